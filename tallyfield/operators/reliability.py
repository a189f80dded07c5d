"""How far a figure can be trusted: intervals by resampling matches, halves, labels. Weights are hashed, not drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seasons import season_of
from .scoring import replicate_weight

ORDINALS = {1: "st", 2: "nd", 3: "rd"}


def label(value: Column, lo: Column, hi: Column, league: Column, first: Column, second: Column) -> Column:
    """High, Medium or Low: the interval excludes the league's value, and both halves lie on one side of it. Without a
    league's value: the interval is narrow, and the halves are close."""
    apart, agree = (lo > league) | (hi < league), (first - league) * (second - league) > 0
    narrow, close = (hi - lo) <= 0.5 * F.abs(value), F.abs(first - second) <= 0.25 * F.abs(value)
    points = lambda a, b: F.coalesce(a, F.lit(False)).cast("int") + F.coalesce(b, F.lit(False)).cast("int")
    n = F.when(league.isNull(), F.when(value == 0, 0).otherwise(points(narrow, close))).otherwise(points(apart, agree))
    return F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), n + 1)


def rank_words(rank: Column, of: Column) -> Column:
    """3rd highest, 2nd lowest, highest, lowest."""
    high = rank <= of / 2
    k = F.when(high, rank).otherwise(of - rank + 1)
    teen = (k % 100 >= 11) & (k % 100 <= 13)
    end = F.when(teen, "th")
    for d, e in ORDINALS.items():
        end = end.when(k % 10 == d, e)
    word = F.when(high, "highest").otherwise("lowest")
    return F.when(k == 1, word).otherwise(F.concat(k.cast("string"), end.otherwise("th"), F.lit(" "), word))


def claim_estimates(led: DataFrame, table, reps: int = 200) -> DataFrame:
    """Every team and claim: value, 5-95 % interval, the league's median, alternate-match halves, confidence, rank in words."""
    rows = ", ".join(f"'{k}', cast({n} as double), cast({d} as double)" for k, n, d in table)
    half = (F.row_number().over(Window.partitionBy("team_id").orderBy("match_id")) - 1) % 2
    m = led.withColumn("half", half).selectExpr("match_id", "team_id", "half", f"stack({len(table)}, {rows}) as (claim, num, den)")
    keys = ["team_id", "claim"]
    of = lambda c: F.try_divide(F.sum(F.when(c, F.col("num"))), F.sum(F.when(c, F.col("den"))))
    v = m.groupBy(*keys).agg(F.count("*").alias("matches"), of(F.lit(True)).alias("value"), of(F.col("half") == 0).alias("first"), of(F.col("half") == 1).alias("second"))
    d = m.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", replicate_weight("match_id", "rep"))
    d = d.groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col("num")), F.sum(F.col("w") * F.col("den"))).alias("r"))
    d = d.groupBy(*keys).agg(F.percentile("r", F.lit(0.05)).alias("lo"), F.percentile("r", F.lit(0.95)).alias("hi"))
    w = Window.partitionBy(season_of(), "claim")
    e = v.join(d, keys).where("value is not null").withColumn("league", F.percentile("value", F.lit(0.5)).over(w)).withColumn("of", F.count("*").over(w))
    e = e.withColumn("rank", F.rank().over(w.orderBy(F.desc(F.round("value", 9)))))
    r = {c: F.round(c, 6) for c in ("value", "lo", "hi", "league", "first", "second")}
    conf = F.when(F.col("matches") < 2, "Low").otherwise(label(*r.values()))
    return e.select(*keys, "matches", *(c.alias(k) for k, c in r.items()), F.round(F.try_divide("value", "league"), 6).alias("vs_league"), conf.alias("confidence"), "rank", "of", rank_words(F.col("rank"), F.col("of")).alias("words"))


def half_agreement(estimates: DataFrame) -> DataFrame:
    """Share of claims whose halves lie on the same side of the league's value, by claim."""
    same = (F.col("first") - F.col("league")) * (F.col("second") - F.col("league")) > 0
    return estimates.where("first is not null and second is not null").groupBy("claim").agg(F.count("*").alias("n"), F.round(F.avg(same.cast("double")), 6).alias("agreement"))


def estimate(rows: DataFrame, stat: Column, *keys: str, reps: int = 300, league: Column | None = None) -> DataFrame:
    """Any aggregate `stat` over rows with match_id, by keys: value, interval over resampled matches, halves, confidence.
    A match that is drawn several times counts as several: its copies differ in match_id."""
    half = (F.dense_rank().over(Window.partitionBy(*keys).orderBy("match_id")) - 1) % 2
    r = rows.withColumn("half", half)
    whole = r.groupBy(*keys).agg(stat.alias("value"), F.countDistinct("match_id").alias("matches"))
    parts = [r.where(F.col("half") == k).groupBy(*keys).agg(stat.alias(n)) for k, n in enumerate(("first", "second"))]
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", replicate_weight("match_id", "rep")).where("w > 0")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w")))).withColumn("match_id", F.concat_ws("/", F.col("match_id").cast("string"), "copy"))
    ends = drawn.groupBy(*keys, "rep").agg(stat.alias("v")).groupBy(*keys).agg(F.percentile("v", F.lit(0.05)).alias("lo"), F.percentile("v", F.lit(0.95)).alias("hi"))
    out = whole
    for p in (*parts, ends):
        out = out.join(p, list(keys), "left")
    usual = F.lit(None).cast("double") if league is None else league
    conf = F.when(F.col("matches") < 2, "Low").otherwise(label(F.col("value"), F.col("lo"), F.col("hi"), usual, F.col("first"), F.col("second")))
    return out.select(*keys, "matches", "value", "lo", "hi", "first", "second", conf.alias("confidence"))
