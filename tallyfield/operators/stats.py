"""Per-(match, team) statistics, sparse outcome counts and descriptive graphs. All are grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from ..functions.seasons import season_of


def ratio(n, d) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.round(F.try_divide(c(n).cast("double"), c(d).cast("double")), 6)


def count_if(condition: str) -> Column:
    return F.sum(F.when(F.expr(condition), 1).otherwise(0)).cast("long")


def outcome_table(ev: DataFrame) -> DataFrame:
    """Counts by (match, team, opponent, zone, outcome): outcome is the next zone, a shot or a loss."""
    z1 = F.expr(f"case kind when 'move' then {pitch.zone('end_x', 'end_y')} when 'shot' then {pitch.SHOT} else {pitch.LOSS} end")
    a = ev.where("kind is not null").select("match_id", "team_id", "opp_id", F.expr(pitch.zone("x", "y")).alias("z0"), z1.alias("out"), F.when(F.col("kind") == "shot", F.col("xg")).alias("xg"))
    return a.groupBy("match_id", "team_id", "opp_id", "z0", "out").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("xg"), F.lit(0.0)), 6).alias("xg"))


def outcome_totals(ev: DataFrame) -> DataFrame:
    return outcome_table(ev).groupBy("z0", "out").agg(F.sum("n").alias("n"), F.round(F.sum("xg"), 5).alias("xg"))


def start_table(ev: DataFrame) -> DataFrame:
    """Zone of each possession's first open-play action."""
    first = ev.where("kind is not null").groupBy("match_id", "team_id", "opp_id", "possession").agg(F.min_by(F.struct("x", "y"), "idx").alias("p"))
    return first.groupBy("match_id", "team_id", "opp_id", F.expr(pitch.zone("p.x", "p.y")).alias("z0")).agg(F.count("*").alias("n"))


def progressions(ev: DataFrame) -> DataFrame:
    """First crossing of x = 40 and x = 80 in each possession: idx, lane, player; what came of it."""
    at = lambda line: F.min_by(F.when(F.expr(pitch.crosses(line)), F.struct("idx", F.expr(pitch.crossing_lane(line)).alias("lane"), "player_id")), F.when(F.expr(pitch.crosses(line)), F.col("idx")))
    g = ev.where("action is not null").groupBy("match_id", "possession", "team_id").agg(at(40).alias("mid"), at(80).alias("fin"), F.round(F.max("xg_after"), 6).alias("xg"), F.max(F.col("action") == "shot").alias("shot"), (F.min_by("x", "idx") < 40).alias("deep"))
    return g.where("mid is not null or fin is not null").select("match_id", "possession", "team_id", F.col("mid.idx").alias("idx_mid"), F.col("mid.lane").alias("lane_mid"), F.col("fin.idx").alias("idx_final"), F.col("fin.lane").alias("lane_final"), F.col("fin.player_id").alias("player_final"), "xg", "shot", "deep")


def route_table(prog: DataFrame) -> DataFrame:
    r = prog.where("lane_mid is not null and lane_final is not null").groupBy("team_id", "lane_mid", "lane_final").agg(F.count("*").alias("n"), F.round(F.avg(F.col("shot").cast("double")), 6).alias("shot_rate"), F.round(F.avg("xg"), 9).alias("mean_xg"))
    return r.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy("team_id"))))


def lane_shares(prog: DataFrame) -> DataFrame:
    teams = prog.select("team_id").distinct()
    n = prog.where("lane_final is not null").groupBy("team_id", F.col("lane_final").alias("lane")).agg(F.count("*").alias("n"))
    full = teams.select("team_id", F.explode(F.array(*(F.lit(k) for k in range(5)))).alias("lane")).join(n, ["team_id", "lane"], "left").fillna(0, ["n"])
    return full.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy("team_id"))))


def ledger(ev: DataFrame) -> DataFrame:
    """One row for each (match, team): what it did, what it conceded. Missing cells are 0."""
    entry = pitch.crosses(80)
    one = ev.groupBy("match_id", "team_id", "opp_id").agg(
        count_if("type = 'Pass'").alias("passes"),
        count_if("type = 'Pass' and action is not null and restart is null").alias("open_passes"),
        count_if("type = 'Pass' and action is not null and restart is null and sqrt((end_x - x) * (end_x - x) + (end_y - y) * (end_y - y)) > 35").alias("long_passes"),
        count_if("type = 'Pass' and x < 72").alias("passes_low"),
        count_if(f"{pitch.DEFENSIVE} and x > 48").alias("def_actions"),
        F.round(F.coalesce(F.sum(F.when(F.expr("kind = 'shot'"), F.col("xg"))), F.lit(0.0)), 6).alias("xg"),
        count_if("kind = 'shot'").alias("shots"),
    )
    pos = ev.where("action is not null").groupBy("match_id", "team_id", "possession").agg(
        F.min_by("x", "idx").alias("x0"), F.max(F.when(F.expr("action = 'move'"), F.col("end_x"))).alias("reach"),
        F.min_by(F.struct("pos_seconds", F.expr(pitch.crossing_lane(80)).alias("lane")), F.when(F.expr(entry), F.col("idx"))).alias("e"), F.max(F.expr(entry)).alias("entered"),
    )
    two = pos.groupBy("match_id", "team_id").agg(
        count_if("x0 < 40").alias("deep"), count_if("x0 < 40 and reach >= 80").alias("deep_reached"), count_if("entered").alias("entries"), count_if("entered and e.pos_seconds <= 10").alias("entries_fast"), count_if("entered and e.lane in (0, 4)").alias("entries_wide"),
    )
    press = ev.where("type = 'Pressure' and not in_possession").groupBy("match_id", "team_id", "possession").agg(F.min_by("x", F.struct("clock", "idx")).alias("px")).groupBy("match_id", "team_id").agg(F.count("*").alias("press_starts"), F.round(F.sum("px"), 6).alias("press_x"))
    cols = ["deep", "deep_reached", "entries", "entries_fast", "entries_wide", "press_starts"]
    led = one.join(two, ["match_id", "team_id"], "left").join(press, ["match_id", "team_id"], "left").fillna(0, cols).fillna(0.0, ["press_x"])
    other = led.select("match_id", F.col("team_id").alias("opp_id"), F.col("passes").alias("opp_passes"), F.col("passes_low").alias("opp_passes_low"), F.col("xg").alias("opp_xg"), F.col("entries").alias("opp_entries"), F.col("entries_wide").alias("opp_entries_wide"))
    return led.join(other, ["match_id", "opp_id"], "left").fillna(0, ["opp_passes", "opp_passes_low", "opp_entries", "opp_entries_wide"]).fillna(0.0, ["opp_xg"])


# Claims as sum(num) / sum(den) over a team's matches.
CLAIMS = (
    ("possession", "passes", "passes + opp_passes"), ("buildup_success", "deep_reached", "deep"), ("fast_attacks", "entries_fast", "entries"),
    ("long_balls", "long_passes", "open_passes"), ("wide_entries", "entries_wide", "entries"), ("xg_per_match", "xg", "1"), ("ppda", "opp_passes_low", "def_actions"),
    ("press_height", "press_x", "press_starts"), ("conceded_xg", "opp_xg", "1"), ("conceded_wide", "opp_entries_wide", "opp_entries"),
)


def claims(led: DataFrame, table=CLAIMS) -> DataFrame:
    """Every team and claim with its value, league rank (highest first), number of teams and median."""
    rows = ", ".join(f"'{k}', cast({n} as double), cast({d} as double)" for k, n, d in table)
    long = led.selectExpr("match_id", "team_id", f"stack({len(table)}, {rows}) as (claim, num, den)")
    v = long.groupBy("team_id", "claim").agg(ratio(F.sum("num"), F.sum("den")).alias("value")).where("value is not null")
    w = Window.partitionBy(season_of(), "claim")
    return v.select("team_id", "claim", "value", F.rank().over(w.orderBy(F.desc("value"))).cast("int").alias("rank"), F.count("*").over(w).alias("of"), F.round(F.percentile("value", F.lit(0.5)).over(w), 6).alias("median"))


def opponent_adjustment(led: DataFrame) -> DataFrame:
    """Mean of what opponents made here less what they make elsewhere: leave-one-out by subtraction."""
    w = Window.partitionBy("team_id")
    made = led.select("match_id", "team_id", "opp_id", "xg", F.try_divide(F.sum("xg").over(w) - F.col("xg"), (F.count("xg").over(w) - 1).cast("double")).alias("elsewhere"))
    return made.groupBy(F.col("opp_id").alias("team_id")).agg(F.round(F.avg(F.col("xg") - F.col("elsewhere")), 9).alias("adjustment"), F.count("elsewhere").alias("n"))


def copress_edges(ev: DataFrame, seconds: float = 2.0, least: int = 1) -> DataFrame:
    """Unordered pairs of players who press within `seconds` in the same possession: equi join, then a range."""
    p = ev.where("type = 'Pressure'").select("match_id", "possession", "team_id", "clock", "player_id")
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a.possession") == F.col("b.possession")) & (F.col("a.team_id") == F.col("b.team_id")) & (F.col("b.clock") > F.col("a.clock")) & (F.col("b.clock") - F.col("a.clock") <= seconds) & (F.col("a.player_id") != F.col("b.player_id")))
    return j.groupBy("a.team_id", F.least("a.player_id", "b.player_id").alias("p"), F.greatest("a.player_id", "b.player_id").alias("q")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def player_nodes(ev: DataFrame) -> DataFrame:
    a = ev.where("action is not null")
    return a.groupBy("team_id", "player_id").agg(F.count("*").alias("n"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("x"), F.round(F.percentile("y", F.lit(0.5)), 6).alias("y"))


def zone_graph(ev: DataFrame) -> DataFrame:
    return ev.where("kind = 'move'").groupBy("team_id", F.expr(pitch.region("x", "y")).alias("r0"), F.expr(pitch.region("end_x", "end_y")).alias("r1")).agg(F.count("*").alias("n"))


def setpieces(ev: DataFrame) -> DataFrame:
    shot = "type = 'Shot' and coalesce(sub_type, '') <> 'Penalty'"
    sp = f"{shot} and play_pattern in ('From Corner', 'From Free Kick')"
    g = ev.where("period <= 4").groupBy("match_id", "team_id").agg(
        count_if("type = 'Pass' and sub_type = 'Corner'").alias("corners"), count_if("sub_type = 'Free Kick' and type in ('Pass', 'Shot') and x >= 80").alias("att_free_kicks"), count_if(sp).alias("sp_shots"),
        F.round(F.coalesce(F.sum(F.when(F.expr(sp), F.col("xg"))), F.lit(0.0)), 6).alias("sp_xg"), F.sum(F.when(F.expr(shot), F.col("xg"))).alias("all_xg"), count_if(f"{shot} and play_pattern = 'From Corner'").alias("corner_shots"),
    )
    return g.select("match_id", "team_id", "corners", "att_free_kicks", "sp_shots", "sp_xg", ratio("sp_xg", "all_xg").alias("sp_xg_share"), ratio("corner_shots", "corners").alias("shots_per_corner"))


def results(ev: DataFrame) -> DataFrame:
    """Goals and non-penalty xg of both sides of every match."""
    shot = "type = 'Shot' and coalesce(sub_type, '') <> 'Penalty'"
    return ev.where("period <= 4").groupBy("match_id", "match_date", "team_id", "opp_id", (F.col("team_id") == F.col("home_team_id")).alias("home")).agg(count_if(pitch.GOAL).alias("goals"), F.round(F.coalesce(F.sum(F.when(F.expr(shot), F.col("xg"))), F.lit(0.0)), 6).alias("xg"))


def asof_calls(res: DataFrame, feature: str = "xg", pseudo: float = 5.0) -> DataFrame:
    """Shrunk own and against means over strictly earlier dates; same-day matches are left out by a RANGE frame."""
    day = F.datediff("match_date", F.lit("2024-01-01").cast("date"))
    r = res.withColumn("day", day).withColumn("v", F.col(feature))
    past = lambda *by: Window.partitionBy(*by).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("season", season_of())
    everyone = r.groupBy("season", "day").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    league = everyone.withColumn("league", F.try_divide(F.sum("s").over(past("season")), F.sum("n").over(past("season")).cast("double"))).select("season", "day", "league")
    r = r.join(league, ["season", "day"])
    mean = lambda side: (F.coalesce(F.sum("v").over(past(side)), F.lit(0.0)) + pseudo * F.col("league")) / (F.count("v").over(past(side)) + pseudo)
    out = r.withColumn("own", mean("team_id")).withColumn("against", mean("opp_id")).withColumn("n_prior", F.count("*").over(past("team_id")))
    return out.where("league is not null").select("match_id", "team_id", F.round("v", 6).alias("actual"), F.round("league", 9).alias("league"), F.round("own", 9).alias("own"), F.round("against", 9).alias("against"), F.round(F.expr("own + against - league"), 9).alias("call"), "n_prior")


HIGHEST_RATE = 300.0  # fixed value: the product of both sides' exp(-rate) is a normal double up to here


def chances(calls: DataFrame, *keys: str) -> DataFrame:
    """Home, draw and away chances of independent Poisson goals 0..12, from both sides' calls; by match_id and `keys`.
    exp(-rate) is common to all goals of a side and cancels out; it is held above 0, so that no rate leaves a total of 0."""
    def pmf(rate: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.exp(-F.least(F.col(rate), F.lit(HIGHEST_RATE))) * F.pow(F.col(rate), k) / F.factorial(k.cast("int")).cast("double"))

    c = calls.withColumn("a", pmf("home_rate")).withColumn("b", pmf("away_rate"))
    below = lambda v, k: F.aggregate(F.slice(v, 1, k), F.lit(0.0), lambda s, x: s + x)
    index = F.sequence(F.lit(0), F.lit(12))
    c = c.withColumn("h", F.aggregate(index, F.lit(0.0), lambda s, k: s + F.element_at("a", k + 1) * below("b", k)))
    c = c.withColumn("d", F.aggregate(index, F.lit(0.0), lambda s, k: s + F.element_at("a", k + 1) * F.element_at("b", k + 1)))
    c = c.withColumn("w", F.aggregate(index, F.lit(0.0), lambda s, k: s + F.element_at("b", k + 1) * below("a", k)))
    t = F.col("h") + F.col("d") + F.col("w")
    return c.select("match_id", *keys, F.round(F.col("h") / t, 6).alias("home"), F.round(F.col("d") / t, 6).alias("draw"), F.round(F.col("w") / t, 6).alias("away"))


def result_calls(res: DataFrame, floor: float = 0.05, least_prior: int = 5) -> DataFrame:
    """Chances before each match by model (xg, goals, blend, base), from strictly earlier dates only. A side's rate is its
    as-of call times the league's home factor, and goals/xg for xg; base is the league's shares of results.
    scored: both sides are in the later half of their fixtures, with `least_prior` matches before."""
    side = lambda c, at: F.when(F.col("home") == at, F.col(c))
    h = res.where("home").select("match_id", "match_date", F.col("team_id").alias("home_id"), F.col("goals").alias("hg"))
    a = res.where("not home").select("match_id", F.col("team_id").alias("away_id"), F.col("goals").alias("ag"))
    # League means before the day: sums by day first, so the running window has one row for each day of a season.
    both = h.join(a, "match_id").withColumn("season", season_of("home_id"))
    ends = both.select("match_id", (F.col("hg") > F.col("ag")).cast("double").alias("w"), (F.col("hg") == F.col("ag")).cast("double").alias("d"))
    day = res.withColumn("season", season_of()).join(ends, "match_id", "left").groupBy("season", "match_date").agg(*(F.sum(v).alias(k) for k, v in (
        ("sx", F.col("xg")), ("sg", F.col("goals")), ("sh", side("goals", True)), ("sa", side("goals", False)), ("sw", side("w", True)), ("sd", side("d", True)))),
        F.count("*").alias("n"), F.count(side("goals", True)).alias("nh"), F.count(side("goals", False)).alias("na"), F.count(side("w", True)).alias("nw"))
    past = Window.partitionBy("season").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    mean = lambda s, n: F.try_divide(F.sum(s).over(past).cast("double"), F.sum(n).over(past).cast("double"))
    day = day.select("season", "match_date", mean("sx", "n").alias("lx"), mean("sg", "n").alias("lg"), mean("sh", "nh").alias("lh"), mean("sa", "na").alias("la"), mean("sw", "nw").alias("lw"), mean("sd", "nw").alias("ld"))
    place = Window.partitionBy("team_id")
    later = F.row_number().over(place.orderBy("match_date", "match_id")) - 1 >= F.floor(F.count("*").over(place) * 0.5)
    half = res.select("match_id", "team_id", later.alias("later"))
    call = asof_calls(res, "xg").select("match_id", "team_id", F.col("call").alias("x"), "n_prior").join(asof_calls(res, "goals").select("match_id", "team_id", F.col("call").alias("g")), ["match_id", "team_id"]).join(half, ["match_id", "team_id"])
    call = call.select("match_id", "team_id", "x", "g", (F.col("later") & (F.col("n_prior") >= least_prior)).alias("ok"))
    of = lambda s: call.select("match_id", F.col("team_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("x", "g", "ok")))
    m = both.join(day, ["season", "match_date"]).join(of("home"), ["match_id", "home_id"]).join(of("away"), ["match_id", "away_id"]).where("lx > 0 and lg > 0 and lh is not null and la is not null and lw is not null")
    rate = lambda c, by: F.greatest(F.col(c), F.lit(floor)) * by
    factor, ratio_ = {"home": F.col("lh") / F.col("lg"), "away": F.col("la") / F.col("lg")}, F.col("lg") / F.col("lx")
    m = m.select("match_id", "home_ok", "away_ok", "lw", "ld", *(rate(f"{s}_x", ratio_ * factor[s]).alias(f"{s}_xg") for s in factor), *(rate(f"{s}_g", factor[s]).alias(f"{s}_goals") for s in factor))
    models = m.selectExpr("match_id", "home_ok and away_ok as scored", "stack(3, 'xg', home_xg, away_xg, 'goals', home_goals, away_goals, 'blend', (home_xg + home_goals) / 2, (away_xg + away_goals) / 2) as (model, home_rate, away_rate)")
    keys = ["model", "scored", "home_rate", "away_rate"]
    base = m.selectExpr("match_id", "'base' as model", "home_ok and away_ok as scored", "cast(null as double) as home_rate", "cast(null as double) as away_rate", "round(lw, 6) as home", "round(ld, 6) as draw", "round(1 - lw - ld, 6) as away")
    out = chances(models, *keys).unionByName(base)
    return out.select("match_id", "model", "scored", *(F.round(c, 6).alias(c) for c in ("home_rate", "away_rate")), "home", "draw", "away")
