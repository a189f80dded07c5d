"""A season's chains, solved: values, visits and threat of each side, region flows, style, match-ups and denial plans.

Chains are long: cells (side, team_id, z0, out, p) and zones (side, team_id, z0, g, start). A side is 'attack', 'conceded'
(what opponents do against the team) or 'league' (team_id -1). Arrays appear only in the grouped solves, whose groups are
one chain of 30 zones each.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from ..functions.seasons import LEAGUE as LEAGUE
from ..functions.seasons import league_key, season_of
from .chain import league_chain, team_chains, with_kappa
from .matchup import CLIP, REGIONS, _middle, _region, conceded_counts, denied, middle_crossing, solve

N = pitch.ZONES
KAPPA_XG = 10.0  # fixed value: pseudo shots of a zone's shot quality
MATERIAL = 0.03  # fixed value: least mean drop of an unusual link


def once(df: DataFrame) -> DataFrame:
    """A table that several branches of a plan read: checkpointed in the shared folder, or cached where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def kept(df: DataFrame, name: str) -> DataFrame:
    """As `once`, for rows as many as the events: columns in files of the shared folder, of which each reader takes the few it needs."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.cache()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _zones(counts: DataFrame, starts: DataFrame, kappa: float | DataFrame, side: str) -> DataFrame:
    """Shot quality and starts of every team and zone, shrunk to those of the season's league."""
    spark = counts.sparkSession
    shots = counts.where(F.col("out") == pitch.SHOT)
    s = season_of().alias("season")
    total = starts.groupBy(s).agg(F.sum("n").alias("all"))
    league = counts.select(s).distinct().crossJoin(F.broadcast(spark.range(N).selectExpr("cast(id as int) as z0")))
    league = league.join(shots.groupBy(s, "z0").agg((F.sum("xg") / F.sum("n")).alias("gl")), ["season", "z0"], "left")
    league = league.join(starts.groupBy(s, "z0").agg(F.sum("n").alias("ns")), ["season", "z0"], "left").join(total, "season", "left")
    league = league.select("season", "z0", F.coalesce("gl", F.lit(0.0)).alias("gl"), F.coalesce(F.try_divide(F.coalesce("ns", F.lit(0)), "all"), F.lit(1.0 / N)).alias("sl"))
    if side == "league":
        return league.select(F.lit(side).alias("side"), league_key().alias("team_id"), "z0", F.col("gl").alias("g"), F.col("sl").alias("start"))
    if side == "conceded":
        shots, starts = conceded_counts(shots), starts.withColumnRenamed("team_id", "made").withColumnRenamed("opp_id", "team_id")
    teams = counts.select(F.col("team_id" if side == "attack" else "opp_id").alias("team_id")).distinct().withColumn("season", season_of())
    return _shrunk(teams, shots, starts, league, kappa).select(F.lit(side).alias("side"), "team_id", "z0", "g", "start")


def _shrunk(teams: DataFrame, shots: DataFrame, starts: DataFrame, league: DataFrame, kappa: float | DataFrame) -> DataFrame:
    """team_id, z0, g, start of teams (team_id, season): thirty rows each."""
    full = teams.join(league, "season")
    full = full.join(shots.groupBy("team_id", "z0").agg(F.sum("xg").alias("xg"), F.sum("n").alias("shots")), ["team_id", "z0"], "left")
    full = full.join(starts.groupBy("team_id", "z0").agg(F.sum("n").alias("ns")), ["team_id", "z0"], "left").fillna(0, ["shots", "ns"]).fillna(0.0, ["xg"])
    w = F.col("ns") + F.col("kappa") * F.col("sl")
    return with_kappa(full, kappa).select("team_id", "z0", ((F.col("xg") + KAPPA_XG * F.col("gl")) / (F.col("shots") + KAPPA_XG)).alias("g"), (w / F.sum(w).over(Window.partitionBy("team_id"))).alias("start"))


def season_chains(counts: DataFrame, starts: DataFrame, kappa: float | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and zones of all three sides."""
    sided = lambda df, side: df.select(F.lit(side).alias("side"), F.col("team_id").cast("long").alias("team_id"), "z0", "out", "p")
    cells = sided(team_chains(counts, kappa), "attack").union(sided(team_chains(conceded_counts(counts), kappa), "conceded"))
    cells = cells.union(sided(league_chain(counts).withColumn("team_id", league_key()), "league"))
    zones = [_zones(counts, starts, kappa, side) for side in ("attack", "conceded", "league")]
    return cells, zones[0].union(zones[1]).union(zones[2])


def _matrices(g: pd.DataFrame, p: str = "p", q: str = "g", s: str = "start") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moves, gain of a shot and starts out of the 960 rows of a chain."""
    m, gain, start = np.zeros((N, N + 2)), np.zeros(N), np.zeros(N)
    z = g["z0"].to_numpy(int)
    m[z, g["out"].to_numpy(int)] = g[p].to_numpy(float)
    gain[z], start[z] = g[q].to_numpy(float), g[s].to_numpy(float)
    return m[:, :N], m[:, pitch.SHOT] * gain, start


def solved(cells: DataFrame, zones: DataFrame, *keys: str) -> DataFrame:
    """keys, z0, start, value, visits: chance of a goal from each zone, and actions there for each possession."""
    kinds = dict(zones.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        move, gain, start = _matrices(g)
        value, visits = np.linalg.solve(np.eye(N) - move, gain), np.linalg.solve((np.eye(N) - move).T, start)
        return pd.DataFrame({**{k: [g[k].iloc[0]] * N for k in keys}, "z0": np.arange(N), "start": start, "value": value, "visits": visits})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", z0 int, start double, value double, visits double"
    return cells.join(zones, [*keys, "z0"]).groupBy(*keys).applyInPandas(run, schema)


def threats(zones: DataFrame, *keys: str) -> DataFrame:
    """Expected goals of a possession: starts times values."""
    return zones.groupBy(*keys).agg(F.sum(F.col("start") * F.col("value")).alias("threat"))


def distances(cells: DataFrame, zones: DataFrame, other: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """team_a, team_b, distance: Jensen-Shannon divergence (base 2) of two teams' zone rows, weighted by the mean of
    their shares of visits. cells: team_id, z0, out, p; zones: team_id, z0, visits. With `other`, all of one against all of it."""
    share = F.greatest("visits", F.lit(0.0)) / F.sum(F.greatest("visits", F.lit(0.0))).over(Window.partitionBy("team_id"))
    full = lambda c, z: c.join(z.select("team_id", "z0", share.alias("w")), ["team_id", "z0"]).select("team_id", "z0", "out", "p", "w")
    mine = full(cells, zones)
    theirs = full(*other) if other else mine
    a, b = mine.alias("a"), theirs.alias("b")
    apart = season_of("a.team_id") == season_of("b.team_id")
    apart = apart if other else apart & (F.col("a.team_id") < F.col("b.team_id"))
    j = a.join(b, (F.col("a.z0") == F.col("b.z0")) & (F.col("a.out") == F.col("b.out")) & apart)
    m = (F.col("a.p") + F.col("b.p")) / 2
    part = lambda p: F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) / m)).otherwise(0.0)
    term = (F.col("a.w") + F.col("b.w")) / 2 * (part("a.p") + part("b.p")) / 2
    return j.groupBy(F.col("a.team_id").alias("team_a"), F.col("b.team_id").alias("team_b")).agg(F.round(F.sum(term), 6).alias("distance"))


def reidentified(halves: DataFrame) -> DataFrame:
    """Place of the team's own other half among all, by distance between the first half (team_a) and the second (team_b)."""
    place = F.row_number().over(Window.partitionBy("team_a").orderBy("distance", "team_b"))
    r = halves.withColumn("place", place).where("team_a = team_b").select(F.col("team_a").alias("team_id"), "place", "distance")
    w = Window.partitionBy(season_of())
    return r.withColumn("top1", F.round(F.avg((F.col("place") == 1).cast("double")).over(w), 6)).withColumn("top3", F.round(F.avg((F.col("place") <= 3).cast("double")).over(w), 6))


def half_distances(counts: DataFrame, starts: DataFrame, kappa: float | DataFrame) -> DataFrame:
    """Distances between chains of a team's odd matches and of its even ones, each shrunk to the league of all."""
    order = counts.select("team_id", "match_id").distinct()
    order = order.withColumn("half", (F.row_number().over(Window.partitionBy("team_id").orderBy("match_id")) - 1) % 2)
    league, zones = league_chain(counts), _zones(counts, starts, kappa, "league").select(season_of().alias("season"), "z0", F.col("g").alias("gl"), F.col("start").alias("sl"))
    out = []
    for k in (0, 1):
        part = order.where(F.col("half") == k)
        c, s = (df.join(part, ["team_id", "match_id"], "left_semi") for df in (counts, starts))
        cells = _shrunk_to(c, league, kappa)
        z = _shrunk(c.select("team_id", season_of().alias("season")).distinct(), c.where(F.col("out") == pitch.SHOT), s, zones, kappa)
        out.append((cells, solved(cells, z, "team_id")))
    return distances(*out[0], other=out[1])


def _shrunk_to(counts: DataFrame, league: DataFrame, kappa: float | DataFrame) -> DataFrame:
    n = counts.groupBy("team_id", "z0", "out").agg(F.sum("n").alias("n"))
    full = n.select("team_id", season_of().alias("season")).distinct().join(league, "season").join(n, ["team_id", "z0", "out"], "left").fillna(0, ["n"])
    k = F.col("kappa")
    return with_kappa(full, kappa).select("team_id", "z0", "out", ((F.col("n") + k * F.col("p")) / (F.sum("n").over(Window.partitionBy("team_id", "z0")) + k)).alias("p"))


def scaled(distances_: DataFrame) -> DataFrame:
    """Two coordinates for each team whose distances are close to the given ones (classical scaling; signs are free).
    A season is one group, of its teams squared rows."""
    both = distances_.select("team_a", "team_b", "distance").union(distances_.select("team_b", "team_a", "distance"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = g.pivot(index="team_a", columns="team_b", values="distance").fillna(0.0)
        n = len(d)
        j = np.eye(n) - 1 / n
        size, way = np.linalg.eigh(-0.5 * j @ d.to_numpy() ** 2 @ j)
        top = np.argsort(size)[::-1][:2]
        xy = way[:, top] * np.sqrt(np.clip(size[top], 0, None))
        xy = np.column_stack([xy, np.zeros((n, 2 - xy.shape[1]))])
        return pd.DataFrame({"team_id": d.index, "x": xy[:, 0], "y": xy[:, 1]})

    return both.groupBy(season_of("team_a").alias("season")).applyInPandas(run, "team_id long, x double, y double")


def region_flows(cells: DataFrame, zones: DataFrame, *keys: str) -> DataFrame:
    """Moves between the 15 regions in a possession: visits times chances. zones have visits."""
    third = lambda z: f"(case when floor({z} / 5) < 2 then 0 when floor({z} / 5) < 4 then 1 else 2 end * 5 + {z} % 5)"
    j = cells.where(F.col("out") < N).join(zones.select(*keys, "z0", "visits"), [*keys, "z0"])
    return j.groupBy(*keys, F.expr(third("z0")).cast("int").alias("r0"), F.expr(third("out")).cast("int").alias("r1")).agg(F.sum(F.col("visits") * F.col("p")).alias("flow"))


def _with_usual(some: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows with that of the season's league."""
    league = flows.where("side = 'league'").select(season_of().alias("season"), "r0", "r1", F.col("flow").alias("usual"))
    return some.withColumn("season", season_of()).join(league, ["season", "r0", "r1"], "left").drop("season")


def strongest_links(flows: DataFrame, k: int = 10) -> DataFrame:
    """A side's k strongest links between different regions, and how each compares with the league's."""
    f = _with_usual(flows.where("side <> 'league' and r0 <> r1"), flows)
    place = F.row_number().over(Window.partitionBy("side", "team_id").orderBy(F.desc(F.round("flow", 9)), "r0", "r1"))
    f = f.withColumn("place", place).where(F.col("place") <= k)
    return f.select("side", "team_id", "r0", "r1", "place", F.round("flow", 6).alias("flow"), F.round(F.try_divide("flow", "usual"), 6).alias("vs_league"))


def leaks(flows: DataFrame, k: int = 5) -> DataFrame:
    """The k links that opponents use against a team most beyond the league."""
    f = _with_usual(flows.where("side = 'conceded' and r0 <> r1"), flows).withColumn("excess", F.col("flow") - F.coalesce("usual", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc(F.round("excess", 9)), "r0", "r1"))
    return f.withColumn("place", place).where(F.col("place") <= k).select("team_id", "r0", "r1", "place", F.round("flow", 6).alias("flow"), F.round("excess", 6).alias("excess"))


def _lanes(spark) -> DataFrame:
    """Pairs of zones whose line crosses x = 80, with the lane of the crossing: a fixed table of at most 900 rows."""
    pairs = spark.range(N * N).selectExpr(f"cast(id div {N} as int) as z0", f"cast(id % {N} as int) as out")
    return pairs.where(f"{_middle('z0', 'x')} < 80 and {_middle('out', 'x')} >= 80").select("z0", "out", F.expr(pitch.lane(middle_crossing("z0", "out", 80))).alias("lane"))


def entry_lanes(cells: DataFrame, zones: DataFrame, *keys: str) -> DataFrame:
    """Expected share of entries by lane; uniform where there are none."""
    j = cells.join(F.broadcast(_lanes(cells.sparkSession)), ["z0", "out"]).join(zones.select(*keys, "z0", "visits"), [*keys, "z0"])
    n = j.groupBy(*keys, "lane").agg(F.sum(F.col("visits") * F.col("p")).alias("n"))
    every = zones.select(*keys).distinct().withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(4))))
    full = every.join(n, [*keys, "lane"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    return full.select(*keys, "lane", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy(*keys))), F.lit(0.2)).alias("share"))


def _ratio(a: str, b: str) -> F.Column:
    return F.when(F.col(b) > 0, F.least(F.greatest(F.col(a) / F.col(b), F.lit(CLIP[0])), F.lit(CLIP[1]))).otherwise(1.0)


def matchup_parts(cells: DataFrame, zones: DataFrame, fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and zones of team_id's attack against opp_id, for every fixture (team_id, opp_id)."""
    of = lambda df, side, *names: df.where(F.col("side") == side).select(*names)
    pair = ["team_id", "opp_id"]
    against = of(cells, "conceded", F.col("team_id").alias("opp_id"), "z0", "out", F.col("p").alias("pb"))
    c = fixtures.join(of(cells, "attack", "team_id", "z0", "out", "p"), "team_id").join(against, ["opp_id", "z0", "out"])
    s = season_of().alias("season")
    c = c.withColumn("season", s).join(of(cells, "league", s, "z0", "out", F.col("p").alias("pl")), ["season", "z0", "out"]).withColumn("p", F.col("p") * _ratio("pb", "pl"))
    c = c.select(*pair, "z0", "out", (F.col("p") / F.sum("p").over(Window.partitionBy(*pair, "z0"))).alias("p"))
    theirs = of(zones, "conceded", F.col("team_id").alias("opp_id"), "z0", F.col("g").alias("gb"), F.col("start").alias("sb"))
    z = fixtures.join(of(zones, "attack", "team_id", "z0", "g", "start"), "team_id").join(theirs, ["opp_id", "z0"])
    z = z.withColumn("season", s).join(of(zones, "league", s, "z0", F.col("g").alias("gl"), F.col("start").alias("sl")), ["season", "z0"])
    w = F.col("start") * _ratio("sb", "sl")
    return c, z.select(*pair, "z0", (F.col("g") * _ratio("gb", "gl")).alias("g"), (w / F.sum(w).over(Window.partitionBy(*pair))).alias("start"))


def matchups(cells: DataFrame, zones: DataFrame, fixtures: DataFrame) -> DataFrame:
    """For each fixture: threat, its change against the team's usual one, and the shares of entry lanes, own and against this opponent."""
    c, z = matchup_parts(cells, zones, fixtures)
    pair = solved(c, z, "team_id", "opp_id")
    attack = [df.where("side = 'attack'").drop("side") for df in (cells, zones)]
    own = solved(*attack, "team_id")
    usual = threats(own, "team_id").withColumnRenamed("threat", "usual")
    lanes = entry_lanes(c, pair, "team_id", "opp_id").join(entry_lanes(attack[0], own, "team_id").withColumnRenamed("share", "own_share"), ["team_id", "lane"])
    t = threats(pair, "team_id", "opp_id").join(usual, "team_id")
    r = lambda c: F.round(c, 6).alias(c)
    return lanes.join(t, ["team_id", "opp_id"]).select("team_id", "opp_id", "lane", r("share"), r("own_share"), r("threat"), F.round(F.try_divide("threat", "usual") - 1, 6).alias("vs_usual"))


def denial_plan(cells: DataFrame, zones: DataFrame, counts: DataFrame, least_usage: float = 0.005) -> DataFrame:
    """What denying a link between regions, or all entries to one, costs a side: drops of threat if it adapts and if
    not, the same for the league, the excess over it, place among levers and among unusual links.
    counts (team_id, opp_id, z0, out, n) give how often a link is used; region_from is -1 for entries."""
    moves = counts.where(F.col("out") < N)
    used = moves.select(F.lit("attack").alias("side"), "team_id", "z0", "out", "n").union(moves.select(F.lit("conceded"), "opp_id", "z0", "out", "n"))
    used = used.groupBy("side", "team_id", "z0", "out").agg(F.sum("n").alias("n"))
    league = cells.where("side = 'league'").join(zones.where("side = 'league'").drop("side"), ["team_id", "z0"]).select(season_of().alias("season"), "z0", "out", F.col("p").alias("pl"), F.col("g").alias("gl"), F.col("start").alias("sl"))
    own = cells.where("side <> 'league'").join(zones, ["side", "team_id", "z0"]).join(used, ["side", "team_id", "z0", "out"], "left").fillna(0, ["n"])
    region = _region(np.arange(N))
    a, b = np.broadcast_to(region[:, None], (N, N)), np.broadcast_to(region[None, :], (N, N))
    masks = [(i, j, (a == i) & (b == j)) for i in range(REGIONS) for j in range(REGIONS) if i != j] + [(-1, j, (a != j) & (b == j)) for j in range(REGIONS)]
    names = ["usage", "drop_adapting", "drop_losing", "league_adapting", "league_losing", "excess"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        both = [_matrices(g), _matrices(g, "pl", "gl", "sl")]
        use = np.zeros((N, N + 2))
        use[g["z0"].to_numpy(int), g["out"].to_numpy(int)] = g["n"].to_numpy(float)
        share = use[:, :N] / max(use[:, :N].sum(), 1.0)
        base, rows = [solve(*m) for m in both], []
        for i, j, blocked in masks:
            u = float(share[blocked].sum())
            if u >= least_usage and base[0] > 0 and base[1] > 0:
                d = [(t - solve(denied(m[0], blocked, adapt), *m[1:])) / t for m, t in zip(both, base, strict=True) for adapt in (True, False)]
                rows.append((g["side"].iloc[0], g["team_id"].iloc[0], i, j, u, *d, (d[0] + d[1] - d[2] - d[3]) / 2))
        return pd.DataFrame(rows, columns=["side", "team_id", "region_from", "region_to", *names])

    schema = "side string, team_id long, region_from int, region_to int, " + ", ".join(f"{c} double" for c in names)
    p = own.withColumn("season", season_of()).join(league, ["season", "z0", "out"]).groupBy("side", "team_id").applyInPandas(run, schema).select("side", "team_id", "region_from", "region_to", *(F.round(c, 6).alias(c) for c in names))
    w = Window.partitionBy("side", "team_id", F.col("region_from") < 0)
    unusual = ((F.col("drop_adapting") + F.col("drop_losing")) / 2 >= MATERIAL) & (F.col("excess") > 0)
    p = p.withColumn("lever", F.row_number().over(w.orderBy(F.desc("drop_adapting"), F.desc("drop_losing"), "region_from", "region_to")))
    return p.withColumn("unusual", F.when(unusual, F.row_number().over(w.orderBy(F.desc(F.when(unusual, F.col("excess"))), "region_from", "region_to"))))
