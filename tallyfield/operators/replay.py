"""What was known before each match: chains, plans and their outcomes, for all teams at once, from strictly earlier dates.

Chains as of a date are running sums of sparse counts: a team's cells over its own dates, the league's over all dates. No match
meets the matches before it. Only the plan solves chains, one fixture at a time, from sparse lists of at most 960 cells.
`by` names columns (a season, a competition) that every sum and join keeps apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pitch
from .matchup import CLIP, X_CENTRES, Y_CENTRES, _region, denied, solve
from .scoring import expected_deviation
from .season import KAPPA_XG, N

KAPPA = 1000.0  # fixed value: pseudo actions of a chain as of a date
LEAST_PRIOR = 5  # fixed value: matches that each of the four chains of a plan needs
LEVERS = {"left": (11, 12), "right": (13, 12)}  # fixed values: from a half-space to the centre of the final third
REGION = "(case when floor({z} / 5) < 2 then 0 when floor({z} / 5) < 4 then 1 else 2 end * 5 + {z} % 5)"
MODELS = ("matchup", "own", "league")
WIDTH = N + 2


def earlier(rows: DataFrame, dates: DataFrame, keys: list[str], cell: list[str], values: list[str]) -> DataFrame:
    """keys, match_date, cell, values: sums of the rows of strictly earlier dates, for every date of a key and each cell that
    the key had used by then. A cell without a row on a date keeps its sum, for the grid has every date of the key."""
    day = rows.groupBy(*keys, "match_date", *cell).agg(*(F.sum(v).alias(v) for v in values))
    used = day.groupBy(*keys, *cell).agg(F.min("match_date").alias("since"))
    grid = dates.join(used, keys) if keys else dates.crossJoin(F.broadcast(used))  # without keys: one row a cell of the pitch
    full = grid.where("match_date >= since").join(day, [*keys, "match_date", *cell], "left")
    past = Window.partitionBy(*keys, *cell).orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    return full.select(*keys, "match_date", *cell, *(F.sum(v).over(past).alias(v) for v in values)).where(" or ".join(f"{v} is not null" for v in values)).fillna(0, values)


def both_sides(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of what a team did (attack) and of what was done to it (conceded)."""
    own = rows.select(F.lit("attack").alias("side"), "team_id", *columns)
    return own.union(rows.select(F.lit("conceded").alias("side"), F.col("opp_id").alias("team_id"), *columns))


def prior_matches(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, side, team_id, match_date, n_prior: matches of the team with rows of that side on earlier dates."""
    keys = [*by, "side", "team_id"]
    day = both_sides(counts, *by, "match_date", "match_id").distinct().groupBy(*keys, "match_date").agg(F.count("*").alias("m"))
    past = Window.partitionBy(*keys).orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    return day.select(*keys, "match_date", F.coalesce(F.sum("m").over(past), F.lit(0)).alias("n_prior"))


def fixtures(ev: DataFrame, by: tuple[str, ...] = (), start_fraction: float = 0.5) -> DataFrame:
    """Each match seen from both teams; later: in the later part of the team's matches by date."""
    m = ev.select(*by, "match_id", "match_date", "home_team_id", "away_team_id").distinct()
    side = lambda a, b, home: m.select(*by, "match_id", "match_date", F.col(a).cast("long").alias("team_id"), F.col(b).cast("long").alias("opp_id"), F.lit(home).alias("home"))
    f = side("home_team_id", "away_team_id", True).union(side("away_team_id", "home_team_id", False))
    place = Window.partitionBy(*by, "team_id")
    return f.withColumn("later", F.row_number().over(place.orderBy("match_date", "match_id")) - 1 >= F.floor(F.count("*").over(place) * start_fraction))


class AsOf:
    """Running sums of cells (z0, out, n) and zones (z0, xg, starts) for teams and the league. counts and starts carry match_date and `by`."""

    def __init__(self, counts: DataFrame, starts: DataFrame, by: tuple[str, ...] = ()):
        self.by, self.counts, self.starts = by, counts, starts
        zones = counts.groupBy(*by, "match_id", "match_date", "team_id", "opp_id", "z0").agg(F.sum("xg").alias("xg"), F.lit(0).cast("long").alias("starts"))
        zones = zones.union(starts.select(*by, "match_id", "match_date", "team_id", "opp_id", "z0", F.lit(0.0).alias("xg"), F.col("n").alias("starts")))
        team, days = [*by, "side", "team_id"], both_sides(counts, *by, "match_date").distinct()
        dates = counts.select(*by, "match_date").distinct()
        self.cells = earlier(both_sides(counts, *by, "match_date", "z0", "out", "n"), days, team, ["z0", "out"], ["n"])
        self.zones = earlier(both_sides(zones, *by, "match_date", "z0", "xg", "starts"), days, team, ["z0"], ["xg", "starts"])
        self.league_cells = earlier(counts, dates, list(by), ["z0", "out"], ["n"])
        self.league_zones = earlier(zones, dates, list(by), ["z0"], ["xg", "starts"])
        self.prior = prior_matches(counts, by)

    def chains(self, kappa: float = KAPPA, least_prior: int = LEAST_PRIOR) -> DataFrame:
        """by, side, team_id, match_date, z0, out, n, p: cells used so far, shrunk to the league of that date, for teams with enough
        matches. A cell that was not used has p = kappa * its league share over (actions of the zone + kappa)."""
        keys = [*self.by, "match_date"]
        lost = F.when(F.col("out") == pitch.LOSS, 1).otherwise(0)
        league = self.league_cells.withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "z0")) + 1)
        league = league.select(*keys, "z0", "out", ((F.col("n") + lost) / F.col("all")).alias("pl"))
        mine = self.cells.withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "side", "team_id", "z0"))).join(self.prior.where(F.col("n_prior") >= least_prior), [*keys, "side", "team_id"])
        p = (F.col("n") + kappa * F.col("pl")) / (F.col("all") + kappa)
        return mine.join(league, [*keys, "z0", "out"]).select(*self.by, "side", "team_id", "match_date", "z0", "out", "n", p.alias("p"), "n_prior")

    def packed(self) -> tuple[DataFrame, DataFrame]:
        """Sparse lists of each chain: of (by, side, team_id, match_date), and of the league by (by, match_date)."""
        cell = F.sort_array(F.collect_list(F.struct((F.col("z0") * WIDTH + F.col("out")).alias("c"), "n"))).alias("cells")
        zone = F.sort_array(F.collect_list(F.struct("z0", "xg", "starts"))).alias("zones")
        pack = lambda c, z, keys: c.groupBy(*keys).agg(cell).join(z.groupBy(*keys).agg(zone), keys, "left")
        day = [*self.by, "match_date"]
        return pack(self.cells, self.zones, [*day, "side", "team_id"]), pack(self.league_cells, self.league_zones, day)


# A chain in numpy is (moves and ends 30 x 32, gain of a shot, starts).
Chain = tuple[np.ndarray, np.ndarray, np.ndarray]
_x, _y = np.repeat(X_CENTRES, 5).astype(float), np.tile(Y_CENTRES, 6).astype(float)
_ENTERS = (_x[:, None] < 80) & (_x[None, :] >= 80)
_AT = _y[:, None] + (_y[None, :] - _y[:, None]) * np.divide(80 - _x[:, None], _x[None, :] - _x[:, None], out=np.zeros((N, N)), where=_ENTERS)
_LANE = sum((_AT >= e).astype(int) for e in pitch.LANE_EDGES)
_R = _region(np.arange(N))


def sums(cells, zones) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, x, s = np.zeros(N * WIDTH), np.zeros(N), np.zeros(N)
    for r in cells if cells is not None else ():
        c[r["c"]] = r["n"]
    for r in zones if zones is not None else ():
        x[r["z0"]], s[r["z0"]] = r["xg"], r["starts"]
    return c.reshape(N, WIDTH), x, s


def league_of(c: np.ndarray, x: np.ndarray, s: np.ndarray) -> Chain:
    c = c.copy()
    c[:, pitch.LOSS] += 1
    shots = c[:, pitch.SHOT]
    return c / c.sum(1, keepdims=True), np.divide(x, shots, out=np.zeros(N), where=shots > 0), s / s.sum() if s.sum() else np.full(N, 1 / N)


def shrunk(c: np.ndarray, x: np.ndarray, s: np.ndarray, league: Chain, kappa: float) -> Chain:
    w = s + kappa * league[2]
    return (c + kappa * league[0]) / (c.sum(1, keepdims=True) + kappa), (x + KAPPA_XG * league[1]) / (c[:, pitch.SHOT] + KAPPA_XG), w / w.sum()


def against(a: Chain, b: Chain, league: Chain) -> Chain:
    """a's attack where b concedes: each part times b's ratio to the league."""
    p, g, s = (v * np.clip(np.divide(q, z, out=np.ones_like(q), where=z > 0), *CLIP) for v, q, z in zip(a, b, league, strict=True))
    return p / p.sum(1, keepdims=True), g, s / s.sum()


def threat(chain: Chain) -> float:
    return solve(chain[0][:, :N], chain[0][:, pitch.SHOT] * chain[1], chain[2])


def lanes(chain: Chain) -> np.ndarray:
    """Expected shares of entries by lane; uniform where there are none."""
    move = chain[0][:, :N]
    flow = np.linalg.solve((np.eye(N) - move).T, chain[2])[:, None] * move
    n = np.bincount(_LANE[_ENTERS], weights=flow[_ENTERS], minlength=5)
    return n / n.sum() if n.sum() > 0 else np.full(5, 0.2)


def drops(chain: Chain, link: tuple[int, int]) -> tuple[float, float]:
    """Shares of threat that go with a link if its moves find another way, and if they are lost."""
    blocked, base = (_R[:, None] == link[0]) & (_R[None, :] == link[1]), threat(chain)
    gain = chain[0][:, pitch.SHOT] * chain[1]
    found, lost = ((base - solve(denied(chain[0][:, :N], blocked, adapt), gain, chain[2])) / base if base > 0 else 0.0 for adapt in (True, False))
    return found, lost


def cost(chain: Chain, link: tuple[int, int]) -> float:
    """The mean of both."""
    return float(np.mean(drops(chain, link)))


def usage(c: np.ndarray, link: tuple[int, int]) -> float:
    move = c[:, :N]
    return float(move[(_R[:, None] == link[0]) & (_R[None, :] == link[1])].sum() / max(move.sum(), 1.0))


def plan_of(sides: dict[str, tuple], league: tuple, kappa: float = KAPPA) -> dict:
    """The plan out of the sums of us_attack, us_conceded, them_attack, them_conceded and the league."""
    lg = league_of(*league)
    ch = {k: shrunk(*v, lg, kappa) for k, v in sides.items()}
    out: dict = {}
    for who, a, b in (("they", "them_attack", "us_conceded"), ("we", "us_attack", "them_conceded")):
        out |= {f"{who}_matchup": lanes(against(ch[a], ch[b], lg)), f"{who}_own": lanes(ch[a]), f"{who}_league": lanes(lg)}
    for side, link in LEVERS.items():
        out |= {f"{side}_share": usage(sides["them_attack"][0], link), f"{side}_value": cost(ch["them_attack"], link), f"{side}_league": cost(lg, link)}
    out["lever_side"] = "right" if out["right_share"] > out["left_share"] else "left"
    out["lane_we"] = int(np.argmax(np.round(out["we_matchup"] - out["we_own"], 12)))
    return out


SIDES = [f"{who}_{side}" for who in ("us", "them") for side in ("attack", "conceded")]
PLAN = ", ".join([f"{who}_{m} array<double>" for who in ("they", "we") for m in MODELS] + [f"{s}_{c} double" for s in LEVERS for c in ("share", "value", "league")] + ["lever_side string", "lane_we int"])
_fields = [f.split()[0] for f in PLAN.split(", ")]


def match_plans(asof: AsOf, games: DataFrame, kappa: float = KAPPA, least_prior: int = LEAST_PRIOR) -> DataFrame:
    """One row for each match and team: earlier matches of both, and, where all four chains have `least_prior` of them (else null), shares of
    entry lanes of both sides by three models, use and worth of the opponent's two levers, the one it uses most (left if alike), and the lane
    in which this opponent gives us most more than usual."""
    by = list(asof.by)
    chains, league = asof.packed()
    chains = chains.join(asof.prior, [*by, "match_date", "side", "team_id"], "right")
    f = games
    for who, key in (("us", "team_id"), ("them", "opp_id")):
        for side in ("attack", "conceded"):
            c = chains.where(F.col("side") == side).select(*by, "match_date", F.col("team_id").alias(key), F.col("n_prior").alias(f"n_{who}_{side}"), F.struct("cells", "zones").alias(f"{who}_{side}"))
            f = f.join(c, [*by, "match_date", key], "left")
    f = f.join(league.select(*by, "match_date", F.struct("cells", "zones").alias("league")), [*by, "match_date"], "left")
    ready = " and ".join(f"coalesce(n_{s}, 0) >= {least_prior}" for s in SIDES)
    carried = games.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for r in g.to_dict("records"):
                if r["ready"]:
                    p = plan_of({s: sums(r[s]["cells"], r[s]["zones"]) for s in SIDES}, sums(r["league"]["cells"], r["league"]["zones"]), kappa)
                    rows.append([p[c] for c in _fields])
                else:
                    rows.append([None] * len(_fields))
            out = pd.DataFrame(rows, columns=_fields, dtype=object)
            yield pd.concat([g[[*carried, "us_prior", "them_prior"]].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"`{c}` {t}" for c, t in games.dtypes)
    f = f.select(*carried, F.coalesce("n_us_attack", F.lit(0)).cast("long").alias("us_prior"), F.coalesce("n_them_attack", F.lit(0)).cast("long").alias("them_prior"), F.expr(ready).alias("ready"), *SIDES, "league")
    return f.mapInPandas(run, f"{kinds}, us_prior long, them_prior long, {PLAN}")


def _total_variation(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def _floor(n: str, shares: str) -> Column:
    """Total variation that the right shares still show, on average, after n draws."""
    each = F.transform(shares, lambda s: expected_deviation(F.col(n), s))
    return F.when(F.col(n) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2)


def _top(a: str) -> Column:
    """Place of the largest share, the first where they tie."""
    return F.array_position(F.transform(a, lambda x: F.round(x, 12)), F.array_max(F.transform(a, lambda x: F.round(x, 12))))


def lane_counts(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, match_id, team_id, entries, actual: entries of each team-match and their shares by lane (0 without entries)."""
    pairs = pd.DataFrame([(int(i), int(j), int(_LANE[i, j])) for i, j in zip(*np.nonzero(_ENTERS), strict=True)], columns=["z0", "out", "lane"])  # 200 rows
    pairs = counts.sparkSession.createDataFrame(pairs, "z0 int, out int, lane int")
    key = [*by, "match_id", "team_id"]
    n = counts.where(F.col("out") < N).join(F.broadcast(pairs), ["z0", "out"]).groupBy(*key).agg(*(F.sum(F.when(F.col("lane") == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in range(5)))
    n = counts.select(*key).distinct().join(n, key, "left").fillna(0)
    every = F.expr(" + ".join(f"l{k}" for k in range(5)))
    return n.select(*key, every.alias("entries"), F.array(*(F.coalesce(F.try_divide(F.col(f"l{k}").cast("double"), every.cast("double")), F.lit(0.0)) for k in range(5))).alias("actual"))


def plan_outcomes(asof: AsOf, plans: DataFrame) -> DataFrame:
    """What happened where there was a plan: entries by lane, distance of each model's shares, the distance that a right call
    would show as well, whether its busiest lane was right, how much of the lever the opponent got, and its threat against what
    both sides' earlier rates let expect."""
    by = asof.by
    day, key = [*by, "match_date"], [*by, "match_id"]
    p = plans.where("lever_side is not null")
    seen = lane_counts(asof.counts, by)
    for who, team in (("they", "opp_id"), ("we", "team_id")):
        p = p.join(seen.select(*key, F.col("team_id").alias(team), F.col("entries").alias(f"{who}_entries"), F.col("actual").alias(f"{who}_actual")), [*key, team])
        p = p.withColumns({f"{who}_tv_{m}": _total_variation(f"{who}_{m}", f"{who}_actual") for m in MODELS} | {f"{who}_hit_{m}": _top(f"{who}_{m}") == _top(f"{who}_actual") for m in MODELS})
        p = p.withColumn(f"{who}_floor", _floor(f"{who}_entries", f"{who}_matchup"))
    link = lambda side: F.sum(F.when(F.expr(f"{REGION.format(z='z0')} = {LEVERS[side][0]} and {REGION.format(z='out')} = {LEVERS[side][1]}"), F.col("n")).otherwise(0))
    used = asof.counts.where(F.col("out") < N).groupBy(*key, F.col("team_id").alias("opp_id")).agg(F.sum("n").alias("moves"), *(link(s).alias(f"{s}_now") for s in LEVERS))
    made = asof.counts.groupBy(*key, F.col("team_id").alias("opp_id")).agg(F.sum("xg").alias("xg"))
    began = asof.starts.groupBy(*key, F.col("team_id").alias("opp_id")).agg(F.sum("n").alias("possessions"))
    p = p.join(used, [*key, "opp_id"], "left").join(made, [*key, "opp_id"], "left").join(began, [*key, "opp_id"], "left").fillna(0, ["moves", "left_now", "right_now", "possessions"]).fillna(0.0, ["xg"])
    rate = F.sum("xg") / F.greatest(F.sum("starts"), F.lit(1))
    rates = asof.zones.groupBy(*day, "side", "team_id").agg(rate.alias("rate"))
    for side, team in (("attack", "opp_id"), ("conceded", "team_id")):
        p = p.join(rates.where(F.col("side") == side).select(*day, F.col("team_id").alias(team), F.col("rate").alias(f"rate_{side}")), [*day, team], "left")
    p = p.join(asof.league_zones.groupBy(*day).agg(rate.alias("rate_league")), day, "left")
    pick = lambda c: F.when(F.col("lever_side") == "left", F.col(f"left_{c}")).otherwise(F.col(f"right_{c}"))
    now, each = F.coalesce(F.try_divide(pick("now").cast("double"), F.col("moves").cast("double")), F.lit(0.0)), F.col("xg") / F.greatest("possessions", F.lit(1))
    expected = F.coalesce(F.when(F.col("rate_league") > 0, F.col("rate_attack") * F.col("rate_conceded") / F.col("rate_league")), F.lit(0.0))
    p = p.withColumns({"lever_share": now, "lever_usual": pick("share"), "their_rate": each, "their_expected": expected})
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) - 1)
    p = p.withColumns({"lever_vs_usual": over("lever_share", "lever_usual"), "threat_vs_expected": over("their_rate", "their_expected")})
    scores = [f"{who}_{c}" for who in ("they", "we") for c in ("entries", "actual", *(f"{k}_{m}" for k in ("tv", "hit") for m in MODELS), "floor")]
    return p.select(*key, "match_date", "team_id", "opp_id", "home", "later", "lever_side", *scores, "lever_share", "lever_usual", "lever_vs_usual", "their_rate", "their_expected", "threat_vs_expected", F.col("xg").alias("their_xg"))


def plan_summary(outcomes: DataFrame, by: tuple[str, ...] = (), least_pairs: int = 4) -> DataFrame:
    """By team, over the later part of its matches: games, hits and mean distance of each model, how often the match-up was nearer than the
    team's own habits, the mean floor; whether less of the lever went with less threat (from `least_pairs` games, where both vary)."""
    key = [*by, "team_id"]
    o = outcomes.where("later")
    pair = F.col("lever_vs_usual").isNotNull() & F.col("threat_vs_expected").isNotNull()
    o = o.withColumn("middle", F.percentile(F.when(pair, F.col("lever_vs_usual")), F.lit(0.5)).over(Window.partitionBy(*key)))
    aggs = [F.count("*").alias("games")]
    for who in ("they", "we"):
        aggs += [F.sum(F.col(f"{who}_hit_{m}").cast("int")).alias(f"{who}_hits_{m}") for m in MODELS] + [F.avg(f"{who}_tv_{m}").alias(f"{who}_tv_{m}") for m in MODELS]
        aggs += [F.sum((F.col(f"{who}_tv_matchup") < F.col(f"{who}_tv_own")).cast("int")).alias(f"{who}_nearer_than_own"), F.avg(f"{who}_floor").alias(f"{who}_floor")]
    u, y = (F.when(pair, F.col(c)) for c in ("lever_vs_usual", "threat_vs_expected"))
    low = F.col("lever_vs_usual") < F.col("middle")
    aggs += [F.count(u).alias("pairs"), F.try_divide(F.covar_pop(u, y), F.stddev_pop(u) * F.stddev_pop(y)).alias("r"), F.avg(F.when(low, y)).alias("lo"), F.avg(F.when(~low, y)).alias("hi")]
    g = o.groupBy(*key).agg(*aggs)
    told = (F.col("pairs") >= least_pairs) & F.col("r").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    return g.select(*[c for c in g.columns if c not in ("pairs", "r", "lo", "hi")], *(F.when(told, F.col(a)).alias(b) for a, b in (("r", "lever_vs_threat"), ("lo", "threat_when_lever_low"), ("hi", "threat_when_lever_high"))))


_done = "type = 'Pass' and outcome is null and end_x is not null"
_defends = "type in ('Pressure', 'Duel', 'Interception', 'Block', 'Ball Recovery', 'Clearance', 'Foul Committed') and x is not null"
_mirror = lambda r: (2 - r // 5) * 5 + 4 - r % 5
#: Who did what: (role, condition, column of the player, how many are named). Those of a lever end with its side: its passes, their
#: receivers, and the defensive actions where it runs, seen from the other side. Texts run on Spark and DuckDB alike.
ROLES = (
    ("giveaways", "(type = 'Pass' and outcome is not null or type in ('Dispossessed', 'Miscontrol')) and x < 40", "player_id", 3), ("pressers", "type = 'Pressure' and x >= 80", "player_id", 3),
    ("carriers", f"({_done} or type = 'Carry') and end_x is not null and x < 80 and end_x >= 80", "player_id", 3), ("takers", "type = 'Pass' and coalesce(sub_type, '') = 'Corner'", "player_id", 2),
    ("shooters", "type = 'Shot' and play_pattern in ('From Corner', 'From Free Kick') and coalesce(sub_type, '') <> 'Penalty'", "player_id", 3),
    *((f"{name}_{side}", f"{_done} and {pitch.region('x', 'y')} = {a} and {pitch.region('end_x', 'end_y')} = {b}", column, 2) for side, (a, b) in LEVERS.items() for name, column in (("passers", "player_id"), ("receivers", "recipient_id"))),
    *((f"defenders_{side}", f"{_defends} and {pitch.region('x', 'y')} in ({_mirror(a)}, {_mirror(b)})", "player_id", 3) for side, (a, b) in LEVERS.items()),
)
OURS, THEIRS = ("pressers", "carriers", "takers", "shooters", "defenders"), ("giveaways", "takers", "shooters", "passers", "receivers")


def lever_sides(asof: AsOf) -> DataFrame:
    """by, match_date, team_id, lever_side: the lever that a team had used most before each of its dates, left if alike."""
    link = lambda side: F.sum(F.when(F.expr(f"out < {N} and {REGION.format(z='z0')} = {LEVERS[side][0]} and {REGION.format(z='out')} = {LEVERS[side][1]}"), F.col("n")).otherwise(0))
    g = asof.cells.where("side = 'attack'").groupBy(*asof.by, "match_date", "team_id").agg(*(link(s).alias(s) for s in LEVERS))
    return g.select(*asof.by, "match_date", "team_id", F.when(F.col("right") > F.col("left"), "right").otherwise("left").alias("lever_side"))


def plan_players(asof: AsOf, ev: DataFrame, games: DataFrame, eleven: DataFrame | None = None, least_prior: int = LEAST_PRIOR) -> DataFrame:
    """match_id, team_id, opp_id, who (our, their), role, place, player_id, n, share: who did most of what a plan is about, in earlier
    matches, for matches in which there is a plan. With `eleven` (match_id, team_id, eleven) only starters are named where they are
    known; shares are of all who did it."""
    by = list(asof.by)
    acts = ", ".join(f"named_struct('role', '{r}', 'player_id', case when {c} then cast({p} as bigint) end)" for r, c, p, _ in ROLES)
    rows = ev.select(*by, "match_date", F.col("team_id").cast("long").alias("team_id"), F.explode(F.expr(f"filter(array({acts}), r -> r.player_id is not null)")).alias("r")).select(*by, "match_date", "team_id", "r.*", F.lit(1).cast("long").alias("n"))
    day = [*by, "match_date"]
    seen = earlier(rows, games.select(*day, "team_id").distinct(), [*by, "team_id"], ["role", "player_id"], ["n"]).where("n > 0")
    seen = seen.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*day, "team_id", "role")))
    ready = games.select(*by, "match_id", "match_date", "team_id", "opp_id")
    for key in ("team_id", "opp_id"):
        enough = asof.prior.where(F.col("n_prior") >= least_prior).groupBy(*day, F.col("team_id").alias(key)).agg(F.count("*").alias("sides")).where("sides = 2").drop("sides")
        ready = ready.join(enough, [*day, key], "left_semi")
    ready = ready.join(lever_sides(asof).withColumnRenamed("team_id", "opp_id"), [*day, "opp_id"])
    limit = F.create_map(*(F.lit(x) for pair in {r.split("_")[0]: k for r, _, _, k in ROLES}.items() for x in pair))
    out = None
    for who, key, roles in (("our", "team_id", OURS), ("their", "opp_id", THEIRS)):
        j = ready.join(seen.withColumnRenamed("team_id", key), [*day, key])
        kind = F.split("role", "_")
        j = j.where((F.size(kind) == 1) | (F.get(kind, F.lit(1)) == F.col("lever_side"))).withColumn("role", F.get(kind, F.lit(0))).where(F.col("role").isin(*roles))
        if eleven is not None:
            j = j.join(eleven.select("match_id", F.col("team_id").cast("long").alias(key), "eleven"), ["match_id", key], "left").where(F.col("eleven").isNull() | F.array_contains("eleven", F.col("player_id")))
        place = F.row_number().over(Window.partitionBy(*by, "match_id", "team_id", "role").orderBy(F.desc("n"), "player_id"))
        j = j.withColumn("place", place).where(F.col("place") <= limit[F.col("role")]).select(*by, "match_id", "team_id", "opp_id", F.lit(who).alias("who"), "role", "place", "player_id", "n", "share")
        out = j if out is None else out.union(j)
    return out
