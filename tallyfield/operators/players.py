"""Players: chains with players as nodes and what a removal costs, missed matches, line-ups, passing and pressing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..functions import pitch
from .scoring import replicate_weight
from .stats import ratio

OTHERS, SHOT, LOSS = -1, -2, -3
KAPPA_ROW, KAPPA_XG = 20.0, 5.0  # fixed values: pseudo actions of a player's row, pseudo shots of his shot quality
ELEVEN, POWER = 11.0, 4
PARTS = 8  # fixed value: groups that a team's players are dealt to
REGULAR_SHARE, REGULAR_LEAST = 0.6, 5  # fixed values: a regular started this share of at least so many earlier matches
NEAR_SECONDS = 1.5  # fixed value: farthest in time that a player under pressure is taken for the one pressed


def player_actions(ev: DataFrame) -> DataFrame:
    """Open-play passes, shots and losses of known players; carries are left out."""
    return ev.where("kind is not null and player_id is not null and not (kind = 'move' and type = 'Carry')").select("match_id", "possession", "idx", "team_id", "opp_id", "player_id", "recipient_id", "kind", F.coalesce("xg", F.lit(0.0)).alias("xg"))


def player_cells(actions: DataFrame) -> DataFrame:
    """match_id, team_id, src, dst (a player, SHOT or LOSS), n, xg, and dst null for the first actions of possessions."""
    dst = F.when(F.col("kind") == "shot", SHOT).when(F.col("kind") == "turnover", LOSS).otherwise(F.col("recipient_id"))
    a = actions.select("match_id", "team_id", F.col("player_id").alias("src"), dst.alias("dst"), F.when(F.col("kind") == "shot", F.col("xg")).otherwise(0.0).alias("xg"), F.lit(False).alias("first"))
    begun = actions.groupBy("match_id", "team_id", "possession").agg(F.min_by("player_id", "idx").alias("src"))
    a = a.unionByName(begun.select("match_id", "team_id", "src", F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("xg"), F.lit(True).alias("first")))
    return a.groupBy("match_id", "team_id", "src", "dst", "first").agg(F.count("*").alias("n"), F.round(F.sum("xg"), 6).alias("xg"))


class PlayerChain:
    """Nodes are players with enough actions, in order of these, then all others. cells: src, dst, first, n, xg."""

    def __init__(self, cells: pd.DataFrame, least: int):
        acts = cells[~cells["first"]]
        count = acts.groupby("src")["n"].sum()
        count = count[count >= least]
        self.players = sorted(count.index, key=lambda p: (-count[p], p))
        k = self.k = len(self.players) + 1
        node = {p: i for i, p in enumerate(self.players)}
        src = acts["src"].map(node).fillna(k - 1).to_numpy(int)
        dst, n, xg = acts["dst"].to_numpy(float), acts["n"].to_numpy(float), acts["xg"].to_numpy(float)
        to = np.where(dst == SHOT, k, np.where(dst == LOSS, k + 1, pd.Series(dst).map(node).fillna(k - 1))).astype(int)
        c = np.zeros((k, k + 2))
        known = ~np.isnan(dst)
        np.add.at(c, (src[known], to[known]), n[known])
        made = np.zeros(k)
        np.add.at(made, src, xg)
        row = c.sum(0) / max(c.sum(), 1.0)
        self.p = (c + KAPPA_ROW * row) / (c.sum(1, keepdims=True) + KAPPA_ROW)
        shots = c[:, k]
        self.g = (made + KAPPA_XG * made.sum() / max(shots.sum(), 1.0)) / (shots + KAPPA_XG)
        begun = cells[cells["first"]]
        start = np.zeros(k)
        np.add.at(start, begun["src"].map(node).fillna(k - 1).to_numpy(int), begun["n"].to_numpy(float))
        self.start = start / max(start.sum(), 1.0)

    def threat(self, p: np.ndarray | None = None, start: np.ndarray | None = None) -> float:
        p, start = self.p if p is None else p, self.start if start is None else start
        return float(start @ np.linalg.solve(np.eye(self.k) - p[:, : self.k], p[:, self.k] * self.g))

    def without(self, player: int, adapt: bool) -> float:
        """Threat without a player: passes to him go to his team's other targets, or are lost; his starts go to the rest."""
        i, k = self.players.index(player), self.k
        p, start = self.p.copy(), self.start.copy()
        lost = p[:, i].copy()
        p[:, i] = 0
        left = p[:, :k].sum(1)
        kept = (left > 0) & adapt
        p[:, :k] *= np.where(kept, 1 + lost / np.maximum(left, 1e-300), 1.0)[:, None]
        p[:, k + 1] += np.where(kept, 0.0, lost)
        start[i] = 0
        if start.sum() <= 0:
            start[:] = 1
            start[i] = 0
        return self.threat(p, start / start.sum())


class TeamCells:
    """Counts of a team's players as a table: a row for each source, a column for each player that actions go to, others, shots,
    losses, unknown receivers, starts and xg in millionths. Whole numbers, so that matches are taken out of the sums exactly.
    Nobody else has passes, so the equations of a chain are solved over the columns alone; all other players follow from these."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, first: np.ndarray, n: np.ndarray, xg: np.ndarray, match: np.ndarray, least: int):
        self.least = least
        self.ids, row = np.unique(src, return_inverse=True)
        acts = np.bincount(row, np.where(first, 0, n), len(self.ids))
        self.reached = np.intersect1d(dst[~np.isnan(dst)], self.ids[acts >= least]).astype(self.ids.dtype)
        self.at, a = np.searchsorted(self.ids, self.reached), len(self.reached)
        place = np.minimum(np.searchsorted(self.reached, dst), max(a - 1, 0))
        known = (self.reached[place] == dst) if a else np.zeros(len(dst), bool)
        col = np.where(first, a + 4, np.where(np.isnan(dst), a + 3, np.where(dst == SHOT, a + 1, np.where(dst == LOSS, a + 2, np.where(known, place, a)))))
        self.width, shot = a + 6, xg != 0
        flat = np.concatenate([row * self.width + col, row[shot] * self.width + a + 5])
        value, match = np.concatenate([n, np.rint(xg[shot] * 1e6)]).astype(float), np.concatenate([match, match[shot]])
        self.total = self._table(flat, value)
        order = np.argsort(match, kind="stable")
        names, begin = np.unique(match[order], return_index=True)
        self.matches = {m: (flat[o], value[o]) for m, o in zip(names.tolist(), np.split(order, begin[1:]), strict=True)}

    def _table(self, flat: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.bincount(flat, value, len(self.ids) * self.width).reshape(len(self.ids), self.width)

    def chain(self, matches: set | None = None) -> ReachedChain:
        """The chain of some matches, or of all: sums of these, or all less the others, whichever are fewer."""
        t = self.total
        if matches is not None:
            some = [m for m in self.matches if m in matches]
            rest = [m for m in self.matches if m not in matches]
            few = [self.matches[m] for m in (some if len(some) < len(rest) else rest)]
            part = self._table(*(np.concatenate(v) for v in zip(*few, strict=True))) if few else np.zeros_like(t)
            t = part if len(some) < len(rest) else t - part
        a = len(self.reached)
        in_ = t[:, : a + 4].sum(1) >= self.least
        rows = np.vstack([t[in_], t[~in_].sum(0)])
        here = in_[self.at]
        rows[:, a] += rows[:, :a][:, ~here].sum(1)
        node = np.cumsum(in_) - 1
        return ReachedChain(self.ids[in_], np.append(node[self.at[here]], len(rows) - 1), rows[:, np.append(np.flatnonzero(here), [a, a + 1, a + 2])], rows[:, a + 5] / 1e6, rows[:, a + 4])


class ReachedChain:
    """`PlayerChain` over the nodes that can be reached: c has a row for each player and for all others (last), a column for
    each node of `at` (rows; others last), shots and losses."""

    def __init__(self, players: np.ndarray, at: np.ndarray, c: np.ndarray, made: np.ndarray, start: np.ndarray):
        self.players, self.at, self.a = players, at, len(at)
        self.p = (c + KAPPA_ROW * (c.sum(0) / max(c.sum(), 1.0))) / (c.sum(1, keepdims=True) + KAPPA_ROW)
        shots = c[:, self.a]
        self.g = (made + KAPPA_XG * made.sum() / max(shots.sum(), 1.0)) / (shots + KAPPA_XG)
        self.start = start / max(start.sum(), 1.0)
        self.value = self._values(self.p[:, : self.a])
        self.base, self.starters = float(self.start @ self.value), int((self.start > 0).sum())

    def _values(self, move: np.ndarray) -> np.ndarray:
        """Chance of a goal from each node."""
        gain = self.p[:, self.a] * self.g
        return gain + move @ np.linalg.solve(np.eye(self.a) - move[self.at], gain[self.at])

    def without(self, i: int, adapt: bool) -> float:
        """Threat without the player of row i, as `PlayerChain.without`."""
        value, k = self.value, len(self.start)
        j = np.flatnonzero(self.at == i)
        if len(j):
            move = self.p[:, : self.a].copy()
            lost = move[:, j[0]].copy()
            move[:, j[0]] = 0
            left = move.sum(1)
            if adapt:
                move *= np.where(left > 0, 1 + lost / np.maximum(left, 1e-300), 1.0)[:, None]
            value = self._values(move)
        if self.starters > (self.start[i] > 0):
            return float((self.start @ value - self.start[i] * value[i]) / (self.start.sum() - self.start[i]))
        return float((value.sum() - value[i]) / (k - 1))

    def drops(self, i: int) -> list[float]:
        """Drop of threat without the player of row i if the team adapts, and if not."""
        kept = 1 - self.without(i, True) / self.base
        return [kept, 1 - self.without(i, False) / self.base if (self.at == i).any() else kept]


def _team_cells(g: pd.DataFrame, least: int, match: np.ndarray | None = None) -> TeamCells:
    get = lambda c, kind: g[c].to_numpy(kind)
    return TeamCells(get("src", np.int64), get("dst", float), get("first", bool), get("n", float), get("xg", float), np.zeros(len(g), int) if match is None else match, least)


def removal_effects(cells: DataFrame, least: int = 150) -> DataFrame:
    """team_id, player_id, threat, drops of it without the player if the team adapts and if not, and the place among them."""
    total = cells.groupBy("team_id", "src", "dst", "first").agg(F.sum("n").alias("n"), F.sum("xg").alias("xg"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = _team_cells(g, least).chain()
        rows = [(g["team_id"].iloc[0], p, c.base, *c.drops(i)) for i, p in enumerate(c.players)] if c.base > 0 else []
        return pd.DataFrame(rows, columns=["team_id", "player_id", "threat", "drop_adapting", "drop_losing"])

    e = total.groupBy("team_id").applyInPandas(run, "team_id long, player_id long, threat double, drop_adapting double, drop_losing double")
    e = e.select("team_id", "player_id", *(F.round(c, 6).alias(c) for c in ("threat", "drop_adapting", "drop_losing")))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("drop_adapting"), F.desc("drop_losing"), "player_id")))


def opponent_adjusted_rates(actions: DataFrame) -> DataFrame:
    """xg for each possession over what the opponent concedes in its other matches; no row where it has none."""
    m = actions.groupBy("match_id", "team_id", "opp_id").agg((F.sum("xg") / F.countDistinct("possession")).alias("rate"))
    both = m.select("match_id", F.col("team_id").alias("opp_id"), F.lit(1).alias("met"))
    w = Window.partitionBy("opp_id")
    m = m.join(both, ["match_id", "opp_id"]).withColumn("usual", F.try_divide(F.sum("rate").over(w) - F.col("rate"), (F.count("*").over(w) - 1).cast("double")))
    return m.select("match_id", "team_id", "opp_id", "rate", F.try_divide("rate", "usual").alias("adjusted")).where("adjusted is not null")


def played(lineups: DataFrame) -> DataFrame:
    return lineups.where("positions <> '[]'").select("match_id", "team_id", "player_id").distinct()


def missed_matches(cells: DataFrame, rates: DataFrame, lineups: DataFrame, least: int = 150, least_missed: int = 3) -> DataFrame:
    """For each regular who played and missed enough matches: the drop of his team's adjusted rate without him, and the drops
    that the chain of the matches he played predicts."""
    total = cells.where("not first").groupBy("team_id", "src").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("team_id", F.col("src").alias("player_id"))
    matches = cells.select("team_id", "match_id").distinct()
    there = total.join(matches, "team_id").join(played(lineups).withColumn("there", F.lit(True)), ["match_id", "team_id", "player_id"], "left").fillna(False, ["there"])
    there = there.join(rates.select("match_id", "team_id", "adjusted"), ["match_id", "team_id"], "left")
    mean = lambda c: F.avg(F.when(c, F.col("adjusted")))
    seen = there.groupBy("team_id", "player_id").agg(F.sum((~F.col("there")).cast("int")).alias("missed"), F.sum(F.col("there").cast("int")).alias("played"), mean(~F.col("there")).alias("without"), mean(F.col("there")).alias("with"))
    seen = seen.where((F.col("missed") >= least_missed) & (F.col("played") >= least_missed))
    # A player's matches go to one of a few groups of their team's players; each group has the team's cells once.
    part = F.pmod(F.hash("player_id"), F.lit(PARTS)).alias("part")
    mine = there.where("there").join(seen.select("team_id", "player_id"), ["team_id", "player_id"], "left_semi").groupBy("team_id", part, "player_id").agg(F.collect_list("match_id").alias("matches"))
    parts = seen.select("team_id", part).distinct()

    def run(g: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        t, rows = _team_cells(g, least, g["match_id"].to_numpy()) if len(g) else None, []
        for r in of.itertuples() if t else ():
            c = t.chain(set(r.matches.tolist()))
            i = int(np.searchsorted(c.players, r.player_id))
            if i < len(c.players) and c.players[i] == r.player_id and c.base > 0:
                rows.append((r.team_id, r.player_id, *c.drops(i)))
        return pd.DataFrame(rows, columns=["team_id", "player_id", "drop_adapting", "drop_losing"])

    theirs = cells.join(F.broadcast(parts), "team_id").select(F.col("team_id").alias("team"), F.col("part").alias("group"), "match_id", "src", "dst", "first", "n", "xg")
    e = theirs.groupBy("team", "group").cogroup(mine.groupBy("team_id", "part")).applyInPandas(run, "team_id long, player_id long, drop_adapting double, drop_losing double")
    drop = 1 - F.try_divide("without", F.greatest("with", F.lit(1e-9)))
    return e.join(seen, ["team_id", "player_id"]).select("team_id", "player_id", "missed", "played", F.round(drop, 6).alias("observed"), *(F.round(c, 6).alias(c) for c in ("drop_adapting", "drop_losing")))


def absence_summary(missed: DataFrame, reps: int = 200) -> DataFrame:
    """Correlation of observed with predicted drops, and the share of shuffled pairings that reach it. A shuffle deals the
    observed drops out in the order of a hash of player and replicate."""
    m = missed.where("observed is not null").select(F.concat_ws("-", "team_id", "player_id").alias("key"), "observed", ((F.col("drop_adapting") + F.col("drop_losing")) / 2).alias("mid"))
    # The order of keys is that of every replicate: taken once, over ranges of keys. A replicate's rows hold numbers and a short hash.
    parts = m.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    parts = parts.checkpoint() if m.sparkSession.sparkContext.getCheckpointDir() else parts.persist(StorageLevel.DISK_ONLY)
    ahead = parts.groupBy("part").agg(F.count("*").alias("c")).select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("ahead"))  # a row for each range
    m = parts.join(F.broadcast(ahead), "part").select("key", "observed", "mid", (F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("key"))).cast("int").alias("k"))
    hashed = F.unhex(F.md5(F.concat_ws(":", "key", "rep")))
    right = m.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select("rep", "observed", F.col("k").alias("own"), hashed.alias("hash"))
    right = right.select("rep", "observed", F.row_number().over(Window.partitionBy("rep").orderBy("hash", "own")).alias("k"))
    null = right.join(m.select("k", "mid"), "k").groupBy("rep").agg(F.try_divide(F.covar_pop("observed", "mid"), F.stddev_pop("observed") * F.stddev_pop("mid")).alias("r0"))
    real = m.agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("observed", "mid"), F.stddev_pop("observed") * F.stddev_pop("mid")).alias("r"))
    return null.crossJoin(F.broadcast(real)).groupBy("n", "r").agg(F.avg((F.col("r0") >= F.col("r")).cast("double")).alias("p")).select("n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


def starters(lineups: DataFrame) -> DataFrame:
    """match_id, team_id, eleven: players with a spell from the kick-off."""
    return lineups.where(F.col("positions").contains("Starting XI")).groupBy("match_id", "team_id").agg(F.sort_array(F.collect_set("player_id")).alias("eleven"))


def overlap_weight(a: Column, b: Column) -> Column:
    """(shared starters / 11) to the fourth; 1 where a line-up is unknown."""
    return F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(F.pow(F.size(F.array_intersect(a, b)) / F.lit(ELEVEN), F.lit(POWER)))


def missing_regulars(lineups: DataFrame, dates: DataFrame) -> DataFrame:
    """Players who started most of their team's earlier matches and do not start this one."""
    s = lineups.where(F.col("positions").contains("Starting XI")).select("match_id", "team_id", "player_id").distinct().join(dates, "match_id")
    games = s.select("match_id", "match_date", "team_id").distinct()
    past = games.withColumn("of", F.count("*").over(Window.partitionBy("team_id").orderBy(F.datediff("match_date", F.lit("2000-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)))
    past = past.where(F.col("of") >= REGULAR_LEAST)
    # Pairs of a match and an earlier one of the same team: bounded by a team's fixtures.
    e = past.alias("t").join(s.alias("s"), (F.col("t.team_id") == F.col("s.team_id")) & (F.col("s.match_date") < F.col("t.match_date")))
    e = e.groupBy("t.match_id", "t.team_id", "s.player_id", "t.of").agg(F.count("*").alias("started")).where((F.col("started") >= REGULAR_LEAST) & (F.col("started") >= REGULAR_SHARE * F.col("of")))
    return e.join(s.select("match_id", "team_id", "player_id"), ["match_id", "team_id", "player_id"], "left_anti").select("match_id", "team_id", "player_id", "started", "of")


def lineup_calls(calls: DataFrame, long: DataFrame, lineups: DataFrame, pseudo: float = 5.0) -> DataFrame:
    """As-of calls in which earlier matches count by how many of today's starters started them: plain weights (call_xi), and
    scaled to the same amount of data (call_xin)."""
    xi = starters(lineups)
    now = long.join(xi, ["match_id", "team_id"], "left").join(xi.select("match_id", F.col("team_id").alias("opp_id"), F.col("eleven").alias("theirs")), ["match_id", "opp_id"], "left")

    def side(key: str, eleven: str, name: str) -> DataFrame:
        t, p = now.alias("t"), now.alias("p")
        j = t.join(p, (F.col("t.feature") == F.col("p.feature")) & (F.col(f"t.{key}") == F.col(f"p.{key}")) & (F.col("p.match_date") < F.col("t.match_date")))
        j = j.select("t.match_id", "t.team_id", "t.feature", F.col("p.v").alias("v"), overlap_weight(F.col(f"t.{eleven}"), F.col(f"p.{eleven}")).alias("w"))
        got = F.col("v").isNotNull()
        g = j.groupBy("match_id", "team_id", "feature").agg(F.count("*").alias("n"), F.sum("w").alias("all"), F.coalesce(F.sum(F.col("w") * F.col("v")), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(got, F.col("w"))), F.lit(0.0)).alias("d"))
        scale = F.when(F.col("all") > 0, F.col("n") / F.col("all")).otherwise(1.0)
        return g.select("match_id", "team_id", "feature", *(F.col(c).alias(f"{name}_{c}") for c in ("s", "d")), scale.alias(f"{name}_k"))

    keys = ["match_id", "team_id", "feature"]
    c = calls.join(side("team_id", "eleven", "own"), keys, "left").join(side("opp_id", "theirs", "opp"), keys, "left").fillna(0.0, ["own_s", "own_d", "opp_s", "opp_d"]).fillna(1.0, ["own_k", "opp_k"])
    mean = lambda n, k: (F.col(f"{n}_s") * k + pseudo * F.col("league")) / (F.col(f"{n}_d") * k + pseudo)
    plain = mean("own", F.lit(1.0)) + mean("opp", F.lit(1.0)) - F.col("league")
    scaled = mean("own", F.col("own_k")) + mean("opp", F.col("opp_k")) - F.col("league")
    return c.select(*calls.columns, plain.alias("call_xi"), scaled.alias("call_xin"))


def skill_differences(calls: DataFrame, reps: int = 100, key: str = "call_xi") -> DataFrame:
    """By feature: skill of line-up weighted calls less that of plain ones, on the same units, with intervals."""
    u = calls.where(f"scored and actual is not null and call is not null and {key} is not null")
    sse = lambda c: F.sum(F.pow(F.col("actual") - F.col(c), 2))
    m = u.groupBy("feature", "match_id").agg(F.count("*").alias("n"), sse("league").alias("l"), sse("call").alias("c"), sse(key).alias("x"))
    d = m.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(replicate_weight("match_id", "rep")))
    s = d.groupBy("feature", "rep").agg(F.sum(F.expr("case when rep = 0 then n end")).alias("n"), F.try_divide(F.sum(F.col("w") * (F.col("c") - F.col("x"))), F.sum(F.col("w") * F.col("l"))).alias("difference"))
    g = s.groupBy("feature").agg(F.max("n").alias("n"), F.max(F.expr("case when rep = 0 then difference end")).alias("difference"), F.percentile(F.expr("case when rep > 0 then difference end"), F.lit(0.05)).alias("lo"), F.percentile(F.expr("case when rep > 0 then difference end"), F.lit(0.95)).alias("hi"))
    return g.select("feature", "n", *(F.round(c, 6).alias(c) for c in ("difference", "lo", "hi")), (F.col("lo") > 0).alias("helped"), (F.col("hi") < 0).alias("hurt"))


def involvement(ev: DataFrame) -> DataFrame:
    """Share of a team's added value that a player made or received, and made. `ev` has action values."""
    a = ev.where("action is not null").withColumn("v", F.greatest("value", F.lit(0.0)))
    t = a.groupBy("team_id").agg(F.sum("v").alias("t"))
    made = a.where("player_id is not null").select("team_id", "player_id", F.col("v").alias("made"), F.lit(0.0).alias("got"), F.lit(1).alias("acts"))
    got = a.where("recipient_id is not null").select("team_id", F.col("recipient_id").alias("player_id"), F.lit(0.0).alias("made"), F.col("v").alias("got"), F.lit(0).alias("acts"))
    g = made.union(got).groupBy("team_id", "player_id").agg(F.sum("made").alias("made"), F.sum("got").alias("got"), F.sum("acts").alias("actions")).where("actions > 0")
    whole = F.when(F.col("t") > 0, F.col("t")).otherwise(1.0)
    return g.join(F.broadcast(t), "team_id").select("team_id", "player_id", "actions", F.round((F.col("made") + F.col("got")) / whole, 6).alias("involvement"), F.round(F.col("made") / whole, 6).alias("created"))


def passing_edges(ev: DataFrame, least: int = 3) -> DataFrame:
    """Completed passes between players with at least `least` of them: number, value and added value."""
    p = ev.where("type = 'Pass' and action = 'move' and player_id is not null and recipient_id is not null").groupBy("team_id", "player_id", "recipient_id")
    return p.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"), F.round(F.sum(F.greatest("value", F.lit(0.0))), 6).alias("positive")).where(F.col("n") >= least)


def pressing_nodes(ev: DataFrame) -> DataFrame:
    """Pressures of each player and the middle of their places."""
    g = ev.where("type = 'Pressure' and player_id is not null").groupBy("team_id", "player_id")
    return g.agg(F.count("*").alias("n"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("x"), F.round(F.percentile("y", F.lit(0.5)), 6).alias("y"))


def press_starts(ev: DataFrame) -> DataFrame:
    """First pressure of each possession and the position of the opponent under pressure nearest in time, if near enough;
    ties go to the earlier event."""
    first = ev.where("type = 'Pressure'").groupBy("match_id", "possession", "team_id").agg(F.min_by(F.struct("x", "y", "player_id", "clock"), F.struct("clock", "idx")).alias("p"))
    target = ev.where("under_pressure and position is not null").select("match_id", "possession", F.col("team_id").alias("target"), F.col("clock").alias("at"), "position", "idx")
    j = first.join(target, ["match_id", "possession"], "left").withColumn("gap", F.when(F.col("target") != F.col("team_id"), F.abs(F.col("at") - F.col("p.clock"))))
    g = j.groupBy("match_id", "possession", "team_id", "p").agg(F.min_by("position", F.when(F.col("gap").isNotNull(), F.struct("gap", "idx"))).alias("pressed"), F.min("gap").alias("gap"))
    return g.select("match_id", "possession", "team_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.player_id").alias("player_id"), F.when(F.col("gap") <= NEAR_SECONDS, F.col("pressed")).alias("pressed_position"))


def pressed_shares(starts: DataFrame) -> DataFrame:
    """Shares of pressed positions by team, and over the league."""
    g = starts.where("pressed_position is not null").groupBy("team_id", "pressed_position").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pressed_position")
    g = g.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy("team_id")))).withColumn("league_n", F.sum("n").over(w))
    total = g.agg(F.sum("n").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("team_id", "pressed_position", "n", "share", ratio("league_n", "t").alias("league"))


def head_to_head(ev: DataFrame) -> DataFrame:
    """Every match of two teams: goals, own goals included, and xg of both."""
    g = ev.groupBy("match_id", "match_date", "team_id", "opp_id").agg(F.sum(F.expr(f"case when {pitch.GOAL} then 1 else 0 end")).alias("goals"), F.round(F.coalesce(F.sum(F.expr("case when type = 'Shot' then xg end")), F.lit(0.0)) + pitch.NUDGE, 2).alias("xg"))
    o = g.select("match_id", F.col("team_id").alias("opp_id"), F.col("goals").alias("opp_goals"), F.col("xg").alias("opp_xg"))
    return g.join(o, ["match_id", "opp_id"]).select("match_id", "match_date", "team_id", "opp_id", "goals", "opp_goals", "xg", "opp_xg")
