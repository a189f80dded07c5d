"""Chains, plans and outcomes as of a date against plain numpy over the matches before it, and what later matches must not change."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import pitch
from tallyfield.operators import enrich, replay, stats
from tallyfield.sources import adapters

N = 30
X, Y = np.repeat([10, 30, 50, 70, 90, 110], 5), np.tile([9, 24, 40, 56, 71], 6)
REGION = np.array([0, 0, 1, 1, 2, 2])[np.arange(N) // 5] * 5 + np.arange(N) % 5


@pytest.fixture(scope="module")
def season(spark):
    ev = enrich.with_kind(adapters.load(spark, "/root/testdata/sf0.01")).where("match_id < 700").cache()
    dates = ev.select("match_id", "match_date").distinct()
    return ev, *(f(ev).join(dates, "match_id").cache() for f in (stats.outcome_table, stats.start_table))


@pytest.fixture(scope="module")
def planned(season):
    ev, counts, starts = season
    asof = replay.AsOf(counts, starts)
    plans = replay.match_plans(asof, replay.fixtures(ev), 30.0, 3).cache()
    return asof, plans, {(r["match_id"], r["team_id"]): r for r in plans.collect()}


def loaded(season):
    _, counts, starts = season
    c, x, s, day = collections.defaultdict(lambda: np.zeros((N, N + 2))), collections.defaultdict(lambda: np.zeros(N)), collections.defaultdict(lambda: np.zeros(N)), {}
    opp = {}
    for r in counts.collect():
        k = r["match_id"], r["team_id"]
        c[k][r["z0"], r["out"]] += r["n"]
        x[k][r["z0"]] += r["xg"]
        day[r["match_id"]], opp[k] = r["match_date"], r["opp_id"]
    for r in starts.collect():
        s[r["match_id"], r["team_id"]][r["z0"]] += r["n"]
    return c, x, s, day, opp


def chain(c, x, s, league=None, kappa=30.0):
    if league is None:
        c = c.copy()
        c[:, pitch.LOSS] += 1
        shots = c[:, pitch.SHOT]
        return c / c.sum(1, keepdims=True), np.divide(x, shots, out=np.zeros(N), where=shots > 0), s / s.sum()
    w = s + kappa * league[2]
    return (c + kappa * league[0]) / (c.sum(1, keepdims=True) + kappa), (x + 10 * league[1]) / (c[:, pitch.SHOT] + 10), w / w.sum()


def threat(ch, move=None):
    move = ch[0][:, :N] if move is None else move
    return float(ch[2] @ np.linalg.inv(np.eye(N) - move) @ (ch[0][:, pitch.SHOT] * ch[1]))


def lanes(ch):
    n = np.zeros(5)
    visits = ch[2] @ np.linalg.inv(np.eye(N) - ch[0][:, :N])
    for i in range(N):
        for j in range(N):
            if X[i] < 80 <= X[j]:
                at = Y[i] + (Y[j] - Y[i]) * (80 - X[i]) / (X[j] - X[i])
                n[sum(at >= e for e in (18, 30, 50, 62))] += visits[i] * ch[0][i, j]
    return n / n.sum()


def test_plans_equal_numpy(season, planned):
    c, x, s, day, opp = loaded(season)
    _, _, got = planned
    assert len(got) > 60 and sum(r["lever_side"] is not None for r in got.values()) > 10
    seen = {k: r for k, r in got.items() if r["lever_side"] is not None}
    for (m, us), r in sorted(seen.items())[::4]:
        them = r["opp_id"]
        before = [k for k in c if day[k[0]] < r["match_date"]]
        of = lambda keys: tuple(sum((d[k] for k in keys), np.zeros(shape)) for d, shape in ((c, (N, N + 2)), (x, N), (s, N)))
        league = chain(*of(before))
        mine = {name: chain(*of([k for k in before if (k[1] if side == "attack" else opp[k]) == t]), league) for name, t, side in (("ua", us, "attack"), ("uc", us, "conceded"), ("ta", them, "attack"), ("tc", them, "conceded"))}

        def met(a, b):
            p, g, w = (v * np.clip(np.where(z > 0, q / np.where(z > 0, z, 1), 1), 0.25, 4) for v, q, z in zip(a, b, league, strict=True))
            return p / p.sum(1, keepdims=True), g, w / w.sum()

        for name, want in (("they_matchup", lanes(met(mine["ta"], mine["uc"]))), ("they_own", lanes(mine["ta"])), ("we_matchup", lanes(met(mine["ua"], mine["tc"]))), ("we_own", lanes(mine["ua"])), ("we_league", lanes(league))):
            assert r[name] == pytest.approx(want, abs=1e-9), name
        moves = of([k for k in before if k[1] == them])[0][:, :N]
        for side, (a, b) in (("left", (11, 12)), ("right", (13, 12))):
            blocked = (REGION[:, None] == a) & (REGION[None] == b)
            assert r[f"{side}_share"] == pytest.approx(moves[blocked].sum() / moves.sum())
            for key, ch in (("value", mine["ta"]), ("league", league)):
                lost = np.where(blocked, 0, ch[0][:, :N])
                again = lost * np.where(lost.sum(1) > 0, ch[0][:, :N].sum(1) / np.maximum(lost.sum(1), 1e-300), 0)[:, None]
                assert r[f"{side}_{key}"] == pytest.approx(1 - (threat(ch, lost) + threat(ch, again)) / 2 / threat(ch), abs=1e-9)
        assert r["lever_side"] == ("right" if r["right_share"] > r["left_share"] else "left")
        assert r["us_prior"] == len({k[0] for k in before if k[1] == us})


def test_chains_are_running_sums(season, planned):
    c, _, _, day, opp = loaded(season)
    asof = planned[0]
    rows = asof.chains(30.0, 3).where("match_date >= '2024-01-06'").collect()
    got = collections.defaultdict(dict)
    for r in rows:
        got[r["side"], r["team_id"], r["match_date"]][r["z0"], r["out"]] = r
    assert len(got) >= 18
    for (side, team, date), cells in list(got.items())[::3]:
        before = [k for k in c if day[k[0]] < date]
        n = sum((c[k] for k in before if (k[1] if side == "attack" else opp[k]) == team), np.zeros((N, N + 2)))
        league = sum((c[k] for k in before), np.zeros((N, N + 2)))
        league[:, pitch.LOSS] += 1
        league /= league.sum(1, keepdims=True)
        assert set(cells) == {(i, j) for i, j in zip(*np.nonzero(n), strict=True)}
        for (i, j), r in cells.items():
            assert r["n"] == n[i, j] and r["p"] == pytest.approx((n[i, j] + 30 * league[i, j]) / (n[i].sum() + 30))


def test_later_matches_change_nothing(season, planned):
    ev, counts, starts = season
    _, _, got = planned
    wild = counts.withColumn("n", F.when(F.col("match_id") >= 500, F.col("n") * 50).otherwise(F.col("n"))).withColumn("xg", F.when(F.col("match_id") >= 500, 9.0).otherwise(F.col("xg")))
    again = replay.match_plans(replay.AsOf(wild, starts), replay.fixtures(ev), 30.0, 3).where("match_id < 600").collect()
    assert len(again) > 50 and sum(r["lever_side"] is not None for r in again) > 5
    for r in again:
        assert r == got[r["match_id"], r["team_id"]]


def test_outcomes_and_summary(season, planned):
    c, x, s, day, opp = loaded(season)
    asof, plans, got = planned
    out = replay.plan_outcomes(asof, plans).cache()
    rows = {(r["match_id"], r["team_id"]): r for r in out.collect()}
    assert set(rows) == {k for k, r in got.items() if r["lever_side"] is not None and k in c and (k[0], r["opp_id"]) in c}
    rng = np.random.default_rng(0)
    for (m, us), r in sorted(rows.items())[::3]:
        p, them = got[m, us], r["opp_id"]
        for who, t in (("they", them), ("we", us)):
            n = np.zeros(5)
            for i in range(N):
                for j in range(N):
                    if X[i] < 80 <= X[j]:
                        n[sum(Y[i] + (Y[j] - Y[i]) * (80 - X[i]) / (X[j] - X[i]) >= e for e in (18, 30, 50, 62))] += c[m, t][i, j]
            share = n / max(n.sum(), 1)
            assert r[f"{who}_entries"] == n.sum() and r[f"{who}_actual"] == pytest.approx(share)
            for k in replay.MODELS:
                assert r[f"{who}_tv_{k}"] == pytest.approx(0.5 * np.abs(np.array(p[f"{who}_{k}"]) - share).sum())
                assert r[f"{who}_hit_{k}"] == (int(np.argmax(p[f"{who}_{k}"])) == int(np.argmax(share)))
            if n.sum():
                q = np.array(p[f"{who}_matchup"])
                drawn = rng.multinomial(int(n.sum()), q / q.sum(), 4000) / n.sum()
                assert r[f"{who}_floor"] == pytest.approx(0.5 * np.abs(drawn - q).sum(1).mean(), abs=0.02)
        before = [k for k in c if day[k[0]] < r["match_date"]]
        rate = lambda keys: sum(x[k].sum() for k in keys) / max(sum(s[k].sum() for k in keys), 1)
        want = rate([k for k in before if k[1] == them]) * rate([k for k in before if opp[k] == us]) / rate(before)
        assert r["their_expected"] == pytest.approx(want) and r["their_rate"] == pytest.approx(x[m, them].sum() / max(s[m, them].sum(), 1))
        link = replay.LEVERS[p["lever_side"]]
        moves = c[m, them][:, :N]
        assert r["lever_share"] == pytest.approx(moves[(REGION[:, None] == link[0]) & (REGION[None] == link[1])].sum() / max(moves.sum(), 1))
    total = replay.plan_summary(out.withColumn("later", F.lit(True))).collect()
    assert sum(r["games"] for r in total) == len(rows)
    for r in total:
        mine = [v for k, v in rows.items() if k[1] == r["team_id"]]
        assert r["we_tv_own"] == pytest.approx(np.mean([v["we_tv_own"] for v in mine])) and r["they_hits_league"] == sum(v["they_hit_league"] for v in mine)
        pairs = np.array([(v["lever_vs_usual"], v["threat_vs_expected"]) for v in mine if v["lever_vs_usual"] is not None and v["threat_vs_expected"] is not None])
        if len(pairs) >= 4 and r["lever_vs_threat"] is not None:
            low = pairs[:, 0] < np.median(pairs[:, 0])
            assert r["lever_vs_threat"] == pytest.approx(np.corrcoef(pairs.T)[0, 1]) and r["threat_when_lever_low"] == pytest.approx(pairs[low, 1].mean())


def test_two_seasons_equal_each_alone(season):
    ev, counts, starts = season
    moved = [df.withColumn("season", F.lit(2)).withColumn("match_id", F.col("match_id") + 10_000).withColumn("match_date", F.date_add("match_date", 3)) for df in season]
    both = [a.withColumn("season", F.lit(1)).unionByName(b) for a, b in zip(season, moved, strict=True)]
    def key(df):
        return {(r["match_id"], r["team_id"]): np.round([r["us_prior"], *(r["they_matchup"] or [-1]), r["left_value"] or -1], 9).tolist() for r in df.collect()}

    alone = replay.match_plans(replay.AsOf(counts, starts), replay.fixtures(ev), 30.0, 3)
    kept = replay.match_plans(replay.AsOf(both[1], both[2], ("season",)), replay.fixtures(both[0], ("season",)), 30.0, 3)
    assert key(alone) == key(kept.where("season = 1")) and kept.count() == 2 * alone.count()


def test_nothing_gives_nothing(spark, season):
    ev, counts, starts = (df.limit(0) for df in season)
    asof = replay.AsOf(counts, starts)
    plans = replay.match_plans(asof, replay.fixtures(ev))
    assert plans.count() == 0 and asof.chains().count() == 0 and replay.plan_summary(replay.plan_outcomes(asof, plans)).count() == 0
