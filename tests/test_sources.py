"""Ingest of nested JSON, the manifest, and the lake's tables."""

import json

import pytest

from tallyfield.functions import pitch
from tallyfield.sources import ingest, lake


def source(root, matches=(1, 2), stamp="a", bad=()):
    for d in ("matches/7", "events", "lineups", "three-sixty"):
        (root / d).mkdir(parents=True, exist_ok=True)
    (root / "competitions.json").write_text(json.dumps([{"competition_id": 7, "season_id": 3, "competition_name": "Lïga", "season_name": "2015/2016", "competition_gender": "female"}]))
    rows = [{"match_id": m, "match_date": f"2016-01-0{m}", "kick_off": "15:00", "competition_stage": {"name": "Regular"}, "home_team": {"home_team_id": 10, "home_team_name": "Aces"}, "away_team": {"away_team_id": 20, "away_team_name": "Bees"}, "home_score": 1, "away_score": None, "match_status_360": "available" if m == 1 else "x", "match_updated": stamp} for m in matches]
    (root / "matches/7/3.json").write_text(json.dumps(rows))
    for m in matches:
        named = lambda i, n: {"id": i, "name": n}
        base = {"period": 2, "timestamp": "00:01:02.500", "minute": 46, "second": 2, "possession": 4, "possession_team": named(10, "Aces"), "play_pattern": named(1, "Regular Play"), "team": named(10, "Aces")}
        ev = [{"id": f"{m}-a", "index": 1, "type": named(30, "Pass"), "location": [60.0, 40.0], "player": named(5, "Zoë Ünal"), "position": named(1, "Back"), "pass": {"recipient": {"id": 6}, "end_location": [80.0, 30.5], "type": named(61, "Corner"), "switch": True}, "related_events": ["x"], **base},
              {"id": f"{m}-b", "index": 2, "type": named(16, "Shot"), "location": [100.0, 41.0], "under_pressure": True, "shot": {"statsbomb_xg": 0.25, "end_location": [120.0, 40.0, 1.0], "outcome": named(97, "Goal")}, **base},
              {"id": f"{m}-c", "index": 3, "type": named(34, "Half End"), **base}]
        (root / f"events/{m}.json").write_text("not json" if m in bad else json.dumps(ev, ensure_ascii=False), encoding="utf-8")
        (root / f"lineups/{m}.json").write_text(json.dumps([{"team_id": 10, "team_name": "Aces", "lineup": [{"player_id": 5, "player_name": "Zoë Ünal", "player_nickname": None, "jersey_number": 9, "country": {"name": "Perú"}, "positions": [{"start_reason": "Starting XI"}]}, {"player_id": 6, "player_name": "B", "player_nickname": "Bo", "jersey_number": 1, "positions": []}]}]))
    (root / "three-sixty/1.json").write_text(json.dumps([{"event_uuid": "1-a", "visible_area": [0, 0, 10, 0, 10, 10], "freeze_frame": [{"teammate": True, "actor": True, "keeper": False, "location": [60, 40]}, {"teammate": False, "keeper": True, "location": [118, 40]}]}]))
    return str(root)


def test_ingest_is_whole_resumable_and_survives_a_bad_match(spark, tmp_path):
    src, out = source(tmp_path / "s", (1, 2, 3), bad=(3,)), str(tmp_path / "lake")
    first = ingest.ingest(spark, src, out).collect()[0]
    assert (first["matches"], first["events"], first["failed"]) == (3, 6, [3])
    lk = lake.Lake.open(spark, out)
    e = {r["event_id"]: r for r in lk.events().collect()}
    a, b, c = e["1-a"], e["1-b"], e["1-c"]
    assert (a["period_seconds"], a["x"], a["end_x"], a["end_y"], a["sub_type"], a["outcome"], a["recipient_id"], a["player"], a["has_360"], a["competition"]) == (62.5, 60.0, 80.0, 30.5, "Corner", None, 6, "Zoë Ünal", True, "Lïga")
    assert json.loads(a["extra"])["pass"]["switch"] is True and set(json.loads(a["extra"])) == {"pass"} and json.loads(a["related"]) == ["x"]
    assert (b["xg"], b["outcome"], b["end_x"], b["under_pressure"], b["has_360"]) == (0.25, "Goal", 120.0, True, False) and c["x"] is None and c["extra"] == "{}"
    assert lk.scan("frames").count() == 2 and lk.scan("areas").first()["visible_area"].startswith("[0")
    p = {r["player_id"]: r["positions"] for r in lk.scan("lineups").where("match_id = 1").collect()}
    assert "Starting XI" in p[5] and p[6] == "[]"
    assert {r["player_id"]: r["name"] for r in lake.player_names(lk.scan("lineups")).collect()} == {5: "Zoë Ünal", 6: "Bo"}
    # Nothing changed: nothing to do. A later stamp brings the season back, with the mended match.
    matches = ingest.matches_of(ingest._files(spark, f"{src}/matches/*/*.json"), ingest._files(spark, f"{src}/competitions.json"))
    assert ingest.changed_seasons(matches, ingest.read_manifest(spark, out)).count() == 0
    source(tmp_path / "s", (1, 2, 3), "b")
    again = ingest.ingest(spark, src, out).collect()
    assert len(again) == 1 and again[0]["failed"] == [] and again[0]["events"] == 9
    lk = lake.Lake.open(spark, out)
    few = lk.first_matches(1)
    assert {r["match_id"] for r in few.events().collect()} == {1} and few.scan("lineups").count() == 2
    assert lake.team_matches(lk.matches()).count() == 2 and lake.eligible_seasons(lk.matches(), 1, 2).count() == 1 and lake.eligible_seasons(lk.matches()).count() == 0


def test_lake_in_memory_and_errors(spark, tmp_path, monkeypatch):
    ev = spark.createDataFrame([(1, "a")], "match_id long, event_id string")
    lk = lake.Lake.from_frames(events=ev)
    assert lk.has("events") and not lk.has("frames") and lk.events().count() == 1
    with pytest.raises(KeyError):
        lk.scan("frames")
    with pytest.raises(FileNotFoundError):
        lake.Lake.open(spark, str(tmp_path))
    monkeypatch.delenv(lake.ROOT_SETTING, raising=False)
    with pytest.raises(ValueError):
        lake.lake_root()
    wide = lake.together(ev, spark.createDataFrame([(2, 0.5)], "match_id long, x double"))
    assert wide.columns == ["match_id", "event_id", "x"] and wide.count() == 2
    names = spark.createDataFrame([(1, "Real A"), (2, "REAL a B"), (3, "Other")], "team_id long, team string")
    assert [r["team_id"] for r in lake.resolve(names, "real a").collect()] == [1] and lake.resolve(names, "real").count() == 2


def test_season_names(spark):
    got = [r[0] for r in spark.createDataFrame([("15/16",), ("2015-16",), ("2015/2016",), ("1999/00",), ("2015-2016",), ("2018",)], "s string").selectExpr(pitch.SEASON).collect()]
    assert got == ["2015/2016", "2015/2016", "2015/2016", "1999/2000", "2015/2016", "2018"]
