"""A source over HTTP, from a server of this process that fails twice for each file before it answers."""

import collections
import http.server
import json
import threading

import pytest
from test_sources import source

from tallyfield.sources import ingest, lake, remote


@pytest.fixture
def site(tmp_path):
    root, tries = tmp_path / "site", collections.Counter()
    root.mkdir()

    class Flaky(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args, **kw):
            super().__init__(*args, directory=str(root), **kw)

        def do_GET(self):
            tries[self.path] += 1
            if tries[self.path] % 3:
                self.send_error(503)
            else:
                super().do_GET()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Flaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield root, f"http://127.0.0.1:{server.server_port}", tries
    server.shutdown()


def test_files_come_after_failures_and_missing_ones_are_no_rows(spark, site):
    root, url, tries = site
    source(root, (1, 2))
    got = remote.remote_files(spark, url, ["events/1.json", "events/2.json", "events/9.json"], wait=0.01, files=1).collect()
    assert {(r["name"], r["folder"]) for r in got} == {("1", "events"), ("2", "events")} and all(json.loads(r["text"]) for r in got)
    assert all(n >= 3 for n in tries.values()) and remote.remote_files(spark, url, []).count() == 0
    with pytest.raises(Exception, match="503"):
        remote.remote_files(spark, url, ["events/1.json"], attempts=2, wait=0.01).collect()
    with pytest.raises(OSError, match="refused"):
        remote.fetch("http://127.0.0.1:9/x.json", 2, 0.01)


def test_ingest_from_a_site_equals_that_from_its_folder(spark, site, tmp_path, monkeypatch):
    root, url, _ = site
    monkeypatch.setattr(ingest, "remote_files", lambda s, u, paths: remote.remote_files(s, u, paths, wait=0.01))
    folder = source(root, (1, 2))
    far, near = str(tmp_path / "far"), str(tmp_path / "near")
    a, b = ingest.ingest(spark, url, far).collect(), ingest.ingest(spark, folder, near).collect()
    assert a == b and a[0]["events"] == 6
    one, two = lake.Lake.open(spark, far), lake.Lake.open(spark, near)
    assert one.tables.keys() == two.tables.keys()
    for name in one.tables:
        assert sorted(map(str, one.scan(name).collect())) == sorted(map(str, two.scan(name).collect()))


def test_stream_brings_what_changed(spark, site, tmp_path):
    root, url, _ = site
    source(root, (1, 2), "a")
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        q = remote.changes(spark, url, [(7, 3)], wait=0.01).writeStream.format("parquet").option("checkpointLocation", marks).trigger(once=True).start(out)
        assert q.awaitTermination(120)
        return sorted(r["name"] for r in spark.read.schema(remote.SCHEMA).parquet(out).collect())

    assert run() == ["1", "2"]
    source(root, (1, 2, 3), "b")
    assert run() == ["1", "1", "2", "2", "3"]
