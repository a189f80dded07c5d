"""Files of a source over HTTP, as rows (name, folder, text) like those of a folder: read where the partitions are, with retries and
growing waits. A file that the source does not have is no row; one that cannot be had after all attempts fails its task."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "name string, folder string, text string"
ATTEMPTS, WAIT, TIMEOUT = 3, 2.0, 120  # fixed values: tries of a file, seconds of the first wait (twice, thrice that after it), of one try
FILES = 20  # of one partition


def fetch(url: str, attempts: int = ATTEMPTS, wait: float = WAIT) -> str | None:
    """The text of a file; None if the source does not have it."""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT) as r:  # noqa: S310
                return r.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if k == attempts - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k == attempts - 1:
                raise
        time.sleep(wait * (k + 1))
    return None


def _row(url: str, path: str, attempts: int, wait: float) -> tuple[str, str, str] | None:
    text = fetch(f"{url}/{path}", attempts, wait)
    parts = path.removesuffix(".json").split("/")
    return None if text is None else (parts[-1], parts[-2] if len(parts) > 1 else "", text)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.paths = options["url"].rstrip("/"), json.loads(options.get("paths", "[]"))
        self.attempts, self.wait, self.size = int(options.get("attempts", ATTEMPTS)), float(options.get("wait", WAIT)), int(options.get("files", FILES))

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.paths[k : k + self.size]) for k in range(0, len(self.paths), self.size)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            if row := _row(self.url, path, self.attempts, self.wait):
                yield row


class _Changes(SimpleDataSourceStreamReader):
    """Event files of matches by the stamp of their last change: a batch is what changed since the one before. `seasons` is a JSON list of
    [competition, season]."""

    def __init__(self, options: dict):
        self.url, self.seasons = options["url"].rstrip("/"), json.loads(options["seasons"])
        self.attempts, self.wait = int(options.get("attempts", ATTEMPTS)), float(options.get("wait", WAIT))

    def initialOffset(self) -> dict:
        return {"updated": ""}

    def _changed(self, after: str, until: str | None) -> list[tuple[str, int]]:
        out = []
        for competition, season in self.seasons:
            for m in json.loads(fetch(f"{self.url}/matches/{competition}/{season}.json", self.attempts, self.wait) or "[]"):
                stamp = m.get("match_updated") or ""
                if stamp > after and (until is None or stamp <= until):
                    out.append((stamp, m["match_id"]))
        return sorted(out)

    def _rows(self, changed: list[tuple[str, int]]) -> Iterator[tuple]:
        return iter([row for _, m in changed if (row := _row(self.url, f"events/{m}.json", self.attempts, self.wait))])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        changed = self._changed(start["updated"], None)
        return self._rows(changed), {"updated": changed[-1][0] if changed else start["updated"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(self._changed(start["updated"], end["updated"]))


class MatchFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "match_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def remote_files(spark: SparkSession, url: str, paths: list[str], **options) -> DataFrame:
    """name, folder, text of the files under `url`; those that are missing are left out."""
    spark.dataSource.register(MatchFiles)
    return spark.read.format("match_files").options(url=url, paths=json.dumps(paths), **{k: str(v) for k, v in options.items()}).load()


def changes(spark: SparkSession, url: str, seasons: list[tuple[int, int]], **options) -> DataFrame:
    """A stream of event files, each again when its match changes."""
    spark.dataSource.register(MatchFiles)
    return spark.readStream.format("match_files").options(url=url, seasons=json.dumps(seasons), **{k: str(v) for k, v in options.items()}).load()
