"""Rule files that change while a job runs: a stream of changed files, and a cache of parsed ones."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from brevia.plans import rules as R

#: Name of the source for ``spark.readStream.format``.
NAME = "brevia_rule_files"


def modified(folder: str) -> dict[str, int]:
    """Times of change, in nanoseconds, of the TOML files of a folder by path."""
    return {str(p): p.stat().st_mtime_ns for p in sorted(Path(folder).glob("*.toml"))}


@dataclass
class _Changed(InputPartition):
    path: str
    time: int


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(modified(self.folder), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [_Changed(p, t) for p, t in now.items() if before.get(p) != t] + [_Changed(p, -1) for p in before if p not in now]

    def read(self, partition: _Changed) -> Iterator[tuple]:
        if partition.time < 0 or not os.path.exists(partition.path):
            yield partition.path, None, None
        else:
            yield partition.path, partition.time, Path(partition.path).read_text(encoding="utf-8", errors="replace")

    def commit(self, end: dict) -> None:
        pass


class RuleFiles(DataSource):
    """A stream of (path, modified, toml): each TOML file of the option ``path``, a folder that driver and executors share, again whenever its time of change differs.

    Offsets hold the times of all files, so a batch reads changed files only, and a restarted query none that it has seen. A file that is gone gives a row with nulls.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, modified long, toml string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - the interface's name
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RuleFiles)


class RuleCache:
    """Rules of a folder, each file parsed again only if its time of change differs from the one it was parsed at."""

    def __init__(self, folder: str, source: str = "project"):
        self.folder, self.source = folder, source
        self.parsed = 0
        self._known: dict[str, tuple[int, R.Rule | None]] = {}

    def stale(self, path: str) -> bool:
        """Whether a file isn't known as it is; a file that is gone is stale."""
        return path not in self._known or not os.path.exists(path) or os.stat(path).st_mtime_ns != self._known[path][0]

    def rules(self) -> list[R.Rule]:
        """The rules by path, those of changed files parsed anew; files that are no rules are left out."""
        now = modified(self.folder)
        for path in [p for p in self._known if p not in now]:
            del self._known[path]
        for path, time in now.items():
            if path not in self._known or self._known[path][0] != time:
                self.parsed += 1
                try:
                    rule = R.parse_rule(Path(path).read_text(encoding="utf-8"), self.source)
                except (ValueError, TypeError):
                    rule = None
                self._known[path] = time, rule
        return [self._known[p][1] for p in now if self._known[p][1] is not None]
