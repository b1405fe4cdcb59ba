"""A Python data source over a folder of artifacts: lists references, then fetches bytes in parallel partitions.

Batch: filters on source_reference and observed_at, and a limit, are the lister's, so what they leave out is never opened.
Stream: each trigger admits at most `page` references that no earlier one has; an admission log in the checkpoint's shared
folder says which, so a restart goes on behind them, and one that is there already is left out before its bytes are read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

FETCH_BYTES = 25 << 20


class Chunk(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def references(path: str) -> list[str]:
    """All references of a folder, in order; hidden names are none."""
    return sorted(n for n in os.listdir(path) if not n.startswith((".", "_")))


def seen_at(path: str, name: str) -> datetime:
    return datetime.fromtimestamp(os.stat(os.path.join(path, name)).st_mtime, UTC)


def fetched(path: str, names: list[str], bodies: bool = True) -> Iterator[tuple]:
    """(reference, observed_at, bytes, problem) of each; one over FETCH_BYTES is told, not dropped, and its bytes are not handed on."""
    for name in names:
        at = os.path.join(path, name)
        body, problem = None, None
        if bodies:
            with open(at, "rb") as f:
                body = f.read(FETCH_BYTES + 1)
        if max(os.stat(at).st_size, len(body or b"")) > FETCH_BYTES:
            body, problem = None, "OVERSIZED"
        yield name, seen_at(path, name), body, problem


COMPARED = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.page = options["path"], int(options.get("page", 500))
        self.bodies = options.get("bodies", "true") == "true"
        self.limit = int(options.get("limit", 0))  # 0: all
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what the lister can test by name or time; hands the rest back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("source_reference",) and isinstance(f, (EqualTo, In, StringStartsWith, *COMPARED)) or column == ("observed_at",) and type(f) in COMPARED:
                self.wanted.append(f)
            else:
                yield f

    def listed(self, name: str) -> bool:
        for f in self.wanted:
            value = name if f.attribute == ("source_reference",) else seen_at(self.path, name)
            given = f.value
            if isinstance(given, datetime) and given.tzinfo is None:
                given = given.replace(tzinfo=UTC)
            if isinstance(f, In):
                ok = value in given
            elif isinstance(f, StringStartsWith):
                ok = value.startswith(given)
            else:
                ok = COMPARED[type(f)](value, given)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Chunk]:
        names = [n for n in references(self.path) if self.listed(n)]
        names = names[: self.limit] if self.limit else names
        return [Chunk(names[i : i + self.page]) for i in range(0, len(names), self.page)] or [Chunk([])]

    def read(self, partition: Chunk):
        return fetched(self.path, partition.names, self.bodies)


class ArtifactStream(DataSourceStreamReader):
    """Offsets count admissions. Entry n of the log, written before n is told to Spark, lists the references of admission n."""

    def __init__(self, options: dict):
        self.path, self.page, self.log = options["path"], int(options.get("page", 500)), options["log"]
        self.chunk = int(options.get("chunk", 50))
        self.known: set[str] = set()
        self.last = 0
        os.makedirs(self.log, exist_ok=True)

    def entry(self, n: int) -> list[str]:
        with open(os.path.join(self.log, f"{n:012d}.json")) as f:
            return json.load(f)

    def caught_up(self) -> None:
        while os.path.exists(os.path.join(self.log, f"{self.last + 1:012d}.json")):
            self.last += 1
            self.known.update(self.entry(self.last))

    def initialOffset(self) -> dict:
        return {"admission": 0}

    def latestOffset(self) -> dict:
        self.caught_up()
        new = [n for n in references(self.path) if n not in self.known][: self.page]
        if new:
            final = os.path.join(self.log, f"{self.last + 1:012d}.json")
            with open(f"{final}.tmp", "w") as f:
                json.dump(new, f)
            os.rename(f"{final}.tmp", final)
            self.caught_up()
        return {"admission": self.last}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        names = [name for n in range(start["admission"] + 1, end["admission"] + 1) for name in self.entry(n)]
        return [Chunk(names[i : i + self.chunk]) for i in range(0, len(names), self.chunk)] or [Chunk([])]

    def read(self, partition: Chunk):
        return fetched(self.path, partition.names)


class ArtifactSource(DataSource):
    """spark.read.format("artifacts").option("path", folder), a folder that all executors share: option bodies=false lists without
    reading, limit=n lists n at most. spark.readStream takes log, a shared folder for its admissions, and page, the most that one
    trigger admits. Filters reach the lister where spark.sql.python.filterPushdown.enabled is set."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "source_reference string, observed_at timestamp, raw_content binary, problem string"

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options)

    def streamReader(self, schema) -> ArtifactStream:
        return ArtifactStream(self.options)
