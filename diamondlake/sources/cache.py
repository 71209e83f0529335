"""Incremental upkeep of the pitch table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diamondlake import constants as K


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence, keep: str = "last") -> DataFrame:
    """One row per key, the first or last by `order`.

    An aggregate over a struct: duplicates collapse before the shuffle, however many share a key.
    """
    pick = F.max_by if keep == "last" else F.min_by
    rank = F.struct(*order)
    return (df.groupBy(*keys).agg(pick(F.struct(*df.columns), rank).alias("_row"))
            .select("_row.*"))


def upsert(existing: DataFrame, increment: DataFrame, existing_first: bool = True,
           keys: Sequence[str] = tuple(K.PITCH_KEY), tie_break: Sequence[str] = ()) -> DataFrame:
    """Merge by key. With `existing_first` the increment wins (top-up), else the existing rows win
    (back-fill).

    Within one side the largest `tie_break`, a load sequence, wins; without one all other columns
    in their order decide, so the winner never depends on how the rows were read.
    """
    old, new = (0, 1) if existing_first else (1, 0)
    both = (existing.withColumn("_source", F.lit(old))
            .unionByName(increment.withColumn("_source", F.lit(new)), allowMissingColumns=True))
    keys = [k for k in keys if k in both.columns]
    order = list(tie_break) or [c for c in both.columns if c not in keys and c != "_source"]
    return dedupe(both, keys, ["_source", *order], "last").drop("_source")


class Conflict(Exception):
    """Somebody else committed the version first."""


class VersionedTable:
    """A table of Parquet folders with a manifest per version under `_versions`.

    A version names the folder of each partition. Folders are written once under a name of their own and never
    changed, and a version appears whole, by one rename that fails if its number is taken. So a reader keeps what
    it opened, a failed writer leaves nothing that a reader sees, and of two writers the later one merges again.
    Manifests hold one line per partition, some hundred for months. Old folders are left for readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._root = self._fs.Path(self.path)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._root.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._fs.Path(f"{self.path}/_versions")
        if not self._system.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None) -> dict[str, str]:
        """Folder of each partition value; nothing before the first version."""
        if version is None:
            return {}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/_versions/{version:08d}.json").first()[0]
        return json.loads(text)

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame | None:
        """The table as of a version (the newest by default), or only some of its partitions."""
        have = self.versions()
        chosen = version if version is not None else (have[-1] if have else None)
        folders = [f for p, f in self.manifest(chosen).items() if parts is None or p in parts]
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def write_parts(self, df: DataFrame) -> dict[str, str]:
        """Write rows with `_part` into a fresh folder; the folder of each value."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.partitionBy("_part").parquet(f"{self.path}/{name}")
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        dirs = [f.getPath().getName() for f in self._system.listStatus(self._fs.Path(f"{self.path}/{name}")) if f.isDirectory()]
        return {unescape(d[len("_part="):]): f"{name}/{d}" for d in dirs if d.startswith("_part=")}

    def commit(self, base: int | None, changed: dict[str, str]) -> int:
        """The version after `base` with some folders changed. Raises Conflict where it exists already."""
        number = 0 if base is None else base + 1
        manifest = {**self.manifest(base), **changed}
        target = self._fs.Path(f"{self.path}/_versions/{number:08d}.json")
        draft = self._fs.Path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = self._system.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        context = self._fs.FileContext.getFileContext(self._system.getUri(), self._conf)
        try:
            context.rename(self._system.makeQualified(draft), self._system.makeQualified(target), options)
        except Py4JJavaError as failed:
            self._system.delete(draft, False)
            if "FileAlreadyExists" in failed.java_exception.getClass().getName():
                raise Conflict(f"version {number} of {self.path}") from failed
            raise
        return number


def save(spark: SparkSession, path: str, increment: DataFrame, part: Column,
         existing_first: bool = True, keys: Sequence[str] = tuple(K.PITCH_KEY),
         tie_break: Sequence[str] = (), attempts: int = 5) -> DataFrame:
    """Merge the increment into the versioned table at `path` and return the new version.

    The table is partitioned by `part`, a value that a key has once (for pitches the month of the
    game). Only partitions that the increment touches are read, merged and written, beside the old ones; then
    one rename makes them the table. A run that fails anywhere before leaves the table as it was. Where another
    writer came first, the merge is repeated on what it wrote.
    """
    table = VersionedTable(spark, path)
    fresh = increment.withColumn("_part", F.coalesce(part.cast("string"), F.lit("none")))
    touched = [r[0] for r in fresh.select("_part").distinct().collect()]   # one per month
    for attempt in range(attempts):
        base = (table.versions() or [None])[-1]
        old = table.read(base, touched) if base is not None else None
        if old is None:
            merged = dedupe(fresh, keys, list(tie_break) or [c for c in fresh.columns if c not in keys])
        else:
            merged = upsert(old.withColumn("_part", F.coalesce(part.cast("string"), F.lit("none"))), fresh,
                            existing_first, keys, tie_break)
        try:
            version = table.commit(base, table.write_parts(merged))
        except Conflict:
            if attempt + 1 == attempts:
                raise
            continue
        out = table.read(version)
        return out.select(*increment.columns) if out is not None else increment.limit(0)


def coverage_gaps(earliest: date | None, latest: date | None, start: date,
                  end: date) -> list[tuple[str, date, date]]:
    """What to fetch so that [start, end] is covered: ('head'|'tail'|'full', from, to)."""
    if earliest is None or latest is None:
        return [("full", start, end)]
    gaps = []
    if start < earliest:
        gaps.append(("head", start, earliest - timedelta(days=1)))
    if latest < end:
        gaps.append(("tail", latest + timedelta(days=1), end))
    return gaps


def missing_days(df: DataFrame, start, end, day: str = "game_date") -> DataFrame:
    """Days of [start, end] without a row, one row each."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.join(df.select(F.to_date(day).alias("day")).distinct(), "day", "left_anti")


def refresh(cached: DataFrame | None, landed: DataFrame, start: date, end: date,
            keys: Sequence[str] = tuple(K.PITCH_KEY), resume: bool = True,
            tie_break: Sequence[str] = ()) -> DataFrame:
    """The cached table extended to [start, end] from landed rows.

    Covered: returned as is. The head is filled first and never overrides cached rows; the tail
    overrides. Without a cache the landed rows are deduplicated, first one kept.
    """
    def window(lo, hi):
        return landed.where(F.col("game_date").between(F.lit(lo).cast("date"),
                                                       F.lit(hi).cast("date")))

    if cached is None or not resume:
        fresh = window(start, end)
        order = list(tie_break) or [c for c in fresh.columns if c not in keys]
        if fresh.limit(1).count() == 0:
            raise ValueError(f"no rows landed between {start} and {end}")
        return dedupe(fresh, keys, order, "first")
    lo, hi = cached.agg(F.min("game_date"), F.max("game_date")).first()
    out = cached
    for kind, a, b in coverage_gaps(lo, hi, start, end):
        out = upsert(out, window(a, b), existing_first=kind != "head", keys=keys,
                     tie_break=tie_break)
    return out
