"""Idempotent writes without a transactional table format: upserts, replacements and sticky flags."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), sticky: Sequence[str] = ()) -> DataFrame:
    """``target`` with ``updates`` applied: rows with a known key are replaced, the others added.

    ``keep`` columns keep their old value where the row existed (a creation time); ``sticky`` boolean columns stay true
    once they were. Of several updates with one key the last in full row order wins, so applying the same updates twice
    changes nothing. Columns only one side has are null on the other. Rows with a null key part are never matched.
    """
    keys = list(keys)
    order = [F.col(c).desc_nulls_last() for c in updates.columns if updates.schema[c].dataType.typeName() not in ("map", "variant")]
    new = updates.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    held = [c for c in [*keep, *sticky] if c in target.columns and c in updates.columns]
    if held:
        old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in held]).dropDuplicates(keys)
        new = new.join(old, keys, "left")
        new = new.withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep if c in held} | {c: F.coalesce(F.col(f"_old_{c}"), F.lit(False)) | F.coalesce(F.col(c), F.lit(False)) for c in sticky if c in held})
        new = new.drop(*[f"_old_{c}" for c in held])
    rest = target.join(updates.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)


def delete_stale(target: DataFrame, fresh: DataFrame, owner: str, key: str) -> DataFrame:
    """``target`` without rows of owners in ``fresh`` whose key ``fresh`` no longer has."""
    touched = fresh.select(owner).distinct().withColumn("_t", F.lit(True))
    kept = fresh.select(owner, key).distinct().withColumn("_k", F.lit(True))
    return target.join(touched, owner, "left").join(kept, [owner, key], "left").where(F.col("_t").isNull() | F.col("_k").isNotNull()).select(*target.columns)


def replace_for(target: DataFrame, fresh: DataFrame, owner: str) -> DataFrame:
    """``target`` with all rows of the owners in ``fresh`` replaced by ``fresh``."""
    return target.join(fresh.select(owner).distinct(), owner, "left_anti").unionByName(fresh)


def sticky_global(points: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` points with the global flag kept for papers that had it: a flag is never cleared."""
    had = points.groupBy("paper_id").agg(F.max(F.coalesce("in_global_corpus", F.lit(False))).alias("_had"))
    j = incoming.join(had, "paper_id", "left")
    return j.withColumn("in_global_corpus", F.coalesce("in_global_corpus", F.lit(False)) | F.coalesce("_had", F.lit(False))).select(*incoming.columns)


def feed_dedupe(feed: DataFrame) -> DataFrame:
    """One row per paper of ``feed(paper_id, day, position, ...)``: the earliest day, then the first position."""
    w = W.partitionBy("paper_id").orderBy("day", "position")
    return feed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def month_window(month, today):
    """First and last day of a month as columns, the end no later than today; a later month has a null end."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    return first.alias("first_day"), F.when(first <= today, F.least(F.last_day(first), today)).alias("last_day")


class VersionedTable:
    """A Parquet table in hash buckets of its key; a small pointer file names the folder in force of each bucket.

    An upsert reads and rewrites only the buckets its rows fall into, as new folders, and then appends one pointer line;
    a reader sees either the old or the new version, and a write that fails half way leaves the old one. Versions are
    numbered by files that only one writer can create; a writer that comes second reads again and repeats its work. Choose
    ``buckets`` by the size of the table, so that one is some hundred megabytes; it is fixed for the table. Everything goes
    through Hadoop's file system, so it works on any shared storage that creates files exclusively.
    """

    attempts = 5

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _pointers(self) -> list[str]:
        try:
            return sorted(r["value"] for r in self.spark.read.text(f"{self.path}/_versions").collect())  # one line a write
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def folders(self) -> dict[int, str]:
        """The folder in force of each bucket that has rows."""
        held: dict[int, str] = {}
        for line in self._pointers():
            _, version, *changed = line.split(" ")
            gone = {int(b[1:]) for b in changed if b.startswith("-")}
            held |= {int(b): f"{self.path}/{version}/_bucket={b}" for b in changed if not b.startswith("-")}
            held = {b: f for b, f in held.items() if b not in gone}
        return held

    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or its buckets ``only``; None if there is nothing yet."""
        paths = [f for b, f in sorted(self.folders().items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, updates: DataFrame, **how) -> None:
        """:func:`merge_upsert` of the rows; an empty update writes nothing."""
        touched = sorted(r["b"] for r in updates.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`
        if touched:
            self._commit(touched, lambda old: merge_upsert(old if old is not None else updates.limit(0), updates, self.keys, **how))

    def replace(self, rows: DataFrame, owners: DataFrame, owner: str) -> None:
        """All rows of the ``owners`` replaced by ``rows``; buckets that neither touches stay as they are."""
        owners = owners.select(owner).distinct()
        new = rows.select(self._bucket().alias("b")).distinct()
        now = self.read()
        if now is not None:
            new = new.unionByName(now.join(owners, owner, "left_semi").select(self._bucket().alias("b")).distinct()).distinct()
        touched = sorted(r["b"] for r in new.collect())  # at most `buckets`
        if touched:
            self._commit(touched, lambda old: rows if old is None else old.join(owners, owner, "left_anti").unionByName(rows, allowMissingColumns=True))

    def _commit(self, touched: Sequence[int], change: Callable[[DataFrame | None], DataFrame]) -> None:
        """Write the changed buckets and claim the next number; a writer that lost the number to another starts over."""
        for _ in range(self.attempts):
            number = len(self._pointers()) + 1
            old, version = self.read(touched), f"v-{uuid.uuid4().hex}"
            change(old).withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(f"{self.path}/{version}")
            empty = set(touched) - set(self._written(version))
            line = " ".join([f"{number:012d}", version, *map(str, touched)]) + "".join(f" -{b}" for b in sorted(empty))
            if self._claim(number, line):
                return
        raise RuntimeError(f"{self.path} is written by others all the time")

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _written(self, version: str) -> list[int]:
        fs, path = self._file(version)
        return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("_bucket=")]

    def _claim(self, number: int, line: str) -> bool:
        """Create the pointer file of a number, which only one writer can."""
        fs, path = self._file(f"_versions/{number:012d}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray((line + "\n").encode()))
        out.close()
        return True
