"""Keyed state on storage as a bucketed base with small deltas.

``root/base/v=<n>`` is the whole state as of change ``n``; ``root/delta/v=<n>``
holds the rows of change ``n`` alone. Bases are bucketed and sorted by the key,
so a lookup or a merge reads the state where it lies: its side needs no
exchange. One changed key writes one small delta.

A reader lists the folders once and takes the newest complete base and the
complete deltas after it. Compaction writes the same content as a base of the
same number beside them, so whichever the reader took, it sees one version.
Folders without their mark (a job that died) are not seen, and are replaced by
the next writer. There is one writer at a time; readers need no lock.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import RATING_STATE
from .state import _fs

KEY = "company_key"
#: Buckets of a new state. Fewer than the shuffle partitions, and Spark deals a large state out anew.
BUCKETS = 64
BASE, DELTA = "base", "delta"
_MARK = "_buckets="


def _buckets(spark: SparkSession, path: str) -> int | None:
    """Number of buckets of a complete folder; its mark is written last."""
    folder, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return next((int(n.removeprefix(_MARK)) for n in names if n.startswith(_MARK)), None)


@dataclass(frozen=True)
class Ledger:
    """The state under ``root``: rows of ``schema``, one per ``company_key``."""

    spark: SparkSession
    root: str
    schema: T.StructType = RATING_STATE
    buckets: int = BUCKETS

    @property
    def _rest(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name != KEY]

    def _path(self, kind: str, version: int) -> str:
        return f"{self.root}/{kind}/v={version}"

    def versions(self, kind: str) -> list[int]:
        """Numbers of the complete folders, ascending (names only, no data)."""
        path, fs = _fs(self.spark, f"{self.root}/{kind}")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        numbers = sorted(int(n[2:]) for n in names if n.startswith("v="))
        return [v for v in numbers if _buckets(self.spark, self._path(kind, v))]

    def newest(self) -> int:
        """Number of the last change; 0 for a new state."""
        return max([0, *self.versions(BASE), *self.versions(DELTA)])

    def _write(self, df: DataFrame, kind: str, version: int, buckets: int) -> None:
        path = self._path(kind, version)
        folder, fs = _fs(self.spark, path)
        fs.delete(folder, True)  # what a writer that died left there
        if kind == BASE:
            name = f"ledger_{uuid.uuid4().hex}"
            df.write.format("parquet").option("path", path).bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(name)
            self.spark.sql(f"DROP TABLE {name}")  # the entry in the catalog only
        else:
            df.write.parquet(path)
        fs.create(_fs(self.spark, f"{path}/{_MARK}{buckets}")[0]).close()

    def _open(self, version: int) -> DataFrame:
        """A complete base as a bucketed table."""
        path = self._path(BASE, version)
        name = "ledger_" + hashlib.md5(path.encode()).hexdigest()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
            f"INTO {_buckets(self.spark, path)} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def append(self, changes: DataFrame) -> int:
        """Write the next delta: one row per changed key, ``deleted`` for keys that go. Returns its number."""
        known = [(k, v) for k in (BASE, DELTA) for v in self.versions(k)]
        buckets = _buckets(self.spark, self._path(*known[0])) if known else self.buckets  # one number for the whole state
        number = max([0, *[v for _, v in known]]) + 1
        rows = changes.select(
            *[F.col(f.name).cast(f.dataType) for f in self.schema.fields],
            F.coalesce("deleted", F.lit(False)).alias("deleted"), F.lit(number).cast("long").alias("change"))
        self._write(rows, DELTA, number, buckets)
        return number

    def _parts(self, version: int | None) -> tuple[DataFrame | None, DataFrame | None]:
        """(base, last change of each key after it): (key, _base) and (key, _last, deleted)."""
        top = self.newest() if version is None else version
        base = max((v for v in self.versions(BASE) if v <= top), default=0)
        deltas = [v for v in self.versions(DELTA) if base < v <= top]
        row = F.struct(*self._rest)
        more = [T.StructField("deleted", T.BooleanType()), T.StructField("change", T.LongType())]
        old = self._open(base).select(KEY, row.alias("_base")) if base else None
        new = None
        if deltas:
            # Read as plain files: they are small, and a union of bucketed scans may lose its buckets after it was relied on.
            rows = self.spark.read.schema(T.StructType([*self.schema.fields, *more])).parquet(*[self._path(DELTA, v) for v in deltas])
            last = rows.groupBy(KEY).agg(F.max_by(F.struct(*self._rest, "deleted"), "change").alias("_l"))
            new = last.select(KEY, F.struct(*[F.col(f"_l.{c}") for c in self._rest]).alias("_last"), F.col("_l.deleted").alias("deleted"))
        return old, new

    def load(self, version: int | None = None) -> DataFrame:
        """The state as of the last change, or of ``version``; empty where there is none."""
        old, new = self._parts(version)
        if old is None and new is None:
            return self.spark.createDataFrame([], self.schema)
        if new is None:
            return old.select(KEY, "_base.*")
        if old is None:
            return new.filter(~F.col("deleted")).select(KEY, "_last.*")
        merged = old.join(new, KEY, "full")
        kept = merged.select(KEY, "deleted", F.when(F.col("deleted").isNull(), F.col("_base")).otherwise(F.col("_last")).alias("_row"))
        return kept.filter(~F.coalesce("deleted", F.lit(False))).select(KEY, "_row.*")

    def lookup(self, keys: DataFrame, out: str = "entry", version: int | None = None) -> DataFrame:
        """``keys`` with the state's row of each key as the struct ``out`` (null where there is none).

        The keys come to the state's buckets; the base is not moved.
        """
        old, new = self._parts(version)
        entry = F.lit(None).cast(T.StructType([f for f in self.schema.fields if f.name != KEY]))
        found, columns = keys, [F.col(c) for c in keys.columns]
        if old is not None:
            found, entry = found.join(old, KEY, "left"), F.col("_base")
        if new is not None:
            found = found.join(new, KEY, "left")
            entry = F.when(F.col("deleted").isNull(), entry).when(~F.col("deleted"), F.col("_last"))
        return found.select(*columns, entry.alias(out))

    def compact(self) -> int:
        """Write the state as of the last change as a base. Nothing is removed: readers go on."""
        top = self.newest()
        if top and top not in self.versions(BASE):
            self._write(self.load(top), BASE, top, _buckets(self.spark, self._path(DELTA, top)))
        return top

    def forget(self, keep: int = 2) -> None:
        """Delete what no reader of the last ``keep`` bases needs."""
        bases = self.versions(BASE)
        if len(bases) <= keep:
            return
        oldest = bases[-keep]
        for kind in (BASE, DELTA):
            for v in self.versions(kind):
                if v < oldest or (kind == DELTA and v == oldest):
                    path, fs = _fs(self.spark, self._path(kind, v))
                    fs.delete(path, True)
