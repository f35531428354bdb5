"""A table of the last version of each key, kept up by batches of changes.

Keys are dealt over a fixed number of parts by their hash. A batch writes its changes, one row a key, as a new version of
the parts it touches (path/batch=n/part=p), and a manifest of the versions that each part now consists of
(path/_manifest/n). A part that has gathered too many versions is compacted in the same batch: its rows are merged into
one version. So a batch reads one manifest and the parts it compacts, however many batches there were before, and no
folder is searched for what is there.

A batch that is replayed starts from the manifest before it and writes the same versions again. Versions that neither of
the last two manifests names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tallyspark.context import BadArgument
from tallyspark.operators.sync import latest

PARTS, VERSIONS = 64, 8
_MANIFEST = StructType([StructField("part", IntegerType()), StructField("versions", ArrayType(LongType())), StructField("parts", IntegerType())])


class KeyedStore:
    """order: columns by which the last of a batch's changes of a key is chosen; a later batch always comes after an earlier one.

    parts is fixed by the first batch. versions: a part is compacted at the latest when it has so many. deal: the part of a
    row, from its keys alone (a hash of them by default). gone: a column that is true where a change takes its key away.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], parts: int = PARTS, versions: int = VERSIONS, deal: Column | None = None, gone: str | None = None):
        if versions < 1 or parts < 1:
            raise BadArgument("a store has at least one part, and a part one version")
        self.spark, self.path, self.keys, self.order, self.parts, self.versions = spark, path, keys, order, parts, versions
        self.schema = StructType([StructField(f.name, f.dataType) for f in schema])
        self.part = (deal if deal is not None else F.pmod(F.xxhash64(*keys), F.lit(parts))).cast("int")
        self.here = ~F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(True)

    def _folder(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def manifests(self) -> list[int]:
        """Batches whose manifest is complete; there are three at most."""
        fs, where = self._folder(f"{self.path}/_manifest")
        if not fs.exists(where):
            return []
        found = [x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory()]
        return sorted(int(n) for n in found if n.isdigit() and fs.exists(self._folder(f"{self.path}/_manifest/{n}/_SUCCESS")[1]))

    def versions_at(self, batch: int | None = None) -> dict[int, list[int]]:
        """Of each part the batches its rows are in, after `batch` or the newest one; as many rows as there are parts."""
        known = [n for n in self.manifests() if batch is None or n <= batch]
        if not known:
            return {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/_manifest/{known[-1]}").collect()
        if rows and rows[0].parts != self.parts:
            raise BadArgument(f"the store at {self.path} has {rows[0].parts} parts, not {self.parts}")
        return {r.part: list(r.versions) for r in rows}

    def _rows(self, parts: dict[int, list[int]]) -> DataFrame:
        """Rows of some parts' versions, with part and batch."""
        columns = StructType([*self.schema.fields, StructField("batch", LongType()), StructField("part", IntegerType())])
        paths = [f"{self.path}/batch={n}/part={p}" for p, versions in parts.items() for n in versions]
        if not paths:
            return self.spark.createDataFrame([], columns).filter(F.lit(False))  # which Catalyst knows to be empty, so joins with it go
        return self.spark.read.schema(columns).option("basePath", self.path).parquet(*paths)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.keys, ["batch", *self.order])

    def read(self, batch: int | None = None, parts: list[int] | None = None, only: Column | None = None, values: list[Column] | None = None) -> DataFrame:
        """The last version of each key, after `batch` or the newest one; of some parts, and where a condition on keys holds.

        values: what to give of a row besides its keys, instead of all columns. It is made before versions are merged, so only that is shuffled.
        """
        found = {p: v for p, v in self.versions_at(batch).items() if parts is None or p in parts}
        one, more = ({p: v for p, v in found.items() if (len(v) > 1) == many} for many in (False, True))
        only = only if only is not None else F.lit(True)
        given = self.schema.names if values is None else [*self.keys, *values]
        out = self._rows(one).filter(only & self.here).select(*given)
        if not more:
            return out
        if values is None:
            return out.unionByName(self._merged(self._rows(more).filter(only)).filter(self.here).select(*given))
        rows = self._rows(more).filter(only).select(*self.keys, F.struct("batch", *self.order).alias("__order"), self.here.alias("__here"), F.struct(*values).alias("__values"))
        return out.unionByName(latest(rows, self.keys, ["__order"]).filter("__here").select(*self.keys, "__values.*"))

    def _full(self, part: int, versions: int) -> bool:
        """Whether a part is to be compacted; parts take turns, so that not all are in one batch."""
        return versions > max(1, self.versions - part % max(1, self.versions // 2))

    def stage(self, changes: DataFrame, batch: int | None = None, once: bool = False, then: Callable[[DataFrame], DataFrame] | None = None, deal: Column | None = None) -> int:
        """Write changes as the versions of the next batch (or that of this number), which no reader sees before merge() is given the number.

        once: no key is there twice, so none has to be looked for. then: makes the store's rows of those that are dealt out to
        parts, by deal; it runs behind the shuffle, which so carries what is smaller.
        """
        known = self.manifests()
        n = batch if batch is not None else (known[-1] + 1 if known else 0)
        rows = changes if then else changes.select(*self.schema.names)
        self._write(rows if once else latest(rows, self.keys, self.order), n, then, deal)
        return n

    def staged(self, n: int) -> DataFrame:
        """The rows that stage() wrote as batch n, also those that take a key away."""
        return self._rows({p: [n] for p in self._written(n)}).select(*self.schema.names)

    def merge(self, changes: DataFrame | int, batch: int | None = None, once: bool = False) -> int:
        """Merge changes as the next batch, or as the batch of this number (again); gives the number. changes: rows, or the number that stage() gave."""
        n = changes if isinstance(changes, int) else self.stage(changes, batch, once)
        before = self.versions_at(n - 1)
        touched = self._written(n)
        after = before | {p: [*before.get(p, []), n] for p in touched}
        heavy = {p: after[p] for p in touched if self._full(p, len(after[p]))}
        if heavy:
            self._write(self._merged(self._rows(heavy)).filter(self.here), self._compacted(n))
            whole = set(self._written(self._compacted(n)))  # a part of which all is gone has no rows
            after |= {p: [self._compacted(n)] if p in whole else [] for p in heavy}
        rows = [(p, v, self.parts) for p, v in sorted(after.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/_manifest/{n}")
        for p in heavy:  # merged, so no manifest names it
            self._delete(f"batch={n}/part={p}")
        self._forget(n)
        return n

    def _write(self, rows: DataFrame, n: int, then: Callable[[DataFrame], DataFrame] | None = None, deal: Column | None = None) -> None:
        """A version of each part with rows. Sorted by keys, so that a reader of some keys skips most of a file; a large part is written by many tasks."""
        dealt = rows.withColumn("part", self.part if deal is None else deal.cast("int")).hint("rebalance", "part")
        dealt = (then(dealt) if then else dealt).select(*self.schema.names, "part")
        dealt.sortWithinPartitions("part", *self.keys).write.partitionBy("part").mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch={n}")

    @staticmethod
    def _compacted(n: int) -> int:
        """Batches count up from 0, what they compacted down from -1."""
        return -n - 1

    def _written(self, n: int) -> list[int]:
        fs, where = self._folder(f"{self.path}/batch={n}")
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(where) if x.getPath().getName().startswith("part="))

    def _forget(self, n: int) -> None:
        """Delete versions that only manifests before the last two name, and these manifests."""
        old = [m for m in self.manifests() if m < n - 1]
        kept = {(p, v) for m in (n - 1, n) for p, versions in self.versions_at(m).items() for v in versions}
        for m in old:
            for p, versions in self.versions_at(m).items():
                for v in versions:
                    if (p, v) not in kept:
                        self._delete(f"batch={v}/part={p}")
            self._delete(f"_manifest/{m}")

    def _delete(self, name: str) -> None:
        fs, where = self._folder(f"{self.path}/{name}")
        fs.delete(where, True)

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Merge a stream, a micro-batch at a time; by default what is there now."""
        return changes.writeStream.foreachBatch(lambda batch, n: self._merge_batch(batch, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _merge_batch(self, batch: DataFrame, n: int) -> None:
        self.merge(batch, n)


def raw_store(spark: SparkSession, path: str, parts: int = PARTS) -> KeyedStore:
    """The store that sync.landed() rows are merged into; the last payload of a key stays."""
    schema = StructType.fromDDL("source string, entity string, external_id string, payload string, fetched_at timestamp")
    return KeyedStore(spark, path, schema, ["source", "entity", "external_id"], ["fetched_at"], parts)
