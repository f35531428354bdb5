"""A written vector index: vectors by the cell of their nearest centre, so that a search reads few cells.

Centres come from spherical k-means over at most SAMPLE vectors; every vector is then put in the cell of its nearest
centre, with its angle to it. The cells are parts of a keyed store, and a second store has each vector's digest and cell:
update() writes what changed, and takes a vector that moved out of its old cell. Of each cell the widest angle is kept.

search() reads the cells nearest to the query, and further ones (twice as many each time) while fewer than k rows pass the
filter. With exact=True it reads on until no cell left can hold a nearer vector: one whose centre is at angle a from the
query and which is r wide holds none nearer than a - r.

Vectors that are null or zero or hold null or non-finite components, and rows without an id, are left out; a vector of
another length than the centres fails the job. Of an id's repeated rows one counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.operators import retrieval
from tallyspark.session import written
from tallyspark.streaming.store import KeyedStore

CELLS, SAMPLE, ROUNDS, PROBES = 64, 20_000, 12, 8
#: Vectors of a cell that meet a question in one row.
BLOCK = 2048
#: Scores are rounded to 6 places: nearer than this, a cell may hold a tie.
CLOSE = 2e-6


def centres(vectors: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Unit centres of at most `cells` groups of unit vectors (spherical k-means)."""
    rng = np.random.default_rng(seed)
    out = vectors[rng.permutation(len(vectors))[:cells]]
    for _ in range(ROUNDS):
        near = (vectors @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1)
        out = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], out)
    return out


def _units(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, cells: int = CELLS, id_type: str = "bigint"):
        self.spark, self.path, self.cells, self.hits = spark, path, cells, f"vec_id {id_type}, score double"
        store = lambda name, columns, keys, parts, **more: KeyedStore(spark, f"{path}/{name}", StructType.fromDDL(columns), keys, [keys[0]], parts, **more)
        self.vectors = store("vectors", f"vec_id {id_type}, cell int, embedding array<float>, metadata map<string, string>, gone boolean", ["vec_id", "cell"], cells, deal=F.col("cell"), gone="gone")
        self.places = store("places", f"vec_id {id_type}, content_hash string, cell int, gone boolean", ["vec_id"], cells, gone="gone")
        self.bounds = store("bounds", "cell int, centre array<double>, radius double", ["cell"], 1)

    def _placed(self, rows: DataFrame, centre: np.ndarray) -> DataFrame:
        """rows with their cell and angle."""
        sent = self.spark.sparkContext.broadcast(centre)

        @F.arrow_udf("cell int, angle double")
        def place(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                near = _units(column) @ sent.value.T if len(column) else np.zeros((0, 1))
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(angle)], ["cell", "angle"])

        return rows.withColumn("at", place("embedding")).select("*", "at.cell", "at.angle").drop("at")

    @staticmethod
    def _prepared(rows: DataFrame, metadata: list[str], once: bool = False) -> DataFrame:
        """One row an id, of those that can be compared: vec_id, content_hash, embedding, metadata. once: no id is there twice."""
        about = F.map_filter(F.create_map(*[x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if metadata else F.create_map().cast("map<string, string>")
        rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), about.alias("metadata"))
        rows = rows.withColumn("content_hash", F.sha2(F.to_json(F.struct("embedding", "metadata")), 256))
        if once:
            return rows.select("vec_id", "content_hash", "embedding", "metadata")
        largest = F.max(F.struct("content_hash", "embedding", F.map_entries("metadata").alias("m")))
        return rows.groupBy("vec_id").agg(largest.alias("r")).select("vec_id", "r.content_hash", "r.embedding", F.map_from_entries("r.m").alias("metadata"))

    def update(self, rows: DataFrame, metadata: tuple[str, ...] | list[str] = ()) -> dict[str, int]:
        """Bring the index to these rows (vec_id, embedding, and columns kept as metadata); gives how many were new, changed, unchanged and orphans."""
        rows = self._prepared(rows, list(metadata))
        flat = lambda df: df.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "content_hash")
        diff = written(retrieval.ingest_diff(flat(self.places.read()), flat(rows)).select(F.col("doc_id").alias("vec_id"), "action"), "diff")
        counts = {r.action: r.n for r in diff.groupBy("action").agg(F.count("*").alias("n")).collect()}
        if set(counts) - {"unchanged"}:
            self._change(rows.join(diff.filter("action in ('new', 'changed')").select("vec_id"), "vec_id", "left_semi"), diff.filter("action = 'orphan'").select("vec_id"))
        return {a: counts.get(a, 0) for a in ("new", "changed", "unchanged", "orphan")}

    def change(self, rows: DataFrame, lost: DataFrame, metadata: tuple[str, ...] | list[str] = (), once: bool = False) -> None:
        """Put these rows in place of those of their ids, and take ids (vec_id) away; all others stay. once: no id of both is there twice."""
        self._change(self._prepared(rows, list(metadata), once), lost if once else lost.distinct())

    def _change(self, coming: DataFrame, lost: DataFrame) -> None:
        known = self.bounds.read().orderBy("cell").collect()  # as many as there are cells
        if known:
            centre, radius = np.array([r.centre for r in known]), {r.cell: r.radius for r in known}
        else:
            some = coming.select("embedding").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow().column(0).combine_chunks()
            if not len(some):
                return
            centre, radius = centres(_units(some), self.cells), {}
        placed = written(self._placed(retrieval.checked(coming, centre.shape[1]), centre), "placed")
        widest = {r.cell: r.angle for r in placed.groupBy("cell").agg(F.max("angle").alias("angle")).collect()}  # as many as there are cells
        wide = [(c, centre[c].tolist(), max(radius.get(c, 0.0), widest.get(c, 0.0))) for c in range(len(centre))]
        self.bounds.merge(self.spark.createDataFrame(wide, self.bounds.schema))
        changed = placed.select("vec_id", F.col("cell").alias("to")).unionByName(lost.select("vec_id", F.lit(None).cast("int").alias("to")))
        left = written(self.places.read().select("vec_id", "cell").join(changed, "vec_id").filter("to is null or to <> cell"), "left")
        none = lambda kind: F.lit(None).cast(kind)
        gone = left.select("vec_id", "cell", none("array<float>").alias("embedding"), none("map<string, string>").alias("metadata"), F.lit(True).alias("gone"))
        self.vectors.merge(placed.select("vec_id", "cell", "embedding", "metadata", F.lit(False).alias("gone")).unionByName(gone), once=True)
        orphans = left.filter("to is null").select("vec_id", F.lit("").alias("content_hash"), "cell", F.lit(True).alias("gone"))
        self.places.merge(placed.select("vec_id", "content_hash", "cell", F.lit(False).alias("gone")).unionByName(orphans), once=True)

    def candidates(self, query: list[float], cells: list[int], k: int, having: dict[str, str] | None = None, where: Column | None = None) -> DataFrame:
        """The k nearest in some cells, of rows whose metadata has all pairs of `having` and for which `where` holds."""
        rows = self.vectors.read(parts=cells)
        for name, value in (having or {}).items():
            rows = rows.filter(F.col("metadata")[name] == value)
        return retrieval.vector_search(rows, query, k, where)

    def search(self, query: list[float], k: int = retrieval.HALF, probes: int = PROBES, having: dict[str, str] | None = None, where: Column | None = None, exact: bool = False) -> DataFrame:
        """(vec_id, score) of the k nearest by cosine, ties to the smaller id."""
        bounds = self.bounds.read().collect()  # as many as there are cells
        asked = np.asarray(query, float)
        if not np.isfinite(asked).all() or not asked.any():
            return self.spark.createDataFrame([], self.hits)
        unit = asked / np.abs(asked).max()
        unit /= np.linalg.norm(unit)
        angle = {b.cell: math.acos(min(1.0, max(-1.0, float(unit @ np.array(b.centre))))) for b in bounds}
        least = {b.cell: max(0.0, angle[b.cell] - b.radius) for b in bounds}
        order = sorted(angle, key=(lambda c: (least[c], angle[c])) if exact else angle.get)
        best: list[tuple[int, float]] = []
        while order:
            cells, order = order[:probes], order[probes:]
            found = self.candidates(list(query), cells, k, having, where).collect()  # k rows
            best = sorted([*best, *((r.vec_id, r.score) for r in found)], key=lambda r: (-r[1], r[0]))[:k]
            probes *= 2
            if len(best) == k and (not exact or not order or best[-1][1] > math.cos(least[order[0]]) + CLOSE):
                break
        return self.spark.createDataFrame(best, self.hits).orderBy(F.desc("score"), "vec_id")

    def _best_of_blocks(self, asked: DataFrame, k: int) -> DataFrame:
        """(question_id, vec_id, score) of the k nearest in each block of the cells asked (question_id, asked, cell).

        Vectors of a cell are dealt into blocks of about BLOCK, and a question meets a block in one row, of which k are left: no
        task sorts all pairs, and a hot cell is many groups.
        """
        rows = self.vectors.read().select("cell", "vec_id", "embedding")
        many = {r.cell: math.ceil(r.n / BLOCK) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as many as there are cells
        if not many:
            return asked.join(rows, "cell").select("question_id", "vec_id", F.lit(0.0).alias("score"))
        blocks = F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("cell"))
        dot = retrieval.dot
        block = rows.select("cell", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), F.struct("vec_id", "embedding", dot(F.col("embedding"), F.col("embedding")).alias("own")).alias("row"))
        block = block.groupBy("cell", "block").agg(F.collect_list("row").alias("rows"))
        asked = asked.filter(F.col("cell").isin(*many)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("theirs", dot(F.col("asked"), F.col("asked")))
        score = F.transform("rows", lambda r: F.struct(r["vec_id"].alias("vec_id"), F.round(dot(r["embedding"], F.col("asked")) / F.sqrt(r["own"] * F.col("theirs")), 6).alias("score")))
        first = lambda s: F.when(F.isnan(s), F.lit(float("-inf"))).otherwise(-s)
        best = F.slice(F.array_sort(F.transform(score, lambda r: F.struct(first(r["score"]).alias("first"), r["vec_id"].alias("vec_id"), r["score"].alias("score")))), 1, k)
        return asked.join(block, ["cell", "block"]).select("question_id", F.inline(best)).select("question_id", "vec_id", "score")

    def search_many(self, questions: DataFrame, k: int = retrieval.HALF, probes: int | None = PROBES) -> DataFrame:
        """(question_id, vec_id, score, rank) of the k nearest of each question (question_id, embedding) in its `probes` nearest cells, or in all.

        Questions are sent to their cells by a join on the cell; what is null or zero there finds nothing.
        """
        centre = np.array([r.centre for r in self.bounds.read().orderBy("cell").collect()])  # as many as there are cells
        if not len(centre):
            return questions.limit(0).select("question_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.strip().split(" ") for x in self.hits.split(","))], F.lit(0).alias("rank"))
        sent, many = self.spark.sparkContext.broadcast(centre), min(probes or len(centre), len(centre))

        @F.arrow_udf("array<int>")
        def nearest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                near = np.argsort(-(_units(column) @ sent.value.T), axis=1, kind="stable")[:, :many] if len(column) else np.zeros((0, many), int)
                yield pa.ListArray.from_arrays(np.arange(0, near.size + 1, many, dtype=np.int32), near.astype(np.int32).ravel())

        asked = questions.filter(usable(F.col("embedding"))).select("question_id", F.col("embedding").alias("asked"))
        asked = written(retrieval.checked(asked, centre.shape[1], "asked").withColumn("cells", nearest("asked")), "asked")
        found = self._best_of_blocks(asked.select("question_id", "asked", F.explode("cells").alias("cell")), k)
        best = Window.partitionBy("question_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
