"""Search over a shop's products and documents: passages in a text index and a vector index under the same ids.

A passage's id is its kind, its source's id and its place, so a search of one kind reads that kind's ids. The embedding is
a column function: a model's pandas UDF, or `hashed`, which needs none.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.operators import retrieval
from tallyspark.operators.text_index import TextIndex, words
from tallyspark.operators.vector_index import VectorIndex
from tallyspark.session import written
from tallyspark.streaming.store import KeyedStore

#: Characters of a passage in an answer; places of the hashed embedding.
SHOWN, SIZE = 600, 64


def hashed(text: Column, size: int = SIZE) -> Column:
    """Counts of words by a hash: an embedding without a model. All zero for a text without words."""

    @F.arrow_udf("array<float>")
    def counts(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), size), np.float32)
        place: dict[str, int] = {}
        for i, ws in enumerate(texts.to_pylist()):
            for w in ws or ():
                if w not in place:
                    place[w] = int(md5(w.encode()).hexdigest()[:4], 16) % size
                out[i, place[w]] += 1
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, size, dtype=np.int32), out.ravel())

    return counts(words(text))


def fused(vector_hits: DataFrame, text_hits: DataFrame, k: int) -> DataFrame:
    """retrieval.hybrid of two rankings over the same string ids."""
    return retrieval.hybrid(vector_hits, text_hits, "vec_id", "doc_id", k)


class Knowledge:
    """update() brings all to the passages it is given: (kind, source_id, chunk_index, title, content)."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = hashed, parts: int = 64, cells: int = 64):
        self.spark, self.embed = spark, embed
        self.texts = TextIndex(spark, f"{path}/texts", "string", parts)
        self.vectors = VectorIndex(spark, f"{path}/vectors", cells, "string")
        self.passages = KeyedStore(spark, f"{path}/passages", StructType.fromDDL("id string, kind string, title string, content string, gone boolean"), ["id"], ["content"], parts, gone="gone")

    def update(self, passages: DataFrame) -> dict[str, int]:
        """Texts say what changed; a passage's embedding is only computed anew with its text."""
        named = passages.filter("kind is not null and source_id is not null").select(F.concat_ws(":", "kind", F.col("source_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "kind", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
        full = F.concat_ws("\n\n", F.when(F.trim("title") != "", F.col("title")), "content")
        digest = F.sha2(F.concat_ws("\0", "title", "content"), 256)
        twice = retrieval.repeated(named, "id")
        known = self.passages.read(values=[digest.alias("had")])
        coming = named.withColumn("has", digest)
        if self.passages.versions_at():  # digests are compared first, so that only texts that change are moved
            fresh = named.select("id", digest.alias("has")).join(known, "id", "left").filter(F.col("had").isNull() | (F.col("had") != F.col("has")))
            fresh = written(fresh.select(F.struct("id", "has").alias("key")).distinct(), "fresh")
            coming = retrieval.picked(coming.withColumn("key", F.struct("id", "has")), fresh)
        lost = written(known.join(named.select("id"), "id", "left_anti").select("id"), "lost")
        away = lost.select("id", *[F.lit("").alias(c) for c in ("kind", "title", "content")], F.lit(True).alias("gone"))
        n = self.passages.stage(coming.select("id", "kind", "title", "content", F.lit(False).alias("gone")).unionByName(away), None, not twice)
        coming = self.passages.staged(n).filter("not gone")
        counts = self.texts.update(named.select(F.col("id").alias("doc_id"), full.alias("text")))
        embedded = written(coming.select(F.col("id").alias("vec_id"), self.embed(full).alias("embedding"), "kind"), "embedded")
        self.vectors.change(embedded, lost.select(F.col("id").alias("vec_id")), ["kind"], once=True)
        self.passages.merge(n)
        return counts

    def hits(self, query: str, k: int = 10, kind: str | None = None) -> DataFrame:
        """(id, vector_rank, text_rank, score): reciprocal ranks of both halves added up."""
        asked = [float(x) for x in self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first().v]
        near = self.vectors.search(asked, retrieval.HALF, having={"kind": kind} if kind else None, exact=True)
        found = self.texts.search(query, retrieval.HALF, where=F.col("doc_id").startswith(f"{kind}:") if kind else None)
        return fused(near, found, k)

    def search(self, query: str, k: int = 8, kind: str | None = None) -> DataFrame:
        """(id, kind, title, text, score) of the k best passages, the best first."""
        best = self.hits(query, k, kind).select("id", "score")
        return self.passages.read().join(F.broadcast(best), "id").orderBy(F.desc("score"), "id").select("id", "kind", "title", F.substring("content", 1, SHOWN).alias("text"), "score")

    def search_many(self, questions: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """(question_id, mode, rank, id, title) of the k best passages of each question (question_id, query) by vector, by text and by both."""
        embedded = written(questions.select("question_id", self.embed(F.col("query")).alias("embedding")), "questions")
        near = written(self.vectors.search_many(embedded, retrieval.HALF, probes).select("question_id", F.col("vec_id").alias("id"), F.col("rank").alias("vector_rank")), "near")
        found = written(self.texts.search_many(questions, retrieval.HALF).select("question_id", F.col("doc_id").alias("id"), F.col("rank").alias("text_rank")), "found")
        part = lambda c: F.coalesce(1.0 / (retrieval.RRF + F.col(c)), F.lit(0.0))
        both = near.join(found, ["question_id", "id"], "full_outer").withColumn("score", F.round(part("vector_rank") + part("text_rank"), 8))
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "id"))
        hits = near.select("question_id", "id", F.lit("vector").alias("mode"), F.col("vector_rank").alias("rank")).unionByName(found.select("question_id", "id", F.lit("text").alias("mode"), F.col("text_rank").alias("rank")))
        hits = hits.unionByName(both.select("question_id", "id", F.lit("hybrid").alias("mode"), place.alias("rank"))).filter(F.col("rank") <= k)
        return hits.join(self.passages.read().select("id", "title"), "id").select("question_id", "mode", "rank", "id", "title")

    def evaluate(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(mode, questions, hits, hit_rate): of how many questions (question_id, query, expected) a title among the k best holds what is expected."""
        found = self.search_many(questions, k)
        modes = questions.select("question_id", "expected").join(self.spark.createDataFrame([("vector",), ("text",), ("hybrid",)], "mode string"))  # three
        hit = F.coalesce(F.bool_or(F.contains(F.lower("title"), F.lower("expected"))), F.lit(False)).alias("hit")
        each = modes.join(found, ["question_id", "mode"], "left").groupBy("question_id", "mode").agg(hit)
        return each.groupBy("mode").agg(F.count("*").alias("questions"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"))
