"""A written inverted index: the same hits as retrieval.text_search, from the postings of the asked words alone.

Postings (word, text, how often, the text's number of words) lie in parts by the word's hash, a word's over SPREAD of them,
so that no frequent word makes a part large. They are sorted by word: a search opens the asked words' parts and skips what
lies between. A second store has each text's digest, words and their counts. update() compares digests (retrieval.ingest_diff) and writes
only what changed; both are keyed stores, so an update's cost follows the change, not what was written before.

Texts without an id are left out; of an id's repeated rows one counts (the one with the largest digest).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tallyspark.operators import retrieval
from tallyspark.session import written
from tallyspark.streaming.store import KeyedStore

PARTS, SPREAD = 64, 4
#: Distinct words of many questions that are listed to the reader, so that it skips others; beyond, all postings are read.
LISTED = 2000
#: Texts whose postings are packed at once.
ROWS = 1000
#: Fixed values of the ranking by frequencies.
K1, B = 1.2, 0.75


def words(column: Column) -> Column:
    """All words of a text, repeated ones too, as retrieval.terms splits them."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def counted(rows: DataFrame) -> DataFrame:
    """The distinct words of each text and how often it has them, from its sorted words."""
    rows = rows.withColumn("w", F.sort_array(words(F.col("text"))))
    first = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = rows.withColumn("at", F.when(F.size("w") > 0, first).otherwise(F.array().cast("array<int>")))
    until = lambda j: F.coalesce(F.get("at", j + 1), F.size("w"))
    return rows.withColumn("terms", F.transform("at", lambda i: F.get("w", i))).withColumn("counts", F.transform("at", lambda i, j: until(j) - i))


def _unpacked(rows: DataFrame) -> DataFrame:
    """Postings one by one; those of texts without words take a posting away."""
    each = F.arrays_zip(F.split("words", " ").alias("term"), F.col("ns").alias("n"))
    return rows.select("part", "doc_id", "size", F.inline(each)).toDF("part", "doc_id", "size", "term", "n").withColumn("gone", F.col("size") == 0)


class TextIndex:
    """id_type: the type of doc_id. parts and spread are fixed by the first update."""

    def __init__(self, spark: SparkSession, path: str, id_type: str | DataType = "bigint", parts: int = PARTS, spread: int = SPREAD):
        self.spark, self.parts, self.spread = spark, parts, min(spread, parts)
        name = id_type if isinstance(id_type, str) else id_type.simpleString()
        deal = self._deal(F.col("term"), F.col("doc_id"))
        self.postings = KeyedStore(spark, f"{path}/postings", StructType.fromDDL(f"term string, doc_id {name}, n int, size int, gone boolean"), ["term", "doc_id"], ["size"], parts, deal=deal, gone="gone")
        self.texts = KeyedStore(spark, f"{path}/texts", StructType.fromDDL(f"doc_id {name}, content_hash string, terms array<string>, counts array<int>, gone boolean"), ["doc_id"], ["content_hash"], parts, gone="gone")

    def update(self, documents: DataFrame) -> dict[str, int]:
        """Bring the index to these documents (doc_id, text); gives how many were new, changed, unchanged and orphans.

        Texts are shuffled once, to the parts of their digests; their words are counted there, and the postings made of what
        lies there. Postings are merged before digests: an update that failed between them does its work again.
        """
        texts = documents.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        texts = texts.withColumn("content_hash", retrieval.content_hash(F.col("text"), "words"))
        flat = lambda df: df.select("doc_id", F.lit(0).alias("chunk_index"), "content_hash")
        had = self.texts.read(values=[F.col("content_hash")])
        diff = written(retrieval.ingest_diff(flat(had), flat(texts.groupBy("doc_id").agg(F.max("content_hash").alias("content_hash")))).select("doc_id", "action"), "diff")
        counts = {r.action: r.n for r in diff.groupBy("action").agg(F.count("*").alias("n")).collect()}
        ids = lambda *actions: diff.filter(F.col("action").isin(*actions)).select("doc_id")
        if set(counts) - {"unchanged"}:
            new = retrieval.picked(texts, ids("new", "changed")) if counts.get("unchanged") else texts
            if retrieval.repeated(texts, "doc_id"):
                new = new.groupBy("doc_id").agg(F.max_by("text", "content_hash").alias("text"), F.max("content_hash").alias("content_hash"))
            orphans = ids("orphan").select("doc_id", F.lit("").alias("text"), F.lit("").alias("content_hash"), F.lit(True).alias("gone"))
            n = self.texts.stage(new.withColumn("gone", F.lit(False)).unionByName(orphans), None, True, counted)
            coming = self.texts.staged(n).filter("not gone").select("doc_id", "terms", "counts")
            both = [coming.withColumn("size", F.size("terms"))]
            none = lambda terms: (F.transform(terms, lambda _: F.lit(0)).alias("counts"), F.lit(0).alias("size"))
            if counts.get("changed"):
                now = retrieval.picked(coming, ids("changed")).select("doc_id", F.col("terms").alias("now"))
                lost = retrieval.picked(self.texts.read(values=[F.col("terms")]), ids("changed")).join(now, "doc_id").select("doc_id", F.array_except("terms", "now").alias("terms"))
                both.append(lost.select("doc_id", "terms", *none("terms")))
            if counts.get("orphan"):
                lost = retrieval.picked(self.texts.read(values=[F.col("terms")]), ids("orphan"))
                both.append(lost.select("doc_id", "terms", *none("terms")))
            self.postings.merge(self.postings.stage(self._packed(reduce(DataFrame.unionByName, both)), None, True, _unpacked, F.col("at")))
            self.texts.merge(n)
        return {a: counts.get(a, 0) for a in ("new", "changed", "unchanged", "orphan")}

    def _deal(self, term: Column, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(term) + F.pmod(F.xxhash64(doc_id), F.lit(self.spread)), F.lit(self.parts))

    def _packed(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, terms, counts, size) as one for each text and part, its words in a string: what is shuffled has a text's id once, not with each word."""
        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS)):
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
                if not len(row):
                    continue
                key = row * parts + b.column("at").flatten().to_numpy()
                order = np.argsort(key, kind="stable")
                key = key[order]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                offsets = pa.array(np.append(starts, len(key)).astype(np.int32))
                words, ns = (pa.ListArray.from_arrays(offsets, b.column(c).flatten().take(order)) for c in ("terms", "counts"))
                of = key[starts] // parts
                yield pa.RecordBatch.from_arrays([pa.array(key[starts] % parts), b.column("doc_id").take(of), b.column("size").take(of), pc.binary_join(words, " "), ns], ["at", "doc_id", "size", "words", "ns"])

        kind = dict(rows.dtypes)["doc_id"]
        at = F.transform("terms", lambda t: self._deal(t, F.col("doc_id"))).alias("at")
        return rows.select("doc_id", "size", "terms", "counts", at).mapInArrow(run, f"at bigint, doc_id {kind}, size int, words string, ns array<int>")

    def parts_of(self, asked: list[str]) -> list[int]:
        """The parts that postings of these words can be in."""
        at = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(w)) + F.lit(i), F.lit(self.parts)) for w in asked for i in range(self.spread)]).first()
        return sorted({int(p) for p in at})

    def read(self, asked: list[str]) -> DataFrame:
        """The postings of these words."""
        return self.postings.read(parts=self.parts_of(asked), only=F.col("term").isin(asked))

    def frequencies(self, asked: list[str]) -> DataFrame:
        """(term, texts, occurrences) of the words that some text has."""
        return self.read(asked).groupBy("term").agg(F.count("*").alias("texts"), F.sum("n").alias("occurrences"))

    def search(self, query: str, k: int = retrieval.HALF, by: str = "share", where: Column | None = None) -> DataFrame:
        """Texts with all words of the query; only if there are none, texts with any. Ties to the smaller id. where: a condition on doc_id.

        by share: matched words over length, the scores of retrieval.text_search. by frequencies: the sum over the words of
        their rarity times how often the text has them, against its length (BM25).
        """
        asked = retrieval.asked(query)
        if not asked:
            return self.postings.read(parts=[]).select("doc_id", F.lit(0.0).alias("score"))
        rows = self.read(asked)
        rows = rows.filter(where) if where is not None else rows
        if by == "share":
            found = rows.groupBy("doc_id").agg(F.count("*").alias("hits"), F.max("size").alias("size")).withColumn("score", F.round(F.col("hits") / (1 + F.log(F.col("size").cast("double"))), 6))
        else:
            all_texts = self.texts.read(values=[F.size("terms").alias("size")]).agg(F.count("*").alias("all"), F.avg("size").alias("usual"))  # one row
            rarity = rows.groupBy("term").agg(F.count("*").alias("with"))
            rows = rows.join(F.broadcast(rarity), "term").join(F.broadcast(all_texts))
            weight = F.log(1 + (F.col("all") - F.col("with") + 0.5) / (F.col("with") + 0.5))
            often = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("size") / F.col("usual")))
            found = rows.withColumn("part", weight * often).groupBy("doc_id").agg(F.count("*").alias("hits"), F.round(F.sum("part"), 6).alias("score"))
        return retrieval.all_or_any(found.select("doc_id", (F.col("hits") == len(asked)).alias("full"), "score"), k)

    def search_many(self, questions: DataFrame, k: int = retrieval.HALF) -> DataFrame:
        """(question_id, doc_id, score, rank) of the k best texts of each question (question_id, query), in one job.

        The same scores and the same all-or-any rule as search(); questions meet the postings of their words in a join. Their
        words are only listed to the reader while they are at most LISTED.
        """
        wanted = questions.select("question_id", F.array_distinct(words(F.col("query"))).alias("terms")).withColumn("asked", F.size("terms"))
        wanted = written(wanted.select("question_id", "asked", F.explode("terms").alias("term")), "wanted")
        some = [r.term for r in wanted.select("term").distinct().limit(LISTED + 1).collect()]
        rows = self.read(some) if 0 < len(some) <= LISTED else self.postings.read()
        hits = rows.join(wanted, "term").groupBy("question_id", "doc_id").agg(F.count("*").alias("hits"), F.max("size").alias("size"), F.max("asked").alias("asked"))
        hits = hits.select("question_id", "doc_id", (F.col("hits") == F.col("asked")).alias("full"), F.round(F.col("hits") / (1 + F.log(F.col("size").cast("double"))), 6).alias("score"))
        best = Window.partitionBy("question_id").orderBy(F.desc("full"), F.desc("score"), "doc_id")
        hits = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        every = F.max("full").over(Window.partitionBy("question_id"))  # of k rows
        return hits.withColumn("any_full", every).filter(F.col("full") | ~F.col("any_full")).select("question_id", "doc_id", "score", "rank")
