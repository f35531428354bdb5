"""Retrieval over chunks: chunking, incremental ingest, vector, text and hybrid search, and how well they hit."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import ordering

#: Characters of a chunk and of the overlap; hits of each half; the constant of reciprocal rank fusion; batch limits.
CHUNK, OVERLAP = 2000, 200
HALF, RRF = 30, 60
BATCH_ITEMS, BATCH_CHARS = 128, 120_000
#: Ids up to this number are broadcast to pick rows; beyond it, rows are shuffled.
BROADCAST_IDS = 2_000_000


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs, else sentences, else hard cuts, packed up to size; each chunk begins with the end of the one before it, from a word on."""
    pieces: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text or ""):
        parts = [paragraph.strip()] if len(paragraph) <= size else re.split(r"(?<=[.!?])\s+", paragraph.strip())
        for part in parts:
            pieces += [part[i : i + size] for i in range(0, len(part), size)]
    packed: list[str] = []
    for piece in filter(None, pieces):
        if packed and len(packed[-1]) + 2 + len(piece) <= size:
            packed[-1] += "\n\n" + piece
        else:
            packed.append(piece)
    out = packed[:1]
    for before, chunk in zip(packed, packed[1:], strict=False):
        tail = before[-overlap:] if overlap else ""
        tail = tail[tail.find(" ") + 1 :] if len(before) > overlap and " " in tail else tail
        out.append(f"{tail}\n{chunk}" if tail else chunk)
    return out


def chunks(documents: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk_index, content, and the columns to keep): packing is sequential within a text, so it runs in Arrow batches; an empty text has no chunks."""
    keep = keep or []

    def run(batches):
        for batch in batches:
            rows = [(i, n, c, *more) for i, t, *more in batch.itertuples(index=False) for n, c in enumerate(split_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content", *keep])

    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    rows = documents.select(F.col("doc_id").cast("long"), "text", *keep)
    schema = StructType([StructField("doc_id", LongType()), StructField("chunk_index", IntegerType()), StructField("content", StringType()), *[rows.schema[c] for c in keep]])
    return rows.mapInPandas(run, schema)


def passages(documents: DataFrame, title: str, metadata: list[str], size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, content, metadata): chunks that each begin with the text's title, and its other columns as a map.

    A text without title has its passages as they are; metadata leaves out columns that are null. Both go along with a text,
    so rows of one id keep their own.
    """
    about = F.to_json(F.struct(F.col(title).cast("string").alias("title"), *[F.col(c).cast("string").alias(f"m_{c}") for c in metadata]))
    named = chunks(documents.withColumn("__about", about), size, overlap, ["__about"])
    told = F.from_json("__about", "title string" + "".join(f", `m_{c}` string" for c in metadata))
    named = named.withColumn("__told", told)
    values = F.create_map(*[x for c in metadata for x in (F.lit(c), F.col("__told")[f"m_{c}"])]) if metadata else F.create_map().cast("map<string, string>")
    head = F.col("__told.title")
    return named.select("doc_id", "chunk_index", F.concat_ws("\n\n", F.when(F.trim(head) != "", head), "content").alias("content"), F.map_filter(values, lambda _, v: v.isNotNull()).alias("metadata"))


def content_hash(content: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), content), 256)


def ingest_diff(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, action): new, changed, unchanged, or orphan; both have content_hash."""
    s = stored.select("doc_id", "chunk_index", F.col("content_hash").alias("had"))
    w = wanted.select("doc_id", "chunk_index", F.col("content_hash").alias("has"))
    action = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "orphan").when(F.col("had") == F.col("has"), "unchanged").otherwise("changed")
    return s.join(w, ["doc_id", "chunk_index"], "full_outer").select("doc_id", "chunk_index", action.alias("action"))


def batches(items: DataFrame, size_col: str, max_items: int = BATCH_ITEMS, max_chars: int = BATCH_CHARS, keys: list[str] | None = None) -> DataFrame:
    """Items with their batch, filled greedily by number and characters in the order of keys (all columns, if none are named), which must tell items apart."""
    return ordering.batches(items, size_col, keys or items.columns, max_items, max_chars)


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ids (one column, which is counted): by broadcast up to BROADCAST_IDS."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, ids.columns[0], "left_semi")


def repeated(rows: DataFrame, key: str) -> bool:
    """Whether any key is there more than once."""
    return not rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def checked(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """Vectors of the model's length; a row of another length fails the job."""
    ok = F.size(column) == size
    return vectors.filter(F.when(ok, True).otherwise(F.raise_error(F.lit(f"a vector does not have {size} components")).cast("boolean")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(vectors: DataFrame, query: list[float], k: int = HALF, where: Column | None = None) -> DataFrame:
    """The k nearest by cosine; ties to the smaller id. Every row is compared; each task passes on k rows."""
    rows = vectors.filter(where) if where is not None else vectors
    asked = F.array(*[F.lit(float(x)) for x in query])
    found = rows.select("vec_id", F.round(cosine(F.col("embedding"), asked), 6).alias("score"))
    return found.orderBy(F.desc("score"), "vec_id").limit(k)


def terms(column: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def asked(query: str) -> list[str]:
    """The words of a query."""
    return sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})


def all_or_any(rows: DataFrame, k: int) -> DataFrame:
    """The k best of rows (doc_id, full, score): full ones alone, or any if there is no full one; ties to the smaller id."""
    # texts with all words come first: if there is one, those with some words are cut off from the k
    best = rows.orderBy(F.desc("full"), F.desc("score"), "doc_id").limit(k)
    every = F.max("full").over(Window.partitionBy(F.lit(1)))  # of k rows
    return best.withColumn("any_full", every).filter(F.col("full") | ~F.col("any_full")).select("doc_id", "score").orderBy(F.desc("score"), "doc_id")


def text_search(documents: DataFrame, query: str, k: int = HALF) -> DataFrame:
    """Texts with all words of the query; only if there are none, texts with any. Ranked by matched words over length."""
    wanted = asked(query)
    if not wanted:
        return documents.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    words = F.array(*map(F.lit, wanted))
    rows = documents.select("doc_id", terms(F.col("text")).alias("terms")).withColumn("hits", F.size(F.array_intersect("terms", words)))
    return all_or_any(rows.filter("hits > 0").select("doc_id", (F.col("hits") == len(wanted)).alias("full"), F.round(F.col("hits") / (1 + F.log(F.size("terms").cast("double"))), 6).alias("score")), k)


def _placed(hits: DataFrame, id_col: str, name: str) -> DataFrame:
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), id_col))).select(F.col(id_col).alias("id"), name)  # of k rows


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, vector_id: str = "vec_id", text_id: str = "doc_id", k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two rankings: 1 / (60 + rank) of each half, ties to the smaller id."""
    both = _placed(vector_hits, vector_id, "vector_rank").join(_placed(text_hits, text_id, "text_rank"), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return both.withColumn("score", F.round(part("vector_rank") + part("text_rank"), 8)).orderBy(F.desc("score"), "id").limit(k)


def hit_at_k(expected: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """Share of questions (question_id, expected) of which a result (question_id, rank, title) up to k holds the expected text."""
    near = results.filter(F.col("rank") <= k)
    found = expected.join(near, "question_id", "left").groupBy("question_id").agg(F.coalesce(F.bool_or(F.lower("title").contains(F.lower("expected"))), F.lit(False)).alias("hit"))
    return found.agg(F.count("*").alias("questions"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"))


def chunk_counts(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.groupBy("doc_id").agg(F.count("*").alias("chunks"))
