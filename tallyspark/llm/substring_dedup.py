"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark.

1. A pass over the texts hashes each window of `window` words. Within one chunk of texts a repeated
   window is settled at once: only its earliest place goes on, so a passage that a third of all
   documents share costs one entry a chunk, not one a document.
2. The earliest places meet in buckets of the hash space, whose number follows the bytes of text.
   Of each hash all places but the smallest (doc_id, start) come back, by document.
3. Only documents with such places are read again; their windows merge into maximal intervals.

Hashes have 64 bits; the chance that n windows hold a false match is about n**2 / 2**65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.words import SPACES, Words, batch_rows, chunks, key_of, pack, unpack

#: Bytes of text whose windows meet in one bucket, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 128

_PLACES = "bucket int, hashes binary, ids binary, salts binary, counts binary, starts binary"
_BACK = "id long, salt int, starts binary"


def _salt(words: Words) -> np.ndarray:
    """Tells apart texts with one doc_id."""
    return (words.whole() >> np.uint64(33)).astype(np.int32)


def _places(window: int, buckets: int):
    """Chunks of texts as rows for each bucket; negative ones have the places that are settled."""

    def run(batches):
        for rows in chunks(batch_rows(batches, "id", "text")):
            rows.sort(key=lambda r: key_of(r[0]))
            words = Words([t for _, t in rows], SPACES)
            ids, salts = np.array([key_of(i) for i, _ in rows], np.int64), _salt(words)
            hashes, bounds = words.windows(window, short=False)
            doc = np.repeat(np.arange(len(rows)), np.diff(bounds))
            start = np.arange(len(hashes)) - bounds[doc]
            by = np.lexsort((salts, ids))  # a repeated row counts once
            again = np.zeros(len(rows), bool)
            again[by[1:]] = (ids[by[1:]] == ids[by[:-1]]) & (salts[by[1:]] == salts[by[:-1]])
            keep = ~again[doc]
            hashes, doc, start = hashes[keep], doc[keep], start[keep].astype(np.int32)
            if not len(hashes):
                continue
            tied = np.any((ids[1:] == ids[:-1]))
            order = np.lexsort((start, salts[doc], ids[doc], hashes)) if tied else np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            later = np.concatenate([[False], ranked[1:] == ranked[:-1]])
            parts = [(np.full(int(later.sum()), -1 - int(ranked[0] % np.uint64(buckets))), np.sort(order[later]))]
            first = np.sort(order[~later])
            bucket = (hashes[first] % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            parts.append((bucket[by], first[by]))
            out = {n: [] for n in ("bucket", "hashes", "ids", "salts", "counts", "starts")}
            for which, entries in parts:
                cuts = np.flatnonzero(np.diff(which)) + 1
                for e, b in zip(np.split(entries, cuts), which[np.concatenate([[0], cuts])] if len(which) else [], strict=False):
                    d, counts = np.unique(doc[e], return_counts=True)
                    for n, v in zip(out, (int(b), pack(hashes[e]) if b >= 0 else b"", pack(ids[d]), pack(salts[d]), pack(counts.astype(np.int32)), pack(start[e])), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in list(out)[1:])]))

    return run


def _by_doc(ids: np.ndarray, salts: np.ndarray, starts: np.ndarray) -> pa.Table:
    order = np.lexsort((starts, salts, ids))
    ids, salts, starts = ids[order], salts[order], starts[order]
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (salts[1:] != salts[:-1])) + 1
    heads = np.concatenate([[0], cut]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    return pa.table({"id": pa.array(ids[heads], pa.int64()), "salt": pa.array(salts[heads], pa.int32()), "starts": pa.array([s.astype(np.int32).tobytes() for s in np.split(starts, cut)][: len(heads)], pa.binary())})


def _entries(table: pa.Table, hashed: bool):
    columns = {n: table.column(n).to_pylist() for n in ("hashes", "ids", "salts", "counts", "starts")}
    join = lambda n, kind: np.concatenate([unpack(x, kind) for x in columns[n]])
    counts = join("counts", np.int32)
    return (join("hashes", np.uint64) if hashed else None, np.repeat(join("ids", np.int64), counts), np.repeat(join("salts", np.int32), counts), join("starts", np.int32))


def _later(table: pa.Table) -> pa.Table:
    """Places of one bucket whose window also starts earlier; those of a negative one are known to."""
    if table.column("bucket")[0].as_py() < 0:
        return _by_doc(*_entries(table, False)[1:])
    hashes, ids, salts, starts = _entries(table, True)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    e = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    e = e[np.lexsort((starts[e], salts[e], ids[e], hashes[e]))]
    head = np.concatenate([[True], hashes[e][1:] != hashes[e][:-1]]) if len(e) else np.zeros(0, bool)
    first = e[head][np.cumsum(head) - 1] if len(e) else e
    late = e[(ids[e] != ids[first]) | (salts[e] != salts[first]) | (starts[e] != starts[first])]
    return _by_doc(ids[late], salts[late], starts[late])


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal intervals [begin, end) covered by windows at sorted starts, one a row."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + window], 1)


def repeated_spans(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, salt, starts) for each document with windows that also start earlier.

    salt tells apart rows with one id and different texts; starts are lists of binary int32, in words.
    """
    buckets = max(LEAST_BUCKETS, common.text_bytes(docs, text_col) // BUCKET_BYTES)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    later = read.mapInArrow(_places(window, buckets), _PLACES).groupBy("bucket").applyInArrow(_later, _BACK)
    return later.groupBy("id", "salt").agg(F.collect_list("starts").alias("starts"))


def _plain(batches):
    for rows in chunks(batch_rows(batches, "id", "text")):
        salts = _salt(Words([t for _, t in rows], SPACES))
        words = [t.split() for _, t in rows]
        yield pa.RecordBatch.from_pydict(
            {"id": [key_of(i) for i, _ in rows], "salt": salts, "n_words": [len(w) for w in words], "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words], "null_id": [i is None for i, _ in rows]},
            pa.schema([("id", pa.int64()), ("salt", pa.int32()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("null_id", pa.bool_())]),
        )


def _cut(window: int):
    def run(batches):
        for rows in chunks(batch_rows(batches, "id", "salt", "starts", "text")):
            salts = _salt(Words([r[-1] for r in rows], SPACES))
            out = []
            for (i, salt, starts, text), own in zip(rows, salts, strict=True):
                if own != salt:
                    continue
                words, kept, done, removed = text.split(), [], 0, []
                for a, b in intervals(np.concatenate([np.frombuffer(s, np.int32) for s in starts]), window).tolist():
                    kept += words[done:a]
                    done = b
                    removed.append({"start": a, "end": b})
                kept += words[done:]
                out.append({"id": i, "salt": salt, "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode("utf-8", "replace"), "removed": removed})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.int64()), ("salt", pa.int32()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return run


def cut_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that lose words: id, salt, n_removed, kept (the words left, joined by a space), removed (intervals of words).

    Null texts and texts of fewer words than the window lose none. Rows with one id and one text count
    as one document; with one id and different texts they are separate, ordered by a hash of the text. A
    null id sorts last.
    """
    spans = common.save(repeated_spans(docs, window, id_col, text_col), "spans")
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    again = common.rows_with(read, spans, "id").distinct()
    return again.join(spans, "id").select("id", "salt", "starts", "text").mapInArrow(_cut(window), "id long, salt int, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones too; see cut_repeats() for nulls, short texts and ties."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = cut_repeats(docs).select("id", "salt", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("cut_sha256"), F.size("removed").cast("long").alias("n_spans"))
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(_plain, "id long, salt int, n_words long, kept_sha256 string, null_id boolean")
    return plain.join(cut, ["id", "salt"], "left").select(
        F.when(~F.col("null_id"), F.col("id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"), F.coalesce("n_spans", F.lit(0)).alias("n_spans")
    )
