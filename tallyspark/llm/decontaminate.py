"""Benchmark decontamination: a distributed positional inverted index over the training texts.

The index is a table of segments. A segment covers a bounded number of words of some documents and
holds, for each term in it, the sorted list of its positions (differences, packed). Positions number
the words of all the segment's documents; a gap between documents keeps phrases from crossing over.
Searching reads segments where they lie: no postings are shuffled. Terms' frequencies are summed over
all segments, and each test window intersects its terms' offset-adjusted lists from the rarest on.

Test windows are sent to the tasks in blocks of BLOCK_WINDOWS, so what is broadcast is bounded;
a larger benchmark takes more passes over the index.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.words import NON_WORD, Words, batch_rows, chunks, pack, unpack

WINDOW = 13
#: A near match has each term of a window at most this far from its place.
SLOP = 2
#: Bytes of text in a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 3_500_000
#: Windows broadcast at once: 13 * 8 bytes each.
BLOCK_WINDOWS = 500_000

_INDEX = "segment string, ids array<bigint>, keys array<bigint>, n_words binary, terms binary, counts binary, steps binary"


def _gap(window: int, slop: int) -> int:
    return window + 2 * slop + 1


def _segments(gap: int):
    def run(batches):
        for rows in chunks(batch_rows(batches, "id", "key", "text"), SEGMENT_BYTES):
            words = Words([r[-1].lower() for r in rows], NON_WORD)
            n = words.counts
            place = np.arange(len(words.hash)) + np.repeat(np.arange(len(rows)) * gap, n)
            order = np.argsort(words.hash, kind="stable")
            ranked, place = words.hash[order], place[order]
            heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
            steps = np.diff(place, prepend=0)
            steps[heads] = place[heads]
            name = uuid.uuid4().hex
            yield pa.RecordBatch.from_pydict(
                {"segment": [name], "ids": [[r[0] for r in rows]], "keys": [[r[1] for r in rows]], "n_words": [pack(n.astype(np.int32))], "terms": [ranked[heads].tobytes()], "counts": [pack(np.diff(heads, append=len(ranked)).astype(np.int32))], "steps": [pack(steps.astype(np.int32))]},
                pa.schema([("segment", pa.string()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("n_words", "terms", "counts", "steps"))]),
            )

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Positional index of all words of all texts, written to the shared folder.

    Words are runs of ASCII letters, digits and any other characters above ASCII; A-Z count as a-z. A null
    text has no words. Every row, repeated ones too, has its own entry.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return common.save(read.mapInArrow(_segments(_gap(window, slop)), _INDEX), "postings")


class Windows:
    """Distinct word windows of some test items: terms (hashes) in rows of `size`, 0 beyond a short window's length."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int):
        words = Words([t.lower() for _, t in items], NON_WORD)
        found: dict[tuple, set] = defaultdict(set)
        for i, (item, _) in enumerate(items):
            own = words.hash[words.bounds[i] : words.bounds[i + 1]].tolist()
            for s in range(max(1, len(own) - size + 1) if own else 0):
                found[tuple(own[s : s + size])].add(item)
        self.terms = np.zeros((len(found), size), np.uint64)
        self.length = np.array([len(w) for w in found], np.int64)
        for i, w in enumerate(found):
            self.terms[i, : len(w)] = w
        self.items = [sorted(x for x in v if x is not None) for v in found.values()]
        self.vocabulary = np.unique(self.terms[np.arange(size) < self.length[:, None]])

    def rank(self, frequency: dict[int, int]) -> None:
        """Order each window's terms from the rarest in the corpus on."""
        often = np.array([frequency.get(int(t), 0) for t in self.vocabulary], np.int64)
        self.ids = np.searchsorted(self.vocabulary, self.terms) % max(1, len(self.vocabulary))
        cost = np.where(np.arange(self.terms.shape[1]) < self.length[:, None], often[self.ids], np.iinfo(np.int64).max)
        self.order = np.argsort(cost, axis=1, kind="stable")


def _find(lists, terms, order, length: int, slop: int) -> np.ndarray:
    """Starts at which each term of a window lies within slop of its place."""
    first = order[0]
    at = lists(terms[first]) - first
    for j in order[1:length]:
        if not len(at):
            break
        own = lists(terms[j])
        i = np.searchsorted(own, at + j - slop)
        at = at[(i < len(own)) & (own[np.minimum(i, len(own) - 1)] <= at + j + slop)]
    return at


def _matches(sent, slop: int, gap: int):
    def run(batches: Iterator[pa.RecordBatch]):
        w: Windows = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                n = unpack(row["n_words"], np.int32).astype(np.int64)
                terms, counts = np.frombuffer(row["terms"], np.uint64), unpack(row["counts"], np.int32).astype(np.int64)
                ends = np.cumsum(counts)
                steps = unpack(row["steps"], np.int32).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(n + gap)])[: len(n)]
                at = np.minimum(np.searchsorted(terms, w.vocabulary), max(0, len(terms) - 1))
                there = terms[at] == w.vocabulary if len(terms) else np.zeros(len(w.vocabulary), bool)
                known: dict[int, np.ndarray] = {}

                def lists(v, at=at, ends=ends, counts=counts, steps=steps, known=known):
                    if v not in known:
                        e = ends[at[v]]
                        known[v] = np.cumsum(steps[e - counts[at[v]] : e])
                    return known[v]

                cover = np.zeros(int(n.sum()) + gap * len(n) + 1, np.int32)
                exact: dict[int, set] = defaultdict(set)
                near: dict[int, set] = defaultdict(set)
                inside = np.arange(w.terms.shape[1]) < w.length[:, None]
                for k in np.flatnonzero((there[w.ids] | ~inside).all(1)) if len(w.length) else []:
                    starts = _find(lists, w.ids[k], w.order[k], w.length[k], 0)
                    np.add.at(cover, starts, 1)
                    np.subtract.at(cover, starts + w.length[k], 1)
                    for d in np.unique(np.searchsorted(begin, starts, "right") - 1):
                        exact[d].update(w.items[k])
                    if slop:
                        close = _find(lists, w.ids[k], w.order[k], w.length[k], slop) + w.order[k][0]
                        for d in np.unique(np.searchsorted(begin, close, "right") - 1):
                            near[d].update(w.items[k])
                hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                edge = np.flatnonzero(hit[1:] != hit[:-1])
                spans: dict[int, list] = defaultdict(list)
                for a, b, d in zip(edge[0::2], edge[1::2], np.searchsorted(begin, edge[0::2], "right") - 1, strict=True):
                    spans[d].append({"start": int(a - begin[d]), "end": int(b - begin[d])})
                rows = [{"segment": row["segment"], "place": d, "doc_id": i, "key": row["keys"][d], "n_words": int(n[d]), "spans": spans.get(d, []), "items": sorted(exact.get(d, ())), "near_items": sorted(near.get(d, ()))} for d, i in enumerate(row["ids"])]
                for s in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[s : s + 4096], _MATCH)

    return run


_MATCH = pa.schema([("segment", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64()))])
_MATCH_SQL = "segment string, place int, doc_id bigint, key bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>, near_items array<bigint>"


def _frequencies(sent):
    def run(batches):
        vocabulary = sent.value.vocabulary
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts = np.frombuffer(row["terms"], np.uint64), unpack(row["counts"], np.int32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    total += np.where(terms[at] == vocabulary, counts[at], 0)
        keep = total > 0
        yield pa.RecordBatch.from_pydict({"term": vocabulary[keep].view(np.int64), "n": total[keep]})

    return run


def _joined(batches):
    """Overlapping spans of one document merge; items are a set."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            merged: list[dict] = []
            for s in sorted(r["spans"], key=lambda s: s["start"]):
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(s)
            r["spans"] = merged
            r["items"], r["near_items"] = sorted(set(r["items"])), sorted(set(r["near_items"]))
        yield pa.RecordBatch.from_pylist(rows, _MATCH)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """All test items, streamed to the driver in lists of at most BLOCK_WINDOWS words of text, or of one item."""
    words = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    out: list = []
    total = 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), words.alias("n")).toLocalIterator():
        if total and total + r.n > BLOCK_WINDOWS:
            yield out
            out, total = [], 0
        out.append((r.id, bytes(r.text or b"")))
        total += r.n
    yield out


def search(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Exact phrase and proximity matches of every `window` consecutive words of test items in the index.

    One row for each indexed row: doc_id, key (xxhash64 of the text), n_words, spans (maximal intervals of words inside an exact match),
    items (ids of items with an exactly matching window), near_items (with every term of a window within
    `slop` words of its place). An item of fewer words, but not none, is one window; items with a null id
    count for spans but can't be listed. An empty benchmark matches nothing. window and slop must not exceed
    those the index was built with.
    """
    spark, parts = index.sparkSession, []
    for items in item_blocks(benchmark, id_col, text_col):
        windows = Windows(items, window)
        sent = spark.sparkContext.broadcast(windows)
        counts = index.select("terms", "counts").mapInArrow(_frequencies(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        windows.rank({int(np.int64(r.term).view(np.uint64)): r.n for r in counts.toLocalIterator()})
        sent.destroy()
        sent = spark.sparkContext.broadcast(windows)
        parts.append(index.mapInArrow(_matches(sent, slop, _gap(window, slop)), _MATCH_SQL))
    if len(parts) == 1:
        return parts[0].select("doc_id", "key", "n_words", "spans", "items", "near_items")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return out.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"), flat("spans"), flat("items"), flat("near_items")).select(*_MATCH.names).mapInArrow(_joined, _MATCH_SQL).select("doc_id", "key", "n_words", "spans", "items", "near_items")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """search() over all docs, with n_hit (words inside an exact match) and contaminated: n_hit > 0 and 20 * n_hit >= n_words."""
    found = search(build_index(docs), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows; rows are told apart by doc_id and text. Null and empty texts stay."""
    id_, key = common.fresh("id"), common.fresh("key")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias(id_), F.col("key").alias(key)).distinct()
    bad = common.save(bad, "contaminated")
    few = bad.limit(common.BROADCAST_IDS + 1).count() <= common.BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones too; see search() for nulls, empty texts and an empty benchmark."""
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")
