"""Toxicity: class-conditional Kneser-Ney models of the pieces of words.

A word is a path of pieces: two bytes each for LEVELS levels, then what is left of it, then its end. In each
class a piece's probability after the path before it is a discounted count over labelled training texts, each
word counted once a text. What the discount leaves goes to a shared probability: the number of classes in which
the piece follows this path, and what LOWER takes off that number goes to the piece's continuation count (before
how many different paths it stands). The discounts of counts of 1, 2, and 3 and more are estimated for each class
from its counts of counts. A piece never seen after a known path differs between the classes by what they have
left there. A text's evidence is the difference of its toxic and ordinary log-likelihoods, divided by its length;
a logistic function of that, of the strongest words and of the length gives the score. It is fitted on training
texts scored without their own counts.

All counts cover all training texts and are added up in Spark. Every counted path is in the model, which grows
with the corpus. For scoring, a path is reduced to two numbers: what it adds to a word's evidence, and what a word
gets that leaves the known paths behind it. Up to BROADCAST_PATHS of them are broadcast; beyond, words are joined
with them and their evidence with the texts (`_far`), with the same scores. Bounded are only the FIT texts the
logistic function is fitted on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.words import NON_WORD, Words, batch_rows, chunks, distinct, pack, unpack

#: The largest model that is broadcast (16 bytes a path), and texts that the logistic function is fitted on.
BROADCAST_PATHS, FIT = 8_000_000, 20_000
LEVELS, STEP = 6, 2
#: What is taken off counts of 1, 2, and 3 and more where the counts of counts tell nothing.
DISCOUNTS = (0.5, 1.0, 1.5)
#: What is taken off the number of classes in which a piece follows a path.
LOWER = 0.5
#: The largest evidence of a word and that of a strong one, words counted as the strongest, and the score from which a text counts as toxic.
MOST, STRONG, STRONGEST, THRESHOLD = 8.0, 2.0, 4, 0.7
#: Texts are picked for the logistic function by this many values of a hash of their doc_id, so about FIT are.
_PICKS = 1 << 40
#: Counts that a task gathers before it passes them on.
GATHERED = 1 << 20
#: Rows of a task that are scored at once.
SLICE = 256

_COUNTS = pa.schema([("key", pa.int64()), ("parent", pa.int64()), ("piece", pa.int64()), ("ordinary", pa.int64()), ("toxic", pa.int64())])


def _paths(words: Words, which: np.ndarray):
    """Keys of the paths of some words, one column a level, and of their last pieces; 0 beyond a word's end."""
    spelled, start, end = words.spelled(which)
    size = end - start
    keys, pieces = np.zeros((len(which), LEVELS + 2), np.int64), np.zeros((len(which), LEVELS + 2), np.int64)
    for j in range(LEVELS + 2):
        a = np.minimum(start + j * STEP, end)
        b = np.minimum(a + STEP, end) if j < LEVELS else end
        there = size >= j * STEP if j <= LEVELS else size > LEVELS * STEP  # a word ends with an empty piece
        level = np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)  # a path and the same one with its end differ
        keys[:, j] = np.where(there, (spelled.hash(start, b) ^ level).view(np.int64), 0)
        pieces[:, j] = np.where(there, spelled.hash(a, b).view(np.int64) if j < LEVELS else j, 0)
    return keys, pieces


def _words(texts: list[bytes]):
    """Words, the text of each kind of word in each text, where each distinct word stands first, and its number."""
    words = Words([t.lower() for t in texts], NON_WORD)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    _, first, where = np.unique(words.hash, return_index=True, return_inverse=True)
    once = distinct(doc * len(first) + where)
    return words, once // max(1, len(first)), first, once % max(1, len(first))


def _added(parts: list[tuple]) -> tuple:
    key, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    take = lambda i: np.concatenate([p[i] for p in parts])
    return key, take(1)[first], take(2)[first], *(np.bincount(where, take(i), len(key)).astype(np.int64) for i in (3, 4))


def _counts(batches):
    """Counts of paths by class, summed over as many texts as GATHERED allows."""
    parts, size = [], 0
    for rows in chunks(batch_rows(batches, "toxic", "text")):
        words, doc, first, where = _words([t for _, t in rows])
        toxic = np.array([y for y, _ in rows], np.float64)[doc]
        keys, pieces = _paths(words, first)
        many = np.bincount(where, minlength=len(first)), np.bincount(where, toxic, len(first))
        for j in range(LEVELS + 2):
            on = keys[:, j] != 0
            parent = keys[on, j - 1] if j else np.zeros(int(on.sum()), np.int64)
            parts.append(_added([(keys[on, j], parent, pieces[on, j], (many[0] - many[1])[on], many[1][on])]))
        size = sum(len(p[0]) for p in parts)
        if size > GATHERED:
            parts = [_added(parts)]
            size = len(parts[0][0])
        if size > GATHERED:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, parts[0])), schema=_COUNTS)
            parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _added(parts))), schema=_COUNTS)


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 and more, from how many paths have counts of 1, 2, 3 and 4."""
    y = n[0] / max(1, n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / max(1, n[k - 1]) for k in (1, 2, 3)]
    return np.array([0, *[d if n[k] and 0 < d < k + 1 else DISCOUNTS[k] for k, d in enumerate(found)]])


def _off(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(counts, 3).astype(np.int64)]


class Model:
    """Of each path: its occurrences and what is discounted from those of the paths one piece longer, by
    class, and the shared probability of its last piece. total and first are those of the empty path; taken: discounts by class."""

    def __init__(self, keys, seen, follow, shared, total, first, taken):
        self.keys, self.total, self.first, self.taken = keys, total, first, taken
        self.seen = [np.append(s, 0).astype(np.float32) for s in seen]
        self.follow = [np.append(f, 0).astype(np.float32) for f in follow]
        self.shared = np.append(shared, 0).astype(np.float32)

    def evidence(self, texts: list[bytes], own: np.ndarray | None = None):
        """For each word of each text its toxic minus its ordinary log-probability; own: classes whose counts hold the text."""
        words, doc, first, where = _words(texts)
        keys, _ = _paths(words, first)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        at = np.where((self.keys[at] == keys) & (keys != 0), at, len(self.keys)) if len(self.keys) else np.zeros_like(keys)
        there = keys != 0
        if own is None:
            return self._sum(at, there)[where], doc
        out = np.zeros(len(where))
        for d in range(len(texts)):
            s = slice(*np.searchsorted(doc, [d, d + 1]))
            if s.start < s.stop:
                out[s] = self._sum(at[where[s]], there[where[s]], int(own[d]))
        return out, doc

    def _own(self, at: np.ndarray, k: int):
        """Of the words of one text of class k: occurrences of their paths in it, and how much less is discounted after the path before without them."""
        mine, less = np.zeros(at.shape), np.zeros(at.shape)
        for j in range(at.shape[1]):
            child, one, inverse = np.unique(at[:, j], return_index=True, return_inverse=True)
            many, seen = np.bincount(inverse), self.seen[k][child]
            mine[:, j] = many[inverse]
            gone = _off(seen, self.taken[k]) - _off(np.maximum(seen - many, 0), self.taken[k])
            _, before = np.unique(at[:, j - 1], return_inverse=True) if j else (None, np.zeros(len(at), np.int64))
            less[:, j] = np.bincount(before[one], gone, before.max() + 1)[before]
        return mine, less

    def _sum(self, at: np.ndarray, there: np.ndarray, own: int | None = None) -> np.ndarray:
        """Evidence of words by the rows of their paths, the last row for unseen ones; own: the class whose counts hold these words, as one text."""
        logs = []
        for k in (0, 1):
            mine, less = self._own(at, k) if own == k else (0, 0)
            seen = np.maximum(self.seen[k][at] - mine, 0).astype(np.float64)
            before = np.concatenate([np.full((len(at), 1), max(0, self.total[k] - (len(at) if own == k else 0))), seen[:, :-1]], 1)
            left = np.concatenate([np.full((len(at), 1), self.first[k]), self.follow[k][at][:, :-1]], 1) - less
            shared = np.maximum(self.shared[at], 1e-9)
            n = np.maximum(before, 1)
            p = np.maximum(seen - _off(seen, self.taken[k]), 0) / n + np.minimum(1, np.maximum(left, self.taken[k][1:].min()) / n) * shared
            logs.append(np.where(before > 0, np.log(p), np.log(shared)))
        return np.clip(np.where(there, logs[1] - logs[0], 0).sum(1), -MOST, MOST)

    def features(self, texts: list[bytes], own: np.ndarray | None = None) -> np.ndarray:
        return features(*self.evidence(texts, own), len(texts))


def features(e: np.ndarray, doc: np.ndarray, many: int) -> np.ndarray:
    """Of each of `many` texts, from the evidence of its words: the mean, the strongest, how many are strong, the length."""
    n = np.bincount(doc, minlength=many)
    out = np.zeros((many, 5))
    order = np.lexsort((-e, doc))
    rank = np.arange(len(e)) - np.concatenate([[0], np.cumsum(n)])[:-1][doc]
    strong = np.maximum(np.where(rank < STRONGEST, e[order], 0), 0)
    out[:, 0] = np.bincount(doc, e, many) / np.maximum(n, 1)
    out[:, 1] = np.bincount(doc, strong, many) / STRONGEST
    out[:, 2] = np.bincount(doc, e > STRONG, many) / np.sqrt(np.maximum(n, 1))
    out[:, 3] = np.log1p(n)
    out[:, 4] = np.log1p(np.bincount(doc, e > 2 * STRONG, many))
    return out


class Scorer:
    """Of each path, by sorted keys: what it adds to a word's evidence (gain) and what a word gets whose next piece
    never followed it (miss); root: the same for words that no path begins."""

    def __init__(self, keys: np.ndarray, gain: np.ndarray, miss: np.ndarray, root: float):
        self.keys, self.gain, self.miss, self.root = keys, gain, miss, root

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Evidence of words by the keys of their paths, a row each. A path is known only if those before it are."""
        e, last = np.zeros(len(keys)), np.full(len(keys), self.root)
        on = np.arange(len(keys))
        for j in range(keys.shape[1]):
            on = on[keys[on, j] != 0]
            at = np.minimum(np.searchsorted(self.keys, keys[on, j]), max(0, len(self.keys) - 1))
            known = self.keys[at] == keys[on, j] if len(self.keys) else np.zeros(len(on), bool)
            gone, on, at = on[~known], on[known], at[known]
            e[gone] += last[gone]
            e[on] += self.gain[at]
            last[on] = self.miss[at]
        return np.clip(e, -MOST, MOST)

    def evidence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, doc, first, where = _words(texts)
        return self.words(_paths(words, first)[0])[where], doc

    def features(self, texts: list[bytes]) -> np.ndarray:
        return features(*self.evidence(texts), len(texts))


class Logistic:
    """Of features to a score from 0 to 1: fitted by Newton's steps with a small penalty; without both classes the smoothed base rate."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.centre, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(5), np.ones(5))
        self.weights = np.zeros(6)
        self.weights[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -1.0
        if not 0 < y.sum() < len(y):
            return
        z = np.c_[np.ones(len(x)), (x - self.centre) / self.scale]
        penalty = np.array([0, *[0.3] * 5])

        def loss(w):
            return np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + (penalty * w * w).sum() / 2

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (y - p) - penalty * self.weights
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), slope)
            size = 1.0
            while size > 1e-6 and loss(self.weights + size * step) > loss(self.weights) - 1e-4 * size * (slope @ step):
                size /= 2
            self.weights = self.weights + size * step
            if np.abs(size * step).max() < 1e-7:
                break

    def column(self, *x):
        """The score as a Spark column of the five features."""
        z = F.lit(float(self.weights[0]))
        for v, c, s, w in zip(x, self.centre.tolist(), self.scale.tolist(), self.weights[1:].tolist(), strict=True):
            z = z + (v - F.lit(c)) / F.lit(s) * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.centre) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Far:
    """A model too large to broadcast: its table (key, gain, miss) and root."""

    def __init__(self, table: DataFrame, root: float):
        self.table, self.root = table, root


_COUNTED = "key long, parent long, piece long, ordinary long, toxic long"
_CLASSES = ("ordinary", "toxic")


class Counts:
    """Counts of all paths of texts (text binary, toxic 0 or 1). table: of each path its occurrences by class, the
    occurrences (n0, n1) and left-over mass (l0, l1) of the path before it, its own left-over mass (f0, f1) and the
    shared probability of its last piece. total, first: those of the empty path; taken: discounts by class."""

    def __init__(self, texts: DataFrame):
        start = common.mark()
        summed = texts.select("toxic", "text").mapInArrow(_counts, _COUNTED).groupBy("key")
        paths = common.save(summed.agg(*[F.first(c).alias(c) for c in ("parent", "piece")], *[F.sum(c).alias(c) for c in _CLASSES]), "paths")
        end = common.mark()
        often = [F.count_if(F.col(c) == i) for c in _CLASSES for i in (1, 2, 3, 4)]
        top = paths.agg(*[F.sum(F.when(F.col("parent") == 0, F.col(c))) for c in _CLASSES], F.count("*"), *often).first()
        self.many, self.total = top[2], [top[0] or 0, top[1] or 0]
        self.taken = taken = [discounts(top[3 + 4 * k : 7 + 4 * k]) for k in (0, 1)]
        # whole counts are added up, so that a sum does not depend on the order
        off = lambda c, k: sum((F.count_if(F.col(c) >= 3 if i == 3 else F.col(c) == i) * F.lit(float(taken[k][i])) for i in (1, 2, 3)), F.lit(0.0))
        kinds = sum(F.when(F.col(c) > 0, 1).otherwise(0) for c in _CLASSES)
        # a path's occurrences are those of the paths one piece longer
        follow = paths.groupBy("parent").agg(
            *[off(c, k).alias(f"l{k}") for k, c in enumerate(_CLASSES)], *[F.sum(c).alias(f"n{k}") for k, c in enumerate(_CLASSES)], F.sum(kinds).alias("all"), F.count("*").alias("children")
        )
        row = follow.filter("parent = 0").first()
        self.first = [row.l0, row.l1] if row else [0.0, 0.0]
        # a piece has at most two bytes, so there are fewer than 66,000: they may be broadcast
        shared = paths.groupBy("piece").agg(F.count("*").alias("before"))
        own = follow.select(F.col("parent").alias("key"), F.col("l0").alias("f0"), F.col("l1").alias("f1"))
        table = paths.join(F.broadcast(shared), "piece").join(own, "key", "left").join(follow, "parent")
        lower = (kinds - LOWER + LOWER * F.col("children") * F.col("before") / max(1, self.many)) / F.col("all")
        rest = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("f0", "f1")]
        self.table = common.save(table.select("key", *_CLASSES, "n0", "n1", "l0", "l1", *rest, F.greatest(lower, F.lit(1e-9)).alias("shared")), "model")
        common.clear(start, end)

    def scoring(self) -> tuple[DataFrame, float]:
        """(key, gain, miss) of each path, and root, as Scorer has them."""
        logs, left = [], []
        for k, c in enumerate(_CLASSES):
            taken = [F.lit(float(t)) for t in self.taken[k]]
            least = F.lit(float(self.taken[k][1:].min()))
            count, before = F.col(c), F.col(f"n{k}")
            off = F.when(count >= 3, taken[3]).when(count == 2, taken[2]).when(count == 1, taken[1]).otherwise(taken[0])
            n = F.greatest(before, F.lit(1))
            p = F.greatest(count - off, F.lit(0.0)) / n + F.least(F.lit(1.0), F.greatest(F.col(f"l{k}"), least) / n) * F.col("shared")
            logs.append(F.log(F.when(before > 0, p).otherwise(F.col("shared"))))
            left.append(F.when(count > 0, F.log(F.least(F.lit(1.0), F.greatest(F.col(f"f{k}"), least) / count))).otherwise(F.lit(0.0)))
        rows = self.table.select("key", (logs[1] - logs[0]).cast("float").alias("gain"), (left[1] - left[0]).cast("float").alias("miss"))
        root = [np.log(min(1, max(self.first[k], self.taken[k][1:].min()) / n)) if (n := self.total[k]) else 0.0 for k in (0, 1)]
        return rows, float(root[1] - root[0])

    def model(self, texts: DataFrame | None = None) -> Model:
        """The model of all paths, or of those in `texts`, on the driver."""
        table = self.table
        if texts is not None:
            table = table.join(texts.select("toxic", "text").mapInArrow(_counts, _COUNTED).select("key").distinct(), "key", "left_semi")
        found = table.select("key", *_CLASSES, "f0", "f1", "shared").toArrow()
        order = np.argsort(found.column("key").to_numpy())
        keys, ordinary, toxic, f0, f1, shared = (c.to_numpy()[order] for c in found.columns)
        return Model(keys, [ordinary, toxic], [f0, f1], shared, self.total, self.first, self.taken)


def train(texts: DataFrame):
    """A Scorer, broadcast, or Far, and a logistic function of texts (text binary, toxic 0 or 1, pick below _PICKS)."""
    spark = texts.sparkSession
    counts = Counts(texts)
    n = texts.count()
    some = texts.select("toxic", "text", "pick")
    some = some.filter(F.col("pick") < int(FIT / n * _PICKS)) if n > FIT else some
    fitted = spark.sparkContext.broadcast(counts.model(some))
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def own_features(batches):
        for rows in chunks(batch_rows(batches, "toxic", "text"), 1 << 20):
            y = np.array([r[0] for r in rows], np.int64)
            yield pa.RecordBatch.from_pydict({"toxic": y, "x": list(fitted.value.features([t for _, t in rows], y))}, schema)

    fit = some.mapInArrow(own_features, "toxic int, x array<double>").toArrow()
    fitted.destroy()
    x = np.array(fit.column("x").to_pylist()).reshape(-1, 5)
    logistic = Logistic(x, fit.column("toxic").to_numpy().astype(np.float64))
    table, root = counts.scoring()
    if counts.many > BROADCAST_PATHS:
        return Far(table, root), logistic
    found = table.toArrow()
    order = np.argsort(found.column("key").to_numpy())
    return spark.sparkContext.broadcast(Scorer(*(c.to_numpy()[order] for c in found.columns), root)), logistic


_OCCURS = pa.schema([("chunk", pa.string()), ("words", pa.list_(pa.int64())), ("fresh", pa.list_(pa.list_(pa.int64()))), ("ids", pa.list_(pa.int64())), ("doc", pa.binary()), ("place", pa.binary())])
_OCCURS_SQL = "chunk string, words array<long>, fresh array<array<long>>, ids array<long>, doc binary, place binary"


def _occurrences(batches):
    """Chunks of texts: their distinct words, which word each text has, and the words that this task did not have
    before (at least not since it forgot them), with the keys of their paths."""
    had = np.zeros(0, np.int64)
    for rows in chunks(batch_rows(batches, "id", "text")):
        words, doc, first, where = _words([t for _, t in rows])
        if not len(first):
            continue
        hashes = words.hash[first].view(np.int64)
        fresh = ~np.isin(hashes, had)
        had = np.union1d(had, hashes) if len(had) < GATHERED else hashes
        keys = np.c_[hashes[fresh], _paths(words, first[fresh])[0]]
        out = (uuid.uuid4().hex, hashes, list(keys), [i for i, _ in rows], pack(doc.astype(np.int32)), pack(where.astype(np.int32)))
        yield pa.RecordBatch.from_pydict(dict(zip(_OCCURS.names, ([x] for x in out), strict=True)), _OCCURS)


def _of_chunks(batches):
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])
    for batch in batches:
        for r in batch.to_pylist():
            e = np.zeros(len(r["found"]))
            for f in r["found"]:
                e[f["pos"]] = f["e"]
            x = features(e[unpack(r["place"], np.int32)], unpack(r["doc"], np.int32), len(r["ids"]))
            yield pa.RecordBatch.from_pydict({"id": r["ids"], "x": list(x)}, schema)


def _far(texts: DataFrame, model: Far) -> DataFrame:
    """(id, x): features of distinct texts (id long, text binary), by joins with the model.

    A word goes over the network once a chunk of texts, not once a text; words with many chunks are split by the skew join.
    """
    occurs = common.save(texts.mapInArrow(_occurrences, _OCCURS_SQL), "occurrences")
    path = occurs.select(F.explode("fresh").alias("k")).select(F.col("k")[0].alias("word"), F.slice("k", 2, LEVELS + 2).alias("keys")).dropDuplicates(["word"])
    path = path.select("word", F.posexplode("keys").alias("level", "key")).filter("key != 0").join(model.table, "key", "left")
    last = F.max(F.when(F.col("gain").isNotNull(), F.struct("level", "miss")))
    e = F.sum(F.coalesce(F.col("gain").cast("double"), F.lit(0.0))) + F.when(F.count("gain") == F.count("*"), 0.0).otherwise(F.coalesce(last["miss"].cast("double"), F.lit(model.root)))
    known = path.groupBy("word").agg(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), e)).alias("e"))
    each = occurs.select("chunk", F.posexplode("words").alias("pos", "word")).join(known, "word")
    found = each.groupBy("chunk").agg(F.collect_list(F.struct("pos", "e")).alias("found"))  # a chunk's words are bounded
    return occurs.select("chunk", "ids", "doc", "place").join(found, "chunk").select("ids", "doc", "place", "found").mapInArrow(_of_chunks, "id long, x array<double>")


def held_out(doc_id):
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of labelled docs outside the held-out fold, written out. Of several labels of a doc the largest counts; null labels don't."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = known.limit(common.BROADCAST_IDS + 1).count() <= common.BROADCAST_IDS
    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return common.save(read.join(F.broadcast(known) if few else known, "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(_PICKS)).alias("pick")), "training")


def score(docs: DataFrame, model, logistic: Logistic, *keep: str) -> DataFrame:
    """The columns `keep` of docs and score, from 0 to 1, of the whole text; null and empty texts get that of no words.

    A column `score` among `keep` is given up for the new one.
    """
    keep = [c for c in keep if c != "score"]
    if isinstance(model, Far):
        # equal texts have equal scores: rows meet theirs by a 64-bit hash of the text
        text, known = F.col("text").cast("binary"), uuid.uuid4().hex
        unique = docs.filter("text is not null").select(F.xxhash64(text).alias("id"), text.alias("text")).groupBy("id").agg(F.min("text").alias("text"))
        found = _far(unique, model).select(F.col("id").alias(known), logistic.column(*[F.col("x")[i] for i in range(5)]).alias("score"))
        none = F.lit(float(logistic.score(np.zeros((1, 5)))[0]))
        return docs.join(found, F.xxhash64(text) == F.col(known), "left").select(*[docs[c] for c in keep], F.coalesce(found["score"], none).alias("score"))

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [[t or b"" for t in column.slice(i, SLICE).to_pylist()] for i in range(0, len(column), SLICE)]
            yield pa.array(np.concatenate([logistic.score(model.value.features(p)) for p in parts]) if parts else [], pa.float64())

    return docs.select(*keep, scores(F.col("text").cast("binary")).alias("score"))


def judged(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """score() by a model of the labelled docs, and predicted: 1 from THRESHOLD on. Columns of these names in docs are given up.

    Repeated rows each get their score; without labels, or labels of one class only, all get the smoothed base rate.
    """
    return score(docs, *train(training_texts(docs, labels)), *keep).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is not predicted to be toxic, with all their columns."""
    names = {c: f"{c}_{uuid.uuid4().hex}" for c in docs.columns if c in ("score", "predicted")}
    found = judged(docs.withColumnsRenamed(names), labels, *[names.get(c, c) for c in docs.columns])
    return found.filter("predicted = 0").drop("score", "predicted").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones too; a null or empty text scores as no words, a null id is never held out."""
    found = judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
