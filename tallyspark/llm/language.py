"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A text's subwords are the runs of 1 to LONGEST characters of its words, lower-cased, with a mark for either end of a
word; words are runs of letters and combining marks. Each falls by its hash into one of BUCKETS buckets, which have
embeddings. The mean of a text's embeddings goes through a linear layer and a softmax over the languages.

Embeddings and layer are trained by stochastic gradient descent in numpy, each step on a few subwords drawn from each
of BATCH texts, so that short texts are learned as well as long ones. Learned from are at most about SAMPLE labelled
rows, SAMPLE / languages of each (by a hash of the id, so that the same rows are taken in any partitioning), each with
its whole text as counts of buckets: this bounds what reaches the driver. One in FOLDS of them is kept back: on these,
whole and in part, two numbers are fitted that turn a text's scores into a probability, by how many subwords it has. Then
the least accepted probability is set: the highest that RISK of those identified rightly stay below, so that what resembles
none of the languages is rejected, or a higher one if more than RISK of what is accepted would be wrong.

For scoring, embeddings and layer are one table of integers, a number for each bucket and language. Sums of integers do
not depend on order, so a text has the same score in any batch or block.

Defined cases: a null text, or one without letters, is `und` with score 0. A null id is never held out; rows of one id
count once in the sample. Rows without a language, a text or a letter teach nothing; without any that do, all is `und`. Beyond LANGUAGES
languages only the commonest are learned.
Repeated rows each get a row; an empty table gives an empty one. Long texts are read in blocks that end behind a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, words

UNKNOWN = "und"
BUCKETS, LONGEST, DIM = 1 << 16, 4, 16
SAMPLE, FOLDS, RISK = 6000, 5, 0.01
#: Languages that are learned at most, the commonest ones: the table for scoring has a column for each.
LANGUAGES = 256
EPOCHS, BATCH, RATE = 8, 16, 0.3
#: Subwords drawn from a text in a step, by turns; and of a text kept back, besides all.
DRAWN = (8, 32, 128)
#: Characters read at once; texts taken from Arrow at once.
BLOCK, SLICE = 1 << 18, 128
#: Fractional bits of the table of integers.
BITS = 20
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a combining mark, else 0."""
    if not _kinds:
        _kinds.append(np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8))
    return _kinds[0]


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased texts in blocks of about BLOCK characters: which texts a block has parts of, code points (0 outside words, and at either end), ends of the parts."""
    parts, which, size = [], [], 0

    def out():
        joined = " " + " ".join(parts) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = 1 + np.cumsum([len(p) + 1 for p in parts])
        return np.array(which), np.where(kinds()[codes] > 0, codes, 0), ends

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            while end < len(text) and kinds()[ord(text[end])]:
                end += 1
            part = text[at:end].lower()
            at = end
            parts.append(part)
            which.append(i)
            size += len(part)
            if size >= BLOCK:
                yield out()
                parts, which, size = [], [], 0
    if parts:
        yield out()


def subwords(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where subwords of each length begin, and their buckets."""
    inside = codes > 0
    h = np.zeros(len(codes), np.uint64)
    whole = np.ones(len(codes), bool)  # no mark but at either end
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        if n == 1:
            ok = inside
        elif n == 2:
            ok = inside[:m] | inside[1:]
        else:
            whole = whole[:m] & inside[n - 2 : n - 2 + m]
            ok = whole
        at = np.flatnonzero(ok)
        yield at, (words.mix(h[at]) >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for _, codes, _ in blocks([text]):
        for _, bucket in subwords(codes):
            total += np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets by languages, integers of BITS fractional bits
    bias: np.ndarray
    stretch: tuple[float, float] = (1.0, 0.0)
    floor: float = 0.0

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: sums of the table over its subwords, how many there are, whether it has a letter."""
        sums, n, letter = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for which, codes, ends in blocks(texts):
            starts = np.concatenate([[0], ends[:-1]])
            letters = np.concatenate([[0], np.cumsum(kinds()[codes] == 2)])
            np.logical_or.at(letter, which, letters[np.minimum(ends, len(codes))] > letters[starts])
            for at, bucket in subwords(codes):
                # a subword belongs to the text it begins in; one that begins with a mark, to the text behind the mark
                cut = np.searchsorted(at, np.concatenate([[0], ends - 1]))
                np.add.at(n, which, np.diff(cut))
                for k in range(len(self.languages)):
                    total = np.concatenate([[0], np.cumsum(self.table[bucket, k], dtype=np.int64)])
                    np.add.at(sums[:, k], which, total[cut[1:]] - total[cut[:-1]])
        return sums, n, letter

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        return calibrated(sums / np.maximum(n, 1)[:, None] / 2.0**BITS + self.bias, n, self.stretch)

    def identify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its probability."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums, n, letter = self.sums(texts)
        p = self.probabilities(sums, n)
        best = p.argmax(1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], np.where(letter, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrated(z: np.ndarray, n: np.ndarray, stretch: tuple[float, float]) -> np.ndarray:
    """Probabilities of scores of means over n subwords: more subwords make a difference surer."""
    return softmax(z * (stretch[0] * np.maximum(n, 1.0) ** stretch[1])[:, None])


def trained(texts: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, languages: list[str], seed: int = 11) -> Model:
    """Stochastic gradient descent over texts as (buckets, counts)."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    e, w, b = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    ends = [np.cumsum(c) for _, c in texts]
    steps, done = EPOCHS * -(-len(texts) // BATCH), 0
    squares = [np.full((*x.shape[:1], 1), 1e-12) for x in (e, w, b[:, None])]

    def step(x, g, q, at=slice(None)):  # by the squares of each row's gradients so far, as buckets are met unequally often
        q[at] += (g * g).mean(1, keepdims=True)
        x[at] -= RATE * (1 - done / steps) * g / np.sqrt(q[at])

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            m = DRAWN[done % len(DRAWN)]
            drawn = np.stack([texts[i][0][np.searchsorted(ends[i], rng.integers(0, ends[i][-1], m), side="right")] for i in some])
            mean = e[drawn].mean(1)
            off = softmax(mean @ w + b)
            off[np.arange(len(some)), truth[some]] -= 1
            met, place = np.unique(drawn.ravel(), return_inverse=True)
            back = np.zeros((len(met), DIM))
            np.add.at(back, place, np.repeat(off @ w.T / (m * len(some)), m, 0))
            step(w, mean.T @ off / len(some), squares[1])
            step(b[:, None], off.mean(0)[:, None], squares[2])
            step(e, back, squares[0], met)
            done += 1
    return Model(languages, np.rint(e @ w * 2.0**BITS).astype(np.int32), b)


def calibrate(model: Model, texts: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, seed: int = 12) -> Model:
    """Fit the model's stretch, by likelihood, and its floor, by what is wrong above it, on texts it hasn't seen."""
    if not texts:
        return model
    rng = np.random.default_rng(seed)
    mean = lambda buckets, counts: (model.table[buckets] * counts[:, None]).sum(0) / counts.sum() / 2.0**BITS + model.bias
    z, n, y, whole = [], [], [], []
    for (buckets, counts), t in zip(texts, truth, strict=True):
        ends = np.cumsum(counts)
        for m in (*DRAWN, int(ends[-1])):
            if m >= ends[-1]:
                z.append(mean(buckets, counts))
            else:
                z.append(mean(buckets[np.searchsorted(ends, rng.integers(0, ends[-1], m), side="right")], np.ones(m, np.int64)))
            n.append(min(m, ends[-1]))
            y.append(t)
            whole.append(m == ends[-1])
    z, n, y, whole = np.array(z), np.array(n), np.array(y), np.array(whole)
    loss = lambda s: -np.log(np.maximum(calibrated(z, n, s)[np.arange(len(y)), y], 1e-12)).mean()
    model.stretch = min(((float(a), float(c)) for c in np.linspace(0, 0.5, 6) for a in 2.0 ** np.linspace(-5, 5, 41)), key=loss)
    p = calibrated(z, n, model.stretch)[whole]
    top, wrong = p.max(1), p.argmax(1) != y[whole]
    order = np.argsort(-top, kind="stable")
    risk = (np.cumsum(wrong[order]) + 1) / (np.arange(len(order)) + 2)
    fine = np.flatnonzero(risk <= RISK)
    if not len(fine):  # too few to tell: as sure as the surest
        model.floor = float(top.max())
    else:
        model.floor = max(float(top[order[fine[-1]]]) if fine[-1] < len(order) - 1 else 0.0, float(np.quantile(top[~wrong], RISK, method="lower")))
    return model


def _counts(batches):
    for key, lang, text in ((k, n, t.decode("utf-8", "replace")) for k, n, t in words.batch_rows(batches, "key", "lang", "text")):
        buckets, counts = counted(text)
        if len(buckets):
            yield pa.RecordBatch.from_pylist([{"key": key, "lang": lang, "buckets": buckets.astype(np.uint32).tobytes(), "counts": counts.astype(np.uint32).tobytes()}])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of labelled rows, from about SAMPLE of them at most."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)))
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(key.alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    many = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not many:
        return Model([], np.zeros((BUCKETS, 0), np.int32), np.zeros(0))
    share = {n: min(1.0, SAMPLE / len(many) / max(m, 1)) for n, m in many.items()}
    limit = F.create_map(*[F.lit(x) for n, s in share.items() for x in (n, int(s * 2**32))])[F.col("lang")]
    some = rows.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(2**32)) < limit).groupBy("key").agg(F.min(F.struct("lang", "text")).alias("row")).select("key", "row.*")
    found = sorted(some.mapInArrow(_counts, "key long, lang string, buckets binary, counts binary").toLocalIterator(), key=lambda r: r.key)
    if not found:
        return Model([], np.zeros((BUCKETS, 0), np.int32), np.zeros(0))
    languages = sorted({r.lang for r in found})
    texts = [(np.frombuffer(r.buckets, np.uint32).astype(np.int64), np.frombuffer(r.counts, np.uint32).astype(np.int64)) for r in found]
    truth = np.array([languages.index(r.lang) for r in found])
    late = np.arange(len(found)) % FOLDS == FOLDS - 1
    some = lambda which: ([texts[i] for i in np.flatnonzero(which)], truth[which])
    return calibrate(trained(*some(~late), languages), *some(late))


def identify(docs: DataFrame, model: Model, text_col: str = "text", reject: bool = True) -> DataFrame:
    """docs with lang_pred, score and accepted (whether score reaches the model's floor); columns of these names are given up.

    reject: what isn't accepted is `und`, and keeps its score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words.release()
        for column in texts:
            langs, scores = [], []
            for i in range(0, len(column), SLICE):
                best, p = sent.value.identify([(t or b"").decode("utf-8", "replace") for t in column.slice(i, SLICE).to_pylist()])
                langs += best
                scores.append(p)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    name, kept = common.fresh("found"), [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    out = docs.select(*kept, found(F.col(text_col).cast("binary")).alias(name))
    lang, score = F.col(f"{name}.lang"), F.col(f"{name}.score")
    sure = (lang != UNKNOWN) & (score >= model.floor)
    return out.select(*kept, (F.when(sure, lang).otherwise(UNKNOWN) if reject else lang).alias("lang_pred"), score.alias("score"), sure.alias("accepted"))


def held_out(doc_id: Column) -> Column:
    """The fold whose languages are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for each whole text, however unsure; accepted says whether it is sure enough."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model, reject=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
