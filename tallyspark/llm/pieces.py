"""SentencePiece encoding and decoding with a shared-prefix forward pass.

Texts are split into marked words (a space becomes the mark before the next word). The distinct words of a
chunk are sorted, so that neighbours share prefixes: this walks their trie depth-first. The forward state of a
prefix is the last piece of its encoding and where that piece starts; it depends on the prefix alone, so a
word only computes states beyond the prefix that it shares with the word before it.

The vocabulary's scores are merge ranks: a piece follows another in an encoding exactly if merging the two
pieces' characters by rank gives these two pieces again. A state is therefore decided by this test of
neighbours instead of by sums of scores, whose maximum would be another segmentation than the
tokenizer's. Words of several marks, whose pieces tie in rank, are merged directly. Viterbi has forward sums and
their maximum, for vocabularies with log-probabilities.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallyspark.llm import common
from tallyspark.llm.words import batch_rows, chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose encodings, and pairs of pieces whose test, a worker remembers; they are forgotten all at once.
WORDS, PAIRS = 160_000, 400_000
#: Rows of a task that are handled at once.
SLICE = 256
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


def load(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, is text) of each id, read on the driver."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
    return [(model.id_to_piece(i), model.get_score(i), plain(i)) for i in range(model.get_piece_size())]


def _code(i: int) -> bytes:
    return i.to_bytes(4, "little")


class Encoder:
    """The vocabulary, and what a worker remembers. Pieces must have marks only at their beginning, and bytes be pieces."""

    def __init__(self, vocabulary: list[tuple[str, float, bool]]):
        self.vocabulary = vocabulary
        self.prepare()

    def __getstate__(self):
        return self.vocabulary

    def __setstate__(self, state):
        self.vocabulary = state
        self.prepare()

    def prepare(self) -> None:
        self.ids = {p: i for i, (p, _, text) in enumerate(self.vocabulary) if text}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece has a mark inside: words can't be encoded one by one")
        self.coded = {p: _code(i) for p, i in self.ids.items()}
        self.scores = {p: self.vocabulary[i][1] for p, i in self.ids.items()}
        index = {p: i for i, (p, _, _) in enumerate(self.vocabulary)}
        self.byte_ids = [index.get(f"<0x{b:02X}>", 0) for b in range(256)]
        self.raw = [p.encode() if text else b"" for p, _, text in self.vocabulary]
        for b, i in enumerate(self.byte_ids):
            if i:
                self.raw[i] = bytes([b])
        self.backward: dict = {}
        for p in self.ids:
            node = self.backward
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging neighbours, best score first, ties from the left."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list = []

        def push(i):
            j = after[i]
            if j < len(parts) and (s := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            push(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p]

    def _fit(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def packed(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.coded.__getitem__, pieces))
        except KeyError:  # a character outside the vocabulary becomes its bytes
            return b"".join(self.coded.get(p) or b"".join(_code(self.byte_ids[b]) for b in p.encode()) for p in pieces)

    def learn(self, words: set[str]) -> None:
        """Encode marked words depth-first along their common prefixes."""
        last: list[tuple[str, int]] = [("", 0)]  # of each prefix of the word before: its last piece and its start
        previous, backward, fits, fit, known = "", self.backward, self.fits, self._fit, self.known
        for word in sorted(words):
            if word[:2] == MARK * 2:
                self.known[word] = self.packed(self.merged(word))
                continue
            n = min(len(word), len(previous))
            same = 0
            while same < n and word[same] == previous[same]:
                same += 1
            del last[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                node, j, choices = backward, i, []
                while j:
                    j -= 1
                    node = node.get(word[j])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None:
                        choices.append((piece, j))
                for piece, j in reversed(choices):
                    left = last[j][0]
                    found = fits.get((left, piece))
                    if found or (found is None and fit(left, piece)):
                        last.append((piece, j))
                        break
                else:
                    last.append((word[i - 1], i - 1))
            previous = word
            pieces, i = [], len(word)
            while i:
                piece, i = last[i]
                pieces.append(piece)
            pieces.reverse()
            known[word] = self.packed(pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as int32; an empty text has none."""
        if len(self.known) > WORDS:
            self.known.clear()
        units = []
        for t in texts:
            if not t:
                units.append([])
            elif MARK in t or "  " in t or t[0] == " " or t[-1] == " ":
                units.append(_UNITS.findall(MARK + t.replace(" ", MARK)))
            else:
                units.append((MARK + t.replace(" ", " " + MARK)).split(" "))
        known = self.known
        self.learn({w for u in units for w in u if w not in known})
        return [b"".join(map(known.__getitem__, u)) for u in units]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


#: What a character outside the vocabulary costs more than the worst piece.
UNKNOWN = 10.0


class Viterbi(Encoder):
    """For vocabularies whose scores are log-probabilities: of all segmentations of a word the one with the largest sum.

    The forward state of a prefix is its largest sum and where the last piece of it starts; words that are neighbours in
    sorted order share the states of their common prefix. Of equal sums the one with the longer last piece counts.
    """

    def prepare(self) -> None:
        super().prepare()
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN

    def learn(self, words: set[str]) -> None:
        forward: list[tuple[float, int]] = [(0.0, 0)]
        previous, backward, scores = "", self.backward, self.scores
        for word in sorted(words):
            n = min(len(word), len(previous))
            same = 0
            while same < n and word[same] == previous[same]:
                same += 1
            del forward[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                best, start = forward[i - 1][0] + self.unknown, i - 1
                node, j = backward, i
                while j:
                    j -= 1
                    node = node.get(word[j])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None and forward[j][0] + scores[piece] >= best:
                        best, start = forward[j][0] + scores[piece], j
                forward.append((best, start))
            previous = word
            pieces, i = [], len(word)
            while i:
                start = forward[i][1]
                pieces.append(word[start:i])
                i = start
            pieces.reverse()
            self.known[word] = self.packed(pieces)


def encode(docs: DataFrame, vocabulary=None, text_col: str = "text", viterbi: bool = False) -> DataFrame:
    """docs with the column ids (array of int, in place of one of that name): the tokenizer's ids of each whole text.

    Null and empty texts have an empty array. Characters outside the vocabulary become bytes. viterbi: the scores are
    log-probabilities, not merge ranks.
    """
    sent = docs.sparkSession.sparkContext.broadcast((Viterbi if viterbi else Encoder)(vocabulary or load()))
    docs = docs.drop("ids")
    names = docs.columns

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                texts = [t or "" for t in batch.column(names.index(text_col)).to_pylist()]
                ids = [np.frombuffer(x, np.int32) for x in sent.value.encode(texts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(ids: DataFrame, vocabulary=None, ids_col: str = "ids") -> DataFrame:
    """ids with the column decoded, in place of any of that name: the text of the ids; null for null."""
    sent = ids.sparkSession.sparkContext.broadcast(Encoder(vocabulary or load()))
    kept = ids.drop(*[c for c in ids.columns if c == "decoded" and c != ids_col])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts = [None if x is None else sent.value.decode(np.array(x, np.int64)) for x in column.to_pylist()]
            names = [c for c in batch.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return kept.mapInArrow(run, StructType([*[f for f in kept.schema.fields if f.name != "decoded"], StructField("decoded", StringType())]))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])


def digests(docs: DataFrame, vocabulary=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_tokens, ids_sha256 (of little-endian int32 ids) and whether decoding gives the text back.

    A text with the mark itself comes back with a space in its place, as the tokenizer defines; that counts as a round trip.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary or load()))

    def run(batches):
        for rows in chunks(batch_rows(batches, "id", "text"), 1 << 20):
            texts = [t.decode("utf-8", "replace") for _, t in rows]
            ids = sent.value.encode(texts)
            back = [sent.value.decode(np.frombuffer(x, np.int32)) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "round_trip": back}, _DIGEST)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones too; null and empty texts have no tokens."""
    return digests(common.table(spark, sf_dir, "documents"))
