"""Secret scans with SQL functions only.

Base spans are the matches of fixed patterns. Entropy spans are stretches of candidate strings whose sliding
windows of WINDOW characters reach the Shannon entropy of their character class; a step to the next
window changes the counts of one leaving and one entering character only, so a candidate costs time in proportion to
its length. Candidates that match the allow-list
are passed over, as are stretches that overlap a base span (the last one of each kind that begins before a stretch ends
is looked at, so many of both cost little more than few). Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Patterns by kind, in the order in which kinds are listed; which group's length counts, and the least.
PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
KINDS = [*(k for k, *_ in PATTERNS), "entropy"]
#: The same spans as the kind's pattern has after its least length, where that can be told beforehand: runs are maximal.
_LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
WINDOW = 20
#: The characters of candidates. A window's counts are a string whose nth character's code tells how often the nth of these occurs.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Units of c * log2(c) in which sums are kept: whole numbers, so that no step loses anything.
_UNITS = 1 << 40
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes in order of trial: what a candidate of the class looks like, and the least entropy in bits a character.
CLASSES = [
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.7),
    ("plain", r"^(?=.*[0-9])(?=.*[A-Za-z]).+$", 3.6),
]
#: Candidates that are no secrets: UUIDs, placeholders, repeated characters, dates and paths of words.
ALLOWED = [
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]",
    r"(.)\1{5}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^(?!.*[/_=-]{2})[a-z][a-z/_=-]*[0-9]{1,4}$",
]
_BLOCK = 256
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def matches(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Spans of leftmost non-overlapping matches: lengths of matches and of what is between them, added up.

    Sums run within blocks and then over blocks, as each step copies the list so far.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("size"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"))

    def add(state, part):
        start = state["at"] + part["gap"]
        end = start + F.coalesce(part["size"], F.lit(0))
        return F.struct(end.alias("at"), F.when(part["size"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))))).alias("out"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))
    named = F.transform(parts, lambda p: F.struct(p["gap"].cast("bigint").alias("gap"), p["size"].cast("bigint").alias("size"), p["value"].alias("value")))

    def joined(named):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(named) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(named, b * _BLOCK + 1, F.lit(_BLOCK)), empty, add))
        moved = F.aggregate(
            blocks,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
            lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(F.transform(b["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + s["at"]).alias("end"), x["value"].alias("value"))))).alias("out")),
        )
        return F.flatten(moved["out"])

    return F.when(text.rlike(pattern), _once(named, joined)).otherwise(F.array().cast(_SPAN))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once, though the lambdas in `then` name it again and again."""
    return F.transform(F.array(value), then)[0]


def _longer(least: int):
    return lambda s: F.length(s["value"]) >= least


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> list[Column]:
    """Spans by kind; a match with too short a value is dropped and not tried again."""
    out = []
    for i, (kind, pattern, group, least) in enumerate(PATTERNS):
        found = matches(text, _LONG.get(kind, pattern), i, group)
        out.append(F.filter(found, _longer(least)))
    return out


def _stretches(span: Column) -> Column:
    """The stretches of a candidate that windows which reach its class's entropy cover; those up to a window apart are one."""
    text = span["value"]
    # entropy = log2(WINDOW) - sum(c * log2(c)) / WINDOW: at most so much of the sum is let through, none for -1
    limit = lambda bits: F.lit(math.floor((math.log2(WINDOW) - bits) * WINDOW * _UNITS))
    most = F.lit(-1)
    for _, pattern, bits in reversed(CLASSES):
        most = F.when(text.rlike(pattern), limit(bits)).otherwise(most)
    for pattern in ALLOWED:
        most = F.when(text.rlike(pattern), F.lit(-1)).otherwise(most)
    weights = F.array(*[F.lit(round(c * math.log2(c) * _UNITS) if c else 0) for c in range(WINDOW + 1)])
    weight = lambda count: F.element_at(weights, count + 1)
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1)))
    with_count = lambda counts, place, n: F.overlay(counts, F.char(n), place, F.lit(1))

    def fold(bound):
        places, most = bound["places"], bound["most"]

        def leave(state, i):
            place = F.element_at(places, i - WINDOW)
            n = count(state["counts"], place)
            less = F.struct(with_count(state["counts"], place, n - 1).alias("counts"), (state["total"] - weight(n) + weight(n - 1)).alias("total"))
            return F.when(i > WINDOW, less).otherwise(F.struct(state["counts"], state["total"]))

        def enter(state, left, i):
            place = F.element_at(places, i)
            n = count(left["counts"], place)
            total = left["total"] + weight(n + 1) - weight(n)
            hit = (i >= WINDOW) & (total <= most)
            apart = hit & (state["high"] > 0) & (i - WINDOW > state["high"] + WINDOW)
            done = F.when(apart, F.concat(state["done"], F.array(F.struct(state["low"].alias("low"), state["high"].alias("high"))))).otherwise(state["done"])
            low = F.when(hit & ((state["high"] == 0) | apart), i - WINDOW).otherwise(state["low"])
            return F.struct(with_count(left["counts"], place, n + 1).alias("counts"), total.alias("total"), low.alias("low"), F.when(hit, i).otherwise(state["high"]).alias("high"), done.alias("done"))

        start = F.struct(F.lit("\0" * len(ALPHABET)).alias("counts"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.array().cast("array<struct<low:int,high:int>>").alias("done"))
        steps = F.when(most >= 0, F.sequence(F.lit(1), F.size(places))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, lambda state, i: _once(leave(state, i), lambda left: enter(state, left, i)))

    places = F.when(most >= 0, F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))).otherwise(F.array().cast("array<int>"))
    bound = F.struct(F.filter(places, lambda x: x > 0).alias("places"), most.alias("most"))
    last = lambda s: F.filter(F.array(F.struct(s["low"].alias("low"), s["high"].alias("high"))), lambda r: r["high"] > 0)
    runs = _once(_once(bound, fold), lambda s: F.concat(s["done"], last(s)))
    return F.transform(runs, lambda r: F.struct((span["start"] + r["low"]).alias("start"), F.lit(len(PATTERNS)).alias("kind"), (span["start"] + r["high"]).cast("bigint").alias("end"), F.lit(None).cast("string").alias("value")))


def _overlaps(spans: str, s: Column) -> Column:
    """Whether one of spans, sorted and apart from each other, overlaps s: the last one that begins before s ends, found by halving."""
    before = lambda n: F.coalesce(F.get(F.col(spans), n - 1)["start"] < s["end"], F.lit(False))
    halves = F.transform(F.sequence(F.floor(F.log2(F.size(spans).cast("double"))).cast("int"), F.lit(0), F.lit(-1)), lambda bit: F.pow(F.lit(2.0), bit).cast("int"))
    n = F.aggregate(halves, F.lit(0), lambda n, step: F.when(before(n + step), n + step).otherwise(n))
    return F.when(F.size(spans) == 0, False).otherwise(F.coalesce(F.get(F.col(spans), n - 1)["end"] > s["start"], F.lit(False)))


def _clear_of(spans: str):
    return lambda s: ~_overlaps(spans, s)


def _scanned(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str, str]:
    """docs with three more columns, and their names: the text (null read as empty), its base spans, all its spans."""
    text, base, every, candidates, *kinds = (common.fresh(n) for n in ("text", "base", "spans", "candidates", *KINDS))
    t = F.col(text)
    found = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    mixed = F.filter(matches(t, CANDIDATE, len(PATTERNS)), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    found = found.withColumns(dict(zip(kinds, base_spans(t), strict=False)) | {candidates: mixed})
    found = found.withColumn(base, F.array_sort(F.concat(*kinds[: len(PATTERNS)])))
    alone = F.flatten(F.transform(candidates, _stretches))
    for kind in kinds[: len(PATTERNS)]:
        alone = F.filter(alone, _clear_of(kind))
    return found.withColumn(every, F.array_sort(F.concat(base, alone))).drop(candidates, *kinds), text, base, every


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns base_spans and spans, in place of any of that name: sorted (start, kind, end, value).

    kind is a number in KINDS. Overlapping base spans of different kinds all stay. Null and empty texts have none;
    repeated rows each have theirs.
    """
    found, text, base, every = _scanned(docs, text_col)
    return found.drop(text).withColumns({"base_spans": F.col(base), "spans": F.col(every)}).drop(base, every)


def _text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each found stretch of text replaced by mark; other rows, null texts too, stay as they are."""
    found, text, _, every = _scanned(docs, text_col)

    def cut(state, s):
        fresh = F.when(s["start"] >= state["at"], F.concat(state["out"], F.col(text).substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), fresh.alias("out"))

    def whole(state):
        return F.concat(state["out"], F.col(text).substr((state["at"] + 1).cast("int"), F.length(text)))

    state = F.aggregate(every, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), cut)
    return found.withColumn(text_col, F.when(F.size(every) > 0, _once(state, whole)).otherwise(F.col(text_col))).select(*docs.columns)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones too; null and empty texts have no spans."""
    found, _, base, every = _scanned(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    counts = [F.size(F.filter(base, _of_kind(i))).cast("long").alias(f"n_{k}") for i, (k, *_) in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(every).alias("spans"))
