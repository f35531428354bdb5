"""PII: information-theoretic sanitisation.

Protected entities are found by fixed patterns. Terms (words) near them are counted, in all and with each
entity, and so are all occurrences of these terms in the whole corpus: a term's pointwise mutual information with being near any
entity, or near this one, over the information that such an entity's presence carries, tells how strongly the term reveals it. Of the two the larger counts.
A term near an entity whose disclosure reaches GENERALISE is replaced by a mark, from REMOVE on it is removed.

The corpus counts are added up in Spark. Up to TERMS distinct terms (8 bytes each) are broadcast so that a
task passes on only their counts; beyond that all words' counts are shuffled, with the same result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.words import NON_WORD, Words, batch_rows, chunks

#: Kinds in the order in which they are listed, and their patterns.
KINDS = ["email", "ip", "card", "phone", "term"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: In a text whose A-Z are lower case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_DIGITS = re.compile("[0-9]")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Words on either side of an entity that count as near; occurrences at the corpus's own rate that are added to a term's; thresholds of disclosure.
NEAR, PRIOR, GENERALISE, REMOVE = 6, 1.0, 0.9, 0.98
TERMS, GATHERED = 2_000_000, 1 << 20


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in double)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of protected entities in order, in code points; failing matches are dropped, not tried again."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 40:
                digits = "".join(_DIGITS.findall(m[0]))
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


_FOUND = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))), ("near", pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("entities", pa.list_(pa.int64()))]))), ("inside", pa.list_(pa.int64()))])
_FOUND_SQL = "id bigint, key bigint, base array<struct<kind:int,start:bigint,end:bigint>>, near array<struct<term:bigint,start:bigint,end:bigint,entities:array<bigint>>>, inside array<bigint>"


def entity(kind: int, text: str) -> int:
    """A hash of an entity, equal for its spellings: in either case, or with other marks or zeros among its digits."""
    form = text.translate(_LOWER) if kind == 0 else ".".join(p.lstrip("0") for p in text.split(".")) if kind == 1 else "".join(_DIGITS.findall(text))
    return int.from_bytes(hashlib.blake2b(f"{kind} {form}".encode(), digest_size=8).digest(), "big", signed=True)


def _near(text: str, base: list[tuple[int, int, int]]) -> tuple[list[dict], list[int]]:
    """Words within NEAR words of an entity, each once, without those inside one, and the entities they are near; and the terms inside entities."""
    names = [entity(kind, text[a:b]) for kind, a, b in base]
    text, beside = text.translate(_LOWER), {}
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = np.array([a for a, _ in words], np.int64), np.array([b for _, b in words], np.int64)
    near, inside = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
    for name, (_, a, b) in zip(names, base, strict=True):
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        near[max(0, i - NEAR)] += 1
        near[min(len(words), j + NEAR)] -= 1
        inside[i] += 1
        inside[j] -= 1
        for k in (*range(max(0, i - NEAR), i), *range(j, min(len(words), j + NEAR))):
            beside.setdefault(k, set()).add(name)
    within = np.cumsum(inside)[:-1] > 0
    chosen = np.flatnonzero((np.cumsum(near)[:-1] > 0) & ~within)
    terms, parts = (Words([" ".join(text[words[k][0] : words[k][1]] for k in ks).encode()], NON_WORD).hash.view(np.int64).tolist() for ks in (chosen, np.flatnonzero(within)))
    return [{"term": t, "start": words[k][0], "end": words[k][1], "entities": sorted(beside[k])} for t, k in zip(terms, chosen, strict=True)], parts


def _find(batches):
    for rows in chunks(batch_rows(batches, "id", "key", "text")):
        out = []
        for i, key, raw in rows:
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            near, inside = _near(text, base) if base else ([], [])
            out.append({"id": i, "key": key, "base": [{"kind": k, "start": a, "end": b} for k, a, b in base], "near": near, "inside": inside})
        yield pa.RecordBatch.from_pylist(out, _FOUND)


def _corpus(sent):
    """Occurrences of the sent terms, or of all words, added up within a task; term null: of all words together."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def added(parts):
        key, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return key, np.bincount(where, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)

    def run(batches):
        terms, parts, size, total = sent and sent.value, [], 0, 0
        for rows in chunks(batch_rows(batches, "text")):
            keys = Words([t.lower() for (t,) in rows], NON_WORD).hash.view(np.int64)
            total += len(keys)
            if terms is not None:
                at = np.minimum(np.searchsorted(terms, keys), max(0, len(terms) - 1))
                keys = keys[terms[at] == keys] if len(terms) else keys[:0]
            parts.append(np.unique(keys, return_counts=True))
            size += len(parts[-1][0])
            if size > GATHERED:
                parts = [added(parts)]
                size = len(parts[0][0])
            if size > GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], schema=schema)
                parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(parts)], schema=schema)
        yield pa.RecordBatch.from_pydict({"term": [None], "n": [total]}, schema)

    return run


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, key, base, near, inside) for each row: entities (kind, start, end), the terms near them and those inside them. key is a hash of the text; a null text is read as empty."""
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return common.save(read.mapInArrow(_find, _FOUND_SQL), "entities")


def disclosure(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, near, total, disclosure) of the terms near entities, over all of docs.

    disclosure is log(P(near | term) / P(near)) / -log P(near): 0 for a term that is independent of entities, near 1
    for one that never stands elsewhere. P(near | term) is smoothed by PRIOR occurrences, so that a rare term tells less.
    total leaves out words inside entities, as a name often is part of the address beside it.
    """
    return _disclosure(docs, found, text_col)[0]


def _strength(near: Column, total: Column, share: Column) -> Column:
    base = F.when((share > 0) & (share < 1), -F.log(share)).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log((near + PRIOR * share) / (total + PRIOR)) + base) / base))


def _disclosure(docs: DataFrame, found: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    near = found.select(F.explode("near.term").alias("term")).groupBy("term").agg(F.count("*").alias("near"))
    near = common.save(near, "near")
    sent = None
    if near.limit(TERMS + 1).count() <= TERMS:
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(near.select("term").toArrow().column(0).to_numpy()))
    counts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_corpus(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("total"))
    counts = common.save(counts, "terms")
    everything = counts.filter("term is null").first()
    share = (near.agg(F.sum("near")).first()[0] or 0) / max(1, everything.total if everything else 1)
    inside = found.select(F.explode("inside").alias("term")).groupBy("term").agg(F.count("*").alias("within"))
    terms = near.join(counts.filter("term is not null"), "term").join(inside, "term", "left").select("term", "near", (F.col("total") - F.coalesce("within", F.lit(0))).alias("total"))
    terms = terms.withColumn("disclosure", _strength(F.col("near"), F.col("total"), F.lit(float(share))))
    return terms, everything.total if everything else 0


def disclosure_by_entity(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, entity, disclosure) of the terms near each entity: as disclosure(), with P(near this entity) for P(near), or disclosure() if that is larger."""
    terms, everything = _disclosure(docs, found, text_col)
    each = found.select(F.explode("near").alias("n")).select("n.term", F.explode("n.entities").alias("entity"))
    pairs = common.save(each.groupBy("term", "entity").agg(F.count("*").alias("n")), "pairs")
    sizes = pairs.groupBy("entity").agg((F.sum("n") / max(1, everything)).alias("share"))
    both = pairs.join(terms, "term").join(sizes, "entity")
    return both.select("term", "entity", F.greatest("disclosure", _strength(F.col("n"), F.col("total"), F.col("share"))).alias("disclosure"))


def sensitive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, key, base, terms) for each row of docs; terms (start, end, disclosure) reach GENERALISE."""
    found = entities(docs, id_col, text_col)
    strong = disclosure_by_entity(docs, found, text_col).filter(F.col("disclosure") >= GENERALISE)
    near = found.select("id", "key", F.explode("near").alias("n")).select("id", "key", "n.term", "n.start", "n.end", F.explode("n.entities").alias("entity")).distinct()
    near = near.join(strong, ["term", "entity"]).groupBy("id", "key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    terms = near.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    terms = terms.select(F.col("id").alias("t_id"), F.col("key").alias("t_key"), "terms")
    none = F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")
    return found.join(terms, found["id"].eqNullSafe(F.col("t_id")) & (F.col("key") == F.col("t_key")), "left").select("id", "key", "base", F.coalesce("terms", none).alias("terms"))


def _clean(batches):
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            text, out, done = r["__text"] or "", [], 0
            spans = [(b["start"], b["end"], f"[{KINDS[b['kind']].upper()}]") for b in r["base"] or []]
            spans += [(t["start"], t["end"], "" if t["disclosure"] >= REMOVE else "[TERM]") for t in r["terms"] or []]
            for a, b, mark in sorted(spans):
                if a >= done:
                    out += [text[done:a], mark]
                done = max(done, b)
            r["clean"] = None if r["__text"] is None else "".join([*out, text[done:]])
        yield pa.RecordBatch.from_pydict({**{n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("base", "terms", "__text")}, "clean": [r["clean"] for r in rows]})


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, clean): texts with entities marked by kind and revealing terms marked or removed; one row for each distinct row."""
    spans = sensitive(docs, id_col, text_col).dropDuplicates(["id", "key"])
    read = docs.select(F.col(id_col).cast("long").alias("d_id"), F.xxhash64(text_col).alias("d_key"), F.col(text_col).alias("__text")).dropDuplicates(["d_id", "d_key"])
    both = spans.join(read, spans["id"].eqNullSafe(F.col("d_id")) & (F.col("key") == F.col("d_key"))).select("id", "key", "base", "terms", "__text")
    return both.mapInArrow(_clean, "id long, key long, clean string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones too; null and empty texts have no spans. See sensitive()."""
    found = sensitive(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.array_sort("base")
    everything = F.concat(base, F.transform("terms", lambda t: F.struct(F.lit(4).alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))
    kind = lambda k: F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), F.lit(False))).cast("long")
    return found.select(F.col("id").alias("doc_id"), *[kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(everything).alias("spans"))
