"""Fill-in-middle transformation, in Spark SQL functions only.

A text is cut into units (leading white space and a word, or white space alone). A digest of the seed and the
document's id gives two cuts and the form, so that a document is arranged alike in any run, order or partitioning:

* plain: the text as it is;
* psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle;
* spm: suffix mark, suffix, prefix mark, prefix, middle mark, middle.

Marks neither begin inside a mark nor hold another, and a text that contains one stays plain. So an arranged text
holds each mark once, and restored() cuts it there.

Nulls: a null text is read as empty, and an empty text is plain; a null id has the digest of the seed alone. Repeated
rows give repeated rows. An empty table gives an empty one. A caller's columns named like the new ones are replaced;
all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

#: A unit, as the contract of the query has it.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ADDED = ("output", "form", "n_units", "prefix_chars", "middle_chars")


@dataclass(frozen=True)
class Marks:
    """No mark may overlap another or itself, as it must be found again in one way only."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for i, a in enumerate(self.each):
            if not a:
                raise ValueError("a mark is empty")
            for j, b in enumerate(self.each):
                if any(b[-n:] == a[:n] for n in range(1, min(len(a), len(b)) + (i != j))) or i != j and a in b:
                    raise ValueError(f"marks {b!r} and {a!r} overlap")

    @property
    def each(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


MARKS = Marks()


def _quoted(text: str) -> str:
    """A text as a pattern that matches it alone."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of 8 hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Marks = MARKS) -> DataFrame:
    """docs with output, form (plain, psm, spm), n_units, prefix_chars and middle_chars (null where plain).

    rate: percent of texts that are arranged; spm_rate: percent of these whose suffix comes first.
    """
    text, digest, units, first, last, form = map(common.fresh, ("text", "digest", "units", "first", "last", "form"))
    prefix, middle, suffix = map(common.fresh, ("prefix", "middle", "suffix"))
    kept = [c for c in docs.columns if c not in ADDED]
    out = docs.withColumns({text: F.coalesce(text_col, F.lit("")), digest: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)})
    out = out.withColumn(units, F.regexp_extract_all(text, F.lit(f"({UNIT})"), 0))
    n = F.size(units).cast("long")
    cuts = [_draw(F.col(digest), k) % (n + 1) for k in (0, 1)]
    marked = reduce(lambda a, b: a | b, (F.contains(F.col(text), F.lit(m)) for m in marks.each))
    plain = (F.col(text) == "") | marked | (_draw(F.col(digest), 2) % 100 >= rate)
    out = out.withColumns({first: F.least(*cuts).cast("int"), last: F.greatest(*cuts).cast("int"), form: F.when(plain, "plain").when(_draw(F.col(digest), 3) % 100 < spm_rate, "spm").otherwise("psm")})
    part = lambda a, b: F.array_join(F.slice(units, a + 1, b - a), "")
    out = out.withColumns({prefix: part(F.lit(0), F.col(first)), middle: part(F.col(first), F.col(last)), suffix: part(F.col(last), F.size(units))})
    p, s, m = map(F.lit, marks.each)
    arranged = F.when(F.col(form) == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col(form) == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col(text))
    chars = lambda c: F.when(F.col(form) != "plain", F.length(c).cast("long"))
    return out.select(*kept, arranged.alias("output"), F.col(form).alias("form"), n.alias("n_units"), chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"))


def restored(output: Column, form: Column, marks: Marks = MARKS) -> Column:
    """The text that output was arranged from, by its form and its marks alone."""
    parts = F.split(output, "|".join(map(_quoted, marks.each)))  # nothing, first part, second part, middle
    at = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT FOR k IN [0, 1, 2, 3]] AS draws FROM d),
c AS (SELECT *, len(units) AS n, least(draws[1] % (len(units) + 1), draws[2] % (len(units) + 1)) AS a, greatest(draws[1] % (len(units) + 1), draws[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 50 THEN 'plain' WHEN draws[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
