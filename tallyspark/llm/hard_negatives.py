"""Hard-negative mining: an orthogonal rotation to principal components, bounds on what is left, integer verification.

A row's score is the integer inner product of its quantised vector with an anchor's. An anchor's positives are the first
rows of its own label; its negatives for a positive are the first rows of other labels whose score lies between two
shares of the positive's score.

Vectors are turned by an orthogonal matrix whose first axes carry most of their length (principal components about the
origin, of rows with SAMPLE components: a turn leaves inner products as they are, so any turn gives the same result). For a pair,
the products of the leading components are summed; what the rest can add lies within the product of the two residual
norms, and a slack covers rounding. A pair leaves as soon as that interval misses every range that is still wanted, whose
lower ends rise to the last place found so far. What stays after all components is verified with integer products.

Anchors are a stated query set, which meets all rows in blocks: rows are dealt at random over blocks of bounded size,
anchors over others, and each pair of blocks is a group of its own. So no key, however hot, makes a group large; nothing
passes the driver but the sample and counts. A group returns its first rows for each anchor, a window then ranks them.

Defined cases: rows with a null id, label or vector, an empty vector, a null or non-finite component, or a squared length
of 2**61 or more (a product might not fit in a long) take no part. Vectors are compared with others of their own length.
The anchor's own id is never its positive. Repeated rows count each; equal scores go to the smaller id. An empty table
gives an empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Components of the rows that rotations are fitted on (16,384 rows of 64), and entries of all rotations, about.
SAMPLE, TURNED = 1 << 20, 1 << 22
#: Components in a block of rows and in one of anchors; rows compared at once, at first and at most; components gathered at once.
ROW_BLOCK, ANCHOR_BLOCK, FEW, STEP, GATHERED = 1 << 20, 1 << 17, 64, 1024, 1 << 22
#: Small tables are cut into this many blocks too, so that all cores work.
BLOCKS, LEAST = 24, 256
#: Shares of the components after which pairs are discarded.
CUTS = (8, 4, 2)
LARGEST = 2.0**61
_FIRST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component in double precision; null unless every component is finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * scale)))


def usable(rows: DataFrame, vec_id: Column, label: Column, v: Column) -> DataFrame:
    """vec_id, label, v (array<int>) and dim of the rows that take part."""
    out = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).filter("vec_id is not null and label is not null and size(v) > 0")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.filter(length < LARGEST).select("vec_id", "label", F.col("v").cast("array<int>").alias("v"), F.size("v").alias("dim"))


def rotations(rows: DataFrame, many: int, total: int) -> dict[int, np.ndarray]:
    """Principal axes by length of vector, of rows with about `many` components at most.

    Lengths that the sample has not stay as they are, and the rarer ones of it where their axes go beyond TURNED entries.
    """
    seen: dict[int, list] = {}
    for r in rows.filter(F.rand(7) < many / max(total, 1) / F.col("dim")).select("v").toLocalIterator():
        seen.setdefault(len(r.v), []).append(np.array(r.v, np.int32))
    out, left = {}, TURNED
    for dim, vectors in sorted(seen.items(), key=lambda x: (-len(x[1]), x[0])):
        if dim * dim <= left:
            left -= dim * dim
            x = np.stack(vectors).astype(float)
            out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


class Side:
    """Vectors with their turned components and, for each cut, the norm of the components behind it."""

    def __init__(self, v: np.ndarray, turn: np.ndarray | None, cuts: list[int]):
        self.v = v
        x = v.astype(float) if turn is None else v @ turn
        self.x = x.astype(np.float32)
        squares = np.cumsum((x * x)[:, ::-1], 1)[:, ::-1]
        self.norm = np.sqrt(squares[:, 0]) if x.shape[1] else np.zeros(len(x))
        self.rest = [np.sqrt(squares[:, c]) if c < x.shape[1] else np.zeros(len(x)) for c in cuts]


def cut_points(dim: int) -> list[int]:
    return sorted({max(1, dim // c) for c in CUTS} | {dim})


class First:
    """The k best (score, id) of each anchor for one range of scores."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.need = low.copy()
        self.found = tuple(np.zeros(0, np.int64) for _ in range(3))

    def floats(self) -> tuple[np.ndarray, np.ndarray]:
        """The range that is still wanted, rounded outwards."""
        return tuple(np.nextafter(x.astype(np.float32), np.float32(to)) for x, to in ((self.need, -np.inf), (self.high, np.inf)))

    def add(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fits = (score >= self.need[a]) & (score <= self.high[a])
        if not fits.any():
            return
        a, score, ids = (np.concatenate([x, y[fits]]) for x, y in zip(self.found, (a, score, ids), strict=True))
        order = np.lexsort((ids, -score, a))
        a, score, ids = a[order], score[order], ids[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        last = place == self.k - 1
        self.need[a[last]] = score[last]
        self.found = tuple(x[place < self.k] for x in (a, score, ids))


def search(anchors: Side, rows: Side, ids: np.ndarray, allowed, wanted: list[First], cuts: list[int]) -> dict[str, int]:
    """Fill wanted with the rows that belong there; gives how many pairs there were, and how many were verified.

    allowed(slice of rows) says which pairs count, as a matrix of anchors by rows.
    """
    dim = rows.v.shape[1]
    slack = (2 * dim + 16) * 2.0**-24
    count = {"pairs": 0, "verified": 0}
    many = max(1, GATHERED // dim)
    end = 0
    while end < len(ids):  # few rows first, so that the next ones meet raised ends
        at, end = end, end + min(STEP, max(FEW, end))
        part = slice(at, end)
        ranges = [w.floats() for w in wanted]

        def alive(a, r, score, c, ranges=ranges):
            if a is None:
                off = (np.outer(anchors.rest[c], rows.rest[c][r]) + slack * np.outer(anchors.norm, rows.norm[r])).astype(np.float32)
                each = [(low[:, None], high[:, None]) for low, high in ranges]
            else:
                off = (anchors.rest[c][a] * rows.rest[c][r] + slack * anchors.norm[a] * rows.norm[r]).astype(np.float32)
                each = [(low[a], high[a]) for low, high in ranges]
            most, least = score + off, score - off
            return np.logical_or.reduce([(most >= low) & (least <= high) for low, high in each])

        near = anchors.x[:, : cuts[0]] @ rows.x[part, : cuts[0]].T
        ok = allowed(part)
        count["pairs"] += int(ok.sum())
        a, r = np.nonzero(ok & alive(None, part, near, 0))
        score = near[a, r]
        r += at
        for c in range(1, len(cuts)):
            span = slice(cuts[c - 1], cuts[c])
            for i in range(0, len(a), many):
                j = slice(i, i + many)
                score[j] += np.einsum("ij,ij->i", anchors.x[a[j], span], rows.x[r[j], span])
            keep = alive(a, r, score, c)
            a, r, score = a[keep], r[keep], score[keep]
        count["verified"] += len(a)
        exact = np.zeros(len(a), np.int64)
        for i in range(0, len(a), many):
            j = slice(i, i + many)
            exact[j] = np.einsum("ij,ij->i", anchors.v[a[j]], rows.v[r[j]])
        for w in wanted:
            w.add(a, exact, ids[r])
    return count


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def _column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _ends(scores: list[list[int]], share: int, up: bool, fill: int) -> np.ndarray:
    """Ends of ranges: share percent of each score, rounded into the range; places that an anchor lacks get fill."""
    most = max(map(len, scores), default=0)
    return np.array([[-(-s * share // 100) if up else s * share // 100 for s in x] + [fill] * (most - len(x)) for x in scores], np.int64).reshape(len(scores), most)


def _nearest(turns, k: int):
    """For each pair of blocks: the k best rows of each anchor's own label."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        n = anchors.num_rows
        if not n or not rows.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in ("key", "vec_id", "score")})
        cuts, turn = cut_points(key[0].as_py()), turns.value.get(key[0].as_py())
        ids, own, label, named = _column(rows, "vec_id"), _column(anchors, "anchor_id"), _column(anchors, "anchor_label"), _column(rows, "label")
        first = First(np.full(n, _FIRST), np.full(n, _LAST), k)
        search(Side(_matrix(anchors.column("anchor_v")), turn, cuts), Side(_matrix(rows.column("v")), turn, cuts), ids, lambda p: (label[:, None] == named[p]) & (own[:, None] != ids[p]), [first], cuts)
        a, score, found = first.found
        return pa.table({"key": _column(anchors, "key")[a], "vec_id": found, "score": score})

    return run


def _between(turns, k: int, low: int, high: int):
    """For each pair of blocks: the k best rows of other labels in each positive's range."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in ("key", "place", "vec_id", "score")})
        cuts, turn = cut_points(key[0].as_py()), turns.value.get(key[0].as_py())
        scores = anchors.column("scores").to_pylist()
        lows, highs = _ends(scores, low, True, _LAST), _ends(scores, high, False, _FIRST)
        label, named = _column(anchors, "anchor_label"), _column(rows, "label")
        wanted = [First(lows[:, i].copy(), highs[:, i].copy(), k) for i in range(lows.shape[1])]
        search(Side(_matrix(anchors.column("anchor_v")), turn, cuts), Side(_matrix(rows.column("v")), turn, cuts), _column(rows, "vec_id"), lambda p: label[:, None] != named[p], wanted, cuts)
        keys = _column(anchors, "key")
        parts = [pa.table({"key": keys[w.found[0]], "place": np.full(len(w.found[0]), i), "vec_id": w.found[2], "score": w.found[1]}) for i, w in enumerate(wanted)]
        return pa.concat_tables(parts)

    return run


def _dealt(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Rows and anchors grouped by pairs of blocks."""
    blocks = F.greatest(F.lit(min(BLOCKS, -(-n_rows // LEAST))), F.ceil(n_rows * F.col("dim") / ROW_BLOCK)).cast("int")
    others = F.ceil(F.greatest(F.lit(1), n_anchors * F.col("dim") / ANCHOR_BLOCK)).cast("int")
    here = lambda n, seed: F.floor(F.rand(seed) * n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.withColumn("row_block", here(blocks, 1)).withColumn("anchor_block", each(others))
    right = anchors.withColumn("anchor_block", here(others, 2)).withColumn("row_block", each(blocks))
    names = ["dim", "row_block", "anchor_block"]
    return left.groupBy(*names).cogroup(right.groupBy(*names))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: of usable(). low, high: percent of the positive's score between which a negative's lies.
    """
    spark = rows.sparkSession
    rows = common.save(rows, "vectors")
    anchors = common.save(rows.filter(is_anchor).select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor_v"), "dim"), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()
    turns = spark.sparkContext.broadcast(rotations(rows, SAMPLE, n_rows))
    ranked = lambda df, n, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= n)

    near = _dealt(rows, anchors, n_rows, n_anchors).applyInArrow(_nearest(turns, positives), "key long, vec_id long, score long")
    first = ranked(near, positives, "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    asked = common.save(anchors.join(first, "key").withColumns({"ids": F.col("found.vec_id"), "scores": F.col("found.score")}).drop("found"), "positives")

    found = _dealt(rows, asked.drop("ids"), n_rows, n_anchors).applyInArrow(_between(turns, negatives, low, high), "key long, place long, vec_id long, score long")
    out = ranked(found, negatives, "key", "place").join(asked.select("key", "anchor_id", "ids", "scores"), "key")
    at = lambda c: F.get(c, F.col("place").cast("int"))
    return out.select("anchor_id", at("ids").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), at("scores").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(common.table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, quantised(F.col("embedding")))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda x: CAST(x[1] AS HUGEINT) * x[2])) AS BIGINT) AS score FROM a JOIN e ON len(a.v) = len(e.v)),
p AS (SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM s WHERE same AND vec_id <> anchor_id QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.n, place ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.n = s.n AND NOT same AND CAST(30 AS HUGEINT) * positive_score <= CAST(100 AS HUGEINT) * score AND CAST(100 AS HUGEINT) * score <= CAST(90 AS HUGEINT) * positive_score QUALIFY rank <= 10"""
