"""Approximate nearest neighbours: shifted space-filling curves.

Vectors are projected by several random rotations, shifted, and put in the order of a Hilbert curve; each order is
range-partitioned and sorted by Spark. A query looks, in every order, at the key window around its own key that holds
WIDTH of all rows, wherever the partitions' borders lie. Neighbours of all windows merge and are ranked by exact
cosines of the original vectors.

Vectors without structure are nearly equally far from each other, and no order keeps more than a little of their
nearness: windows must then be wide to find 9 in 10. WIDTH and ORDERS are set for such vectors; see the README for
recall. Equal vectors are searched once, with their smallest ids, so that copies cost nothing. Queries are sent to
tasks in blocks of BLOCK.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

ORDERS, WIDTH = 4, 0.42
#: Projected dimensions and bits of each: together fewer than 63.
DIMENSIONS, BITS = 8, 7
#: Quantiles of keys that set windows' ends; queries broadcast at once; rows compared at once.
QUANTILES, BLOCK, ROWS = 1000, 20_000, 4096
#: Decimal places to which cosines count as equal while candidates are gathered.
TIED = 13


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows of coordinates below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level, from the largest cells on
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keys(unit: np.ndarray, orders: int) -> np.ndarray:
    """Keys of unit vectors in each order, a row each."""
    size = unit.shape[1]
    out = np.zeros((orders, len(unit)), np.int64)
    for o in range(orders):
        rng = np.random.default_rng([o, size])
        turn = np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(DIMENSIONS, size)]
        place = unit @ turn * np.sqrt(size) / 8 + 0.5 + (rng.random(turn.shape[1]) - 0.5) / 4
        out[o] = hilbert(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)
    return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(1, keepdims=True) if len(v) else v
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True) if len(v) else v


def _keyed(orders: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                k = keys(_units(_matrix(b.column(1))), orders)
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, k)], [*b.schema.names, *[f"key{o}" for o in range(orders)]])

    return run


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of pairs of rows, in double precision; scaled first, so that large and tiny vectors lose nothing."""
    q, c = q / np.abs(q).max(1, keepdims=True), c / np.abs(c).max(1, keepdims=True)
    return (q * c).sum(1) / np.sqrt((q * q).sum(1) * (c * c).sum(1))


def _best(score: np.ndarray, ids: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest scores of each row and their ids, a row each; of scores equal to TIED places the smaller ids. -inf fills up."""
    short = many - score.shape[1]
    if short > 0:
        score = np.concatenate([score, np.full((len(score), short), -np.inf)], 1)
        ids = np.concatenate([ids, np.zeros((len(ids), short), np.int64)], 1)
    score = np.round(score, TIED)
    least = -np.partition(-score, many - 1, axis=1)[:, many - 1 : many]
    i, j = np.nonzero(score >= least)
    order = np.lexsort((ids[i, j], -score[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[place < many].reshape(-1, many), j[place < many].reshape(-1, many)
    return score[i, j], ids[i, j]


def _searched(sent, k: int):
    """The k + 1 nearest distinct vectors to each query among a partition's rows inside its window."""

    def run(batches):
        q = sent.value
        if not len(q["unit"]):
            return
        best = np.full((len(q["unit"]), k + 1), -np.inf)
        who = np.zeros((len(q["unit"]), k + 1), np.int64)
        vectors: dict[int, tuple] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, raw, key = part.column(0).to_numpy(), _matrix(part.column(1)), part.column(2).to_numpy()
                ask = np.flatnonzero((q["low"] <= key.max()) & (q["high"] >= key.min()))
                if not len(ask):
                    continue
                s = q["unit"][ask] @ _units(raw).T
                s[(key[None] < q["low"][ask, None]) | (key[None] > q["high"][ask, None])] = -np.inf
                top, names = _best(s, np.broadcast_to(ids, s.shape), k + 1)
                best[ask], who[ask] = _best(np.concatenate([best[ask], top], 1), np.concatenate([who[ask], names], 1), k + 1)
                near = set(np.unique(who[ask]).tolist())
                vectors |= {int(i): r for i, r in zip(ids, raw, strict=True) if i in near}
            kept = set(np.unique(who[best > -np.inf]).tolist())
            vectors = {i: v for i, v in vectors.items() if i in kept}
        i, j = np.nonzero(best > -np.inf)
        for a in range(0, len(i), 1 << 15):
            x, found = i[a : a + (1 << 15)], who[i[a : a + (1 << 15)], j[a : a + (1 << 15)]]
            score = cosines(q["raw"][x], np.array([vectors[int(f)] for f in found]))
            yield pa.RecordBatch.from_pydict({"query": q["id"][x], "rep": found, "score": score})

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: not null, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


_FOUND = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, orders: int = ORDERS, width: float = WIDTH) -> DataFrame:
    """The k nearest rows found of each query: query_id, rank (from 1), vec_id, score (cosine).

    Both frames are (id, v), as usable() gives them; a query's own id is no candidate. Equal scores go to the smaller
    id. Rows that repeat an id with other components are separate candidates; of one id the best stays. Vectors are
    compared with those of their own length: there is a search for each length that queries have.
    """
    of = lambda df, n: df.filter(F.size("v") == n)
    lengths = sorted(r.n for r in queries.select(F.size("v").alias("n")).distinct().collect())
    parts = [_nearest(of(vectors, n), of(queries, n), k, orders, width) for n in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], _FOUND)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, orders: int, width: float) -> DataFrame:
    """nearest() of vectors of one length."""
    spark = vectors.sparkSession
    # equal vectors: the k + 1 smallest ids are all that any query can return
    w = Window.partitionBy("v").orderBy("id")
    distinct = vectors.distinct()
    small = distinct.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = distinct.join(small.filter("n > 1"), "v").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("rep", "id", "r")
    keyed = common.save(small.select("rep", "v").mapInArrow(_keyed(orders), "rep long, v array<double>, " + ", ".join(f"key{o} long" for o in range(orders))), "keys")
    copies = common.save(copies, "copies")
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    cuts = keyed.agg(*[F.percentile_approx(f"key{o}", at, 20_000) for o in range(orders)]).first()
    half = round(width * QUANTILES / 2)
    # each order is dealt and written once, however many blocks of queries there are
    ordered = [common.save(keyed.select("rep", "v", f"key{o}").repartitionByRange(f"key{o}", "rep").sortWithinPartitions(f"key{o}", "rep"), "order") for o in range(orders)] if cuts[0] else []
    parts, block = [], []

    def search(block):
        raw = np.array([r.v for r in block], np.float64)
        unit = _units(raw)
        places = keys(unit, orders)
        for o in range(orders):
            cut = np.array(cuts[o], np.int64)
            middle = np.clip((np.searchsorted(cut, places[o], "left") + np.searchsorted(cut, places[o], "right")) // 2, half, max(half, QUANTILES - half))
            low, high = cut[np.maximum(middle - half, 0)], cut[np.minimum(middle + half, QUANTILES)]
            sent = spark.sparkContext.broadcast({"id": np.array([r.id for r in block], np.int64), "raw": raw, "unit": unit, "low": np.where(middle <= half, np.iinfo(np.int64).min, low), "high": np.where(middle >= QUANTILES - half, np.iinfo(np.int64).max, high)})
            parts.append(common.save(ordered[o].mapInArrow(_searched(sent, k), "query long, rep long, score double"), "found"))
            sent.destroy()

    if cuts[0]:
        for r in queries.distinct().toLocalIterator():
            block.append(r)
            if len(block) == BLOCK:
                search(block)
                block = []
        if block:
            search(block)
    if not parts:
        return spark.createDataFrame([], _FOUND)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    more = found.join(copies.filter("r > 1").select("rep", "id"), "rep").select("query", F.col("id").alias("vec_id"), "score")
    every = found.select("query", F.col("rep").alias("vec_id"), "score").unionByName(more).filter("query <> vec_id").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 5 rows for each query; see usable() for rows that take no part, nearest() for repeated ones and ties."""
    rows = usable(common.table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.filter("id % 50 = 0"))
