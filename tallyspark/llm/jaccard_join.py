"""N-gram Jaccard join by a count-vector R-tree.

A text's set is its distinct shingles of `size` words; two texts link when their sets' Jaccard
similarity is 3/4 or more. Shingles are hashed into DIMS groups; a text's point is its counts of
shingles by group. The overlap of two sets is at most the sum of the coordinate minima of their points,
and at most that of the upper corners of two boxes that hold them: this prunes pairs of R-tree leaves,
then pairs of points; pairs that are left are verified on the whole sets.

Points of unrelated texts of one length lie close together, so one tree over all texts would have to
visit nearly every pair of leaves. The tree's top level is therefore a lossless routing: texts that can
link share one of their n - ceil(3n/4) + 1 rarest shingles, and each such shingle has a tree of its own.

1. `_fold`: every shingle of every distinct text meets its equals in buckets of the hash space. A text
   goes on only if 3/4 of its shingles occur in another text; common shingles are listed with counts.
2. `_route`: texts that go on enter the trees of their rarest shingles, common ones last.
3. Each text is first verified against one centre (the text of a tree with the most common shingles), so
   that a large group of near copies becomes one class without its pairs being listed.
4. In trees that still hold several classes, boxes of inner nodes, of their leaves, points and sets are compared
   in turn; a tree of one leaf starts at its points. Nodes hold texts of one band of sizes, or of one class; a node only
   meets those of bands that it can link with.
5. Classes grow into components by alternating large-star and small-star steps on tables.

Hashes have 64 bits. Buckets, leaves and broadcasts are bounded; hot shingles are settled within each
chunk of texts before they are shuffled, and large trees are dealt out by nodes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.neighbours import hilbert
from tallyspark.llm.words import SPACES, Words, batch_rows, chunks, pack, unpack

SHINGLE, DIMS = 5, 32
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 128
#: Shingles in so many texts are common, if no more than HOT_LIMIT (12 bytes each) are; else the number doubles.
HOT, HOT_LIMIT = 64, 2_000_000
#: Texts in an R-tree leaf, and about how many of a tree one task deals into leaves.
LEAF, DEAL = 256, 4096
#: How far the sizes of a node's texts are apart at most, but for those of one label.
BAND = 1.05
#: Bytes of text that are routed at once.
ROUTED_BYTES = 1 << 19


def needed(a, b):
    """Least overlap of linked sets of sizes a and b: 4 I >= 3 (a + b - I)."""
    return (3 * (a + b) + 6) // 7


def _sets(rows: list[tuple], size: int):
    """Distinct shingle hashes of each text, sorted, with bounds; and each text's class."""
    words = Words([t.lower() for t in (r[-1] for r in rows)], SPACES)
    hashes, bounds = words.windows(size, short=True)
    doc = np.repeat(np.arange(len(rows)), np.diff(bounds))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    hashes, doc = hashes[keep], doc[keep]
    return hashes, doc, np.searchsorted(doc, np.arange(len(rows) + 1)), words.whole().view(np.int64)


_FOLDED = "bucket int, chunk string, ids array<bigint>, tags binary, counts binary, folds binary, common binary, often binary"
_FOLDED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("tags", "counts", "folds", "common", "often"))])


def _fold(size: int, buckets: int):
    """Rows by bucket: folds (upper halves of hashes) of texts alone in the chunk with them, and folds that
    several texts have. Negative buckets have, with ids, classes and set sizes; without, the repeats settled
    in the chunk."""

    def run(batches):
        for rows in chunks(batch_rows(batches, "id", "text")):
            hashes, doc, bounds, tag = _sets(rows, size)
            name = f"{tag.sum() & 0xFFFFFFFFFFFF:x}-{hashes.sum():x}-{rows[0][0]}"
            aside = -1 - int(hashes.sum() % np.uint64(buckets))
            out = [(aside, name, [r[0] for r in rows], pack(tag), pack(np.diff(bounds).astype(np.int32)), b"", b"", b"")]
            once = np.zeros(len(rows), bool)
            counted = np.flatnonzero([r[0] is not None for r in rows])  # rows with a null id link with nothing
            once[counted[np.unique(tag[counted], return_index=True)[1]]] = True
            hashes, doc = hashes[once[doc]], doc[once[doc]]
            order = np.argsort(hashes, kind="stable")
            hashes, doc = hashes[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            many = np.diff(head, append=len(hashes))
            local = np.repeat(many > 1, many)
            repeats = np.bincount(doc[local], minlength=len(rows))
            out.append((aside, name, None, pack(tag[once]), pack(repeats[once].astype(np.int32)), b"", b"", b""))
            # texts alone in this chunk with a shingle, by bucket and text
            h, d = hashes[~local], doc[~local]
            b = (h % np.uint64(buckets)).astype(np.int32)
            by = np.lexsort((d, b))
            h, d, b = h[by], d[by], b[by]
            hs, often = hashes[head[many > 1]], many[many > 1]
            hb = (hs % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(hb, kind="stable")
            hs, often, hb = hs[by], often[by], hb[by]
            edges, hedges = np.searchsorted(b, np.arange(buckets + 1)), np.searchsorted(hb, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges) + np.diff(hedges)).tolist():
                e, g = slice(edges[k], edges[k + 1]), slice(hedges[k], hedges[k + 1])
                own, counts = np.unique(d[e], return_counts=True)
                out.append((k, name, None, pack(tag[own]), pack(counts.astype(np.int32)), (h[e] >> np.uint64(32)).astype(np.uint32).tobytes(), pack((hs[g] >> np.uint64(32)).astype(np.uint32)), pack(often[g].astype(np.int32))))
            yield pa.RecordBatch.from_pydict(dict(zip(_FOLDED_ARROW.names, map(list, zip(*out, strict=True)), strict=True)), _FOLDED_ARROW)

    return run


_REPEATS = "chunk string, ids array<bigint>, tags binary, counts binary, bucket int, common binary, often binary, sizes array<bigint>"
_REPEATS_ARROW = pa.schema([("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("tags", pa.binary()), ("counts", pa.binary()), ("bucket", pa.int32()), ("common", pa.binary()), ("often", pa.binary()), ("sizes", pa.list_(pa.int64()))])


def _repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: how many folds each text of each chunk shares with another text; and the common folds.

    Rows of negative buckets pass.
    """
    if table.column("bucket")[0].as_py() < 0:
        return pa.Table.from_pylist([r | {"bucket": None, "sizes": None} for r in table.drop_columns(["folds"]).to_pylist()], _REPEATS_ARROW)
    rows = table.to_pylist()
    folds = [np.frombuffer(r["folds"], np.uint32) for r in rows]
    tags = [np.repeat(unpack(r["tags"], np.int64), unpack(r["counts"], np.int32)) for r in rows]
    marked = np.concatenate([unpack(r["common"], np.uint32) for r in rows])
    often = np.concatenate([unpack(r["often"], np.int32) for r in rows]).astype(np.int64)
    f, t = np.concatenate(folds), np.concatenate(tags)
    order = np.lexsort((t, f))
    f, t = f[order], t[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (t[1:] != t[:-1])]) if len(f) else np.zeros(0, bool)
    values, where = np.unique(np.concatenate([f[new], marked]), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([np.ones(int(new.sum()), np.int64), often]), minlength=len(values)).astype(np.int64)
    shared = np.zeros(len(f), bool)
    shared[order] = total[np.searchsorted(values, f)] > 1
    out, at = [], 0
    for r, part in zip(rows, folds, strict=True):
        own = shared[at : at + len(part)]
        at += len(part)
        counts = unpack(r["counts"], np.int32)
        if len(counts):
            n = np.add.reduceat(own, np.concatenate([[0], np.cumsum(counts)[:-1]]))
            if n.any():
                out.append({"chunk": r["chunk"], "ids": None, "tags": pack(unpack(r["tags"], np.int64)[n > 0]), "counts": pack(n[n > 0].astype(np.int32)), "bucket": None, "common": None, "often": None, "sizes": None})
    hot = total >= HOT
    sizes = np.bincount(np.log2(total[hot]).astype(np.int64), minlength=48).tolist()
    out.append({"chunk": None, "ids": None, "tags": None, "counts": None, "bucket": rows[0]["bucket"], "common": pack(values[hot]), "often": pack(total[hot]), "sizes": sizes})
    return pa.Table.from_pylist(out, _REPEATS_ARROW)


def _members(batches):
    schema = pa.schema([("id", pa.int64()), ("cls", pa.int64()), ("n", pa.int32())])
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_pydict({"id": r["ids"], "cls": unpack(r["tags"], np.int64), "n": unpack(r["counts"], np.int32)}, schema)


def _sum_chunk(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    tags, where = np.unique(np.concatenate([unpack(r["tags"], np.int64) for r in rows]), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([unpack(r["counts"], np.int32) for r in rows]), minlength=len(tags))
    return pa.table({"cls": pa.array(tags, pa.int64()), "shared": pa.array(total.astype(np.int64), pa.int64())})


def _common(repeats: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the common shingles: at most HOT_LIMIT, by raising the least count."""
    hot = repeats.filter("bucket is not null")
    sizes = {r.pos: r.n for r in hot.select(F.posexplode("sizes")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    least, total = 48, 0
    while least > 6 and total + sizes.get(least - 1, 0) <= HOT_LIMIT:
        least -= 1
        total += sizes.get(least, 0)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = unpack(r["often"], np.int64)
                keep = n >= 1 << least
                yield pa.RecordBatch.from_pydict({"key": (np.int64(r["bucket"]) << 32) | unpack(r["common"], np.uint32)[keep].astype(np.int64), "n": n[keep]}, schema)

    found = hot.filter(F.octet_length("common") > 0).select("bucket", "common", "often").mapInArrow(run, "key long, n long").toArrow()
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


_ROUTED = "h long, cls long, n int, pos int, hot int, point binary, shingles binary"
_ROUTED_ARROW = pa.schema([("h", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("hot", pa.int32()), ("point", pa.binary()), ("shingles", pa.binary())])


def _route(size: int, buckets: int, sent):
    """Rows for the trees of each text's rarest shingles; a row without h has its whole set."""

    def run(batches):
        keys, often = sent.value
        for rows in chunks(batch_rows(batches, "id", "text"), ROUTED_BYTES):
            hashes, doc, bounds, tag = _sets(rows, size)
            key = ((hashes % np.uint64(buckets)) << np.uint64(32) | (hashes >> np.uint64(32))).view(np.int64)
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            count = np.where(keys[at] == key, often[at], 0) if len(keys) else np.zeros(len(key), np.int64)
            order = np.lexsort((hashes, count, doc))
            out: dict[str, list] = {n: [] for n in _ROUTED_ARROW.names}
            for d in range(len(rows)):
                a, b = bounds[d], bounds[d + 1]
                n = int(b - a)
                if not n or rows[d][0] is None:
                    continue
                own = hashes[a:b]
                point = np.minimum(np.bincount((own >> np.uint64(20)) % np.uint64(DIMS), minlength=DIMS), 65535).astype(np.uint16).tobytes()
                prefix = hashes[order[a:b]][: n - (3 * n + 3) // 4 + 1].view(np.int64)
                hot, many = int(np.count_nonzero(count[a:b])), len(prefix) + 1
                for name, v in zip(_ROUTED_ARROW.names, ([*prefix.tolist(), None], [int(tag[d])] * many, [n] * many, range(many), [hot] * many, [point] * many, [None] * (many - 1) + [own.tobytes()]), strict=True):
                    out[name] += v
            if out["h"]:
                yield pa.RecordBatch.from_pydict(out, _ROUTED_ARROW)

    return run


def _may_link(n1, n2, pos1, pos2, p1, p2):
    """Bounds on the overlap: by sizes, by places in the common order of shingles, by coordinate minima.

    The second one holds at the first shingle that two texts share, so a linked pair passes in that tree.
    Counts of 65535 may stand for more: such texts are not pruned by points.
    """
    need = needed(n1, n2)
    ok = (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)) & (np.minimum(n1 - pos1, n2 - pos2) >= need)
    i = np.flatnonzero(ok)
    bound = np.minimum(p1[i], p2[i]).sum(1, dtype=np.int64)
    ok[i] = (bound >= need[i]) | (p1[i].max(1, initial=0) == 65535) | (p2[i].max(1, initial=0) == 65535)
    return ok


def _near_centre(batches):
    """Texts of a tree that may link with its centre."""
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda n, b=batch: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
        points = lambda n, g=get: np.frombuffer(b"".join(g(n)), np.uint16).reshape(-1, DIMS)
        n1, n2 = get("n").astype(np.int64), get("c_n").astype(np.int64)
        zero = np.zeros(len(n1), np.int64)
        ok = (get("cls") != get("centre")) & _may_link(n1, n2, zero, zero, points("point"), points("c_point"))
        yield pa.RecordBatch.from_pydict({"a": get("centre")[ok], "b": get("cls")[ok]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _verified(batches):
    """Links among pairs that come with both sets."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            out = [(r["a"], r["b"]) for r in batch.slice(i, 256).to_pylist() if _linked(np.frombuffer(r["set_a"], np.uint64), np.frombuffer(r["set_b"], np.uint64))]
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [x for _, x in out]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
    return one.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a").select("a", "b", "set_a", "set_b").mapInArrow(_verified, "a long, b long")


_BOX = "h long, node string, leaf string, n_min int, n_max int, label_min long, label_max long, top array<int>"
_LEAF = f"{_BOX}, cls binary, n binary, pos binary, label binary, points binary"
_LEAF_ARROW = pa.schema([("h", pa.int64()), ("node", pa.string()), ("leaf", pa.string()), ("n_min", pa.int32()), ("n_max", pa.int32()), ("label_min", pa.int64()), ("label_max", pa.int64()), ("top", pa.list_(pa.int32())), *((n, pa.binary()) for n in ("cls", "n", "pos", "label", "points"))])


def _leaves(table: pa.Table) -> pa.Table:
    """Leaves of one node of a tree: neighbours by size, then along a curve through their counts, then by label."""
    cls, first = np.unique(table.column("cls").to_numpy(), return_index=True)
    get = lambda n: table.column(n).to_numpy(zero_copy_only=False)[first]
    n, pos, label = get("n"), get("pos"), get("label")
    points = np.frombuffer(b"".join(get("point")), np.uint16).reshape(-1, DIMS)
    cells = np.minimum(points.reshape(len(points), 8, -1).sum(2, dtype=np.int64) * 32 // np.maximum(n, 1)[:, None], 15)
    order = np.lexsort((label, hilbert(cells, 4), n))
    h, deal, part = (table.column(c)[0].as_py() for c in ("h", "deal", "part"))
    out = []
    for k in range(0, len(order), LEAF):
        o = order[k : k + LEAF]
        box = (int(n[o].min()), int(n[o].max()), int(label[o].min()), int(label[o].max()), points[o].max(0).astype(np.int32))
        out.append((h, f"{deal}-{part}", f"{deal}-{part}-{k}", *box, *(x[o].tobytes() for x in (cls, n, pos, label, points))))
    return pa.Table.from_pydict(dict(zip(_LEAF_ARROW.names, map(list, zip(*out, strict=True)), strict=True)), _LEAF_ARROW)


def _dealt(large: DataFrame) -> DataFrame:
    """Entries of large trees with their node (deal, part): by bands of size, in nodes of about DEAL texts; a label with more than
    a leaf of texts has nodes of its own, so that no pair of its leaves is looked at."""
    labels = large.groupBy("h", "label").agg(F.count("*").alias("alike"))
    rows = large.join(labels, ["h", "label"]).withColumn("deal", F.when(F.col("alike") > LEAF, F.xxhash64("label")).otherwise(_band(F.col("n"))))
    there = rows.groupBy("h", "deal").agg(F.count("*").alias("there"))
    return rows.join(there, ["h", "deal"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("there") / DEAL)))


def _band(n: Column) -> Column:
    """The band of sizes that n is in: each reaches BAND times as far as the one before."""
    return F.floor(F.log(n.cast("double")) / math.log(BAND))


def _boxes_may_link() -> Column:
    """Whether boxes x and y may hold texts that link: by sizes, by labels, and by the sum of the minima of their
    upper corners. Counts of 65535 may stand for more: such boxes are not pruned by corners."""
    x, y = ({c: F.col(f"{s}_{c}") for c in ("n_min", "n_max", "label_min", "label_max", "top")} for s in "xy")
    sizes = (4 * x["n_max"] >= 3 * y["n_min"]) & (4 * y["n_max"] >= 3 * x["n_min"])
    labels = (x["label_min"] < x["label_max"]) | (y["label_min"] < y["label_max"]) | (x["label_min"] != y["label_min"])
    overlap = F.aggregate(F.zip_with(x["top"], y["top"], lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, b: a + b)
    full = F.greatest(F.array_max(x["top"]), F.array_max(y["top"])) == 65535
    return sizes & labels & (full | (7 * overlap >= 3 * (x["n_min"].cast("long") + y["n_min"])))


def _sides(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    x, y = (df.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in keys)) for s in "xy")
    return x, y


def tree_pairs(leaves: DataFrame) -> DataFrame:
    """Pairs of leaves of one tree (or a leaf with itself) whose boxes, and those of whose nodes, may hold linked texts."""
    low, high = [F.min(c).alias(c) for c in ("n_min", "label_min")], [F.max(c).alias(c) for c in ("n_max", "label_max")]
    nodes = leaves.groupBy("h", "node").agg(*low, *high, *[F.max(F.col("top")[i]).alias(f"t{i}") for i in range(DIMS)])
    nodes = nodes.select("h", "node", "n_min", "n_max", "label_min", "label_max", F.array(*[f"t{i}" for i in range(DIMS)]).alias("top"))
    # a node meets those of the bands that sizes of 3/4 to 4/3 of its own are in
    x, y = _sides(nodes, "h")
    low, high = F.col("x_n_min") * 0.75, F.col("x_n_max") / 0.75
    x = x.withColumn("band", F.explode(F.sequence(_band(low), _band(high))))
    y = y.withColumn("band", F.explode(F.sequence(_band(F.col("y_n_min")), _band(F.col("y_n_max")))))
    near = x.join(y, ["h", "band"]).filter("x_node <= y_node").filter(_boxes_may_link()).select("h", "x_node", "y_node").distinct()
    x, y = _sides(leaves, "h")
    both = near.join(x, ["h", "x_node"]).join(y, ["h", "y_node"])
    return both.filter("x_node < y_node or x_leaf <= y_leaf").filter(_boxes_may_link())


def _leaf_pairs(batches):
    """Pairs of texts of two leaves (or one) that no bound rules out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            side = [{c: np.frombuffer(r[f"{s}_{c}"], k) for c, k in (("cls", np.int64), ("n", np.int32), ("pos", np.int32), ("label", np.int64))} | {"points": np.frombuffer(r[f"{s}_points"], np.uint16).reshape(-1, DIMS)} for s in "xy"]
            i, j = np.nonzero(side[0]["label"][:, None] != side[1]["label"][None])
            if r["x_leaf"] == r["y_leaf"]:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                x, y = {c: v[i[k : k + (1 << 16)]] for c, v in side[0].items()}, {c: v[j[k : k + (1 << 16)]] for c, v in side[1].items()}
                ok = _may_link(x["n"].astype(np.int64), y["n"].astype(np.int64), x["pos"], y["pos"], x["points"], y["points"])
                yield pa.RecordBatch.from_pydict({"a": np.minimum(x["cls"], y["cls"])[ok], "b": np.maximum(x["cls"], y["cls"])[ok]}, schema)


def _small_trees(batches):
    """Pairs of texts of trees of one leaf that no bound rules out; rows come sorted by tree."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ("h", "cls", "n", "pos", "label", "point")

    def pairs(rows):
        h, cls, n, pos, label, point = rows
        points = np.frombuffer(b"".join(point), np.uint16).reshape(-1, DIMS)
        i, step = np.arange(len(h) - 1), 1
        while len(i):
            i = i[i + step < len(h)]
            i = i[h[i] == h[i + step]]
            x = i[label[i] != label[i + step]]
            y = x + step
            ok = _may_link(n[x], n[y], pos[x], pos[y], points[x], points[y])
            a, b = cls[x[ok]], cls[y[ok]]
            yield np.minimum(a, b), np.maximum(a, b)
            step += 1

    def out(rows):
        found = list(pairs(rows))
        if found:
            both = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": both[:, 0].copy(), "b": both[:, 1].copy()}, schema)

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        rows[2] = rows[2].astype(np.int64)
        if left is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(left, rows, strict=True)]
        cut = np.searchsorted(rows[0], rows[0][-1])
        left = [r[cut:] for r in rows]
        if cut:
            yield from out([r[:cut] for r in rows])
    if left is not None:
        yield from out(left)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps on written tables until no edge changes; edges only ever
    point to smaller nodes, so a hot component is a star around its smallest node.
    """
    edges = common.save(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = common.save(edges, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def similar(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (id, cls, n) of classes of equal word sequences, and links (a, b) between classes.

    Links hold enough pairs to connect all that are similar: pairs inside a class that is already connected
    are not listed again. Words are split at ASCII white space, A-Z count as a-z; a text of fewer words
    than `size` has its whole sequence as only shingle. Null and empty texts have none and no links; rows with
    a null id neither.
    """
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, common.text_bytes(docs, text_col) // BUCKET_BYTES)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    repeats = common.save(read.mapInArrow(_fold(size, buckets), _FOLDED).groupBy("bucket").applyInArrow(_repeats, _REPEATS), "repeats")
    members = repeats.filter("ids is not null").select("ids", "tags", "counts").mapInArrow(_members, "id long, cls long, n int")
    shared = repeats.filter("chunk is not null and ids is null").groupBy("chunk").applyInArrow(_sum_chunk, "cls long, shared long").groupBy("cls").agg(F.max("shared").alias("shared"))
    first = members.filter("id is not null and n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    going = first.join(shared, "cls").filter("4 * shared >= 3 * n").select("id")

    sent = spark.sparkContext.broadcast(_common(repeats, buckets))
    routed = common.save(common.rows_with(read, common.save(going, "going"), "id").mapInArrow(_route(size, buckets, sent), _ROUTED), "routed")
    sets = routed.filter("h is null").select("cls", "shingles").dropDuplicates(["cls"])
    entries = routed.filter("h is not null").drop("shingles")
    trees = entries.groupBy("h").agg(F.max(F.struct((F.col("hot") / F.col("n")).alias("share"), "cls", "n", "point")).alias("c"), F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("many")).filter("low <> high")
    trees = trees.select("h", "many", F.col("c.cls").alias("centre"), F.col("c.n").alias("c_n"), F.col("c.point").alias("c_point"))
    entries = common.save(entries.join(trees, "h"), "entries")

    near = entries.select("cls", "n", "point", "centre", "c_n", "c_point").mapInArrow(_near_centre, "a long, b long")
    best = near.groupBy("b", "a").agg(F.count("*").alias("trees")).groupBy("b").agg(F.max(F.struct("trees", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    stars = common.save(_verify(best, sets), "stars")
    up = stars.select(F.col("b").alias("cls"), F.col("a").alias("label"))
    up2 = up.join(stars.select(F.col("b").alias("label"), F.col("a").alias("next")), "label", "left").select("cls", F.coalesce("next", "label").alias("label"))
    entries = entries.drop("centre", "c_n", "c_point").join(up2, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    entries = common.save(entries, "labelled")
    mixed = entries.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h")
    mixed = entries.join(mixed, "h")
    small = mixed.filter(F.col("many") <= LEAF).select("h", "cls", "n", "pos", "label", "point").repartition("h").sortWithinPartitions("h").mapInArrow(_small_trees, "a long, b long")
    large = mixed.filter(F.col("many") > LEAF)
    leaves = common.save(_dealt(large).groupBy("h", "deal", "part").applyInArrow(_leaves, _LEAF), "leaves")
    both = tree_pairs(leaves)
    rest = _verify(common.save(both.mapInArrow(_leaf_pairs, "a long, b long").unionByName(small).distinct(), "pairs"), sets)
    return members, stars.unionByName(common.save(rest, "links"))


def groups(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of docs; see similar().

    component_id is the smallest id reachable by links, the row's own for a text without words, null for a null id.
    """
    members, links = similar(docs, size, id_col, text_col)
    classes = common.save(members.filter("id is not null and n > 0").groupBy("cls").agg(F.min("id").alias("least")), "classes")
    # a class goes by its smallest id first, so that a component's smallest node has the smallest id in it
    for c in ("a", "b"):
        links = links.join(classes.select(F.col("cls").alias(c), F.struct("least", "cls").alias(f"node_{c}")), c)
    found = components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).select(F.col("node.cls").alias("cls"), F.col("component.least").alias("component_id"))
    classes = classes.join(found, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    return members.join(classes, "cls", "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Docs without near duplicates: the row with the smallest id of each component stays.

    Of rows with one id one stays (the smallest text); rows with a null id all stay.
    """
    found = groups(docs, id_col=id_col, text_col=text_col).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.expr("doc_id = component_id")).alias("stays"), F.count("*").alias("n"))
    found = common.save(found.filter("not stays or n > 1"), "dropped")
    id_, place = common.fresh("id"), common.fresh("place")
    gone, twice = (found.filter(c).select(F.col("doc_id").alias(id_)) for c in ("not stays", "stays and n > 1"))
    few = found.limit(common.BROADCAST_IDS + 1).count() <= common.BROADCAST_IDS
    hint = F.broadcast if few else lambda df: df
    kept = docs.join(hint(gone), docs[id_col] == F.col(id_), "left_anti")
    if twice.isEmpty():
        return kept
    again = kept.join(hint(twice), docs[id_col] == F.col(id_), "left_semi")
    one = again.withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))).filter(F.col(place) == 1)
    return kept.join(hint(twice), docs[id_col] == F.col(id_), "left_anti").unionByName(one.select(*docs.columns))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones too; see groups() for nulls, empty texts and ties."""
    return groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
