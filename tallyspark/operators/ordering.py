"""Numbers that follow an order over all rows, without one task that sees all rows.

Rows are range-partitioned and sorted, and written with their partition and place. What a partition needs to know of those
before it is then small: how many rows they have, or how they would pack, whatever they begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import written

_PART, _PLACE = "__part", "__place"


def _placed(rows: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """rows in the order of keys (nulls first), with their partition and place in it, written."""
    ordered = rows.repartitionByRange(*([parts] if parts else []), *map(F.col, keys)).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(ordered.select("*", F.spark_partition_id().cast("long").alias(_PART), place.alias(_PLACE)), "ordered")


def row_numbers(rows: DataFrame, keys: list[str], name: str = "row", parts: int | None = None) -> DataFrame:
    """rows with their number, from 1, in the order of keys; rows with equal keys are numbered in any order."""
    placed = _placed(rows, keys, parts)
    before = F.coalesce(F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(_PART).agg(F.count("*").alias("n")).select(_PART, before.alias("__before"))  # a row a partition
    return placed.join(starts, _PART).withColumn(name, F.col("__before") + F.col(_PLACE) + 1).drop(_PART, _PLACE, "__before")


def following(sizes: np.ndarray, most: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of sizes, and for each item the first one that does not fit in a batch that begins with it; an item over the limit is a batch."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    end = np.searchsorted(total, total[:-1] + largest, side="right") - 1
    return total, np.minimum(np.maximum(end, np.arange(n) + 1), np.minimum(np.arange(n) + most, n))


def summary(sizes: np.ndarray, most: int, largest: int) -> list[tuple[int, int, int, int, int]]:
    """How a partition packs if its first new batch begins with item b, for each b that can be: (b, characters before it, batches begun, items and characters of the last one).

    A batch has `most` items at most, so b is at most that; b = the number of items says that all fit in the batch before.
    """
    total, after = following(sizes, most, largest)
    n = len(sizes)
    at = np.arange(min(most, n - 1) + 1 if n else 0)
    start, last, begun = at.copy(), at.copy(), np.zeros(len(at), np.int64)
    while len(at) and (at < n).any():
        on = at < n
        last[on], begun[on] = at[on], begun[on] + 1
        at[on] = after[at[on]]
    out = [(int(b), int(total[b]), int(k), int(n - i), int(total[n] - total[i])) for b, k, i in zip(start, begun, last, strict=True)]
    if n <= most:
        out.append((n, int(total[n]), 0, n, int(total[n])))
    return out


def first_new(before: list[int], items: int, chars: int, most: int, largest: int) -> int:
    """The first item that does not fit in a batch that has so many items and characters already; before[b]: characters before item b."""
    b = 0
    while b + 1 < len(before) and items + b + 1 <= most and chars + before[b + 1] <= largest:
        b += 1
    return b


def batches(items: DataFrame, size_col: str, keys: list[str], most: int, largest: int, parts: int | None = None) -> DataFrame:
    """items with their batch, from 0: in the order of keys each batch takes items as long as it has at most `most` and `largest` in sizes.

    Two passes: each partition says how it would pack after any batch left open before it (at most `most` + 2 rows), the
    driver links these in order, and each partition then numbers its items. keys must tell items apart; a null size is 0.
    """
    placed = _placed(items.withColumn("__size", F.coalesce(F.col(size_col).cast("long"), F.lit(0))), keys, parts)

    def sized(table: pa.Table) -> np.ndarray:
        return table.column("__size").to_numpy()[np.argsort(table.column(_PLACE).to_numpy(), kind="stable")]

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        rows = summary(sized(table), most, largest)
        return pa.table({_PART: [key[0].as_py()] * len(rows)} | {c: [r[i] for r in rows] for i, c in enumerate(("b", "before", "begun", "items", "chars"))})

    found: dict[int, list] = {}
    for r in placed.select(_PART, _PLACE, "__size").groupBy(_PART).applyInArrow(summed, f"{_PART} long, b long, before long, begun long, items long, chars long").toLocalIterator():
        found.setdefault(r[_PART], []).append(r)
    opened, at, held, chars = [], -1, most, largest + 1  # nothing fits in the batch before the first
    for part in sorted(found):
        rows = sorted(found[part], key=lambda r: r.b)
        b = first_new([r.before for r in rows], held, chars, most, largest)
        row = rows[b]
        opened.append((part, at, b))
        at += row.begun
        held, chars = (row.items, row.chars) if row.begun else (held + row.items, chars + row.chars)
    starts = items.sparkSession.createDataFrame(opened, f"{_PART} long, __open long, __first long")

    def numbered(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(_PLACE).to_numpy(), kind="stable")
        sizes = table.column("__size").to_numpy()[order]
        _, after = following(sizes, most, largest)
        batch = np.full(len(sizes), table.column("__open")[0].as_py())
        i, number = table.column("__first")[0].as_py(), int(batch[0]) if len(batch) else 0
        while i < len(sizes):
            number += 1
            batch[i : after[i]] = number
            i = int(after[i])
        return pa.table({_PART: table.column(_PART).to_numpy(), _PLACE: table.column(_PLACE).to_numpy()[order], "batch": batch})

    numbers = placed.select(_PART, _PLACE, "__size").join(F.broadcast(starts), _PART).groupBy(_PART).applyInArrow(numbered, f"{_PART} long, {_PLACE} long, batch long")
    return placed.join(numbers, [_PART, _PLACE]).drop(_PART, _PLACE, "__size")


def greedy(sizes: Iterator[int], most: int, largest: int) -> Iterator[int]:
    """The batch of each size, one after another: what batches() gives over partitions."""
    batch, n, total = -1, most, 0
    for size in sizes:
        if n >= most or total + size > largest:
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + size
        yield batch
