import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.operators import ordering


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_row_numbers(spark, parts):
    rng = random.Random(1)
    keys = [(rng.randrange(50), i) for i in range(500)] + [(None, 1000)]
    rng.shuffle(keys)
    frame = spark.createDataFrame(keys, "a int, b int").repartition(5)
    got = ordering.row_numbers(frame, ["a", "b"], parts=parts).collect()
    want = sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.row)] == want and {r.row for r in got} == set(range(1, 502))
    assert ordering.row_numbers(frame.limit(0), ["a"]).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.lists(st.integers(0, 40), max_size=6), st.integers(1, 6), st.integers(1, 20))
def test_linking_partitions_equals_one_pass(sizes, cuts, most, largest):
    """Any cut into partitions, also empty ones, packs like one pass over all."""
    cuts = sorted(min(c, len(sizes)) for c in cuts)
    at, held, chars, got = -1, most, largest + 1, []
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        part = np.array(sizes[a:b], np.int64)
        if not len(part):
            continue
        rows = ordering.summary(part, most, largest)
        assert len(rows) <= most + 2
        first = ordering.first_new([r[1] for r in rows], held, chars, most, largest)
        _, after = ordering.following(part, most, largest)
        numbers, i, number = [at] * first, first, at
        while i < len(part):
            number += 1
            numbers += [number] * int(after[i] - i)
            i = int(after[i])
        got += numbers
        _, _, begun, items, total = rows[first]
        at += begun
        held, chars = (items, total) if begun else (held + items, chars + total)
    assert got == list(ordering.greedy(sizes, most, largest))


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_batches_over_partitions(spark, parts):
    rng = random.Random(2)
    sizes = [rng.choice([1, 5, 40, 90, 200, None]) for _ in range(700)]
    frame = spark.createDataFrame(list(enumerate(sizes)), "id int, chars int").repartition(6)
    got = ordering.batches(frame, "chars", ["id"], 8, 150, parts)
    assert got.columns == ["id", "chars", "batch"]
    rows = sorted(got.collect())
    assert [r.batch for r in rows] == list(ordering.greedy([s or 0 for s in sizes], 8, 150))
    assert ordering.batches(frame.limit(0), "chars", ["id"], 8, 150).collect() == []
