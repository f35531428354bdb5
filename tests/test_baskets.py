import random
from collections import Counter
from itertools import permutations

import pytest

from tallyspark.operators import stale


@pytest.mark.parametrize("block", [1, 4, 500])
def test_pairs_against_brute_force(spark, block):
    rng = random.Random(block)
    baskets = {o: set(rng.sample(range(30), rng.randrange(1, 12))) for o in range(60)} | {1000: set(range(30)), None: {1, 2}}
    targets = {3, 4, 5, 29, 77}
    want = Counter((a, b) for o, items in baskets.items() if o is not None for a, b in permutations(items, 2) if a in targets)
    frame = spark.createDataFrame([(o, v) for o, items in baskets.items() for v in items], "order_id int, variant_id int")
    got = stale.basket_pairs(frame, spark.createDataFrame([(t,) for t in targets], "variant_id int"), block)
    assert {(r.target_id, r.variant_id): r.baskets for r in got.collect()} == want


def test_a_huge_basket_is_many_groups(spark):
    """One basket of 3,000 variants in blocks of 100: no group gets more than a few hundred of its rows, all pairs are counted once."""
    frame = spark.createDataFrame([(1, i) for i in range(3000)], "order_id int, variant_id long")
    targets = spark.range(3000).selectExpr("id as variant_id")
    pairs = stale.basket_pairs(frame, targets, 100)
    assert pairs.count() == 3000 * 2999
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "own" in plan and "other" in plan
