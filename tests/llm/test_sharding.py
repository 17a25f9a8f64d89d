"""Shards' law on repeated rows and other hot groups."""

from collections import Counter, defaultdict

import pytest

from leadlattice.llm import sharding

CASES = {
    "equal rows": [(7, "the same text")] * 400 + [(None, None)] * 200 + [(i, f"text {i}") for i in range(100)],
    "one row many times": [(1, "a")] * 500,
    "copies": [(i, "copy of a text") for i in range(400)] + [(1000 + i, f"other {i} " * (i % 9)) for i in range(400)],
    "a long one": [(1, "x" * 3000), *[(2, "yy")] * 300, *[(3, "yy")] * 300],
}


@pytest.mark.parametrize("name", CASES)
def test_shards_are_near_equal(spark, name):
    data = CASES[name]
    size = lambda t: len((t or "").encode()) + 1
    got = sharding.shard(spark.createDataFrame(data, "doc_id long, text string").repartition(3), shards=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t in data)
    filled, slots = Counter(), defaultdict(list)
    for r in got:
        filled[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(filled.values()) / 4
    largest = max(size(t) for _, t in data)
    assert max(filled.values()) <= 1.1 * mean + largest
    if largest < mean / 10:
        assert min(filled[k] for k in range(4)) >= 0.9 * mean - largest
