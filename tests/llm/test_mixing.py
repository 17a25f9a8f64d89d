"""The mix against plain versions: draws by shard, exact sums, small sources, repeated rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_ops import waterfill

from leadlattice.llm import mixing

TABLE = "doc_id long, text string, source string, lang string, n_chars long, block long"


def doc(i, n, source):
    return (i, " ".join(f"w{i}x{k}" for k in range(n)), source, "en", 0, 7)


def test_shards_draw_multinomial_counts_with_exact_sums(spark):
    want = {0: 6000, 1: 3000, 2: 990, 3: 10, 4: 0}
    sources = spark.createDataFrame([(s, n, max(1, n // 2)) for s, n in want.items()], "s int, n_slots long, n_blocks long")
    got = mixing.slots(sources, shard_slots=100).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(i // 100, i % 100) for i in range(10_000)]
    assert Counter(r["s"] for r in got) == Counter({s: n for s, n in want.items() if n})
    for s in (0, 1, 2, 3):
        blocks = Counter(r["block"] for r in got if r["s"] == s)
        assert set(blocks) == set(range(want[s] // 2))
        assert set(blocks.values()) == {2}
    by_shard = defaultdict(Counter)
    for r in got:
        by_shard[r["shard"]][r["s"]] += 1
    # Counts of a source with probability p in 100 shards of 100 slots: mean 100 p, variance 100 p (1 - p).
    for s, p in ((0, 0.6), (1, 0.3)):
        counts = [by_shard[k][s] for k in range(100)]
        variance = sum((c - 100 * p) ** 2 for c in counts) / 100
        assert 0.6 < variance / (100 * p * (1 - p)) < 1.5
    again = mixing.slots(sources.repartition(3), shard_slots=100).collect()
    assert sorted(again) == sorted(got)


def test_small_sources_come_near_their_targets(spark):
    data = [doc(i, 30, "big") for i in range(400)] + [doc(1000 + i, 20, "small") for i in range(3)] + [doc(2000, 60, "tiny"), doc(3000, 1, None)]
    size = {"big": 12_000, "small": 60, "tiny": 60, None: 1}
    got = mixing.mix(spark.createDataFrame(data, TABLE)).collect()
    of = {d[0]: d[2] for d in data}
    taken = Counter()
    for r in got:
        taken[of[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
        assert (r["first_shard"] is not None) == (r["taken"] > 0)
    for s, want in waterfill(size).items():
        assert abs(taken[s] - want) <= max(1, 0.05 * want), (s, taken[s], want)


def test_targets_below_the_size_of_small_sources(spark):
    data = [doc(0, 60, "a"), doc(1, 40, "b"), doc(2, 3000, "c")] + [doc(10 + i, 500, "d") for i in range(9)]
    size = {"a": 60, "b": 40, "c": 3000, "d": 4500}
    taken = Counter()
    of = {d[0]: d[2] for d in data}
    for r in mixing.mix(spark.createDataFrame(data, TABLE)).collect():
        taken[of[r["doc_id"]]] += r["taken"]
    for s, want in waterfill(size).items():
        assert abs(taken[s] - want) <= max(1, 0.05 * want), (s, taken[s], want)


def test_mixed_documents_keep_repeated_rows_nulls_and_columns(spark):
    rng = random.Random(1)
    data = [doc(rng.choice([1, 2, None]), 50, rng.choice(["a", None])) for _ in range(60)] + [(None, None, None, None, None, None), (5, "", "a", "en", 0, 7)]
    d = spark.createDataFrame(data, TABLE)
    want = Counter()
    for r in mixing.mix(d, block_words=8).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    mixed = mixing.mixed_documents(d, block_words=8)
    assert mixed.columns == d.columns
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        assert r["block"] == 7
        got[r["doc_id"]] += len(r["text"].split())
    assert got == want
    assert mixing.mixed_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("total", [1, 5, 5000])
def test_numbers_meet_their_range(spark, total):
    ranges = spark.createDataFrame([(0, 0, total // 3), (1, total // 3, total // 3), (2, total // 3, total)], "s int, lo long, hi long")
    got = mixing._met(spark.range(total).withColumn("at", F.col("id")), "at", ranges, total).collect()
    assert sorted((r["at"], r["s"]) for r in got) == [(i, 0 if i < total // 3 else 2) for i in range(total)]
