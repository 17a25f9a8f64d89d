"""Joins on similar words and names against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadlattice.functions import similarity
from leadlattice.operators import set_join


def indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    return 200 * row[-1] / (len(a) + len(b))


def words_of(spark, words):
    return spark.createDataFrame([(w,) for w in words], "token string")


@pytest.mark.parametrize(("shortest", "longest", "floor"), [(1, 11, 85.0), (9, 16, 85.0), (20, 40, 85.0), (52, 75, 85.0), (1, 14, 80.0)])
def test_similar_words_of_each_length(spark, shortest, longest, floor):
    rng = random.Random(shortest)
    letters = "abcdefg"
    base = ["".join(rng.choices(letters, k=rng.randint(shortest, longest))) for _ in range(30 if longest < 20 else 4)]

    def changed(w):
        for _ in range(rng.randint(0, 1 + len(w) // 6)):
            i = rng.randint(0, len(w))
            w = w[:i] + rng.choice(["", rng.choice(letters)]) + w[i + rng.randint(0, 1) :]
        return w

    one, two = sorted(set(base)), sorted({changed(w) for w in base for _ in range(3)} | {""})
    want = {(a, b): round(indel(a, b), 9) for a in one for b in two if b and indel(a, b) >= floor}
    got = [(r["a"], r["b"], round(r["ratio"], 9)) for r in similarity.similar_tokens(words_of(spark, one), words_of(spark, two), floor).collect()]
    assert len(got) == len(want) and {(a, b): r for a, b, r in got} == want
    assert similarity.similar_tokens(words_of(spark, []), words_of(spark, two)).count() == 0


def dice(a, b, weight, floor=85):
    """Greedy pairing by plain Python."""
    left, total = sorted(b), 0.0
    for w in sorted(a, key=lambda t: (-weight[t], t)):
        best = max(((indel(w, x), [-ord(c) for c in x], x) for x in left), default=None)
        if best and best[0] >= floor:
            left.remove(best[2])
            total += min(weight[w], weight[best[2]]) * best[0] / 100
    whole = sum(weight[t] for t in a) + sum(weight[t] for t in b)
    return 2 * total / whole if whole else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_no_similar_name_is_lost(spark, seed):
    """Names of 1 to 20 words, some misspelt, of like and of very different weights, in two pools."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(14 if seed else 40)]
    vocabulary = sorted({*base, *(w[:i] + w[i + 1 :] for w in base for i in (0, 3) if len(w) > 6)})
    weight = {w: (1.0 + rng.random() / 5 if seed == 1 else rng.choice([0.0, 0.05, 0.3, 1.0, 2.0, 9.0])) for w in vocabulary}
    pick = lambda: sorted(rng.sample(vocabulary, min(len(vocabulary), rng.choice([1, 1, 2, 3, 4, 5, 6, 9, 20]))))
    one = [(rng.choice("xy"), pick()) for _ in range(60)]
    near = lambda ws: sorted({*(w for w in ws if rng.random() > 0.2), *rng.sample(vocabulary, rng.randint(0, 2))})
    two = [(p, near(ws)) for p, ws in one] + [(rng.choice("xy"), pick()) for _ in range(40)]
    table = lambda rows: spark.createDataFrame([(p, " ".join(ws)) for p, ws in rows] + [(None, "a b"), ("x", "")], "pool string, name string")
    weights = spark.createDataFrame(list(weight.items()), "token string, weight double")
    got = {(r["pool"], r["a"], r["b"]): round(r["agreement"], 6) for r in set_join.similar_names(table(one), table(two), weights, 0.7).collect()}
    heavy = lambda ws: [w for w in ws if weight[w] > 0]
    want = {(p, " ".join(a), " ".join(b)): round(min(1.0, dice(heavy(a), heavy(b), weight)), 6) for p, a in one for q, b in two if p == q and a and b and dice(heavy(a), heavy(b), weight) >= 0.7}
    assert got == want and len(want) > 20


def test_a_common_word_does_not_bring_names_together(spark):
    """All names share a word that is light; the candidates are few all the same."""
    rare = lambda i: F.substring(F.sha2(i.cast("string"), 256), 1, 9)
    names = spark.range(600).select(F.lit("").alias("pool"), F.concat_ws(" ", F.lit("common word"), rare(F.col("id") % 300), rare(F.col("id") % 7 + 1000)).alias("name"))
    weights = spark.sql("SELECT * FROM VALUES ('common', 0.4D), ('word', 0.5D) AS t(token, weight)").union(spark.range(300).select(rare(F.col("id")), F.lit(5.0))).union(spark.range(1000, 1007).select(rare(F.col("id")), F.lit(3.0)))
    words = set_join.weighted_names(names.select("name").distinct(), weights)
    a, b = (names.distinct().join(d, "name") for d in set_join.with_near(words, words))
    assert 600 <= set_join.candidate_names(a, b, 0.7).count() < 1500


def test_words_do_not_meet_by_what_leaves_too_many_letters(spark):
    """400 words have six letters in common, and one pair in ten is similar: all met by the six, and were told apart after that."""
    words = words_of(spark, [f"{x}abcdef{y}" for x in "ghijklmnopqrstuvwxyz" for y in "ghijklmnopqrstuvwxyz"])
    met = similarity._by_dropping(words.toDF("a"), words.toDF("b"), 85.0)
    assert met.count() == 400 * 39
    joins = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.search(r"left#\d+ = left#\d+", line)]
    assert len(joins) == 1 and "length(" not in joins[0]
