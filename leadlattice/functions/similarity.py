"""String and set similarity as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlattice.functions.text import let
from leadlattice.staging import spread

#: Words of at least this similarity count as one, with misspellings.
TOKEN_FLOOR = 85.0


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda ch: ch != "")


def _lcs_by_rows(a: Column, b: Column) -> Column:
    """Row by row of the table, for strings of any length."""

    def last(v: Column) -> Column:
        def row(before: Column, ch: Column) -> Column:
            def cell(done: Column, j: Column) -> Column:
                here = F.when(F.element_at(v["ys"], j) == ch, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(done, j), F.element_at(before, j + 1)))
                return F.concat(done, F.array(here))

            return F.aggregate(F.sequence(F.lit(1), F.size(v["ys"])), F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(v["xs"], F.array_repeat(F.lit(0), F.size(v["ys"]) + 1), row), -1)

    return let(F.struct(_chars(a).alias("xs"), _chars(b).alias("ys")), last)


def _lcs_by_bits(a: Column, b: Column) -> Column:
    """A whole row of the table at a time, as the bits of a number, for `a` of at most BITS characters."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def places(xs: Column) -> Column:
        """Where each character stands, as bits."""
        of = lambda ch: F.aggregate(xs, F.struct(zero.alias("m"), one.alias("bit")), lambda s, c: F.struct(F.when(c == ch, s["m"] + s["bit"]).otherwise(s["m"]).alias("m"), (s["bit"] * 2).alias("bit")), lambda s: s["m"])
        return F.map_from_entries(F.transform(F.array_distinct(xs), lambda ch: F.struct(ch.alias("k"), of(ch).alias("v"))))

    def length(v: Column) -> Column:
        def row(bits: Column, ch: Column) -> Column:
            hit = bits.bitwiseAND(F.coalesce(F.try_element_at(v["places"], ch), zero))
            return (bits + hit).bitwiseOR(bits - hit).bitwiseAND(v["full"])

        return F.length(a) - F.bit_count(F.aggregate(_chars(b), v["full"], row))

    return let(F.struct(let(_chars(a), places).alias("places"), (F.pow(F.lit(2.0), F.length(a)).cast("long") - 1).alias("full")), length)


#: Places in a long that leave room for a carry.
BITS = 62


def lcs_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence."""
    n, m = F.length(a), F.length(b)
    return F.when((n == 0) | (m == 0), 0).when(a == b, n).when(n <= BITS, _lcs_by_bits(a, b)).when(m <= BITS, _lcs_by_bits(b, a)).otherwise(_lcs_by_rows(a, b))


def ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (len a + len b): 100 for equal strings, 0 for two empty ones' lack of anything to compare with one."""
    total = F.length(a) + F.length(b)
    return F.when(a == b, 100.0).when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs_length(a, b) / total)


def bounded_ratio(a: Column, b: Column, floor: float) -> Column:
    """As ratio, and 0 where the lengths alone keep it below the floor, so that most pairs need no table."""
    most = F.lit(200.0) * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))
    return F.when(a == b, 100.0).when(most < floor, 0.0).otherwise(ratio(a, b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """How alike two token arrays are as sets: 100 if one holds the other, else the best of three ratios of joined parts."""

    def of(v: Column) -> Column:
        i, m, n = F.length(v["both"]), F.length(v["one"]), F.length(v["two"])
        gap = F.when(i > 0, 1).otherwise(0)
        whole_m, whole_n = i + gap + m, i + gap + n
        r0 = F.lit(100.0) * (1 - (m + n - 2 * lcs_length(v["one"], v["two"])) / (whole_m + whole_n))
        r1, r2 = (F.lit(100.0) * (1 - (1 + part) / (i + whole)) for part, whole in ((m, whole_m), (n, whole_n)))
        return F.when((i > 0) & ((m == 0) | (n == 0)), 100.0).when(i == 0, r0).otherwise(F.greatest(r0, r1, r2))

    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ")
    parts = F.struct(joined(F.array_intersect(a, b)).alias("both"), joined(F.array_except(a, b)).alias("one"), joined(F.array_except(b, a)).alias("two"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(parts, of))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def exact_dice(a: Column, b: Column, weights: Column, total_a: Column, total_b: Column) -> Column:
    """Weighted Dice over equal words of two token arrays; `weights` maps the tokens of `a`, totals sum each side's weights."""
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, t: s + F.element_at(weights, t))
    return F.when((total_a == 0) | (total_b == 0), 0.0).when(~F.arrays_overlap(a, b), 0.0).otherwise(F.least(F.lit(1.0), 2 * shared / (total_a + total_b)))


def fuzzy_dice(a: Column, b: Column, floor: float = TOKEN_FLOOR) -> Column:
    """Weighted Dice in which words pair up greedily: the most telling word of `a` first takes its most similar one left of `b`.

    Ties go to the smaller token, on both sides, so the result doesn't depend on any order of input.
    """
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + w["weight"])
    ranked = F.transform(F.array_sort(F.transform(a, lambda w: F.struct((-w["weight"]).alias("k"), w["token"].alias("token"), w["weight"].alias("weight")))), lambda w: F.struct(w["token"].alias("token"), w["weight"].alias("weight")))

    def take(state: Column, mine: Column) -> Column:
        scored = F.transform(state["left"], lambda w: F.struct((-bounded_ratio(mine["token"], w["token"], floor)).alias("k"), w["token"].alias("token"), w["weight"].alias("weight")))
        best = F.array_min(scored)
        hit = F.coalesce(-best["k"] >= floor, F.lit(False))
        left = F.when(hit, F.filter(state["left"], lambda w: w["token"] != best["token"])).otherwise(state["left"])
        more = F.when(hit, F.least(mine["weight"], best["weight"]) * (-best["k"] / 100.0)).otherwise(0.0)
        return F.struct((state["sum"] + more).alias("sum"), left.alias("left"))

    start = F.struct(F.lit(0.0).alias("sum"), F.transform(b, lambda w: F.struct(w["token"].alias("token"), w["weight"].alias("weight"))).alias("left"))
    matched = F.aggregate(ranked, start, take, lambda s: s["sum"])
    return F.when((total(a) == 0) | (total(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * matched / (total(a) + total(b)))))


def near_dice(a: Column, b: Column, floor: float = TOKEN_FLOOR) -> Column:
    """As fuzzy_dice, where each word of `a` brings its similar ones of the other side's vocabulary, near (token, ratio): no words are compared letter by letter."""
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + w["weight"])
    ranked = F.array_sort(F.transform(a, lambda w: F.struct((-w["weight"]).alias("k"), w["token"].alias("token"), w["weight"].alias("weight"), w["near"].alias("near"))))

    def take(state: Column, mine: Column) -> Column:
        near = F.filter(mine["near"], lambda n: (n["ratio"] >= floor) & F.array_contains(state["left"], n["token"]))
        best = F.array_min(F.transform(near, lambda n: F.struct((-n["ratio"]).alias("k"), n["token"].alias("token"))))
        theirs = F.element_at(F.filter(b, lambda w: w["token"] == best["token"]), 1)["weight"]
        more = F.when(best.isNotNull(), F.least(mine["weight"], theirs) * (-best["k"] / 100.0)).otherwise(0.0)
        return F.struct((state["sum"] + more).alias("sum"), F.when(best.isNotNull(), F.array_remove(state["left"], best["token"])).otherwise(state["left"]).alias("left"))

    start = F.struct(F.lit(0.0).alias("sum"), F.transform(b, lambda w: w["token"]).alias("left"))
    matched = F.aggregate(ranked, start, take, lambda s: s["sum"])
    return F.when((total(a) == 0) | (total(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * matched / (total(a) + total(b)))))


#: Words up to SHORT letters meet by what is left of them when letters are dropped; up to LONG by segments; beyond by pairs of letters.
SHORT, LONG = 11, 60


def _unmatched(n: Column, m: Column, floor: float) -> Column:
    """The most letters that two words of n and m letters may leave unmatched at the floor: of one parity with n + m."""
    most = F.floor(F.lit(1 - floor / 100 + 1e-9) * (n + m))
    return most - (most + n + m) % 2


def _dropped(c: Column, n: Column, share: float) -> Column:
    """What is left of a word when up to n * share of its letters are dropped, in every way."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = lambda ws: F.array_distinct(F.flatten(F.transform(ws, without)))
    levels = [F.array(c)]
    while len(levels) <= int(SHORT * share):
        levels.append(once(levels[-1]))
    none = F.slice(F.array(c), 1, 0)
    return F.flatten(F.array(levels[0], *[F.when(F.floor(n * F.lit(share + 1e-9)) >= k, level).otherwise(none) for k, level in enumerate(levels) if k]))


def _by_dropping(a: DataFrame, b: DataFrame, floor: float) -> DataFrame:
    """Pairs of words up to SHORT letters. Their longest common subsequence is one of the shared leftovers, so its length needs no table.

    What is left says for which length of the other word it will do, so that words with more letters unmatched don't meet by it.
    """
    share = 1 - floor / (200 - floor)
    n, m = F.length("a"), F.length("b")

    def left(d: DataFrame, c: str, own: str, other: str, others: DataFrame) -> DataFrame:
        sizes = F.broadcast(others.where(F.length(F.col(others.columns[0])).between(1, SHORT)).select(F.length(others.columns[0]).alias(other)).distinct())
        each = spread(d.where(F.length(c).between(1, SHORT))).select(c, F.length(c).alias(own), F.explode(_dropped(F.col(c), F.length(c), share)).alias("left"))
        enough = (F.col(other) >= F.length("left")) & (F.col(own) + F.col(other) - 2 * F.length("left") <= _unmatched(F.col(own), F.col(other), floor))
        return each.join(sizes, enough)

    met = left(a, "a", "n", "m", b).join(left(b, "b", "m", "n", a), ["left", "n", "m"])
    return met.groupBy("a", "b").agg(F.max(F.length("left")).alias("common")).select("a", "b", (F.lit(200.0) * F.col("common") / (n + m)).alias("ratio"))


def _by_segments(a: DataFrame, b: DataFrame, floor: float) -> DataFrame:
    """Candidates among words up to LONG letters of which one has more than SHORT.

    With at most u unmatched letters, one of u + 1 segments of `b` stands whole in `a`, moved no further than letters of one
    side go unmatched. u follows from both lengths, so words look for partners of each length apart.
    """
    least = floor / (200 - floor)
    both = lambda d, c, own, other: d.where(F.length(c).between(1, LONG)).select(
        c, F.length(c).alias(own), F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.length(c) * F.lit(least - 1e-9))).cast("int"), F.least(F.lit(LONG), F.floor(F.length(c) / F.lit(least - 1e-9))).cast("int"))).alias(other)
    ).where(F.greatest(own, other) > SHORT)
    parted = lambda d: d.withColumn("u", _unmatched(F.col("n"), F.col("m"), floor)).where("u >= 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("u"))))
    start, end = F.expr("k * m div (u + 1)"), F.expr("(k + 1) * m div (u + 1)")
    segments = parted(both(b, "b", "m", "n")).select("b", "n", "m", "k", F.substring("b", start + 1, end - start).alias("part"))
    moved = F.sequence(F.expr("-((u - n + m) div 2)"), F.expr("(u + n - m) div 2"))
    wanted = parted(both(a, "a", "n", "m")).where(F.abs(F.col("n") - F.col("m")) <= F.col("u")).withColumn("at", F.explode(F.transform(moved, lambda s: s + start))).where((F.col("at") >= 0) & (F.col("at") + end - start <= F.col("n")))
    return wanted.select("a", "n", "m", "k", F.substring("a", F.col("at") + 1, end - start).alias("part")).distinct().join(segments, ["n", "m", "k", "part"]).select("a", "b").distinct()


def _by_letters(a: DataFrame, b: DataFrame, floor: float) -> DataFrame:
    """Candidates of which one has more than LONG letters: their common letters stand in fewer runs than there are letters, so some run has two."""
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    each = lambda d, c: d.where(F.length(c) > int(LONG * floor / (200 - floor))).select(c, F.explode(F.array_distinct(pairs(F.col(c)))).alias("pair"))
    most = F.lit(200.0) * F.least(F.length("a"), F.length("b")) / (F.length("a") + F.length("b"))
    return each(a, "a").join(each(b, "b"), "pair").where((F.greatest(F.length("a"), F.length("b")) > LONG) & (most >= floor)).select("a", "b").distinct()


def similar_tokens(one: DataFrame, two: DataFrame, floor: float = TOKEN_FLOOR) -> DataFrame:
    """(a, b, ratio) of the tokens of two tables (token) whose ratio reaches the floor, from 80 on.

    Vocabularies are compared, not rows, and words meet by what similar ones must share, never all with all: short words, nearly all of
    them, by leftovers when letters are dropped, longer ones by segments, very long ones by pairs of letters.
    """
    a, b = one.select(F.col("token").alias("a")).where("a <> ''").distinct(), two.select(F.col("token").alias("b")).where("b <> ''").distinct()
    met = _by_segments(a, b, floor).unionByName(_by_letters(a, b, floor)).withColumn("ratio", bounded_ratio(F.col("a"), F.col("b"), floor)).where(F.col("ratio") >= floor)
    return _by_dropping(a, b, floor).unionByName(met)
