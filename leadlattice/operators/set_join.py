"""Joins of names as weighted sets of words, without comparing all that share a word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from itertools import combinations, pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from leadlattice.functions.similarity import TOKEN_FLOOR, similar_tokens
from leadlattice.staging import spread, staged

#: The most words that a key may have, and the most words of a prefix whose subsets of so many words are made.
LEVELS, MOST_WORDS = 4, {1: 1 << 30, 2: 16, 3: 8, 4: 8}


def weighted_names(names: DataFrame, weights: DataFrame) -> DataFrame:
    """(name, words, total) of names (name: different words joined by spaces), words being those with a weight, heaviest first.

    `weights` is (token, weight) without words that tell nothing; a name of only such words goes.
    """
    each = names.select("name", F.explode(F.split("name", " ")).alias("token")).join(weights, "token").where("weight > 0")
    heavy = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("k"), "token"))), lambda w: F.struct(w["token"].alias("token"), (-w["k"]).alias("weight")))
    d = each.groupBy("name").agg(heavy.alias("words"))
    return d.withColumn("total", F.aggregate("words", F.lit(0.0), lambda s, w: s + w["weight"]))


def with_near(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (name, words, total) with `near` at every word: the words of `b` that are similar, with their weight turned about as k, the ratio, and the most that a match weighs."""
    each = lambda d: d.select("name", "total", F.explode("words").alias("w")).select("name", "total", F.col("w.token").alias("token"), F.col("w.weight").alias("weight"))
    mine = each(a)
    own, theirs = (staged(d.select("token", "weight").distinct(), "tokens") for d in (mine, each(b)))
    like = similar_tokens(own.select("token"), theirs.select("token")).join(theirs.toDF("b", "wb"), "b")
    near = F.collect_list(F.struct((-F.col("wb")).alias("k"), F.col("b").alias("token"), (F.least("weight", "wb") * F.col("ratio") / 100).alias("most"), "ratio"))
    known = own.join(like, F.col("token") == F.col("a")).groupBy("token").agg(near.alias("near"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<k: DOUBLE, token: STRING, most: DOUBLE, ratio: DOUBLE>>)")
    told = mine.join(known, "token", "left").groupBy("name", "total").agg(F.collect_list(F.struct("token", "weight", F.coalesce("near", none).alias("near"))).alias("words"))
    itself = lambda w: F.array(F.struct((-w["weight"]).alias("k"), w["token"].alias("token"), w["weight"].alias("most"), F.lit(100.0).alias("ratio")))
    return told, b.select("name", "total", F.transform("words", lambda w: F.struct(w["token"].alias("token"), w["weight"].alias("weight"), itself(w).alias("near"))).alias("words"))


#: An item: the word, the most that it may add itself, and that all from it on, and all after it, may add together.
_Item = tuple[str, float, float, float]


def _plain(values: pa.Array) -> list:
    """Values without nulls as a list, faster than one by one."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _items(batch: pa.RecordBatch) -> Iterator[tuple[list[_Item], list[float]]]:
    """Items and best of the words of each row, from the last item to the first: what each own word may add from there on only grows."""
    words = batch.column("words")
    near = dict(zip((f.name for f in words.values.type), words.values.flatten(), strict=True))["near"]
    flat = dict(zip((f.name for f in near.values.type), near.values.flatten(), strict=True))
    ks, tokens, mosts, within = *(_plain(flat[c]) for c in ("k", "token", "most")), _plain(near.offsets)
    for lo, hi in pairwise(_plain(words.offsets)):
        held = sorted((ks[n], tokens[n], w - lo, mosts[n]) for w in range(lo, hi) for n in range(within[w], within[w + 1]))
        own, made, i = [0.0] * (hi - lo), [], len(held) - 1
        while i >= 0:
            k, token, after, top = held[i][0], held[i][1], sum(own), 0.0
            while i >= 0 and held[i][1] == token and held[i][0] == k:
                own[held[i][2]] = max(own[held[i][2]], held[i][3])
                top = max(top, held[i][3])
                i -= 1
            made.append((token, top, sum(own), after))
        yield made[::-1], sorted(own, reverse=True)


def _listed(values: list, ends: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _itemised(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    of = schema.field("items").type.value_type
    for batch in batches:
        items, ends = [], [0]
        for made, _ in _items(batch):
            items += made
            ends.append(len(items))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*items, strict=True) if items else [()] * len(of), of, strict=True)]
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(of)))
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*(batch.column(n) for n in schema.names[:-1]), listed], schema, strict=True)], schema=schema)


def with_items(names: DataFrame) -> DataFrame:
    """Turns words into items, the words of the other side that a name may match, in one order for all names, heaviest first.

    An item has the most that it may add itself, and that all from it on, and all after it, may add together: each own word counts once in those.
    """
    item = StructType([StructField("token", StringType()), *[StructField(c, DoubleType()) for c in ("most", "on", "after")]])
    made = StructType([*[f for f in names.schema.fields if f.name != "words"], StructField("items", ArrayType(item))])
    return names.mapInArrow(partial(_itemised, schema=to_arrow_schema(made)), made)


def _prefix(items: list[_Item], best: list[float], total: float, level: int, floor: float) -> list[_Item] | None:
    """The first items, of which, at this level, `level` must be shared; None where no such claim holds. `best` is each own word's most.

    Shared items stand in one order. Were fewer than `level` of them in both names' prefixes, the rest would lie beyond the prefix of one
    of both, and all would weigh at most half of the level - 1 heaviest items of each side and what lies beyond. A prefix leaves out as
    much as keeps that below floor / 2 of its name's weight; then two such names stay below the floor.
    """
    room = total * (floor / 2) - sum(best[: level - 1]) / 2 - (1 + total) * 1e-9
    return [i for i in items if i[2] > room] if room >= 0 else None


def _key(whose: str, level: int, shared: tuple[_Item, ...]) -> int:
    return int.from_bytes(blake2b(f"{whose} {level} {' '.join(i[0] for i in shared)}".encode(), digest_size=8).digest(), "little", signed=True)


def _name_keys(items: list[_Item], best: list[float], total: float, side: str, floor: float) -> set[int]:
    """Keys of the subsets of prefixes that may be a pair's first shared items: with all that comes after them they weigh what the floor asks of a name.

    Two names meet at the lower of their highest levels: a key says whose highest level it is. So a name whose heaviest word
    outweighs the rest meets others by that word, and names of several words of like weight by several at once.
    """
    prefixes = [_prefix(items, best, total, 1, floor)]
    while len(prefixes) < LEVELS and (more := _prefix(items, best, total, len(prefixes) + 1, floor)) is not None and len(more) <= MOST_WORDS[len(prefixes) + 1]:
        prefixes.append(more)
    need, keys = total * ((floor - 1e-9) / (2 - floor)) - 1e-9, set()
    for level, prefix in enumerate(prefixes, 1):
        own = level == len(prefixes)
        tags = ("a" if own else "b") if side == "a" else ("ab" if own else "a")
        for shared in combinations(prefix or [], level):
            if shared[-1][3] + sum(i[1] for i in shared) >= need:
                keys.update(_key(whose, level, shared) for whose in tags)
    return keys


def _keyed(batches: Iterator[pa.RecordBatch], side: str, floor: float) -> Iterator[pa.RecordBatch]:
    """(name, total, keys) of names (name, total, words)."""
    for batch in batches:
        keys, ends = [], [0]
        for (items, best), total in zip(_items(batch), batch.column("total").to_pylist(), strict=True):
            keys += _name_keys(items, best, total, side, floor)
            ends.append(len(keys))
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("total"), _listed(keys, ends, pa.int64())], names=["name", "total", "keys"])


def candidate_names(one: DataFrame, two: DataFrame, floor: float, told: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(pool, a, b): all pairs of names of one pool whose fuzzy_dice may reach the floor, each once.

    `one` and `two` are (pool, name, total, words), see with_near; or (pool, name), and `told` has each name's total and words. A name's keys are made once, for all its pools.
    """

    def keyed(d: DataFrame, names: DataFrame, side: str) -> DataFrame:
        keys = staged(spread(names).select("name", "total", "words").mapInArrow(partial(_keyed, side=side, floor=floor), "name string, total double, keys array<long>"), "keys")
        return d.select("pool", "name").join(keys, "name").select("pool", F.col("name").alias(side), F.col("total").alias(f"t{side}"), F.explode("keys").alias("k"))

    names = told or [d.select("name", "total", "words").dropDuplicates(["name"]) for d in (one, two)]
    a, b = (keyed(d, of, side) for d, of, side in zip((one, two), names, "ab", strict=True))
    # What matches weighs no more than the lighter name.
    met = a.join(b, ["pool", "k"]).where(F.least("ta", "tb") * (2 - floor) >= F.greatest("ta", "tb") * (floor - 1e-9))
    return met.select("pool", "a", "b").distinct()


def _agreed(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Pairs (pool, a, b) whose words wa and wb agree as similarity.near_dice has it, with that agreement, from the floor on."""
    for batch in batches:
        words = [batch.column(c) for c in ("wa", "wb")]
        one, two = (dict(zip((f.name for f in w.values.type), w.values.flatten(), strict=True)) for w in words)
        near = dict(zip((f.name for f in one["near"].values.type), one["near"].values.flatten(), strict=True))
        within, theirs, ratios = _plain(one["near"].offsets), _plain(near["token"]), _plain(near["ratio"])
        mine, ma, tokens, mb = _plain(one["token"]), _plain(one["weight"]), _plain(two["token"]), _plain(two["weight"])
        found = []
        for (a0, a1), (b0, b1) in zip(*(pairwise(_plain(w.offsets)) for w in words), strict=True):
            left, matched, total_a, total_b = dict(zip(tokens[b0:b1], mb[b0:b1], strict=True)), 0.0, 0.0, 0.0
            for w in range(a0, a1):
                total_a += ma[w]
            for w in range(b0, b1):
                total_b += mb[w]
            for w in sorted(range(a0, a1), key=lambda w: (-ma[w], mine[w])):
                best = min(((-ratios[n], theirs[n]) for n in range(within[w], within[w + 1]) if ratios[n] >= TOKEN_FLOOR and theirs[n] in left), default=None)
                if best:
                    matched += min(ma[w], left.pop(best[1])) * (-best[0] / 100.0)
            found.append(min(1.0, max(0.0, 2 * matched / (total_a + total_b))) if total_a and total_b else 0.0)
        agreement = pa.array(found, pa.float64())
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pool", "a", "b")), agreement], names=["pool", "a", "b", "agreement"])
        yield out.filter(pc.greater_equal(agreement, floor))


def similar_names(one: DataFrame, two: DataFrame, weights: DataFrame, floor: float) -> DataFrame:
    """(pool, a, b, agreement) of names (pool, name) of two tables whose weighted fuzzy Dice reaches the floor, within a pool.

    Different names are compared, each pair once; pools and words of any size are fine, since a pair must share as many of its
    heaviest words as the floor asks for to meet at all. Null pools and empty names take no part.
    """
    first, second = (d.where("pool is not null and name <> ''").select("pool", "name").distinct() for d in (one, two))
    a, b = (staged(d, "names") for d in with_near(*(staged(weighted_names(d.select("name").distinct(), weights), "words") for d in (first, second))))
    pairs = candidate_names(first, second, floor, (a, b))
    # Of similar words, the agreement asks for those and their ratios alone.
    slim = F.transform("words", lambda w: F.struct(w["token"].alias("token"), w["weight"].alias("weight"), F.transform(w["near"], lambda n: F.struct(n["token"].alias("token"), n["ratio"].alias("ratio"))).alias("near")))
    told = pairs.join(a.select(F.col("name").alias("a"), slim.alias("wa")), "a").join(b.select(F.col("name").alias("b"), F.transform("words", lambda w: F.struct(w["token"].alias("token"), w["weight"].alias("weight"))).alias("wb")), "b")
    return spread(told.select("pool", "a", "b", "wa", "wb")).mapInArrow(partial(_agreed, floor=floor), "pool string, a string, b string, agreement double")
