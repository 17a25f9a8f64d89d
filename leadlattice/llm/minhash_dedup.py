"""Near-duplicate documents by banded MinHash, odd sketches and exact verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlattice.llm.common import materialize, prefix_sums
from leadlattice.llm.components import connected_components

#: 25 bands of 5 values find a pair of similarity 0.8 with probability 1 - 5e-5.
BANDS, ROWS = 25, 5
SKETCH_BITS = 512
#: A pair of similarity 0.8 differs in 45 sketch bits on average, with a deviation of 10: five of them are allowed.
SKETCH_LIMIT = 95
#: Bits of the parity bitmap of a whole set, and members that each bucket is compared with at first.
PARITY_BITS, PIVOTS = 1024, 4
_U64 = np.uint64
_STEP = _U64(0x9E3779B97F4A7C15)
_CACHE_LIMIT = 400_000


class _WordHashes(dict):
    """Word bytes to 64-bit hash; emptied when it has grown large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def words(text: str) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space (the bytes 0x20 and 0x09 to 0x0D)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(tokens: list[bytes], hashes: _WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle as a whole."""
    t = np.fromiter(map(hashes.__getitem__, tokens), _U64, len(tokens))
    n = max(1, len(t) - width + 1)
    h = np.full(n, len(tokens) if len(tokens) < width else width, _U64)
    for i in range(min(width, len(t))):
        h = h * _STEP + t[i : i + n]
    return np.unique(_mix(h))


def _multipliers() -> np.ndarray:
    return _mix(np.arange(1, BANDS * ROWS + 1, dtype=_U64) * _STEP) | _U64(1)


def minhash(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One minimum per multiplier, over blocks so that long texts need no more memory than short ones."""
    best = np.full(len(multipliers), ~_U64(0), _U64)
    for i in range(0, len(shingles), 2048):
        block = shingles[i : i + 2048, None] * multipliers
        block ^= block >> _U64(29)
        np.minimum(best, block.min(axis=0), out=best)
    return best


def band_keys(mins: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=_U64)
    for column in mins.reshape(BANDS, ROWS).T:
        h = _mix(h * _STEP + column)
    return h.view(np.int64)


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """The parity of how often each of 512 places is hit by a (position, minimum) pair, as eight words."""
    place = _mix(mins + np.arange(1, len(mins) + 1, dtype=_U64) * _STEP) % _U64(SKETCH_BITS)
    odd = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each place. Two bitmaps differ in no more bits than their sets in shingles."""
    odd = np.bincount((_mix(shingles + _STEP) % _U64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, same, n_shingles, bands, sketch, parity) of every row: `same` is a digest of the words in order, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, multipliers = _WordHashes(), _multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, same, sizes, bands, sketches, parities = [], [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    tokens = words(text.as_py() or "")
                    shingles = shingle_hashes(tokens, hashes, width) if tokens else np.zeros(0, _U64)
                    mins = minhash(shingles, multipliers) if tokens else None
                    ids.append(doc_id)
                    same.append(xxhash.xxh3_128_digest(b" ".join(tokens)) if tokens else None)
                    sizes.append(len(shingles))
                    bands.append(band_keys(mins) if tokens else np.zeros(0, np.int64))
                    sketches.append(odd_sketch(mins) if tokens else np.zeros(0, np.int64))
                    parities.append(parity_bitmap(shingles) if tokens else np.zeros(0, np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x))) for x in (bands, sketches, parities)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "same", "n_shingles", "bands", "sketch", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, same binary, n_shingles long, bands array<long>, sketch array<long>, parity array<long>")


def similar_pairs(docs: DataFrame, pairs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets reach the share: den * intersection >= num * union."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            kept: tuple[list, list] = ([], [])
            for a, b, one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = (shingle_hashes(words(t.as_py()), hashes, width) for t in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    kept[0].append(a)
                    kept[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in kept], ["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("two")), "b")
    return joined.select("a", "b", "one", "two").mapInArrow(run, "a long, b long").distinct()


def _differing(one: Column, two: Column, bits: int) -> Column:
    first, *rest = [F.bit_count(one[i].bitwiseXOR(two[i])) for i in range(bits // 64)]
    return sum(rest, first)


def _may_link(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether sizes, parity bitmaps and odd sketches allow the share. The first two never reject a linked pair.

    At the share, sets of sizes x and y differ in at most (x + y) (den - num) / (den + num) shingles, and their
    bitmaps in no more bits. An id that has several texts passes.
    """
    num, den = share
    one, two = F.col(a), F.col(b)
    fits = (den * one["n"] >= num * two["n"]) & (den * two["n"] >= num * one["n"])
    near = _differing(one["parity"], two["parity"], PARITY_BITS) * (den + num) <= (one["n"] + two["n"]) * (den - num)
    sketch = _differing(one["sketch"], two["sketch"], SKETCH_BITS) <= SKETCH_LIMIT
    return one["several"] | two["several"] | (fits & near & sketch)


def near_duplicates(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs without ASCII white space. A text's set holds its distinct shingles of
    `width` words; a shorter text is one shingle; null texts and those without words have an empty set
    (n_shingles 0) and link with nothing. Two documents are linked if their sets' Jaccard similarity is at least
    the share, confirmed on the full sets. component_id is the smallest doc_id that links reach, the document's
    own without links; kept marks the document with that id, one of each group. Rows of equal doc_id are one
    document and share its component; a null doc_id links with nothing, has a null component and is kept. An empty
    table gives an empty one; further columns are ignored.

    Texts of equal words are one class. Classes meet in bands of five MinHash values; each class has an odd
    sketch, the parity bitmap of its values, and the XOR population count of two sketches rejects far pairs; so does,
    without error, the count over bitmaps of the whole sets. A bucket is never expanded into all pairs: each member meets
    a few pivots first, components are formed, and then the join emits only members of one bucket that are still
    apart and that the bitmaps let pass. So large groups cost about their size, and yet every pair that shares a band is
    linked, joined through others, or rejected by a bitmap or by its sets.
    """
    spark_docs = docs.select("doc_id", "text")
    signed = materialize(signatures(spark_docs, width), "signed")
    linkable = signed.where("doc_id is not null and same is not null")
    classes = materialize(
        linkable.groupBy("same").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("bands", "sketch", "parity")]), "classes"
    )
    entries = classes.select(F.explode("bands").alias("key"), "id")
    pivots = F.array_distinct(F.array(F.min("id"), *[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(1, PIVOTS)]))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), pivots.alias("pivots")).where("c > 1")
    members = materialize(entries.join(shared, "key").select("key", "id", "pivots"), "members")
    about = classes.groupBy("id").agg(F.max("n").alias("n"), (F.count(F.lit(1)) > 1).alias("several"), F.min("sketch").alias("sketch"), F.min("parity").alias("parity"))
    about = materialize(about.join(members.select("id").distinct(), "id", "left_semi").select("id", F.struct("n", "several", "sketch", "parity").alias("at")), "about")
    texts = materialize(spark_docs.where("doc_id is not null and text is not null").join(about.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "texts")
    sides = [about.select(F.col("id").alias(s), F.col("at").alias(f"at_{s}")) for s in "ab"]
    ordered = lambda one, two: (F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))

    first = members.select("id", F.explode("pivots").alias("pivot")).where("id <> pivot").select(*ordered(F.col("id"), F.col("pivot"))).distinct()
    tried = materialize(first.join(sides[0], "a").join(sides[1], "b").where(_may_link("at_a", "at_b", share)).select("a", "b"), "pairs")
    links = materialize(similar_pairs(texts, tried, width, share), "links")
    comps = connected_components(links).withColumnRenamed("node", "id")
    parted = members.select("key", "id").distinct().join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = parted.groupBy("key").agg((F.min("component") < F.max("component")).alias("open")).where("open").select("key")
    parted = materialize(parted.join(open_keys, "key").join(about, "id"), "parted")
    one, two = (parted.select("key", F.col("id").alias(f"id_{s}"), F.col("component").alias(f"of_{s}"), F.col("at").alias(f"at_{s}")) for s in "ab")
    met = one.join(two, (one["key"] == two["key"]) & (F.col("of_a") < F.col("of_b")) & _may_link("at_a", "at_b", share))
    fresh = materialize(met.select(*ordered(F.col("id_a"), F.col("id_b"))).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = materialize(similar_pairs(texts, fresh, width, share), "links")
    if not more.isEmpty():
        comps = connected_components(links.union(more)).withColumnRenamed("node", "id")
    by_class = classes.select("same", "id").join(comps, "id", "left").select("same", F.coalesce("component", "id").alias("of_class"))
    of_doc = linkable.join(by_class, "same").groupBy("doc_id").agg(F.min("of_class").alias("of_doc"))
    found = signed.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("of_doc", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs, all columns, that stand for their group: one of each group of near-duplicate texts.

    Of a group the row of the smallest doc_id stays. Rows of equal doc_id and text are one; of them the one of least hash over
    all columns stays. Different texts of one doc_id are judged each by its own text; those but one
    count as larger than all other ids. Rows without a doc_id stay, and so do texts without words. An empty table gives an empty one.
    """
    named = docs.where("doc_id is not null").withColumn("_mark", F.xxhash64("text"))
    texts = named.select("doc_id", "_mark").distinct()
    nth = materialize(prefix_sums(texts, ["doc_id"], ["_mark"], F.lit(1), "_nth").select(F.col("doc_id").cast("long").alias("_of"), F.col("_mark").alias("_as"), "_nth"), "nth")
    top = nth.agg(F.max("_of")).first()[0] or 0
    more = nth.where("_nth > 0").select("_of", "_as", (F.lit(top + 1) + F.monotonically_increasing_id()).alias("_other"))
    more = materialize(more, "more")
    nodes = named.join(more, (named["doc_id"] == more["_of"]) & (named["_mark"] == more["_as"]), "left").withColumn("_node", F.coalesce("_other", F.col("doc_id").cast("long")))
    kept = near_duplicates(nodes.select(F.col("_node").alias("doc_id"), "text"), width, share).where("kept").select(F.col("doc_id").alias("_node")).distinct()
    ones = nodes.join(kept, "_node", "left_semi").groupBy("_node").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return ones.select("_row.*").union(docs.where(F.col("doc_id").isNull()))
