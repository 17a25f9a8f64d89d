"""Mixing sources to target weights by blocks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.llm.common import WORD_PATTERN, materialize, prefix_sums, small

#: Words in a block at most, blocks in an output shard, rounds of a permutation, times a source may be repeated.
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, MOST_REPEATS = 128, 4096, 10, 3
#: A source's blocks are so short that its target takes at least so many, so that rounding to blocks hardly shows.
LEAST_SLOTS = 200
#: Ranges of numbers are met by equal strides, of which there are so many; slots that a task makes.
_STRIDES, _SLOTS_PER_TASK = 4096, 1 << 20


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size), one row per source.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, ...; targets share the total of all sizes by weight. A
    target stops at three times its source's size, and the excess is shared again by weight until none is above:
    then each target is the lesser of that limit and a common rate times the weight, and the rate follows from
    running sums over sources in the order in which they reach their limits.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    s = s.withColumn("limit", F.col("source_size").cast("double") * MOST_REPEATS)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("rate", rate).withColumn("free", F.col("rate") * F.col("weight") <= F.col("limit"))
    # The first source that does not reach its limit sets the rate of all after it.
    first = F.first(F.when(F.col("free"), F.col("rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return s.withColumn("target", F.least("limit", F.coalesce(first * F.col("weight"), F.col("limit")))).drop("limit", "rate", "free")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of index in a pseudorandom permutation of 0 to n - 1 that the key chooses (a swap-or-not shuffle).

    Each round pairs x with (k - x) mod n and swaps the two or not by one bit that both agree on, so every
    round is one to one for any n.
    """

    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), *key, r).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), index.cast("long"), one)


def in_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds s (an index), block_words, n_blocks and n_slots to (source, source_size, target).

    A source of n blocks gets target / size * n slots, rounded, so its words come within about half a block of the
    target. Its blocks have `block_words` words, fewer where its size or target is small.
    """
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.least("source_size", "target") / LEAST_SLOTS))).cast("long")
    t = targets.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).withColumn("block_words", words)
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    return t.withColumn("n_slots", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("n_blocks"))).otherwise(0).cast("long"))


def _met(df: DataFrame, at: str, ranges: DataFrame, total: int) -> DataFrame:
    """df joined with the one of ranges (s, lo, hi) that holds column `at`: lo <= at < hi. Ranges part 0 to total.

    Both sides meet in strides of equal width, so no range is compared with all numbers.
    """
    width = max(1, -(-total // _STRIDES))
    cut = ranges.where("hi > lo").withColumn("stride", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    return df.withColumn("stride", F.expr(f"{at} div {width}")).join(small(cut), "stride").where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("stride", "hi")


def _running(df: DataFrame, n: Column, total: str) -> DataFrame:
    """Ranges (s, lo, hi) of running sums of n over sources, which are few; `total` names the last sum."""
    upto = F.coalesce(F.sum(n).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    return df.select("s", (upto - n).alias("lo"), upto.alias("hi"), F.coalesce(F.sum(n).over(Window.partitionBy()), F.lit(0)).alias(total))


def draws(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, slot, s, j): the source of every slot of every output shard, and its number among the source's slots, from (s, n_slots).

    Each slot draws its source with the share of slots as probability, so the counts of a shard are
    multinomial. Over all shards they come near n_slots only. Slots of a source beyond n_slots are dealt to the sources that
    drew too few, so sums are exact; such slots are about as many as the square root of all.
    """
    spark = sources.sparkSession
    wide = materialize(_running(sources, F.col("n_slots"), "total"), "shares")
    total = (wide.agg(F.max("total")).first()[0]) or 0
    slot = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // _SLOTS_PER_TASK)))
    slot = slot.select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod("id", F.lit(shard_slots)).alias("slot"))
    slot = slot.withColumn("u", F.pmod(F.xxhash64("shard", "slot", F.lit(seed)), F.lit(max(1, total))))
    drawn = _met(slot, "u", wide.select("s", "lo", "hi"), total).select("shard", "slot", "s")
    counts = materialize(drawn.groupBy("s", "shard").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = prefix_sums(counts, ["s"], ["shard"], F.col("n"), "before").select("s", "shard", "before")
    rank = F.row_number().over(Window.partitionBy("s", "shard").orderBy("slot")) - 1
    numbered = drawn.withColumn("rank", rank).join(before.hint("merge"), ["s", "shard"]).select("shard", "slot", "s", (F.col("before") + F.col("rank")).alias("j"))
    numbered = materialize(numbered, "drawn")
    got = sources.select("s", "n_slots").join(counts.groupBy("s").agg(F.sum("n").alias("got")), "s", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = materialize(got, "got")
    over = materialize(_running(got, F.greatest(F.lit(0), F.col("got") - F.col("n_slots")), "total"), "over")
    under = _running(got, F.greatest(F.lit(0), F.col("n_slots") - F.col("got")), "total").join(got.select("s", "got"), "s")
    about = small(got.join(over.select("s", F.col("lo").alias("over_lo")), "s"))
    numbered = numbered.join(about, "s")
    kept = numbered.where("j < n_slots").select("shard", "slot", "s", "j")
    spare = numbered.where("j >= n_slots").select("shard", "slot", (F.col("over_lo") + F.col("j") - F.col("n_slots")).alias("r"))
    moved = _met(spare, "r", under.select("s", "lo", "hi", "got"), over.agg(F.max("total")).first()[0] or 0)
    return kept.union(moved.select("shard", "slot", "s", (F.col("got") + F.col("r") - F.col("lo")).alias("j")))


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The mix as (shard, slot, s, block), from (s, n_blocks, n_slots): see draws.

    A source's slots go through its blocks in passes, each in the order of its own pseudorandom permutation, so that in whole
    passes every block comes once.
    """
    each = draws(sources, shard_slots, seed).join(small(sources.select("s", "n_blocks")), "s")
    block = permuted(F.pmod("j", "n_blocks"), F.col("n_blocks"), F.lit(seed + 1), F.col("s"), F.expr("j div n_blocks"))
    return each.select("shard", "slot", "s", block.alias("block"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def place(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sized documents (doc_id, source, size, start: words of the source before it, row), and sources with targets."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    placed = prefix_sums(sized, ["source"], ["doc_id", "mark", "size"], F.col("size"), "start", ties=["row"])
    return materialize(placed, "placed"), sources


def takes(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(row, doc_id, source, size, mark, source_size, target, block, at, words, times, shard): a row for each block that a document reaches into.

    `words` of the document, from its word `at` on, lie in `block`, and the mix takes the block `times` times, in output shards of which
    `shard` is the first. A document without words has one row with a null block.
    """
    placed, sources = place(docs)
    sources = materialize(in_blocks(sources, block_words), "blocks")
    used = slots(sources, shard_slots, seed).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    about = sources.select("s", F.col("source").alias("s_source"), "source_size", "target", "block_words")
    about = F.broadcast(about) if sources.count() <= 100_000 else about
    placed = placed.join(about, placed["source"].eqNullSafe(F.col("s_source")))
    end = F.col("start") + F.col("size")
    reach = F.when(F.col("size") > 0, F.sequence(F.expr("start div block_words"), F.expr("(start + size - 1) div block_words")))
    pieces = placed.select("*", F.explode_outer(reach).alias("block"))
    from_, to = F.greatest("start", F.col("block") * F.col("block_words")), F.least(end, (F.col("block") + 1) * F.col("block_words"))
    pieces = pieces.withColumn("words", F.coalesce(to - from_, F.lit(0))).withColumn("at", from_ - F.col("start"))
    # A source with most of the rows spreads over its blocks. The size of the slots can't be told from the few
    # sources they come from, so the join is told not to broadcast them.
    got = pieces.join(used.hint("merge"), ["block", "s"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return got.select("row", "doc_id", "source", "size", "mark", "source_size", "target", "block", "at", "words", "times", "shard")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard) of each row of docs (doc_id, text, source).

    size counts runs without ASCII white space (null text: 0); taken counts the words of the document that the
    mix takes, repeats included, at most three times its size; first_shard is the first output shard with any of them, or null. The same input gives the same mix. A null source
    is a source of its own; sources without words have target 0; repeated rows each get a row (equal rows may
    swap places); an empty table gives an empty one; further columns are ignored. A document's whole blocks are
    taken as often as the source's passes reach them, so a document may be taken in part.
    """
    t = takes(docs, block_words, shard_slots, seed)
    out = t.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix as rows of docs: a row for each time that a document, or the part of it in taken blocks, is taken.

    A row holds the document's text if all of its blocks are taken that often, else its words in the taken blocks
    joined by spaces; n_chars, where there is such a column, counts the new text. Documents that the mix doesn't
    take have no row. Rows equal in doc_id, source and text share their other columns.
    """
    part = F.struct("at", "words", "times")
    # A struct of nulls equals another, unlike nulls, so rows without an id or source meet too; one key serves both steps.
    key = F.struct("doc_id", "source", "mark").alias("_key")
    by_row = takes(docs, block_words, seed=seed).where("times > 0 or block is not null").groupBy("row", "doc_id", "source", "mark").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    marked = docs.withColumn("_key", F.struct("doc_id", "source", F.xxhash64("text").alias("mark")))
    rows = marked.dropDuplicates(["_key"]).join(by_row.select(key, "_parts"), "_key").withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(MOST_REPEATS))))
    rows = rows.withColumn("_kept", F.filter("_parts", lambda p: p["times"] >= F.col("_time"))).where(F.size("_kept") > 0)
    words = F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), F.lit(1))
    some = F.array_join(F.flatten(F.transform("_kept", lambda p: F.slice("_words", (p["at"] + 1).cast("int"), p["words"].cast("int")))), " ")
    whole = F.size("_kept") == F.size("_parts")
    rows = rows.withColumn("_words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
