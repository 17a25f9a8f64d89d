"""Range sharding by sampled splitters, near equal in bytes."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.llm.common import materialize

#: Ranges in each shard, keys in a sample for each range, and how overfull a range may stay.
RANGES_PER_SHARD, SAMPLE_PER_RANGE, OVERFULL = 64, 24, 2.5
#: How many times the sample's number of keys tasks put forward for it, as expected at most.
AHEAD = 1.5
#: Ranges of one key stay together up to this share of a shard.
WHOLE_GROUP = 0.05
_LOW = -(1 << 63)
#: A row's place in the order: hash of the text, hash of the doc_id, and a number that parts rows equal in both.
Key = tuple[int, int, int]


def _sampled(rows: DataFrame, n: int, seed: int, total: int) -> list[Key]:
    """At most n (key, sub, tie) triples, drawn without replacement by size: those of least exponential variate over size.

    A row of size s is below a variate t with a probability of at most s * t. So of rows whose sizes add up to `total`
    no more than AHEAD * n are expected below t = AHEAD * n / total, and only those leave their tasks.
    """
    uniform = (F.pmod(F.xxhash64("key", "sub", "tie", F.lit(seed)), F.lit(1 << 53)) + 1).cast("double") / float((1 << 53) + 1)
    drawn = rows.select("key", "sub", "tie", (-F.log(uniform) / F.col("size")).alias("e")).where(F.col("e") <= AHEAD * n / max(1, total))
    return sorted((r["key"], r["sub"], r["tie"]) for r in drawn.orderBy("e", "key", "sub", "tie").limit(n).collect())


def _splitters(sample: list[Key], parts: int, start: Key | None = None) -> list[Key]:
    """Quantile boundaries above `start`. The first one in a key stands at its start, and the first one in rows of equal key and sub at theirs: only what holds more than a range is split."""
    cuts = [start] if start else []
    for i in range(1, parts):
        key, sub, tie = sample[i * len(sample) // parts]
        at = (key, _LOW, _LOW)
        if cuts and cuts[-1][0] == key:
            at = (key, sub, tie) if cuts[-1][:2] == (key, sub) else (key, sub, _LOW)
        if not cuts or at > cuts[-1]:
            cuts.append(at)
    return cuts[1:] if start else cuts


def _range_of(cuts: list[Key]) -> Column:
    """How many boundaries are at or below (key, sub, tie), by a balanced tree of comparisons."""
    if not cuts:
        return F.lit(0)
    bounds = [F.array(*[F.lit(c[k]) for c in cuts]) for k in range(3)]
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])

    def step(at: Column, jump: Column) -> Column:
        to = at + jump
        k, s, t = (F.get(b, to - 1) for b in bounds)
        below = (k < F.col("key")) | ((k == F.col("key")) & ((s < F.col("sub")) | ((s == F.col("sub")) & (t <= F.col("tie")))))
        return F.when((to <= len(cuts)) & below, to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _measured(rows: DataFrame, cuts: list[Key]) -> dict[int, tuple[int, int]]:
    at = rows.select(_range_of(cuts).alias("range"), "size")
    return {r["range"]: (r["bytes"], r["rows"]) for r in at.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}


def shard(docs: DataFrame, shards: int = 16, rounds: int = 4) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs (doc_id, text).

    The law is `bytes`: shards' sums of sizes (UTF-8 bytes plus 1; a null text counts as empty) are near equal, so
    grown_shard is null. slot numbers a shard's rows from 0. Rows are ordered by a hash of the text, then of the
    doc_id: equal texts stand together, and are parted only where a shard ends within such a group. Repeated
    rows each get a slot, and rows equal in doc_id and text, which may swap places, are parted like others, by their place in the written table; an empty table gives an empty one; further columns are ignored.

    A size-weighted sample of keys gives quantile boundaries for many small ranges, and all rows are measured against
    them. Overfull ranges are sampled again and subdivided, down to parts of one text, or of one text and doc_id, if that alone is too
    large. Runs of ranges are then dealt to shards by their exact sums. The driver sees the sample
    and one sum per range; both depend on the number of shards only.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(3)).alias("key"), F.xxhash64("doc_id", F.lit(4)).alias("sub"),
    ).withColumn("tie", F.monotonically_increasing_id())
    rows = materialize(rows, "sized")
    parts = shards * RANGES_PER_SHARD
    every = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sample = _sampled(rows, parts * SAMPLE_PER_RANGE, 1, every)
    cuts = _splitters(sample, parts) if sample else []
    sums = _measured(rows, cuts)
    total = sum(b for b, _ in sums.values())
    for turn in range(2, 2 + rounds):
        over = sorted(r for r, (b, n) in sums.items() if n > 1 and b > OVERFULL * total / parts)
        if not over:
            break
        inside = rows.withColumn("range", _range_of(cuts)).where(F.col("range").isin(over))
        again = _sampled(inside, parts * SAMPLE_PER_RANGE, turn, sum(sums[r][0] for r in over))
        grown = set(cuts)
        for r in over:
            mine = [x for x in again if bisect_right(cuts, x) == r]
            finer = max(2, round(sums[r][0] * parts / total))
            if mine:
                grown.update(_splitters(mine, finer, cuts[r - 1] if r else None))
        if len(grown) == len(cuts):
            break
        cuts = sorted(grown)
        sums = _measured(rows, cuts)
    return _dealt(spark, rows, cuts, sums, shards)


def _dealt(spark: SparkSession, rows: DataFrame, cuts: list[Key], sums: dict[int, tuple[int, int]], shards: int) -> DataFrame:
    total, before, dealt, filled = sum(b for b, _ in sums.values()), 0, [], [0] * shards
    groups: list[list[int]] = []
    for r in sorted(sums):
        inside = r > 0 and cuts[r - 1][1:] != (_LOW, _LOW)
        if inside and groups and sum(sums[x][0] for x in [*groups[-1], r]) <= WHOLE_GROUP * total / shards:
            groups[-1].append(r)
        else:
            groups.append([r])
    for group in groups:
        size = sum(sums[r][0] for r in group)
        to = min(shards - 1, int((before + size / 2) * shards / max(1, total)))
        for r in group:
            dealt.append((r, to, filled[to]))
            filled[to] += sums[r][1]
        before += size
    ranges = F.broadcast(spark.createDataFrame(dealt, "range long, shard int, slots_before long"))
    placed = rows.withColumn("range", _range_of(cuts).cast("long")).join(ranges, "range")
    within = Window.partitionBy("range").orderBy("key", "sub", "tie")
    slot = F.col("slots_before") + F.row_number().over(within) - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
