"""Best-fit packing of tokenised documents into sequences, in supersteps over sizes."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlattice.llm.common import materialize, prefix_sums

CAPACITY, END_ID = 2048, 0
#: Fixed value: the published pre-tokenisation pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which all libraries agree whether they are letters, numbers or white space.
_OTHER = re.compile(r"[^\t\n\r -~¡-¬®-ſ‐-‧‰-⁞€]")


class TokenIds:
    """Little-endian 32-bit ids of texts, by the tokenizer at `path`.

    With the path of the same vocabulary as ranks, texts of plain characters and without control strings are encoded
    by those: the same ids in a quarter of the time. Other texts go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if self.ranked and not any(s in text for s in self.special) and (text.isascii() or not _OTHER.search(text)):
            return np.array(self.ranked.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text): ids, then the end id.

    A document of more than `capacity` ids is cut into pieces of that length, of which the first may be shorter.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TokenIds(tokenizer_path, ranks_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = ids.of(text.as_py() or "") + end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, rank_from, rank_to, first sequence, offset): where the pieces of each size and rank go.

    Sizes are taken from the largest down, all pieces of a size in one superstep. Gaps are kept sorted by size; the
    successor of the size among them is the best fit, pieces and gaps of these two sizes are matched by rank, the
    gaps shrink and join those of their new size, and the step repeats until the size is used up. Pieces that
    no gap fits open new sequences. Runs of sequences stand for their members, so the work depends on the number of
    sizes and not on the number of pieces.
    """
    gaps: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []
    plan, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and gap not in gaps:
            gaps[gap] = deque()
            insort(sizes, gap)
        if gap:
            runs = gaps[gap]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((first, n))

    for size in sorted(counts, reverse=True):
        rank, total = 0, counts[size]
        while rank < total:
            at = bisect_left(sizes, size)
            if at == len(sizes):
                n = -(-(total - rank) // (capacity // size))
                add(capacity, opened, n)
                opened += n
                continue
            gap = sizes[at]
            first, n = gaps[gap].popleft()
            used = min(n, total - rank)
            if used < n:
                gaps[gap].appendleft((first + used, n - used))
            elif not gaps[gap]:
                del gaps[gap], sizes[at]
            plan.append((size, rank, rank + used, first, capacity - gap))
            add(gap - size, first, used)
            rank += used
    return plan


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece's place in a sequence.

    A null or empty text is the end id alone. Sequences hold at most `capacity` ids without gaps from offset 0.
    Repeated rows are packed each; rows of equal doc_id and text may swap places. An empty table gives an empty
    one; further columns are ignored.

    Pieces of one size are interchangeable, so documents and gaps are sorted by size once, as counts per size: at
    most `capacity` numbers, whatever the number of documents. Supersteps over them give a table of
    matches, and every piece finds its own by its rank among the pieces of its size. Ranks are running counts that never
    gather a size in one task.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, ranks_path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(counts, capacity)
    ranked = prefix_sums(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "rank", ties=["row"])
    matches = spark.createDataFrame(plan, "size long, rank_from long, rank_to long, first long, offset long")
    if len(plan) <= 200_000:
        matches = F.broadcast(matches)
    fits = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.join(matches, fits)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
