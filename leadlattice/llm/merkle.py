"""Merkle manifest of a dataset: digests of rows, a tree per group, a tree over the groups, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.llm.common import materialize, small

FANOUT = 8
#: Levels that one task hashes at once: a block is FANOUT ** BLOCK_LEVELS consecutive nodes, 512.
BLOCK_LEVELS = 3
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODE = "g string, idx long, n long, node string"
_TAIL = "g string, idx long, root string, subroot string, lefts array<string>, rights array<string>"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long"


def framed(column: Column) -> Column:
    """A value so that several of them side by side can be told apart: `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def _digest(text: bytes | memoryview) -> str:
    return hashlib.sha256(text).hexdigest()


def _matrix(digests: Iterable[str]) -> np.ndarray:
    """Hex digests as the rows of one contiguous matrix of bytes."""
    return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, HEX)


def _parents(level: np.ndarray, fanout: int) -> np.ndarray:
    """Each run of `fanout` rows becomes one row by a reshape; a last shorter run is hashed as it is."""
    whole = len(level) // fanout * fanout
    runs = [*level[:whole].reshape(-1, fanout * HEX), *([level[whole:].reshape(-1)] if whole < len(level) else [])]
    return _matrix(_digest(run.data) for run in runs)


def _block(digests: Iterable[str], n: int, fanout: int, levels: int) -> list[np.ndarray]:
    """The levels of one block of a tier of n nodes, from the nodes up: as many as the block has, or as lie below the tree's top."""
    out = [_matrix(digests)]
    for _ in range(levels):
        if n <= 1:
            break
        out.append(_parents(out[-1], fanout))
        n = -(-n // fanout)
    return out


def _siblings(block: list[np.ndarray], at: int, fanout: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node `at` in its run, level by level, by index arithmetic alone."""
    lefts, rights = [], []
    for level in block[:-1]:
        first = at - at % fanout
        lefts.append(level[first:at].tobytes().decode("ascii"))
        rights.append(level[at + 1 : first + fanout].tobytes().decode("ascii"))
        at //= fanout
    return lefts, rights


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds idx, the place of each row within `g`, and n, the rows of `g`, whatever share of all rows a group holds.

    Rows are sorted by range over (g, order), so a group may span many tasks; each range's share of a group is
    counted, and the counts, at most one per range and group, are summed up before it.
    """
    placed = materialize(df.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_row", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    group = Window.partitionBy("_g")
    before = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(F.col("g").alias("_g"), F.col("_part").alias("_p")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    runs = small(runs.select("_g", "_p", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("n")))
    return placed.join(runs, (F.col("g") == F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("idx", F.col("_row") + F.col("_shift")).drop("_g", "_p", "_part", "_row", "_shift")


def _tiers(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Nodes by tier: each block of one tier is a node of the next; the last has one node per group, its root."""
    width = fanout**levels

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n = int(pdf["n"].iloc[0])
        top = _block(pdf["node"], n, fanout, levels)[-1]
        return pd.DataFrame({"g": pdf["g"].iloc[0], "idx": [int(pdf["idx"].iloc[0]) // width], "n": [-(-n // width)], "node": [top.tobytes().decode("ascii")]})

    tiers = [nodes.select("g", "idx", "n", "node")]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = tiers[-1].groupBy("g", F.floor(F.col("idx") / width).alias("block"))
        tiers.append(materialize(blocks.applyInPandas(roots, _NODE), "tier"))
    return tiers


def _tails(tiers: list[DataFrame], tails: DataFrame, fanout: int, levels: int) -> DataFrame:
    """From the siblings above each group's root (`tails`) to those above every node of the lowest tier given."""
    width = fanout**levels

    def below(nodes: pd.DataFrame, tail: pd.DataFrame) -> pd.DataFrame:
        nodes, up = nodes.sort_values("idx"), tail.iloc[0]
        block = _block(nodes["node"], int(nodes["n"].iloc[0]), fanout, levels)
        sides = [_siblings(block, at, fanout) for at in range(len(nodes))]
        return pd.DataFrame({
            "g": nodes["g"], "idx": nodes["idx"], "root": up["root"], "subroot": up["subroot"],
            "lefts": [lefts + list(up["lefts"]) for lefts, _ in sides], "rights": [rights + list(up["rights"]) for _, rights in sides],
        })

    for tier in reversed(tiers):
        blocks = tier.groupBy("g", F.floor(F.col("idx") / width).alias("block"))
        tails = materialize(blocks.cogroup(tails.groupBy("g", "idx")).applyInPandas(below, _TAIL), "tails")
    return tails


def prove(leaves: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """A proof for each row of leaves (doc_id, grp, leaf, claimed): the manifest's tree per grp and over all of them.

    Within a grp (null is a group of its own, the first) leaves ascend by doc_id (null first), then leaf; rows equal in both are
    interchangeable. While more than one node remains, each run of `fanout`, or the rest, becomes its digest, even a run of one. Subroots by grp go on likewise. A lone
    leaf is its subroot, a lone subroot the root. `claimed` is folded up with the original siblings; null stands for leaf.
    An empty table gives an empty one. A task holds one block of fanout ** levels nodes, never a group.
    """
    keyed = leaves.select("doc_id", "leaf", "claimed", F.coalesce(F.concat(F.lit("1"), F.col("grp")), F.lit("0")).alias("g"))
    # Rows with equal keys still spread over ranges by their place in the written table.
    keyed = materialize(keyed.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    rows = materialize(numbered(keyed, ["doc_id", "leaf", "_tie"]), "numbered")
    tiers = _tiers(rows.withColumnRenamed("leaf", "node"), fanout, levels)
    subroots = tiers[-1].select(F.col("g").alias("name"), F.col("node"), F.lit("").alias("g"))
    tops = materialize(numbered(subroots, ["name"]), "subroots")
    top_tiers = _tiers(tops, fanout, levels)
    top = top_tiers[-1].select("g", "idx", F.col("node").alias("root"), F.col("node").alias("subroot"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("lefts"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("rights"))
    above = _tails(top_tiers[:-1], top, fanout, levels)
    above = above.drop("g", "subroot").join(tops.select("idx", F.col("name").alias("g"), F.col("node").alias("subroot")), "idx").select("g", F.lit(0).cast("long").alias("idx"), "root", "subroot", "lefts", "rights")
    width = fanout**levels
    # A tree of one tier has its leaves as roots: every group is then one row.
    tails = _tails(tiers[1:-1], above, fanout, levels)

    def proofs(pdf: pd.DataFrame, tail: pd.DataFrame) -> pd.DataFrame:
        pdf, up = pdf.sort_values("idx"), tail.iloc[0]
        block = _block(pdf["leaf"], int(pdf["n"].iloc[0]), fanout, levels)
        up_left, up_right = list(up["lefts"]), list(up["rights"])
        up_all = "".join(a + b for a, b in zip(up_left, up_right, strict=True))
        proof, folded = [], []
        for at, (leaf, claimed) in enumerate(zip(pdf["leaf"], pdf["claimed"], strict=True)):
            lefts, rights = _siblings(block, at, fanout)
            proof.append(_digest(("".join(a + b for a, b in zip(lefts, rights, strict=True)) + up_all).encode("ascii")))
            now = claimed if isinstance(claimed, str) else leaf
            for a, b in zip(lefts + up_left, rights + up_right, strict=True):
                now = _digest((a + now + b).encode("ascii"))
            folded.append(now)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "leaf": pdf["leaf"], "subroot": up["subroot"], "root": up["root"],
            "proof_sha256": proof, "folded_root": folded, "verified": [x == up["root"] for x in folded], "position": pdf["idx"],
        })

    # The blocks of a tree that is only leaves (every group has one) are their own tier above.
    blocks = rows.groupBy("g", F.floor(F.col("idx") / (width if len(tiers) > 1 else 1)).alias("block"))
    return blocks.cogroup(tails.groupBy("g", "idx")).applyInPandas(proofs, _PROOF)


def document_manifest(documents: DataFrame) -> DataFrame:
    """The manifest of documents by language, and for each row whether its proof holds once some texts were tampered with.

    A leaf is the digest of doc_id, source, lang, n_chars and text, framed; it is made before anything is shuffled, so texts
    never leave the scan's tasks. Tampering lower-cases A-Z of texts whose unsigned crc32 of doc_id is a multiple of 3; rows without a doc_id or
    text stay. Null, empty and repeated values and further columns are defined as in `prove`. Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and position, the row's place in its language.
    """
    d, rest = documents, ("source", "lang", "n_chars")
    columns = [d["doc_id"], *[d[c] for c in rest]]
    hit = F.crc32(d["doc_id"].cast("string").cast("binary")) % 3 == 0
    tampered = F.translate(d["text"], UPPER, LOWER)
    leaves = d.select(
        "doc_id", F.col("lang").alias("grp"), leaf_digest([*columns, d["text"]]).alias("leaf"),
        F.when(hit & d["text"].rlike("[A-Z]"), leaf_digest([*columns, tampered])).alias("claimed"),
    )
    return prove(leaves)
