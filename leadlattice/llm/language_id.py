"""Language identification by nearest clustered centroids of normalised TF-IDF n-gram vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.llm.common import materialize, small

UNKNOWN = "und"
#: Byte n-grams of these lengths are hashed into so many places.
LENGTHS, PLACES = (1, 2, 3), 8192
#: The fit uses at most so many labelled texts per language, those of least hashed id.
SAMPLE_PER_LANGUAGE = 250
CENTROIDS = 4
#: A text is rejected if its similarity is below this quantile of what held-out texts of as many distinct n-grams have.
REJECT_QUANTILE = 0.01
#: Lengths in bytes to which they are cut for that, powers of two of distinct n-grams with a limit each, and texts needed for one.
CUTS, SIZES, FEWEST = tuple(1 << k for k in range(3, 17)), tuple(range(2, 13)), 20
_BLOCK = 1 << 16


@dataclass
class Model:
    langs: list[str]
    #: One row per centroid, unit length, already weighted by idf.
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    #: Least accepted cosine per language and number of distinct n-grams, as SIZES.
    least: np.ndarray


def _limit(least: np.ndarray, count: np.ndarray) -> float:
    """The limit at so many distinct n-grams, which a text that repeats itself has few of: between SIZES by the logarithm."""
    return float(np.interp(np.log2(max(1, np.count_nonzero(count))), np.array(SIZES) + 0.5, least))


def counts(text: str) -> np.ndarray:
    """How often each hashed byte n-gram of the lower-cased text occurs; blocks keep memory the same for any length."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(PLACES)
    for at in range(0, len(raw), _BLOCK):
        b = raw[at : at + _BLOCK + max(LENGTHS) - 1].astype(np.uint32)
        for n in LENGTHS:
            own = min(_BLOCK, len(b) - n + 1)
            if own <= 0:
                continue
            h = np.full(own, n, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x9E3779B1) + b[i : i + own]
            out += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(19), minlength=PLACES)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(count) * idf)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-point starts: the same result at every run."""
    start = [int(np.argmax(x @ _unit(x.mean(axis=0))))]
    while len(start) < min(k, len(x)):
        far = (x @ x[start].T).max(axis=1)
        if far.min() > 0.999:
            break
        start.append(int(np.argmin(far)))
    c = x[start]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        c = np.stack([_unit(x[nearest == j].mean(axis=0)) if (nearest == j).any() else c[j] for j in range(len(c))])
    return c


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from (doc_id, text, lang) rows with text and lang.

    A sample of at most `per_language` different whole texts of each language is turned into count vectors on the
    executors; the driver gets those vectors only, so what it holds is bounded by the parameter, however often rows repeat.

    The least accepted cosines are measured on texts that the centroids have not seen: each half of the sample is
    cut to each length of CUTS and compared with centroids of the other half, again on the executors.
    """
    ids = labelled.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id", F.lit(5)).alias("h")).distinct()
    # Spark sorts out the first of each language in every task before any row is shuffled.
    first = lambda d, *order: d.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= per_language).drop("n")
    texts = labelled.where("text is not null").select("doc_id", "lang", "text").join(small(first(ids, "h", "doc_id")), ["doc_id", "lang"]).select("doc_id", "lang", "h", "text")
    # An id may have many rows: equal ones count once, rows are bounded as ids are, and each id's first text comes before any second one.
    texts = texts.withColumn("t", F.xxhash64("text")).dropDuplicates(["lang", "doc_id", "t"])
    texts = texts.withColumn("k", F.row_number().over(Window.partitionBy("lang", "doc_id").orderBy("t"))).where(F.col("k") <= per_language)
    texts = materialize(first(texts, "k", "h", "doc_id").select("lang", "doc_id", "text"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.log1p(counts(t.as_py())).astype(np.float32).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["lang", "doc_id", "v"])

    rows = sorted((r["lang"], r["doc_id"], bytes(r["v"])) for r in texts.mapInArrow(run, texts.select("lang", "doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", v binary").collect())
    langs = sorted({r[0] for r in rows})
    x = np.stack([np.frombuffer(r[2], np.float32) for r in rows]) if rows else np.zeros((0, PLACES), np.float32)
    of = np.array([langs.index(r[0]) for r in rows], int)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1 if len(x) else np.ones(PLACES)
    idf = idf.astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centroids, owner, halves = [], [], {}
    for i, lang in enumerate(langs):
        mine = x[of == i]
        c = _clusters(mine, CENTROIDS)
        centroids.append(c)
        owner += [i] * len(c)
        # By the sample's order of ids: even places and odd ones.
        halves[lang] = [_clusters(half if len(half) else mine, CENTROIDS) for half in (mine[::2], mine[1::2])]
    place: dict[tuple, int] = {}
    for at, (lang, doc_id, _) in enumerate(rows):
        place.setdefault((lang, doc_id), int(at - np.searchsorted(of, langs.index(lang))))
    least = _limits(texts, langs, halves, place, idf)
    return Model(langs, np.concatenate(centroids) if centroids else np.zeros((0, PLACES)), np.array(owner, int), idf, least)


def _limits(texts: DataFrame, langs: list[str], halves: dict[str, list[np.ndarray]], place: dict[tuple, int], idf: np.ndarray) -> np.ndarray:
    """The least accepted cosine of each language at each of SIZES, from texts (lang, doc_id, text) of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not any(map(str.isalpha, text)):
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                other = halves[lang][1 - place[lang, doc_id] % 2]
                for n in CUTS:
                    if n > len(raw):
                        break
                    # Cut at a place that the id chooses, since texts may begin alike.
                    at = zlib.crc32(f"{doc_id} {n}".encode()) % (len(raw) - n + 1)
                    cut = raw[at : at + n].decode("utf-8", "ignore")
                    if any(map(str.isalpha, cut)):
                        count = counts(cut)
                        k = min(max(int(np.count_nonzero(count)).bit_length() - 1, SIZES[0]), SIZES[-1]) - SIZES[0]
                        found.append((lang, k, float((other @ _weighted(count, idf)).max())))
            lists = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(lists, (pa.string(), pa.int32(), pa.float64()), strict=True)], ["lang", "k", "s"])

    seen: dict[tuple[str, int], list[float]] = {}
    for r in texts.select("lang", "doc_id", "text").mapInArrow(run, "lang string, k int, s double").collect() if langs else []:
        seen.setdefault((r["lang"], r["k"]), []).append(r["s"])
    least = np.zeros((len(langs), len(SIZES)))
    for i, lang in enumerate(langs):
        for k in range(len(SIZES)):
            # Longer texts are more typical, so where too few are so long, the limit of the next lesser size holds.
            s = seen.get((lang, k), [])
            least[i, k] = np.quantile(s, REJECT_QUANTILE) if len(s) >= FEWEST else least[i, k - 1] if k else 0.0
    return np.maximum.accumulate(least, axis=1)


def nearest(text: str | None, lettered: bool, model: Model) -> tuple[str, float, bool]:
    """(language, cosine to the nearest centroid, rejected) of one whole text."""
    if not lettered or text is None or not model.langs:
        return UNKNOWN, 0.0, True
    count = counts(text)
    near = model.centroids @ _weighted(count, model.idf)
    at = int(near.argmax())
    score = float(min(1.0, max(0.0, near[at])))
    return model.langs[model.owner[at]], score, score < _limit(model.least[model.owner[at]], count)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row of docs (doc_id, text); score is the cosine, 0 to 1.

    Only the text is looked at, as a whole. lang_pred is a learned language, or `und` with score 0 if the text is
    null, has no letter, or nothing was learned; rejected marks those, and texts whose cosine is below the least
    accepted one of the language at the text's number of distinct n-grams. Equal cosines go to the language first in code point order. An empty table
    gives an empty one; repeated rows each get a row; further columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [nearest(t, l, model) for t, l in zip(pdf["text"], pdf["lettered"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]})

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text the model does not reject."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at)]
            yield batch.filter(pa.array([not nearest(t, t is not None and any(map(str.isalpha, t)), model)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str = "doc_id", of: int = 5):  # noqa: ANN201
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def fit_on_folds(docs: DataFrame, training_remainders: tuple[int, ...] = (1, 2, 3, 4)) -> Model:
    return fit(docs.where(fold().isin(*training_remainders)).select("doc_id", "text", "lang"))


def identify(docs: DataFrame, training_remainders: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Fits on the training folds of docs (doc_id, text, lang) and predicts every row: doc_id, held_out, lang_pred, score, rejected."""
    model = fit_on_folds(docs, training_remainders)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(~fold().isin(*training_remainders), F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")
