"""Settings landed as JSON documents: locales, demand, search terms, regions, taxonomies. They are small, and read once on the driver."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from leadlattice.functions.text import Locale
from leadlattice.operators import market


def read_document(path: str) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _bare(words: list[str]) -> tuple[str, ...]:
    """Lower case, letters and digits only, each once, the longest first."""
    found = {"".join(c for c in w.lower() if c.isalnum()) for w in words}
    return tuple(sorted(found - {""}, key=lambda w: (-len(w), w)))


def locale_of(doc: dict[str, Any]) -> Locale:
    """A locale from diacritics, variants, legal_suffixes, prefixes and stopwords; what is absent keeps its default. Stopwords are folded like names."""
    base = Locale()
    folds = doc.get("diacritics") or dict(zip(base.accented, base.plain, strict=True))
    fold = str.maketrans({k: v for k, v in folds.items() if len(k) == 1})
    return Locale(
        accented="".join(k for k, v in folds.items() if len(k) == len(v) == 1), plain="".join(v for k, v in folds.items() if len(k) == len(v) == 1),
        variants=tuple((doc.get("variants") or dict(base.variants)).items()), legal_forms=_bare(doc["legal_suffixes"]) if "legal_suffixes" in doc else base.legal_forms,
        prefixes=_bare(doc["prefixes"]) if "prefixes" in doc else base.prefixes, stopwords=_bare([w.translate(fold) for w in doc["stopwords"]]) if "stopwords" in doc else base.stopwords,
    )


def demand_of(spark: SparkSession, doc: dict[str, Any]) -> DataFrame:
    """(destination, category, demand, supply) from {destination: {category: {demand, supply}}}."""
    rows = {d: {c: (int(v["demand"]), int(v["supply"])) for c, v in cells.items()} for d, cells in doc["destinations"].items()}
    return market.demand_table(spark, rows)


def terms_of(spark: SparkSession, doc: dict[str, Any]) -> DataFrame:
    """(term, category, enabled, offered) of search terms; enabled unless they say otherwise."""
    rows = [(t["term"], t["category"], bool(t.get("enabled", True)), bool(t.get("default", False))) for t in doc["terms"]]
    return spark.createDataFrame(rows, "term string, category string, enabled boolean, offered boolean")


def overridden(terms: DataFrame, overrides: DataFrame) -> DataFrame:
    """Terms with the switches of overrides (term, enabled, at): the last one of each term counts."""
    from pyspark.sql import functions as F

    last = overrides.groupBy("term").agg(F.max_by("enabled", "at").alias("_on"))
    return terms.join(last, "term", "left").withColumn("enabled", F.coalesce("_on", "enabled")).drop("_on")


def regions_of(doc: dict[str, Any]) -> dict[str, tuple[bool, tuple[tuple[float, float], ...]]]:
    """Regions as areas.permitted takes them, from [{id, enabled, polygon}]."""
    return {r["id"]: (bool(r.get("enabled", False)), tuple((float(a), float(b)) for a, b in r["polygon"])) for r in doc["regions"]}


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a taxonomy landed as text, a path a line."""
    return spark.read.text(path).withColumnRenamed("value", "path")
