"""The pipeline's stages one by one and as a whole on a small table, against what plain versions keep."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_ops import edits, groups, paths, shingles

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from leadlattice.llm import components, minhash_dedup, packing  # noqa: E402
from leadlattice.llm.common import materialize  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
STAGES = dict(corpus_pipeline.STAGES)


def words(i, n=40):
    return " ".join(f"{w}{(i * 7 + k * 13) % 9973 if k % 3 else ''}" for k, w in zip(range(n), ["the", "house", "of", "green", "water", "is", "near", "our", "old", "town"] * n, strict=False))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean texts of two languages, toxic ones, foreign ones, copies, nulls, empty texts and a repeated id."""
    german = lambda i: " ".join(f"{w}{(i * 5 + k) % 9967 if k % 4 == 0 else ''}" for k, w in zip(range(40), ["der", "hund", "und", "die", "katze", "sind", "nicht", "über", "straße", "gegangen"] * 4, strict=False))
    data = [(i, words(i) if i % 2 else german(i), "en" if i % 2 else "de", f"s{i % 3}", 10, "x") for i in range(600)]
    rude = lambda i: " ".join([*(w := words(3000 + i).split())[: i % 37], "idiot" if i % 2 else "moron", *w[i % 37 :]])
    data += [(1000 + i, rude(i), "en", "s0", 10, "x") for i in range(120)]
    data += [(2000, "完全に異なる言語で書かれた文章です" * 5, None, "s1", 10, "x"), (2001, None, None, None, None, None), (2002, "", "en", "s1", 0, "x"), (2003, "123 456 --", "en", "s1", 0, "x")]
    data += [(3000 + i, words(1), "en", "s0", 10, "x") for i in range(20)] + [(3, words(777), "en", "s0", 10, "x"), (None, words(5), "en", "s0", 10, "x")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(data, SCHEMA).coalesce(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(600)] + [(1000 + i, 1, 1) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = STAGES["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    # The plain version: a text goes if a word is at most one edit from an abusive one.
    want = Counter(r["doc_id"] for r in docs.collect() if not any(edits(w, t) <= 1 for w in set((r["text"] or "").split()) for t in ("idiot", "moron")))
    assert ids == want
    spoken = STAGES["language_id"](spark, kept, sf_dir)
    assert spoken.columns == docs.columns
    left = {r["doc_id"] for r in spoken.select("doc_id").collect()}
    assert not left & {2000, 2001, 2002, 2003}
    assert len(left & set(range(600))) >= 585
    spoken = materialize(spoken, "spoken")
    ones = STAGES["minhash_dedup"](spark, spoken, sf_dir)
    assert ones.columns == docs.columns
    rows = [r for r in spoken.collect() if r["doc_id"] is not None]
    node = {n: r for n, r in enumerate(rows)}
    sets = {n: shingles(r["text"], 5) for n, r in node.items()}
    of = groups(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = Counter((r["doc_id"], r["text"]) for r in ones.where("doc_id is not null").collect())
    assert max(got.values()) == 1
    group_of = {(r["doc_id"], r["text"]): of[n] for n, r in node.items()}
    assert sorted(group_of[k] for k in got) == sorted(set(of.values()))
    assert {(3, words(3)), (3, words(777))} <= set(got)
    assert ones.where("doc_id is null").count() == 1
    mixed = materialize(STAGES["mixing"](spark, materialize(ones, "ones"), sf_dir), "mixed")
    assert mixed.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for r in ones.collect():
        sizes[r["source"]] += len(r["text"].split())
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    total, weight = sum(sizes.values()), {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    assert all(abs(taken[s] - min(3 * sizes[s], total * weight[s] / sum(weight.values()))) <= 0.05 * sizes[s] for s in sizes)
    packed = STAGES["best_fit_packing"](spark, mixed, sf_dir).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert len({r["sequence_id"] for r in packed}) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 400
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_different_texts_of_an_id_stay_and_equal_rows_are_one(spark):
    data = [(1, words(1)), (1, words(2)), (1, words(2)), (2, words(2)), (3, words(3)), (4, ""), (4, None)]
    got = sorted((r["doc_id"], r["text"] or "") for r in minhash_dedup.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert [g for g in got if g[1]] == sorted([(1, words(1)), (2, words(2)), (3, words(3))])


def test_components_reach_the_fixed_point_of_a_long_chain(spark):
    edges = spark.range(3000).select(F.pmod(F.col("id") * 7919, F.lit(3001)).alias("a"), F.pmod((F.col("id") + 1) * 7919, F.lit(3001)).alias("b"))
    assert {r["component"] for r in components.connected_components(edges).collect()} == {0}


def test_both_encoders_agree_on_every_document(spark):
    path, ranks = paths()
    table = Path("/root/testdata/sf0.001/documents.parquet")
    if not table.exists():
        pytest.skip("no table of documents here")
    one, two = packing.TokenIds(path, ranks), packing.TokenIds(path)
    assert all(one.of(r["text"] or "") == two.of(r["text"] or "") for r in spark.read.parquet(str(table)).select("text").collect())
