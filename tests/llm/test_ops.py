"""Edge cases and brute-force versions of the operators on small tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlattice.llm import chat_format, embedding_dedup, hamming_search, html_extract, language_id, minhash_dedup, mixing, packing, sharding, toxicity
from leadlattice.llm.components import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"
ODD = [None, "", " \n\t", "one", "one two three four five", "x " * 3000, "ünïcödé “quoted” 🙂 text", "<|endoftext|> a", "one two three four five"]


def docs(spark, texts, start=0):
    """A table whose further columns clash with names that operators use."""
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}" if i % 4 else None, 0, 1.0, "x") for i, t in enumerate(texts)], DOC)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---------------------------------------------------------------- chat formatting


def test_chat_round_trip(spark):
    text = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> [\\INST]", "a<|im_end|><|im_start|>user<|im_sep|>", "", None, "<", "[INST", "plain"]
    turns = [(1, i, ("user", "assistant", "system", None)[i % 4], t) for i, t in enumerate(text)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 0, "user", "q"), (None, None, "assi<s>stant", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(7))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.expand_prefixes(df)).collect()}
    digest = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns[:8]).encode()).hexdigest()
    loss = "".join(t or "" for _, _, r, t in turns[:8] if r == "assistant")
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"]) == (8, digest, len(loss))
    assert got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[3]["loss_chars"], got[None]["n_turns"]) == (2, 2, 0, 1)
    ex = chat_format.expand_prefixes(df.where("conv_id = 1")).orderBy("example").collect()
    assert [e["example"] for e in ex] == [2, 6, 8]
    assert all(b["formatted"].startswith(a["formatted"]) for a, b in zip(ex, ex[1:], strict=False))
    assert chat_format.expand_prefixes(df.limit(0)).count() == 0


# ---------------------------------------------------------------- search


def test_hamming_top_k_is_exact(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(150)]
    codes = [(i, base[i % 150]) for i in range(400)]
    df = spark.createDataFrame(codes, "id long, code long")
    got = defaultdict(list)
    for r in hamming_search.top_k(df, df.where("id % 100 = 0"), k=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["neighbor_id"]))
    for q in (0, 100, 200, 300):
        want = sorted(((codes[q][1] ^ c) & (2**64 - 1)).bit_count() * 1000 + i for i, c in codes)[:7]
        assert got[q] == [(w // 1000, w % 1000) for w in want]
    assert hamming_search.top_k(df.limit(3), df.limit(1), k=7).count() == 3
    assert hamming_search.top_k(df.limit(0), df.limit(1), k=7).count() == 0


def test_sign_codes(spark):
    ok = [1.0] + [-1.0] * 62 + [2.0]
    d = spark.createDataFrame([(1, ok), (2, None), (3, ok[:5]), (4, [None, *ok[1:]]), (5, [float("nan"), *ok[1:]])], "i long, v array<double>")
    assert [(r["id"], r["code"]) for r in hamming_search.sign_codes(d, "i", "v").collect()] == [(1, 1 - (1 << 63))]


# ---------------------------------------------------------------- language ID, toxicity


def test_language(spark):
    rng = random.Random(5)
    make = {"aa": ["aba", "abu", "bab"], "cc": ["cec", "dec", "ced"]}
    rows_ = [(i, " ".join(rng.choices(make[lang], k=30)), lang) for i in range(200) for lang in [("aa", "cc")[i % 2]]]
    train = spark.createDataFrame(rows_ + [(900, None, "aa"), (901, "aba", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train, per_language=40)
    test = spark.createDataFrame([(1, "aba bab abu"), (2, "cec ced"), (3, None), (4, "123 --"), (5, ""), (6, "aba " * 50_000), (7, "zzz qqq")], "doc_id long, text string")
    got = rows(language_id.predict(test.withColumn("lang", F.lit(1)), model))
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["aa", "cc", "und", "und", "und", "aa"]
    assert [got[i]["rejected"] for i in range(1, 8)] == [False, False, True, True, True, False, True]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sorted(r["doc_id"] for r in language_id.drop_rejected(test, model).collect()) == [1, 2, 6]
    nothing = language_id.fit(train.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(test, nothing).collect()} == {"und"}
    assert language_id.predict(test.limit(0), model).count() == 0


def test_language_rejects_what_it_has_not_learned(spark):
    rng = random.Random(12)
    vocab = {
        "en": "the of and to in is was that for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so".split(),
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben".split(),
    }
    text = lambda lang, n: " ".join(rng.choices(vocab[lang], k=n))
    train = [(i, text(("en", "de")[i % 2], rng.choice([1, 20, 60, 200])), ("en", "de")[i % 2]) for i in range(400)]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    clean = [text(("en", "de")[i % 2], n) for i in range(200) for n in (4, 15, 100)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    foreign = ["".join(rng.choices(letters, k=600)), "".join(rng.choices(letters + "     ", k=600)), base64.b64encode(rng.randbytes(450)).decode(), rng.randbytes(300).hex(), finnish]
    got = rows(language_id.predict(docs(spark, [*foreign, *clean]), model))
    assert [got[i]["rejected"] for i in range(5)] == [True] * 5
    assert sum(got[5 + i]["rejected"] for i in range(len(clean))) <= 0.03 * len(clean)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_against_edit_distance():
    terms = {"idiot": 1.0, "stupid": 1.0, "scum": 1.0, "moron": 1.0}
    auto = toxicity.TrieAutomaton(toxicity.Lexicon(terms))
    rng = random.Random(6)
    for _ in range(3000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 2)):
            k, at, c = rng.randint(0, 2), rng.randrange(len(w) + 1), rng.choice("idotsupcmrn")
            w[at : at + (k > 0)] = [c] if k < 2 else []
        w = "".join(w)
        near = w in terms or (len(w) >= 4 and any(len(t) >= 5 and edits(w, t) <= 1 for t in terms))
        assert (auto.match(w) is not None) == near, w


def test_toxicity(spark):
    rng = random.Random(7)
    words = ["the", "cat", "sat", "mat", "hat", "dog", "ran", "far", "sun", "sea"]
    make = lambda bad: " ".join(rng.choices(words, k=25) + ([rng.choice(["idiot", "vequa", "vequo", "vequi", "vequs"])] if bad else []) + rng.choices(words, k=5))
    d = spark.createDataFrame([(i, make(i % 4 == 0)) for i in range(800)], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    got = rows(toxicity.score_toxicity(d, labels))
    assert [r["predicted"] for _, r in sorted(got.items())] == [int(i % 4 == 0) for i in range(800)]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    lexicon = toxicity.fit(d, labels)
    odd = rows(toxicity.score(docs(spark, [*ODD, "you IDIOT", 'he said "you idiot" to them', "a vequmo here", "cat " * 100_000 + "idiot"]), lexicon))
    assert [odd[i]["score"] for i in range(9)] == [0.0] * 9
    assert (odd[9]["predicted"], odd[11]["predicted"], odd[12]["predicted"]) == (1, 1, 1)
    assert odd[10]["score"] < odd[9]["score"]
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs(spark, [None, "you idiot", "cat"]), lexicon).collect()) == [0, 2]
    empty = toxicity.score_toxicity(d, labels.limit(0))
    assert {r["score"] for r in empty.collect()} == {0.0}
    assert toxicity.score(d.limit(0), lexicon).count() == 0


# ---------------------------------------------------------------- components and near-duplicates


def groups(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(300, 200), (300, 201), (5, 5), (0, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == groups({n for e in real for n in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_minhash_against_all_pairs(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 12, 60, 200]))] for _ in range(25)]
    texts = list(ODD)
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(c) // 25))):
                c[rng.randrange(len(c))] = f"n{rng.randint(0, 99)}"
            texts.append((" " if rng.random() < 0.5 else "\n").join(c).upper() if rng.random() < 0.3 else " ".join(c))
    sets = {i: shingles(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if t else t, 4) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = rows(minhash_dedup.near_duplicates(docs(spark, texts).withColumn("n_shingles", F.lit(1)), width=4))
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == groups(sets, links)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_minhash_repeats_and_empty(spark):
    d = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(5, 2, False), (5, 2, False), (-1, None, True), (2, 2, True), (9, 9, True)], key=str)
    assert minhash_dedup.near_duplicates(d.limit(0)).count() == 0


def test_bitmaps_never_reject_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64)
        y = np.concatenate([x[: max(1, int(len(x) * rng.uniform(0.7, 1)))], rng.integers(0, 1 << 62, rng.integers(0, 60)).astype(np.uint64)])
        bits = sum(int(v).bit_count() for v in (minhash_dedup.parity_bitmap(np.unique(x)) ^ minhash_dedup.parity_bitmap(np.unique(y))).view(np.uint64))
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(260, 64))
    for i in range(120):
        v[140 + i] = v[i % 40] + rng.normal(size=64) * rng.uniform(0.05, 0.6)
    v[30] = v[31]
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, [])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("id", F.lit("x"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T
    links = [(a, b) for a in range(260) for b in range(a) if cos[a, b] >= 0.9] + [(904, 905)]
    want = groups([i for i, _ in data + odd], links)
    degree = Counter(x for e in links for x in e)
    got = rows(embedding_dedup.near_duplicate_vectors(df), "vec_id")
    found = sum(r["n_links"] for r in got.values())
    assert all(r["n_links"] <= degree[i] for i, r in got.items())
    assert found >= 0.99 * sum(degree.values())
    assert sum(got[i]["component_id"] == c for i, c in want.items()) >= 0.99 * len(want)
    assert all(got[i]["n_links"] == 0 for i in (900, 901, 902, 903, 906))
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("per_table", [2, 3, 4])
def test_recall_at_the_threshold_is_the_same_at_every_size(spark, per_table):
    rng = np.random.default_rng(20 + per_table)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    v = np.concatenate([x, 0.9001 * x + math.sqrt(1 - 0.9001**2) * y])
    cos = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    want = (cos >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, [float(z) for z in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = rows(embedding_dedup.near_duplicate_vectors(df, per_table=per_table), "vec_id")
    assert want.sum() >= 800
    assert all(got[i]["n_links"] <= n for i, n in enumerate(want))
    assert sum(r["n_links"] for r in got.values()) >= 0.995 * want.sum()


@pytest.mark.parametrize("spread", [0.15, 0.3, 0.45])
def test_groups_of_near_copies_are_counted_by_balls(spark, spread):
    """Tight groups link as wholes; in loose ones some members of a ball link with another ball and some don't."""
    rng = np.random.default_rng(5)
    v = np.concatenate([c + spread * rng.uniform(0.2, 1.2, (80, 1)) * rng.normal(size=(80, 64)) for c in rng.normal(size=(3, 64))] + [rng.normal(size=(60, 64))])
    v[5], v[6], v[7] = 2 * v[4], v[4], v[4]
    cos = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    links = [(a, b) for a in range(len(v)) for b in range(a) if cos[a, b] >= 0.9]
    want, degree = groups(range(len(v)), links), Counter(x for e in links for x in e)
    df = spark.createDataFrame([(i, [float(z) for z in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = rows(embedding_dedup.near_duplicate_vectors(df), "vec_id")
    assert all(r["n_links"] <= degree[i] for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.999 * sum(degree.values()) > 4000
    assert sum(got[i]["component_id"] == c for i, c in want.items()) >= 0.99 * len(want)


def test_near_copies_of_one_vector_are_not_paired(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=64) + 0.1 * rng.normal(size=(300, 64))
    classes = spark.createDataFrame([(i, [float(z) for z in row], 1) for i, row in enumerate(v)], "id long, v array<double>, n long").cache()
    hashed = embedding_dedup._hashed(classes, 8, 1).cache()
    members = embedding_dedup._balls(classes, hashed, 0.9)
    assert members.select("ball").distinct().count() < 30
    assert embedding_dedup._meetings(hashed, members, 0.9).count() < 300


# ---------------------------------------------------------------- pages

PAGES = [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"),
    ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>One  <b>two</b>\n three.<p>Of.<br>x<div class='ad-box'>buy</div><section id=comments><p>me too</p></section></article><footer>f</footer>", "Head\nOne two three.\nOf. x"),
    ("<body><div class=cookie-notice>We use cookies</div><div class=sidebar>links</div><div><p>" + "long text here " * 20 + "</p><p>short</p><p>" + "more text there " * 20 + "</p></div><form><p>name</p></form></body>",
     ("long text here " * 20).strip() + "\nshort\n" + ("more text there " * 20).strip()),
    ("<article><p>a<script>var t='</p>';</script>b<style>p{}</style></p><!-- c --><p>&copy;&nbsp;x &lt;y&gt;</p></article>", "ab\n© x <y>"),
    ("<article><p>unclosed <i>tag", "unclosed tag"), ("<p hidden>no</p><p>yes yes yes</p>", "yes yes yes"), ("</div></p><<<", "<<<"),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_main_text(html, want):
    assert html_extract.main_text(html) == want


STORY = "<h1>Head</h1>" + "<p>" + "long text here " * 20 + "</p>"
TOLD = "Head\n" + ("long text here " * 20).strip()
WRAPPED = [
    f"<html class='no-sidebar'><body class='has-sidebar'><div class='sidebar'>links</div>{STORY}</body></html>",
    f"<body><main class='with-sidebar'>{STORY}<div class='related'>more of it</div></main></body>",
    f"<body><div id='page' class='header-fixed'><div class='menu'>go</div><div class='content-with-sidebar'>{STORY}</div><div class='sidebar'>see also</div></div></body>",
    f"<body><div class='has-sidebar'><article class='comments-open'>{STORY}<div class='share'>share it</div></article><div class='related'><article><p>other</p></article></div></div></body>",
    f"<body>{STORY}<div class='comments'><article class='comment'><p>{'me too and more ' * 60}</p></article></div></body>",
    f"<body><article>{STORY}</article><div class='related'><article><p>{'another story of it ' * 20}</p></article></div></body>",
]


@pytest.mark.parametrize("html", WRAPPED)
def test_marked_wrappers_of_the_content_are_no_furniture(html):
    assert html_extract.main_text(html) == TOLD


def test_pages_table(spark):
    d = spark.createDataFrame([(i, None, h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = rows(html_extract.extract_main_text(d), "page_id")
    assert {i: (r["text"], r["n_chars"]) for i, r in got.items()} == {i: (w, len(w)) for i, (_, w) in enumerate(PAGES)}
    assert html_extract.extract_main_text(d.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing, packing, sharding


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, fixed = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(10)
    data = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 40, 900]))) or None, rng.choice(["a", "a", "a", "b", "c", None, "dé"]), "z") for i in range(300)] + [(1000, "q " * 5, "tiny", "z"), (1000, "q " * 5, "tiny", "z"), (1001, "", "void", "z")]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, words string")
    size = Counter()
    for _, t, s, _ in data:
        size[s] += len((t or "").split())
    got = mixing.mix(d, block_words=16).collect()
    assert len(got) == len(data)
    by = {r["doc_id"]: r for r in got}
    taken = Counter()
    source = {i: s for i, _, s, _ in data}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    want = waterfill(size)
    for s in size:
        r = by[next(i for i, x in source.items() if x == s)]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["source_size"] == size[s]
        assert abs(taken[s] - want[s]) <= 16 + 0.02 * want[s]
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(d.repartition(7), block_words=16).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    mixed = mixing.mixed_documents(d, block_words=16)
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert all(words[i] == sum(r["taken"] for r in got if r["doc_id"] == i) for i in by)
    assert mixing.mix(d.limit(0)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def paths():
    P = pytest.importorskip("public_tokenizers")
    return str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken"))


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, *["word " * n for n in (1, 5, 500, 1000, 2046, 2047, 2048, 5000)], "naïve  café x\x85y ２"]
    d = docs(spark, texts).union(docs(spark, texts[:3])).withColumn("length", F.lit(1))
    got = packing.pack(d, *paths()).collect()
    tok = Tokenizer.from_file(paths()[0])
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]})
        assert [(a, n) for _, a, n, _ in mine] == [(a, n) for a, n in zip(np.cumsum([0, *[n for _, _, n, _ in mine]])[:-1], [n for _, _, n, _ in mine], strict=True)]
        assert sum(n for _, _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for _, a, n, c in mine)
        assert all(n == 2048 for k, _, n, _ in mine if k)
    total = sum(r["length"] for r in got)
    assert len(seqs) <= math.ceil(total / 2048) + 1
    assert packing.pack(d.limit(0), *paths()).count() == 0


def test_best_fit_plan():
    rng = random.Random(11)
    sizes = [rng.randint(1, 64) for _ in range(2000)]
    counts = Counter(sizes)
    plan = packing.best_fit(counts, 64)
    bins = defaultdict(list)
    for size, a, b, first, offset in plan:
        for k in range(b - a):
            bins[first + k].append((offset, size))
    assert Counter(s for v in bins.values() for _, s in v) == counts
    for v in bins.values():
        at = 0
        for offset, size in sorted(v):
            assert offset == at
            at += size
        assert at <= 64
    gaps = []
    for s in sorted(sizes, reverse=True):  # best fit, one piece at a time
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit or 64) - s)
    assert len(bins) == len(gaps)


def test_sharding(spark):
    texts = [*ODD, *["copy of one text"] * 300, *[f"text {i} " * (i % 40) for i in range(700)]]
    got = sharding.shard(docs(spark, texts).withColumn("size", F.lit(1)), shards=4).collect()
    assert len(got) == len(texts)
    slots, size = defaultdict(list), Counter()
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert sorted(slots) == [0, 1, 2, 3]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.06 * sum(size.values()) / 4
    assert sharding.shard(docs(spark, []), shards=4).count() == 0
    same = sharding.shard(docs(spark, ["only one text"] * 400), shards=4).groupBy("shard").count().collect()
    assert len(same) == 4
    assert max(r["count"] for r in same) <= 120


# ---------------------------------------------------------------- repeated rows and the bounds of samples


def _repeated(spark):
    """10,000 equal rows, as many rows of one id with different texts, and a few others in two languages."""
    equal = spark.range(10_000).selectExpr("4L doc_id", "'der kleine hund geht heim' text", "'de' lang", "'s' source", "25L n_chars")
    one_id = spark.range(10_000).selectExpr("11L doc_id", "concat('the small dog number ', id, ' walks home') text", "'en' lang", "'s' source", "30L n_chars")
    rest = spark.range(100, 160).selectExpr("id doc_id", "case when id % 2 = 0 then concat('ein hund und eine katze ', id) else concat('a dog and a cat ', id) end text", "case when id % 2 = 0 then 'de' else 'en' end lang", "'s' source", "20L n_chars")
    none = spark.sql("SELECT CAST(NULL AS BIGINT) doc_id, 'ohne nummer' text, 'de' lang, 's' source, 11L n_chars")
    return equal.unionByName(one_id).unionByName(rest).unionByName(none)


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    limits = language_id._limits
    monkeypatch.setattr(language_id, "_limits", lambda texts, *rest: seen.append(texts) or limits(texts, *rest))
    d = _repeated(spark)
    model = language_id.fit(d.select("doc_id", "text", "lang"), per_language=50)
    by = Counter(r["lang"] for r in seen[0].collect())
    assert max(by.values()) <= 50 and set(by) == {"de", "en"}
    assert seen[0].where("doc_id = 4").count() <= 1
    got = Counter((r["doc_id"], r["lang_pred"]) for r in language_id.predict(d.where("doc_id in (4, 101) or doc_id is null"), model).collect())
    assert got[4, "de"] == 10_000 and got[101, "en"] == 1 and sum(n for (i, _), n in got.items() if i is None) == 1


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 30)
    d = _repeated(spark).select("doc_id", "text")
    known = spark.sql("SELECT explode(sequence(100L, 159L)) doc_id").selectExpr("doc_id", "cast(doc_id % 2 as int) toxic").union(spark.sql("SELECT * FROM VALUES (4L, 1), (11L, 0) AS t(doc_id, toxic)"))
    rows = toxicity._sample(d, known).collect()
    by = Counter(r["toxic"] for r in rows)
    assert 0 < by[1] <= 40 and 0 < by[0] <= 30
    assert sum(r["doc_id"] == 4 for r in rows) <= 1
    lexicon = toxicity.fit(d, known)
    assert toxicity.score(d.where("doc_id is null"), lexicon).count() == 1
