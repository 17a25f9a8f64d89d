"""Archives, conversation tries and manifests against plain versions, on odd rows too."""

import gzip
import hashlib
import zlib
from collections import defaultdict
from urllib.request import url2pathname

import pytest

from leadlattice.llm import conversation_trie, merkle, warc
from leadlattice.llm.common import own_dir

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- WARC

LONG, BYTES = "<p>" + "long text " * 40_000, "x" * 100
PAGES = [
    (5, "http://a/ü x\r\ny", LONG), (3, None, LONG), (9, "http://b", LONG), (1, "http://c", None), (2, "http://c", ""), (None, "http://d", LONG), (None, None, "z" * 200),
    (7, "u", BYTES), (7, "u", BYTES), (8, "u", BYTES[1:]), (6, "u", BYTES[1:]), (10, "u", "WARC/1.1\r\n\r\n\r\n" * 30), (11, "u", "é" * 50), (4, "u", "é" * 50), (12, "u", "\r\n\r\n"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "response", 0) for r in rows], "page_id long, url string, html string, record_type string, file int")


def plain_archive(rows):
    first = {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page_id)
    seen, out = set(), []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        again = len(body) >= 100 and html in seen
        seen.add(html)
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_pages_come_back_from_their_archives(spark, parts):
    got = [tuple(r) for r in warc.archived_pages(pages(spark, PAGES).repartition(parts)).collect()]
    assert sorted(got, key=repr) == plain_archive(PAGES)
    assert warc.archived_pages(pages(spark, PAGES).limit(0)).count() == 0


def test_many_copies_over_many_files(spark):
    rows = [(i, f"u{i}", "the same page " * 20 if i % 3 else f"page {i} " * 20) for i in range(400)]
    folder = own_dir(spark)
    written = warc.write_monolithic(pages(spark, rows).repartition(5).selectExpr("page_id", "url", "CAST(html AS BINARY) AS payload"), f"{folder}/whole", file_bytes=9000)
    archives = warc.normalise(warc.revisits(written), f"{folder}/members")
    files = archives.collect()
    assert len(files) > 5 and sum(r["records"] for r in files) == 400 + len(files)  # each file begins with a warcinfo record
    index = warc.read_index(archives)
    got = [tuple(r) for r in warc.read_records(index).drop("url").collect()]
    assert sorted(got, key=repr) == plain_archive(rows)
    for f in files[:2]:  # each member is a gzip file of its own, and they stand side by side
        raw = open(url2pathname(f["archive"].removeprefix("file://")), "rb").read()
        entries = sorted(index.where(index["archive"] == f["archive"]).collect(), key=lambda e: e["offset"])
        assert [e["ordinal"] for e in entries] == list(range(len(entries)))
        assert [e["offset"] for e in entries] == [sum(x["length"] for x in entries[:i]) for i in range(len(entries))]
        assert sum(e["length"] for e in entries) == len(raw) == f["bytes"]
        members = [gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]) for e in entries]
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
        assert b"".join(members) == gzip.decompress(raw)
    refer = {e["record_id"] for e in index.where("record_type = 'response'").collect()}
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(index, payloads=True).where("payload IS NOT NULL").collect()}
    assert len(refer) == len(payloads) and all(dict((i, h) for i, _, h in rows)[k] == v for k, v in payloads.items())


def test_foreign_and_broken_files(spark, tmp_path):
    """A file of several members, one with a truncated end, and one that is no archive."""
    record = lambda i, n: warc._record("resource", [("WARC-Record-ID", f"<urn:x:{i}>"), ("Content-Type", "text/plain")], bytes([65 + i]) * n)
    whole = [record(i, 10**i) for i in range(7)]
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(b"".join(whole[:3])) + gzip.compress(b"".join(whole[3:])))
    packed = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = packed.compress(b"".join(whole)) + packed.flush()
    (tmp_path / "short.warc.gz").write_bytes(data[:-200_000])
    (tmp_path / "other.gz").write_bytes(gzip.compress(b"no archive\r\n\r\n"))
    (tmp_path / "raw.gz").write_bytes(b"not even gzip")
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    names = ["members.warc.gz", "short.warc.gz", "other.gz", "raw.gz", "empty.warc.gz"]
    records = spark.createDataFrame([(f"file://{tmp_path}/{n}", 0, None) for n in names], "file string, ordinal long, refers_to string")
    made = {r["source"].rpartition("/")[2]: r for r in warc.normalise(records, own_dir(spark)).collect()}
    assert {n: made[n]["records"] for n in names} == {"members.warc.gz": 7, "short.warc.gz": 6, "other.gz": 0, "raw.gz": 0, "empty.warc.gz": 0}
    assert {n for n in names if made[n]["error"]} == {"short.warc.gz", "other.gz", "raw.gz"}
    assert gzip.open(url2pathname(made["members.warc.gz"]["archive"].removeprefix("file://"))).read() == b"".join(whole)


# ---------------------------------------------------------------- conversation trie


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, sha(f"{len(role.encode())}:{role}{text}"), text))
    turns = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].add(c)
        ends[rebuilt].add(c)
    words = lambda text: len([w for w in text.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w])
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = {n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below}
        saved = sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], sum(k == 0 for k in kids.values()), saved, sha(",".join(map(str, sorted(ends[node]))))))
    return sorted(out, key=repr)


CONVERSATIONS = {
    "odd rows": [(1, None, None, None), (1, 0, "user", "a  b\tc d"), (1, 0, "user", "a b"), (1, 0, "assistant", ""), (None, 0, "user", "nobody's"), (40, 2, "a", "x"), (41, 1, "a", "x"), (41, 1, "a", "x"), (-3, 0, "u", "minus"), (-25, 0, "u", "minus")],
    "one opening": [(c, t, ("user", "assistant")[t % 2], "hello there" if t == 0 else f"reply {c % 7 if t < 3 else c}") for c in range(90) for t in range(1 + c % 5)],
    "copies and a long one": [(c, t, "user", f"turn {t}") for c in range(0, 60, 3) for t in range(4)] + [(400, t, "user", f"w {t}") for t in range(70)] + [(401, t, "user", f"w {t}") for t in range(67)],
    "deep sharing": [(c, t, "u", f"w w {t}" if t < 6 else f"{c} {t}") for c in range(25) for t in range(6 + c % 3)],
}


@pytest.mark.parametrize("name", CONVERSATIONS)
def test_trie_is_the_plain_one(spark, name, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    df = spark.createDataFrame([(*r, 1, "x") for r in CONVERSATIONS[name]], "conv_id long, turn long, role string, text string, depth int, node string")
    got = [tuple(r)[:8] for r in conversation_trie.shared_prefixes(df.repartition(3)).collect()]
    assert sorted(got, key=repr) == plain_trie(CONVERSATIONS[name])


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.shared_prefixes(empty).count() == 0
    assert conversation_trie.trie(conversation_trie.own(conversation_trie.digested_turns(empty))).count() == 0


# ---------------------------------------------------------------- Merkle manifest


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if hit else r[1]
        groups[r[2]].append(((r[0] is not None, r[0] or 0), digest(r, r[1]), digest(r, text), r[0]))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            run = at - at % 8
            out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
            at //= 8
        return out

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, leaf, *_ in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for at, (_, leaf, claimed, doc_id) in enumerate(sorted(groups[g])):
            steps = path(trees[g], at) + path(top, place)
            now = claimed
            for left, right in steps:
                now = sha(left + now + right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), now, now == top[-1][0]))
    return sorted(out, key=repr)


DOCUMENTS = {
    "odd rows": [(None, None, None, None, None), (None, "A", None, "s", 1), (0, "", "", "", 0), (3, "ÄB ß", "de", "s", 4), (3, "ÄB ß", "de", "s", 4), (5, "Long " * 20_000, "de", None, 9), (-5, "X", "é", "s", 1), (6, "Y", "z", "s", 1)],
    "one group": [(i, f"Text {i}", "en", "s", i) for i in range(9)],
    "one row": [(1, "A", "en", "s", 1)],
    "many groups": [(i, f"T{i}", f"l{i % 70}", "s", 1) for i in range(300)],
    "tiers": [(i * 7 % 1201, f"Text {i}", ("en", "de", None)[i % 11 % 3], "s", i) for i in range(1201)],
    "equal rows": [(4, "Same", "en", "s", 1)] * 130 + [(i, "t", "de", "s", 1) for i in range(8)],
}


@pytest.mark.parametrize("name", DOCUMENTS)
@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_is_the_plain_one(spark, name, levels, monkeypatch):
    monkeypatch.setattr(merkle.prove, "__defaults__", (merkle.FANOUT, levels))
    rows = DOCUMENTS[name]
    df = spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, root string, idx int")
    got = merkle.document_manifest(df.repartition(4)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == plain_manifest(rows)
    assert {r["verified"] for r in got} <= {True, False}


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.document_manifest(empty).count() == 0
