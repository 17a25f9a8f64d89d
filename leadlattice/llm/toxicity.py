"""Toxicity scores from a learned lexicon: a trie met by Levenshtein automata, and the context of each hit."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlattice.llm.common import materialize, small

#: The fit uses at most so many labelled texts of each class, those of least hashed id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 8000
#: A term or stem must be met in so many different neighbourhoods, so that copies of one text don't make it one.
LEAST_CONTEXTS, LEAST_STEM_WORDS, STEM_LENGTHS = 3, 3, (4, 5, 6, 7)
#: The least share of toxic texts among those with a term, and how many candidates may pass by chance.
LEAST_PRECISION, BY_CHANCE = 0.9, 0.01
#: Misspellings of words from this length on are looked for, one edit away.
FUZZY_FROM = 5
THRESHOLD = 0.7
WINDOW_CHARS, QUOTED_FACTOR, CUE_FACTOR = 120, 0.35, 0.6
_MEMO_LIMIT, _STATE_LIMIT = 300_000, 200_000
WORD = re.compile(r"\w+(?:[*@$!]\w+)*")
#: Opening and closing quotation marks, and words that report speech.
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("»", "«"))
CUES = frozenset("said says wrote called quote quoted quoting word term insult slur reported sagte schrieb wort zitat dit écrit mot cité dijo escribió palabra cita".split())


@dataclass
class Lexicon:
    """Weights of whole terms and of stems (a stem stands for all words that begin with it)."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Weight of a misspelling, and near words that clean texts use.
    fuzzy: float = 0.0
    ordinary: frozenset[str] = frozenset()


class TrieAutomaton:
    """The union of the one-edit Levenshtein automata of all terms, run along the trie of the terms.

    A configuration is (trie node, edits so far). Sets of them are states; transitions are made when first needed
    and kept, so a word costs one look-up for each character until no term is within reach.
    """

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for word, ends in [(w, self.term) for w in lexicon.terms] + [(w, self.stem) for w in lexicon.stems]:
            node = 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.term.append(None), self.stem.append(None)
                node = self.children[node][c]
            ends[node] = word
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, configs: set[tuple[int, int]]) -> int:
        # A character of the term may be missing in the word: one edit without reading.
        closed = frozenset(configs | {(n, 1) for node, e in configs if e == 0 for n in self.children[node].values()})
        if closed not in self.ids:
            self.ids[closed] = len(self.states)
            self.states.append(closed)
            self.moves.append({})
        return self.ids[closed]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.states[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            if e == 0:
                out.add((node, 1))
                out |= {(n, 1) for n in self.children[node].values()}
        self.moves[state][c] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[str, str] | None:
        """('term' | 'stem' | 'fuzzy', the entry) that the word meets, whole terms first."""
        if len(self.states) > _STATE_LIMIT:
            self._reset()
        state = self.start
        stem, node = None, 0
        for c in word:
            node = self.children[node].get(c, -1) if node >= 0 else -1
            if node >= 0 and self.stem[node] is not None and stem is None:
                stem = self.stem[node]
            state = self.moves[state].get(c, -1) if c in self.moves[state] else self._move(state, c)
            if not self.states[state] and stem is None:
                return None
        if node >= 0 and self.term[node] is not None:
            return "term", self.term[node]
        if stem is not None:
            return "stem", stem
        near = sorted(self.term[n] for n, _ in self.states[state] if self.term[n] is not None and len(self.term[n]) >= FUZZY_FROM)
        return ("fuzzy", near[0]) if near and len(word) >= FUZZY_FROM - 1 else None


class Scorer(dict):
    """Word to (kind, weight) or None, remembered up to a bounded number of words; and the score of whole texts."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.automaton = lexicon, TrieAutomaton(lexicon)

    def __missing__(self, word: str) -> tuple[str, float] | None:
        if len(self) > _MEMO_LIMIT:
            self.clear()
        kind, entry = self.automaton.match(word) or (None, None)
        found = None
        if kind == "term":
            found = kind, self.lexicon.terms[entry]
        elif kind == "stem":
            found = kind, self.lexicon.stems[entry]
        elif kind == "fuzzy" and word not in self.lexicon.ordinary:
            found = kind, self.lexicon.fuzzy
        self[word] = found
        return found

    def _factor(self, text: str, start: int, end: int) -> float:
        """How much a hit counts by the window around it: quoted and reported words count less than abuse."""
        line_from, line_to = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        before = text[max(line_from, start - WINDOW_CHARS) : start]
        after = text[end : min(len(text) if line_to < 0 else line_to, end + WINDOW_CHARS)]
        for left, right in QUOTES:
            opened = before.count(left) % 2 == 1 if left == right else before.rfind(left) > before.rfind(right)
            if opened and right in after:
                return QUOTED_FACTOR
        return CUE_FACTOR if CUES & set(WORD.findall(before)[-4:]) else 1.0

    def score(self, text: str) -> tuple[float, int]:
        """1 - exp(-sum of weights by context), each different word counting once at its gravest; and the hits."""
        low = text.lower()
        hot = {w for w in set(WORD.findall(low)) if self[w] is not None}
        if not hot:
            return 0.0, 0
        worst: dict[str, float] = {}
        hits = 0
        for m in WORD.finditer(low):
            if (w := m[0]) in hot:
                hits += 1
                worst[w] = max(worst.get(w, 0.0), self[w][1] * self._factor(low, m.start(), m.end()) if worst.get(w, 0.0) < self[w][1] else 0.0)
        sure = sum(x for w, x in worst.items() if self[w][0] != "fuzzy")
        # Chance neighbours of terms add up in long texts, so misspellings count by the gravest one, a little more for others.
        vague = [x for w, x in worst.items() if self[w][0] == "fuzzy"]
        total = sure + (max(vague) * (1 + 0.1 * min(5, len(vague) - 1)) if vague else 0.0)
        return 1 - math.exp(-total), hits


def _sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """At most the stated number of different whole texts of each class, by least hashed id, however often rows repeat."""
    ids = docs.where("text is not null").select("doc_id").distinct().join(known, "doc_id")
    # Each task sorts out its own least ids first, so no task reads all rows of a class.
    least = [ids.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most) for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = least[0].union(least[1]).select("doc_id", "toxic")
    rows = docs.where("text is not null").select("doc_id", "text").join(small(chosen), "doc_id").withColumn("t", F.xxhash64("text"))
    rows = materialize(rows.dropDuplicates(["doc_id", "toxic", "t"]), "sample")
    # An id may have many texts: rows are bounded as ids are, and each id's first text comes before any second one.
    found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if found.get(1, 0) > SAMPLE_TOXIC or found.get(0, 0) > SAMPLE_CLEAN:
        keys = rows.select("doc_id", "toxic", "t", F.row_number().over(Window.partitionBy("doc_id").orderBy("t")).alias("k"))
        least = [keys.where(F.col("toxic") == label).orderBy("k", F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most) for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
        rows = materialize(rows.join(small(least[0].union(least[1]).drop("k")), ["doc_id", "toxic", "t"]), "sample")
    return rows.select("doc_id", "toxic", "text")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, neighbourhood) of every word."""
    for batch in batches:
        for text in batch.column(0):
            words = ["", *WORD.findall(text.as_py().lower()), ""]
            met = {(w, hash_of(a, b)) for a, w, b in zip(words, words[1:], words[2:], strict=False)}
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in met], pa.string()), pa.array([c for _, c in met], pa.int64())], ["word", "context"])


def hash_of(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{a} {b}".encode("utf-8", "surrogatepass")) >> 1


def _chance(toxic: int, clean: int, share: float) -> float:
    """A bound on the probability that of toxic + clean texts so many are toxic, if each is with the given share."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return 1.0
    return math.exp(-n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))) if share else 0.0


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learns from docs (doc_id, text) that labels (doc_id, toxic) covers; what the driver gets is bounded by the sample's bound.

    Candidates are the words, and the stems of several words, that toxic texts of the sample use in enough
    different neighbourhoods. Counting texts of both classes with each candidate then gives its precision at the
    rate of labels in all rows; those below the least precision go, and those that so many candidates bring up by chance. Last, words of clean texts that are one edit
    from a term are noted as ordinary, and the weight of misspellings follows from how often toxic texts use
    others, against the rate of near words that only one clean text uses (what further clean texts will bring).
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not of.get(1):
        return Lexicon()
    rate = of[1] / sum(of.values())
    sample = _sample(docs, known)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    met = sample.where("toxic = 1").select("text").mapInArrow(_contexts, "word string, context long").distinct()
    words = met.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.length("word").between(3, 40))
    terms = {r["word"]: r["n"] for r in words.where(F.col("n") >= LEAST_CONTEXTS).collect()}
    stems = words.select("word", "n", F.explode(F.array(*[F.substring("word", 1, k) for k in STEM_LENGTHS])).alias("stem")).where("length(word) > length(stem)").distinct()
    stems = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).where((F.col("words") >= LEAST_STEM_WORDS) & (F.col("n") >= LEAST_CONTEXTS))
    stems = {r["stem"]: (r["n"], r["words"]) for r in stems.collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = set(WORD.findall(text.as_py().lower()))
                seen.update(("term", w, label) for w in own & terms.keys())
                seen.update(("stem", s, label) for s in {w[:k] for w in own for k in STEM_LENGTHS if len(w) > k} & stems.keys())
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys]).cast(t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))] + [pa.array([seen[k] for k in keys], pa.int64())], ["kind", "entry", "label", "n"])

    counted = sample.select(F.col("toxic").cast("long"), "text").mapInArrow(count, "kind string, entry string, label long, n long")
    counted = counted.groupBy("kind", "entry").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    pos, neg = rate * F.col("toxic") / max(1, sizes.get(1, 0)), (1 - rate) * (F.col("clean") + 0.2) / max(1, sizes.get(0, 0))
    good = counted.where(F.col("toxic") >= 2).withColumn("p", pos / (pos + neg)).where(F.col("p") >= LEAST_PRECISION).collect()
    share = sizes.get(1, 0) / max(1, sizes.get(1, 0) + sizes.get(0, 0))
    contexts = {("term", w): n for w, n in terms.items()} | {("stem", w): n for w, (n, _) in stems.items()}
    good = [r for r in good if _chance(min(r["toxic"], contexts[r["kind"], r["entry"]]), r["clean"], share) * len(contexts) <= BY_CHANCE]
    weigh = lambda p: min(3.0, -math.log(max(1 - p, 1e-9)))
    lexicon = Lexicon({r["entry"]: weigh(r["p"]) for r in good if r["kind"] == "term"}, {r["entry"]: weigh(r["p"]) for r in good if r["kind"] == "stem"})
    # Of stems within stems the longest that still stands for nearly all words of the shorter one stays.
    specific = {s for s in lexicon.stems if not any(t != s and t.startswith(s) and stems[t][1] >= 0.9 * stems[s][1] for t in lexicon.stems)}
    lexicon.stems = {s: w for s, w in lexicon.stems.items() if s in specific and not any(s[:k] in specific for k in range(1, len(s)))}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = Scorer(lexicon), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.update((w, label) for w in set(WORD.findall(text.as_py().lower())) if (scorer[w] or ("", 0))[0] == "fuzzy")
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["word", "label", "n"])

    found = sample.select(F.col("toxic").cast("long"), "text").mapInArrow(near, "word string, label long, n long").groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")
    ).collect()
    lexicon.ordinary = frozenset(r["word"] for r in found if r["clean"])
    hits = sum(r["toxic"] for r in found if not r["clean"])
    pos, neg = rate * hits / max(1, sizes.get(1, 0)), (1 - rate) * (sum(r["clean"] == 1 for r in found) + 0.2) / max(1, sizes.get(0, 0))
    lexicon.fuzzy = min(2.0, weigh(pos / (pos + neg))) if hits else 0.5
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted, hits) of each row of docs (doc_id, text), from the whole text alone.

    Null and empty texts score 0. An empty lexicon scores everything 0. Repeated rows each get a row, an empty
    table gives an empty one, further columns are left out. predicted is 1 from a score of 0.7 on.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for pdf in batches:
            got = [scorer.score(t) if isinstance(t, str) else (0.0, 0) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [s for s, _ in got], "predicted": [int(s >= THRESHOLD) for s, _ in got], "hits": [h for _, h in got]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int, hits long")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold; null texts stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([t.as_py() is None or scorer.score(t.as_py())[0] < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str = "doc_id", of: int = 3):  # noqa: ANN201
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def fit_on_folds(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learns from the labels of folds 0 and 2 only."""
    return fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(fold() != 1))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on labels of the training folds (0 and 2) and scores all docs: doc_id, held_out, score, predicted, hits."""
    lexicon = fit_on_folds(docs, labels)
    out = score(docs, lexicon)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted", "hits")
