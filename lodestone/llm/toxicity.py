"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned: words, and stems shared by many words, that toxic documents hold far more often than others. It is
kept as a trie; intersecting it with Levenshtein automata gives one automaton, made deterministic as words ask for it, that
accepts a lexicon term with up to 1 error (5 letters or more) or 2 errors (8 or more), or a word that begins with a stem. For every hit
a window of words around it tells quotation (quotation marks on both sides) from abuse and measures how dense hits are. A
logistic model over those figures gives the score.

It is fitted on at most SAMPLE labelled rows of each class, those with the smallest hashes, none of them held out.
Defined results: null and empty texts are scored like texts without hits; without labelled rows of both classes the score
is the share of toxic ones among the labelled, 0 if none. Labels that are null or whose document is missing don't count; a
doc_id labelled repeatedly is toxic if one label says so. A row with a null doc_id is scored and not held out. Texts of any
length are scored whole. Rows of an empty table have no scores; other columns of docs come through score_column as they are,
and a name that one of them has already is refused.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, documents, free_name, sliced, texts_of, written

SAMPLE = 4000
#: Letters of the shortest and the longest stem.
STEMS = (3, 8)
WINDOW = 10
QUOTES = "\"“”„«»‘’‹›"
_WORD = re.compile(r"\w+")
#: Words, and states of the automaton, that a worker keeps; beyond, both are made anew.
_CACHED, _STATES = 200_000, 40_000


class Lexicon:
    """The deterministic automaton of a set of terms; a term that ends in * is a stem. kind(word): 0, 1 exact, 2 misspelled."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.errors: list[int] = [0]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        for term in terms:
            letters = term.rstrip("*")
            allowed = 2 if len(letters) >= 8 else 1 if len(letters) >= 5 else 0
            node = 0
            path = [0]
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.errors.append(0)
                    self.word.append(-1)
                    self.stem.append(-1)
                node = self.children[node][c]
                path.append(node)
            if term.endswith("*"):
                self.stem[node] = 0
            else:
                self.word[node] = allowed
                for p in path:
                    self.errors[p] = max(self.errors[p], allowed)
        self.known: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[int] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, states: set) -> frozenset:
        """With term letters left out, one error each; a node's greater errors are dropped beside smaller ones."""
        todo, best = list(states), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values() if e < self.errors[child]] if node >= 0 else []
        return frozenset(best.items())

    def _state(self, states: frozenset) -> int:
        if states not in self.states:
            self.states[states] = len(self.sets)
            self.sets.append(states)
            self.next.append({})
            found = 0
            for node, e in states:
                if node < 0 or self.word[node] >= e:
                    found = 1 if node < 0 or e == 0 else found or 2
            self.accept.append(found)
        return self.states[states]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if node < 0:
                out.add((-1, 0))
                continue
            if e < self.errors[node]:
                out.add((node, e + 1))
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, e))
                    if e == 0 and self.stem[child] == 0:
                        out.add((-1, 0))
                elif e < self.errors[child]:
                    out.add((child, e + 1))
        self.next[state][c] = found = self._state(self._closed(out))
        return found

    def kind(self, word: str) -> int:
        if (found := self.known.get(word)) is not None:
            return found
        state = self.start
        for c in word:
            following = self.next[state].get(c)
            state = self._step(state, c) if following is None else following
            if state == self.dead:
                break
        found = self.accept[state]
        if len(self.sets) > _STATES:
            self._restart()
        if len(self.known) > _CACHED:
            self.known.clear()
        self.known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Of a text: logarithms of exact, misspelled and quoted hits, the densest window's hits and hits per hundred words."""
        lower = text.lower()
        kind = self.kind
        if not any(map(kind, set(_WORD.findall(lower)))):
            return [0.0] * 6
        matches = list(_WORD.finditer(lower))
        hits = [(i, m, k) for i, m in enumerate(matches) if (k := kind(m[0]))]
        exact = misspelled = quoted = 0
        for i, m, k in hits:
            first, last = matches[max(0, i - WINDOW)].start(), matches[min(len(matches) - 1, i + WINDOW)].end()
            before, after = lower[first : m.start()], lower[m.end() : last]
            if sum(c in QUOTES for c in before) % 2 and any(c in QUOTES for c in after):
                quoted += 1
            elif k == 1:
                exact += 1
            else:
                misspelled += 1
        at = np.array([i for i, _, _ in hits])
        dense = int((np.searchsorted(at, at + 2 * WINDOW, "right") - np.arange(len(at))).max())
        return [math.log1p(exact), math.log1p(misspelled), math.log1p(quoted), math.log1p(dense), min(1.0, 100 * exact / len(matches)), float(exact > 1)]


def held_out() -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _prefixes(words: set[str]) -> set[str]:
    """Whole words, and their beginnings of STEMS letters, as stems."""
    low, high = STEMS
    return {w for w in words if len(w) >= low} | {w[:n] + "*" for w in words for n in range(low, min(len(w), high + 1))}


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Terms of a sample (text, toxic) that toxic documents have far more often, and beside a stem, which allows no error, the
    words that at least half of its documents have. All of them come to the driver; the sample's bound bounds them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in sliced(batches):
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(_prefixes(set(_WORD.findall(text.lower()))))
        terms = list(seen[0].keys() | seen[1].keys())
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)], names=["term", "clean", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    counted = sample.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    least = max(4, n_toxic // 100)
    strong = counted.where((F.col("toxic") >= least) & (odds >= 2.5) & (F.col("toxic") >= 19 * F.col("clean") * max(1, n_toxic) / max(1, n_clean)))
    found = {r["term"]: r["toxic"] for r in strong.orderBy(F.desc("toxic"), "term").collect()}
    terms = []
    # Forms by their letters, and by all but the last of these.
    forms: dict[str, list[str]] = {}
    for term in found:
        letters = term.rstrip("*")
        forms.setdefault(letters, []).append(term)
        forms.setdefault(letters[:-1], []).append(term)
    # The longest form that keeps a beginning's documents; then no stem that another covers.
    for term, n in found.items():
        letters = term.rstrip("*")
        longer = forms[letters] if term.endswith("*") else ()
        if not any(t != term and found.get(t, 0) >= 0.9 * n for t in longer):
            terms.append(term)
    stems = {t[:-1] for t in terms if t.endswith("*")}
    # Of the words that a stem covers, those that are the bulk of its documents: these are what others misspell.
    bulk = lambda t: any(2 * found[t] >= found[t[:k] + "*"] for k in range(STEMS[0], len(t) + 1) if t[:k] in stems)
    covered = lambda t: any(t.rstrip("*")[:k] in stems for k in range(STEMS[0], len(t.rstrip("*")) + (not t.endswith("*"))))
    return [t for t in terms if not covered(t) or (not t.endswith("*") and bulk(t))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights (the first is the intercept) by Newton's method, classes weighted alike."""
    a = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * len(y) * np.eye(len(w)) * 0.01, a.T @ (weight * (p - y)) + ridge * len(y) * 0.01 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[float]]:
    """Lexicon and weights, from at most sample rows of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = known.where(~held_out()).withColumn("h", F.xxhash64("doc_id"))
    chosen = usable.where("toxic = 1").orderBy("h", "doc_id").limit(sample).unionByName(usable.where("toxic = 0").orderBy("h", "doc_id").limit(sample)).drop("h")
    # At most 2 * sample rows are broadcast.
    rows = written(documents(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        share = 1.0 if counts.get(1) else 0.0
        return [], [30.0 * (2 * share - 1), 0, 0, 0, 0, 0, 0]
    terms = learn_lexicon(rows)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon = _lexicon(terms)
        return pa.RecordBatch.from_arrays([pa.array([lexicon.features(t) for t in texts_of(batch)], pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    found = arrow_map(rows, measure, "x array<double>, toxic int").collect()
    return terms, fit(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found])).tolist()


_lexicons: dict[tuple, Lexicon] = {}


def _lexicon(terms: list[str]) -> Lexicon:
    key = tuple(terms)
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(terms)
    return _lexicons[key]


def score_column(docs: DataFrame, model: tuple[list[str], list[float]], text: str = "text", name: str = "score") -> DataFrame:
    """The same rows with a column more, between 0 and 1."""
    terms, weights = model
    if free_name(docs, name) != name:
        raise ValueError(f"docs have a column {name} already")
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon = _lexicon(terms)
        scores = []
        for t in batch.column(at).to_pylist():
            z = weights[0] + sum(a * b for a, b in zip(weights[1:], lexicon.features(t or ""), strict=True))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return arrow_map(docs, make, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = score_column(documents(docs), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
