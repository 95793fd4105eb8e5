"""Toxicity scores from a learned lexicon, misspellings included.

Terms (whole words, and stems: beginnings of words) that labelled toxic texts prefer make a lexicon,
kept as a trie.  A word is matched by running the Levenshtein automaton of that word over the trie:
the automaton's states are bit masks, one per number of edits, and branches on which no state is
left are cut.  Only terms that share a deletion neighbour with the word can be met, so the automaton
runs on the branches that lead to them.  Hits, misspelt ones too, are then scored by their
surroundings: sums over sliding windows, and hits inside quotation marks apart from the others.  A logistic regression on these sums gives the score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import saved, shuffle_width, text_of

#: Labelled rows that the lexicon and the weights are fitted on, at most: those least by hash.
FIT_ROWS = 20_000
#: Terms of the lexicon; how often a term must occur in toxic texts, and its least log odds.
TERMS, LEAST_COUNT, LEAST_ODDS = 2000, 4, 2.0
STEMS = range(4, 9)
#: Words of a window.
WINDOW = 25
#: Whole words and stems of this length and over are also found with one edit, longer words with two; shorter words count apart.
ONE_EDIT, TWO_EDITS, SHORT = 5, 10, 3
#: First letters by which deletion neighbours are looked up before all of them are formed.
HEAD = ONE_EDIT - 1
#: Words remembered by one worker, and characters of text whose new words are looked up together.
MEMORY, TOGETHER = 250_000, 1 << 20
#: Bits of the maps that new words are tried on first, as a power of two.
MAP_BITS = 22
FEATURES = 12

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"«»“”„]")
# Digits that stand for letters inside a word.
_LOOKALIKES = str.maketrans("0134578", "oieastb")


def _folded(word: str) -> str:
    return word.translate(_LOOKALIKES) if not word.isalpha() and not word.isdigit() else word


def _misspelled(terms: dict[str, float]) -> dict[str, float]:
    """The terms whose misspellings count: whole words, and stems that are long enough for an edit."""
    return {t: w for t, w in terms.items() if (len(t) > ONE_EDIT if t.endswith("*") else len(t) >= SHORT)}


def _neighbours(word: str, edits: int) -> set[str]:
    """The word with up to ``edits`` letters left out.  Words within that many edits of each other share one."""
    out = last = {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


def _without(word: str, place: int) -> str:
    return word[:place] + word[place + 1:] if place >= 0 else word


def _heads(word: str, edits: int) -> set[str]:
    """The first HEAD letters of all its deletion neighbours that are as long."""
    return set(map("".join, combinations(word[:HEAD + edits], HEAD)))


class Trie:
    """Lexicon of words and stems with weights; a stem ends in ``*``."""

    def __init__(self, terms: dict[str, float], top: bool = True):
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem = [0.0], [0.0]
        self.loose = Trie(_misspelled(terms), False) if top else self
        #: Terms by the strings that they leave with one letter left out, and its place (-1: none left out); long words by two letters.
        self.once: dict[str, list[tuple[str, int]]] = {}
        self.stems: dict[str, list[tuple[str, int]]] = {}
        self.twice: dict[str, list[str]] = {}
        #: The first letters of the strings that stems and long words leave.
        self.heads: tuple[set[str], set[str]] = set(), set()
        self.longest = 0
        for term, weight in terms.items():
            node = 0
            for c in term.rstrip("*"):
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
            (self.stem if term.endswith("*") else self.word)[node] = weight
            if not top:
                bare = term.rstrip("*")
                if len(term) >= TWO_EDITS and bare == term:
                    self.longest = max(self.longest, len(term))
                    self.heads[1].update(_heads(term, 2))
                    for rest in _neighbours(term, 2):
                        self.twice.setdefault(rest, []).append(term)
                    continue
                known = self.once if bare == term else self.stems
                if known is self.stems:
                    self.heads[0].update(_heads(bare, 1))
                for i in range(-1, len(bare)):
                    known.setdefault(_without(bare, i), []).append((term, i))

    def candidates(self, word: str) -> set[str]:
        """Terms within the allowed edits of the word or its beginning, and few others."""
        size, found = len(word), set()
        if size <= TWO_EDITS:
            for i in range(-1, size):
                for term, place in self.once.get(_without(word, i), ()):
                    if place == i or place < 0 or i < 0:
                        found.add(term)
        if size >= ONE_EDIT:
            top = min(size - 1, STEMS[-1] + 1)
            for i in range(-1, top):
                rest = _without(word[:top], i)
                if rest[:HEAD] in self.heads[0]:
                    for n in range(max(i, HEAD), len(rest) + 1):
                        for term, place in self.stems.get(rest[:n], ()):
                            if place == i or place < 0 or i < 0:
                                found.add(term)
        if TWO_EDITS - 2 <= size <= self.longest + 2 and not self.heads[1].isdisjoint(_heads(word, 2)):
            for rest in _neighbours(word, 2):
                found.update(self.twice.get(rest, ()))
        return found

    def exact(self, word: str) -> float:
        """Weight of the word, or of the heaviest stem that it goes on from."""
        node, best = 0, 0.0
        for n, c in enumerate(word, 1):
            node = self.children[node].get(c, 0)
            if not node:
                return best
            if n < len(word):
                best = max(best, self.stem[node])
        return max(best, self.word[node])

    def _branches(self, terms: Iterable[str]) -> dict[int, set[tuple[str, int]]]:
        """The part of the trie that leads to the terms."""
        out: dict[int, set[tuple[str, int]]] = {}
        for term in terms:
            node = 0
            for c in term.rstrip("*"):
                child = self.children[node][c]
                out.setdefault(node, set()).add((c, child))
                node = child
        return out

    def close(self, word: str) -> float:
        """Heaviest whole word within one edit (two, if long) of ``word``, but not equal to it."""
        return self.near(word)[0]

    def near(self, word: str, terms: set[str] | None = None) -> tuple[float, float, float]:
        """Weights of the heaviest misspelt terms: whole words as in ``close``, shorter whole words with one edit,
        and stems.  A stem is met where ``word`` goes on from the stem's last letter with one edit before it.
        ``terms``: the word's candidates, where they are known.
        """
        if terms is None:
            terms = self.candidates(word) if len(word) >= SHORT - 1 else ()
        if not terms:
            return 0.0, 0.0, 0.0
        branches = self._branches(terms)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        edits = 2 if len(word) >= TWO_EDITS - 2 else 1
        size, best, short, stem = len(word), 0.0, 0.0, 0.0
        inside = (1 << size) - 1
        # state e: bit i is set if the path so far matches the first i letters with e edits
        start = tuple(sum(1 << i for i in range(min(e, size) + 1)) for e in range(edits + 1))
        stack = [(0, 0, start, 0)]
        while stack:
            node, depth, states, kept = stack.pop()
            weight = self.word[node]
            if weight > (best if depth >= ONE_EDIT else short):
                allowed = 1 if depth < TWO_EDITS else 2
                if any(states[e] >> size & 1 for e in range(1, min(allowed, edits) + 1)) and not states[0] >> size & 1:
                    if depth >= ONE_EDIT:
                        best = weight
                    else:
                        short = weight
            if self.stem[node] > stem and kept & inside and not states[0] & inside:
                stem = self.stem[node]
            for c, child in branches.get(node, ()):
                mask, moved = masks.get(c, 0), []
                for e, now in enumerate(states):
                    new = (now & mask) << 1
                    if e:
                        new |= states[e - 1] | states[e - 1] << 1 | moved[e - 1] << 1
                    moved.append(new & (1 << size + 1) - 1)
                if any(moved):
                    stack.append((child, depth + 1, tuple(moved), (states[1] & mask) << 1))
        return best, short, stem


class _Strings:
    """Terms by the hash of a string: a bit map first, then the sorted hashes of what it lets through."""

    def __init__(self, hashes: np.ndarray, terms: list[list[str]]):
        order = np.argsort(hashes)
        self.hashes, self.terms = hashes[order], [terms[i] for i in order]
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[self._place(self.hashes)] = True

    @staticmethod
    def _place(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - MAP_BITS)

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """(row, terms) of the hashes that are known."""
        rows = np.flatnonzero(self.map[self._place(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
        for row, place in zip(rows[self.hashes[at] == h[rows]].tolist(), at[self.hashes[at] == h[rows]].tolist()):
            yield row, self.terms[place]


class Neighbours:
    """``Trie.candidates`` of many words at once: hashes of all their deletion neighbours, a place of deletion at a time."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, trie: Trie):
        self.width = max(TWO_EDITS, STEMS[-1] + 1, trie.longest + 2) + 1
        self.longest = trie.longest
        self.powers = np.array([pow(self.BASE, i, 1 << 64) for i in range(self.width)], np.uint64)
        self.back = [np.uint64(pow(self.BASE, -i, 1 << 64)) for i in range(3)]
        self.once = self._strings({k: [t for t, _ in v] for k, v in trie.once.items()})
        self.stems = self._strings({k: [t for t, _ in v] for k, v in trie.stems.items()})
        self.twice = self._strings(trie.twice)

    def _sums(self, words: Iterable[str]) -> np.ndarray:
        """Column i: hash of the first i letters."""
        letters = np.array([w[:self.width] for w in words], f"U{self.width}").view("<u4").reshape(-1, self.width).astype(np.uint64)
        return np.concatenate([np.zeros((len(letters), 1), np.uint64), np.cumsum(letters * self.powers, axis=1, dtype=np.uint64)], axis=1)

    def _strings(self, known: dict[str, list[str]]) -> _Strings | None:
        return _Strings(self._sums(known)[:, -1], list(known.values())) if known else None

    def candidates(self, words: list[str]) -> dict[int, set[str]]:
        """For the words that have any: terms within the allowed edits of the word or its beginning, and few others."""
        out: dict[int, set[str]] = {}
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))  # the longest first, so that those with a letter i lead
        size = -np.array([-len(words[i]) for i in order], np.int64)
        sums, back = self._sums(words[i] for i in order), self.back

        def met(known: _Strings, first: int, h: np.ndarray) -> None:
            for row, terms in known.hits(h):
                out.setdefault(order[first + row], set()).update(terms)

        def longer(n: int) -> int:
            """Number of words with more than ``n`` letters."""
            return int(np.searchsorted(-size, -n, side="left"))

        if self.once:
            first, least = longer(TWO_EDITS), longer(SHORT - 2)
            met(self.once, first, sums[first:least, -1])
            for i in range(TWO_EDITS):
                end = max(first, longer(i)) if i > SHORT - 2 else least
                part = sums[first:end]
                met(self.once, first, part[:, i] + (part[:, -1] - part[:, i + 1]) * back[1])
        if self.stems:
            # the first n letters with letter i left out; a stem is followed by a letter
            for n in range(HEAD, STEMS[-1] + 1):
                met(self.stems, 0, sums[:longer(n), n])
                part = sums[:longer(n + 1)]
                for i in range(n):
                    met(self.stems, 0, part[:, i] + (part[:, n + 1] - part[:, i + 1]) * back[1])
        if self.twice:
            first, least = longer(self.longest + 2), longer(TWO_EDITS - 3)
            met(self.twice, first, sums[first:least, -1])
            for i in range(self.longest + 2):
                part = sums[first:max(first, min(least, longer(i)))]
                met(self.twice, first, part[:, i] + (part[:, -1] - part[:, i + 1]) * back[1])
                for j in range(i + 1, self.longest + 2):
                    part = sums[first:max(first, min(least, longer(j)))]
                    met(self.twice, first, part[:, i] + (part[:, j] - part[:, i + 1]) * back[1] + (part[:, -1] - part[:, j + 1]) * back[2])
        return out


class Scorer:
    """Features of texts; remembers the words it has seen."""

    def __init__(self, terms: dict[str, float]):
        self.trie, self.kinds = Trie(terms), {(0.0, 0.0, 0.0, 0.0): 0}
        self.neighbours = Neighbours(self.trie.loose)
        self.weights, self.table = [(0.0, 0.0, 0.0, 0.0)], np.zeros((1, 4))
        self.seen: dict[str, int] = {}

    def learn(self, new: set[str]) -> None:
        """Looks up words that are not remembered, all at once."""
        words = list(new)
        folded = [_folded(w) for w in words]
        candidates = self.neighbours.candidates(folded)
        none = (0.0, 0.0, 0.0)
        for i, (word, bare) in enumerate(zip(words, folded)):
            exact = self.trie.exact(bare)
            found = (exact, *(self.trie.loose.near(bare, candidates[i]) if i in candidates and not exact else none))
            number = self.kinds.setdefault(found, len(self.kinds))
            if number == len(self.weights):
                self.weights.append(found)
            self.seen[word] = number
        if len(self.table) < len(self.weights):
            self.table = np.array(self.weights)

    def all_features(self, texts: Iterable[str | None]) -> np.ndarray:
        """One row of features per text."""
        out, held, size = [], [], 0
        for text in texts:
            text = (text or "").lower()
            held.append((text, _WORD.findall(text)))
            size += len(text)
            if size > TOGETHER:
                out += self._features(held)
                held, size = [], 0
        out += self._features(held)
        return np.array(out, float).reshape(-1, FEATURES)

    def features(self, text: str | None) -> list[float]:
        return self.all_features([text])[0].tolist()

    def _features(self, held: list[tuple[str, list[str]]]) -> list[list[float]]:
        every = set().union(*(words for _, words in held))
        new = every - self.seen.keys()
        if len(self.seen) + len(new) > MEMORY:
            self.seen.clear()
            new = every
        self.learn(new)
        return [self._one(text, words) for text, words in held]

    def _one(self, text: str, words: list[str]) -> list[float]:
        if not words:
            return [0.0] * FEATURES
        number = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        if not number.any():
            return [0.0] * 8 + [math.log(len(words))] + [0.0] * (FEATURES - 9)
        exact, *near = self.table[number].T
        quoted = self._quoted(text) if _QUOTES.search(text) else np.zeros(len(words), bool)
        said, cited = np.where(quoted, 0.0, exact), np.where(quoted, exact, 0.0)
        close, short, stems = (np.where(quoted, 0.0, x) for x in near)
        return [
            math.log1p((said > 0).sum()), float(said.max()), math.log1p(said.sum()), _window_sum(said), float(said.sum()) / len(words),
            math.log1p((said > 3).sum()), math.log1p(cited.sum()), _window_sum(close), math.log(len(words)),
            math.log1p(short.sum()), math.log1p(stems.sum()), math.log1p(sum(x[quoted].sum() for x in near)),
        ]

    @staticmethod
    def _quoted(text: str) -> np.ndarray:
        """Whether each word lies between a pair of quotation marks of its line."""
        spans = []
        for line in re.finditer(r"[^\n]+", text):
            marks = [m.start() + line.start() for m in _QUOTES.finditer(line.group())]
            spans += zip(marks[::2], marks[1::2])
        starts = np.array([m.start() for m in _WORD.finditer(text)])
        if not spans:
            return np.zeros(len(starts), bool)
        opened, closed = np.array(spans).T
        at = np.searchsorted(opened, starts) - 1
        return (at >= 0) & (starts < closed[np.maximum(at, 0)])


_scorers: dict[str, Scorer] = {}


def scorer(terms: dict[str, float]) -> Scorer:
    """One per worker and lexicon; its memory serves all tasks of that worker."""
    key = hashlib.sha256(repr(sorted(terms.items())).encode()).hexdigest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(terms)
    return _scorers[key]


def _window_sum(x: np.ndarray) -> float:
    total = np.concatenate([[0.0], np.cumsum(x)])
    size = min(WINDOW, len(x))
    return float((total[size:] - total[:-size]).max())


@dataclass
class Model:
    """terms: the lexicon with its weights; the regression's means, scales and weights (the last for 1)."""

    terms: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0] * FEATURES + [-30.0]))

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)
        return 1 / (1 + np.exp(-z))


def _terms(text: str | None) -> set[str]:
    words = {_folded(w) for w in _WORD.findall((text or "").lower())}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), ridge * np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from labelled rows that are not held out; at most ``rows``, those with the least hash of doc_id.

    Repeated labels of a doc_id count as toxic if one does; rows without label or doc_id are left
    out.  Without rows of both labels the model scores every text 0.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = saved(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id").select("text", "toxic").repartition(shuffle_width(docs.sparkSession)), "sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy(F.expr("int(toxic > 0)").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic > 0].update(_terms(text))
        terms = list(counts[1])
        if terms:
            yield pa.RecordBatch.from_pydict({"term": terms, "bad": [counts[1][t] for t in terms], "good": [0] * len(terms)})
        terms = list(counts[0])
        if terms:
            yield pa.RecordBatch.from_pydict({"term": terms, "bad": [0] * len(terms), "good": [counts[0][t] for t in terms]})

    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1))
    lexicon = (
        sample.mapInArrow(counted, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= LEAST_COUNT).withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS).orderBy(F.desc("odds"), "term").limit(TERMS)
    )
    terms = {r["term"]: r["odds"] for r in lexicon.collect()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(terms)
        for batch in batches:
            x = own.all_features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("toxic")], ["x", "y"])

    kind = labels.schema["toxic"].dataType.simpleString()
    points = sample.mapInArrow(measured, f"x array<double>, y {kind}").toPandas().sort_values("y", kind="stable")  # ``rows`` short rows at most
    mean, scale, weights = _regression(np.stack(points["x"].to_numpy()), (points["y"].to_numpy() > 0).astype(float))
    return Model(terms, mean, scale, weights)


def score(model: Model, text: Column) -> Column:
    """Column from 0 to 1, by whole texts."""
    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scorer(model.terms)
        for part in parts:
            yield pd.Series(model.score(own.all_features(part)))

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Null texts are empty and are scored too."""
    model = fit(docs, labels, rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), score(model, text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = fit(docs, labels, rows)
    return docs.where(score(model, text_of()) < 0.5)
