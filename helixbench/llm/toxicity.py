"""Toxicity by a learned lexicon, met with up to two misspellings, and the context around each hit.

The lexicon is a trie. Levenshtein automata of its terms (one edit from four letters on, two from nine on) run on it
together: a state is the set of (trie node, edits so far), made when a word first needs it and then kept, so a word
costs one step a letter and most words die after a few. A hit counts as quoted where a pair of marks encloses it or a
word of reporting stands near it, else as abuse. A logistic model weighs the two.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbench.llm.common import forget, fresh, sampled, stored

_TOKEN = re.compile(r"\w+|[\"“”„«»\n]")
_WORD = re.compile(r"\w+")
#: Quotation marks and those that close them.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«"}
#: Words that report what someone else said.
REPORTING = frozenset("said says called calls wrote quoted quote cited reported sagte nannte schrieb zitiert dit appelle cite dijo llama cita".split())
REACH = 6
#: Words whose match is remembered by a worker, and states of its automaton; beyond it the memory starts anew.
REMEMBERED, STATES = 400_000, 100_000


class Lexicon:
    """Terms with weights, matched exactly or, but for those in ``exact``, within their number of edits."""

    def __init__(self, terms: dict[str, float], exact: frozenset[str] = frozenset()):
        self.terms, self.exact = terms, exact
        self._prepare()

    def __reduce__(self):
        return Lexicon, (self.terms, self.exact)

    def edits(self, term: str) -> int:
        return 0 if term in self.exact or len(term) < 4 else 1 if len(term) < 9 else 2

    def _prepare(self) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.room = [0]  # most edits that a term below the node allows
        for term in self.terms:
            node, most = 0, self.edits(term)
            self.room[0] = max(self.room[0], most)
            for letter in term:
                if letter not in self.edges[node]:
                    self.edges[node][letter] = len(self.edges)
                    self.edges.append({})
                    self.ends.append(None)
                    self.room.append(0)
                node = self.edges[node][letter]
                self.room[node] = max(self.room[node], most)
            self.ends[node] = term
        self.known: dict[str, tuple[str, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of these nodes and what deletions reach from them; -1 if there are none."""
        work = list(nodes)
        while work:
            node = work.pop()
            for child in self.edges[node].values():
                cost = nodes[node] + 1
                if cost <= self.room[child] and cost < nodes.get(child, 9):
                    nodes[child] = cost
                    work.append(child)
        if not nodes:
            return -1
        name = frozenset(nodes.items())
        if name not in self.states:
            self.states[name] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            ends = [(c, self.ends[n]) for n, c in nodes.items() if self.ends[n] and c <= self.edits(self.ends[n])]
            self.found.append(min(ends)[::-1] if ends else None)
        return self.states[name]

    def _move(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, cost: int) -> None:
            if cost <= self.room[node] and cost < nodes.get(node, 9):
                nodes[node] = cost

        for node, cost in self.sets[state].items():
            reach(node, cost + 1)  # a letter too many
            for other, child in self.edges[node].items():
                reach(child, cost + (other != letter))
        new = self.moves[state][letter] = self._state(nodes)
        return new

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term, the first of equals, and its distance; None beyond the edits allowed."""
        if word in self.terms:
            return word, 0
        state, moves = self.start, self.moves
        for letter in word:
            new = moves[state].get(letter)
            state = self._move(state, letter) if new is None else new
            if state < 0:
                return None
        return self.found[state]

    def remembered(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """The words that match, with their matches."""
        known = self.known
        new = words.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = words
        for word in new:
            if len(self.sets) > STATES:
                self._forget()
            known[word] = self.match(word)
        return {w: m for w in words if (m := known[w])}


FEATURES = 7


def quoted(tokens: list[str]) -> list[bool]:
    """For each token, whether a pair of quotation marks of one line encloses it. A mark that opens pairs with the next
    one that closes it; marks without a partner enclose nothing."""
    out, opened = [False] * len(tokens), None
    for i, token in enumerate(tokens):
        if token == "\n":
            opened = None
        elif opened is not None and token in CLOSING[tokens[opened]]:
            out[opened : i + 1] = [True] * (i + 1 - opened)
            opened = None
        elif opened is None and token in CLOSING:
            opened = i
    return out


def features(lexicon: Lexicon, text: str | None) -> np.ndarray:
    """Weights of exact and of misspelled abuse, of quoted hits, number of distinct abusive terms, the heaviest
    abusive hit, hits a word, and a constant."""
    tokens = _TOKEN.findall((text or "").lower())
    out = np.zeros(FEATURES)
    out[6] = 1
    if not (hits := lexicon.remembered(set(tokens))):
        return out
    within, terms, n = quoted(tokens), set(), 0
    for i, token in enumerate(tokens):
        n += token not in CLOSING and token != "\n"
        if token in hits:
            term, distance = hits[token]
            weight = lexicon.terms[term]
            before, after = tokens[max(0, i - REACH) : i], tokens[i + 1 : i + 4]
            if within[i] or not REPORTING.isdisjoint(before) or not REPORTING.isdisjoint(after):
                out[2] += weight
            else:
                out[0 if distance == 0 else 1] += weight
                out[4] = max(out[4], weight / (1 + distance))
                terms.add(term)
    out[5] = 10 * (out[0] + out[1]) / max(1, n)
    out[3] = len(terms)
    out[:4] = np.log1p(out[:4])
    return out


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = float(np.clip(self.weights @ features(self.lexicon, text), -30, 30))
        return 1 / (1 + math.exp(-z))


def _prints(text: str | None) -> list[int]:
    """Three min-hashes of the five-word shingles of a text; near copies have one in common."""
    words = (text or "").split()
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return [min(xxhash.xxh3_64_intdigest(s, seed) for s in shingles) >> 1 for seed in (1, 2, 3)]


def _sample(df: DataFrame, labels: DataFrame, usable: Column, key: str, text: str, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(y, at, t): the sampled texts without near copies, numbered within their class, as a stored table; and the
    number of usable keys of each label."""
    tagged = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    own = df.where(usable).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64(F.lit(4), "k", "t"))
    ids = own.select("k", "h").join(tagged, "k").select("y", "h")  # hashes are shuffled, texts are not
    sizes = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = F.broadcast(sampled(ids, "y", per_class))  # two classes of at most per_class rows
    prints = F.udf(_prints, "array<long>")
    few = stored(own.select("h", "t").join(picked, "h").dropDuplicates(["y", "h"]).select("y", "h", "t", prints("t").alias("p")), "sample")
    each = few.select("y", "h", F.posexplode("p").alias("seed", "p"))
    first = F.col("h") == F.min("h").over(Window.partitionBy("y", "seed", "p"))
    alone = each.select("y", "h", first.alias("first")).groupBy("y", "h").agg(F.bool_and("first").alias("first")).where("first")
    at = F.row_number().over(Window.partitionBy("y").orderBy("h")) - 1
    return stored(few.join(alone.select("y", "h"), ["y", "h"]).select("y", at.alias("at"), "t"), "texts"), sizes


def _resembled(lexicon: Lexicon):
    def near(words: pd.Series) -> pd.Series:
        return pd.Series([None if w in lexicon.terms else (lexicon.match(w) or (None,))[0] for w in words], dtype=object)

    return F.pandas_udf(near, "string")


def induce(rows: DataFrame) -> Lexicon:
    """Words of ``rows`` (y, t) whose share of toxic documents exceeds that of clean ones beyond chance, with their log
    odds as weights. A term that some word of the clean documents resembles takes no misspellings. Words are counted
    in Spark, a document once each; the driver sees the terms."""
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    own = F.udf(lambda t: list(set(_WORD.findall((t or "").lower()))), "array<string>")
    count = rows.select("y", F.explode(own("t")).alias("w")).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c"))
    count = stored(count, "words")
    odds = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5)) + math.log((size.get(0, 0) + 1) / (size.get(1, 0) + 1))
    certain = F.col("odds") / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    found = count.withColumn("odds", odds).where((F.col("t") >= 3) & (F.col("odds") > 2) & (certain > 2) & F.col("w").rlike(r"\p{L}"))
    terms = {r.w: round(r.odds, 4) for r in found.orderBy("w").collect()}
    clean = count.where("c > 0").select("w")
    lexicon = Lexicon(terms)
    while met := {r.m for r in clean.select(_resembled(lexicon)("w").alias("m")).where("m is not null").distinct().collect()} - lexicon.exact:
        lexicon = Lexicon(terms, lexicon.exact | met)
    forget(count)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, prior: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton steps on the weighted log loss, drawn to ``prior``."""
    w = prior.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + ridge * (w - prior)
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1, 2 / (np.abs(step).max() + 1e-9))
    return w


def train(df: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1500) -> Model | None:
    """A model from at most ``per_class`` usable rows of each label, those of the smallest hash of key and text
    (``common.sampled``), whole texts; None without a toxic row. Near copies of a sampled text are left out, as their
    every word would look like a term. Every other row goes to the lexicon, the rest fit the weights, so that these
    know how often clean words look like misspelled terms. Labels other than 0 and 1, and those of null keys, count
    for nothing; of several labels of a key the larger counts; repeated rows count once. The driver gets the terms
    and seven numbers a text."""
    rows, sizes = _sample(df, labels, usable, key, text, label, per_class)
    if not sizes.get(1):
        return None
    lexicon = induce(rows.where("at % 2 = 0"))

    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([features(lexicon, t).tolist() for t in texts])

    alone = {y: n == 1 for y, n in rows.groupBy("y").count().collect()}
    rest = rows.where((F.col("at") % 2 == 1) | F.col("y").isin([y for y, one in alone.items() if one]))
    got = rest.select("y", "at", F.pandas_udf(made, "array<double>")("t").alias("x")).orderBy("y", "at").collect()
    forget(rows)
    x, y = np.array([r.x for r in got]), np.array([float(r.y) for r in got])
    total = sum(sizes.values())
    share = np.array([sizes[r.y] / total / (y == r.y).sum() for r in got]) * len(y)
    prior = np.array([1.0, 0.7, -0.2, 0.5, 0.3, 0.3, math.log(max(1, sizes[1]) / max(1, sizes.get(0, 1))) - 1])
    return Model(lexicon, _logistic(x, y, share, prior))


def score(df: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.3, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``df`` with the toxicity score (0 to 1) of each whole text and whether it reaches ``threshold``, as columns
    ``into`` (replaced if there). Null and wordless texts score like a text without a hit; without a model every
    score is 0. Nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score(t) if model else 0.0 for t in texts], dtype=float)

    rest = [f"`{c}`" for c in df.columns if c not in into]
    (own,) = fresh(df, "_score")
    scored = df.select(*rest, judge(F.col(text).cast("string")).alias(own))
    return scored.select(*rest, F.col(own).alias(into[0]), (F.col(own) >= threshold).cast("int").alias(into[1]))
