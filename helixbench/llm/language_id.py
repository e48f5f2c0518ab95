"""Language identification in two steps: the family first, then one-versus-one linear machines within it.

A text becomes hashed counts of its n-grams of 1 to 4 letters, where a run of anything but letters counts as one
more sign (the edge of a word), as square roots scaled to unit length. A linear machine for each family, one against
the rest, picks the family; within it each pair of languages has a linear support vector machine of its own, and the language that wins most pairs, then the
largest sum of margins, then the first name, is the prediction.

The machines only choose among learned languages. Whether a text resembles these at all is told by its likeness: the
length of its vector within the span of the languages' mean vectors, so that a text in several learned languages is as
near as one in one of them. Likeness grows with a text's n-grams, hence the floors by their number, set below what
the learned texts reach: other scripts and strings of letters fall below, a close relative of a learned language may not.
"""

from __future__ import annotations

import pickle
import sys
from collections import Counter
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixbench.llm.common import fresh, in_one_task, sampled

UNKNOWN = "und"
BITS = 12
WIDTH = 1 << BITS
#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


class Model(NamedTuple):
    languages: list[str]
    families: list[str]
    family_weights: np.ndarray  # family x (WIDTH + 1)
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]  # by family: languages a, b and the weights of a against b
    span: np.ndarray  # orthonormal rows that span the languages' mean vectors
    floors: np.ndarray  # least likeness of a text by the bit length of its number of n-grams; 0 where too few were seen


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of a whole text's n-grams and their weights; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    edge = np.uint32(1)
    letter = np.concatenate([[False], letter, [False]])
    signs = np.where(letter, np.concatenate([[edge], codes, [edge]]), edge).astype(np.uint32)
    signs = signs[np.concatenate([[True], letter[1:] | letter[:-1]])]
    counts = np.zeros(WIDTH, np.float32)
    mixed = np.zeros(len(signs), np.uint32)
    for n in range(1, 5):
        mixed = mixed[: len(signs) - n + 1] * np.uint32(0x9E3779B1) + signs[n - 1 :]
        spread = (mixed ^ np.uint32(n * 0x1000193)) * np.uint32(0x85EBCA6B)
        counts += np.bincount(spread >> np.uint32(32 - BITS), minlength=WIDTH)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at, value / np.sqrt((value * value).sum())


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> np.ndarray:
    """A linear support vector machine (squared hinge) by accelerated gradient steps; y is +1 or -1. Both classes
    weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    y, share = y.astype(np.float32), share.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    look, t = w.copy(), 1.0
    step = 1 / (2 * 2 + ridge)  # rows have length sqrt(2) with the constant
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look + np.float32(step) * (2 * ((share * slack * y) @ x) - np.float32(ridge) * look)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model from (language, buckets, weights)."""
    languages = sorted({s[0] for s in sample})
    x = np.zeros((len(sample), WIDTH + 1), np.float32)
    for i, (_, at, value) in enumerate(sample):
        x[i, at] = value
        x[i, WIDTH] = 1
    label = np.array([languages.index(s[0]) for s in sample])
    family_of = [_FAMILY.get(code, f"only {code}") for code in languages]
    families = sorted(set(family_of))
    family = np.array([families.index(family_of[i]) for i in label], int)
    rest = [_machine(x, np.where(family == f, 1.0, -1.0)) for f in range(len(families))] if len(families) > 1 else [np.zeros(WIDTH + 1)] * len(families)
    pairs = {}
    for name in families:
        members = [i for i, f in enumerate(family_of) if f == name]
        pairs[name] = []
        for a, b in combinations(members, 2):
            rows = np.flatnonzero((label == a) | (label == b))
            pairs[name].append((a, b, _machine(x[rows], np.where(label[rows] == a, 1.0, -1.0))))
    means = np.array([x[label == i, :WIDTH].mean(axis=0) for i in range(len(languages))])
    span = np.linalg.qr(means.T)[0].T.astype(np.float32)
    return Model(languages, families, np.array(rest).reshape(len(families), WIDTH + 1).astype(np.float32), pairs, span, _floors(span, sample))


#: Learned texts of about the same number of n-grams that a floor needs, and its share of their lowest hundredth: low
#: enough that a text stays of which half is names, code or another language.
SEEN, SLACK = 20, 0.5


def _floors(span: np.ndarray, sample: list[tuple[str, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Floors of likeness by bit length, rising. Texts shorter than those learned from have none, as they tell too
    little; longer ones have that of the longest."""
    like = np.array([np.linalg.norm(span[:, at] @ value) for _, at, value in sample])
    bits = np.array([len(at).bit_length() for _, at, _ in sample])
    floors = np.zeros(BITS + 2)
    for b in range(1, len(floors)):
        same = like[bits == b]
        floors[b] = SLACK * np.quantile(same, 0.01) if len(same) >= SEEN else floors[b - 1]
    return np.minimum.accumulate(floors[::-1])[::-1]


def familiar(model: Model, at: np.ndarray, value: np.ndarray) -> bool:
    """Whether a text resembles the learned languages, one or several of them."""
    return bool(np.linalg.norm(model.span[:, at] @ value) >= model.floors[len(at).bit_length()])


def predict(model: Model, at: np.ndarray, value: np.ndarray) -> tuple[str, float]:
    """The language and the share of the probability (logistic margins of family and pairs) that it gets."""
    scores = model.family_weights[:, at] @ value + model.family_weights[:, WIDTH]
    f = int(np.argmax(scores))
    chance = _soft(scores)[f] if len(scores) > 1 else 1.0
    pairs = model.pairs[model.families[f]]
    if not pairs:
        members = [i for i, code in enumerate(model.languages) if _FAMILY.get(code, f"only {code}") == model.families[f]]
        return model.languages[members[0]], float(chance)
    wins, margins = Counter(), Counter()
    for a, b, w in pairs:
        m = float(w[at] @ value + w[WIDTH])
        wins[a if m >= 0 else b] += 1
        margins[a] += m
        margins[b] -= m
    best = min(margins, key=lambda i: (-wins[i], -margins[i], i))
    within = _soft(np.array([margins[i] for i in margins]) * 2)
    return model.languages[best], float(chance * within[list(margins).index(best)])


def _soft(scores: np.ndarray) -> np.ndarray:
    e = np.exp(4 * (scores - scores.max()))
    return e / e.sum()


def _packed(texts: pd.Series) -> pd.DataFrame:
    none = np.zeros(0), np.zeros(0)
    found = [features(t) or none for t in texts]
    return pd.DataFrame([(at.astype(np.int16).tobytes(), value.astype(np.float32).tobytes()) for at, value in found], columns=["at", "value"])


def _fitted(rows: pa.Table) -> bytes:
    """A pickled model from rows (lang, h, at, value)."""
    rows = rows.sort_by([("lang", "ascending"), ("h", "ascending")]).to_pylist()
    return pickle.dumps(tuple(fit([(r["lang"], np.frombuffer(r["at"], np.int16), np.frombuffer(r["value"], np.float32)) for r in rows])))


def train(df: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400) -> Model | None:
    """A model of the languages that ``usable`` rows of ``df`` name, from at most ``per_language`` texts of each, those
    of the smallest hash of key and text (``common.sampled``); None if there are none. Rows without a language or a
    letter are not learned from, repeated rows count once, null keys are like any other. The sample's features go to
    one task, which fits the model; only the model comes to the driver."""
    good = df.where(usable & F.col(lang).isNotNull() & F.col(text).rlike(r"[\p{L}]"))
    good = good.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.lit(6), F.col(key), F.col(text)).alias("h"))
    packed = F.pandas_udf(_packed, "at binary, value binary")
    rows = sampled(good, "lang", per_language).select("lang", "h", packed("t").alias("f")).select("lang", "h", "f.at", "f.value")
    made = in_one_task(rows, _fitted)
    return Model(*pickle.loads(made)) if made else None


def identify(df: DataFrame, model: Model | None, text: str = "text", into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the predicted language and its score (0 to 1) as columns ``into``, one row for each row; columns
    of these names are replaced. A third name gets whether the text resembles the learned languages (``familiar``;
    false where the language is unknown). A null text or one without a letter is ``und`` with score 0; so is every text
    where no model could be trained. Whole texts are read, and nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, familiar boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            counts = features(t) if shared.value else None
            out.append((*predict(shared.value, *counts), familiar(shared.value, *counts)) if counts else (UNKNOWN, 0.0, False))
        return pd.DataFrame(out, columns=["lang", "score", "familiar"])

    rest = [f"`{c}`" for c in df.columns if c not in into]
    (own,) = fresh(df, "_judged")
    judged = df.select(*rest, judge(F.col(text).cast("string")).alias(own))
    return judged.select(*rest, *(F.col(f"{own}.{c}").alias(name) for c, name in zip(("lang", "score", "familiar"), into, strict=False)))
