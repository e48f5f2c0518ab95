"""URL filters by a bit-parallel wildcard automaton.

All rules are packed into the bits of a few 64-bit words. A rule of ``m`` characters owns ``m + 1`` bits: bit 0
says that nothing was read yet, bit ``i`` that its first ``i`` characters were. Reading a byte shifts the words
left (with a carry from word to word), keeps the bits whose next character is that byte, and adds the bits that
stand on a wildcard which takes the byte. One step advances every rule for every url of a batch.

Rules are globs over ``host/path``: ``*`` in the host part stands for any characters but ``/``, ``*`` in the path
part for any characters; ``?`` stands for one byte. A rule fits its host and all its subdomains, and every path
that starts with its path.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    verdict: str
    glob: str


class Automaton(NamedTuple):
    start: np.ndarray
    step: np.ndarray  # by byte: bits that this byte may enter
    stay: np.ndarray  # by byte: bits that this byte may keep
    accept: list[tuple[int, int, int]]  # best rule first: word, bit, index of the rule


def compile_rules(rules: Sequence[Rule]) -> Automaton:
    """Masks of all rules. The longest glob comes first in ``accept``; among equals, the first listed."""
    cells: list[tuple[object, str]] = []  # (byte, or None for any, or "start"), kind of wildcard behind it
    ends = []
    for rule in rules:
        host, slash, path = rule.glob.partition("/")
        cells.append(("start", "host"))
        symbols = [(b".", "")] + [(x, "host") for x in _bytes(host)]
        symbols += [(x, "path") for x in _bytes(slash + path)]
        for symbol, part in symbols:
            if symbol == b"*":
                cells[-1] = (cells[-1][0], part)
            else:
                cells.append((None if symbol == b"?" else symbol[0], ""))
        cells[-1] = (cells[-1][0], "path")
        ends.append(len(cells) - 1)
    words = max(1, -(-len(cells) // 64))
    start = np.zeros(words, np.uint64)
    step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    not_slash = np.arange(256) != ord("/")
    for i, (symbol, wildcard) in enumerate(cells):
        word, bit = i // 64, np.uint64(1 << (i % 64))
        if symbol == "start":
            start[word] |= bit
        elif symbol is None:
            step[not_slash, word] |= bit
        else:
            step[symbol, word] |= bit
        if wildcard == "path":
            stay[:, word] |= bit
        elif wildcard == "host":
            stay[not_slash, word] |= bit
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].glob), i))
    return Automaton(start, step, stay, [(ends[i] // 64, ends[i] % 64, i) for i in order])


def _bytes(text: str) -> list[bytes]:
    return [bytes([x]) for x in text.encode()]


def match(automaton: Automaton, canonical: Sequence[bytes]) -> np.ndarray:
    """Index of the best rule for each canonical url (``.host/path``), -1 where none fits."""
    lengths = np.fromiter(map(len, canonical), np.int64, len(canonical))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    flat = np.frombuffer(b"".join(canonical), np.uint8)
    state = np.repeat(automaton.start[None, :], len(canonical), axis=0)
    falling, one, top = -lengths[order], np.uint64(1), np.uint64(63)
    for j in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(falling, -j))  # urls longer than j
        byte = flat[starts[:n] + j]
        now = state[:n]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        state[:n] = (moved & automaton.step[byte]) | (now & automaton.stay[byte])
    best = np.full(len(canonical), -1)
    for word, bit, rule in reversed(automaton.accept):
        best[(state[:, word] >> np.uint64(bit)) & one == one] = rule
    out = np.empty_like(best)
    out[order] = best
    return out


def url_filter(df: DataFrame, keep: Sequence[str], rules: Sequence[Rule], method: Sequence[Rule] = (), url: str = "url", default: str = ALLOW) -> DataFrame:
    """Columns ``keep`` of ``df`` with host, path, rule and verdict of each url; one row for each input row.

    ``rules`` decide first, the longest that fits; ``rule`` is its text. Where none fits, ``rule`` is null and the
    longest of the ``method``'s own globs gives the verdict, else ``default``. A url that is null or has no ``://``
    has an empty host and path and gets ``default`` (an empty host can fit no rule that names one). Host: A-Z are
    lower-cased, a port or user name stays part of it. Whole urls of any length are read; the rules are
    configuration of fixed size, and nothing is shuffled.
    """
    own, general = compile_rules(rules), compile_rules(method)

    @F.pandas_udf("own int, general int")
    def judge(urls: pd.Series) -> pd.DataFrame:
        texts = [f".{x}".encode("utf-8", "surrogatepass") for x in urls]
        return pd.DataFrame({"own": match(own, texts), "general": match(general, texts)})

    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    parts = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("j", judge(F.concat("host", "path")))

    def pick(field: str, values: list[str]):
        return F.get(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"), F.when(F.col(field) >= 0, F.col(field)))

    return judged.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
        "host",
        "path",
        pick("j.own", [r.glob for r in rules]).alias("rule"),
        F.coalesce(pick("j.own", [r.verdict for r in rules]), pick("j.general", [r.verdict for r in method]), F.lit(default)).alias("verdict"),
    )
