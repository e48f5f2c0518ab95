"""Mutated sequences: variants with their wild type, folded from left to right."""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixbench.functions.expressions import to_dna, to_rna


class Mode(NamedTuple):
    rna: bool  # alphabet
    insert: bool  # an old letter N inserts the new one behind the position
    free: bool  # an old letter N overwrites whatever is there
    strip: bool  # N is taken out at the end


#: ``insert``: DNA, N inserts. ``fill``: DNA, N must stand there, all N go at the end. ``substitute``: RNA, N overwrites.
MODES = {"insert": Mode(False, True, False, False), "fill": Mode(False, False, False, True), "substitute": Mode(True, False, True, False)}


def _position(text: str) -> int | None:
    """A position as Spark's try_cast reads it: blanks around it and a sign are allowed, beyond 32 bits is none."""
    if len(text) < 10 and text.isascii() and text.isdigit():
        return int(text)
    found = re.fullmatch(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*", text)
    return int(found[1]) if found and -(1 << 31) <= int(found[1]) < 1 << 31 else None


def _folded(mode: Mode):
    """A column (seq, reason) of a construct and its mutations, applied from left to right; the first that cannot be
    applied gives the reason; null without mutations. ``-`` as new letter deletes. Mutations come as text and are parsed
    here as ``parse_mutations`` does, as arrays of structs cost more than the work. Filters on the result stay behind
    it, so that it is made once and what mutations are computed from is not repeated in a filter."""
    letters = set("AUCGN" if mode.rna else "ATCGN")

    def fold(seq: str | None, mutant: str | None) -> tuple[str | None, str | None]:
        if mutant is None:
            return None, None
        if seq is None:
            return None, "construct"
        for m in mutant.split(","):
            old, pos, new = m[:1], _position(m[1:-1]), m[-1:]
            if pos is None:
                return None, "position"
            if old not in letters or new not in letters and new != "-":
                return None, "letter"
            if not 1 <= pos <= len(seq):
                return None, "outside"
            if not (old == "N" and (mode.insert or mode.free)) and seq[pos - 1] != old:
                return None, "mismatch"
            behind = mode.insert and old == "N"
            seq = seq[: pos if behind else pos - 1] + new.replace("-", "") + seq[pos:]
        return seq, None

    @F.arrow_udf("seq string, reason string")
    def apply(constructs: pa.Array, mutants: pa.Array) -> pa.Array:
        done = list(map(fold, constructs.to_pylist(), mutants.to_pylist()))
        columns = zip(*done, strict=True) if done else ((), ())
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["seq", "reason"], mask=mutants.is_null())

    return apply.asNondeterministic()


def mutated_sequences(variants: DataFrame, constructs: DataFrame, mode: str) -> DataFrame:
    """Variants with a mutation, with ``mutated_sequence`` or, where that is null, the ``reason``: position (no
    number), letter, outside (of the sequence), mismatch (the old letter is not there), construct (none known).
    Letters are compared in the mode's alphabet, positions count from 1 in the sequence as mutated so far."""
    m = MODES[mode]
    alphabet = to_rna if m.rna else to_dna
    rows = variants.join(F.broadcast(constructs.select("dms_id", F.col("construct").alias("_wt"))), "dms_id", "left")
    own = alphabet(F.replace(F.col("mutant"), F.lit(" "), F.lit("")))
    end = F.replace(F.col("_s.seq"), F.lit("N"), F.lit("")) if m.strip else F.col("_s.seq")
    folded = rows.withColumn("_s", _folded(m)(alphabet(F.col("_wt")), own)).where("_s is not null")
    return folded.select(*variants.columns, F.when(F.col("_s.reason").isNull(), end).alias("mutated_sequence"), F.col("_s.reason").alias("reason"))


def whole_assays(mutated: DataFrame) -> DataFrame:
    """Only assays without a rejected variant, as a strict run keeps them."""
    bad = mutated.where("reason is not null").select("dms_id").distinct()
    return mutated.join(bad, "dms_id", "left_anti")


def too_long(df: DataFrame, sequence: str, limit: int) -> DataFrame:
    """(dms_id, longest, too_long) for each assay."""
    return df.groupBy("dms_id").agg(F.max(F.length(sequence)).alias("longest")).withColumn("too_long", F.col("longest") > limit)


def truncated(sequence: Column, limit: int) -> Column:
    return F.substring(sequence, 1, limit)


def with_likelihoods(mutated: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """Variants with the likelihood of their sequence; repeated likelihood rows repeat the variant."""
    return mutated.join(likelihoods.select(F.col("seqs").alias("mutated_sequence"), "scores"), "mutated_sequence", "left")


def without_assays(df: DataFrame, part: str = "snoRNA") -> DataFrame:
    return df.where(~F.col("dms_id").contains(part))
