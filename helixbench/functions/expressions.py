"""Column expressions: missing values, alphabets, mutation strings, clipping, guarded division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing from the scan on."""
    doubles = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns))


def to_rna(c: Column) -> Column:
    return F.translate(F.upper(F.trim(c)), "T", "U")


def to_dna(c: Column) -> Column:
    return F.translate(F.upper(F.trim(c)), "U", "T")


def standard_mutation(c: Column) -> Column:
    """Mutation strings are compared in the RNA alphabet; their case stays."""
    return F.replace(c, F.lit("T"), F.lit("U"))


def pyrimidine_to_c(c: Column) -> Column:
    return F.translate(c, "TY", "UC")


def mutation_count(mutant: Column) -> Column:
    return F.size(F.split(mutant, ","))


def depth(mutant: Column) -> Column:
    return F.when(mutation_count(mutant) == 1, "single").when(mutant.isNotNull(), "multiple")


def mutation_parts(m: Column) -> list[Column]:
    """old, pos and new of one mutation, with pos from 1; a position that is no number is null."""
    return [
        F.substring(m, 1, 1).alias("old"),
        F.substring(m, F.lit(2), F.greatest(F.length(m) - 2, F.lit(0))).try_cast("int").alias("pos"),
        F.substring(m, -1, 1).alias("new"),
    ]


def parse_mutations(mutant: Column) -> Column:
    """``A12G,C3U`` as structs (old, pos, new)."""
    return F.transform(F.split(mutant, ","), lambda m: F.struct(*mutation_parts(m)))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]
