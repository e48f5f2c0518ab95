"""Position labels: ranges, numbering, evaluation subsets, pairing probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixbench.operators.merge import first_rows


def attach_ranges(labels: DataFrame, ranges: DataFrame, width: int = 1024, sequence: bool = False, inner: bool = False) -> DataFrame:
    """``labels`` with the sequence_id and id_min of the range that holds their id, and with ``sequence`` its sequence;
    without a range null, or with ``inner`` left out. A range is repeated only for each stretch of ``width`` ids that
    it touches, and joined on the stretch. Ranges do not overlap."""
    low, high = F.floor(F.col("id_min") / width), F.floor(F.col("id_max") / width)
    carried = ["sequence_id", "id_min", *(["sequence"] if sequence else [])]
    cut = ranges.where("id_min <= id_max").select(*carried, "id_max", F.explode(F.sequence(low, high)).alias("stretch"))
    rows = labels.withColumn("stretch", F.floor(F.col("id") / width))
    on = (rows["stretch"] == cut["stretch"]) & (rows["id"] >= cut["id_min"]) & (rows["id"] <= cut["id_max"])
    return rows.join(cut, on, "inner" if inner else "left").select(*(rows[c] for c in labels.columns), *carried)


def number_positions(attached: DataFrame, gap_free: bool = False, all_known: bool = False) -> DataFrame:
    """``attached`` with position_id from 0 in the order of ids; null without a sequence. Where each range's ids are
    all there once (``gap_free``), it is the distance from the range's start and needs no shuffle. ``all_known``: no
    row lacks a sequence, so that rows need only be dealt by it."""
    if gap_free:
        return attached.withColumn("position_id", (F.col("id") - F.col("id_min")).cast("int"))
    # Rows without a sequence are dealt out by a hash, so that they fill no task of their own.
    spread = [] if all_known else [F.when(F.col("sequence_id").isNull(), F.pmod(F.xxhash64("id"), F.lit(1 << 20)))]
    rank = F.row_number().over(Window.partitionBy("sequence_id", *spread).orderBy("id")) - 1
    return attached.withColumn("position_id", rank if all_known else F.when(F.col("sequence_id").isNotNull(), rank))


def ranges_without_gaps(attached: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges whose ids occur once each."""
    seen = attached.where("sequence_id is not null").groupBy("sequence_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
    whole = seen.join(ranges, "sequence_id").where((F.col("n") == F.col("id_max") - F.col("id_min") + 1) & (F.col("n") == F.col("d")))
    return whole.select(*ranges.columns)


def without_gaps(attached: DataFrame, ranges: DataFrame) -> bool:
    """Whether each range's ids occur once each."""
    return ranges.select("sequence_id").join(ranges_without_gaps(attached, ranges), "sequence_id", "left_anti").isEmpty()


def of_usage(df: DataFrame, usage: str) -> DataFrame:
    return df.where(F.col("usage") == usage)


def not_ignored(df: DataFrame) -> DataFrame:
    """All but ``Ignored``; rows without a usage stay."""
    return df.where(~F.col("usage").eqNullSafe("Ignored"))


def evaluation_subset(labels: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """All labels whose ``key`` occurs in ``chosen``."""
    return labels.join(chosen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def chosen_ranges(labels: DataFrame, ranges: DataFrame, usage: str) -> DataFrame:
    """The ranges whose *sequence* some label of this usage has, under this or another id. The labels' filter reaches
    the scan; only distinct sequences are shuffled."""
    has = attach_ranges(of_usage(labels, usage).select("id"), ranges, sequence=True, inner=True)
    return evaluation_subset(ranges, has, "sequence")


def evaluation_set(labels: DataFrame, ranges: DataFrame, usage: str = "Private", gap_free: bool = False) -> DataFrame:
    """All labels of the sequences of which a label has this usage, with sequence_id, sequence and position_id.

    Sequences are chosen first, among the ranges, which are few; the labels then meet only the chosen ranges, and what
    is left is dealt by sequence_id once, to be numbered. Labels without a range are in no set."""
    few = chosen_ranges(labels, ranges, usage)
    return number_positions(attach_ranges(labels, few, sequence=True, inner=True), gap_free, all_known=True)


def predictions_of(predictions: DataFrame, evaluation: DataFrame) -> DataFrame:
    """The predictions (keyed by id) of an evaluation set's labels."""
    return evaluation_subset(predictions, evaluation, "id")


def first_of_each(labels: DataFrame, ranges: DataFrame, usage: str = "Private") -> DataFrame:
    """For each distinct sequence among the labels of a usage, the label of the smallest id with it; labels without a
    range are one sequence, the unknown one. An aggregate that combines before the shuffle, so that a sequence (or
    the unknown one) with very many labels fills no task."""
    rows = attach_ranges(of_usage(labels, usage), ranges, sequence=True)
    return first_rows(rows, ["sequence"], ["id", "sequence_id"])


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n_shared): keys that both sides have; 0 if they are disjoint."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("n_shared"))


def align(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels with their predictions; those without one go."""
    known = predictions.where("prediction is not null")
    return labels.join(known, ["sequence_id", "position_id"])


def unpaired_probability(pairs: DataFrame) -> DataFrame:
    """(seq_id, i, p_unpaired): product of 1 - p over the partners that are listed."""
    return pairs.groupBy("seq_id", "i").agg(F.product(1 - F.col("p")).alias("p_unpaired"))
