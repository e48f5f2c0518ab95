"""Readers and writers of sheets, assay folders, prediction folders and connect tables."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from helixbench.functions.expressions import nan_to_null
from helixbench.operators.pairs import distinct_pairs
from helixbench.schema import ASSAY_SHEET, LABELS, POSITION_PREDICTIONS, PREDICTIONS, RANGES, SCORE_COLUMNS, SHEET_ALIASES, STRUCTURES_BY_SEQUENCE
from helixbench.session import reachable
from helixbench.sources.datasources import AssayFiles, SplitFiles, any_listed


def read_sheet(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The assay sheet in canonical columns; older layouts are read by their aliases, absent columns are null."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
    found = {}
    for c in raw.columns:
        name = SHEET_ALIASES.get(c.strip().lower(), c.strip().lower())
        found.setdefault(name, c)
    pick = lambda f: F.col(f"`{found[f.name]}`").cast(f.dataType) if f.name in found else F.lit(None).cast(f.dataType)
    return raw.select(*(pick(f).alias(f.name) for f in ASSAY_SHEET.fields))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def read_csvs(spark: SparkSession, folder: str, wanted: dict[str, str]) -> DataFrame:
    """A folder of CSV files of differing headers as one table: ``wanted`` maps canonical columns (``mutant`` is found
    under any of its names) to types; columns that a file lacks are null, as are cells that are not of the type
    (``rejected_cells`` lists these). With the ``dms_id`` that names the file, and its ``path``. Files are planned in
    packs, and each header is read by the task that reads the file; an empty or absent folder is an error."""
    raw = raw_csvs(spark, folder, wanted)
    return nan_to_null(raw.select("dms_id", "path", *(F.col(f"`{n}`").try_cast(t).alias(n) for n, t in wanted.items())))


def raw_csvs(spark: SparkSession, folder: str, wanted: dict[str, str]) -> DataFrame:
    """The cells of ``read_csvs`` as they are in the files."""
    if not any_listed(folder):
        raise FileNotFoundError(folder)
    reachable(spark).dataSource.register(AssayFiles)
    return spark.read.format("assay_files").option("columns", json.dumps(list(wanted))).load(folder)


def rejected_cells(raw: DataFrame, wanted: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """(keys, column, value): cells of ``raw`` that hold something, but nothing of the column's type."""
    return raw.select(*keys, F.inline(_failed_casts(raw, wanted)))


def _failed_casts(raw: DataFrame, wanted: dict[str, str]) -> Column:
    """The cells of a row that hold something, but nothing of their type, as structs (column, value)."""
    failed = lambda n, t: F.when(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast(t).isNull(), F.col(f"`{n}`").cast("string"))
    cells = F.array(*(F.struct(F.lit(n).alias("column"), failed(n, t).alias("value")) for n, t in wanted.items()))
    return F.filter(cells, lambda c: c["value"].isNotNull())


def read_assays(spark: SparkSession, folder: str) -> DataFrame:
    """(dms_id, mutant, dms_score, sequence) of a folder of one CSV (or one folder of them) for each assay, named by it."""
    return read_csvs(spark, folder, {"mutant": "string", "dms_score": "double", "sequence": "string"}).drop("path")


def by_manifest(assays: DataFrame, sheet: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of the sheet's assays, and the sheet's assays without rows; with ``strict`` such an assay is an error."""
    missing = sheet.select("dms_id").distinct().join(assays.select("dms_id").distinct(), "dms_id", "left_anti")
    if strict and (absent := [r.dms_id for r in missing.limit(10).collect()]):
        raise FileNotFoundError(f"no file for {', '.join(absent)}")
    return assays.join(F.broadcast(sheet.select("dms_id").distinct()), "dms_id", "left_semi"), missing


def read_predictions(spark: SparkSession, folder: str, models: Sequence[str]) -> DataFrame:
    """(model, dms_id, mutant, score) of ``<folder>/<model>/<assay>.csv``, each model's own score column. A model without
    files is warned of and left out; ``merge.loss_report`` then has it as one without a file for any assay."""
    out = None
    for model in models:
        column = SCORE_COLUMNS[model]
        try:
            rows = read_csvs(spark, f"{folder}/{model}", {"mutant": "string", column: "double"})
        except FileNotFoundError:
            warnings.warn(f"no predictions of {model} in {folder}", stacklevel=2)
            continue
        rows = rows.select(F.lit(model).alias("model"), "dms_id", "mutant", F.col(column).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], PREDICTIONS) if out is None else out


#: The column of a CSV reader that has the lines it could not split as the header asks.
_CORRUPT = "_corrupt_record"


def _raw_table(spark: SparkSession, path: str, names: dict[str, str], schema: StructType) -> DataFrame:
    """The columns that ``schema`` asks for as they are in the files, Parquet or CSV, under canonical names: ``names``
    are the files' own names of some. A CSV also has its malformed lines, whole, in a column of their own."""
    own = lambda f: F.col(f"`{names.get(f.name, f.name)}`").alias(f.name)
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path).select(*(own(f) for f in schema.fields), F.lit(None).cast("string").alias(_CORRUPT))
    header = spark.read.option("header", True).csv(path).columns
    lines = StructType([*(StructField(c, StringType()) for c in header), StructField(_CORRUPT, StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    reader = reader.option("columnPruning", False)  # else a short line passes where its last cells are not asked for
    return reader.schema(lines).csv(path).select(*(own(f) for f in schema.fields), _CORRUPT)


def _table(spark: SparkSession, path: str, names: dict[str, str], schema: StructType) -> DataFrame:
    """A table in canonical columns and types. Nothing is inferred from CSV values; only the columns asked for are
    read. Cells that are not of their type are null, malformed lines are left out: ``rejects`` has both."""
    raw = _raw_table(spark, path, names, schema).where(F.col(_CORRUPT).isNull())
    return nan_to_null(raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields)))


def rejects(spark: SparkSession, path: str, names: dict[str, str], schema: StructType) -> DataFrame:
    """(column, value): what ``_table`` could not take from a table's files: malformed lines with a null column, and of
    all other lines the cells that are not of their column's type."""
    raw = _raw_table(spark, path, names, schema)
    wanted = {f.name: f.dataType.simpleString() for f in schema.fields}
    line = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.col(_CORRUPT).alias("value")))
    return raw.select(F.inline(F.when(F.col(_CORRUPT).isNull(), _failed_casts(raw, wanted)).otherwise(line)))


def label_rejects(spark: SparkSession, path: str, reactivity: str = "reactivity_DMS_MaP") -> DataFrame:
    return rejects(spark, path, {"usage": "Usage", "reactivity": reactivity}, LABELS)


def range_rejects(spark: SparkSession, path: str) -> DataFrame:
    return rejects(spark, path, {}, RANGES)


def read_labels(spark: SparkSession, path: str, reactivity: str = "reactivity_DMS_MaP") -> DataFrame:
    """(id, usage, reactivity) of a table of position labels."""
    return _table(spark, path, {"usage": "Usage", "reactivity": reactivity}, LABELS)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, sequence, id_min, id_max) of a table of sequences and their ranges of ids."""
    return _table(spark, path, {}, RANGES)


def read_position_predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(sequence, sequence_id, position_id, prediction) of a model's table, whose column is ``prediction_<model>``."""
    return _table(spark, path, {"prediction": f"prediction_{model}"}, POSITION_PREDICTIONS)


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, method, dotbracket): predicted structures keyed by their sequence."""
    return _table(spark, path, {}, STRUCTURES_BY_SEQUENCE)


def write_result(df: DataFrame, path: str) -> None:
    """A leaderboard or an evaluation set as CSV with a header, in place of what was there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_likelihoods(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.option("header", True).schema("seqs string, scores double").csv(path, sep="\t"))


def read_ct(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """Connect tables, one a file, as (path, sequence) and (path, i, j): see ``parse_ct``."""
    return parse_ct(spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_ct(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (path, value) of connect tables as (path, sequence) and (path, i, j): columns are index, base, previous,
    next, partner (0 for none); the header line starts with the length. Pairs are 0-based, each once."""
    cell = lambda i: F.get("c", F.lit(i))
    rows = lines.select("path", F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 6)
    rows = rows.select("path", cell(0).try_cast("int").alias("idx"), cell(1).alias("base"), cell(4).try_cast("int").alias("partner"))
    rows = rows.where("idx is not null and partner is not null")
    ordered = F.sort_array(F.collect_list(F.struct("idx", "base")))
    sequences = rows.groupBy("path").agg(F.array_join(F.transform(ordered, lambda s: s["base"]), "").alias("sequence"))
    both = rows.where("partner <> 0").select("path", (F.col("idx") - 1).alias("i"), (F.col("partner") - 1).alias("j"))
    return sequences, distinct_pairs(both, ["path"])


def write_assays(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """One directory of CSV for each assay; ``read_assays`` and ``read_predictions`` read them back. Files appear when
    all are written. A null is an empty cell."""
    reachable(df.sparkSession).dataSource.register(AssayFiles)
    text = df.select("dms_id", *(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != "dms_id"))
    text.repartition("dms_id").sortWithinPartitions("dms_id").write.format("assay_files").mode(mode).save(folder)


def write_split(df: DataFrame, folder: str, split_type: str) -> None:
    """The folds of (dms_id, fold, other columns) as ``<split_type>/<fold>/<assay>_<fold>.csv``, with all other columns.
    Files appear when all are written; a task that fails leaves none, and a second run replaces those of its names."""
    reachable(df.sparkSession).dataSource.register(SplitFiles)
    rows = df.repartition("dms_id", "fold").sortWithinPartitions("dms_id", "fold")
    rows.write.format("split_files").option("kind", split_type).mode("append").save(folder)


def read_split(spark: SparkSession, folder: str, split_type: str, columns: str) -> DataFrame:
    """(dms_id, fold, columns) of the files of ``write_split``, read in packs; a cell that is not of its type is null."""
    reachable(spark).dataSource.register(SplitFiles)
    schema = StructType.fromDDL(columns)
    rows = spark.read.format("split_files").option("columns", json.dumps(schema.names)).load(f"{folder}/{split_type}")
    name = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.csv$", "")
    own = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(F.regexp_replace(name, "_[^_]*$", "").alias("dms_id"), F.regexp_extract(name, "_([^_]*)$", 1).alias("fold"), *own)


def append_result(df: DataFrame, folder: str, run: str) -> None:
    """The rows of one run into a table of results. A run that is written again takes the place of what it has
    written, so that rows are never there twice; it counts from when it is in the list of runs, which is written last,
    so that one that was killed leaves nothing that is read. The schema is the files' own."""
    spark = df.sparkSession
    rows = df.withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)
    if run not in finished_runs(spark, folder):
        spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{folder}/_runs")


def finished_runs(spark: SparkSession, folder: str) -> set[str]:
    """The runs whose rows are all there: one short name each."""
    try:
        return {r.run for r in spark.read.schema("run string").parquet(f"{folder}/_runs").distinct().collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return set()


def read_results(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all finished runs, with ``run``; None before the first."""
    runs = finished_runs(spark, folder)
    return spark.read.parquet(folder).withColumn("run", F.col("run").cast("string")).where(F.col("run").isin(sorted(runs))) if runs else None
