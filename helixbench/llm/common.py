"""Helpers of the training-data operators: tables, shared scratch space, whole-word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session of one machine
    gets a temporary folder; on a cluster, whose executors would not see that, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors. ``options`` are
    those of the Parquet writer."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``df`` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, group: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of each group, those of the smallest ``h`` (a hash of what tells rows apart; rows of the
    same hash count once). A hash threshold leaves about one and a half times the bound, whatever the table's size,
    before rows are numbered; groups are counted by their distinct hashes, so that repeated rows and keys neither
    crowd out the others nor come all together."""
    sizes = {r[0]: r[1] for r in df.groupBy(group).agg(F.approx_count_distinct("h")).collect()}
    sizes.pop(None, None)
    if not sizes:
        return df.limit(0)
    whole = 1 << 62
    share = F.create_map(*(F.lit(x) for g, n in sizes.items() for x in (g, min(whole, 3 * bound * whole // (2 * max(1, n)) + 1))))
    few = df.where(F.pmod("h", F.lit(whole)) < share[F.col(group)]).dropDuplicates([group, "h"])
    at = F.row_number().over(Window.partitionBy(group).orderBy("h"))
    return few.withColumn("_at", at).where(F.col("_at") <= bound).drop("_at")


def in_one_task(df: DataFrame, work: Callable[[pa.Table], bytes]) -> bytes:
    """What ``work`` makes of a table of bounded size, within one task of an executor; only that comes to the driver."""

    def run(batches):
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_pydict({"made": pa.array([work(pa.Table.from_batches(held))], pa.binary())})

    made = df.repartition(1).mapInArrow(run, "made binary").collect()
    return bytes(made[0].made) if made else b""


def remainder(id_column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % divisor


#: Keys that are sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def sized(keys: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A table of keys, stored and counted; marked for broadcast if it is within the bound."""
    keys = stored(keys, name)
    n = keys.count()
    return (F.broadcast(keys) if n <= BROADCAST_KEYS else keys), n
