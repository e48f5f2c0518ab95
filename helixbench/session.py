"""What a session needs so that its Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def reachable(spark: SparkSession) -> SparkSession:
    """Adds the folder of this package to the workers' path, wherever the driver was started. On a cluster without
    that folder on each machine the package is shipped as usual, with ``--py-files``. Batches that go to the workers
    are bounded by their bytes, as ten thousand rows of long texts or arrays are no bound; a smaller one stays."""
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, here]))
    if (found := spark.conf.get(BATCH, None)) is None or not found.isdigit() or int(found) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark
