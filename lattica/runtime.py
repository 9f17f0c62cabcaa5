"""Session services shared by every operator: durable intermediates and clash-free column names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, taken from ``spark.checkpoint.dir``.

    Only a local session (tests) may lack the setting; it then gets a temporary folder of its own.
    On a cluster a missing setting is an error, because a machine-local folder dies with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, keeps columnar pruning for later reads and survives the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables inside iterative algorithms."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by the columns ``by`` in as many parts as the session shuffles into, and one a core at least.

    Adaptive execution merges parts by their bytes, which says little where rows compress well or cost
    much time; it leaves a given number of parts as it is.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def fresh_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column (case-insensitively) has that name."""
    lowered = {name.lower() for name in taken}
    while base.lower() in lowered:
        base += "_"
    return base


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark application, for plans with Python in them."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lattica-ship-")  # the driver's; Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/lattica-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(archive)
    # Batches bounded by bytes keep workers and buffers small whatever the texts; a setting of the user's own stays.
    if spark.conf.get(BATCH_CONF, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_CONF, "4194304b")
    _SHIPPED.add(context.applicationId)
