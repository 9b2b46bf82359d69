"""One place for the session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.parquet.compression.codec": "zstd",
    # HotSpot never compiles longer methods; beyond it, split projections beat one generated method
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fleetloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is absent (tests on one machine) a local folder is made
    and registered, so that later calls in the session agree on it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="fleetloom-shared-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def checkpointed(df):
    """Cut the lineage through the shared checkpoint folder, eagerly."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def small_side(df, rows: int = 500_000):
    """The frame, evaluated once in the shared folder; marked for broadcast only if it proves to have
    at most ``rows`` rows. Beyond that, joins with it shuffle as Catalyst plans."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= rows else df


def together(tasks: dict[str, Callable[[], T]]) -> dict[str, T]:
    """The results of tasks that don't depend on each other, submitted at once: while one is
    planned or waits for its last tasks, the cores work for the others."""
    with ThreadPoolExecutor(max_workers=max(1, len(tasks))) as pool:
        running = {n: pool.submit(f) for n, f in tasks.items()}
        return {n: r.result() for n, r in running.items()}


def spread(df, key: str):
    """The rows over all cores where few files would leave most of them idle.

    Costs a shuffle of the rows, so only inputs with fewer partitions than cores
    take it: those are small, or badly laid out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package's code to the executors and set the limit of generated
    methods, once per application.

    The archive is only the driver's upload; Spark serves it to every executor,
    those that join later included.
    """
    context = spark.sparkContext
    if spark.conf.get("fleetloom.shipped", None) != context.applicationId:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="fleetloom-"), "fleetloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(Path(root.name) / f.relative_to(root)))
        context.addPyFile(target)
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", SETTINGS["spark.sql.codegen.hugeMethodLimit"])
        spark.conf.set("fleetloom.shipped", context.applicationId)
    return spark
