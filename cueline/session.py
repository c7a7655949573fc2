"""Session helpers: the shared folder and tables written to it.

Intermediate results that several jobs read are written as Parquet under the
folder named by ``spark.checkpoint.dir``. They survive lost executors, and
readers keep column pruning and predicate pushdown, which a checkpointed RDD
would lose.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "cueline") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, from ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage. Where it is unset (tests,
    one machine) a scratch folder is made once and the setting is filled in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.cueline.scratch.dir", None
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.cueline.scratch.dir", folder)
    return folder


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    ``zstd`` suits tables of many lines of text that are read about once."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/cueline/{app}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input that is read in fewer splits than there are cores.

    A table of one row group is read by one task however large the cluster.
    Inputs of many splits, as all large ones are, pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
