"""Session-level helpers shared by all operators: table reading, lineage cuts, parallelism."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the tests and the benchmark use."""
    builder = SparkSession.builder.master(master).appName("scholiast")
    base = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; where it is unset, make one on a single machine and refuse on a cluster, whose executors could not share it."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="scholiast-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint that is never broadcast: joins with it sort both sides, wherever it stands below filters, aggregates or Python.

    The size that Spark goes by is that of the compressed files the checkpoint was made
    from, as if every row had stayed one row. Where rows were unpacked or multiplied it is
    hundreds of times too small, and a table of gigabytes would pass for one the driver can hold.
    """
    return materialize(df).hint("merge")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition a scan only where it yields fewer partitions than the cluster has cores.

    A large table is read in many splits and passes unchanged; a small one, read in a
    few, is spread so that Python work uses every core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if df.rdd.getNumPartitions() < cores else df


def parallel(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Share out rows behind a shuffle before costly Python work.

    Adaptive execution joins small shuffle partitions by their bytes; where a row is a few
    bytes but costs much to process, that leaves one task with all of it.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism * per_core, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that Python workers can import it wherever they run."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_scholiast_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="scholiast-"), "scholiast.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._scholiast_shipped = True
    return spark
