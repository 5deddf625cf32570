"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CUTS: list[str] = []


def local_session(cores: int = 8, partitions: int | None = None, app: str = "landloom") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the cluster names none (tests, one machine) a folder of our own is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="landloom-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written as a compressed table in the shared folder and read back: lineage ends here, a lost executor costs nothing, and later reads are pruned by column.

    The tables stay until `drop_cuts` or until the folder is cleared, as results that are still lazy may read them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _CUTS.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Deletes the table behind a result of `cut` that nothing will read again, such as the last round's state of an iteration."""
    path = getattr(df, "_cut_path", None)
    if path in _CUTS:
        _CUTS.remove(path)
        _delete(df.sparkSession, path)


def drop_cuts(spark: SparkSession) -> None:
    """Deletes the tables that `cut` wrote in this process. Call it when no result that reads them is needed any more."""
    while _CUTS:
        _delete(spark, _CUTS.pop())
