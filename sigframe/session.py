"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sigframe") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may do without the
    setting; its folder is then a temporary one that goes when Python ends. On a cluster the
    setting is required, because executors cannot read what another machine wrote locally.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not is_local(master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/sigframe-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` starts several."""
    return master == "local" or master.startswith("local[")


def drop_shared(spark: SparkSession) -> None:
    """Delete every intermediate folder of this process; call it once results are stored."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(hadoop).delete(path, True)


def written(df, name: str = "table"):
    """Cut the lineage of ``df`` through a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it rows reach Python ``rows`` at a time; afterwards the session has its own setting again. Only actions count, so
    store the result inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, rows)))
    try:
        yield
    finally:
        spark.conf.set(key, before)
