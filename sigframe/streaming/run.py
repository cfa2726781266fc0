"""Running streams to completion over files that are there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sigframe.session import shared_dir

#: Event time of the row that ends a replay; it stands in no result.
END = "2261-01-01 00:00:00"


@dataclass(frozen=True)
class PerBatch:
    """A stream and what completes the rows that come out of each micro-batch.

    ``step`` gets these rows, the batch id and a folder where it may keep tables under that id, and returns rows of ``schema``. A repeated
    batch overwrites its own folders, so retries do not count twice.
    """

    rows: DataFrame
    schema: StructType
    step: Callable[[DataFrame, int, str], DataFrame]

    @property
    def sparkSession(self) -> SparkSession:
        return self.rows.sparkSession

    def start(self, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
        """Start the stream; results are a folder for each batch in ``path``/out."""
        def keep(batch: DataFrame, batch_id: int) -> None:
            self.step(batch, batch_id, f"{path}/kept").write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

        writer = self.rows.writeStream.outputMode(mode).foreachBatch(keep)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_files(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 1000) -> DataFrame:
    """A parquet file stream of what matches ``pattern`` in ``folder``: files, or tables that are folders of part files."""
    base = folder.rstrip("/")
    matched = f"{base}/{pattern}"
    schema = spark.read.parquet(matched).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # a file name filter sees the part files' own names, so folders are given as the path
    if is_folder(spark, matched):
        return reader.parquet(matched)
    return reader.option("pathGlobFilter", pattern).parquet(base)


def is_folder(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or one that the pattern matches, is a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return any(f.isDirectory() for f in found or [])


def replay(spark: SparkSession, folder: str, pattern: str, ts_col: str, files_per_trigger: int = 1000) -> tuple[DataFrame, Callable[[], None]]:
    """A stream of files that ends, and what ends it.

    Calling the second adds one row far in the future, NULL but for its event time, so that every window that is open and every row
    that waits is emitted; ``drain`` does so once all files are read.
    """
    files = read_files(spark, folder, pattern, files_per_trigger)
    last = f"{shared_dir(spark)}/end"
    row = spark.range(1).select(*[(F.lit(END) if f.name == ts_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in files.schema])
    row.limit(0).write.parquet(last)  # the folder has to be there when the stream starts
    return files.unionAll(spark.readStream.schema(files.schema).parquet(last)), lambda: row.write.mode("append").parquet(last)


def drain(df: DataFrame | PerBatch, mode: str = "append", finish: Callable[[], None] | None = None, allow_late: bool = False) -> DataFrame:
    """Process all available input into a parquet table in the shared folder and read it.

    With ``finish``, of ``replay``, the stream is ended and the result complete. Rows that come later than the stream allows
    are lost to it; unless that is allowed they are an error, because which they are depends on how files fall into batches.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    # progress of all batches is kept, not of the last hundred, or late rows of earlier ones would go uncounted
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(1 << 20))

    def start() -> StreamingQuery:
        if isinstance(df, PerBatch):
            return df.start(base, f"{base}/checkpoint", mode)
        return (
            df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )

    def run() -> int:
        q = start()
        q.awaitTermination()
        return sum(int(s.numRowsDroppedByWatermark) for p in q.recentProgress for s in p.stateOperators)

    late = run()
    if finish is not None:
        finish()
        late += run()
    if late and not allow_late:
        raise ValueError(f"{late} rows or partial groups came later than the stream allows; allow more time or pass allow_late")
    return spark.read.schema(df.schema).parquet(f"{base}/out").select(*df.schema.names)
