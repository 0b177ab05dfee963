"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects of any session (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kernel_partitions(spark: SparkSession) -> int:
    """Partitions for work that costs by the row, not by the byte: AQE would coalesce them by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A plain scan that has fewer partitions than there are cores (a few small files), dealt over all cores; a larger
    one as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.rdd().getNumPartitions() < n else df


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; a local one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
        folder = "file://" + tempfile.mkdtemp(prefix="roadloom")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a parquet table into the shared folder and reads it back: computed once, lineage cut,
    and safe when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/roadloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that an operator may bring to the driver and broadcast; what is more is refused before it is collected.
MOST_BYTES = 1_000_000_000


def collected(df: DataFrame, what: str, cells: Column | None = None) -> list[Row]:
    """The rows of df, after their size has been checked: 100 bytes a row and 16 for each of its `cells` (array entries)."""
    size = df.agg(F.sum(F.lit(100) + 16 * (cells if cells is not None else F.lit(len(df.columns))))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{what}: about {size} bytes are more than tasks may be given ({MOST_BYTES})")
    return df.collect()


def discarded(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more, so that many rounds don't fill the shared folder."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("roadloom-"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
