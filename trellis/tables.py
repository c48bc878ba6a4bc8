"""Reading the input tables and the places a job may write to."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from trellis.exceptions import TrellisError


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartitions only an input with fewer splits than half the cores, as one small file is; larger inputs keep their splits."""
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names it, else, on a local master only (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise TrellisError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "trellis-shared")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back: a columnar cut of the lineage. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trellis-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of written() rows that are no longer needed, and the shuffle files of plans that nothing refers to."""
    spark = frames[0].sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # type: ignore[union-attr]
    for folder in {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(folder)  # type: ignore[union-attr]
        place.getFileSystem(conf).delete(place, True)
    gc.collect()
    jvm.System.gc()  # type: ignore[union-attr]
