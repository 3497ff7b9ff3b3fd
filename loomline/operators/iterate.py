"""Tables written in the shared folder: they cut the lineage of loops and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is set in a session of one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("loomline.scratch", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        named = tempfile.mkdtemp(prefix="spark-loomline-")
        spark.conf.set("loomline.scratch", named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept as a table in the shared folder. Unlike a checkpoint it isn't worked out twice, and later
    reads take only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def removed(*tables: DataFrame) -> None:
    """Removes the files of settled tables that nothing will read any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
