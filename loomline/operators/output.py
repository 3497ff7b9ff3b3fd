"""The output of a run: nested session documents by bucket, tables, and a manifest that makes them visible.

A run writes into a folder of its own below the root; no reader looks there yet. Documents are JSON in hash buckets, whole
buckets are replaced (dynamic partition overwrite), so a run of the same name can be repeated. The manifest comes last,
under the next number, by a rename: readers take the one with the highest number and see the set of files that it names,
all of one state. A run over some sessions only rewrites their buckets and takes the others from the manifest before.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.logs import Run

BUCKETS = 64


class _Files:
    """The file system of a folder that Spark reaches, for the few small files that the driver writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path("").getFileSystem(conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes the file whole or not at all; False if there is one of that name."""
        part = f"{name}.part"
        stream = self.fs.create(self._path(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return not self.fs.exists(self._path(name)) and self.fs.rename(self._path(part), self._path(name))

    def remove(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What the last complete run has left: {"run", "details": {bucket: folder}, "tables": {name: folder}, "schemas"}."""
    files = _Files(spark, root)
    found = [n for n in files.names("_manifests") if n.endswith(".json")]
    return json.loads(files.read(f"_manifests/{found[-1]}")) if found else None


def bucket_of(session_id: str = "session_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def write(spark: SparkSession, root: str, name: str, details: DataFrame, tables: dict[str, DataFrame], buckets: int = BUCKETS, only: DataFrame | None = None, run: Run | None = None) -> dict:
    """Writes a run called name and returns its manifest.

    details has a row per session (session_id and whatever is nested in it); tables are written as Parquet. only: (session_id) of
    the sessions that have changed or gone; their buckets are written anew from details, the others stay as the last run
    left them. Without it every bucket is new, and one that no session falls into any more is gone. run observes the
    sessions written.
    """
    before = manifest(spark, root)
    if before is not None and only is not None and before["buckets"] != buckets:
        raise ValueError(f"the output has {before['buckets']} buckets")
    rows = details.withColumn("bucket", bucket_of("session_id", buckets))
    stale = None
    if only is not None:
        changed = only.select(bucket_of("session_id", buckets).alias("bucket")).distinct()
        stale = {r.bucket for r in changed.collect()}  # at most one row a bucket
        rows = rows.join(F.broadcast(changed), "bucket", "left_semi").select(*rows.columns)
    folder = f"{root.rstrip('/')}/{name}"
    rows = rows.repartition("bucket")
    if run is not None:
        rows, run.wrote = rows.observe(run.written, F.count(F.lit(1)).alias("written")), True
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").json(f"{folder}/details")
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/tables/{table}")
    files = _Files(spark, root)
    # A run that is repeated may have left buckets which it doesn't have any more.
    own = {r.bucket for r in details.select(bucket_of("session_id", buckets).alias("bucket")).distinct().collect()}
    live = {str(b): f"{name}/details/bucket={b}" for b in sorted(own if stale is None else own & stale)}
    if stale is not None and before is not None:
        live |= {b: path for b, path in before["details"].items() if int(b) not in stale}
    old = before or {"tables": {}, "schemas": {}}
    found = {
        "run": name, "buckets": buckets, "details": live, "detail_schema": details.schema.jsonValue(),
        "tables": old["tables"] | {t: f"{name}/tables/{t}" for t in tables}, "schemas": old["schemas"] | {t: df.schema.jsonValue() for t, df in tables.items()},
    }
    number = max((int(n.split(".")[0]) + 1 for n in files.names("_manifests")), default=0)
    while not files.put(f"_manifests/{number:08}.json", json.dumps(found)):
        number += 1
    return found


def read_details(spark: SparkSession, root: str) -> DataFrame:
    """The documents of the last complete run."""
    from pyspark.sql.types import StructType

    found = manifest(spark, root)
    if found is None:
        raise FileNotFoundError(f"no complete run below {root}")
    schema = StructType.fromJson(found["detail_schema"])
    paths = [f"{root.rstrip('/')}/{p}" for p in found["details"].values()]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    from pyspark.sql.types import StructType

    found = manifest(spark, root)
    if found is None or name not in found["tables"]:
        raise FileNotFoundError(f"no table {name} below {root}")
    return spark.read.schema(StructType.fromJson(found["schemas"][name])).parquet(f"{root.rstrip('/')}/{found['tables'][name]}")


def clear(spark: SparkSession, root: str) -> list[str]:
    """Removes the folders of runs that the last manifest doesn't name any more; returns their names. Manifests before it go
    too, so readers that began with them must have ended."""
    found = manifest(spark, root)
    if found is None:
        return []
    files = _Files(spark, root)
    used = {p.split("/", 1)[0] for p in [*found["details"].values(), *found["tables"].values(), f"{found['run']}/"]}
    gone = [n for n in files.names("") if n not in used and not n.startswith("_")]
    for n in gone:
        files.remove(n)
    for n in files.names("_manifests")[:-1]:
        files.remove(f"_manifests/{n}")
    return gone
