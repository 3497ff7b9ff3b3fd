"""What the operators of this subpackage share: the shared folder, written tables, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    A cluster names it in spark.checkpoint.dir. Only where that is unset in a session of one machine (tests, local runs)
    a temporary folder takes its place.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        named = spark.conf.get("loomline.scratch", None) or tempfile.mkdtemp(prefix="spark-loomline-")
        spark.conf.set("loomline.scratch", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, survives lost executors, has a known size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes the files of written tables that nothing will read any more, and lets Spark remove shuffle files of jobs that
    have ended, which otherwise stay until the driver's next collection of garbage."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


#: Rows of texts in an Arrow batch, where the session leaves it at Spark's 10,000.
TEXTS_AT_ONCE = 2000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch: texts are long, and a batch stands in the JVM, in Arrow and in pandas at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(TEXTS_AT_ONCE))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Entries of one generation and the longest key that Recent keeps.
KEPT, LONGEST = 200_000, 64


class Recent(dict):
    """make(key) by key, kept for keys asked for lately: two generations of at most KEPT entries, of which the older goes
    when the newer is full. Keys longer than LONGEST aren't kept, so memory is bounded. Indexing is all it's for."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node reachable; a written table.

    Each round ties every node to its least neighbour, follows these ties to their roots, which are the least of their
    trees, and keeps only edges between different roots. So an edge is joined in the first round, few are in later ones, and
    two rounds halve the nodes at least. Nodes without an edge to another node don't appear. Rows with a null end are ignored.
    """
    links = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "component-edges",
    )
    ties, spent = [], [links]
    while not ties or not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ties.append(_rooted(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), spent))
        root = lambda c: ties[-1].select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        ahead = links.join(root("u"), "u").select("v", "of_u").distinct().join(root("v"), "v").where("of_u != of_v")
        links = written(ahead.select(F.greatest("of_u", "of_v").alias("u"), F.least("of_u", "of_v").alias("v")).distinct(), "component-edges")
        spent.append(links)
    named = ties[-1]
    for earlier in reversed(ties[:-1]):
        further = named.select(F.col("node").alias("component"), F.col("component").alias("further"))
        named = earlier.join(further, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    if len(ties) > 1:
        named = written(named, "components")
        spent += ties
    dropped(*spent)
    return named


def _rooted(ties: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Ties (node, component) to smaller nodes, or the node itself at a root, followed to their roots by leaps that double."""
    ties = written(ties, "ties")
    while True:
        ahead = ties.where("node != component").select(F.col("node").alias("component"), F.col("component").alias("further"))
        if ties.join(ahead, "component", "left_semi").isEmpty():
            return ties
        spent.append(ties)
        ties = written(ties.join(ahead, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "ties")


def least_hashed(rows: DataFrame, key: list[str], n: int, total: int) -> DataFrame:
    """The n different rows whose key has the least hash, of about `total` rows: looked for among those under a bound that
    some four times n should pass, so that one task sorts no more, and among all if repeats left too few."""
    if n <= 0:
        return rows.limit(0)
    place = F.pmod(F.xxhash64(F.lit(3), *key), F.lit(1 << 30))
    first = lambda kept: kept.dropDuplicates(key).orderBy(place, *key).limit(n)
    if total <= 4 * n:
        return first(rows)
    near = written(first(rows.where(place < F.lit(int((1 << 30) * 4 * n / total)))), "least-hashed")
    return near if near.count() == n else first(rows)
