"""Input, shared scratch tables, joins on hot keys and connected components used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see: ``spark.checkpoint.dir``.

    Where that setting is absent, a local session takes a temporary folder; on a cluster
    that is an error, since its machines share no such folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="panelcast-")
    return _OWN_DIR[app]


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/panelcast/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, if it is there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; to be called once no result that reads them is needed."""
    drop(spark, run_folder(spark))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends at the table, so a lost executor never repeats the work before
    it, and the files give the planner exact sizes.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_sized(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column, how: str = "inner", pieces: int = 2000) -> DataFrame:
    """``rows`` joined to ``groups`` (one row for each value of ``keys``, ``size`` = how many of ``rows`` have it), hot keys salted.

    A key with more than a ``pieces``-th of all rows is hot, so at most ``pieces`` keys are, and only
    their 64-bit hashes are broadcast.  Rows of a hot key are dealt by ``spread`` (a hash of what tells
    them apart) over as many salts as the key has shares, and its group's row is copied to each, which
    adds ``2 pieces`` rows at most.  Nulls in ``keys`` match nothing.
    """
    digest, salt, salts = (fresh(rows, n) for n in ("key_digest", "salt", "salts"))
    least = max(1, (groups.agg(F.sum(size)).first()[0] or 0) // pieces)
    hot = groups.where(F.col(size) > least).select(F.xxhash64(*keys).alias(digest), F.ceil(F.col(size) / least).cast("long").alias(salts))
    hot = F.broadcast(hot.groupBy(digest).agg(F.max(salts).alias(salts)))  # at most ``pieces`` pairs of longs
    left = rows.withColumn(digest, F.xxhash64(*keys)).join(hot, digest, "left").withColumn(salt, F.coalesce(F.pmod(spread, F.col(salts)), F.lit(0)))
    right = groups.withColumn(digest, F.xxhash64(*keys)).join(hot, digest, "left")
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(salts), F.lit(1)) - 1)))
    return left.drop(digest, salts).join(right.drop(digest, salts), [*keys, salt], how).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(node, component)``.

    ``component`` is the smallest node of the component; only nodes that occur in
    an edge are returned.  Each round contracts every node into the neighbour
    (or itself) that comes first in an order hashed anew per round, so paths and
    stars both shrink by a constant share a round.  The smallest neighbour is a
    plain aggregate with partial sums, so a hub with any number of edges is never
    gathered, and the joins on a hub are splittable by adaptive execution.
    """
    left = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    where = nodes.select("node", F.col("node").alias("at"))
    turn = 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        step = (
            both.select("a", F.struct(rank("b").alias("h"), F.col("b").alias("n")).alias("s"))
            .groupBy("a")
            .agg(F.min("s").alias("s"))
            .select("a", F.least(F.col("s"), F.struct(rank("a").alias("h"), F.col("a").alias("n")))["n"].alias("to"))
        )
        step = cut(step, "step")
        onto = lambda side: step.select(F.col("a").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: B023, E731
        left = cut(
            left.join(onto("a"), "a")
            .join(onto("b"), "b")
            .where("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .distinct(),
            "edges",
        )
        where = cut(
            where.join(onto("at"), "at", "left").select("node", F.coalesce("at_to", "at").alias("at")),
            "where",
        )
        turn += 1
    least = where.groupBy("at").agg(F.min("node").alias("component"))
    return where.join(least, "at").select("node", "component")
