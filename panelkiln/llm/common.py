"""Pieces that several operators share: words, keys, checkpoints and components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows of one key, at least, that a join treats apart from the others.
HOT_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for NULL or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is evaluated once whatever body does with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may do without one being named."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelkiln-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same through a compressed Parquet table, which `forget` can delete."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # different values for the most part: dictionaries would be tried and given up
    df.write.option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what `written` made, once nothing reads it any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._table)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets go of shuffles and broadcasts that nothing refers to any more: Spark deletes them once the driver's garbage collector has seen that."""
    gc.collect()
    spark._jvm.System.gc()


def row_key() -> Column:
    """Tells rows apart within one scan, repeated ones too. Another scan may number them differently: see `keyed`."""
    return F.monotonically_increasing_id()


def _stored(plan) -> bool:
    """Whether a plan is one file scan under selections and filters, so that its rows have their places in files."""
    if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation"):
        return False
    children = plan.children()
    return all(_stored(children.apply(i)) for i in range(children.size()))


def keyed(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs with the struct `name`: a row's file (hash of its path) and its place there. Unlike a running number, it is the
    same in every scan, however many cores plan it. Anything but stored Parquet rows is written to the shared folder first."""
    def with_key(df: DataFrame) -> DataFrame:
        return df.select("*", F.struct(F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << 62) - 1)).alias("f"), F.col("_metadata.row_index").alias("r")).alias(name))

    if _stored(docs._jdf.queryExecution().analyzed()):
        try:
            return with_key(docs)
        except AnalysisException:
            pass  # no Parquet files
    return with_key(written(docs, "rows"))


def least_joined(rows: DataFrame, least: DataFrame, bound: int) -> DataFrame:
    """rows joined on `u` with least (u, m, n), n being the rows' number by u. The few u with more than `bound` rows are sent to
    the rows; a bound of a thousandth of all rows leaves at most a thousand of these."""
    hot = least.where(F.col("n") > bound).select("u", F.col("m").alias("hot"))
    flagged = rows.join(F.broadcast(hot), "u", "left")
    rest = flagged.where(F.col("hot").isNull()).drop("hot").join(least.where(F.col("n") <= bound).drop("n"), "u")
    return flagged.where(F.col("hot").isNotNull()).withColumnRenamed("hot", "m").union(rest)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges, as (node, root) with the smallest node as root.

    Alternates large-star and small-star steps until the edges are stars. Only minima are aggregated (partial sums before the
    shuffle), hubs are joined apart from other nodes, and each round is written, so neither a hub nor a long chain gathers in
    one task or in the lineage. Nodes without an edge don't appear.
    """
    def stored(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = written(e.distinct(), "edges")
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return e, tuple(row)

    u, v = F.col("u"), F.col("v")
    e, seen = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while seen[0]:
        bound = max(HOT_ROWS, seen[0] // 500)
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = least_joined(both.where(v > u), least, bound).select(v.alias("u"), F.col("m").alias("v"))
        first = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = least_joined(large, first, bound).where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).union(first.select("u", "m"))
        before = e
        e, now = stored(small)
        forget(before)
        # a round's shuffles are small, but have files for each of its tasks
        del both, least, large, first, small, before
        tidy(edges.sparkSession)
        if now == seen:
            break
        seen = now
    roots = e.select(v.alias("node"), v.alias("root")).distinct()
    return e.select(u.alias("node"), v.alias("root")).union(roots)
