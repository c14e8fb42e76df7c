"""What the operators of this subpackage share: the shared folder, stored tables, components.

Tables that are used more than once are written as Parquet below the folder that the
cluster names in ``spark.checkpoint.dir`` and read back.  That cuts lineage, survives
lost executors, and makes later passes see exactly the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import plan_bytes, shared_folder, spread  # noqa: F401

#: Rows in one Arrow batch; bounds the memory of a Python worker for long texts.
BATCH_ROWS = 256


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder, or anew to ``path``, and read it back with the same schema."""
    spark = df.sparkSession
    mode, path = ("overwrite", path) if path else ("errorifexists", new_path(spark, name))
    df.write.mode(mode).option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that one Arrow batch holds, before a plan with Python tasks is run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the text with null as empty, and named further columns.

    Rows without doc_id are left out, because no row of a result could name them.
    """
    return spread(docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more))


def one_row_each(docs: DataFrame, keep: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are in ``keep`` (doc_id, row, distinct); of rows that repeat both, one.

    ``row`` is ``hashed`` of the text, null as empty.  Rows are joined and told apart by the same
    keys, so they are shuffled once.
    """
    whole = docs.select("doc_id", hashed(F.coalesce(F.col("text"), F.lit(""))).alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    kept = whole.join(keep.hint("merge"), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_cells(rows: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """``rows`` with columns ``cell`` (long) and ``side`` (0 or 1), for a self-join inside each key.

    A group of one row has nothing to join and is left out.  One of up to ``most`` rows is a
    cell.  A larger one is dealt by the hash of ``by`` into chunks of about ``most`` rows, and
    each pair of chunks (i, j), i <= j, is a cell: side 0 holds chunk i and side 1 chunk j.  So
    every pair of rows of a group meets in exactly one cell, and no task holds more than about
    two chunks of one.  Cells are hashes: rows of other keys in a cell are to be told apart.
    """
    sizes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_here")).where("n_here > 1"), "cell-sizes")
    chunks = F.ceil(F.col("n_here") / F.lit(most)).cast("int")
    return (
        rows.join(sizes, keys)
        .withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("cell", F.xxhash64(*keys, F.least("chunk", "other"), F.greatest("chunk", "other")))
        .withColumn("side", (F.col("chunk") > F.col("other")).cast("int"))
        .drop("n_here", "chunks", "chunk", "other")
    )


def whole_groups(batches, most: int = 8192, most_bytes: int = 64 << 20):
    """Regroup sorted Arrow batches into tables that hold whole runs of equal first columns.

    A table is closed at the end of a run once it has ``most`` rows or ``most_bytes``.
    """
    import numpy as np
    import pyarrow as pa

    held: list = []
    rows = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows < most and size < most_bytes:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def smallest_linked(n: int, a, b):
    """For nodes 0..n-1 and links ``a[i]``-``b[i]`` the smallest node that each can reach (numpy)."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        np.minimum.at(now, label[a], least)
        np.minimum.at(now, label[b], least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long) as (node, root), root the smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges
    form stars.  A step joins each edge with the smallest neighbour of its node; that
    side holds a node once and is stored, and the other side may be skewed, which Spark's
    adaptive skew join splits.  Nodes without an edge are not returned.  Rounds take turns
    in two sets of tables, so their number does not add to what is stored.
    """
    spark = edges.sparkSession
    paths = [{t: new_path(spark, t) for t in ("edges", "least", "large", "low")} for _ in range(2)]
    now = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before, turn = None, 0
    while True:  # ends: each round only lowers ends of edges
        here = paths[turn % 2]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least", path=here["least"])
        large = stored(
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct(),
            "large",
            path=here["large"],
        )
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low", path=here["low"])
        small = (
            large.join(low, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = stored(small, "edges", path=here["edges"])
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, turn = state, turn + 1
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b"))).distinct()
