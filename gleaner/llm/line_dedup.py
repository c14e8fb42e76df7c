"""Line dedup by winnowing over line hashes, with DataFrame functions only.

1. Winnow: of every ``run`` consecutive lines of a document the smallest line hash is
   selected (the rightmost of equals).  Only the selected lines are indexed, about two in
   ``run + 1``, each with the hashes of the ``run - 1`` lines on both sides.  Two equal runs
   of ``run`` lines select the same line of them, so a repeated run is guaranteed to share one.
2. Join positions: selected lines whose hash stands at one place only are dropped.
3. Extend both ways: a shared line is extended over its neighbours to every run of ``run``
   lines that holds it.  Lines are equal if both of their 64-bit hashes are.  Each run of
   lines has its first place, in the order of (doc_id, row, line); places after that match
   it, and matches that overlap or touch extend each other to maximal runs.
4. The lines of these later runs are deleted.

The sides of the joins that hold a line or a run once come from partial aggregations and are
stored, so that the other side, which may be skewed, is joined with splitting; they grow with
the input, so none is broadcast.  A document's positions are the only group that is gathered,
and it is as large as the document.

A row is known by doc_id and a hash of its text (``row``), so rows that share a doc_id keep
lines of their own.  Defined results: a null text counts as empty, and an empty text is one
empty line; lines end at line feeds and are compared unchanged; runs are judged on the
input, so a document may repeat its own earlier lines; documents of fewer than ``run`` lines
stay whole; rows without doc_id are left out; rows that repeat a doc_id with the same text
are one document, of which each row keeps what that keeps; of different texts under one
doc_id the one with the smaller row hash comes first; an empty table gives an empty table;
other columns are passed on, but for n_lines, n_removed and n_runs, which are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RUN = 3


def _lines(text: Column | str = "text") -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def _row(text: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def selected_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, row, the selected line ``at``, its hash ``fp``, and two hashes of each line from ``start`` on around it."""
    hashed = docs.where("doc_id is not null").select(
        "doc_id",
        _row().alias("row"),
        F.transform(_lines(), lambda x, i: F.struct(F.xxhash64(x).alias("h"), (-i).alias("p"))).alias("a"),
        F.transform(_lines(), lambda x: F.xxhash64(F.lit(run), x)).alias("b"),
    )
    size = F.size("a")

    def position(at: Column) -> Column:
        start = F.greatest(at - (run - 1), F.lit(0))
        n = F.least(at + run, size) - start
        return F.struct(F.get("a", at)["h"].alias("fp"), at.alias("at"), start.alias("start"), F.slice("a", start + 1, n)["h"].alias("h"), F.slice("b", start + 1, n).alias("k"))

    # Distinct positions are found by hashing, as they are integers; distinct structs would be compared each with all.
    minima = F.array_distinct(F.transform(F.sequence(F.lit(0), size - run), lambda i: -F.array_min(F.slice("a", i + 1, run))["p"]))
    chosen = hashed.where(size >= run).withColumn("minima", minima)
    return chosen.select("doc_id", "row", F.explode(F.transform("minima", position)).alias("s")).select("doc_id", "row", "s.*")


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Maximal runs of lines to delete: doc_id, row, first line, and the line after the last."""
    index = stored(selected_lines(docs, run), "line-index")
    place = F.struct("doc_id", "row", "at")
    shared = stored(index.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp"), "line-shared")

    def extended(i: Column) -> Column:
        at = i - F.col("start") + 1
        return F.struct(i.alias("i"), F.xxhash64(F.slice("h", at, run)).alias("k1"), F.xxhash64(F.slice("k", at, run)).alias("k2"))

    last = F.least(F.col("at"), F.col("start") + F.size("h") - run)
    near = index.join(shared.hint("merge"), "fp", "left_semi")
    matches = near.select("doc_id", "row", F.explode(F.transform(F.sequence("start", last), extended)).alias("w")).select("doc_id", "row", "w.*")
    here = F.struct("doc_id", "row", "i")
    first = stored(
        matches.groupBy("k1", "k2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first <> last").select("k1", "k2", "first"), "line-first"
    )
    later = matches.join(first.hint("merge"), ["k1", "k2"]).where(here > F.col("first")).select("doc_id", "row", "i").distinct()
    by_place = Window.partitionBy("doc_id", "row").orderBy("i")
    begins = F.coalesce(F.col("i") > F.lag("i").over(by_place) + run, F.lit(True))
    return (
        later.withColumn("new", begins.cast("int"))
        .withColumn("nr", F.sum("new").over(by_place))
        .groupBy("doc_id", "row", "nr")
        .agg(F.min("i").alias("first_line"), (F.max("i") + run).alias("end_line"))
        .drop("nr")
    )


def delete_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with ``text`` after deletion, and n_lines, n_removed and n_runs."""
    by_place = Window.partitionBy("doc_id", "row").orderBy("first_line")
    kept_before = F.col("first_line") - F.coalesce(F.lag("end_line").over(by_place), F.lit(0))
    marks = F.concat(F.expr("repeat('k', cast(gap as int))"), F.expr("repeat('d', cast(end_line - first_line as int))"))
    per_row = (
        repeated_runs(docs, run)
        .withColumn("gap", kept_before)
        .select("doc_id", "row", "first_line", (F.col("end_line") - F.col("first_line")).alias("n"), marks.alias("marks"))
        .groupBy("doc_id", "row")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_line", "marks"))), lambda x: x["marks"]), "").cast("binary").alias("marks"),
            F.sum("n").alias("removed"),
            F.count(F.lit(1)).alias("runs"),
        )
    )
    # All columns of a document go in one, so no name can clash.
    whole = docs.where("doc_id is not null").select("doc_id", _row().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    lines = _lines(F.col("doc")["text"])
    # A byte of the marks is read in constant time, so long documents take linear time.
    stays = lambda _, i: (i >= F.length("marks")) | (F.substring(F.col("marks"), i + 1, F.lit(1)) == F.lit(b"k"))
    kept = F.when(F.col("marks").isNull(), F.col("doc")["text"]).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    found = whole.join(per_row.hint("merge"), ["doc_id", "row"], "left").select(
        "doc",
        kept.alias("kept"),
        F.size(lines).cast("long").alias("lines"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("removed"),
        F.coalesce("runs", F.lit(0)).cast("long").alias("runs"),
    )
    return found.select(
        *(F.col("doc")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed", "n_runs")),
        F.col("kept").alias("text"),
        F.col("lines").alias("n_lines"),
        F.col("removed").alias("n_removed"),
        F.col("runs").alias("n_runs"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = delete_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The lines of ``documents`` that stay, as CTEs; {source} is the table.
KEPT_LINES = f"""
    lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
        FROM {{source}}),
    windows AS (
        SELECT doc_id, i, [{', '.join(f'lead(line, {k}) OVER w' for k in range(RUN))}] AS key, lead(i, {RUN - 1}) OVER w IS NOT NULL AS whole
        FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    later AS (
        SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nr FROM windows WHERE whole)
        WHERE nr > 1),
    deleted AS (SELECT DISTINCT doc_id, i + o.o AS i FROM later, range({RUN}) o(o)),
    marked AS (
        SELECT l.doc_id, l.i, l.line, d.i IS NOT NULL AS gone,
               coalesce(lag(d.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS gone_before
        FROM lines l LEFT JOIN deleted d ON l.doc_id = d.doc_id AND l.i = d.i)"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE = {
    "op1_line_dedup": "WITH "
    + KEPT_LINES.format(source="documents")
    + """
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           count(*) FILTER (gone AND NOT gone_before) AS n_runs,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""
}
