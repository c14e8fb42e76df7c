"""Field census, agreement of two passes, echoes and soft errors over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import html as H
from ..functions import text as T


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``."""
    fields = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_r"))
    return picked.select(key, *(F.col(f"_r.{c}").alias(c) for c in fields))


def field_census(rows: DataFrame, fields: list[str]) -> DataFrame:
    """filled, total and rate per field, in one pass over the table."""
    counted = rows.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(~T.is_empty(F.col(f).cast("string"))).alias(f"f{i}") for i, f in enumerate(fields)),
    )
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(i).alias("pos"), F.col(f"f{i}").alias("filled")) for i, f in enumerate(fields)))
    return (
        counted.select("total", F.explode(entries).alias("e"))
        .select("e.field", "e.pos", "e.filled", "total")
        .withColumn("rate", F.coalesce(F.col("filled") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))
    )


def open_field_census(rows: DataFrame, fields: str) -> DataFrame:
    """The census of records with open fields in a map column; a missing field counts in the total."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    filled = rows.select(F.explode(fields).alias("field", "value")).groupBy("field").agg(F.count_if(~T.is_empty("value")).alias("filled"))
    return filled.crossJoin(F.broadcast(total)).withColumn("rate", F.col("filled") / F.col("total"))  # one row


def empty_records(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys of the records all of whose fields are empty."""
    empty = F.lit(True)
    for f in fields:
        empty = empty & T.is_empty(F.col(f).cast("string"))
    return rows.where(empty).select(key)


def thin(census: DataFrame, floor: float = K.THIN_FLOOR) -> DataFrame:
    return census.where(F.col("rate") < floor)


def census_compare(before: DataFrame, after: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """The change in rate per field over the fields of both; a missing side is 0."""
    a = before.select("field", F.col("rate").alias("before"))
    b = after.select("field", F.col("rate").alias("after"))
    delta = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    return a.join(b, "field", "full").select("field", F.when(F.abs(delta) <= tolerance, F.lit(0.0)).otherwise(delta).alias("delta"))


def agreement(pass_a: DataFrame, pass_b: DataFrame, key: str, fields: dict[str, Column | None]) -> DataFrame:
    """(id, field, class, value_a, value_b) of two passes over the same records.

    ``fields`` gives each field's normal form as a function of a column name, or None for
    ``text_norm``.  A value present in one pass only is in its own class, and is neither
    agreed nor disputed.
    """

    def long(rows: DataFrame, side: str) -> DataFrame:
        entries = F.array(
            *(
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f).cast("string").alias("value"),
                    (norm(f) if norm else T.text_norm(F.col(f).cast("string"))).alias("norm"),
                )
                for f, norm in fields.items()
            )
        )
        e = rows.select(F.col(key).alias("id"), F.explode(entries).alias("e")).where(T.is_present(F.col("e.value")))
        return e.select("id", "e.field", F.col("e.value").alias(f"value_{side}"), F.col("e.norm").alias(f"norm_{side}"))

    both = long(pass_a, "a").join(long(pass_b, "b"), ["id", "field"], "full")
    kind = (
        F.when(F.col("norm_a").isNull(), "only_in_b")
        .when(F.col("norm_b").isNull(), "only_in_a")
        .when(F.col("norm_a") == F.col("norm_b"), "agreed")
        .otherwise("disputed")
    )
    return both.select("id", "field", kind.alias("class"), "value_a", "value_b")


def agreement_rate(compared: DataFrame) -> DataFrame:
    """agreed over agreed and disputed; 1.0 if nothing was comparable."""
    agreed, disputed = F.count_if(F.col("class") == "agreed"), F.count_if(F.col("class") == "disputed")
    return compared.agg(F.coalesce(agreed / F.nullif(agreed + disputed, F.lit(0)), F.lit(1.0)).alias("rate"))


def agreed_values(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("class") == "agreed").select("id", "field", F.col("value_a").alias("value"))


def echo_scan(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, value, reasons) of the values that echo an address."""
    entries = F.array(
        *(
            F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), T.echo_reasons(F.col(f), f).alias("reasons"), T.is_echo(F.col(f), f).alias("echo"))
            for f in fields
        )
    )
    found = rows.select(F.col(key).alias("id"), F.explode(entries).alias("e")).where("e.echo")
    return found.select("id", "e.field", "e.value", "e.reasons")


def soft_errors(pages: DataFrame, key: str = "page_id", html: str = "html", min_text: int = K.MIN_TEXT, locales=("en",), ceiling: int | None = None) -> DataFrame:
    """Pages with their visible length, the reasons against them, and whether they are suspect.

    An error phrase on a short page is enough by itself; on a long page it is one reason
    of the two that are needed.
    """
    ceiling = 4 * min_text if ceiling is None else ceiling
    seen = pages.select("*", H.visible_text(html).alias("_text"), H.title(html).alias("_title"))
    seen = seen.withColumn("text_chars", F.length("_text")).withColumn("_phrase", T.first_marker(F.lower("_text"), K.markers("soft_error_markers", locales)))
    why = T.reasons(
        (F.col("text_chars") < min_text, F.concat(F.lit("only "), F.col("text_chars").cast("string"), F.lit(" chars of visible text"))),
        (F.coalesce("_title", F.lit("")) == "", "no <title>"),
        (F.col("_phrase").isNotNull(), F.concat(F.lit("error phrase: '"), F.col("_phrase"), F.lit("'"))),
        (T.text_or_empty(html).rlike(K.ERROR_ICON), "error icon"),
    )
    conclusive = F.col("_phrase").isNotNull() & (F.col("text_chars") < ceiling)
    return seen.withColumn("reasons", why).withColumn("suspect", conclusive | (F.size("reasons") >= 2)).drop("_text", "_title", "_phrase")


def sorted_census(census: DataFrame) -> DataFrame:
    """Fields by rising rate, equal ones in their own order, with their place."""
    return census.withColumn("place", F.row_number().over(Window.orderBy("rate", "pos")))  # a row per field


