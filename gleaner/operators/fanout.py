"""Work-lists, census gates, authorized replies and their ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import fences as N
from ..functions import text as T
from .ordering import ordered
from .quality import last_wins


def finished(state: Column | str) -> Column:
    """Whether a done entry (JSON text) counts: an object by its status, a text if ok, else by truth."""
    s = F.trim(T.text_or_empty(state))
    status = F.get_json_object(s, "$.status")
    return (
        F.when(F.startswith(s, F.lit("{")), F.coalesce(status == "ok", F.lit(False)))
        .when(F.startswith(s, F.lit('"')), s == '"ok"')
        .otherwise(~s.isin("", "null", "false", "0", "0.0", "[]"))
    )


def pending(worklist: DataFrame, done: DataFrame, key: str = "id", reverify: bool = False) -> DataFrame:
    """The items that are not finished; all of them if ``reverify``."""
    return worklist if reverify else worklist.join(done.where(finished("state")).select(key), key, "left_anti")


def batches(worklist: DataFrame, ordinal: str = "ordinal", size: int = K.BATCH_SIZE) -> DataFrame:
    """Items (ordinals from 0) with the number of their slice."""
    return worklist.withColumn("batch", F.floor(F.col(ordinal) / F.lit(size)))


def census_gate(worklist: DataFrame, produced: DataFrame, universe: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(id, class): matched, missing (asked, not produced), extra (produced, not asked), invisible (never asked)."""
    asked = worklist.select(key).distinct().withColumn("asked", F.lit(True))
    made = produced.select(key).distinct().withColumn("made", F.lit(True))
    both = asked.join(made, key, "full")
    kind = F.when(F.col("asked").isNull(), "extra").when(F.col("made").isNull(), "missing").otherwise("matched")
    found = both.select(key, kind.alias("class"))
    if universe is not None:
        unseen = universe.select(key).distinct().join(asked, key, "left_anti")
        found = found.union(unseen.select(key, F.lit("invisible")))
    return found


def census_rollup(gate: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col("class") == name).alias(name)
    rolled = gate.agg(count("matched"), count("missing"), count("extra"), count("invisible"))
    return rolled.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("invisible") == 0))


def strict_join(worklist: DataFrame, produced: DataFrame, key: str = "id") -> DataFrame:
    return produced.join(worklist.select(key), key, "left_semi")


def authorize(replies: DataFrame, wanted: DataFrame, agent: str = "agent_id") -> DataFrame:
    """``replies`` with ``authorized``: the id equals a wanted one or one is a prefix of the other.

    Joined by equality: the prefixes of an id (it is short) against wanted ids, and the id
    against the prefixes of wanted ids.  Empty wanted ids authorize nothing.
    """
    w = wanted.select(F.col(wanted.columns[0]).alias("w")).where("w <> ''").distinct()
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substr(F.col(c), F.lit(1), n)))
    ids = replies.select(F.col(agent).alias("a")).where("a <> ''").distinct()
    shorter = ids.select("a", prefixes("a").alias("w")).join(w, "w").select("a")
    longer = ids.join(w.select(prefixes("w").alias("a")), "a", "left_semi").select("a")
    allowed = shorter.union(longer).distinct().withColumn("authorized", F.lit(True))
    return replies.join(allowed, replies[agent] == allowed["a"], "left").drop("a").withColumn("authorized", F.coalesce("authorized", F.lit(False)))


def empty_payload(payload: Column | str) -> Column:
    """A JSON text that holds nothing: null, empty, no records, or an object of empty values."""
    s = F.trim(T.text_or_empty(payload))
    records = F.regexp_replace(F.coalesce(F.get_json_object(s, "$.records"), F.lit("-")), r"\s", "")
    values = F.map_values(F.from_json(s, "map<string,string>"))
    hollow = F.forall(values, lambda v: v.isNull() | F.regexp_replace(v, r"\s", "").isin("", "[]", "{}"))
    bare = F.regexp_replace(s, r"\s", "")
    return bare.isin("", "null", "[]", "{}", '""') | records.isin("[]", "{}") | (F.startswith(s, F.lit("{")) & F.coalesce(hollow, F.lit(False)))


def ledger(replies: DataFrame, wanted: DataFrame, schema_keys: list[str] | None = None, keymap: DataFrame | None = None, marker: str | None = None) -> DataFrame:
    """One row per reply: agent_id, source, item_id, bucket (``applied`` or why not), payload, n, m.

    The tests come in a fixed order, and the first that fails names the bucket.
    """
    rows = authorize(replies, wanted)
    body = N.json_block("text", marker)
    rows = rows.withColumn("payload", body).withColumn("_ok", F.try_parse_json("payload").isNotNull())
    own = F.get_json_object("payload", "$.item_id")
    rows = rows.withColumn("_named", F.coalesce(F.col("item_id"), F.when(F.col("_ok"), own)))
    if keymap is not None:
        targets = keymap.select(F.col("item_id").alias("_named"), F.col("target").alias("_target"))
        rows = rows.join(targets, "_named", "left")
    else:
        rows = rows.withColumn("_target", F.col("_named"))
    unknown = F.lit(False)
    if schema_keys is not None:
        unknown = F.coalesce(F.size(F.array_except(F.json_object_keys("payload"), F.array(*map(F.lit, schema_keys)))) > 0, F.lit(False))
    bucket = (
        F.when(~F.col("authorized"), "unauthorized")
        .when(F.col("payload").isNull(), "no-block")
        .when(~F.col("_ok"), "unparseable")
        .when(F.col("_target").isNull(), "unknown-key")
        .when(empty_payload("payload"), "empty-result")
        .when(unknown, "unknown-key")
        .otherwise("applied")
    )
    report = N.self_report("text")
    return rows.select(
        "agent_id",
        "source",
        F.coalesce("_target", "_named").alias("item_id"),
        bucket.alias("bucket"),
        "payload",
        report["n"].alias("n"),
        report["m"].alias("m"),
    )


def applied(found: DataFrame) -> DataFrame:
    """The last applied reply of each item, by source."""
    return last_wins(found.where(F.col("bucket") == "applied").select("item_id", "source", "agent_id", "payload"), "item_id", "source")


def reject_counts(found: DataFrame) -> DataFrame:
    """A count per bucket, zero ones included, in one pass."""
    counted = found.agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in K.BUCKETS))
    entries = F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(f"`{b}`").alias("n")) for b in K.BUCKETS))
    return counted.select(F.explode(entries).alias("e")).select("e.bucket", "e.n")


def normalize(values: DataFrame, maps: DataFrame) -> DataFrame:
    """(id, field, value) with mapped values replaced and dropped fields left out; ``changed`` says what was done.

    ``maps`` is (field, old, new); a null ``new`` drops the field.
    """
    m = maps.select("field", F.col("old").alias("value"), "new", F.lit(True).alias("_hit"))
    joined = values.join(m, ["field", "value"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.where(~(hit & F.col("new").isNull())).select(
        "id", "field", F.when(hit, F.col("new")).otherwise(F.col("value")).alias("value"), hit.alias("changed")
    )


def lookup(worklist: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The item of each wanted id, of repeated ones the last; unknown ids have nulls."""
    last = F.max_by(F.struct(*[c for c in worklist.columns if c != key]), F.col("ordinal"))
    index = worklist.groupBy(key).agg(last.alias("item"))
    return ids.select(key).distinct().join(index, key, "left").select(key, "item.*")


def worklist_size(worklist: DataFrame, key: str = "id") -> DataFrame:
    """(items, keys): repeated ids count in items, and once in keys."""
    return worklist.agg(F.count(F.lit(1)).alias("items"), F.countDistinct(key).alias("keys"))


def mapped(replies: DataFrame, keymap: DataFrame, item: str = "item_id") -> DataFrame:
    """``replies`` with ``target`` by ``keymap`` (item, target) and ``reason``: unknown-key where it has none."""
    known = keymap.select(F.col(keymap.columns[0]).alias("known_item"), F.col(keymap.columns[1]).alias("target"))
    joined = replies.join(known, replies[item] == known["known_item"], "left").drop("known_item")
    return joined.withColumn("reason", F.when(F.col("target").isNull(), F.lit("unknown-key")))


def lists(rows: DataFrame, group: str, order: str, value: str, size: int = K.LIST_SIZE) -> DataFrame:
    """(group, part, n, values): the values of each group in order of ``order``, in lists of ``size``; only the last is shorter.

    ``order`` is unique in a group.  Places are counted by ranges of the whole order, so a group of any
    size is the work of many tasks, and no row holds more than ``size`` values.
    """
    placed = ordered(rows.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(value).alias("_v")), "_g", "_o")
    first = placed.groupBy(F.col("_g").alias("_h")).agg(F.min("place").alias("_first"))
    part = F.floor((F.col("place") - F.col("_first")) / F.lit(size)).cast("long")
    dealt = placed.join(first, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", part.alias("part"), "_o", "_v")
    packed = dealt.groupBy("_g", "part").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("_o", "_v"))).alias("_l"))
    return packed.select(F.col("_g").alias(group), "part", "n", F.col("_l._v").alias("values"))


def drive_summary(outcomes: DataFrame, item: str = "item", state: str = "state", size: int = K.LIST_SIZE) -> DataFrame:
    """(state, part, n, items): the items of each outcome in order, in lists of at most ``size``."""
    return lists(outcomes, state, item, item, size).withColumnRenamed("values", "items")


def outcome_census(outcomes: DataFrame, group: str, status: str = "status") -> DataFrame:
    """(group, ok, bad): outcomes in and out of the range of success."""
    fine = F.coalesce(ok_range(status), F.lit(False))
    return outcomes.groupBy(group).agg(F.count_if(fine).alias("ok"), F.count_if(~fine).alias("bad"))


def ok_range(status: Column | str) -> Column:
    """Whether a status is a success or a redirect (200 to 399)."""
    return T.col(status).between(200, 399)


def ok_exit(status: Column | str) -> Column:
    """The exit code for a status: 0 in the range of success, else 1."""
    return F.when(ok_range(status), 0).otherwise(1)
