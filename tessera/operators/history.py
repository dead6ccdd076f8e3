"""History of changing attributes as insert-only satellites.

A satellite is an append-only log of attributes that change at a like rate: the fast satellite has the
attributes that change at least as often as the median one, the slow satellite the others, each a table of its
own. A row is appended only where the hash-diff of the valid value changes, and a version's end is never
written but read as the ``lead`` of the log, in a view over both satellites. A negation of the valid value
appends a row without hash-diff. A later batch is folded in from each key's last rows (``appended``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scale import carry_last, carry_next, materialize, ordered_chunks

KEYS = ["tenant", "entity_key", "attribute_key"]
ORDER = ["updated_at", "memory_id"]
SATELLITES = ("fast", "slow")


def value_form(value: Column) -> Column:
    """Values that differ only in case, white space and closing ``.,;:!`` get one form."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[\s.,;:!]+$", ""), r"[\s ]+", "")


def hash_diff(value: Column) -> Column:
    """The 16 hex digits by which two values are told apart."""
    return F.substring(F.sha2(value_form(value), 256), 1, 16)


def stated_rows(facts: DataFrame) -> DataFrame:
    """The rows of a fact feed that can change an attribute, each memory_id once, at its earliest.

    Only single_valued rows that are no placeholder count (null flags are false). Of the rows of a
    memory_id the one with the least updated_at stays; at a tie the least by the other columns.
    Rows without memory_id, updated_at or a value change nothing and are left out; null keys form
    groups of their own.
    """
    f = facts.select(
        "memory_id",
        "updated_at",
        *KEYS,
        "value_text",
        F.coalesce(F.col("temporal_state"), F.lit("")).alias("state"),
        F.coalesce(F.col("is_negated"), F.lit(False)).alias("negated"),
        F.coalesce(F.col("single_valued"), F.lit(False)).alias("single"),
        F.coalesce(F.col("is_placeholder"), F.lit(False)).alias("placeholder"),
    ).where("single AND NOT placeholder AND memory_id IS NOT NULL AND updated_at IS NOT NULL")
    first = f.groupBy("memory_id").agg(F.min(F.struct("updated_at", *KEYS, "value_text", "state", "negated")).alias("r"))
    return (
        first.select("memory_id", "r.*")
        .where("value_text IS NOT NULL AND (negated OR state = 'CURRENT')")
        .select("memory_id", "updated_at", *KEYS, "value_text", "negated", hash_diff(F.col("value_text")).alias("diff"))
    )


def _changes(stated: DataFrame) -> DataFrame:
    """The rows of ``stated`` that change an attribute, chunked by key and order; extra columns stay.

    The test against the valid value needs two carries over the key's order (the last stated value;
    the last row that changed something), both taken over ordered chunks, so that a key with a third
    of all rows is worked on by many tasks.
    """
    d = ordered_chunks(stated, KEYS, ORDER)
    d = carry_last(d, KEYS, ORDER, "stated", F.when(~F.col("negated"), F.col("diff")))
    touches = ~F.col("negated") | (F.col("diff") == F.col("stated"))
    d = d.where(F.coalesce(touches, F.lit(False))).drop("stated")
    d = carry_last(d, KEYS, ORDER, "prev", F.struct("negated", "diff"))
    opens = ~F.col("negated") & (F.col("prev").isNull() | F.col("prev.negated") | (F.col("prev.diff") != F.col("diff")))
    ends = F.col("negated") & ~F.col("prev.negated")
    return d.where(F.coalesce(opens | ends, F.lit(False))).withColumn("diff", F.when(~F.col("negated"), F.col("diff"))).drop("prev")


def satellite_log(facts: DataFrame) -> DataFrame:
    """Appended rows only: keys, memory_id, updated_at, value_text, negated, diff (null where a value ended)."""
    return _changes(stated_rows(facts))


def appended(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows that a later batch of the feed appends to ``log``; nothing in the log is changed.

    The batch's rows must come after the log's in each key's order, and a memory_id that was in the feed
    before must not come again. Of the log only each key's last opening and ending are read, by a partial
    aggregate, so its length does not matter. The log with these rows equals the log of the whole feed.
    """
    new = stated_rows(batch).withColumn("old", F.lit(False))
    row = F.struct(*ORDER, "value_text", "diff")
    last = log.join(new.select(*[F.col(k).alias(f"__{k}") for k in KEYS]).distinct(), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS], "left_semi")
    last = last.groupBy(*KEYS).agg(F.max(F.when(~F.col("negated"), row)).alias("o"), F.max(F.when(F.col("negated"), row)).alias("e"))
    opened = last.where("o IS NOT NULL").select("o.memory_id", "o.updated_at", *KEYS, "o.value_text", F.lit(False).alias("negated"), "o.diff", F.lit(True).alias("old"))
    # an ending names the value that was opened last
    ended = last.where("e.updated_at > o.updated_at OR (e.updated_at = o.updated_at AND e.memory_id > o.memory_id)").select("e.memory_id", "e.updated_at", *KEYS, "e.value_text", F.lit(True).alias("negated"), "o.diff", F.lit(True).alias("old"))
    return _changes(new.unionByName(opened).unionByName(ended)).where("NOT old").drop("old")


def change_rates(log: DataFrame) -> DataFrame:
    """(attribute_key, rate, satellite): changes of an attribute for each of its entities, and where it belongs.

    At most one row for each attribute name: a dictionary, joined by Spark's own choice.
    """
    per = log.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).groupBy("attribute_key").agg((F.sum("n") / F.count(F.lit(1)) - 1).alias("rate"))
    per = materialize(per)
    middle = per.agg(F.percentile("rate", 0.5)).first()[0]
    return per.select("attribute_key", "rate", F.when(F.col("rate") >= F.lit(middle), "fast").otherwise("slow").alias("satellite"))


def satellites(facts: DataFrame) -> dict[str, DataFrame]:
    """The log of each satellite, a table of its own: attributes are split by how often they change."""
    log = materialize(satellite_log(facts))
    rate = change_rates(log).select(F.col("attribute_key").alias("__a"), "satellite")
    split = log.join(rate, F.col("attribute_key").eqNullSafe(F.col("__a"))).drop("__a")
    return {name: materialize(split.where(F.col("satellite") == name).drop("satellite")) for name in SATELLITES}


def periods(log: DataFrame) -> DataFrame:
    """The view over one satellite: each opening with the row that follows it. ``log`` has its chunks."""
    d = carry_next(log, KEYS, ORDER, "next", F.struct("memory_id", "updated_at", "negated"))
    return d.where("diff IS NOT NULL").select(
        *KEYS,
        "value_text",
        F.col("memory_id").alias("opened_by"),
        F.col("updated_at").alias("valid_from"),
        F.coalesce(F.col("next.memory_id"), F.lit(-1).cast("bigint")).alias("closed_by"),
        F.col("next.updated_at").alias("valid_to"),
        F.when(F.col("next").isNotNull(), F.when(F.col("next.negated"), "negated").otherwise("restated")).alias("closed_how"),
    )


def versions(facts: DataFrame) -> DataFrame:
    """Every version of every attribute with the period for which it held.

    Columns: tenant, entity_key, attribute_key, value_text, opened_by, valid_from, closed_by (-1 while
    valid), valid_to (null while valid), closed_how (``restated``, ``negated`` or null), satellite
    (``fast`` or ``slow``). An empty feed gives no row.
    """
    s = satellites(facts)
    fast, slow = (periods(s[n]).withColumn("satellite", F.lit(n)) for n in SATELLITES)
    return fast.unionByName(slow)


def as_of(history: DataFrame, at: str) -> DataFrame:
    """The versions valid at the timestamp literal ``at``: opened at or before it and not yet closed."""
    t = F.lit(at).cast("timestamp")
    return history.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
