"""Per-key results under heavy skew, by value-frequency compression.

Rows are grouped by key and value before they are grouped by key: a hot key's rows spread over its values, the counts
are combined before the shuffle, and the exact statistic comes from weighted values. A median is narrowed down by weights
per day, then per second of the day it falls in, then per value of that second: the window of a key runs over its days, over at most
86,400 seconds and over the changes of one second, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.feed import normal_changes

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Stands in for an unreadable instant: before every other one.
NEVER = -(1 << 62)


def distinct_changes(changes: DataFrame) -> DataFrame:
    """(entity_id, property_id, revid, at): one row per change; at is the earliest of its copies', NEVER if unreadable."""
    feed = normal_changes(changes)
    return feed.groupBy("entity_id", "property_id", "revid").agg(F.coalesce(F.min("at"), F.lit(NEVER)).alias("at"))


def weighted_values(changes: DataFrame, fields: tuple[str, ...] = ("entity_id", "property_id")) -> DataFrame:
    """(field, key_id, at, revid, w): how many changes of each key have the value (at, revid)."""
    return (
        distinct_changes(changes)
        .select("at", "revid", F.inline(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(f).alias("key_id")) for i, f in enumerate(fields)])))
        .groupBy("field", "key_id", "at", "revid")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def key_medians(changes: DataFrame, fields: tuple[str, ...] = ("entity_id", "property_id")) -> DataFrame:
    """(key_field, key_id, n_changes, mid_revid): per key the number n of its changes and the revid at place ceil(n / 2).

    Order is by instant, then revid; copies count once. A NULL key is a key; a change with an unreadable instant comes
    first in order; a NULL revid comes before others. Empty input gives an empty result. Other columns are ignored.
    """
    values = weighted_values(changes, fields).withColumns({"day": F.floor(F.col("at") / F.lit(DAY)), "second": F.floor(F.col("at") / F.lit(SECOND))})
    days = values.groupBy("field", "key_id", "day").agg(F.sum("w").alias("w"))
    sized = days.withColumn("n", F.sum("w").over(Window.partitionBy("field", "key_id")))
    day = _reached(sized.withColumn("place", F.ceil(F.col("n") / F.lit(2)).cast("long")), ["field", "key_id"], ["day"])
    in_day = _inside(values, day, ["field", "key_id", "day"])
    seconds = in_day.groupBy("field", "key_id", "second", "n", "place").agg(F.sum("w").alias("w"))
    second = _reached(seconds, ["field", "key_id"], ["second"])
    middle = _reached(_inside(in_day.drop("n", "place"), second, ["field", "key_id", "second"]), ["field", "key_id"], ["at", "revid"])
    names = F.array(*[F.lit(f) for f in fields])
    return middle.select(names[F.col("field")].alias("key_field"), "key_id", F.col("n").alias("n_changes"), F.col("revid").alias("mid_revid"))


def _reached(weights: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the weights of each key, in order, the one in which the running sum reaches `place`; place is then counted within it."""
    upto = F.sum("w").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    reached = weights.withColumn("before", upto - F.col("w")).where((F.col("before") < F.col("place")) & (F.col("before") + F.col("w") >= F.col("place")))
    return reached.withColumn("place", F.col("place") - F.col("before")).drop("before")


def _inside(values: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """The values in each key's target, with its n and place."""
    named = target.select(*[F.col(c).alias(f"t_{c}") for c in on], "n", "place")
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return values.join(named, same).drop(*[f"t_{c}" for c in on])


def key_modes(changes: DataFrame, field: str, value: str) -> DataFrame:
    """(key_id, n_rows, n_distinct, mode_value, mode_rows): exact distinct count and mode of `value` per key of `field`.

    Rows are grouped by key and value first; ties of the mode go to the smallest value. NULL values count as rows only.
    """
    weights = changes.groupBy(F.col(field).alias("key_id"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("w"))
    rank = F.when(F.col("value").isNotNull(), F.col("w"))
    top = weights.groupBy("key_id", rank.alias("rank")).agg(F.sum("w").alias("n"), F.count("value").alias("d"), F.min("value").alias("v"))
    return top.groupBy("key_id").agg(
        F.sum("n").alias("n_rows"),
        F.sum("d").alias("n_distinct"),
        F.max_by("v", "rank").alias("mode_value"),
        F.coalesce(F.max("rank"), F.lit(0).cast("long")).alias("mode_rows"),
    )
