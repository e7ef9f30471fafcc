"""History of changing attributes: the periods in which each value of a key was valid, by presence bitmaps.

Every change of a key observes the key twice: before (its old value) and after (its new value). Between change
j - 1 and change j of a key lies interval j, with the two observations `after j - 1` (bit 2j) and `before j`
(bit 2j + 1). For each key and value one bit is set per observation that saw the value, in words of 64 bits, so
an interval never crosses a word. A run of set bits, cut at the changes, is a version:

* both bits: valid from change j - 1 to change j;
* bit 2j only: valid from change j - 1, its end `unknown`, or `open` after the last change;
* bit 2j + 1 only: valid from `unknown` to change j.

Lost changes are gaps between runs and need no case of their own.

Keys with very many changes are cut into pieces along time (`feed.heavy_keys`); the intervals between the pieces
form a bitmap of their own, over one observation per end of a piece. No task gathers a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.instants import iso_text
from strandline.operators.feed import HEAVY_ROWS, heavy_keys, is_value, normal_changes

KEY = ("entity_id", "property_id")


def presence_runs(observations: DataFrame) -> DataFrame:
    """Versions of (entity_id, property_id, piece, value, slot, at, last): last marks an observation after the last change."""
    bitmaps = observations.groupBy(*KEY, "piece", "value", F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"),
        F.map_from_entries(F.collect_list(F.struct((F.col("slot").bitwiseAND(63)).alias("bit"), "at"))).alias("seen"),
        F.bool_or("last").alias("last"),
        F.max("slot").bitwiseAND(63).alias("top"),
    )
    runs = bitmaps.withColumn(
        "run", F.explode(F.expr("filter(sequence(0, 62, 2), b -> (shiftrightunsigned(bits, b) & 3L) <> 0)"))
    )
    start, end = F.try_element_at("seen", F.col("run")), F.try_element_at("seen", F.col("run") + 1)
    is_open = F.col("last") & (F.col("run") == F.col("top"))
    return runs.select(
        *KEY,
        "piece",
        F.col("value").alias("version_value"),
        F.coalesce(iso_text(start), F.lit("unknown")).alias("valid_from"),
        F.when(end.isNotNull(), iso_text(end)).when(is_open, "open").otherwise("unknown").alias("valid_to"),
    ).dropDuplicates()


def attribute_history(changes: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(entity_id, property_id, version_value, valid_from, valid_to): every value that a key held, and its period.

    Changes of a key are ordered by instant, then revid. Copies of a change (same key, revid and instant) count once, the
    first delivered is taken. A change without a readable instant has no place in time and starts or ends no version.
    NULL values and sentinels are no versions; NULL keys are keys like others. Empty input gives an empty result;
    further columns of the input are ignored. Versions of no length are kept, equal rows appear once.
    """
    feed = normal_changes(changes).drop("kind").where(F.col("at").isNotNull())
    heavy = heavy_keys(feed, KEY, "at", heavy_rows)
    cut = heavy.cut(feed, "at")
    order = Window.partitionBy(*KEY, "piece").orderBy("at", "revid", "feed_pos")
    copy = F.lag("revid").over(order).eqNullSafe(F.col("revid")) & F.lag("at").over(order).eqNullSafe(F.col("at"))
    numbered = cut.withColumn("copy", copy).where(~F.col("copy")).withColumns(
        {"j": F.row_number().over(order).cast("long") - 1, "final": F.lead(F.lit(1)).over(order).isNull()}
    )
    inner = (
        numbered.select(
            *KEY, "piece", "heavy", "at", "final",
            F.inline(F.array(
                F.struct(F.col("old_value").alias("value"), (F.col("j") * 2 + 1).alias("slot"), F.lit(False).alias("after")),
                F.struct(F.col("new_value").alias("value"), (F.col("j") * 2 + 2).alias("slot"), F.lit(True).alias("after")),
            )),
        )
        .where(is_value(F.col("value")))
        .where(~F.col("heavy") | ~((F.col("final") & F.col("after")) | (F.col("slot") == 1)))
        .select(*KEY, "piece", "value", "slot", "at", (F.col("final") & F.col("after")).alias("last"))
    )
    versions = presence_runs(inner)
    if heavy.count:
        versions = versions.unionByName(presence_runs(_between_pieces(heavy.only(cut))))
    return versions.drop("piece")


def _between_pieces(cut: DataFrame) -> DataFrame:
    """Observations at the ends of the pieces of heavy keys; piece k's first change is `before`, its last one `after`."""
    first = F.struct("at", "revid", "feed_pos")
    last = F.struct("at", "revid", (-F.col("feed_pos")).alias("undelivered"))
    ends = cut.groupBy(*KEY, "piece").agg(
        F.min_by(F.struct("old_value", "at"), first).alias("head"), F.max_by(F.struct("new_value", "at"), last).alias("tail")
    )
    along = Window.partitionBy(*KEY).orderBy("piece")  # as many rows as a key has pieces
    placed = ends.withColumns({"k": F.row_number().over(along).cast("long") - 1, "final": F.lead(F.lit(1)).over(along).isNull()})
    return placed.select(
        *KEY,
        F.inline(F.array(
            F.struct(F.lit(-1).alias("piece"), F.col("head.old_value").alias("value"), (F.col("k") * 2 + 1).alias("slot"), F.col("head.at").alias("at"), F.lit(False).alias("last")),
            F.struct(F.lit(-1).alias("piece"), F.col("tail.new_value").alias("value"), (F.col("k") * 2 + 2).alias("slot"), F.col("tail.at").alias("at"), F.col("final").alias("last")),
        )),
    ).where(is_value(F.col("value")))
