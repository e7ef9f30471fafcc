"""The change feed of a knowledge graph: readable instants, plain change types, heavy keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.instants import instant_micros
from strandline.session import scratch_path

#: In-band marks of the feed that stand for no value.
SENTINELS = ("NEW_CREATED", "NO_VALUE", "SOME_VALUE")

#: A key with more rows than this is cut into pieces.
HEAVY_ROWS = 50_000
PIECES = 128


def normal_changes(changes: DataFrame) -> DataFrame:
    """(entity_id, property_id, revid, at, old_value, new_value, kind, feed_pos); at = microseconds, NULL if unreadable.

    kind is change_type without case and blanks. Columns beyond those of the feed are left out.
    """
    return changes.select(
        "entity_id",
        "property_id",
        "revid",
        instant_micros(F.col("change_timestamp")).alias("at"),
        "old_value",
        "new_value",
        F.lower(F.trim("change_type")).alias("kind"),
        "feed_pos",
    )


def is_value(value: Column) -> Column:
    return value.isNotNull() & ~value.isin(*SENTINELS)


@dataclass(frozen=True)
class HeavyKeys:
    """Cut points of the heavy keys, in a table in the shared folder: Spark broadcasts it if its size allows, and joins by a shuffle if not."""

    table: DataFrame | None
    keys: tuple[str, ...]
    count: int

    def _join(self, df: DataFrame, table: DataFrame, how: str) -> DataFrame:
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys])  # NULL keys are keys
        return df.join(table.withColumnsRenamed({k: f"_{k}" for k in self.keys}), same, how)

    def cut(self, df: DataFrame, order: str) -> DataFrame:
        """df with `piece`: 0, or for a heavy key the number of its cut points up to `order`; and `heavy`."""
        if not self.count:
            return df.withColumns({"piece": F.lit(0), "heavy": F.lit(False)})
        marked = self._join(df, self.table, "left").drop(*[f"_{k}" for k in self.keys])
        below = F.size(F.filter("cuts", lambda c: c <= F.col(order)))
        return marked.withColumns(
            {"piece": F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(below), "heavy": F.col("cuts").isNotNull()}
        ).drop("cuts")

    def only(self, df: DataFrame) -> DataFrame:
        """The rows of the heavy keys."""
        return self._join(df, self.table.select(*self.keys), "left_semi")


def heavy_keys(df: DataFrame, keys: tuple[str, ...], order: str, heavy_rows: int = HEAVY_ROWS, pieces: int = PIECES) -> HeavyKeys:
    """All keys with more than heavy_rows rows, and points that cut each into pieces along `order`.

    All rows are counted (combined before the shuffle); nothing but the number of heavy keys comes to the driver.
    """
    spark = df.sparkSession
    none = HeavyKeys(None, keys, 0)
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_rows)
    path = scratch_path(spark, "heavy")
    many.drop("n").write.parquet(f"{path}/keys")
    named = spark.read.schema(df.select(*keys).schema).parquet(f"{path}/keys")
    if not named.head(1):
        return none
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    rows = HeavyKeys(named, keys, 1).only(df).groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, shares, F.lit(10_000))).alias("cuts"))
    rows.write.parquet(f"{path}/cuts")
    cuts = spark.read.schema(rows.schema).parquet(f"{path}/cuts")
    return HeavyKeys(cuts, keys, cuts.count())
