"""The triple relation: triples from changes, the set of facts, label dimension, neighbourhoods, deterministic order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = ("subject_id", "subject_label", "predicate_id", "predicate_label", "object_id", "object_label")


def hash_order(*ids: str, seed: int = 42) -> Column:
    """A reproducible stand-in for a random order: md5 of the ids and the seed, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def changes_to_triples(changes: DataFrame) -> DataFrame:
    """The item-valued changes as triples; deletions and literals have no item as new value."""
    return changes.where(F.col("new_value").startswith("Q")).select(
        F.col("entity_id").alias("subject_id"),
        F.col("entity_label").alias("subject_label"),
        F.col("property_id").alias("predicate_id"),
        F.col("property_label").alias("predicate_label"),
        F.col("new_value").alias("object_id"),
        F.col("new_value_label").alias("object_label"),
    )


def facts(*triples: DataFrame) -> DataFrame:
    """(s, p, o): the distinct facts of the relations, a graph in the sense of sets. Rows without an id are none."""
    together = triples[0].select("subject_id", "predicate_id", "object_id")
    for more in triples[1:]:
        together = together.unionAll(more.select("subject_id", "predicate_id", "object_id"))
    return together.toDF("s", "p", "o").dropna().distinct()


def labels(*triples: DataFrame) -> DataFrame:
    """(id, label): one label per node and predicate, the smallest that isn't the id itself; a node without one isn't listed."""
    parts = []
    for t in triples:
        for kind in ("subject", "predicate", "object"):
            parts.append(t.select(F.col(f"{kind}_id").alias("id"), F.col(f"{kind}_label").alias("label")))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionAll(part)
    return together.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.col("label") != F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))


def with_label(df: DataFrame, id_column: str, label_column: str, names: DataFrame, fallback: Column | None = None) -> DataFrame:
    """df with the label of an id; without one, `fallback`, or the id itself."""
    known = names.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    given = fallback if fallback is not None else F.col(id_column)
    return df.join(known, F.col(id_column) == F.col("_id"), "left").withColumn(label_column, F.coalesce("_label", given)).drop("_id", "_label")


def find_by_label(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, id) of wanted (label): of the first triple, in order of ids, with the label as subject or object; the subject first."""
    sides = []
    for side, kind in enumerate(("subject", "object")):
        sides.append(
            triples.select(
                F.col(f"{kind}_label").alias("label"),
                F.struct("subject_id", "predicate_id", "object_id", F.lit(side).alias("side")).alias("pos"),
                F.col(f"{kind}_id").alias("id"),
            )
        )
    return sides[0].unionAll(sides[1]).join(wanted.select("label").distinct(), "label").groupBy("label").agg(F.min_by("id", "pos").alias("id"))


def degrees(triples: DataFrame, least: int = 3) -> DataFrame:
    """(subject_id, n): subjects with at least `least` rows, repeated rows counted."""
    return triples.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def neighbourhood(graph: DataFrame, per_side: int = 5) -> DataFrame:
    """(node, side, place, p, other): the first facts of every node as subject and as object, in order of ids.

    The rank is taken per node and predicate first, so that a node of many facts spreads over its predicates.
    """
    both = graph.select(F.col("s").alias("node"), F.lit("subject").alias("side"), "p", F.col("o").alias("other")).unionAll(
        graph.select(F.col("o"), F.lit("object"), "p", F.col("s"))
    )
    local = Window.partitionBy("node", "side", "p").orderBy("other")
    whole = Window.partitionBy("node", "side").orderBy("p", "other")
    few = both.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= per_side).drop("_r")
    return few.withColumn("place", F.row_number().over(whole).cast("long")).where(F.col("place") <= per_side)
