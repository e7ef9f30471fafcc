"""Facts with exactly one answer, bridges of two facts, and smallest sets of constraints that single out an entity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.triples import hash_order

#: Pairs of predicates that lead back where they came from.
SEQUENCE = ("P155", "P156", "P1365", "P1366")
INVERSE = (("P155", "P156"), ("P1365", "P1366"), ("P527", "P361"), ("P749", "P355"), ("P276", "P131"))
#: The predicates that extend an entity's attributes.
EXTENDING = (
    "P27", "P19", "P20", "P106", "P31", "P136", "P495", "P37", "P36", "P17", "P131", "P276", "P57",
    "P50", "P175", "P364", "P407", "P840", "P159", "P937", "P108", "P69", "P463", "P102", "P641",
)


def predicate_sizes(triples: DataFrame) -> DataFrame:
    """(predicate_id, n), largest first, ties by id."""
    return triples.groupBy("predicate_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "predicate_id")


def single_valued(graph: DataFrame) -> DataFrame:
    """(s, p, o): the facts (each there once) whose subject and predicate have no other object."""
    return graph.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o")).where(F.col("n") == 1).select("s", "p", "o")


def stratified(graph: DataFrame, total: int) -> DataFrame:
    """(s, p, o, place): of each predicate as many single-valued facts as its share of `total`, one at least, in hash order; `total` in all at most, by place."""
    quota = graph.agg(F.greatest(F.lit(1), F.floor(F.lit(total) / F.greatest(F.lit(1), F.count_distinct("p")))).alias("quota"))
    order = hash_order("s", "p", "o")
    ranked = single_valued(graph).withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy(order, "s")).cast("long"))
    return ranked.join(F.broadcast(quota), F.col("place") <= F.col("quota")).drop("quota").orderBy("place", "p").limit(total)


def verified(candidates: DataFrame, graph: DataFrame, target: int | None = None) -> DataFrame:
    """The candidates (s, p, ...) whose question has exactly one answer in the graph; the first `target` by place and predicate."""
    ones = graph.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("s", "p")
    kept = candidates.join(ones, ["s", "p"], "left_semi")
    return kept.orderBy("place", "p").limit(target) if target else kept


def greedy_stratified(graph: DataFrame, total: int) -> DataFrame:
    """stratified(), where a node taken for an earlier (larger) predicate, as subject or object, is no subject for a later one.

    Predicates are taken one after the other, in one task and over ids only. No more than 2 * total nodes are ever taken, so the
    first 3 * total facts of each predicate are enough for an exact choice; the result is at most `total` rows.
    """
    sizes = graph.groupBy("p").agg(F.count(F.lit(1)).alias("size"))
    quota = graph.agg(F.greatest(F.lit(1), F.floor(F.lit(total) / F.greatest(F.lit(1), F.count_distinct("p")))).alias("quota")).withColumn("one", F.lit(0))  # of all predicates, as in stratified()
    order = hash_order("s", "p", "o")
    pool = single_valued(graph).withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy(order, "s")).cast("long"))
    pool = pool.where(F.col("place") <= 3 * total).join(sizes, "p").withColumn("one", F.lit(0)).join(F.broadcast(quota), "one").select("one", "s", "p", "o", "place", "size", "quota")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "p", "place"], ascending=[False, True, True])
        used: set[str] = set()
        taken, many = [], 0
        for _, group in rows.groupby("p", sort=False):
            if many >= total:
                break
            free = group[~group["s"].isin(used)].head(int(group["quota"].iloc[0]))
            taken.append(free)
            many += len(free)
            used |= set(free["s"]) | set(free["o"])
        return pd.concat(taken).head(total)[["s", "p", "o", "place"]] if taken else rows[["s", "p", "o", "place"]]

    return pool.groupBy("one").applyInPandas(choose, "s string, p string, o string, place bigint")


def down_sample(rows: DataFrame, most: int, *ids: str) -> DataFrame:
    """The first `most` rows in hash order of their ids: a reproducible random sample."""
    return rows.orderBy(hash_order(*ids), *ids).limit(most)


def bridges(graph: DataFrame) -> DataFrame:
    """(a, p1, b, p2, c): two facts a-p1-b, b-p2-c where b is the only node between a and c by these predicates.

    Nodes between are counted before b = a and b = c are left out; a and c differ. Pairs of predicates that lead back are left out
    before the join, so they cost nothing. The paths through a hub are as many as its facts in times its facts out, and are results for the
    most part; Spark splits the join at a hub by its size (AQE).
    """
    t1 = graph.select(F.col("s").alias("a"), F.col("p").alias("p1"), F.col("o").alias("b"))
    t2 = graph.select(F.col("s").alias("b"), F.col("p").alias("p2"), F.col("o").alias("c"))
    inverse = F.lit(False)
    for x, y in INVERSE:
        inverse = inverse | ((F.col("p1") == x) & (F.col("p2") == y)) | ((F.col("p1") == y) & (F.col("p2") == x))
    sense = ~(F.col("p1").isin(*SEQUENCE) & F.col("p2").isin(*SEQUENCE)) & ~inverse
    paths = t1.join(t2, "b").where(F.col("a") != F.col("c")).where(sense)
    one = paths.groupBy("a", "p1", "p2", "c").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n = 1")
    return one.where((F.col("b") != F.col("a")) & (F.col("b") != F.col("c"))).select("a", "p1", "b", "p2", "c")


def single_paths(graph: DataFrame) -> DataFrame:
    """(a, p1, p2, c): where following p1 and then p2 from a gives exactly one solution: ?b with one end ?c over all paths.

    Counted from the facts of each b and p2 before the join, so that a hub's facts aren't multiplied.
    """
    out = graph.groupBy(F.col("s").alias("b"), F.col("p").alias("p2")).agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("c"))
    t1 = graph.select(F.col("s").alias("a"), F.col("p").alias("p1"), F.col("o").alias("b"))
    paths = t1.join(out, "b").groupBy("a", "p1", "p2").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    return paths.where("n = 1").select("a", "p1", "p2", "c")


def greedy_bridges(found: DataFrame, most: int, pool: int = 20_000) -> DataFrame:
    """Up to `most` bridges in hash order, no node of which is in another one taken.

    The driver sees at most `pool` bridges at a time, and of those after the last one only such as touch no node taken so far; every
    round takes one at least, so there are at most `most` rounds, as a rule one.
    """
    ordered = found.withColumn("k", hash_order("a", "p1", "b", "p2", "c"))
    used: set[str] = set()
    taken, after = [], ""
    while len(taken) < most:
        free = ordered.where(F.col("k") > after)
        if used:
            free = free.where(~(F.col("a").isin(*used) | F.col("b").isin(*used) | F.col("c").isin(*used)))
        rows = free.orderBy("k").limit(pool).collect()
        for row in rows:
            if len(taken) < most and not {row.a, row.b, row.c} & used:
                used |= {row.a, row.b, row.c}
                taken.append(tuple(row)[:5])
        if len(rows) < pool:
            break
        after = rows[-1].k
    return found.sparkSession.createDataFrame(taken, found.schema)


def ordered_constraints(graph: DataFrame, most: int = 5, least: int = 3, rows: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(e, i, p, o): the distinct attributes of entities with at least `least` of them, numbered in hash order, the first `most`.

    With rows (subject_id, n), as triples.degrees() has them, repeated rows count for `least`.
    """
    facts = graph.toDF("e", "p", "o")
    if rows is not None:
        facts = facts.join(rows.where(F.col("n") >= least).select(F.col("subject_id").alias("e")), "e", "left_semi")
    w = Window.partitionBy("e").orderBy(hash_order("e", "p", "o", seed=seed), "p", "o")
    numbered = facts.withColumns({"i": F.row_number().over(w).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy("e"))})
    kept = numbered if rows is not None else numbered.where(F.col("n") >= least)
    return kept.where(F.col("i") <= most).select("e", "i", "p", "o")


def smallest_prefixes(graph: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(e, k): the smallest k >= 2 for which the first k attributes of e fit no other entity.

    Every prefix holds the first two attributes, so the entities to compare are those that share the rarer of the two, not those of every
    attribute; a hub value multiplies rows only where both are hubs. An entity always fits its own attributes, so a count of
    one means itself. `own` (e, i, p, o) are the entities' constraints, as ordered_constraints() gives them, of this graph or a part of it.
    """
    own = ordered_constraints(graph) if own is None else own
    fans = graph.groupBy("p", "o").agg(F.count(F.lit(1)).alias("fan"))
    rarer = own.where("i <= 2").join(fans, ["p", "o"]).groupBy("e").agg(F.min_by(F.struct("p", "o"), F.struct("fan", "i")).alias("r"), F.max("i").alias("m")).where("m = 2")
    others = rarer.select("e", "r.p", "r.o").join(graph.withColumnRenamed("s", "other"), ["p", "o"]).select("e", "other")
    fits = own.join(others, "e").join(graph.select(F.col("s").alias("other"), "p", "o"), ["other", "p", "o"])
    # A candidate fits the first k attributes if it has those numbered 1 to k: the longest unbroken run from 1.
    runs = fits.groupBy("e", "other").agg(F.sort_array(F.collect_set("i")).alias("has"))
    length = F.aggregate("has", F.lit(0).cast("long"), lambda run, i: F.when(i == run + 1, i).otherwise(run))
    reach = runs.select("e", length.alias("run")).where("run >= 2").groupBy("e", "run").agg(F.count(F.lit(1)).alias("n"))
    # As many fit k attributes as have a run of k or more.
    upward = Window.partitionBy("e").orderBy(F.col("run").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = reach.withColumn("fit", F.sum("n").over(upward)).withColumn("next_run", F.lead("run").over(Window.partitionBy("e").orderBy(F.col("run").desc())))
    # With one fitting at run r, the smallest k is one more than the longest run of any other, and 2 at least.
    return counted.where("fit = 1").select("e", F.greatest(F.lit(2).cast("long"), F.coalesce(F.col("next_run") + 1, F.lit(2).cast("long"))).alias("k"))


def extended_prefixes(graph: DataFrame, own: DataFrame, more: DataFrame, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """((e, k), (e, i, p, o)): smallest_prefixes() over own attributes (s, p, o) and further ones together, in a new hash order, k = 2 to `most`; and the constraints.

    Only entities that gain an attribute are tried. A prefix counts only if the entity itself has all of it in the graph, so those from the first
    attribute on that the graph lacks are left out; a prefix that fits nobody is passed over.
    """
    gaining = more.select("s").distinct()
    together = own.select("s", "p", "o").join(gaining, "s", "left_semi").unionByName(more.select("s", "p", "o")).distinct()
    ordered = ordered_constraints(together, most, 2, seed=43)
    there = graph.select(F.col("s").alias("e"), "p", "o", F.lit(True).alias("there"))
    marked = ordered.join(there, ["e", "p", "o"], "left")
    held = F.min(F.when(F.col("there").isNull(), F.col("i"))).over(Window.partitionBy("e"))
    kept = marked.withColumn("missing", held).where(F.col("missing").isNull() | (F.col("i") < F.col("missing"))).select("e", "i", "p", "o")
    return smallest_prefixes(graph, kept), kept


def constrained_entities(graph: DataFrame, own: DataFrame, rows: DataFrame, more: DataFrame, most: int | None = None) -> DataFrame:
    """(e, k, extended): entities with a smallest set of constraints, by their own attributes or, failing that, by extended ones; the first `most` in hash order."""
    first = smallest_prefixes(graph, ordered_constraints(own, rows=rows)).withColumn("extended", F.lit(False))
    enough = rows.select(F.col("subject_id").alias("s"))
    rest = own.join(enough, "s", "left_semi").join(first.select(F.col("e").alias("s")), "s", "left_anti")
    second, _ = extended_prefixes(graph, rest, more.join(rest.select("s").distinct(), "s", "left_semi"))
    found = first.unionByName(second.withColumn("extended", F.lit(True)))
    return found.orderBy(hash_order("e"), "e").limit(most) if most else found


def extensions(triples: DataFrame, names: DataFrame, allowed: tuple[str, ...] = EXTENDING, own: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(s, p, o, p_label, o_label): further attributes of each entity: allowed predicates that `own` (s, p) lacks, `most` of each entity.

    Values have to be items with a label; the first are taken in order of ids.
    """
    facts = triples.where(F.col("p").isin(*allowed) & F.col("p").startswith("P") & F.col("o").startswith("Q"))
    if own is not None:
        facts = facts.join(own.select("s", "p").distinct(), ["s", "p"], "left_anti")
    first = facts.withColumn("_r", F.row_number().over(Window.partitionBy("s").orderBy("p", "o"))).where(F.col("_r") <= most).drop("_r")
    p, o = names.toDF("p", "p_label"), names.toDF("o", "o_label")
    return first.join(o, "o").join(p, "p", "left").select("s", "p", "o", F.coalesce("p_label", "p").alias("p_label"), "o_label")


def entities_fitting(graph: DataFrame, constraints: list[tuple[str, str]]) -> DataFrame:
    """(e): the entities that have all (p, o) of a list; repeated constraints count once."""
    wanted = sorted(set(constraints))
    fits = F.lit(False)
    for p, o in wanted:
        fits = fits | ((F.col("p") == p) & (F.col("o") == o))
    return graph.where(fits).groupBy(F.col("s").alias("e")).agg(F.count_distinct("p", "o").alias("n")).where(F.col("n") == len(wanted)).select("e")
