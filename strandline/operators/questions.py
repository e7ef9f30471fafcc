"""Question records of three levels from mined facts; wording by templates, or by a language model as an adapter."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.triples import hash_order


def with_backoff(call: Callable[[str], str | None], tries: int = 5, wait: float = 1.0, cap: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """`call`, tried again after waits that double up to `cap`, with some chance in them; None after the last try."""

    def tried(prompt: str) -> str | None:
        for n in range(tries):
            try:
                return call(prompt)
            except Exception:  # noqa: BLE001  whatever the service raises
                if n + 1 < tries:
                    sleep(min(cap, wait * 2**n) + random.random() * wait)
        return None

    return tried


def worded(records: DataFrame, prompt: str, client: Callable[[str], str | None] | None, fallback: str, out: str = "question") -> DataFrame:
    """records with `out`: the client's text for the prompt column, or without a client the fallback column; failures and texts of five characters or less are dropped."""
    if client is None:
        asked = records.withColumn(out, F.col(fallback))
    else:
        schema = f"{records.schema.simpleString()[7:-1]},{out}:string"

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(**{out: [client(p) for p in batch[prompt]]})

        asked = records.mapInPandas(ask, f"struct<{schema}>")
    return asked.where(F.length(F.trim(out)) > 5)


def count_of_object(s: Column, p: Column) -> Column:
    return F.format_string("SELECT (COUNT(?object) AS ?count) WHERE { wd:%s wdt:%s ?object . }", s, p)


def count_of_star(constraints: Column) -> Column:
    parts = F.transform(constraints, lambda c: F.format_string("?entity wdt:%s wd:%s .", c["p"], c["o"]))
    return F.concat(F.lit("SELECT (COUNT(?entity) AS ?count) WHERE { "), F.concat_ws(" ", parts), F.lit(" }"))


def single_hop(facts: DataFrame) -> DataFrame:
    """Level 1 from (s, p, o, s_label, p_label, o_label): what the object of the only fact of its kind is. Facts without a label of the object are left out."""
    return facts.where(F.col("o_label").isNotNull()).select(
        F.format_string("What is the %s of %s?", F.coalesce("p_label", "p"), F.coalesce("s_label", "s")).alias("question"),
        F.col("o_label").alias("answer"), F.lit(1).alias("level"), F.lit("single_hop").alias("type"),
        F.array(F.array(F.coalesce("s_label", "s"), F.coalesce("p_label", "p"), F.col("o_label"))).alias("reasoning_chain"),
        count_of_object(F.col("s"), F.col("p")).alias("sparql_verification"), F.lit(True).alias("verified_with_sparql"),
    )


def bridge(found: DataFrame) -> DataFrame:
    """Level 2 from (a, p1, b, p2, c) with labels a_label, p1_label, ...: the far end of a bridge, its middle unnamed."""
    return found.select(
        F.format_string("What is the %s of the %s of %s?", F.col("p2_label"), F.col("p1_label"), F.col("a_label")).alias("question"),
        F.col("c_label").alias("answer"), F.lit(2).alias("level"), F.lit("bridge").alias("type"),
        F.array(F.array("a_label", "p1_label", "b_label"), F.array("b_label", "p2_label", "c_label")).alias("reasoning_chain"),
        F.format_string("SELECT (COUNT(?answer) AS ?count) WHERE { wd:%s wdt:%s ?bridge . ?bridge wdt:%s ?answer . }", F.col("a"), F.col("p1"), F.col("p2")).alias("sparql_verification"),
        F.struct(F.col("a_label").alias("start_entity"), F.col("b_label").alias("intermediate_entity"), F.col("c_label").alias("final_entity"), F.lit(1).alias("intermediate_count")).alias("bridge_info"),
    )


def multi_attribute(prefixes: DataFrame, constraints: DataFrame, names: DataFrame) -> DataFrame:
    """(e, question, answer, ..., constraints): level 2 from smallest_prefixes and ordered_constraints: which entity has all of the first k attributes."""
    kept = constraints.join(prefixes, "e").where("i <= k").join(names.toDF("p", "p_label"), "p", "left").join(names.toDF("o", "o_label"), "o", "left")
    one = F.struct("i", "p", "o", F.coalesce("p_label", "p").alias("p_label"), F.coalesce("o_label", "o").alias("o_label"))
    sets = kept.groupBy("e").agg(F.sort_array(F.collect_list(one)).alias("constraints")).join(names.toDF("e", "e_label"), "e", "left")
    has = F.concat_ws(" and ", F.transform("constraints", lambda c: F.concat_ws(" ", F.lit("has"), c["p_label"], c["o_label"])))
    name = F.coalesce("e_label", F.concat(F.lit("Entity_"), F.col("e")))
    return sets.select(
        "e", F.concat(F.lit("Which entity "), has, F.lit("?")).alias("question"), name.alias("answer"), F.lit(2).alias("level"), F.lit("multi_attribute").alias("type"),
        F.transform("constraints", lambda c: F.array(name, c["p_label"], c["o_label"])).alias("reasoning_chain"),
        count_of_star(F.col("constraints")).alias("sparql_verification"), "constraints",
    )


def abstracted(level2: DataFrame, descriptions: DataFrame, by_label: bool = False) -> DataFrame:
    """(e, question, answer, constraint_texts, n_abstract): level 3: the first three constraints with their objects described, where there is a description.

    descriptions = (node, description), several of a node as rows or as an array column `descriptions`; of an array one of the first two is
    picked by a hash. by_label: `node` is a label. Constraints stay structured until here, so labels with a colon do no harm.
    A question needs two constraints before and after.
    """
    part = level2.where(F.size("constraints") >= 2).select("e", "answer", F.posexplode(F.slice("constraints", 1, 3)).alias("i", "c"))
    wanted = F.col("c.o_label" if by_label else "c.o")
    told = part.join(descriptions.withColumnRenamed("node", "_node"), wanted == F.col("_node"), "left")
    if "descriptions" in descriptions.columns:
        told = told.withColumn("_o", F.col("c.o")).withColumn("description", chosen_description(F.col("descriptions"), "e", "_o"))
    plain = F.concat_ws(": ", "c.p_label", "c.o_label")
    hidden = F.format_string("abstract [%s] As [%s: %s]", plain, F.col("c.p_label"), F.col("description"))
    text = F.when(F.col("description").isNotNull(), hidden).otherwise(plain)
    item = F.struct("i", text.alias("t"), F.coalesce("description", "c.o_label").alias("d"), F.col("c.p_label").alias("p"), F.col("description").isNotNull().alias("told"))
    again = told.groupBy("e", "answer").agg(F.sort_array(F.collect_list(item)).alias("parts")).where(F.size("parts") >= 2)
    question = F.concat(F.lit("Which entity "), F.concat_ws(" and ", F.transform("parts", lambda x: F.concat_ws(" ", F.lit("has"), x["p"], x["d"]))), F.lit("?"))
    n = F.size(F.filter("parts", lambda x: x["told"])).cast("long")
    return again.select("e", question.alias("question"), "answer", F.transform("parts", lambda x: x["t"]).alias("constraint_texts"), n.alias("n_abstract"))


def chosen_description(descriptions: Column, *ids: str) -> Column:
    """One of the first two descriptions, by a hash of the ids; NULL if there is none."""
    n = F.least(F.lit(2), F.size(descriptions))
    return F.when(n > 0, F.try_element_at(descriptions, (F.conv(F.substring(hash_order(*ids), 1, 4), 16, 10).cast("int") % n + 1).cast("int")))


def abstracted_bridge(found: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(a, p1, b, p2, c, question, answer): level 3 of a bridge with labels: start and middle described, (node, description) given, where there is a description.

    The far end stays the only one: a bridge is single by its nodes, which don't change by the wording.
    """
    start, middle = descriptions.toDF("a", "a_told"), descriptions.toDF("b", "b_told")
    told = found.join(start, "a", "left").join(middle, "b", "left")
    text = F.format_string("What is the %s of %s, the %s of %s?", F.col("p2_label"), F.coalesce("b_told", F.lit("something")), F.col("p1_label"), F.coalesce("a_told", "a_label"))
    return told.select(*[c for c in ("record_id",) if c in found.columns], "a", "p1", "b", "p2", "c", text.alias("question"), F.col("c_label").alias("answer"))


def by_type(records: DataFrame, bridge_form, multi_form) -> DataFrame:
    """The level-3 form of each level-2 record (type, ...): bridges and sets of constraints by their own form, others left out."""
    return bridge_form(records.where(F.col("type") == "bridge")).unionByName(multi_form(records.where(F.col("type") == "multi_attribute")), allowMissingColumns=True)


def level3(records: DataFrame, bridge_form, multi_form, most: int = 200) -> DataFrame:
    """(record_id, type, question, answer): the level-3 questions of level-2 records (record_id, type, ...), taken in hash order of their ids until there are `most`.

    Each form takes the records of its type and gives (record_id, question, answer) of those that it can word.
    """
    form = lambda f: lambda rows: f(rows).select("record_id", "question", "answer")
    worded_ = by_type(records, form(bridge_form), form(multi_form))
    named = worded_.join(records.select("record_id", F.concat(F.lit("abstract_"), F.col("type")).alias("type")), "record_id")
    return named.orderBy(hash_order("record_id"), "record_id").limit(most).select("record_id", "type", "question", "answer")
