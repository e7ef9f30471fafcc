"""Queries over triples, questions and evaluation records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import evaluate, expand, extract, graph, mining, questions, stats
from strandline.operators import triples as t
from strandline.session import scratch_path
from strandline.sources.tables import table
from strandline.streaming.latest import stream_latest, stream_state

#: Predicates of the test graph that stand for location, country and continent in the optional chain.
STEPS = (("P9336", "P6105"), ("P9336", "P1267"), ("P9336", "P4068"))
STEP_SQL = ("('P9336', 'P6105')", "('P9336', 'P1267')", "('P9336', 'P4068')")
ALLOWED = ("P9336", "P6834", "P4068", "P6616", "P6105", "P93391", "P55842", "P6097", "P6524")


def _all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "triples"), t.changes_to_triples(table(spark, d, "triple_changes"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return t.facts(*_all(spark, d))


def _known(spark: SparkSession, d: str) -> DataFrame:
    return t.facts(table(spark, d, "triples"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return t.labels(*_all(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    names = _labels(spark, d)
    facts = t.with_label(t.with_label(t.with_label(_facts(spark, d), "s", "s_label", names), "p", "p_label", names), "o", "o_label", names, F.lit(None))
    return facts


def changes_classified(spark, d):
    c = table(spark, d, "triple_changes")
    return c.select("feed_pos", extract.change_kind(F.col("old_value"), F.col("new_value")).alias("kind"), F.lower(F.trim("change_type")).alias("given"))


def latest_change(spark, d):
    c = table(spark, d, "triple_changes").select("entity_id", "property_id", "revid", "new_value", "change_timestamp", "feed_pos")
    return extract.latest_per_entity(c).select("entity_id", "property_id", "revid", "new_value")


def top_changes(spark, d):
    c = table(spark, d, "triple_changes").select("entity_id", "property_id", "revid", "new_value", "change_timestamp", "feed_pos")
    return extract.newest_first(extract.latest_per_entity(c), 100).select("entity_id", "property_id", "revid")


def prior_values(spark, d):
    c = extract.previous_values(table(spark, d, "triple_changes"))
    broken = ~F.col("prior_value").eqNullSafe(F.col("old_value"))
    return c.groupBy("property_id").agg(F.count_if(F.col("prior_value").isNull()).alias("n_first"), F.count_if(broken & F.col("prior_value").isNotNull()).alias("n_broken"), F.count(F.lit(1)).alias("n"))


def item_counts(spark, d):
    return mining.predicate_sizes(t.changes_to_triples(table(spark, d, "triple_changes")))


def star_counts(spark, d):
    demo = table(spark, d, "demo")
    return graph.stored_counts(_facts(spark, d), demo, "qa_id", "sparql_verification")


def ask_items(spark, d):
    held = graph.run(_facts(spark, d), "ASK { ?e wdt:P9336 ?x . ?e wdt:P6834 ?y . }").select(F.lit("both").alias("name"), "holds")
    none = graph.run(_facts(spark, d), "ASK { ?e wdt:P9336 wd:Q0 . }").select(F.lit("nothing").alias("name"), "holds")
    return held.unionAll(none)


def filtered_select(spark, d):
    q = graph.parse("SELECT ?e ?p ?v WHERE { ?e ?p ?v . FILTER(?p IN (wdt:P9336, wdt:P6834, wdt:P4068)) FILTER(?p NOT IN (wdt:P4068)) }")
    return graph.run(_facts(spark, d), q)


def optional_select(spark, d):
    q = graph.parse("SELECT ?e ?t ?k WHERE { ?e wdt:P6834|wdt:P4068 ?t . OPTIONAL { ?t wdt:P9336 ?k . } }")
    return graph.run(_facts(spark, d), q)


def extended(spark, d):
    names = _labels(spark, d)
    own = _known(spark, d).select("s", "p")
    facts = t.facts(t.changes_to_triples(table(spark, d, "triple_changes")))
    return mining.extensions(facts, names, ALLOWED, own).select("s", "p", "o", "p_label", "o_label")


def bridge_questions(spark, d):
    return questions.bridge(_bridge_records(spark, d)).select("question", "answer", "sparql_verification")


def level1_questions(spark, d):
    ones = mining.single_valued(_facts(spark, d)).join(_labelled(spark, d), ["s", "p", "o"])
    plain = questions.single_hop(ones).withColumnRenamed("question", "plain")
    return questions.worded(plain, "plain", None, "plain").select("question", "answer", "sparql_verification")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """(subject_id, n): the rows of each subject, repeated ones too."""
    known, changed = _all(spark, d)
    return t.degrees(known.select("subject_id").unionAll(changed.select("subject_id")), 3)


def _constraints(spark, d):
    return mining.ordered_constraints(_facts(spark, d), rows=_rows(spark, d))


def _level2(spark, d):
    own = _constraints(spark, d)
    return questions.multi_attribute(mining.smallest_prefixes(_facts(spark, d), own), own, _labels(spark, d))


def constrained(spark, d):
    """Own attributes are those known before the feed, further ones those of the feed; all are held against the whole graph."""
    known = table(spark, d, "triples")
    more = mining.extensions(t.facts(t.changes_to_triples(table(spark, d, "triple_changes"))), _labels(spark, d), ALLOWED, _known(spark, d).select("s", "p"))
    return mining.constrained_entities(_facts(spark, d), _known(spark, d), t.degrees(known, 3), more, 400)


#: Predicates of the test graph that a description may use.
TOLD = ("P9336", "P6834", "P4068", "P6105", "P6616", "P6097", "P6524", "P12013", "P1267", "P2801")


def _bridge_records(spark, d):
    found, names = mining.bridges(_facts(spark, d)), _labels(spark, d)
    for c in ("a", "p1", "b", "p2", "c"):
        found = t.with_label(found, c, f"{c}_label", names, F.concat(F.lit("Entity_"), F.col(c)))
    return found


def level3_questions(spark, d):
    """Constraints told by the phrase of a fact that points at their object, by the node's id."""
    told = expand.reverse_descriptions(_facts(spark, d), _labels(spark, d), None)
    return questions.abstracted(_level2(spark, d), told).select("e", "question", "answer", F.concat_ws("; ", "constraint_texts").alias("constraints"))


def level3_driver(spark, d):
    """Bridges and sets of constraints in one order, each by its form, with one of the first two direct descriptions of a node, found by its label."""
    told = expand.first_descriptions(expand.direct_attributes(_labelled(spark, d), TOLD))
    node = _labels(spark, d).groupBy("label").agg(F.min("id").alias("node"))
    by_label = told.join(node, "node").select(F.col("label").alias("node"), "descriptions")
    first = told.select("node", F.col("descriptions")[0].alias("description"))
    ids = F.concat_ws("|", F.lit("b"), "a", "p1", "b", "p2", "c")
    bridges = _bridge_records(spark, d).withColumns({"record_id": ids, "type": F.lit("bridge")})
    sets = _level2(spark, d).withColumn("record_id", F.concat_ws("|", F.lit("m"), "e"))
    records = bridges.unionByName(sets, allowMissingColumns=True)
    columns = [c for c in bridges.columns if c != "record_id"]
    bridge_form = lambda r: questions.abstracted_bridge(r.select("record_id", *columns), first)
    multi_form = lambda r: questions.abstracted(r.select("e", "answer", "constraints"), by_label, by_label=True).withColumn("record_id", F.concat_ws("|", F.lit("m"), "e"))
    return questions.level3(records, bridge_form, multi_form, 200)


def extracted_changes(spark, d):
    """The extractor over records, entities and revisions made of the recorded changes: each delivery is an edit with two revisions.

    Every 13th edit is of a page that is no item, every 17th names no property, every 19th has a new revision that can't be read, every 23rd is the first of its page,
    and an entity whose id ends in 7 has no English page.
    """
    c = table(spark, d, "triple_changes")
    pos = F.col("feed_pos")
    comment = F.when(pos % 17 == 0, F.lit("edit")).otherwise(F.concat(F.lit("set [[Property:"), "property_id", F.lit("]] for [[Property:P1]]")))
    records = c.select(F.when(pos % 13 == 0, F.concat(F.lit("Talk:"), "entity_id")).otherwise(F.col("entity_id")).alias("title"), comment.alias("comment"), pos.alias("revid"), F.when(pos % 23 == 0, F.lit(0)).otherwise(-pos).cast("long").alias("old_revid"), F.col("change_timestamp").alias("timestamp"))
    revisions = c.select(pos.alias("revid"), F.when(pos % 19 == 0, F.lit("{broken")).otherwise(_document("new_value")).alias("content")).unionAll(c.select((-pos).alias("revid"), _document("old_value")))
    of = c.groupBy("entity_id", "property_id").agg(F.min("property_type").alias("kind"), F.min("entity_label").alias("label")).groupBy("entity_id").agg(
        F.map_from_entries(F.collect_list(F.struct("property_id", F.array(F.struct(F.struct(F.lit("value").alias("snaktype"), F.col("kind").alias("datatype"), F.lit(None).cast("struct<value: string>").alias("datavalue")).alias("mainsnak")))))).alias("claims"), F.min("label").alias("label")
    )
    english = F.when(~F.col("entity_id").endswith("7"), F.create_map(F.lit("enwiki"), F.struct(F.concat(F.lit("Page of "), "entity_id").alias("title")))).otherwise(F.from_json(F.lit("{}"), "map<string, struct<title: string>>"))
    entities = of.select(F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("missing"), F.when(F.col("label").isNotNull(), F.create_map(F.lit("en"), F.struct(F.col("label").alias("value")))).otherwise(F.from_json(F.lit("{}"), "map<string, struct<value: string>>")).alias("labels"), english.alias("sitelinks"), "claims")
    found = extract.extract_changes(records, entities, revisions, _labels(spark, d))
    return found.select("revid", "entity_id", "entity_label", "property_id", "property_label", "property_type", "old_value", "new_value", "new_value_label", "change_type", "change_timestamp", "wiki_url")


def _document(value: str):
    """A page's JSON text in which the property has the value."""
    v = F.col(value)
    written = (
        F.when(F.col("property_type") == "wikibase-item", F.to_json(F.struct(v.alias("id"))))
        .when(F.col("property_type") == "quantity", F.to_json(F.struct(v.alias("amount"))))
        .when(F.col("property_type") == "time", F.to_json(F.struct(v.alias("time"))))
        .otherwise(F.to_json(F.struct(F.get(F.split(v, ","), F.lit(0)).alias("latitude"), F.get(F.split(v, ","), F.lit(1)).alias("longitude"))))
    )
    kind = F.when(v.isin("NO_VALUE", "NEW_CREATED"), "novalue").when(v == "SOME_VALUE", "somevalue").otherwise("value")
    return F.format_string('{"claims": {"%s": [{"mainsnak": {"snaktype": "%s", "datavalue": {"value": %s}}}, {"mainsnak": {"snaktype": "somevalue"}}]}}', F.col("property_id"), kind, written)


def _as(relations: dict[str, str], wanted: str, names: DataFrame) -> DataFrame:
    """names with the labels of some predicates put in place, for descriptions that go by the label."""
    pairs = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    return names.withColumn("label", F.coalesce(F.try_element_at(pairs, F.col(wanted)), F.col("label")))


#: Labels put in place of those of the test graph's predicates, whose names the descriptions don't know.
RELATIONS = {"P9336": "place of birth", "P6834": "native language", "P4068": "capital", "P6105": "director", "P6616": "occupation", "P1267": "country"}


def told_metaphors(spark, d):
    names = _as(RELATIONS, "id", _labels(spark, d))
    facts = t.with_label(t.with_label(_facts(spark, d), "p", "p_label", names), "o", "o_label", names, F.lit(None))
    return expand.metaphors(expand.direct_attributes(facts, TOLD))


#: Values put in place of labels of the test graph, by the last digit of the node's id.
VALUES = ("Italy", "teacher", "Norway", "film", "University", "album", "Texas", "Museum", "France", "no such thing")


def indirect_told(spark, d):
    value = F.element_at(F.array(*[F.lit(v) for v in VALUES]), F.substring("o", -1, 1).cast("int") + 1)
    rows = _facts(spark, d).where(F.col("p").isin(*RELATIONS)).select("s", "p", "o", F.element_at(F.create_map(*[F.lit(x) for pair in {"P9336": "located in", "P6834": "occupation", "P4068": "genre", "P6105": "country", "P6616": "inception", "P1267": "employer"}.items() for x in pair]), F.col("p")).alias("p_label"), F.when(F.col("p") == "P6616", F.concat(F.lit("19"), F.substring("o", -2, 2), F.lit("-01-01"))).otherwise(value).alias("o_label"))
    return expand.indirect_descriptions(expand.direct_attributes(rows)).select("node", F.concat_ws("; ", "descriptions").alias("told"))


def organisations(spark, d):
    g = _facts(spark, d)
    kinds = F.element_at(F.array(*[F.lit(v) for v in ("Football Club", "national team", "river", "Research Institution", "sports organization", "village", "organization", "bridge", "clubhouse", "person")]), F.substring("id", -1, 1).cast("int") + 1)
    names = g.select(F.col("o").alias("id")).distinct().withColumn("label", kinds)
    return expand.kind_chain(g, names, ("P9336", "P6105"), ("P6834",))


def eras(spark, d):
    c = table(spark, d, "triple_changes").where("property_type = 'time'").select(F.regexp_replace("new_value", r"^\+", "").alias("v"))
    return c.groupBy(expand.era_of_date(F.col("v")).alias("era"), expand.era_of_instant(F.col("v")).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def extracted_values(spark, d):
    c = table(spark, d, "triple_changes")
    return c.select("feed_pos", extract.statement_value(_document("new_value"), F.col("property_id")).alias("value"))


def scored(spark, d):
    return evaluate.score(table(spark, d, "eval_results"))


def accuracy_levels(spark, d):
    joined = scored(spark, d).join(table(spark, d, "demo").select("qa_id", "level", "year"), "qa_id")
    return evaluate.accuracy(joined, "model", "level")


def accuracy_rollup(spark, d):
    joined = scored(spark, d).join(table(spark, d, "demo").select("qa_id", "level"), "qa_id")
    return joined.rollup("model", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("matched").cast("long")).alias("hits"))


def tags(spark, d):
    text = F.concat(F.lit("thinking <search>"), F.coalesce("question", F.lit("")), F.lit("</search> then <answer> "), F.coalesce("answer", F.lit("")), F.lit(" </answer> end"))
    return table(spark, d, "demo").select("qa_id", evaluate.search_query(text).alias("query"), evaluate.tagged_answer(text).alias("answer"), evaluate.asked(F.col("question")).alias("asked"))


def search_lines(spark, d):
    """Of each recorded search: the documents of the result's entity that have most of the query's words."""
    e = table(spark, d, "eval_results").join(table(spark, d, "demo").select("qa_id", F.col("source_triple.subject_id").alias("entity_id")), "qa_id")
    asked = e.select("result_id", "entity_id", F.posexplode(F.filter("reasoning_process", lambda x: x["type"] == "search")).alias("i", "x"))
    wanted = asked.select(F.concat_ws("-", "result_id", "i").alias("query_id"), "entity_id", F.col("x.query").alias("query")).where("entity_id is not null")
    return evaluate.snippets(table(spark, d, "documents"), wanted)


def replayed(spark, d):
    """The recorded traces as turns: a search per recorded query, then the model's answer."""
    e = table(spark, d, "eval_results")
    asks = e.select(F.col("result_id").alias("item_id"), F.posexplode(F.filter("reasoning_process", lambda x: x["type"] == "search")).alias("i", "x"))
    ends = e.select(F.col("result_id").alias("item_id"), (F.size(F.filter(F.coalesce("reasoning_process", F.array().cast(e.schema["reasoning_process"].dataType)), lambda x: x["type"] == "search")) + 1).alias("step"), F.col("model_answer").alias("text"))
    turns = asks.select("item_id", (F.col("i") + 1).alias("step"), F.concat(F.lit("<search>"), F.coalesce("x.query", F.lit("?")), F.lit("</search>")).alias("text")).unionAll(ends)
    return evaluate.replay(turns)


def _pages(spark, d, pages: int = 8) -> tuple[str, object]:
    """The feed as a folder of files in order of arrival, as a stream finds it, and its schema."""
    c = table(spark, d, "triple_changes")
    path = scratch_path(spark, "pages")
    c.repartitionByRange(pages, "feed_pos").write.parquet(path)
    return path, c.schema


def stream_newest(spark, d):
    return stream_latest(spark, *_pages(spark, d), 2).select("entity_id", "property_id", "revid", "new_value")


def stream_current(spark, d):
    return stream_state(spark, *_pages(spark, d), 1, buckets=4).read()


def windowed_changes(spark, d):
    """Changes of the 48 hours before the feed's last instant but one day."""
    c = table(spark, d, "triple_changes").withColumn("timestamp", F.col("change_timestamp"))
    end = F.lit("2025-01-03T00:00:00Z").cast("timestamp")
    return extract.in_window(c, end, 48.0).select("feed_pos", "entity_id", "property_id")


def era_descriptions(spark, d):
    dates = table(spark, d, "triple_changes").where("property_type = 'time'").select(F.col("entity_id").alias("s"), F.col("property_id").alias("p"), F.regexp_replace("new_value", r"^\+", "").alias("o")).distinct()
    return expand.era_chain(dates, None)


def abstract_bridges(spark, d):
    attributes = expand.direct_attributes(_labelled(spark, d)).where("place = 1")
    told = attributes.select("node", F.concat(F.lit("something that "), F.col("description")).alias("description"))
    return questions.abstracted_bridge(_bridge_records(spark, d), told).select("a", "p1", "b", "p2", "c", "question", "answer")


FIELDS = {"subjects": "subject_id", "relations": "predicate_id", "objects": "object_id"}

QUERIES = {
    "changes_classified": changes_classified,
    "latest_change_per_entity": latest_change,
    "top_changes": top_changes,
    "prior_values": prior_values,
    "statement_values": extracted_values,
    "item_counts": item_counts,
    "top_relations": lambda s, d: item_counts(s, d).limit(10),
    "locally_unique_facts": lambda s, d: mining.single_valued(_facts(s, d)),
    "stratified_candidates": lambda s, d: mining.stratified(_facts(s, d), 5000),
    "verified_candidates": lambda s, d: mining.verified(mining.stratified(_known(s, d), 5000), _facts(s, d)),
    "greedy_candidates": lambda s, d: mining.greedy_stratified(_facts(s, d), 5000),
    "sampled_facts": lambda s, d: mining.down_sample(_facts(s, d), 1000, "s", "p", "o"),
    "bridge_paths": lambda s, d: mining.bridges(_facts(s, d)),
    "bridge_single_paths": lambda s, d: mining.single_paths(_facts(s, d)),
    "greedy_bridges": lambda s, d: mining.greedy_bridges(mining.bridges(_facts(s, d)), 50),
    "bridge_questions": bridge_questions,
    "stored_query_counts": star_counts,
    "ask_queries": ask_items,
    "select_filtered": filtered_select,
    "select_optional": optional_select,
    "smallest_constraint_sets": lambda s, d: mining.smallest_prefixes(_facts(s, d), _constraints(s, d)),
    "constrained_entities": constrained,
    "extracted_changes": extracted_changes,
    "windowed_changes": windowed_changes,
    "level3_driver": level3_driver,
    "metaphors": told_metaphors,
    "indirect_descriptions": indirect_told,
    "organisation_descriptions": organisations,
    "verified_target": lambda s, d: mining.verified(mining.stratified(_facts(s, d), 5000), _facts(s, d), 600),
    "attribute_extensions": extended,
    "neighbourhoods": lambda s, d: t.neighbourhood(_facts(s, d)),
    "found_by_label": lambda s, d: t.find_by_label(table(s, d, "triples"), table(s, d, "demo").select(F.col("source_triple.object_label").alias("label")).where("label is not null")),
    "direct_attributes": lambda s, d: expand.direct_attributes(_labelled(s, d)),
    "diverse_properties": lambda s, d: expand.diverse_properties(expand.direct_attributes(_labelled(s, d))),
    "location_descriptions": lambda s, d: expand.location_chain(_facts(s, d), _labels(s, d), STEPS),
    "reverse_descriptions": lambda s, d: expand.reverse_descriptions(_facts(s, d), _labels(s, d), None),
    "era_counts": eras,
    "era_descriptions": era_descriptions,
    "node_expansions": lambda s, d: expand.expansions(expand.direct_attributes(_labelled(s, d))).select("node", F.size("direct_attributes").cast("long").alias("n"), F.concat_ws("; ", "direct_attributes.description").alias("told")),
    "abstract_bridges": abstract_bridges,
    "level1_questions": level1_questions,
    "level2_questions": lambda s, d: _level2(s, d).select("e", "question", "answer", "sparql_verification"),
    "level3_questions": level3_questions,
    "answer_tags": tags,
    "answer_matches": lambda s, d: scored(s, d).select("result_id", "matched", "strict"),
    "accuracy_by_level": accuracy_levels,
    "accuracy_rollup": accuracy_rollup,
    "search_traces": lambda s, d: evaluate.traced_searches(table(s, d, "eval_results")),
    "replayed_turns": replayed,
    "search_snippets": search_lines,
    "corpus_top_values": lambda s, d: stats.value_counts(table(s, d, "triples"), FIELDS),
    "corpus_distinct_counts": lambda s, d: stats.distinct_counts(table(s, d, "triples"), FIELDS),
    "stream_latest_change": stream_newest,
    "stream_current_state": stream_current,
}

_TS = "CAST(change_timestamp AS TIMESTAMPTZ)"
_G = """g AS (SELECT DISTINCT * FROM (
  SELECT subject_id AS s, predicate_id AS p, object_id AS o FROM triples
  UNION ALL SELECT entity_id, property_id, new_value FROM triple_changes WHERE new_value LIKE 'Q%') WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)"""
_KNOWN = "k AS (SELECT DISTINCT subject_id AS s, predicate_id AS p, object_id AS o FROM triples WHERE subject_id IS NOT NULL AND predicate_id IS NOT NULL AND object_id IS NOT NULL)"
_K = _G.replace("g AS (", "k AS (", 1)  # the whole graph under the other name
_N = """n AS (SELECT id, min(label) AS label FROM (
  SELECT subject_id AS id, subject_label AS label FROM triples UNION ALL SELECT predicate_id, predicate_label FROM triples
  UNION ALL SELECT object_id, object_label FROM triples
  UNION ALL SELECT entity_id, entity_label FROM triple_changes WHERE new_value LIKE 'Q%' UNION ALL SELECT property_id, property_label FROM triple_changes WHERE new_value LIKE 'Q%'
  UNION ALL SELECT new_value, new_value_label FROM triple_changes WHERE new_value LIKE 'Q%') WHERE id IS NOT NULL AND label IS NOT NULL AND label <> id GROUP BY id)"""
_ONE = "u AS (SELECT s, p, min(o) AS o FROM {g} GROUP BY s, p HAVING count(*) = 1)"
_STRATA = """q AS (SELECT greatest(1, 5000 // greatest(1, count(DISTINCT p))) AS quota FROM {g}),
  r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY md5(s || '|' || p || '|' || o || '|42'), s) AS place FROM u)"""
_B = """b AS (SELECT a, p1, min(b) AS b, p2, c FROM (
    SELECT x.s AS a, x.p AS p1, x.o AS b, y.p AS p2, y.o AS c FROM k x JOIN k y ON x.o = y.s WHERE x.s <> y.o)
  WHERE NOT (p1 IN ('P155', 'P156', 'P1365', 'P1366') AND p2 IN ('P155', 'P156', 'P1365', 'P1366'))
    AND (least(p1, p2), greatest(p1, p2)) NOT IN (('P155', 'P156'), ('P1365', 'P1366'), ('P361', 'P527'), ('P355', 'P749'), ('P131', 'P276'))
  GROUP BY a, p1, p2, c HAVING count(DISTINCT b) = 1 AND min(b) <> a AND min(b) <> c)"""
def _small(name: str, own: str, graph: str, most: int) -> str:
    """The smallest prefixes of the constraints `own` (e, i, p, o) as `name` (e, k)."""
    return f"""{name}_fit AS (SELECT w.e, x.s AS x, ks.k, count(*) AS m FROM {own} w JOIN {graph} x ON x.p = w.p AND x.o = w.o
    JOIN (SELECT unnest(range(2, {most + 1})) AS k) ks ON w.i <= ks.k GROUP BY ALL),
  {name}_size AS (SELECT e, max(i) AS most FROM {own} GROUP BY e),
  {name} AS (SELECT e, min(k) AS k FROM (SELECT e, k FROM {name}_fit JOIN {name}_size USING (e) WHERE m = k AND k <= most GROUP BY e, k HAVING count(*) = 1) GROUP BY e)"""


_OWN = """deg AS (SELECT s FROM (SELECT subject_id AS s FROM triples UNION ALL SELECT entity_id FROM triple_changes WHERE new_value LIKE 'Q%') GROUP BY s HAVING count(*) >= 3),
  own AS (SELECT e, i, p, o FROM (SELECT s AS e, p, o, row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || p || '|' || o || '|42'), p, o) AS i FROM k JOIN deg USING (s)) WHERE i <= 5),
  """ + _small("small", "own", "k", 5)
_LATEST = f"""SELECT entity_id, property_id, revid, new_value, {_TS} AS at_, feed_pos FROM triple_changes
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_TS} DESC, revid DESC, property_id DESC, feed_pos) = 1"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_FINAL = "(" + _STRIP.format("CASE WHEN instr(model_answer, '<answer>') > 0 AND instr(model_answer, '</answer>') > 0 THEN substr(model_answer, instr(model_answer, '<answer>') + 8, greatest(0, instr(model_answer, '</answer>') - instr(model_answer, '<answer>') - 8)) ELSE model_answer END") + ")"
_SCORED = f"""sc AS (SELECT *, coalesce(contains(lower({_STRIP.format('fin')}), lower({_STRIP.format('expected_answer')})), false) AS matched,
  coalesce({_PLAIN.format('fin')} = {_PLAIN.format('expected_answer')}, false) AS strict FROM (SELECT *, {_FINAL} AS fin FROM eval_results))"""
_ATTR = """attr AS (SELECT s AS node, row_number() OVER (PARTITION BY s ORDER BY g.p, g.o) AS place, coalesce(pl.label, g.p) AS property, ol.label AS value,
    'has ' || coalesce(pl.label, g.p) || ' ' || ol.label AS description
  FROM g JOIN n ol ON ol.id = g.o LEFT JOIN n pl ON pl.id = g.p
  WHERE NOT regexp_full_match(ol.label, 'Q[0-9]+') AND ol.label <> '' AND NOT contains(lower(ol.label), 'http://') AND NOT contains(lower(ol.label), 'https://')
    AND NOT contains(coalesce(pl.label, g.p), 'http://') AND length(ol.label) <= 100 AND length(ol.label) - length(replace(ol.label, '/', '')) <= 1
    AND lower(ol.label) NOT IN ('profession', 'occupation', 'concept', 'category', 'classification', 'type', 'kind', 'form', 'class'))"""


def _phrase_sql() -> str:
    cases = []
    for label, phrase in expand.REVERSE_PHRASES.items():
        said = "lower(sl.label)" if phrase == "lower" else f"sl.label || '{phrase[1:]}'" if phrase.startswith("x ") else f"'{phrase[:-1]}' || sl.label"
        cases.append(f"WHEN pl.label = '{label}' THEN {said}")
    return "CASE " + " ".join(cases) + " END"


_LABELLED = f"""SELECT g.s, g.p, g.o, coalesce(sl.label, g.s) AS s_label, coalesce(pl.label, g.p) AS p_label, ol.label AS o_label
  FROM u g LEFT JOIN n sl ON sl.id = g.s LEFT JOIN n pl ON pl.id = g.p LEFT JOIN n ol ON ol.id = g.o"""
_YEAR = "try_cast(split_part(v, '-', 1) AS INT)"

SQL = {
    "changes_classified": """SELECT feed_pos, CASE WHEN old_value IN ('NEW_CREATED', 'NO_VALUE', 'SOME_VALUE') THEN 'created'
      WHEN new_value IN ('NO_VALUE', 'SOME_VALUE') THEN 'deleted' ELSE 'updated' END AS kind, lower(trim(change_type)) AS given FROM triple_changes""",
    "latest_change_per_entity": f"SELECT entity_id, property_id, revid, new_value FROM ({_LATEST})",
    "top_changes": f"SELECT entity_id, property_id, revid FROM ({_LATEST}) ORDER BY at_ DESC, entity_id LIMIT 100",
    "prior_values": f"""SELECT property_id, count(*) FILTER (prior IS NULL) AS n_first, count(*) FILTER (prior IS NOT NULL AND prior IS DISTINCT FROM old_value) AS n_broken, count(*) AS n FROM (
      SELECT *, lag(new_value) OVER (PARTITION BY entity_id, property_id ORDER BY {_TS}, revid, feed_pos) AS prior FROM triple_changes) GROUP BY 1""",
    "statement_values": "SELECT feed_pos, new_value AS value FROM triple_changes",
    "item_counts": "SELECT property_id AS predicate_id, count(*) AS n FROM triple_changes WHERE new_value LIKE 'Q%' GROUP BY 1",
    "locally_unique_facts": f"WITH {_G}, {_ONE.format(g='g')} SELECT s, p, o FROM u",
    "stratified_candidates": f"WITH {_G}, {_ONE.format(g='g')}, {_STRATA.format(g='g')} SELECT s, p, o, place FROM r, q WHERE place <= quota ORDER BY place, p LIMIT 5000",
    "verified_candidates": f"WITH {_G}, {_KNOWN}, {_ONE.format(g='k')}, {_STRATA.format(g='k')} SELECT s, p, o, place FROM r, q WHERE place <= quota AND (s, p) IN (SELECT (s, p) FROM g GROUP BY s, p HAVING count(*) = 1)",
    "sampled_facts": f"WITH {_G} SELECT s, p, o FROM g ORDER BY md5(s || '|' || p || '|' || o || '|42'), s, p, o LIMIT 1000",
    "bridge_paths": f"WITH {_K}, {_B} SELECT a, p1, b, p2, c FROM b",
    "bridge_single_paths": f"WITH {_K} SELECT x.s AS a, x.p AS p1, y.p AS p2, min(y.o) AS c FROM k x JOIN k y ON x.o = y.s GROUP BY 1, 2, 3 HAVING count(*) = 1",
    "bridge_questions": f"""WITH {_K}, {_N}, {_B}, l AS (SELECT b.*, coalesce(la.label, 'Entity_' || a) AS al, coalesce(l1.label, 'Entity_' || p1) AS l1, coalesce(l2.label, 'Entity_' || p2) AS l2, coalesce(lc.label, 'Entity_' || c) AS cl
      FROM b LEFT JOIN n la ON la.id = a LEFT JOIN n l1 ON l1.id = p1 LEFT JOIN n l2 ON l2.id = p2 LEFT JOIN n lc ON lc.id = c)
      SELECT 'What is the ' || l2 || ' of the ' || l1 || ' of ' || al || '?' AS question, cl AS answer,
        'SELECT (COUNT(?answer) AS ?count) WHERE {{ wd:' || a || ' wdt:' || p1 || ' ?bridge . ?bridge wdt:' || p2 || ' ?answer . }}' AS sparql_verification FROM l""",
    "stored_query_counts": rf"""WITH {_G}, pt AS (SELECT DISTINCT qa_id, regexp_replace(x[1], '^wd:', '') AS s, x[2] AS p, regexp_replace(x[3], '^wd:', '') AS o FROM (
        SELECT qa_id, [regexp_extract(m, '(\?\w+|wd:\w+)\s+wdt:(\w+)\s+(\?\w+|wd:\w+)', 1), regexp_extract(m, '(\?\w+|wd:\w+)\s+wdt:(\w+)\s+(\?\w+|wd:\w+)', 2), regexp_extract(m, '(\?\w+|wd:\w+)\s+wdt:(\w+)\s+(\?\w+|wd:\w+)', 3)] AS x
        FROM (SELECT qa_id, unnest(regexp_extract_all(sparql_verification, '(\?\w+|wd:\w+)\s+wdt:(\w+)\s+(\?\w+|wd:\w+)')) AS m FROM demo))),
      h AS (SELECT qa_id, g.o AS x FROM pt JOIN g ON g.s = pt.s AND g.p = pt.p WHERE starts_with(pt.o, '?') UNION ALL SELECT qa_id, g.s FROM pt JOIN g ON g.o = pt.o AND g.p = pt.p WHERE starts_with(pt.s, '?')),
      f AS (SELECT qa_id, count(*) AS n FROM (SELECT qa_id, x, count(*) AS m FROM h GROUP BY 1, 2) JOIN (SELECT qa_id, count(*) AS m FROM pt GROUP BY 1) USING (qa_id, m) GROUP BY 1)
      SELECT d.qa_id AS id, coalesce(f.n, 0) AS n FROM demo d LEFT JOIN f USING (qa_id)""",
    "ask_queries": f"WITH {_G} SELECT 'both' AS name, EXISTS (SELECT 1 FROM g x JOIN g y USING (s) WHERE x.p = 'P9336' AND y.p = 'P6834') AS holds UNION ALL SELECT 'nothing', EXISTS (SELECT 1 FROM g WHERE p = 'P9336' AND o = 'Q0')",
    "select_filtered": f"WITH {_K} SELECT s AS e, p, o AS v FROM k WHERE p IN ('P9336', 'P6834')",
    "select_optional": f"WITH {_K} SELECT x.s AS e, x.o AS t, y.o AS k FROM k x LEFT JOIN k y ON y.s = x.o AND y.p = 'P9336' WHERE x.p IN ('P6834', 'P4068')",
    "smallest_constraint_sets": f"WITH {_K}, {_OWN} SELECT e, CAST(k AS BIGINT) AS k FROM small",
    "attribute_extensions": f"""WITH {_KNOWN}, {_N}, f AS (SELECT DISTINCT entity_id AS s, property_id AS p, new_value AS o FROM triple_changes WHERE new_value LIKE 'Q%' AND property_id IN {ALLOWED}),
      r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o) AS r FROM f WHERE (s, p) NOT IN (SELECT (s, p) FROM k))
      SELECT s, p, o, coalesce(pl.label, p) AS p_label, ol.label AS o_label FROM r JOIN n ol ON ol.id = o LEFT JOIN n pl ON pl.id = p WHERE r <= 20""",
    "neighbourhoods": f"""WITH {_K} SELECT node, side, p, other, place FROM (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY p, other) AS place FROM (
      SELECT s AS node, 'subject' AS side, p, o AS other FROM k UNION ALL SELECT o, 'object', p, s FROM k)) WHERE place <= 5""",
    "found_by_label": """WITH w AS (SELECT DISTINCT source_triple.object_label AS label FROM demo WHERE source_triple.object_label IS NOT NULL),
      l AS (SELECT subject_label AS label, subject_id AS id, subject_id AS a, predicate_id AS b, object_id AS c, 0 AS side FROM triples UNION ALL SELECT object_label, object_id, subject_id, predicate_id, object_id, 1 FROM triples)
      SELECT label, id FROM l JOIN w USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY a, b, c, side) = 1""",
    "direct_attributes": f"WITH {_G}, {_N}, {_ATTR} SELECT node, place, property, value, description FROM attr",
    "diverse_properties": f"""WITH {_G}, {_N}, {_ATTR}, o AS (SELECT * FROM attr QUALIFY row_number() OVER (PARTITION BY node, description ORDER BY place) = 1),
      b AS (SELECT node, property, value, min(place) OVER (PARTITION BY node, property) AS first FROM o QUALIFY row_number() OVER (PARTITION BY node, property ORDER BY length(value), contains(value, 'Q'), contains(lower(value), 'http'), place) = 1)
      SELECT node, property, value FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY first) <= 5""",
    "location_descriptions": f"""WITH {_K}, {_N}, l AS (SELECT s, o AS l FROM k WHERE p IN {STEP_SQL[0]} QUALIFY row_number() OVER (PARTITION BY s ORDER BY p, o) <= 5),
      x AS (SELECT l.s, coalesce(nl.label, l.l) AS l, coalesce(nc.label, c.o) AS c, coalesce(nk.label, r.o) AS r FROM l LEFT JOIN k c ON c.s = l.l AND c.p IN {STEP_SQL[1]} LEFT JOIN k r ON r.s = c.o AND r.p IN {STEP_SQL[2]}
        LEFT JOIN n nl ON nl.id = l.l LEFT JOIN n nc ON nc.id = c.o LEFT JOIN n nk ON nk.id = r.o)
      SELECT DISTINCT s, CASE WHEN c IS NOT NULL AND l <> c THEN c || ' entity' WHEN r IS NOT NULL THEN r || ' organization' ELSE l || ' based' END AS description FROM x""",
    "reverse_descriptions": f"""WITH {_K}, {_N}, f AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY p, s) AS r FROM k),
      d AS (SELECT f.o AS node, r, {_phrase_sql()} AS description FROM f JOIN n pl ON pl.id = f.p JOIN n sl ON sl.id = f.s WHERE r <= 5 AND length(sl.label) BETWEEN 3 AND 49)
      SELECT node, arg_min(description, r) AS description FROM d WHERE description IS NOT NULL GROUP BY node""",
    "era_counts": f"""SELECT CASE WHEN NOT contains(v, '-') OR {_YEAR} IS NULL THEN NULL WHEN {_YEAR} < 1900 THEN 'pre-industrial era' WHEN {_YEAR} < 1950 THEN 'early 20th century' WHEN {_YEAR} < 2000 THEN 'late 20th century' ELSE 'modern era' END AS era,
      CASE WHEN NOT contains(v, '-') OR {_YEAR} IS NULL THEN NULL WHEN {_YEAR} < 1900 THEN 'pre-modern era' WHEN {_YEAR} < 1950 THEN 'early 20th century' WHEN {_YEAR} < 2000 THEN 'late 20th century' ELSE '21st century' END AS period, count(*) AS n
      FROM (SELECT ltrim(new_value, '+') AS v FROM triple_changes WHERE property_type = 'time') GROUP BY 1, 2""",
    "era_descriptions": f"""SELECT DISTINCT s, CASE WHEN y < 1900 THEN 'pre-modern era' WHEN y < 1950 THEN 'early 20th century' WHEN y < 2000 THEN 'late 20th century' ELSE '21st century' END AS description FROM (
      SELECT s, CASE WHEN contains(v, '-') THEN {_YEAR} END AS y FROM (SELECT s, v FROM (SELECT DISTINCT entity_id AS s, property_id AS p, ltrim(new_value, '+') AS v FROM triple_changes WHERE property_type = 'time')
        QUALIFY row_number() OVER (PARTITION BY s ORDER BY p, v) <= 3)) WHERE y IS NOT NULL""",
    "node_expansions": f"WITH {_G}, {_N}, {_ATTR} SELECT node, count(*) AS n, string_agg(description, '; ' ORDER BY place) AS told FROM attr WHERE place <= 100 GROUP BY node",
    "level1_questions": f"""WITH {_G}, {_N}, {_ONE.format(g='g')} SELECT 'What is the ' || p_label || ' of ' || s_label || '?' AS question, o_label AS answer,
      'SELECT (COUNT(?object) AS ?count) WHERE {{ wd:' || s || ' wdt:' || p || ' ?object . }}' AS sparql_verification FROM ({_LABELLED}) WHERE o_label IS NOT NULL""",
    "level2_questions": f"""WITH {_K}, {_N}, {_OWN}, c AS (SELECT own.e, i, p, o, coalesce(pl.label, p) AS pl, coalesce(ol.label, o) AS ol FROM own JOIN small USING (e) LEFT JOIN n pl ON pl.id = p LEFT JOIN n ol ON ol.id = o WHERE i <= small.k)
      SELECT e, 'Which entity ' || string_agg('has ' || pl || ' ' || ol, ' and ' ORDER BY i) || '?' AS question, coalesce(any_value(el.label), 'Entity_' || e) AS answer,
        'SELECT (COUNT(?entity) AS ?count) WHERE {{ ' || string_agg('?entity wdt:' || p || ' wd:' || o || ' .', ' ' ORDER BY i) || ' }}' AS sparql_verification FROM c LEFT JOIN n el ON el.id = e GROUP BY e""",
    "answer_tags": f"""SELECT qa_id, nullif({_STRIP.format("coalesce(question, '')")}, '') AS query, {_STRIP.format("' ' || coalesce(answer, '') || ' '")} AS answer, CASE WHEN question LIKE '%?' THEN question ELSE question || '?' END AS asked
      FROM demo WHERE coalesce(answer, '') NOT LIKE '%<answer>%' UNION ALL SELECT qa_id, nullif({_STRIP.format("coalesce(question, '')")}, ''), {_STRIP.format("split_part(answer, '</answer>', 1)")}, CASE WHEN question LIKE '%?' THEN question ELSE question || '?' END FROM demo WHERE answer LIKE '%<answer>%'""",
    "answer_matches": f"WITH {_SCORED} SELECT result_id, matched, strict FROM sc",
    "accuracy_by_level": f"WITH {_SCORED} SELECT model, level, count(*) AS total_questions, CAST(sum(matched::INT) AS BIGINT) AS correct_answers, avg(matched::INT) AS accuracy FROM sc JOIN demo USING (qa_id) GROUP BY 1, 2",
    "accuracy_rollup": f"WITH {_SCORED} SELECT model, level, count(*) AS n, CAST(sum(matched::INT) AS BIGINT) AS hits FROM sc JOIN demo USING (qa_id) GROUP BY ROLLUP (model, level)",
    "search_traces": """SELECT result_id, coalesce(len(list_filter(reasoning_process, lambda x: x.type = 'search')), 0) AS n_searches, coalesce(len(list_filter(reasoning_process, lambda x: x.type = 'information')), 0) AS n_informed,
      list_filter(reasoning_process, lambda x: x.type = 'search')[-1].query AS last_query FROM eval_results""",
    "replayed_turns": f"""SELECT result_id AS item_id, CASE WHEN regexp_full_match(coalesce(model_answer, ''), ' *') THEN '{evaluate.NO_OUTPUT}' ELSE {_FINAL} END AS answer,
      coalesce(len(list_filter(reasoning_process, lambda x: x.type = 'search')), 0) AS search_count, CASE WHEN regexp_full_match(coalesce(model_answer, ''), ' *') THEN 'empty' ELSE 'answer' END AS outcome FROM eval_results""",
    "search_snippets": r"""WITH q AS (SELECT result_id || '-' || (i - 1) AS query_id, entity_id, query, list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS asks FROM (
        SELECT e.result_id, d.source_triple.subject_id AS entity_id, unnest(list_filter(e.reasoning_process, lambda x: x.type = 'search')).query AS query, generate_subscripts(list_filter(e.reasoning_process, lambda x: x.type = 'search'), 1) AS i
        FROM eval_results e JOIN demo d USING (qa_id)) WHERE entity_id IS NOT NULL),
      r AS (SELECT q.query_id, d.text, d.source, row_number() OVER (PARTITION BY q.query_id ORDER BY len(list_intersect(list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+')), coalesce(asks, []))) DESC, n_chars DESC, doc_id) AS r
        FROM q JOIN documents d USING (entity_id) WHERE d.text IS NOT NULL),
      l AS (SELECT query_id, string_agg('Doc ' || r || '(Title: ' || coalesce(source, 'None') || ') ' || text, chr(10) ORDER BY r) AS information FROM r WHERE r <= 3 GROUP BY 1)
      SELECT q.query_id, coalesce(information, '') AS information FROM q LEFT JOIN l USING (query_id)""",
    "corpus_top_values": "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place FROM triples WHERE {c} IS NOT NULL GROUP BY {c}" for f, c in FIELDS.items())
    + ") WHERE place <= 50",
    "corpus_distinct_counts": " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT {c}) AS total_count FROM triples" for f, c in FIELDS.items()),
    "stream_latest_change": f"SELECT entity_id, property_id, revid, new_value FROM ({_LATEST})",
    "stream_current_state": f"""SELECT entity_id, property_id, new_value AS current_value FROM (
      SELECT *, lower(trim(change_type)) AS kind FROM triple_changes QUALIFY row_number() OVER (PARTITION BY entity_id, property_id ORDER BY {_TS} DESC, revid DESC, feed_pos) = 1) WHERE kind <> 'deleted'""",
}
_BL = """bl AS (SELECT b.*, coalesce(la.label, 'Entity_' || a) AS al, coalesce(l1.label, 'Entity_' || p1) AS l1, coalesce(l2.label, 'Entity_' || p2) AS l2, coalesce(lc.label, 'Entity_' || c) AS cl
  FROM b LEFT JOIN n la ON la.id = a LEFT JOIN n l1 ON l1.id = p1 LEFT JOIN n l2 ON l2.id = p2 LEFT JOIN n lc ON lc.id = c)"""
_ABSTRACT = "'What is the ' || l2 || ' of ' || coalesce(tb.d, 'something') || ', the ' || l1 || ' of ' || coalesce(ta.d, al) || '?'"
_RD = SQL["reverse_descriptions"].partition("f AS (SELECT")
_SETS = """cs AS (SELECT own.e, i, p, o, coalesce(pl.label, p) AS pl, coalesce(ol.label, o) AS ol FROM own JOIN small USING (e) LEFT JOIN n pl ON pl.id = p LEFT JOIN n ol ON ol.id = o WHERE i <= least(small.k, 3))"""
_VALUES = "[" + ", ".join(f"'{v}'" for v in VALUES) + "]"


def _case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


SQL |= {
    "top_relations": "SELECT property_id AS predicate_id, count(*) AS n FROM triple_changes WHERE new_value LIKE 'Q%' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "verified_target": f"WITH {_G}, {_ONE.format(g='g')}, {_STRATA.format(g='g')} SELECT s, p, o, place FROM r, q WHERE place <= quota ORDER BY place, p LIMIT 600",
    "windowed_changes": f"SELECT feed_pos, entity_id, property_id FROM triple_changes WHERE {_TS} BETWEEN TIMESTAMPTZ '2025-01-01 00:00:00+00' AND TIMESTAMPTZ '2025-01-03 00:00:00+00'",
    "greedy_bridges": f"""WITH RECURSIVE {_K}, {_B}, o AS MATERIALIZED (SELECT *, md5(a || '|' || p1 || '|' || b || '|' || p2 || '|' || c || '|42') AS h FROM b),
      pick AS (SELECT 0 AS i, '' AS h, CAST([] AS VARCHAR[]) AS used UNION ALL
        SELECT i + 1, x.h, list_concat(used, [x.a, x.b, x.c]) FROM pick, LATERAL (SELECT arg_min(o, o.h) AS x FROM o WHERE o.h > pick.h AND NOT list_has_any(pick.used, [o.a, o.b, o.c])) WHERE i < 50 AND x IS NOT NULL)
      SELECT a, p1, b, p2, c FROM o JOIN pick USING (h)""",
    "greedy_candidates": f"""WITH RECURSIVE {_G}, {_ONE.format(g='g')}, {_STRATA.format(g='g')},
      z AS (SELECT p, row_number() OVER (ORDER BY count(*) DESC, p) AS z FROM g WHERE p IN (SELECT p FROM u) GROUP BY p), pool AS MATERIALIZED (SELECT r.*, z.z FROM r JOIN z USING (p)),
      step AS (SELECT 0 AS z, CAST([] AS VARCHAR[]) AS used, CAST([] AS STRUCT(s VARCHAR, p VARCHAR, o VARCHAR, place BIGINT)[]) AS picks UNION ALL
        SELECT z + 1, list_concat(used, list_concat(ss, oo)), ps FROM step, LATERAL (
          SELECT coalesce(list(s), []) AS ss, coalesce(list(o), []) AS oo, coalesce(list({{'s': s, 'p': p, 'o': o, 'place': place}}), []) AS ps FROM (
            SELECT *, row_number() OVER (ORDER BY place) AS free FROM pool WHERE pool.z = step.z + 1 AND NOT list_contains(step.used, pool.s)) WHERE free <= (SELECT quota FROM q)) WHERE z < (SELECT count(*) FROM z))
      SELECT x.s AS s, x.p AS p, x.o AS o, x.place AS place FROM (SELECT z, unnest(picks) AS x FROM step) ORDER BY z, x.place LIMIT 5000""",
    "abstract_bridges": f"""WITH {_G}, {_K}, {_N}, {_B}, {_BL}, {_ATTR}, td AS (SELECT node, 'something that ' || description AS d FROM attr WHERE place = 1)
      SELECT a, p1, b, p2, c, {_ABSTRACT} AS question, cl AS answer FROM bl LEFT JOIN td ta ON ta.node = a LEFT JOIN td tb ON tb.node = b""",
    "level3_questions": f"""{_RD[0]}{_OWN}, {_SETS}, f AS (SELECT{_RD[2].rpartition('SELECT node, arg_min')[0]}, rd AS (SELECT node, arg_min(description, r) AS d FROM d WHERE description IS NOT NULL GROUP BY node)
      SELECT cs.e, 'Which entity ' || string_agg('has ' || pl || ' ' || coalesce(rd.d, ol), ' and ' ORDER BY i) || '?' AS question, coalesce(any_value(el.label), 'Entity_' || cs.e) AS answer,
        string_agg(CASE WHEN rd.d IS NULL THEN pl || ': ' || ol ELSE 'abstract [' || pl || ': ' || ol || '] As [' || pl || ': ' || rd.d || ']' END, '; ' ORDER BY i) AS constraints
      FROM cs LEFT JOIN rd ON rd.node = o LEFT JOIN n el ON el.id = cs.e GROUP BY cs.e""",
    "level3_driver": f"""WITH {_G}, {_K}, {_N}, {_B}, {_BL}, {_OWN}, {_SETS}, {_ATTR.replace("WHERE NOT regexp", f"WHERE g.p IN {TOLD} AND NOT regexp", 1)},
      ds AS (SELECT node, list(description ORDER BY place) AS ds FROM attr WHERE place <= 2 GROUP BY node), td AS (SELECT node, ds[1] AS d FROM ds),
      lab AS (SELECT x.label, ds.ds FROM (SELECT label, min(id) AS node FROM n GROUP BY label) x JOIN ds USING (node)),
      ms AS (SELECT e, i, pl, coalesce(ds[CASE WHEN len(ds) = 2 THEN (instr('0123456789abcdef', substr(md5(e || '|' || o || '|42'), 4, 1)) - 1) % 2 ELSE 0 END + 1], ol) AS told FROM cs LEFT JOIN lab ON lab.label = ol),
      all_ AS (SELECT 'b|' || a || '|' || p1 || '|' || b || '|' || p2 || '|' || c AS record_id, 'abstract_bridge' AS type, {_ABSTRACT} AS question, cl AS answer FROM bl LEFT JOIN td ta ON ta.node = a LEFT JOIN td tb ON tb.node = b
        UNION ALL SELECT 'm|' || ms.e, 'abstract_multi_attribute', 'Which entity ' || string_agg('has ' || pl || ' ' || told, ' and ' ORDER BY i) || '?', coalesce(any_value(el.label), 'Entity_' || ms.e) FROM ms LEFT JOIN n el ON el.id = ms.e GROUP BY ms.e)
      SELECT * FROM all_ ORDER BY md5(record_id || '|42'), record_id LIMIT 200""",
    "constrained_entities": f"""WITH {_G}, {_KNOWN}, {_N}, deg AS (SELECT subject_id AS s FROM triples GROUP BY 1 HAVING count(*) >= 3),
      own0 AS (SELECT e, i, p, o FROM (SELECT s AS e, p, o, row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || p || '|' || o || '|42'), p, o) AS i FROM k JOIN deg USING (s)) WHERE i <= 5),
      {_small("first", "own0", "g", 5)}, rest AS (SELECT s FROM deg WHERE s NOT IN (SELECT e FROM first)),
      f AS (SELECT DISTINCT entity_id AS s, property_id AS p, new_value AS o FROM triple_changes WHERE new_value LIKE 'Q%' AND property_id IN {ALLOWED}),
      more AS (SELECT s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o) AS r FROM f WHERE (s, p) NOT IN (SELECT (s, p) FROM k)) JOIN n ol ON ol.id = o WHERE r <= 20 AND s IN (SELECT s FROM rest)),
      both_ AS (SELECT s, p, o FROM k WHERE s IN (SELECT s FROM more) UNION SELECT s, p, o FROM more),
      own1 AS (SELECT e, i, p, o FROM (SELECT s AS e, p, o, row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || p || '|' || o || '|43'), p, o) AS i FROM both_) WHERE i <= 6), {_small("second", "own1", "g", 6)}
      SELECT e, CAST(k AS BIGINT) AS k, extended FROM (SELECT e, k, false AS extended FROM first UNION ALL SELECT e, k, true FROM second) ORDER BY md5(e || '|42'), e LIMIT 400""",
    "extracted_changes": f"""WITH {_N}, el AS (SELECT entity_id, min(entity_label) AS label FROM triple_changes GROUP BY 1), kd AS (SELECT entity_id, property_id, min(property_type) AS kind FROM triple_changes GROUP BY 1, 2),
      c AS (SELECT *, CASE WHEN feed_pos % 23 = 0 THEN 'NEW_CREATED' WHEN old_value = 'NEW_CREATED' THEN 'NO_VALUE' ELSE old_value END AS ov, CASE WHEN new_value = 'NEW_CREATED' THEN 'NO_VALUE' ELSE new_value END AS nv FROM triple_changes)
      SELECT feed_pos AS revid, entity_id, coalesce(el.label, entity_id) AS entity_label, property_id, coalesce(pl.label, property_id) AS property_label, kind AS property_type, ov AS old_value, nv AS new_value,
        CASE WHEN nv LIKE 'Q%' THEN coalesce(vl.label, nv) ELSE nv END AS new_value_label,
        CASE WHEN ov IN ('NEW_CREATED', 'NO_VALUE', 'SOME_VALUE') THEN 'created' WHEN nv IN ('NO_VALUE', 'SOME_VALUE') THEN 'deleted' ELSE 'updated' END AS change_type, change_timestamp, '{extract.WIKI}Page_of_' || entity_id AS wiki_url
      FROM c JOIN el USING (entity_id) JOIN kd USING (entity_id, property_id) LEFT JOIN n pl ON pl.id = property_id LEFT JOIN n vl ON vl.id = nv
      WHERE feed_pos % 13 <> 0 AND feed_pos % 17 <> 0 AND feed_pos % 19 <> 0 AND entity_id NOT LIKE '%7' AND kind IN {extract.PROPERTY_TYPES} AND ov <> nv""",
    "metaphors": f"""WITH {_G}, {_N}, {_ATTR.replace("WHERE NOT regexp", f"WHERE g.p IN {TOLD} AND NOT regexp", 1).replace("coalesce(pl.label, g.p) AS property", f"coalesce({_case(RELATIONS, 'g.p')}, pl.label, g.p) AS property", 1)}
      SELECT DISTINCT * FROM (SELECT node, CASE WHEN contains(lower(property), 'birth') THEN 'offspring of ' || value WHEN contains(lower(property), 'capital') THEN 'crowned jewel of ' || value
        WHEN contains(lower(property), 'language') THEN 'voice that speaks ' || value WHEN contains(lower(property), 'director') THEN 'cinematic architect' END AS description FROM attr WHERE place <= 3) WHERE description IS NOT NULL""",
    "indirect_descriptions": f"""WITH {_G}, a AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p, o) AS place, CASE WHEN p = 'P6616' THEN '19' || right(o, 2) || '-01-01' ELSE {_VALUES}[CAST(right(o, 1) AS INT) + 1] END AS v FROM g WHERE p IN {tuple(RELATIONS)}),
      d AS (SELECT s, place, CASE WHEN p IN ('P9336', 'P6105') THEN {_case(expand.PLACES, 'v')} WHEN p IN ('P6834', 'P4068') THEN {_case(expand.KINDS, 'lower(v)')}
        WHEN p = 'P6616' THEN CASE WHEN {_YEAR} < 1900 THEN 'pre-industrial era' WHEN {_YEAR} < 1950 THEN 'early 20th century' WHEN {_YEAR} < 2000 THEN 'late 20th century' END END AS d FROM a)
      SELECT s AS node, string_agg(d, '; ' ORDER BY place) AS told FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY place) AS r FROM d WHERE d IS NOT NULL) WHERE r <= 2 GROUP BY s""",
    "organisation_descriptions": f"""WITH {_K}, v AS (SELECT DISTINCT o AS id, ['football club', 'national team', 'river', 'research institution', 'sports organization', 'village', 'organization', 'bridge', 'clubhouse', 'person'][CAST(right(o, 1) AS INT) + 1] AS l FROM k),
      x AS (SELECT s, o FROM k WHERE p IN ('P9336', 'P6105') QUALIFY row_number() OVER (PARTITION BY s ORDER BY p, o) <= 5)
      SELECT DISTINCT s, description FROM (SELECT x.s, CASE WHEN contains(vu.l, 'organization') THEN vu.l WHEN regexp_matches(vk.l, 'club|team|organization|institution') THEN vk.l END AS description
        FROM x LEFT JOIN k u ON u.s = x.o AND u.p = 'P6834' LEFT JOIN v vk ON vk.id = x.o LEFT JOIN v vu ON vu.id = u.o) WHERE description IS NOT NULL""",
}
SQL = {name: sql.replace("{{", "{").replace("}}", "}") for name, sql in SQL.items()}
