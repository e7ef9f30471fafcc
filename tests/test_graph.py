"""Triples, patterns, mining and expansion, against brute force and hand-made cases."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.operators import expand, graph, mining, questions, stats
from strandline.operators import triples as t

FACTS = "s string, p string, o string"


def random_graph(seed: int, nodes: int = 12, facts: int = 60) -> list[tuple]:
    r = random.Random(seed)
    return sorted({(f"Q{r.randrange(nodes)}", f"P{r.randrange(4)}", f"Q{r.randrange(nodes)}") for _ in range(facts)})


@pytest.mark.parametrize("seed", range(3))
def test_bridges_and_single_paths(spark, seed):
    g = random_graph(seed)
    between, ends = defaultdict(set), defaultdict(list)
    for (a, p1, b), (b2, p2, c) in itertools.product(g, g):
        if b == b2:
            ends[a, p1, p2].append(c)
            if a != c:
                between[a, p1, p2, c].add(b)
    expected = {(a, p1, next(iter(b)), p2, c) for (a, p1, p2, c), b in between.items() if len(b) == 1 and not b & {a, c}}
    df = spark.createDataFrame(g, FACTS)
    assert {tuple(r) for r in mining.bridges(df).collect()} == expected
    assert {tuple(r) for r in mining.single_paths(df).collect()} == {(*k, v[0]) for k, v in ends.items() if len(v) == 1}
    chosen = [tuple(r) for r in mining.greedy_bridges(mining.bridges(df), 5).collect()]
    nodes = [n for a, _, b, _, c in chosen for n in (a, b, c)]
    assert len(nodes) == len(set(nodes)) and set(chosen) <= expected


def test_meaningless_bridges_are_left_out(spark):
    g = [("A", "P155", "B"), ("B", "P156", "C"), ("C", "P276", "D"), ("D", "P131", "E"), ("A", "P1", "F"), ("F", "P156", "G")]
    assert {tuple(r) for r in mining.bridges(spark.createDataFrame(g, FACTS)).collect()} == {("A", "P1", "F", "P156", "G"), ("B", "P156", "C", "P276", "D")}


@pytest.mark.parametrize("seed", range(4))
def test_smallest_prefixes(spark, seed):
    df = spark.createDataFrame(random_graph(seed, 8, 50), FACTS)
    own = defaultdict(list)
    for r in sorted(mining.ordered_constraints(df).collect(), key=lambda r: r.i):
        own[r.e].append((r.p, r.o))
    has = defaultdict(set)
    for s, p, o in random_graph(seed, 8, 50):
        has[s].add((p, o))
    expected = {}
    for e, constraints in own.items():
        for k in range(2, len(constraints) + 1):
            if sum(set(constraints[:k]) <= x for x in has.values()) == 1:
                expected[e] = k
                break
    assert {r.e: r.k for r in mining.smallest_prefixes(df).collect()} == expected


def test_greedy_excludes_used_nodes_and_strata_share(spark):
    g = [("A", "P1", "B"), ("C", "P1", "D"), ("E", "P1", "F"), ("B", "P2", "X"), ("G", "P2", "Y"), ("H", "P2", "Y"), ("H", "P2", "Z"), ("I", "P1", "J"), ("K", "P1", "L")]
    chosen = {tuple(r)[:3] for r in mining.greedy_stratified(spark.createDataFrame(g, FACTS), 100).collect()}
    assert chosen == {("A", "P1", "B"), ("C", "P1", "D"), ("E", "P1", "F"), ("I", "P1", "J"), ("K", "P1", "L"), ("G", "P2", "Y")}
    assert mining.stratified(spark.createDataFrame(g, FACTS), 2).count() == 2
    assert mining.stratified(spark.createDataFrame([], FACTS), 2).count() == 0


def test_patterns(spark):
    g = spark.createDataFrame([("A", "P1", "B"), ("A", "P2", "C"), ("D", "P1", "B"), ("B", "P3", "C"), ("D", "P1", "E")], FACTS)
    count = lambda q: graph.run(g, q).first()[0]
    assert count("SELECT (COUNT(?o) AS ?count) WHERE { wd:D wdt:P1 ?o . }") == 2
    assert count("SELECT (COUNT(?e) AS ?count) WHERE { ?e wdt:P1 wd:B . ?e wdt:P2 wd:C . ?e wdt:P1 wd:B . }") == 1
    assert count("SELECT (COUNT(?x) AS ?count) WHERE { wd:A wdt:P1 ?b . ?b wdt:P3 ?x . }") == 1
    assert count("ASK { ?e wdt:P1 wd:E . }") and not count("ASK { ?e wdt:P9 ?x . }") and count("ASK { wd:A wdt:P1 wd:B . }")
    q = "SELECT ?e ?x ?k WHERE { ?e wdt:P1|wdt:P2 ?x . OPTIONAL { ?x wdt:P3 ?k . } SERVICE wikibase:label { bd:serviceParam wikibase:language \"en\" . } } LIMIT 3"
    assert [tuple(r) for r in graph.run(g, q).collect()] == [("A", "B", "C"), ("A", "C", None), ("D", "B", "C")]
    q = "SELECT ?p ?o WHERE { wd:A ?p ?o . FILTER(?p IN (wdt:P1, # first\n wdt:P2)) FILTER(?p NOT IN (wdt:P2)) }"
    assert [tuple(r) for r in graph.run(g, q).collect()] == [("P1", "B")]
    assert graph.run(g, "SELECT ?x WHERE { ?x wdt:P1 ?x . }").count() == 0
    with pytest.raises(ValueError, match="cross join"):
        graph.run(g, "SELECT ?x ?y WHERE { ?x wdt:P1 wd:B . ?y wdt:P2 wd:C . }")
    with pytest.raises(ValueError, match="no pattern"):
        graph.parse("SELECT ?x WHERE { }")


def test_stored_counts(spark):
    g = spark.createDataFrame([("A", "P1", "B"), ("A", "P2", "C"), ("D", "P1", "B"), ("D", "P1", "E")], FACTS)
    q = [(1, "SELECT (COUNT(?object) AS ?count) WHERE { wd:D wdt:P1 ?object . }"), (2, "SELECT (COUNT(?entity) AS ?count) WHERE { ?entity wdt:P1 wd:B . ?entity wdt:P2 wd:C . ?entity wdt:P1 wd:B . }"), (3, "SELECT (COUNT(?object) AS ?count) WHERE { wd:X wdt:P1 ?object . }")]
    assert {tuple(r) for r in graph.stored_counts(g, spark.createDataFrame(q, "id bigint, q string"), "id", "q").collect()} == {(1, 2), (2, 1), (3, 0)}


def test_labels_and_lookups(spark):
    rows = [("Q1", "one", "P1", "p", "Q2", "two"), ("Q1", "Q1", "P1", None, "Q3", None), ("Q4", "two", "P1", "p", "Q5", "one"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "subject_id string, subject_label string, predicate_id string, predicate_label string, object_id string, object_label string")
    assert {tuple(r) for r in t.labels(df).collect()} == {("Q1", "one"), ("P1", "p"), ("Q2", "two"), ("Q4", "two"), ("Q5", "one")}
    wanted = spark.createDataFrame([("two",), ("one",), ("none",)], "label string")
    assert {tuple(r) for r in t.find_by_label(df, wanted).collect()} == {("two", "Q2"), ("one", "Q1")}
    assert t.facts(df, df).count() == 3
    assert [tuple(r) for r in t.degrees(df, 2).collect()] == [("Q1", 2)]
    hub = spark.createDataFrame([("H", f"P{i % 3}", f"Q{i:02d}") for i in range(30)], FACTS)
    assert [(r.p, r.other) for r in t.neighbourhood(hub).where("node = 'H'").orderBy("place").collect()] == [("P0", f"Q{i:02d}") for i in (0, 3, 6, 9, 12)]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_phrases(spark):
    lit = F.lit
    assert one(spark, expand.property_name(lit("http://www.wikidata.org/prop/direct/P57"))) == "director"
    assert one(spark, expand.property_name(lit("http://www.wikidata.org/prop/direct/P9"))) == "P9"
    for name, value, good in [("a", "b", True), ("a", "Q12", False), ("a", "Q12x", True), ("a", "see HTTP://x", False), ("https://x", "b", False), ("a", "x" * 101, False), ("a", "a/b", True), ("a", "a/b/c", False), ("a", "Class", False), ("", "b", False), (None, "b", False), ("a", None, False)]:
        assert one(spark, expand.describes(lit(name).cast("string"), lit(value).cast("string"))) is good, (name, value)
    eras = {"-0050-01-01": None, "1899-01-01": "pre-industrial era", "1949-05": "early 20th century", "1999-1-1": "late 20th century", "2000-01-01": "modern era", "2000": None, "x-1": None}
    for date, era in eras.items():
        assert one(spark, expand.era_of_date(lit(date))) == era
    assert one(spark, expand.era_of_instant(lit("1850-01-01T00:00:00Z"))) == "pre-modern era"
    assert one(spark, expand.era_of_instant(lit("2001-01-01"))) == "21st century"
    assert one(spark, expand.indirect(lit("country"), lit("Italy"))) == "Mediterranean country"
    assert one(spark, expand.indirect(lit("genre"), lit("Film"))) == "cinematic work"
    assert one(spark, expand.reverse_phrase(lit("sister city"), lit("Oslo"))) == "neighbor of Oslo"
    assert one(spark, expand.reverse_phrase(lit("continent"), lit("Asia"))) == "Asia entity"
    assert one(spark, expand.reverse_phrase(lit("part of"), lit("Big Thing"))) == "big thing"
    assert one(spark, expand.reverse_phrase(lit("continent"), lit("As"))) is None
    assert one(spark, expand.place_phrase(lit("Paris"), lit("France"), lit("Europe"))) == "France entity"
    assert one(spark, expand.place_phrase(lit("France"), lit("France"), lit("Europe"))) == "Europe organization"
    assert one(spark, expand.organisation_phrase(lit("Football Club"), lit("Sports Organization"))) == "sports organization"
    assert one(spark, expand.organisation_phrase(lit("Football Club"), lit("x"))) == "football club"
    assert one(spark, expand.metaphor(lit("place of birth"), lit("Bonn"))) == "offspring of Bonn"
    assert one(spark, expand.metaphor(lit("film director"), lit("X"))) == "cinematic architect"


def test_descriptions_of_nodes(spark):
    rows = [("A", 1, "country", "Italy", "x"), ("A", 2, "genre", "none", "y"), ("A", 3, "inception", "1901-01-01", "z"), ("A", 4, "country", "France", "w"), ("B", 1, "place of birth", "Bonn", "v")]
    df = spark.createDataFrame(rows, "node string, place bigint, property string, value string, description string")
    assert [tuple(r) for r in expand.indirect_descriptions(df).collect()] == [("A", ["Mediterranean country", "early 20th century"])]
    assert {tuple(r) for r in expand.metaphors(df).collect()} == {("B", "offspring of Bonn")}
    assert {r.node: [x.value for x in r.direct_attributes] for r in expand.expansions(df, 2).collect()} == {"A": ["Italy", "none"], "B": ["Bonn"]}
    g = spark.createDataFrame([("T", "P31", "C"), ("C", "P279", "O"), ("U", "P31", "C2"), ("T", "P571", "1850-01-01T00:00:00Z"), ("T", "P571", "+x")], FACTS)
    names = spark.createDataFrame([("C", "Club"), ("O", "Organization"), ("C2", "Sports Team")], "id string, label string")
    assert {tuple(r) for r in expand.kind_chain(g, names).collect()} == {("T", "organization"), ("C", "organization"), ("U", "sports team")}
    assert {tuple(r) for r in expand.era_chain(g).collect()} == {("T", "pre-modern era")}
    pick = spark.createDataFrame([("A", ["x"]), ("B", []), ("C", ["x", "y", "z"])], "id string, d array<string>").select("id", questions.chosen_description(F.col("d"), "id").alias("c"))
    found = {r.id: r.c for r in pick.collect()}
    assert found["A"] == "x" and found["B"] is None and found["C"] in ("x", "y")
    kept, counts = stats.observed(g, "facts", dated=F.col("p") == "P571")
    assert kept.count() == 5 and counts.get == {"rows": 5, "dated": 2}
    records = spark.createDataFrame([("bridge", "a"), ("multi_attribute", "b"), ("other", "c")], "type string, q string")
    assert {r.q for r in questions.by_type(records, lambda x: x.select("q"), lambda x: x.select("q")).collect()} == {"a", "b"}


def test_level_questions_and_constraint_labels_with_colons(spark):
    sets = spark.createDataFrame([("E", "Ann", [(1, "P1", "Q1", "a: b", "c: d"), (2, "P2", "Q2", "e", "f")])], "e string, answer string, constraints array<struct<i: bigint, p: string, o: string, p_label: string, o_label: string>>")
    told = spark.createDataFrame([("Q1", "a thing")], "node string, description string")
    row = questions.abstracted(sets, told).first()
    assert row.constraint_texts == ["abstract [a: b: c: d] As [a: b: a thing]", "e: f"]
    assert row.question == "Which entity has a: b a thing and has e f?"


def test_model_adapter(spark):
    df = spark.createDataFrame([(1, "ask", "a plain question?"), (2, "fail", "b")], "id int, prompt string, plain string")
    assert {r.id for r in questions.worded(df, "prompt", None, "plain").collect()} == {1}
    assert [(r.id, r.question) for r in questions.worded(df, "prompt", lambda p: "What is it?" if p == "ask" else None, "plain").collect()] == [(1, "What is it?")]
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return "yes"

    assert questions.with_backoff(flaky, sleep=lambda s: None)("x") == "yes" and len(calls) == 3
    assert questions.with_backoff(lambda p: 1 / 0, tries=2, sleep=lambda s: None)("x") is None


def test_statistics(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert [(r.value, r.n, r.place) for r in stats.value_counts(df, {"f": "v"}).orderBy("place").collect()] == [("a", 2, 1), ("b", 1, 2)]
    assert stats.distinct_counts(df, {"f": "v"}).first().total_count == 2


def test_quota_is_of_all_predicates(spark):
    """Of three predicates one has no single-valued fact; it counts for the quota all the same."""
    rows = [(f"s{i}", "P1", f"o{i}") for i in range(9)] + [(f"t{i}", "P2", f"u{i}") for i in range(9)] + [("x", "P3", f"y{i}") for i in range(20)]
    g = spark.createDataFrame(rows, "s string, p string, o string")
    for chosen in (mining.greedy_stratified(g, 9), mining.stratified(g, 9)):
        assert sorted(r["count"] for r in chosen.groupBy("p").count().collect()) == [3, 3]


def test_repeated_rows_count_for_the_least_number_of_attributes(spark):
    rows = [("e", "P1", "a"), ("e", "P2", "b"), ("e", "P2", "b"), ("f", "P1", "a"), ("f", "P2", "c")]
    triples = spark.createDataFrame(rows, "subject_id string, p string, o string")
    g = triples.toDF("s", "p", "o").distinct()
    own = mining.ordered_constraints(g, rows=t.degrees(triples, 3))
    assert {(r.e, r.p, r.o) for r in own.collect()} == {("e", "P1", "a"), ("e", "P2", "b")}
    assert [tuple(r) for r in mining.smallest_prefixes(g, own).collect()] == [("e", 2)]


def test_extended_prefixes_need_the_entity_to_have_them(spark):
    g = spark.createDataFrame([("e", "P1", "a"), ("e", "P2", "b"), ("e", "P3", "c"), ("f", "P1", "a"), ("f", "P2", "b")], "s string, p string, o string")
    own = g.where("p <> 'P3' AND s = 'e'")
    more = spark.createDataFrame([("e", "P3", "c")], "s string, p string, o string")
    found, kept = mining.extended_prefixes(g, own, more)
    (k,) = [r.k for r in found.collect()]
    order = {r.p: r.i for r in kept.collect()}
    assert k == max(2, order["P3"])
    wrong = more.unionByName(spark.createDataFrame([("e", "P4", "not in the graph")], "s string, p string, o string"))
    _, kept = mining.extended_prefixes(g, own, wrong)
    assert "P4" not in {r.p for r in kept.collect()}
    none, _ = mining.extended_prefixes(g, own, more.limit(0))
    assert none.count() == 0
