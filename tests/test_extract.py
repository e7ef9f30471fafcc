"""Extraction, files, the feed source, evaluation and streams on hand-made cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strandline import schemas
from strandline.operators import evaluate, extract
from strandline.sources import feed, lookups, records
from strandline.sources.tables import table
from strandline.streaming.latest import latest_state, stream_latest, stream_state, until_enough


def doc(*values, pid="P1", kind="wikibase-item", snak="value"):
    return json.dumps({"claims": {pid: [{"mainsnak": {"snaktype": snak, "datatype": kind, **({"datavalue": {"value": v}} if snak == "value" else {})}} for v in values]}})


@pytest.mark.parametrize(
    ("text", "value"),
    [
        (doc({"id": "Q7"}), "Q7"), (doc({"amount": "+5", "unit": "1"}), "+5"), (doc({"time": "+2021-00-00T00:00:00Z", "precision": 9}), "+2021-00-00T00:00:00Z"),
        (doc({"latitude": 52, "longitude": 13.5}), "52,13.5"), (doc({"text": "hi", "language": "en"}), "hi"), (doc("plain"), "plain"), (doc(0, snak="somevalue"), "SOME_VALUE"),
        (doc(0, snak="novalue"), "NO_VALUE"), (doc({"id": "Q7"}, pid="P2"), "NO_VALUE"), ('{"claims": []}', "NO_VALUE"), ("{broken", "ERROR"), (None, "ERROR"), ("{}", "ERROR"), (doc({"id": "Q1"}, {"id": "Q2"}), "Q1"),
    ],
)
def test_statement_value(spark, text, value):
    df = spark.createDataFrame([(text, "P1")], "d string, p string")
    assert df.select(extract.statement_value(F.col("d"), F.col("p"))).first()[0] == value


def test_extraction(spark):
    entity = lambda q, title="Page One", kind="wikibase-item", missing=None: (q, missing, {"en": (f"label {q}",)}, {"enwiki": (title,)} if title else {}, {"P1": [((("value", kind, None)),)]})
    entities = [entity("Q1"), entity("Q2", "Category:X"), entity("Q3", None), entity("Q4", missing=""), entity("Q5", kind="string"), entity("Q6"), entity("Q7"), entity("Q8")]
    comment = "edit [[Property:P1]] and [[Property:P2]]"
    recs = [(f"Q{i}", comment, i * 10, i * 10 - 1, "2025-01-01T00:00:00Z") for i in range(1, 8)] + [("Talk:Q1", comment, 80, 79, "x"), ("Q8", "no link", 80, 79, "x"), ("Q8", comment, 81, 0, "2025-01-02T00:00:00Z"), ("Q8", comment, 82, 999, "x")]
    revisions = [(10, doc({"id": "Q7"})), (9, doc({"id": "Q6"})), (60, doc(0, snak="somevalue")), (59, doc({"id": "Q6"})), (70, doc(0, snak="somevalue")), (69, doc(0, snak="novalue")), (81, doc({"id": "Q9"})), (82, doc({"id": "Q9"}))]
    names = spark.createDataFrame([("P1", "is"), ("Q7", "seven")], schemas.LABEL)
    rows = extract.extract_changes(spark.createDataFrame(recs, schemas.CHANGE_RECORD), spark.createDataFrame(entities, schemas.ENTITY), spark.createDataFrame(revisions, schemas.REVISION), names).collect()
    found = {(r.entity_id, r.old_value, r.new_value, r.change_type, r.new_value_label, r.property_label) for r in rows}
    assert found == {("Q1", "Q6", "Q7", "updated", "seven", "is"), ("Q6", "Q6", "SOME_VALUE", "deleted", "SOME_VALUE", "is"), ("Q7", "NO_VALUE", "SOME_VALUE", "created", "SOME_VALUE", "is"), ("Q8", "NEW_CREATED", "Q9", "created", "Q9", "is")}
    assert {r.wiki_url for r in rows} == {"https://en.wikipedia.org/wiki/Page_One"} and {r.entity_label for r in rows} == {"label Q1", "label Q6", "label Q7", "label Q8"}


def test_window_latest_and_order(spark):
    recs = spark.createDataFrame([("Q1", "", 1, 0, "2025-01-01T10:00:00Z"), ("Q1", "", 2, 0, "2025-01-01T12:00:00Z"), ("Q1", "", 3, 0, None)], schemas.CHANGE_RECORD)
    end = F.lit("2025-01-01T12:30:00Z").cast("timestamp")
    assert [r.revid for r in extract.in_window(recs, end, 2.0).collect()] == [2] and extract.in_window(recs, end, None).count() == 3
    rows = [("Q1", "P1", 1, "a", "2025-01-01T00:00:00Z"), ("Q1", "P1", 2, "b", "2025-01-01T00:00:00Z"), ("Q2", "P1", 3, "c", "2025-01-02T00:00:00Z")]
    latest = extract.latest_per_entity(spark.createDataFrame(rows, "entity_id string, property_id string, revid bigint, new_value string, change_timestamp string"))
    assert {(r.entity_id, r.revid) for r in latest.collect()} == {("Q1", 2), ("Q2", 3)}
    assert [r.entity_id for r in extract.newest_first(latest, 1).collect()] == ["Q2"] and extract.newest_first(latest, 0).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('subject_id,subject_label,predicate_id,predicate_label,object_id,object_label\nQ1,NA,P1,"say ""hi"", twice",Q2,"two\nlines"\n')
    kind, df = records.read_csv(spark, str(tmp_path / "t.csv"))
    assert kind == "triples" and tuple(df.first()) == ("Q1", "NA", "P1", 'say "hi", twice', "Q2", "two\nlines")
    row = dict.fromkeys([c.split()[0] for c in schemas.CHANGES.split(", ")], "x") | {"new_value": "Q9", "new_value_label": None}
    changes = spark.createDataFrame([tuple(row.values()), tuple((row | {"new_value": "+5"}).values())], schemas.CHANGES)
    records.write_csv(changes, str(tmp_path / "c.csv"), single=True)
    assert records.read_csv(spark, str(tmp_path / "c.csv"))[0] == "changes"
    assert [r.object_id for r in records.read_triples(spark, str(tmp_path / "none.csv"), str(tmp_path / "c.csv")).collect()] == ["Q9"]
    with pytest.raises(FileNotFoundError):
        records.read_triples(spark, str(tmp_path / "none.csv"))
    items = [{"question": "é?", "answer": "b", "level": 1, "reasoning_chain": [["a", "b", "c"]]}, {"question": "d", "answer": "e", "constraint_info": {"constraint_count": 2, "constraints": ["x: y"]}}]
    (tmp_path / "bare.json").write_text(json.dumps(items))
    (tmp_path / "wrapped.json").write_text(json.dumps({"metadata": {}, "qa_pairs": items}))
    for name in ("bare", "wrapped"):
        found = records.read_questions(spark, str(tmp_path / f"{name}.json")).orderBy("question").collect()
        assert [r.question for r in found] == ["d", "é?"] and found[0].constraint_info.constraints == ["x: y"] and found[1].reasoning_chain == [["a", "b", "c"]]
    assert records.write_envelope(records.read_questions(spark, str(tmp_path / "bare.json")), str(tmp_path / "out.json"), {"v": 1}) == 2
    assert "é?" in (tmp_path / "out.json").read_text("utf-8")
    assert records.evaluation_path("data/2025/level2_x.json", "RAG", "a-b.c/d", "T", "summary", True) == "outputs/evaluations/2025/level2_summary_RAG_a_b_c_d_search_T.json"
    assert records.evaluation_path("x.json", "DA", "m", "T") == "outputs/evaluations/unknown/unknown_results_DA_m_T.json"


def test_feed_source(spark, tmp_path):
    feed.register(spark)
    for page in range(3):
        (tmp_path / f"{page}.json").write_text(json.dumps([{"title": f"Q{page}{i}", "comment": "c", "revid": page * 10 + i, "old_revid": 0, "timestamp": f"2025-01-0{3 - page}T0{i}:00:00Z"} for i in range(4)]))
    (tmp_path / "3.json").write_text("not json")
    df = spark.read.format("change_feed").load(str(tmp_path))
    assert df.count() == 12
    assert df.where("timestamp >= '2025-01-03T02:00:00Z' and revid > 0").count() == 2
    stream = spark.readStream.format("change_feed").load(str(tmp_path))
    query = stream.writeStream.format("memory").queryName("pages").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "marks")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("pages").count() == 12


def test_tags_and_scores(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    for text, answer in [("a <answer> b </answer> c", "b"), (" plain ", "plain"), ("</answer> x <answer>", ""), ("<answer>1</answer><answer>2</answer>", "1"), ("<answer>open", "<answer>open")]:
        assert one(evaluate.tagged_answer(F.lit(text))) == answer
    assert one(evaluate.search_query(F.lit("<search>a</search> <search> b\nc </search>"))) == "b\nc"
    assert one(evaluate.search_query(F.lit("none"))) is None and one(evaluate.search_query(F.lit("<search> </search>"))) is None
    assert one(evaluate.asked(F.lit("a"))) == "a?" and one(evaluate.asked(F.lit("a?"))) == "a?"
    assert one(evaluate.matches(F.lit(" Bonn\t"), F.lit("In bonn."))) and one(evaluate.matches(F.lit(""), F.lit("x"))) and not one(evaluate.matches(F.lit("Bonn"), F.lit("Berlin")))
    items = spark.createDataFrame([("m", "a", "<answer>A!</answer>"), ("m", "a", "xay"), ("m", "b", None)], "model string, expected_answer string, model_answer string")
    assert {tuple(r)[:3] for r in evaluate.accuracy(evaluate.score(items), "model").collect()} == {("m", 3, 2)}
    assert tuple(evaluate.accuracy(evaluate.score(items.limit(0))).first()) == (0, 0, 0.0)


def test_replay(spark):
    s = "<search>q</search>"
    turns = [(1, 1, s), (1, 2, f"{s}<answer>no</answer>"), (1, 3, "<answer> yes </answer>"), (1, 4, s), (2, 1, " "), (2, 2, "late"), (3, 1, "<search></search><answer>x</answer>")] + [(4, i, s) for i in range(1, 12)]
    found = {r.item_id: (r.answer, r.search_count, r.outcome) for r in evaluate.replay(spark.createDataFrame(turns, schemas.TURNS)).collect()}
    assert found == {1: ("yes", 2, "answer"), 2: (evaluate.NO_OUTPUT, 0, "empty"), 3: ("x", 0, "answer"), 4: (evaluate.TOO_MANY, 10, "limit")}


def test_live_adapters_and_evaluation_files(spark, tmp_path):
    items = spark.createDataFrame([(1, "Who", "Ann"), (2, "What?", "Bob")], "item_id bigint, question string, expected_answer string")
    scored = evaluate.score(evaluate.answered(items, lambda prompt: "<answer> Ann </answer>" if prompt.endswith("Who?") else None))
    assert {(r.item_id, r.final_answer, r.matched) for r in scored.collect()} == {(1, "Ann", True), (2, evaluate.NO_OUTPUT, False)}
    summary = records.write_evaluation(scored, str(tmp_path), "data/2025/level1.json", "DA", "m-1", "T")
    assert (summary["total_questions"], summary["correct_answers"], summary["accuracy"]) == (2, 1, 0.5)
    assert spark.read.json(str(tmp_path / "outputs/evaluations/2025/level1_results_DA_m_1_T.json")).count() == 2
    client = lambda prompt: "<answer>found</answer>" if "a document" in prompt else "<search> who </search>" if "Who" in prompt else ""
    turns = evaluate.searched(items, client, lambda query: f"a document on {query}")
    assert {tuple(r) for r in evaluate.replay(turns).collect()} == {(1, "found", 1, "answer"), (2, evaluate.NO_OUTPUT, 0, "empty")}


def test_streams(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    changes = table(spark, d, "triple_changes")
    changes.repartition(5).write.parquet(str(tmp_path / "in"))
    streamed = stream_latest(spark, str(tmp_path / "in"), changes.schema, files_per_batch=2)
    assert {tuple(r) for r in streamed.collect()} == {tuple(r) for r in latest_state(changes).collect()}
    from strandline.operators.lsm import current_state

    assert {tuple(r) for r in stream_state(spark, str(tmp_path / "in"), changes.schema, 2).read().collect()} == {tuple(r) for r in current_state(changes, buckets=2).collect()}
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert len(until_enough(stream, 7, str(tmp_path / "marks"))) == 7


def test_snippets_give_whole_texts(spark):
    long = "word " * 60 + "Mosel"
    documents = spark.createDataFrame([(1, "Q1", "s", long, len(long)), (2, "Q1", None, "short", 5)], "doc_id bigint, entity_id string, source string, text string, n_chars bigint")
    queries = spark.createDataFrame([("a", "Q1", "the Mosel"), ("b", "Q2", "x"), ("c", "Q1", "a short one"), ("d", "Q1", None)], "query_id string, entity_id string, query string")
    found = dict(map(tuple, evaluate.snippets(documents, queries).collect()))
    first = f"Doc 1(Title: s) {long}\nDoc 2(Title: None) short"
    assert found == {"a": first, "b": "", "c": f"Doc 1(Title: None) short\nDoc 2(Title: s) {long}", "d": first}


def test_lookups_in_chunks(spark):
    ids = spark.createDataFrame([(f"Q{i}",) for i in range(120)] + [("Q1",), (None,)], "id string").coalesce(1)
    sizes = spark.sparkContext.accumulator(0)
    calls, failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def labels(part):
        calls.add(1)
        sizes.add(len(part))
        if "Q7" in part:
            raise OSError("down")
        return {i: f"label {i}" for i in part if i != "Q99"}

    named = {r.id: r.label for r in lookups.label_names(ids, labels, failed=failed).collect()}
    assert set(named) == {f"Q{i}" for i in range(120)} and named["Q7"] == "Q7" and named["Q99"] == "Q99"
    assert sizes.value == 120 and calls.value >= 3 and failed.value <= 50
    assert sum(k == v for k, v in named.items()) == failed.value + (named["Q99"] == "Q99" and failed.value < 120)
    assert lookups.label_names(ids.limit(0), labels).count() == 0


def test_extraction_from_looked_up_inputs(spark):
    recs = spark.createDataFrame([("Q1", "set [[Property:P1]]", 2, 1, "2025-01-01T00:00:00Z"), ("Q2", "set [[Property:P1]]", 4, 3, "2025-01-01T00:00:00Z"), ("Talk:Q1", "x", 5, None, "x")], schemas.CHANGE_RECORD)
    known = {"Q1": {"labels": {"en": {"value": "one"}}, "sitelinks": {"enwiki": {"title": "One"}}, "claims": {"P1": [{"mainsnak": {"snaktype": "value", "datatype": "time", "datavalue": None}}]}}}
    docs = {1: doc({"time": "a"}, kind="time"), 2: doc({"time": "b"}, kind="time"), 3: doc("x"), 4: doc("y")}
    clients = {"entities": lambda part: {i: known[i] for i in part if i in known}, "revisions": lambda part: {i: docs[i] for i in part if i in docs}, "labels": lambda part: {"P1": "born"}}
    entities, revisions, names = lookups.extraction_inputs(recs, clients)
    (row,) = extract.extract_changes(recs, entities, revisions, names).collect()
    assert (row.entity_id, row.entity_label, row.property_label, row.old_value, row.new_value) == ("Q1", "one", "born", "a", "b")


def test_pages_of_an_endpoint_are_followed_and_landed(spark, tmp_path):
    feed.register(spark)
    asked, waits = [], []

    def client(request):
        asked.append(request)
        if len(asked) == 2:
            raise OSError("down")
        at = request.get("from", 0)
        records_ = [{"title": f"Q{at + i}", "revid": at + i, "timestamp": f"2025-01-01T00:00:0{9 - at - i}Z"} for i in range(2)]
        return {"records": records_, "continue": {"from": at + 2} if at < 4 else None}

    assert feed.land_pages(feed.paged(client, "2025-01-01T00:00:00Z", 2, sleep=waits.append), str(tmp_path)) == 3
    assert waits == [5.0] and [r.get("from") for r in asked] == [None, 2, 2, 4] and all(r["end"] == "2025-01-01T00:00:00Z" for r in asked)
    found = spark.read.format("change_feed").load(str(tmp_path)).orderBy("revid").collect()
    assert [r.title for r in found] == [f"Q{i}" for i in range(6)]
    assert spark.read.format("change_feed").load(f"file://{tmp_path}").count() == 6
    with pytest.raises(OSError, match="down"):
        list(feed.paged(lambda _: (_ for _ in ()).throw(OSError("down")), tries=3, sleep=waits.append))
