"""History, skew and merge of the change feed, against brute force in Python."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.functions.instants import instant_micros, iso_text
from strandline.operators.feed import SENTINELS, heavy_keys, normal_changes
from strandline.operators.history import attribute_history
from strandline.operators.lsm import MergeTree, current_state
from strandline.operators.skew import key_medians, key_modes
from strandline.session import scratch_path
from strandline.streaming.latest import stream_latest, stream_state

SCHEMA = "feed_pos bigint, revid bigint, entity_id string, property_id string, old_value string, new_value string, change_type string, change_timestamp string, value string, piece string"


def feed(seed: int, n: int = 400, keys: int = 6) -> list[tuple]:
    """Random changes of few keys: lost ones, copies, late ones, several in a second, and clashing extra columns."""
    r, rows, held = random.Random(seed), [], {}
    for i in range(n):
        key = (f"Q{min(r.randrange(keys), r.randrange(keys))}", f"P{r.randrange(2)}")
        old, new = held.get(key, "NEW_CREATED"), r.choice(["A", "B", "C", "NO_VALUE", "SOME_VALUE"])
        held[key] = new
        at = 1_735_689_600 + i // 3
        text = f"2025-01-01T00:{(at % 3600) // 60:02d}:{at % 60:02d}Z"
        spelt = r.choice([text, text, text.replace("T", " "), text.replace("Z", ".000Z"), text.replace("T00", "T02").replace("Z", "+02:00")])
        kind = r.choice(["{}", " {}", "{} "]).format("deleted" if new in SENTINELS else "updated" if r.random() < 0.5 else "UPDATED")
        if r.random() > 0.1:  # some changes never arrive
            row = (1000 + i, *key, old, new, kind, spelt)
            rows += [row] * r.choice([1, 1, 1, 2, 3])
    r.shuffle(rows)
    return [(pos, *row, "clash", "clash") for pos, row in enumerate(rows)]


def ordered(rows: list[tuple]) -> dict[tuple, list[tuple]]:
    """Per key the changes (second, revid, old, new, kind) in order, copies once."""
    from datetime import datetime

    out: dict[tuple, dict] = {}
    for _, revid, e, p, old, new, kind, text, *_ in rows:
        at = datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp()
        out.setdefault((e, p), {})[revid] = (at, revid, old, new, kind.strip().lower())
    return {k: sorted(v.values()) for k, v in out.items()}


def iso(at: float) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def versions(rows: list[tuple]) -> set[tuple]:
    out = set()
    for key, changes in ordered(rows).items():
        for i, (at, _, old, new, _) in enumerate(changes):
            if new not in SENTINELS:
                end = "open" if i + 1 == len(changes) else iso(changes[i + 1][0]) if changes[i + 1][2] == new else "unknown"
                out.add((*key, new, iso(at), end))
            if old not in SENTINELS and (i == 0 or changes[i - 1][3] != old):
                out.add((*key, old, "unknown", iso(at)))
    return out


@pytest.mark.parametrize(("seed", "heavy_rows"), [(1, 10**6), (2, 10**6), (3, 20), (4, 60)])
def test_history(spark, seed, heavy_rows):
    rows = feed(seed)
    found = [tuple(r) for r in attribute_history(spark.createDataFrame(rows, SCHEMA), heavy_rows).collect()]
    assert len(found) == len(set(found))
    assert set(found) == versions(rows)


def test_history_crosses_words_of_bits(spark):
    rows = [(i, i, "Q1", "P1", "A", "A", "updated", f"2025-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "", "") for i in range(200)]
    assert {tuple(r) for r in attribute_history(spark.createDataFrame(rows, SCHEMA)).collect()} == versions(rows)


@pytest.mark.parametrize("seed", [5, 6])
def test_medians(spark, seed):
    rows = feed(seed)
    expected = set()
    for place, field in enumerate(("entity_id", "property_id")):
        by: dict[str, list] = {}
        for key, changes in ordered(rows).items():
            by.setdefault(key[place], []).extend(c[:2] for c in changes)
        expected |= {(field, k, len(v), sorted(v)[math.ceil(len(v) / 2) - 1][1]) for k, v in by.items()}
    assert {tuple(r) for r in key_medians(spark.createDataFrame(rows, SCHEMA)).collect()} == expected


def test_medians_over_days_and_revisions_of_several_properties(spark):
    rows = [(i, i // 2, "Q1", f"P{i % 2}", "A", "B", "updated", f"2025-01-{1 + i // 4:02d}T00:00:00Z", "", "") for i in range(40)]
    found = {(r.key_field, r.key_id): (r.n_changes, r.mid_revid) for r in key_medians(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {("entity_id", "Q1"): (40, 9), ("property_id", "P0"): (20, 9), ("property_id", "P1"): (20, 9)}


def test_modes(spark):
    rows = feed(7)
    by: dict[str, Counter] = {}
    for row in rows:
        by.setdefault(row[3], Counter())[row[5]] += 1
    found = {r.key_id: (r.n_rows, r.n_distinct, r.mode_value, r.mode_rows) for r in key_modes(spark.createDataFrame(rows, SCHEMA), "property_id", "new_value").collect()}
    assert found == {k: (sum(c.values()), len(c), min(v for v, n in c.items() if n == max(c.values())), max(c.values())) for k, c in by.items()}


@pytest.mark.parametrize("seed", [8, 9])
def test_current_state(spark, seed):
    rows = feed(seed)
    expected = {(*key, c[-1][3]) for key, c in ordered(rows).items() if c[-1][4] != "deleted"}
    assert {tuple(r) for r in current_state(spark.createDataFrame(rows, SCHEMA), buckets=4).collect()} == expected


def test_current_state_compacts(spark, monkeypatch):
    compacted, compact = [], MergeTree.compact
    monkeypatch.setattr(MergeTree, "compact", lambda tree, level: (compacted.append((level, len(tree.levels[level]))), compact(tree, level)))
    rows = feed(10)
    expected = {(*key, c[-1][3]) for key, c in ordered(rows).items() if c[-1][4] != "deleted"}
    assert {tuple(r) for r in current_state(spark.createDataFrame(rows, SCHEMA), buckets=4).collect()} == expected
    assert compacted == [(0, 10), (0, 6)]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_tree_compacts_keeps_tombstones_and_reopens(spark):
    rows = feed(10)
    expected = {(*key, c[-1][3]) for key, c in ordered(rows).items() if c[-1][4] != "deleted"}
    path = scratch_path(spark, "test")
    tree = MergeTree(spark, path, buckets=3, fanout=2)
    changes = normal_changes(spark.createDataFrame(rows, SCHEMA))
    for i in range(5):
        tree.append(changes.where(F.col("feed_pos") % 5 == i), batch=i)
        tree.append(changes, batch=i)  # played again: it is there already
        tree = MergeTree(spark, path)  # opened anew
    assert (tree.buckets, tree.fanout, tree.batch) == (3, 2, 4) and 1 < sum(map(len, tree.levels.values())) < 5
    assert {tuple(r) for r in tree.read().collect()} == expected
    plan = final_plan(tree.read())
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    folder = path.removeprefix("file://")
    assert len([n for n in os.listdir(folder) if n.startswith("manifest")]) <= 2
    tree.drop()
    assert not os.path.exists(folder)


def test_a_stream_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    rows = feed(12)
    pages = tmp_path / "pages"
    for i in range(6):
        spark.createDataFrame([r for r in rows if r[0] % 6 == i], SCHEMA).coalesce(1).write.mode("append").parquet(str(pages))
    expected = {(*key, c[-1][3]) for key, c in ordered(rows).items() if c[-1][4] != "deleted"}
    schema, save, calls = spark.read.parquet(str(pages)).schema, MergeTree._save, []

    def fail_after_third(tree):
        calls.append(1)
        save(tree)
        if len(calls) == 3:
            raise RuntimeError("executor lost")

    monkeypatch.setattr(MergeTree, "_save", fail_after_third)
    with pytest.raises(Exception, match="executor lost"):
        stream_state(spark, str(pages), schema, 1, f"file://{tmp_path}/state", fanout=3)
    monkeypatch.setattr(MergeTree, "_save", save)
    tree = stream_state(spark, str(pages), schema, 1, f"file://{tmp_path}/state")
    assert tree.fanout == 3 and tree.batch == 5
    assert {tuple(r) for r in tree.read().collect()} == expected


def test_newest_change_over_a_stream_of_several_batches(spark, tmp_path):
    rows = feed(13)
    for i in range(4):
        spark.createDataFrame([r for r in rows if r[0] % 4 == i], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
    found = stream_latest(spark, str(tmp_path), spark.read.parquet(str(tmp_path)).schema, 1).collect()
    best = {}
    for row in rows:
        (key, c), = ordered([row]).items()
        best[key[0]] = max(best.get(key[0], (0,)), (c[0][0], c[0][1], key[1], -row[0], c[0][3]))
    assert {r.entity_id: r.new_value for r in found} == {k: v[-1] for k, v in best.items()}


ODD = [
    (1, 1, None, "P1", None, "A", "updated", "2025-01-01T00:00:00Z", "", ""),
    (2, None, "Q1", None, "A", None, None, "2025-01-01T00:00:01Z", "", ""),
    (3, 3, "Q1", "P1", "", "x" * 100_000, "created", "2025-01-01T00:00:02Z", "", ""),
    (4, 4, "Q2", "P1", "A", "B", "updated", "no time", "", ""),
    (5, 5, "Q2", "P1", "A", "B", "updated", None, "", ""),
]


def test_nulls_long_values_and_unreadable_times(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    found = {(r.entity_id, r.property_id, (r.version_value or "")[:3], r.valid_from, r.valid_to) for r in attribute_history(df).collect()}
    assert found == {
        (None, "P1", "A", "2025-01-01T00:00:00Z", "open"),
        ("Q1", None, "A", "unknown", "2025-01-01T00:00:01Z"),
        ("Q1", "P1", "xxx", "2025-01-01T00:00:02Z", "open"),
        ("Q1", "P1", "", "unknown", "2025-01-01T00:00:02Z"),
    }
    medians = {(r.key_field, r.key_id): (r.n_changes, r.mid_revid) for r in key_medians(df).collect()}
    assert medians["entity_id", "Q2"] == (2, 4) and medians["entity_id", None] == (1, 1) and medians["property_id", "P1"] == (4, 5)
    state = {(r.entity_id, r.property_id): r.current_value for r in current_state(df, buckets=2).collect()}
    assert state["Q2", "P1"] == "B" and state[None, "P1"] == "A" and state["Q1", None] is None


def test_empty_feed(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert attribute_history(df).count() == key_medians(df).count() == key_modes(df, "entity_id", "new_value").count() == current_state(df, buckets=2).count() == 0


@pytest.mark.parametrize("text", ["2025-01-31T12:00:00Z", "2025-01-31 12:00:00Z", "2025-01-31T12:00:00.000Z", "2025-01-31T14:00:00+02:00", "2025-01-31T14:00:00+0200", "2025-01-31T07:00-05", "20250131T120000Z", "2025-01-31t12:00:00z", "2025-01-31T12:00:00,0Z", " 2025-01-31T12:00:00 "])
def test_spellings_of_an_instant(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(iso_text(instant_micros(F.col("t")))).first()[0] == "2025-01-31T12:00:00Z"


def test_instants_do_not_depend_on_the_zone_of_the_session(spark):
    texts = ["2025-03-30T02:30:00", "2025-03-30 02:30:00.5", "2025-03-30", "2025-03-09T02:30Z", "20250309T023000", "2025-11-02T01:30:00+00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(iso_text(instant_micros(F.col("t"))).alias("at"))
    expected = ["2025-03-30T02:30:00Z", "2025-03-30T02:30:00Z", "2025-03-30T00:00:00Z", "2025-03-09T02:30:00Z", "2025-03-09T02:30:00Z", "2025-11-02T01:30:00Z"]
    rows = feed(14)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/New_York", "Europe/Berlin", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert [r.at for r in df.collect()] == expected
            assert {tuple(r) for r in attribute_history(spark.createDataFrame(rows, SCHEMA)).collect()} == versions(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_heavy_keys_without_a_key_are_cut_too(spark):
    rows = [(p, r, None if e == "Q0" else e, *rest) for p, r, e, *rest in feed(15)]
    expected = {tuple(r) for r in attribute_history(spark.createDataFrame(rows, SCHEMA)).collect()}
    cut = heavy_keys(normal_changes(spark.createDataFrame(rows, SCHEMA)), ("entity_id", "property_id"), "at", heavy_rows=30, pieces=8)
    assert cut.table.where("entity_id is null").count()
    assert {tuple(r) for r in attribute_history(spark.createDataFrame(rows, SCHEMA), 30).collect()} == expected


def test_heavy_keys_are_cut(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("at"))
    heavy = heavy_keys(df, ("k",), "at", heavy_rows=100, pieces=8)
    cut = heavy.cut(df, "at")
    sizes = [r["count"] for r in cut.where("heavy").groupBy("piece").count().collect()]
    assert heavy.count == 1 and len(sizes) == 8 and max(sizes) < 600
    assert cut.where("not heavy and piece <> 0").count() == 0 and cut.count() == 10_000
