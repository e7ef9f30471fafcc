"""Operators over texts, against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import itertools
import math
import random
from pathlib import Path

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

from strandline.llm import bpe, languages, leakage, near, pairs
from strandline.llm.lookup import Lookup
from pyspark.sql import functions as F

ODD = [None, "", " ", "\n\n", "x" * 3000, "ä" * 700, "的" * 600, "​", "a b  c   d", "don't I'LL", "１２3 ½", "🙂👩‍🔬 é", "<|endoftext|>", "\t\r\n mixed 　 blanks "]


def test_lookup_finds_exactly_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 10**6, 20_000).astype(np.uint64))
    asked = np.arange(0, 10**6, 7).astype(np.uint64)
    found = Lookup(keys).find(asked)
    assert ((found >= 0) == np.isin(asked, keys)).all() and (keys[found[found >= 0]] == asked[found >= 0]).all()
    assert (Lookup(keys[:0]).find(asked) == -1).all()


@pytest.fixture(scope="module")
def reference():
    with open(bpe.TOKENIZER, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_ids_are_those_of_the_public_tokenizer(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(ODD + ["".join(random.Random(i).choices("ab cdé1.\n的", k=i % 60)) for i in range(300)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = {r.doc_id: r.ids for r in bpe.token_ids(docs).collect()}
    assert found == {i: reference.encode_ordinary(t or "") for i, t, _ in rows}
    assert bpe.token_ids(docs.limit(0)).count() == 0


def test_ids_decode_to_the_text(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(reference.decode(r.ids) == (texts[r.doc_id] or "") for r in bpe.token_ids(docs).collect())


def test_pieces_of_any_length_go_through_the_matrices(reference):
    v, r = bpe.read_vocabulary(), random.Random(4)
    assert 0 < v.early.mean() < 0.5
    texts = ["abab" * 300, "ü" * 400, "the quick".replace(" ", "") * 50, "a" * 20_001, "aab" * 5000, "".join(r.choices("abcdeé的", k=30_000)), "".join(r.choices("xy", k=513))]
    flat, starts = bpe.encode_pieces([t.encode() for t in texts], v)
    for i, text in enumerate(texts):
        assert flat[starts[i] : starts[i + 1]].tolist() == reference._encode_single_piece(text.encode()), i
    single = bpe.Vocabulary(v.pattern, v.of_byte, v.pairs, v.ranks, np.ones_like(v.early))  # one pair a round
    assert bpe.encode_pieces([t.encode() for t in texts[:3]], single)[0].tolist() == flat[: starts[3]].tolist()


def leaks(docs, items):
    def runs(text):
        w = leakage.words(text)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    return {(d, i) for d, a in docs for i, b in items if runs(a) & runs(b)}


@pytest.mark.parametrize("limit", [10**9, 700])
def test_leaks(spark, limit):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([5, 12, 40])))) for i in range(20)] + [(90, None), (91, ""), (92, "Ünïcode Straße " * 8)]
    docs = []
    for i in range(200):
        words = text(r.randrange(60))
        source = items[r.randrange(20)][1].split()
        span = r.choice([10, 11, 12, 13, 20])
        at = r.randrange(max(1, len(source) - span))
        words[len(words) // 2 : len(words) // 2] = source[at : at + span]
        docs.append((i, r.choice([" ", ", ", " _- "]).join(words).upper()))
    docs += [(None, items[2][1]), (900, None), (901, ""), (902, "x " * 20_000), (903, "ünïcode, STRASSE! straße " * 9)]
    found = leakage.leaked_items(spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=limit)
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == leaks(docs, items)


def test_every_shared_span_has_a_shared_fingerprint():
    r = np.random.default_rng(5)
    for _ in range(200):
        span = r.integers(0, 50, 12)
        a, b = (np.concatenate([r.integers(0, 50, r.integers(0, 30)), span, r.integers(0, 50, r.integers(0, 30))]) for _ in range(2))
        x, y = (set(leakage.winnow(t, np.ones(len(t), bool))[1].tolist()) for t in (a, b))
        assert x & y


def edited(r, text):
    words = text.split()
    for _ in range(r.randrange(4) if len(words) > 4 else 0):
        i = r.randrange(len(words))
        words[i : i + 1] = r.choice([[], [words[i], "extra"], [words[i][::-1]], [words[i], words[i]]])
    return " ".join(words) or "none"


def likeness_pairs(normal):
    out = set()
    for (i, a), (j, b) in itertools.combinations(normal.items(), 2):
        x, y = near.grams(a), near.grams(b)
        if x and y and len(x & y) >= 0.65 * len(x | y):
            out.add((i, j))
    return out


@pytest.mark.parametrize("plan", [*near.PLANS, near.Plan(0.5, 2)])
def test_near_duplicates_miss_no_pair(spark, plan):
    r = random.Random(plan.depth)
    base = ["Which river flows past the town of {} and {}?".format(*("".join(r.choices("abcdefgh", k=7)) for _ in range(2))) for _ in range(40)]
    base += ["".join(r.choices("abc", k=n)) for n in (4, 5, 6, 7, 8, 9, 12, 15, 20)] + [" ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n)) for n in (40, 200)]
    texts = base + [edited(r, r.choice(base)) for _ in range(120)] + ["", "ab", "abcd", "ABCD!", "x" * 5000, "x" * 5000 + "y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, texts[0])]
    expected = likeness_pairs({i: " ".join(__import__("re").findall(r"[^\W_]+", t.lower())) for i, t in rows if t and i is not None})
    df = spark.createDataFrame(rows, "qa_id bigint, question string")
    members = near._members(df, "qa_id", "question").where("row_id is not null")
    distinct = near._texts(members)
    ids = {}
    for m in members.join(distinct, "text").collect():
        ids.setdefault(m.id, []).append(m.row_id)
    for tile in (near.TILE, 2):  # whole buckets, and all of them cut into tiles
        found = {tuple(sorted((i, j))) for r in near.alike_texts(distinct, plan=plan, tile=tile).collect() for i in ids[r.a] for j in ids[r.b]}
        found |= {p for v in ids.values() for p in itertools.combinations(sorted(v), 2)}
        assert found == expected
    if plan == near.PLANS[0]:
        assert {tuple(r) for r in near.near_duplicate_pairs(df).collect()} == expected
        classes = {r.qa_id: r for r in near.near_duplicate_classes(df).collect()}
        assert all(classes[i].class_id == min(v) for v in ids.values() for i in v)
        assert near.near_duplicate_pairs(df.limit(0)).count() == near.near_duplicate_classes(df.limit(0)).count() == 0


def test_near_duplicates_are_shuffled_in_parts(spark, tmp_path):
    """The rows of the tables go by parts, each key in one, and no part's shuffle files outlast it."""
    r = random.Random(3)
    texts = {i: f"which {r.choice(['river', 'lake', 'town'])} lies near {''.join(r.choices('abcdefgh', k=7))} and {''.join(r.choices('abcdefgh', k=7))}" for i in range(300)}
    texts |= {1000 + i: texts[i] + "s" for i in range(0, 300, 3)}
    flat, size = near.gram_hashes(list(texts.values()))
    often = np.zeros(1 << near.SLOT_BITS, np.int32)
    for plan in near.PLANS:
        whole = sorted(zip(*near.text_keys(flat, size, often, plan, near.LIKENESS)))
        parts = [list(zip(*near.prefix_keys(*near.prefixes(flat, size, often, plan, near.LIKENESS), size, plan, near.LIKENESS, part, 5))) for part in range(5)]
        assert sorted(k for p in parts for k in p) == whole and max(map(len, parts)) < 0.4 * len(whole)
    assert near.part_count(10**7, 10**6) == 3 and near.part_count(10**9, 10**9) == 16 and near.part_count(0, 0) == 1

    def shuffled():
        return {p.name for p in Path(spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())).glob("../blockmgr-*/*/shuffle_*.data")}

    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    before = shuffled()
    found = near.alike_texts(df, part_least=300_000)
    assert not shuffled() - before
    assert {tuple(sorted(x)) for x in found.collect()} == likeness_pairs(texts)


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near, "_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(3)) * 1024)
    texts = {i: f"which river flows past the town of {'abcdefghijkl'[i // 2] * 9}{i % 2}" for i in range(24)} | {50: "something else altogether"}
    df = spark.createDataFrame(list(texts.items()), "qa_id bigint, question string")
    assert {tuple(r) for r in near.near_duplicate_pairs(df).collect()} == likeness_pairs(texts)


def test_hashes_of_grams_are_those_of_each_text_alone():
    texts = ["abcd", "", "abc", "abcdabcdabcd", "🙂é的xyz", "x" * 900]
    flat, size = near.gram_hashes(texts)
    assert size.tolist() == [len(near.grams(t)) for t in texts]
    for text, part in zip(texts, np.split(flat, np.cumsum(size)[:-1])):
        assert (part == near.gram_hashes([text])[0]).all()


def test_comparisons_are_few(spark):
    """Over the questions of sf0.01: rows per text, and comparisons as a share of all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.01/demo.parquet")
    texts = near._texts(near._members(df, "qa_id", "question"))
    often, (hashes, size) = near.gram_counts(texts), near.gram_hashes([r.text for r in texts.collect()])
    keys, _ = near.text_keys(hashes, size, often, near.PLANS[0], near.LIKENESS)
    _, n = np.unique(keys, return_counts=True)
    all_pairs = len(size) * (len(size) - 1) / 2
    print(f"{len(keys) / len(size):.0f} rows a text, {(n * (n - 1) / 2).sum() / all_pairs:.4f} comparisons a pair of texts")
    assert (n * (n - 1) / 2).sum() < 0.1 * all_pairs


def test_classes_have_every_row(spark):
    rows = [(5, "Who"), (3, "who?"), (9, "Qué"), (7, None), (8, None), (4, "?"), (2, " "), (None, "Who"), (None, "Wer"), (11, "Which river?"), (10, "which river"), (12, "Which river")]
    found = near.near_duplicate_classes(spark.createDataFrame(rows, "qa_id bigint, question string")).collect()
    assert {tuple(r) for r in found if r.qa_id is None} == {(None, 3, 0), (None, None, 0)}
    assert sorted(tuple(r) for r in found if r.qa_id is not None) == [(2, 2, 0), (3, 3, 0), (4, 2, 0), (5, 3, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (10, 10, 0), (11, 10, 0), (12, 10, 0)]


@pytest.mark.parametrize("plan", near.PLANS)
def test_covering_masks_cover_every_pair_within_the_radius(plan):
    r = np.random.default_rng(2)
    often = r.integers(0, 50, 1 << near.SLOT_BITS).astype(np.int32)
    for _ in range(300):
        a = int(r.integers(1, 150))
        x = np.unique(r.integers(0, 2**63, a).astype(np.uint64))
        # as many shared grams as just suffice, by dropping and adding
        drop = int(r.integers(0, math.floor(0.35 * len(x)) + 1))
        more = max(0, math.floor((len(x) - drop) / 0.65 - len(x) + 1e-9))
        y = np.unique(np.concatenate([x[r.permutation(len(x))[drop:]], r.integers(2**63, 2**64 - 1, int(r.integers(0, more + 1)), dtype=np.uint64)]))
        if len(np.intersect1d(x, y)) >= 0.65 * len(np.union1d(x, y)):
            assert np.intersect1d(*(near.text_keys(h, np.array([len(h)]), often, plan, near.LIKENESS)[0] for h in (x, y))).size


HELD_OUT = {
    "en": "The committee will meet again next week because several members were ill. They have not decided anything about the old bridge yet.",
    "de": "Der Ausschuss trifft sich nächste Woche wieder, weil mehrere Mitglieder krank waren. Über die alte Brücke haben sie noch nichts entschieden.",
    "fr": "Le comité se réunira de nouveau la semaine prochaine parce que plusieurs membres étaient malades. Ils n'ont encore rien décidé pour le vieux pont.",
    "es": "El comité se reunirá de nuevo la próxima semana porque varios miembros estaban enfermos. Todavía no han decidido nada sobre el viejo puente.",
    "it": "Il comitato si riunirà di nuovo la prossima settimana perché diversi membri erano malati. Non hanno ancora deciso nulla sul vecchio ponte.",
    "pt": "A comissão vai reunir-se de novo na próxima semana porque vários membros estavam doentes. Ainda não decidiram nada sobre a velha ponte.",
    "nl": "De commissie komt volgende week weer bijeen omdat verschillende leden ziek waren. Over de oude brug hebben ze nog niets besloten.",
    "sv": "Kommittén träffas igen nästa vecka eftersom flera ledamöter var sjuka. De har inte bestämt något om den gamla bron ännu.",
    "ru": "Комитет снова соберётся на следующей неделе, потому что несколько членов болели. О старом мосте они ещё ничего не решили.",
    "ja": "委員会は来週また集まります。何人かの委員が病気だったからです。古い橋についてはまだ何も決まっていません。",
}


def test_languages(spark):
    docs = [(i, t, None) for i, t in enumerate(HELD_OUT.values())]  # without a label they are held out
    docs += [(20, HELD_OUT["en"] + "\n\n" + HELD_OUT["sv"], "??"), (21, HELD_OUT["fr"], "EN-gb"), (22, HELD_OUT["nl"], "dut"), (23, HELD_OUT["it"], "unknown"), (24, HELD_OUT["de"], None)]
    docs += [(None, HELD_OUT["en"], "de"), (30, None, "en"), (31, " \n", "en"), (32, "SELECT ?x WHERE { ?x wdt:P1 wd:Q2 . }\nhttps://a.example/b?c=d\n0af3", None), (33, HELD_OUT["en"] + ' See also "Die Geschichte von Bonn", a work by Meier.', "en")]
    learn_from = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang")
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, lang string, label string")
    found = languages.language_segments(df.select("doc_id", "text", "lang").unionAll(learn_from)).where("doc_id < 1000").collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.segment_no)):
        by.setdefault(r.doc_id, []).append(r.segment_lang)
        assert 0.5 < r.confidence <= 1
    assert by == {**{i: [k] for i, k in enumerate(HELD_OUT)}, 20: ["en", "sv"], 21: ["fr"], 22: ["nl"], 23: ["it"], 24: ["de"], 33: ["en"]}
    wrong = {r.doc_id for r in languages.mislabelled_segments(df.select("doc_id", "text", "lang").unionAll(learn_from)).collect()}
    assert None in wrong and {d for d in wrong if d is not None and d < 1000} == {*range(10), 20, 21, 23, 24}
    assert languages.mislabelled_segments(df.limit(0)).count() == 0


def test_kept_trees_say_the_same_of_a_text_beside_any_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = languages.Trees.load(languages.learn(docs, "doc_id", "text", "lang").dump())
    alone = spark.createDataFrame([(1, HELD_OUT["sv"] + "\n\n" + HELD_OUT["pt"], "en")], "doc_id bigint, text string, lang string")
    found = [languages.language_segments(df, trees=trees).where("doc_id = 1").orderBy("segment_no").collect() for df in (alone, alone.unionAll(docs.select("doc_id", "text", "lang").where("doc_id > 1")))]
    assert found[0] == found[1] and [r.segment_lang for r in found[0]] == ["sv", "pt"]


def test_code_length_is_that_of_the_counts():
    trees = languages.Trees({"a": ["abab"], "b": ["b"]})
    # After "\n" of order 4 on: "a" was met once after the start, of one kind: 1 / 2 in the longest context.
    assert trees.bits(["a"])[0, 0] == pytest.approx(1.0)
    # b's tree escapes from every context it knows: five of them met one byte of one kind, the empty one too; then 8 bits.
    assert trees.bits(["a"])[0, 1] == pytest.approx(5 * 1 + 8)


PAIRS = [
    ("Which river crosses Tolbru Haneck?", None, "empty"), ("Which river crosses Tolbru Haneck?", " ​", "empty"), ("Which river crosses Tolbru Haneck?", "N/A", "empty"),
    ("Which river crosses Tolbru Haneck?", "<answer></answer>", "empty"), ("Which river crosses Tolbru Haneck?", "The answer is Mosel, as recorded in the old", "truncated"),
    ("Which river crosses Tolbru Haneck?", "I'm sorry, but I can't help with that.", "refusal"), ("Which river crosses Tolbru Haneck?", "Hello! I cannot answer this question.", "refusal"),
    ("Which river crosses Tolbru Haneck?", "which river crosses tolbru haneck", "copy"), ("Which river crosses Tolbru Haneck?", "You asked: Which river crosses Tolbru Haneck?", "copy"),
    ("Which river crosses the town of Tolbru Haneck?", "La respuesta es Mosel, como figura en el registro de Bonn.", "other_language"),
    ("Which river crosses Tolbru Haneck?", "Mosel", None), ("Which river crosses Tolbru Haneck?", "48213", None), ("Which river crosses Tolbru Haneck?", "The answer is Mosel", None),
    ("Which river crosses Tolbru Haneck?", "I am not fully certain, but the evidence points to Mosel.", None), ("Which river crosses Tolbru Haneck?", "You ask: Which river crosses Tolbru Haneck? The answer is Mosel.", None),
]


@pytest.fixture(scope="module")
def fitted_on(spark):
    d = "/root/testdata/sf0.01"
    return pairs.qa_pairs(spark.read.parquet(f"{d}/demo.parquet"), spark.read.parquet(f"{d}/eval_results.parquet"))


def test_pair_defects(spark, fitted_on):
    rows = [("own", i, p, r) for i, (p, r, _) in enumerate(PAIRS)] + [("own", 100, None, "Mosel"), ("own", 101, "", ""), ("own", None, "Who?", ""), ("own", 102, "Which river?", "word " * 30_000 + "end.")]
    df = spark.createDataFrame(rows, "item_table string, item_id bigint, prompt string, response string").unionAll(fitted_on)
    found = {r.item_id: r.defect for r in pairs.pair_defects(df).where("item_table = 'own'").collect()}
    assert found == {i: d for i, (_, _, d) in enumerate(PAIRS) if d} | {101: "empty", None: "empty"}
    assert pairs.pair_defects(fitted_on.limit(0)).count() == 0


def test_ends_are_counted_over_all_pairs(spark, fitted_on):
    """An ending too rare to be in the sample of the field is known from the rows outside it."""
    rows = [("own", i, f"Which river crosses Tolbru {i}?", f"Mosel is the answer, by the quillbook{'.' if i % 7 else ''}") for i in range(40)]
    own = spark.createDataFrame(rows, "item_table string, item_id bigint, prompt string, response string")
    sampled = {p for p, r in pairs._sample(own.unionAll(fitted_on), 1000) if "quillbook" in r}
    own = own.where(~F.col("prompt").isin(list(sampled)))
    assert not any("quillbook" in r for _, r in pairs._sample(own.unionAll(fitted_on), 1000)) and own.where("NOT endswith(response, '.')").count()
    assert pairs.pair_defects(own.unionAll(fitted_on), 1000).where("item_table = 'own'").collect() == []


def test_a_part_of_a_word_met_once_elsewhere_is_no_word(spark, fitted_on):
    rows = [("own", i, "Which river crosses Tolbru?", f"The answer is Mosel {i}, as recorded in the quillb") for i in range(3)]
    rows.append(("own", 9, "Which river has the quillb ook of Tolbru?", "Mosel"))
    own = spark.createDataFrame(rows, "item_table string, item_id bigint, prompt string, response string")
    found = pairs.pair_defects(own.unionAll(fitted_on)).where("item_table = 'own'").collect()
    assert {(r.item_id, r.defect) for r in found} == {(i, "truncated") for i in range(3)}


#: Refusals that the module doesn't have, and a response of each other kind made of a whole one.
DECLINED = ("I'd rather leave that for others to answer.", "Sorry, that is something I can't go into.", "I have nothing to say about this matter.", "We are not allowed to answer such questions.")


def planted(spark, fitted_on, n=400):
    """(prompt, response, defect) of whole responses of several words and of defects made of them."""
    r = random.Random(5)
    rows = [x for x in fitted_on.where("response rlike '^[A-Z].* .* .* .*[.]$' and prompt like 'W%?'").orderBy("item_table", "item_id").limit(4 * n).collect()]
    judged = {(x.item_table, x.item_id) for x in pairs.pair_defects(fitted_on).collect()}
    whole = [x for x in rows if (x.item_table, x.item_id) not in judged][:n]
    foreign = ["La réponse est {}, comme l'indique le registre.", "Die Antwort lautet {}, wie es im Verzeichnis steht.", "La respuesta es {}, como figura en el registro."]
    out = []
    for k, x in enumerate(whole):
        name = f"Tolb{k}ru".translate(str.maketrans("0123456789", "aeioubdgkl"))
        kind = k % 6
        if kind == 0:
            out.append((x.prompt, x.response, None))
        elif kind == 1:
            out.append((x.prompt, x.response.rstrip("."), None))
        elif kind == 2:
            words = x.response.split()
            cut = [i for i in range(2, len(words) - 1) if words[i][0].islower() and len(words[i]) > 4]
            out.append((x.prompt, " ".join(words[: cut[0]] + [words[cut[0]][:2]]) if cut else x.response, "truncated" if cut else None))
        elif kind == 3:
            out.append((x.prompt, r.choice(["{}", "{} {}", "Prompt: {}"]).replace("{}", x.prompt), "copy"))
        elif kind == 4:
            out.append((x.prompt, r.choice(foreign).format(name), "other_language"))
        else:
            out.append((x.prompt, r.choice(DECLINED), "refusal"))
    return out


def by_rules(parts, end):
    """What thresholds on the same measures and the words of REFUSING would say."""
    said = {w for own in pairs.REFUSING.values() for s in own for w in pairs.alnum.findall(s.lower())}
    if all(p.said >= 0.85 and p.repeats >= 0.4 for p in parts):
        return "copy"
    if parts[-1].end is True or isinstance(parts[-1].end, pairs.Ending) and end and end.n and end.share < 0.34:
        return "truncated"
    if any(p.foreign >= 1.2 for p in parts):
        return "other_language"
    if all(sum(w in said for w in p.shape[1:]) > 0.6 * len(p.shape[1:]) and not p.news for p in parts):
        return "refusal"
    return None


def test_the_field_decides_and_is_better_than_rules_on_its_measures(spark, fitted_on):
    rows = planted(spark, fitted_on)
    own = spark.createDataFrame([("own", i, p, r) for i, (p, r, _) in enumerate(rows)], "item_table string, item_id bigint, prompt string, response string")
    judge, ends = pairs.fit_judge(own.unionAll(fitted_on))
    keyed = own.withColumn("key", pairs._response_key()).join(ends, "key", "left").orderBy("item_id").collect()
    texts = [(r.prompt, pairs.readable(r.response)) for r in keyed]
    met = [pairs.End(r.known, r.open, r.share, r.n) if r.n is not None else None for r in keyed]
    found = judge.defects(texts, met)
    parts = pairs.described([(p, pairs.clauses(r)) for p, r in texts], judge.habits)
    rules = [by_rules(cs, e) for cs, e in zip(parts, met)]
    true = [d for _, _, d in rows]
    right = lambda said: sum(a == b for a, b in zip(said, true)) / len(true)
    differ = [(a, b, t) for a, b, t in zip(found, rules, true) if a != b]
    print(f"field {right(found):.3f}, rules {right(rules):.3f}; differ on {len(differ)} of {len(true)}, field right on {sum(a == t for a, _, t in differ)}, rules on {sum(b == t for _, b, t in differ)}")
    hits = sum(a == t for a, t in zip(found, true) if t)
    assert hits >= 0.97 * sum(t is not None for t in true) and hits >= 0.97 * sum(a is not None for a in found)
    assert differ and sum(a == t for a, _, t in differ) > 2 * sum(b == t for _, b, t in differ)
    off = pairs.Judge(judge.habits, pairs.ChainField(np.zeros_like(judge.field.weights), np.zeros_like(judge.field.steps)))
    assert not any(off.defects(texts, met))  # without the field nothing is found


def test_tails_are_counted_at_every_place():
    shapes = [["<", "a", "b"], ["<", "b"], ["<"], ["<", "c", "a", "b", "a", "b", "a", "b"]]
    tails = pairs.Tails()
    ends, passes = {}, {}
    for s in shapes:
        for i in range(1, len(s)):
            for n in range(1, min(pairs.TAIL, i + 1) + 1):
                into = ends if i == len(s) - 1 else passes
                into[tuple(s[i + 1 - n : i + 1])] = into.get(tuple(s[i + 1 - n : i + 1]), 0) + 1
    key = lambda t: int(list(tails.keys([list(t)]))[len(t) - 1][1][-1:].view(np.int64)[0])
    found = {r.tail: (r.ends, r.passes) for r in tails.counts(shapes, np.ones(1 << pairs.FILTER_BITS, bool)).itertuples()}
    assert found == {key(t): (ends.get(t, 0), passes.get(t, 0)) for t in {*ends, *passes}}
    assert len(tails.counts([], np.ones(1 << pairs.FILTER_BITS, bool))) == 0


def test_chain_field_learns_a_pattern():
    r = random.Random(0)
    chains, tags = [], []
    for _ in range(300):
        n = r.randrange(1, 5)
        tags.append([r.choice([pairs.ANSWER, pairs.REFUSAL]) for _ in range(n)])
        chains.append([[1, 10 + t, 20 + r.randrange(5)] for t in tags[-1]])
    field = pairs.ChainField.fit(chains, [[{t} for t in ts] for ts in tags])
    assert field.tag(chains) == tags and field.tag([]) == []


def test_the_field_and_the_trees_are_fitted_on_all_pairs(spark, fitted_on):
    """Every pair is among the examples, and shards that see a part each fit one field."""
    read = fitted_on.where("response rlike '[a-z]{3}'").select("prompt", "response")
    read = read.unionAll(read.selectExpr("prompt", "concat(response, ' Indeed.')")).unionAll(read.selectExpr("prompt", "concat(response, ' So it is.')")).na.drop()
    habits = pairs.Habits(pairs.Trees({k: [pairs.SEED[k], pairs.COMMON[k]] for k in pairs.LANGUAGES}))
    train = pairs._train(read, spark.sparkContext.broadcast(habits))
    assert train.count() == read.count() and {tuple(r) for r in train.select("prompt", "response").collect()} == {tuple(r) for r in read.collect()}
    r = random.Random(0)
    rows = []
    for key in range(900):
        tags = [r.choice([pairs.ANSWER, pairs.REFUSAL]) for _ in range(r.randrange(1, 5))]
        chain = [[1, 10 + t, 20 + r.randrange(5)] for t in tags]
        rows.append((key, np.full(len(tags), 3, np.int32).tobytes(), np.array(chain, np.uint16).tobytes(), bytes(1 << t for t in tags), None, None, None, None, None, None))
    made = spark.createDataFrame(rows, "key bigint, sizes binary, features binary, allowed binary, shape string, last string, known bigint, open bigint, share double, n bigint")
    chains, allowed = pairs._unpacked(made.toPandas())
    field = pairs.fit_field(made, 3, jobs=3, least_steps=600)
    assert field.tag(chains) == [[next(iter(t)) for t in tags] for tags in allowed]


def test_chain_field_learns_from_places_with_several_tags():
    """Half of the places say only what they may be; their features tell."""
    r = random.Random(1)
    true = [[r.choice([pairs.ANSWER, pairs.REFUSAL, pairs.ECHO]) for _ in range(r.randrange(1, 4))] for _ in range(400)]
    chains = [[[1, 10 + t, 20 + r.randrange(5)] for t in ts] for ts in true]
    allowed = [[{t} if r.random() < 0.5 else {t, pairs.FOREIGN, (t + 1) % 3} for t in ts] for ts in true]
    assert pairs.ChainField.fit(chains, allowed).tag(chains) == true
