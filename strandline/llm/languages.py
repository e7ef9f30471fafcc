"""Languages of documents and of their segments, by prediction by partial matching.

Per language a tree of byte contexts up to ORDER bytes is counted over labelled texts and frozen. The code length of a
byte is that of the longest context that knows it: -log2 c / (n + d), with log2 (n + d) / d for each longer context that
has to escape (n bytes seen in the context, d different ones, c times this one); below the empty context every byte costs
8 bits. The code lengths of all languages stand side by side in one row per (context, byte), so a byte costs one search in
a hash table, not one per language.

Texts are cut into sentences, each is given its code length by each language, and the cheapest sequence of languages
with a fixed cost per change (Viterbi) gives the segments.
"""

from __future__ import annotations

import io
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.lookup import Lookup

#: The languages and their two- and three-letter codes (ISO 639-1, 639-2/T, 639-2/B).
CODES = {
    "en": ("en", "eng"),
    "de": ("de", "deu", "ger"),
    "fr": ("fr", "fra", "fre"),
    "es": ("es", "spa"),
    "it": ("it", "ita"),
    "pt": ("pt", "por"),
    "nl": ("nl", "nld", "dut"),
    "sv": ("sv", "swe"),
    "ru": ("ru", "rus"),
    "ja": ("ja", "jpn"),
}
LANGUAGES = tuple(CODES)
#: Article 1 of the Universal Declaration of Human Rights, the first text that each language is learnt from.
SEED = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
}

#: Common words of each language, added to SEED.
COMMON = {
    "en": "the of and to in is was were that with which who for by its it has had from at this not been are their but when there after no who what which when where how many did does do as or be an he she they we you can about only both than my your our me us some any will would could",
    "de": "der die das und wurde nicht ist von mit den dem auf im ein eine einen seit zum zur hat sich auch nach wird war aus bei dass oder noch wer was welche welcher welches welchem wann wo wie viele durch über war wurden er sie es wir ihr kann nur als am",
    "fr": "le la les des est dans qui une un et aux été sur que pour par du au ne pas plus il elle ont avec cette son sa ses mais où quel quelle quels qui quand comment combien où dont a il elles nous vous peut comme entre fut était",
    "es": "el los las del fue una un que por en con se y la no su sus es más al lo como para pero entre también sin hasta desde donde qué quién quiénes cuál cuándo dónde cómo cuántos él ella nosotros ser fue era después antes sobre",
    "it": "il della che di fu gli non per una un dal con lo nel e la si le dei alla sono è stato più come anche ma nella delle questo dove chi quale quali quando dove come quanti che cosa lui lei noi può tra fu era dopo prima sul",
    "pt": "o os da do que uma um não em por com dos as ao se na no foi é mais das para como mas pela pelo também até entre onde quem qual quais quando onde como quantos que ele ela nós pode sobre era depois antes desde seu sua",
    "nl": "het de een van en werd niet dat met die voor naar is op in zijn aan er door als ook maar bij uit om wordt waren haar hun waar wie wat welke wanneer waar hoe veel hij zij wij je kan deze dit was na tot tussen onder",
    "sv": "och det en ett av som den är inte för på med till att har var de om från vid han hon sin men efter där när eller under vem vad vilken vilket när var hur många han vi ni kan denna detta blev mellan före över",
    "ru": "и в не на что был была было с по из как это его её они для от же к но у за так который при также год где кто что какой какая какие когда где сколько он она они мы вы может быть после до между",
    "ja": "は の を に が で と し た て いる ある から まで する れ も ない です ます その この という られ よう 誰 何 どこ いつ どの どちら いくつ 人 年 その後 として による",
}

WORDS_OF = {language: frozenset(words.split()) for language, words in COMMON.items()}

ORDER = 4
#: Labelled documents per language that the trees are counted over, and the length of those that may be taken.
SAMPLE_DOCS = 150
SAMPLE_CHARS = (80, 6000)
ROUNDS = 3
#: Bits that a change of language costs.
CHANGE_BITS = 25.0
BLOCK = 1 << 18


def label_language(lang: Column) -> Column:
    """The language that a label names: a two- or three-letter code in any case, with any region; else NULL."""
    code = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2,3})(?:[-_.@].*)?$", 1))
    named = F.create_map(*[F.lit(x) for language, codes in CODES.items() for c in codes for x in (c, language)])
    return F.try_element_at(named, code)


class Trees:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self._build(tuple(texts), [self.counts(t) for t in texts.values()])

    @classmethod
    def of_counts(cls, languages: tuple[str, ...], counted: list[tuple[np.ndarray, np.ndarray]]) -> Trees:
        """The trees of texts that were counted elsewhere: for each language what counts() gives."""
        trees = cls.__new__(cls)
        trees._build(languages, counted)
        return trees

    @classmethod
    def counts(cls, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all orders in texts, in order, and how often each is there."""
        run = cls._bytes(texts)
        return np.unique(np.concatenate([cls._keys(run, order) for order in range(ORDER + 1)]), return_counts=True)

    def _build(self, languages: tuple[str, ...], counted: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = languages
        n = len(self.languages)
        rows, contexts, self.row_bits, self.escape_bits = [], [], np.zeros((0, n), np.float32), np.zeros((0, n), np.float32)
        lower_keys, lower_bits = np.zeros(0, np.uint64), np.zeros((0, n), np.float32)
        for order in range(ORDER + 1):
            ends = [np.searchsorted(k, np.array([order, order + 1], np.uint64) << np.uint64(56)) for k, _ in counted]
            seen = [(k[a:b], c[a:b]) for (k, c), (a, b) in zip(counted, ends)]
            keys = np.unique(np.concatenate([k for k, _ in seen]))
            count = np.zeros((len(keys), n), np.float32)
            for i, (k, c) in enumerate(seen):
                count[np.searchsorted(keys, k), i] = c
            context, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), n), np.float32), np.zeros((len(context), n), np.float32)
            np.add.at(total, owner, count)
            np.add.at(kinds, owner, (count > 0).astype(np.float32))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0).astype(np.float32)
                own = np.log2((total + kinds)[owner] / count)
            if order:
                shorter = ((keys & np.uint64((1 << (8 * order)) - 1)) | np.uint64(order - 1) << np.uint64(56))
                below = lower_bits[np.searchsorted(lower_keys, shorter)]
            else:
                below = np.full((len(keys), n), 8, np.float32)
            bits = np.where(count > 0, own, escape[owner] + below).astype(np.float32)
            rows.append(keys)
            contexts.append(context)
            self.row_bits, self.escape_bits = np.concatenate([self.row_bits, bits]), np.concatenate([self.escape_bits, escape])
            lower_keys, lower_bits = keys, bits
        self.rows, self.contexts = Lookup(np.concatenate(rows)), Lookup(np.concatenate(contexts))

    def dump(self) -> bytes:
        """The trees as bytes, to keep them: what they say of a text then depends on no other text."""
        file = io.BytesIO()
        np.savez_compressed(file, languages=np.array(self.languages), rows=self.rows.given, contexts=self.contexts.given, row_bits=self.row_bits, escape_bits=self.escape_bits)
        return file.getvalue()

    @classmethod
    def load(cls, kept: bytes) -> Trees:
        trees = cls.__new__(cls)
        with np.load(io.BytesIO(kept)) as parts:
            trees.languages = tuple(parts["languages"].tolist())
            trees.row_bits, trees.escape_bits = parts["row_bits"], parts["escape_bits"]
            trees.rows, trees.contexts = Lookup(parts["rows"]), Lookup(parts["contexts"])
        return trees

    @staticmethod
    def _bytes(texts: list[str]) -> np.ndarray:
        return np.frombuffer(b"\n" * ORDER + "\n".join(map(plain, texts)).encode(), np.uint8).astype(np.uint64)

    @staticmethod
    def _keys(run: np.ndarray, order: int) -> np.ndarray:
        """order | the bytes of the context | the byte, for each byte after the first ORDER ones."""
        key = np.full(len(run) - ORDER, order, np.uint64) << np.uint64(56)
        for back in range(order, -1, -1):
            key |= run[ORDER - back : len(run) - back] << np.uint64(8 * back)
        return key

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text by each language."""
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        coded = [plain(text).encode() for text in texts]
        begin = 0
        while begin < len(coded):
            end, size = begin, 0
            while end < len(coded) and (end == begin or size + len(coded[end]) < BLOCK):
                size += len(coded[end]) + ORDER
                end += 1
            out[begin:end] = self._block_bits(coded[begin:end])
            begin = end
        return out

    def _block_bits(self, coded: list[bytes]) -> np.ndarray:
        pad = b"\n" * ORDER
        run = np.frombuffer(pad + pad.join(coded), np.uint8).astype(np.uint64)
        length = np.array([len(x) for x in coded])
        text = np.repeat(np.arange(len(coded)), length)
        place = np.arange(length.sum()) + text * ORDER  # of each byte among the keys
        out = np.zeros((len(coded), len(self.languages)))
        rest = np.arange(len(place))
        for order in range(ORDER, -1, -1):
            key = self._keys(run, order)[place[rest]]
            row = self.rows.find(key)
            known = row >= 0
            self._add(out, text[rest[known]], self.row_bits, row[known])
            rest = rest[~known]
            context = self.contexts.find(key[~known] >> np.uint64(8))
            self._add(out, text[rest[context >= 0]], self.escape_bits, context[context >= 0])
        np.add.at(out, text[rest], 8.0)
        return out

    @staticmethod
    def _add(out: np.ndarray, text: np.ndarray, table: np.ndarray, row: np.ndarray) -> None:
        if len(text):
            start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[start]] += np.add.reduceat(table[row], start, axis=0, dtype=np.float64)


digits = re.compile(r"\d+")


def plain(text: str) -> str:
    """What the trees see: lower case, numbers as one 0, white space as one blank."""
    return " ".join(digits.sub("0", text).lower().split())


tag = re.compile(r"</?[A-Za-z][^<>]{0,60}>|&[a-z]{2,6};|\[\d+\]|[​-‏﻿­]")
line_start = re.compile(r"^\s*(?:[-*>#|+]+|\(?\d{1,3}[.):])\s+")
sentence_end = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])[」』”]*\s*")
word_like = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*['’]?$")
kana = re.compile(r"[぀-ヿ㐀-鿿]")
ends = tuple(".!?…。！？")


def has_language(unit: str) -> bool:
    """Whether a sentence or line is in a language at all: enough lower-case words (or kana), and mostly words."""
    if len(kana.findall(unit)) >= 6:
        return True
    tokens = [t.strip("\"'“”„«»‹›()[]¿¡*_.,;:!?…—–-") if not t.startswith("?") else t for t in unit.split()]
    tokens = [t for t in tokens if t]
    alike = [t for t in tokens if word_like.match(t)]
    small = sum(1 for t in alike if t[0].islower())
    return small >= 3 and len(alike) * 2 > len(tokens) and "://" not in unit and "[[" not in unit and "{" not in unit


def sentences(text: str) -> list[tuple[str, bool]]:
    """The sentences of a text in order, and whether each is closed by a mark. Lines without any language are left out."""
    text = tag.sub(lambda m: "" if m[0][0] in "​‌‍‎‏﻿­" else " ", text)
    blocks: list[str] = []
    running = False
    for line in re.split(r"[\r\n  ]+", text):
        marked = line_start.match(line)
        line = (line[marked.end() :] if marked else line).strip()
        if not line:
            continue
        if running and not marked and blocks and (line[0].islower() or not line[0].isalpha()) and "://" not in line:
            blocks[-1] += " " + line
        else:
            blocks.append(line)
        running = not line.rstrip("\"'»”’)]").endswith(ends)
    out = []
    for block in blocks:
        for unit in sentence_end.split(block):
            unit = unit.strip()
            if unit and has_language(unit):
                out.append((unit, unit.rstrip("\"'»”’)]」』").endswith(ends)))
    return out


def common_words_language(unit: str) -> int:
    """The language whose common words a sentence has most of, by two at least and with no other like it; else -1."""
    if kana.search(unit):
        return LANGUAGES.index("ja")
    tokens = re.findall(r"[^\W\d_]+", unit.lower())
    hits = [sum(t in WORDS_OF[language] for t in tokens) for language in LANGUAGES]
    most = max(hits)
    return hits.index(most) if most >= 2 and hits.count(most) == 1 else -1


def best_path(bits: np.ndarray) -> list[int]:
    """The cheapest sequence of languages, with CHANGE_BITS per change."""
    cost, back = bits[0].copy(), []
    for row in bits[1:]:
        stay, change = cost, cost.min() + CHANGE_BITS
        back.append(np.where(stay <= change, np.arange(len(cost)), cost.argmin()))
        cost = np.minimum(stay, change) + row
    path = [int(cost.argmin())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def stretches(closed: list[bool], bits: np.ndarray) -> list[tuple[int, list[int]]]:
    """(language, sentences) of the stretches of a text. In a mixed text a stretch under two sentences is none."""
    path = best_path(bits)

    def runs(units: list[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for u in units:
            if out and path[out[-1][-1]] == path[u]:
                out[-1].append(u)
            else:
                out.append([u])
        return out

    found = runs(list(range(len(path))))
    while len(found) > 1:
        short = [r for r in found if len(r) < 2 and sum(closed[u] for u in r) < 2]
        if not short:
            break
        if len(short) == len(found):  # no stretch is long enough: the text's language is that of the whole
            return [(int(bits.sum(axis=0).argmin()), list(range(len(path))))]
        drop = min(short, key=len)
        found = runs([u for r in found if r is not drop for u in r])
    return [(path[r[0]], r) for r in found]


def segments(closed: list[bool], bits: np.ndarray) -> list[tuple[int, float]]:
    """(language, confidence) of the segments of a text."""
    return [(k, confidence(bits[r].sum(axis=0), k, len(r))) for k, r in stretches(closed, bits)]


def confidence(bits: np.ndarray, language: int, units: int) -> float:
    """The language's share when each language weighs 2 to the power of minus its code length, per five sentences' bits."""
    weight = np.exp2(-(bits - bits.min()) / (5.0 * units))
    return float(weight[language] / weight.sum())


def learn(docs: DataFrame, doc_id: str, text: str, lang: str, sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Trees of all languages, from SEED and at most sample_docs labelled documents of each language.

    Labels are counted over all rows; then documents are picked by a hash of their id. Many labels are wrong, so they only
    serve to pick documents of every language: the first trees know SEED and COMMON alone, and are counted again ROUNDS
    times over the sentences of the picked documents, as the trees of the other half of them assign them.
    """
    low, high = SAMPLE_CHARS
    labelled = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), label_language(F.col(lang)).alias("label")).where(
        F.col("label").isNotNull() & F.length("text").between(low, high)
    )
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(int(min(1.0, 2 * sample_docs / n) * (1 << 30)))) for k, n in counts.items()], F.lit(0))
    rows = labelled.where(draw < share).orderBy(draw, "doc_id").limit(3 * sample_docs * len(LANGUAGES)).select("label", "text").collect()
    taken: dict[str, int] = defaultdict(int)
    picked: list[list[tuple[str, bool]]] = []
    for row in rows:
        taken[row["label"]] += 1
        if taken[row["label"]] <= sample_docs and (units := sentences(row["text"])):
            picked.append(units)
    seeds = {k: [SEED[k], COMMON[k]] for k in LANGUAGES}
    given: list[list[int]] = [[] for _ in picked]

    def assign(members: range, trees: Trees) -> None:
        """Gives each sentence of the documents its language by the trees; a lone sentence is taken with what it follows."""
        bits, at = trees.bits([unit for m in members for unit, _ in picked[m]]), 0
        for m in members:
            units = picked[m]
            of = {u: k for k, run in stretches([c for _, c in units], bits[at : at + len(units)]) for u in run}
            given[m] = [of[max((x for x in of if x <= u), default=min(of))] for u in range(len(units))]
            at += len(units)

    def count(members: range) -> Trees:
        texts = {k: list(v) for k, v in seeds.items()}
        for m in members:
            for (unit, _), k in zip(picked[m], given[m]):
                texts[LANGUAGES[k]].append(unit)
        return Trees(texts)

    whole = range(len(picked))
    assign(whole, Trees(seeds))
    for _ in range(ROUNDS):  # each half by trees of the other one: a sentence that is in the trees would stay where it is
        halves = [range(h, len(picked), 2) for h in (0, 1)]
        trees = [count(h) for h in halves]
        for h in (0, 1):
            assign(halves[h], trees[1 - h])
    return count(whole)


def language_segments(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, trees: Trees | None = None
) -> DataFrame:
    """(doc_id, label, segment_no, segment_lang, confidence, mixed): the segments of every document that has a language.

    label is the language that `lang` names, NULL if none. Texts that are NULL, blank or without any language have no row; a NULL id stays NULL.
    `trees`: kept ones (Trees.load); without them they are learnt from the documents, and an answer depends on what these are. Empty input gives an empty result; rows of equal ids are documents of their own; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, doc_id, text, lang, sample_docs) if trees is None else trees)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.iloc[begin : begin + 500]
                cut = [sentences(t) if t else [] for t in part["text"]]
                bits = trees.bits([unit for units in cut for unit, _ in units])
                out, at = [], 0
                for row_id, label, units in zip(part["doc_id"], part["label"], cut):
                    if units:
                        found = segments([c for _, c in units], bits[at : at + len(units)])
                        out += [(row_id, label, i, trees.languages[k], c, len(found) > 1) for i, (k, c) in enumerate(found, 1)]
                    at += len(units)
                yield pd.DataFrame(out, columns=["doc_id", "label", "segment_no", "segment_lang", "confidence", "mixed"])

    schema = "doc_id string, label string, segment_no bigint, segment_lang string, confidence double, mixed boolean"
    ids = F.col(doc_id).cast("string").alias("doc_id")  # pandas has no NULL among whole numbers
    plain_docs = docs.select(ids, F.col(text).alias("text"), label_language(F.col(lang)).alias("label"))
    return plain_docs.where(F.col("text").isNotNull()).mapInPandas(assign, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def mislabelled_segments(docs: DataFrame, **columns) -> DataFrame:
    """(doc_id, segment_no, segment_lang) of the documents that mix languages or whose label is missing or wrong."""
    found = language_segments(docs, **columns)
    wrong = F.col("mixed") | F.col("label").isNull() | (F.col("label") != F.col("segment_lang"))
    return found.where(wrong).select("doc_id", "segment_no", "segment_lang")
