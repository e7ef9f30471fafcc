"""Evaluation passages inside a corpus, by winnowing.

A text is a run of lower-cased words. Of every WINDOW consecutive K-word grams the one of minimum hash (the rightmost of
equals) is a fingerprint, so two texts that share K + WINDOW - 1 = 12 consecutive words share a fingerprint inside
that passage. Fingerprints of corpus and items are joined; each hit is extended word by word to both sides and
counts if at least 12 words agree.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW = 6, 7
SPAN = K + WINDOW - 1
#: Characters of items that go to the workers at a time.
BLOCK_CHARS = 8_000_000
find_words = re.compile(r"[^\W_]+").findall
NOTHING = np.uint64(2**64 - 1)


def words(text: str | None) -> list[str]:
    return [w.lower() for w in find_words(text)] if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def winnow(ids: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of a run of word ids. Grams with an invalid word are none."""
    n = len(ids) - K + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = _mixed(ids.astype(np.uint64) + np.uint64(1))
    gram = np.zeros(n, np.uint64)
    for j in range(K):
        gram = gram * np.uint64(0x100000001B3) + word[j : j + n]
    gram = _mixed(gram)
    bad = np.concatenate([[0], np.cumsum(~valid)])
    gram[bad[K:] - bad[:-K] > 0] = NOTHING
    windows = np.lib.stride_tricks.sliding_window_view(gram, WINDOW)
    full = np.flatnonzero(windows.max(axis=1) != NOTHING)
    place = np.unique(full + WINDOW - 1 - windows[full, ::-1].argmin(axis=1))
    return place, gram[place]


class Items:
    """The items' words, numbered, and their fingerprints."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        self.text: list[np.ndarray] = []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in rows:
            run = np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int64)
            for place, gram in zip(*winnow(run, np.ones(len(run), bool))):
                places[int(gram)].append((len(self.ids), int(place)))
            self.ids.append(item_id)
            self.text.append(run)
        self.places = dict(places)
        self.grams = np.array(sorted(places), np.uint64)

    def agree(self, run: np.ndarray, at: int, item: int, place: int) -> bool:
        """Whether the words around a hit agree over SPAN words."""
        other = self.text[item]
        low = min(at, place, SPAN)
        high = min(len(run) - at, len(other) - place, SPAN)
        same = run[at - low : at + high] == other[place - low : place + high]
        broken = np.flatnonzero(~same)
        left = broken[broken < low]
        right = broken[broken >= low]
        return (right[0] if len(right) else low + high) - (left[-1] + 1 if len(left) else 0) >= SPAN

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(place in texts, item_id) of all leaks."""
        number, found = self.number, set()
        runs, starts, total = [], [], 0
        for text in texts:
            ids = [number.get(w, -1) for w in words(text)]
            starts.append(total)
            runs.append(ids + [-1])  # no gram crosses two texts
            total += len(ids) + 1
        run = np.fromiter((x for ids in runs for x in ids), np.int64, total)
        place, gram = winnow(run, run >= 0)
        hit = np.isin(gram, self.grams)
        for at, g in zip(place[hit].tolist(), gram[hit].tolist()):
            row = int(np.searchsorted(starts, at, side="right")) - 1
            for item, where in self.places[g]:
                if (row, item) not in found and self.agree(run, at, item, where):
                    found.add((row, item))
        return [(row, self.ids[item]) for row, item in sorted(found)]


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id): each pair of a document and an item whose texts share 12 consecutive words.

    Words are the maximal runs of letters and digits, lower-cased. NULL and short texts share nothing; a NULL id stays NULL. Rows of equal
    ids are documents or items of their own, so a pair of ids may come once for each. Other columns are ignored. Items are taken in blocks of about block_chars
    characters (by a hash of text and id; one longer item is a block), and documents are scanned once for each.
    """
    docs = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))  # pandas has no NULL among whole numbers
    items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = [_searched(docs, items.where(block == i)) for i in range(blocks)]
    return reduce(DataFrame.unionAll, found).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id"))


def _searched(docs: DataFrame, items: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in items.collect()]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                part = batch.iloc[begin : begin + 2000]
                pairs = shared.value.leaks(part["text"].tolist())
                if pairs:
                    ids = part["doc_id"].to_numpy()
                    yield pd.DataFrame({"doc_id": [ids[row] for row, _ in pairs], "item_id": [None if item is None else str(item) for _, item in pairs]})

    return docs.mapInPandas(search, "doc_id string, item_id string")
