"""Encoding of a corpus by a public byte-level BPE vocabulary.

Texts are split by the vocabulary's pattern. The distinct pieces of a batch are put into numpy matrices, one per
length class, padded with -1, a row per piece, and merged together: each round every row merges its pairs of minimum rank
from the left (where no pair of the joined token ranks before it, so that the next leftmost one would be of the same rank; else the
leftmost pair alone), the row closes up, and rows without a pair left leave the matrix. Pair ranks come from an open-addressed hash table in two arrays; after a merge only the
new pairs of a row are looked up. Pieces of any length go this way: a row takes as many rounds as it has different ranks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandline.llm.lookup import Lookup

#: Fixed value: where the public vocabularies lie, and the one that p6_ids encodes by.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NO_RANK = np.int32(2**31 - 1)
#: Cells of a matrix at most, or one row.
CELLS = 4_000_000
#: Distinct pieces that a task keeps encoded; beyond it starts anew.
KEPT_PIECES = 400_000


@dataclass
class Vocabulary:
    """Ids of the single bytes, and the pairs left << 32 | right with the rank (= id) of the joined token."""

    pattern: str
    of_byte: np.ndarray
    pairs: Lookup
    ranks: np.ndarray
    #: Whether a token, by rank, has a pair that ranks before it, so that its pairs have to be joined one at a time.
    early: np.ndarray

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK where the pair is no token or one of it is padding."""
        key = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        found = np.full(len(key), NO_RANK, np.int32)
        whole = np.flatnonzero((left >= 0) & (right >= 0))
        place = self.pairs.find(key[whole])
        found[whole[place >= 0]] = self.ranks[place[place >= 0]]
        return found


def read_vocabulary(path: str = TOKENIZER, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file: a base64 token and its rank per line."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[(left << 32) | right] = rank
    keys, values = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
    of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    early = np.zeros(max(ranks.values()) + 1, bool)
    early[left[values < left]] = True
    early[right[values < right]] = True
    return Vocabulary(pattern, of_byte, Lookup(keys), values, early)


def merge_matrix(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merges all rows of a matrix of byte ids, padded with -1; gives the merged matrix and the rows' lengths."""
    done = np.full_like(ids, -1)
    rows, live = np.arange(len(ids)), ids.copy()
    ranks = np.full(live.shape, NO_RANK, np.int32)
    ranks[:, :-1] = vocabulary.lookup(live[:, :-1].ravel(), live[:, 1:].ravel()).reshape(len(live), -1)
    while len(rows):
        least = ranks.min(axis=1)
        open_ = least != NO_RANK
        if not open_.all():
            done[rows[~open_], : live.shape[1]] = live[~open_]
            rows, live, ranks, least = rows[open_], live[open_], ranks[open_], least[open_]
            if not len(rows):
                break
        at = ranks == least[:, None]
        columns = np.arange(live.shape[1])
        alone = vocabulary.early[least]
        if alone.any():
            at[alone] = columns == at[alone].argmax(axis=1)[:, None]
        if (at[:, 1:] & at[:, :-1]).any():  # of pairs that overlap every second one, from the left
            begins = at.copy()
            begins[:, 1:] &= ~at[:, :-1]
            at &= (columns - np.maximum.accumulate(np.where(begins, columns, 0), axis=1)) % 2 == 0
        live = np.where(at, least[:, None], live)
        keep = live >= 0
        keep[:, 1:] &= ~at[:, :-1]
        new_pair = at.copy()
        new_pair[:, :-1] |= at[:, 1:]
        # The rows close up.
        count = keep.sum(axis=1)
        row = np.repeat(np.arange(len(rows)), count)
        column = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        closed, closed_ranks = np.full((len(rows), count.max()), -1, np.int32), np.full((len(rows), count.max()), NO_RANK, np.int32)
        closed[row, column], closed_ranks[row, column] = live[keep], ranks[keep]
        changed = new_pair[keep]
        row, column = row[changed], column[changed]
        inside = column + 1 < closed.shape[1]
        found = np.full(len(row), NO_RANK, np.int32)
        found[inside] = vocabulary.lookup(closed[row[inside], column[inside]], closed[row[inside], column[inside] + 1])
        closed_ranks[row, column] = found
        live, ranks = closed, closed_ranks
    return done, (done >= 0).sum(axis=1)


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces one after the other, and where each piece's ids begin (with the end of the last one)."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    lengths = np.zeros(len(pieces), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    low, high = 0, 4
    while low < sizes.max(initial=0):
        chosen = np.flatnonzero((sizes > low) & (sizes <= high))
        for block in np.array_split(chosen, max(1, len(chosen) * high // CELLS)):
            if len(block):
                n = sizes[block]
                flat = np.frombuffer(b"".join([pieces[i] for i in block]), np.uint8)
                matrix = np.full((len(block), int(n.max())), -1, np.int32)
                matrix[np.arange(matrix.shape[1]) < n[:, None]] = vocabulary.of_byte[flat]
                merged, lengths[block] = merge_matrix(matrix, vocabulary)
                parts.append((np.repeat(block, lengths[block]), merged[merged >= 0]))
        low, high = high, high * 2
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if not parts:
        return np.zeros(0, np.int32), starts
    owner, flat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return flat[np.argsort(owner, kind="stable")].astype(np.int32), starts


class Encoder:
    """Encodes batches of texts and keeps the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids begin (with the end of the last one)."""
        if len(self.number) > KEPT_PIECES:
            self._forget()
        number, known = self.number, len(self.number)
        uses, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                uses.append(np.array([number.setdefault(piece, len(number)) for piece in self.find(text)], np.int64))
                counts[i] = len(uses[-1])
        if len(number) > known:
            fresh = [piece.encode() for piece in list(number)[known:]]
            flat, starts = encode_pieces(fresh, self.vocabulary)
            self.flat, self.starts = np.concatenate([self.flat, flat]), np.concatenate([self.starts, starts[1:] + self.starts[-1]])
        used = np.concatenate(uses) if uses else np.zeros(0, np.int64)
        begin, length = self.starts[used], self.starts[used + 1] - self.starts[used]
        ends = np.cumsum(length)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + length, length)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, offsets


def token_ids(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id_column, ids array<int>): the ids of every text by the vocabulary at `path`, without special tokens.

    A NULL or empty text has the empty list. Every row is kept, equal ids too; other columns are left out. The file is read on
    the driver and its tables (about 10 MB, by the vocabulary's size) go to the workers.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    id_type = df.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_column, "ids"])

    return df.select(id_column, text_column).mapInArrow(encode, f"`{id_column}` {id_type}, ids array<int>")
