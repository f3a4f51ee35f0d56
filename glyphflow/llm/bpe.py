"""Byte-level BPE over padded matrices.

Distinct pieces of a batch are bucketed by length and laid into one padded matrix a bucket. Each round looks every pair of
neighbours up in a hash table, merges each row's leftmost pair of least rank, moves the rest of the row up by one and lets
go of rows that have no pair left. Rounds over a very long piece would take time with the square of its length: from LONG bytes
its pairs wait in a heap by rank and place, over a list that shrinks, which merges the same pairs in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, tidy

NO_RANK = np.int32(2**31 - 1)
#: Cells of a matrix at most; pieces and their bytes of which a worker keeps the encoding; bytes from which a piece is merged by a heap.
CELLS, KEPT, KEPT_BYTES, LONG = 1 << 18, 100_000, 16_000_000, 512


class PairTable:
    """Open addressing: (left id, right id) to the id of both together."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NO_RANK, np.int32)
        keys, waiting, step = left.astype(np.int64) << 32 | right.astype(np.int64), np.arange(len(left)), 0
        slot = self.slot(keys)
        while len(waiting):
            at = (slot[waiting] + step) & (len(self.keys) - 1)
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            won = first[free[first]]
            self.keys[at[won]], self.ids[at[won]] = keys[waiting[won]], merged[waiting[won]]
            waiting = np.delete(waiting, won)
            step += 1
        self.steps = max(1, step)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.slot(keys)
        out, held = np.full(keys.shape, NO_RANK, np.int32), self.keys[at]
        hit = held == keys
        out[hit] = self.ids[at[hit]]
        open_ = np.flatnonzero(~hit & (held != -1))
        for step in range(1, self.steps):
            if not len(open_):
                break
            place = (at[open_] + step) & (len(self.keys) - 1)
            held = self.keys[place]
            hit = held == keys[open_]
            out[open_[hit]] = self.ids[place[hit]]
            open_ = open_[~hit & (held != -1)]
        return out


class Bpe:
    """Encodes and decodes by ranks: ids are the ranks, a merge's rank is the id that it makes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.words = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes((i,))] for i in range(256)], np.int32)
        pairs = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*pairs, strict=True)))
        self.known: dict[str, tuple[bytes, bytes, int]] = {}
        self.held = 0

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        sizes, order = np.array([len(p) for p in pieces], np.int64), None
        bucket = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1))), 0).astype(np.int64)
        for i in np.flatnonzero(sizes >= LONG).tolist():
            out[i] = self.merge_long(pieces[i])
        for b in np.unique(bucket[sizes < LONG]):
            order = np.flatnonzero((bucket == b) & (sizes < LONG))
            width = max(1, int(sizes[order].max()))
            for at in range(0, len(order), rows := max(1, CELLS // width)):
                self.merge_bucket(pieces, order[at : at + rows], width, out)
        return out

    def merge_bucket(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        size = np.array([len(pieces[i]) for i in rows], np.int64)
        cells = np.full((len(rows), width), -1, np.int32)
        cells[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        rank = np.full((len(rows), width), NO_RANK, np.int32)
        both = np.arange(1, width) < size[:, None]
        if width > 1:
            rank[:, :-1][both] = self.pairs.find(cells[:, :-1][both], cells[:, 1:][both])
        while True:
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), best]
            live = least != NO_RANK
            if not live.all():
                for i in np.flatnonzero(~live):
                    out[rows[i]] = cells[i, : size[i]].copy()
                rows, size, cells, rank, best, least = rows[live], size[live], cells[live], rank[live], best[live], least[live]
            if not len(rows):
                return
            most = int(size.max())
            if most < cells.shape[1]:
                cells, rank = cells[:, :most], rank[:, :most]
            n = np.arange(len(rows))
            cells[n, best] = least
            if most > 1:
                behind = np.arange(most - 1) > best[:, None]
                cells[:, :-1], rank[:, :-1] = np.where(behind, cells[:, 1:], cells[:, :-1]), np.where(behind, rank[:, 1:], rank[:, :-1])
            cells[:, -1], rank[:, -1] = -1, NO_RANK
            size = size - 1
            for place in (best, best - 1):
                ok = (place >= 0) & (place + 1 < size)
                rank[n[place >= 0], place[place >= 0]] = NO_RANK
                rank[n[ok], place[ok]] = self.pairs.find(cells[n[ok], place[ok]], cells[n[ok], place[ok] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = np.append(self.pairs.find(ids[:-1], ids[1:]), NO_RANK)
        n, ids, rank = len(ids), ids.tolist(), rank.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(rank) if r != NO_RANK]
        heapq.heapify(heap)
        found: dict[tuple[int, int], int] = {}

        def ranked(i: int) -> None:
            """The pair that now begins at i waits, if it merges."""
            rank[i] = int(NO_RANK)
            if i >= 0 and after[i] < n:
                pair = ids[i], ids[after[i]]
                if pair not in found:
                    found[pair] = int(self.pairs.find(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))[0])
                if (r := found[pair]) != NO_RANK:
                    rank[i] = r
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue  # merged away, or another pair by now
            gone = after[i]
            ids[i], rank[gone], after[i] = r, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            ranked(i)
            if before[i] >= 0:
                ranked(before[i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int32)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """A piece that is a word of the vocabulary is that word; the others are merged."""
        raw = [p.encode() for p in pieces]
        out = [np.array([self.ranks[b]], np.int32) if b in self.ranks else None for b in raw]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.merge([raw[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEPT or self.held > KEPT_BYTES:
            self.known, self.held = {}, 0
            new = list(pieces)
        self.held += sum(map(len, new))
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            ids = ids.tolist()
            self.known[p] = (" ".join(map(str, ids)).encode(), self.decode(ids), len(ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn(set(pieces))
        return [int(x) for p in pieces for x in self.known[p][0].split()]


@cache
def bpe(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", digests: bool = False) -> DataFrame:
    """The documents' other columns with n_tokens and ids, or with digests of the ids and of the decoded bytes instead.

    The vocabulary file lies on every machine at `path`. Null text counts as empty: no ids. Rows are kept one for one, and
    text of any length is encoded whole, a run of its pieces at a time. Columns of the added names are replaced.
    """
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>"
    names = added.split()[::2]
    kept = [c for c in docs.columns if c != text_col and c not in names]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema) + added

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path, pattern)
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = [b.split(x or "") for x in batch.column(text_col).to_pylist()]
                b.learn(set().union(*texts))
                rows = []
                for pieces in texts:
                    found = [b.known[p] for p in pieces]
                    n = sum(x[2] for x in found)
                    ids = b" ".join(x[0] for x in found)
                    rows.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(x[1] for x in found)).hexdigest()) if digests else (n, np.array(ids.split(), np.int32)))
                types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*kept, *names])
        b.known, b.held = {}, 0

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def decoded(encodings: DataFrame, path: str | None = None, pattern: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The rows with ids replaced by text: bytes that aren't UTF-8 become U+FFFD; null ids, null text."""
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]

    @F.pandas_udf("string")
    def text(ids):
        b = bpe(path, pattern)
        return ids.map(lambda x: None if x is None else b.decode(x.tolist()).decode(errors="replace"))

    return encodings.select(*(c for c in encodings.columns if c not in (ids_col, "text")), text(ids_col).alias("text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
