"""Scoring texts by a bigram model whose counts are in a log-frequency Bloom filter.

An n-gram of quantised count q is in the filter at levels 1 to q; its count is read back by probing level after level until one
fails. Sums that probabilities are divided by are in it too, as a level and seven binary digits, each a membership. The filter is
cut into regions by history, so that no machine holds it whole and no count leaves it at any size: texts are brought to chunks of
token numbers once; each chunk asks every region once for what it needs and gets levels back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, crc_mod, discard, mix64, slices, table, tidy, written

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
C1, C2, LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF)
#: Kinds of entries of a history: its own count, the sum of its bigrams' counts, how many different tokens come after it.
OWN, MASS, AFTER = 1, 2, 3
#: Bits an item, probes an item (one in 11,000 others then answers wrongly), levels, binary digits after the first of a sum.
BITS, PROBES, LEVELS, DIGITS = 20, 10, 64, 7
#: Tokens of a chunk, and training tokens that make a bucket: both bound what a task holds.
CHUNK, BUCKET, LEAST_BUCKETS = 1_000_000, 4_000_000, 8
#: A history with more than one in so many training tokens is spread over as many buckets as SALTS; there are HOT at most.
HOT, SALT_BITS = 1024, 6


def token(h: np.ndarray) -> np.ndarray:
    """What tokens are known by: a bijection of their 64-bit hashes. Buckets are ranges of it, followers its low half."""
    return mix64(h ^ C2)


START_G, END_G = (int(token(np.array([x], np.uint64))[0]) for x in (START, END))


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)), 0 for 0: frexp is exact."""
    return np.minimum(np.frexp(np.asarray(counts, float))[1], LEVELS).astype(np.int64)


def means() -> np.ndarray:
    """The count that each level stands for: the mean of its range under 1 / (c (c + 1)). 0 for none, 1 for 1."""
    h = lambda n: np.log(n) + np.euler_gamma + 1 / (2 * n) - 1 / (12 * n * n) if n > 1000 else sum(1 / i for i in range(1, int(n) + 1))
    return np.array([0.0] + [2.0**q * (h(2.0**q) - h(2.0 ** (q - 1))) for q in range(1, LEVELS + 1)])


EXPECTED = means()


def part_of(h: np.ndarray, size: int) -> np.ndarray:
    """The high half of a hash mapped to 0 to size-1, without a division and in its order."""
    return ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def bucket_of(history: np.ndarray, follower: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """A history's bigrams are in one bucket; those of a hot one are dealt out by the follower."""
    out = part_of(history, buckets).astype(np.int64)
    if len(at := np.flatnonzero(np.isin(history, hot))):
        out[at] = part_of(mix64(history[at] + (follower[at].astype(np.uint64) >> np.uint64(32 - SALT_BITS)) * C1), buckets)
    return out


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplaned(raw: np.ndarray, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[: n * size].reshape(size, n).T).view(kind).ravel()


def packed(*arrays: np.ndarray) -> bytes:
    """Lengths, then the arrays' bytes in planes, packed; 32-bit hashes, which don't get smaller, are best given as bytes."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return head + zlib.compress(b"".join(planes(a) for a in arrays), 1)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    sizes = np.frombuffer(data[8 : 8 + 8 * n], np.int64)
    raw, at, out = np.frombuffer(zlib.decompress(data[8 + 8 * n :]), np.uint8), 0, []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(unplaned(raw[at:], kind, size))
        at += size * np.dtype(kind).itemsize
    return out


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class Region:
    """One bucket's bits."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.size = 8 * len(self.bits)

    @staticmethod
    def hashed(keys: np.ndarray, nth: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = mix64(keys + np.asarray(nth, np.uint64) * C1)
        return a, (a * C2) | np.uint64(1)

    @staticmethod
    def made(items: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
        """Of (keys, which membership of each)."""
        bits = np.zeros(max(8, -(-sum(len(k) for k, _ in items) * BITS // 8) * 8), bool)
        for keys, nth in items:
            a, step = Region.hashed(keys, nth)
            for _ in range(PROBES):
                bits[part_of(a, len(bits)).astype(np.int64)] = True
                a = a + step
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, keys: np.ndarray, nth: int) -> np.ndarray:
        """Places of the keys that are in at this membership."""
        live = np.arange(len(keys))
        a, step = self.hashed(keys, nth)
        for _ in range(PROBES if self.size else 0):
            at = part_of(a, self.size).astype(np.int64)
            on = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            live, a, step = live[on], a[on], step[on]
            a = a + step
        return live if self.size else live[:0]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            live = live[self.has(keys[live], level)]
            if not len(live):
                break
            out[live] = level
        return out

    def values(self, keys: np.ndarray) -> np.ndarray:
        """Numbers kept as a level and binary digits; 0 for what isn't there."""
        level = self.levels(keys).astype(np.int64)
        digits, live = np.zeros(len(keys)), np.flatnonzero(level)
        for j in range(DIGITS):
            digits[live[self.has(keys[live], LEVELS + 1 + j)]] += 2.0 ** -(j + 1)
        return np.where(level > 0, 2.0 ** (level - 1) * (1 + digits), 0.0)


def chain(keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every key at each level up to its own."""
    return np.repeat(keys, levels), np.arange(int(levels.sum())) - np.repeat(np.cumsum(levels) - levels, levels) + 1


def rounded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and digits of numbers from 1."""
    whole, power = np.frexp(values)
    digits = np.rint((2 * whole - 1) * 2**DIGITS).astype(np.int64)
    return power + (digits >> DIGITS), digits & ((1 << DIGITS) - 1)


def valued(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    level, digits = rounded(values)
    out = [chain(keys, level)]
    for j in range(DIGITS):
        on = np.flatnonzero(digits >> (DIGITS - 1 - j) & 1)
        out.append((keys[on], np.full(len(on), LEVELS + 1 + j)))
    return out


def pair_keys(history: np.ndarray, follower: np.ndarray) -> np.ndarray:
    return mix64(history * C1 + follower.astype(np.uint64))


def kind_keys(history: np.ndarray, kind: int) -> np.ndarray:
    return mix64(history + np.uint64(kind * int(C2) % 2**64))


def tokens(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, each text with its end, and the number of tokens of each."""
    lists = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(x) + 1 for x in lists], np.int64)
    ends = np.cumsum(sizes) - 1
    out = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes.of([w for x in lists for w in x])
    out[ends] = END
    return token(out), sizes


@dataclass
class Chunk:
    """Texts as numbers: known is all their tokens with the start and the end, in order; at, which of them each token is."""

    known: np.ndarray
    at: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, found: np.ndarray, sizes: np.ndarray) -> Chunk:
        which, distinct = pd.factorize(found)
        known = np.unique(np.concatenate([distinct, np.array([START_G, END_G], np.uint64)]))
        return cls(known, np.searchsorted(known, distinct)[which], sizes)

    def packed(self) -> bytes:
        return packed(steps(self.known), self.at.astype(np.uint32), self.sizes.astype(np.uint32))

    @classmethod
    def unpacked(cls, data: bytes) -> Chunk:
        known, at, sizes = unpacked(data, np.uint64, np.uint32, np.uint32)
        return cls(np.cumsum(known, dtype=np.uint64), at.astype(np.int64), sizes.astype(np.int64))

    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def place(self, g: int) -> int:
        return int(np.searchsorted(self.known, np.uint64(g)))

    def pairs(self) -> np.ndarray:
        """A number for each token and what stands before it."""
        before = np.roll(self.at, 1)
        before[self.first()] = self.place(START_G)
        return before * len(self.known) + self.at


def chunked(rows: DataFrame) -> DataFrame:
    """(chunk, ids, held, train, top, data): rows (doc_id, held_out, text) in chunks of about CHUNK tokens. train: tokens of
    rows that aren't held out; top: those that are at least one in HOT / 2 of them."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    top = pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, nth, n = WordHashes(), [], TaskContext.get().partitionId() << 33, 0

        def out() -> pa.RecordBatch:
            c = Chunk.of(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            ids, out = (pa.concat_arrays([x[i] for x in held]) for i in (2, 3))
            learned = ~out.to_numpy(zero_copy_only=False)
            counts = np.bincount(c.at[np.repeat(learned, c.sizes)], minlength=len(c.known))
            counts[c.place(START_G)], counts[c.place(END_G)] = learned.sum(), 0
            train = int(c.sizes[learned].sum())
            often = np.flatnonzero(counts * (HOT // 2) >= max(1, train))
            often = [{"g": g, "n": m} for g, m in zip(c.known[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]
            held.clear()
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([nth], pa.int64()), whole(ids), whole(out), pa.array([train], pa.int64()), pa.array([often], top), pa.array([c.packed()], pa.binary())], ["chunk", "ids", "held", "train", "top", "data"])

        for big in batches:
            for batch in slices(big, "text"):
                held.append((*tokens(batch.column("text").to_pylist(), hashes), batch.column("doc_id"), batch.column("held_out")))
                n += len(held[-1][0])
                if n >= CHUNK:
                    yield out()
                    nth, n = nth + 1, 0
        if held:
            yield out()

    return written(rows.mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, train long, top array<struct<g:long,n:long>>, data binary"), "lm-chunks")


def counted(chunks: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, region, words, spread, distinct, mass): the filter, and beside it the exact counts of words, which the base score
    asks for; spread: sums of the hot histories' part in the bucket. A row a bucket that has any."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, data in zip(batch.column("held"), batch.column("data"), strict=True):
                c = Chunk.unpacked(data.as_py())
                learned = ~held.values.to_numpy(zero_copy_only=False)
                pairs, n = np.unique(c.pairs()[np.repeat(learned, c.sizes)], return_counts=True)
                history, word = np.divmod(pairs, len(c.known))
                follower = (c.known[word] & LOW).astype(np.uint32)
                bucket = bucket_of(c.known[history], follower, hot, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[b] : cuts[b + 1]]
                    own, many = np.unique(history[at], return_counts=True)
                    rows.append((b, packed(steps(c.known[own]), many.astype(np.uint32), n[at].astype(np.uint32)), follower[at].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "run", "followers"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        runs = [unpacked(x, np.uint64, np.uint32, np.uint32) for x in part["run"]]
        owns = [np.cumsum(g, dtype=np.uint64) for g, _, _ in runs]
        history = np.unique(np.concatenate(owns))
        keys = np.concatenate([np.repeat(np.searchsorted(history, own), many).astype(np.uint64) << np.uint64(32) for own, (_, many, _) in zip(owns, runs, strict=True)])
        keys |= np.concatenate([np.frombuffer(x, np.uint32) for x in part["followers"]]).astype(np.uint64)
        counts = np.concatenate([n for _, _, n in runs]).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        own, level = (keys >> np.uint64(32)).astype(np.int64), quantised(counts)
        total, mass, after = (np.bincount(own, x, len(history)) for x in (counts, EXPECTED[level], None))
        cold = ~np.isin(history, hot)
        items = [chain(pair_keys(history[own], (keys & LOW).astype(np.uint32)), level), chain(kind_keys(history[cold], OWN), quantised(total[cold]))]
        items += valued(kind_keys(history[cold], MASS), mass[cold]) + valued(kind_keys(history[cold], AFTER), after[cold].astype(float))
        spread = packed(history[~cold], total[~cold], mass[~cold], after[~cold].astype(float))
        words = packed(steps(history[cold]), total[cold].astype(np.int64))
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "region": [Region.made(items)], "words": [words], "spread": [spread], "distinct": [int(cold.sum())], "mass": [float(EXPECTED[quantised(total[cold])].sum())]})

    runs = chunks.where("train > 0").select("held", "data").mapInArrow(count, "bucket int, run binary, followers binary")
    return written(runs.groupBy("bucket").applyInPandas(merge, "bucket int, region binary, words binary, spread binary, distinct long, mass double"), "lm-regions")


@dataclass
class Asked:
    """What a chunk asks each bucket: entries (a history and how many of its bigrams come next), and those bigrams' followers."""

    pair: np.ndarray  # of each token: which bigram
    order: np.ndarray  # bigrams in the order that they are asked
    entry: np.ndarray  # bucket * tokens + history, in order
    many: np.ndarray
    follower: np.ndarray  # in order
    cuts: np.ndarray  # of the entries by bucket

    @classmethod
    def of(cls, c: Chunk, hot: np.ndarray, buckets: int) -> Asked:
        pair, pairs = pd.factorize(c.pairs())
        history, word = np.divmod(pairs, len(c.known))
        follower = (c.known[word] & LOW).astype(np.uint32)
        of_pair = bucket_of(c.known[history], follower, hot, buckets) * len(c.known) + history
        cold = np.flatnonzero(~np.isin(c.known, hot))
        entry = np.unique(np.concatenate([of_pair, part_of(c.known[cold], buckets).astype(np.int64) * len(c.known) + cold]))
        order = np.argsort(of_pair, kind="stable")
        many = np.bincount(np.searchsorted(entry, of_pair), minlength=len(entry))
        return cls(pair, order, entry, many, follower[order], np.searchsorted(entry, np.arange(buckets + 1) * len(c.known)))


def answered(chunks: DataFrame, regions: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(chunk, bucket, entries, levels): of each entry the exact count and what the filter has of the history, of bigrams their levels."""

    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                c = Chunk.unpacked(data.as_py())
                a = Asked.of(c, hot, buckets)
                ends, rows = np.concatenate([[0], np.cumsum(a.many)]), []
                for b in np.flatnonzero(np.diff(a.cuts)).tolist():
                    at = slice(a.cuts[b], a.cuts[b + 1])
                    rows.append((chunk, b, packed(steps(c.known[a.entry[at] % len(c.known)]), a.many[at].astype(np.uint32)), a.follower[ends[at.start] : ends[at.stop]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "bucket", "asked", "followers"])

    def answer(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask):
            return pd.DataFrame({"chunk": [], "bucket": [], "entries": [], "levels": []})
        region = Region(have["region"].iloc[0] if len(have) else b"")
        words, counts = unpacked(have["words"].iloc[0], np.uint64, np.int64) if len(have) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        words = np.cumsum(words, dtype=np.uint64)
        parts = [unpacked(x, np.uint64, np.uint32) for x in ask["asked"]]
        owns = [np.cumsum(g, dtype=np.uint64) for g, _ in parts]
        which, known = pd.factorize(np.concatenate(owns))
        at = np.minimum(np.searchsorted(words, known), max(0, len(words) - 1))
        exact = np.where(words[at] == known, counts[at], 0) if len(words) else np.zeros(len(known), np.int64)
        level = region.levels(kind_keys(known, OWN))
        mass, after = (region.values(kind_keys(known, kind)).astype(np.float32) for kind in (MASS, AFTER))
        keys = np.concatenate([pair_keys(np.repeat(own, many), np.frombuffer(x, np.uint32)) for own, (_, many), x in zip(owns, parts, ask["followers"], strict=True)])
        same, distinct = pd.factorize(keys)
        found = region.levels(distinct)[same]
        ends = np.cumsum([len(x) for x in owns])
        bigrams = np.cumsum([len(x) // 4 for x in ask["followers"]])
        entries = [packed(exact[i], level[i], mass[i], after[i]) for i in np.split(which, ends[:-1])]
        return pd.DataFrame({"chunk": ask["chunk"], "bucket": ask["bucket"], "entries": entries, "levels": [zlib.compress(x.tobytes(), 1) for x in np.split(found, bigrams[:-1])]})

    asked = chunks.select("chunk", "data").mapInArrow(ask, "chunk long, bucket int, asked binary, followers binary")
    both = asked.groupBy("bucket").cogroup(regions.select("bucket", "region", "words").groupBy("bucket"))
    return written(both.applyInPandas(answer, "chunk long, bucket int, entries binary, levels binary"), "lm-levels")


@dataclass
class Totals:
    """N, V, the sum of the words' quantised counts, and the hot histories' sums: history, count, mass, after."""

    n: int
    v: int
    mass: float
    hot: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, n: int, regions: DataFrame) -> Totals:
        """The hot histories' parts are summed here: HOT of them at most, in a part a bucket that one falls on."""
        v, mass = regions.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("mass"), F.lit(0.0))).first()

        def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for data in part["spread"]:
                    g, total, mass, after = unpacked(data, np.uint64, float, float, float)
                    yield pd.DataFrame({"g": g.view(np.int64), "c": total, "m": mass, "t": after})

        found = regions.select("spread").mapInPandas(split, "g long, c double, m double, t double").groupBy("g").agg(F.sum("c"), F.sum("m"), F.sum("t")).collect()
        hot = np.array([tuple(r)[1:] for r in found], float).reshape(-1, 3)
        digits = lambda x: (lambda level, d: 2.0 ** (level - 1) * (1 + d / 2**DIGITS))(*rounded(x)) if len(x) else x
        return cls(n, v + len(hot), mass + float(EXPECTED[quantised(hot[:, 0])].sum()), (np.array([r["g"] for r in found], np.int64).view(np.uint64), hot[:, 0], digits(hot[:, 1]), digits(hot[:, 2])))


def probabilities(c: Chunk, a: Asked, exact: np.ndarray, level: np.ndarray, mass: np.ndarray, after: np.ndarray, bigram: np.ndarray, t: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its exact count, and the model's probability.

    (c(hw) + (t(h) + 1) p(w)) / (m(h) + t(h) + 1) with p(w) = (c(w) + 1) / (M + V + 1): m(h) is the sum of the history's c(hw),
    M that of all c(w), each as the filter has it, so that the probabilities after a history add up to 1.
    """
    whole, own = a.entry % len(c.known), np.zeros((4, len(c.known)))
    cold = ~np.isin(c.known[whole], t.hot[0])
    for row, x in zip(own, (exact, EXPECTED[level], mass, after), strict=True):
        row[whole[cold]] = x[cold]
    if len(t.hot[0]):
        order = np.argsort(t.hot[0])
        there = np.flatnonzero(np.isin(c.known, t.hot[0]))
        at = order[np.searchsorted(t.hot[0][order], c.known[there])]
        own[:, there] = t.hot[1][at], EXPECTED[quantised(t.hot[1][at])], t.hot[2][at], t.hot[3][at]
    start, end = c.place(START_G), c.place(END_G)
    own[:2, end] = own[:2, start]  # as many ends as starts
    counts, word, mass, after = own[0][c.at], own[1][c.at], *(x[np.where(first_of(c), start, np.roll(c.at, 1))] for x in own[2:])
    levels = np.empty(len(a.order), np.int64)
    levels[a.order] = bigram
    both = np.minimum(EXPECTED[levels[a.pair]], mass)
    return counts, (both + (after + 1) * (word + 1) / (t.mass + t.v + 1)) / (mass + after + 1)


def first_of(c: Chunk) -> np.ndarray:
    out = np.zeros(len(c.at), bool)
    out[c.first()] = True
    return out


def scored(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a document.

    The model learns from rows where held_out (a column) is false, from all their words and pairs. score is the sum of log10
    of `probabilities`; base_score has exact counts throughout. Null and empty texts have the end as their only token. Null
    ids: held_out false if the column says so, else as false. Repeated rows are rows of their own. No training rows: N and V
    are 0 and every probability is 1. Words are told apart by 64-bit hashes. Other columns play no part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunks = chunked(rows)
    n = chunks.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, n // BUCKET)
    often = chunks.select(F.explode("top").alias("x")).groupBy("x.g").agg(F.sum("x.n").alias("n")).where(F.col("n") * HOT > n)
    hot = np.sort(np.array([r["g"] for r in often.collect()], np.int64).view(np.uint64))  # less than HOT
    regions = counted(chunks, hot, buckets)
    totals = Totals.of(n, regions)
    levels = answered(chunks, regions, hot, buckets)
    discard(regions)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(chunk: pa.Table, found: pa.Table) -> pa.Table:
        c = Chunk.unpacked(chunk.column("data")[0].as_py())
        a = Asked.of(c, hot, buckets)
        found = found.sort_by("bucket")
        exact, level, mass, after = (np.concatenate(x) for x in zip(*(unpacked(x.as_py(), np.int64, np.uint8, np.float32, np.float32) for x in found.column("entries")), strict=True))
        bigram = np.frombuffer(b"".join(zlib.decompress(x.as_py()) for x in found.column("levels")), np.uint8)
        counts, p = probabilities(c, a, exact, level, mass.astype(float), after.astype(float), bigram, totals)
        add = lambda x: np.add.reduceat(x, c.first())
        base = np.log10((counts + 1) / (totals.n + totals.v + 1))
        whole = [pa.array(x) for x in (c.sizes, add((counts > 0).astype(np.int64)), np.full(len(c.sizes), totals.n, np.int64), add(base), add(np.log10(p)))]
        return pa.table([chunk.column("ids").combine_chunks().flatten(), chunk.column("held").combine_chunks().flatten(), *whole], names)

    both = chunks.select("chunk", "ids", "held", "data").groupBy("chunk").cogroup(levels.groupBy("chunk"))
    return both.applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, crc_mod(F.col("doc_id"), 7) == 2)
