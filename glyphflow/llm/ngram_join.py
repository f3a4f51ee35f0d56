"""Documents whose sets of word n-grams have at least a given Jaccard similarity.

Equal sets are one vertex. Each set is ordered rare first, by counts of all documents in a table of fixed size, and the n-grams
of its prefix are the postings that sets meet on. Length and positional filters, parities that bound the difference of whole sets
and the suffix filter, which bounds that of what comes after a common n-gram, leave the candidates; each pair is verified once,
on whole texts. In a group of copies most pairs are linked through others already: neighbours of a posting list are verified
first, and only pairs from different components go on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, discard, mix64, slices, table, tidy, written
from .components import components

#: Cells of the table of counts, the same for any input; they are summed in blocks, so many tables at a time.
CELL_BITS, BLOCK_BITS, FAN = 22, 16, 64
#: Parities of 512 bits for a whole set; ranges of the order that the suffix filter counts in.
PARITY = tuple(f"p{i}" for i in range(8))
RANGES = 32
#: Postings before each one that are tried before all pairs of what is then still apart.
NEAR = 16
#: Rows of a part of a posting list, in which neighbours are looked for; pairs across parts come with all other pairs.
LIST = 64
#: Bits of the table that rows are sieved by before a join with few keys, the same for any input; and those of a row of it.
SIEVE_BITS, ROW_BITS = 24, 15
K = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, and space with the controls 9 to 13."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of n words; of all words where they are fewer; none of none."""
    if not words:
        return np.empty(0, np.uint64)
    h, k = hashes.of(words), min(n, len(words))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * K + h[i : len(h) - k + 1 + i]
    return np.unique(mix64(out + np.uint64(k)))


def by_text(order: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The order within each text; 16-bit numbers are sorted by radix."""
    return order[np.argsort(text[order].astype(np.uint16 if len(text) and text.max() < 1 << 16 else np.int64), kind="stable")]


def sets_of(texts: list[str | None], n: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of shingles, each in order, end to end; and which text each shingle is of."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    h = hashes.of([w for x in lists for w in x])
    out, ends = h.copy(), np.cumsum(sizes)
    for i in range(1, n):
        out[: max(0, len(out) - i)] = out[: max(0, len(out) - i)] * K + h[i:]
    text = np.repeat(np.arange(len(texts)), sizes)
    whole = np.arange(len(h)) + n <= ends[text]
    out, text = mix64(out[whole] + np.uint64(n)), text[whole]
    few = np.flatnonzero((sizes > 0) & (sizes < n))  # all their words are one shingle
    out = np.concatenate([out, *(shingles(lists[i], n, hashes) for i in few)])
    text = np.concatenate([text, few])
    order = np.argsort(out)
    order = by_text(order, text)
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], text[new]


def cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def counted(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """How many documents hold an n-gram of each cell, over all documents."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = WordHashes(), np.zeros(1 << CELL_BITS, np.uint32)
        for whole in batches:
            for batch in slices(whole, text_col):
                sums += np.bincount(cells(sets_of(batch.column(text_col).to_pylist(), n, hashes)[0]), minlength=1 << CELL_BITS).astype(np.uint32)
        blocks = sums.reshape(-1, 1 << BLOCK_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], ["block", "part", "sums"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in part["sums"])
        packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"block": part["block"].iloc[:1], "part": part["part"].iloc[:1] // FAN, "sums": [packed]})

    parts = docs.select(text_col).rdd.getNumPartitions()
    sums = docs.select(text_col).mapInArrow(count, "block int, part int, sums binary")
    while parts > 1:
        sums = sums.groupBy("block", F.expr(f"part div {FAN}").alias("to")).applyInPandas(add, "block int, part int, sums binary")
        parts = -(-parts // FAN)
    out = np.zeros((1 << CELL_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint32)
    for row in sums.collect():  # so many blocks of so many cells, whatever the input
        out[row["block"]] = np.frombuffer(zlib.decompress(row["sums"]), np.uint32)
    return out.ravel()


def pivots(counts: np.ndarray) -> np.ndarray:
    """Counts that cut all n-grams, in their order, into RANGES of about as many."""
    c = np.sort(counts[counts > 0])
    mass = np.cumsum(c, dtype=np.uint64)
    return np.unique(c[np.searchsorted(mass, mass[-1] / RANGES * np.arange(1, RANGES))]) if len(c) else c


def described(docs: DataFrame, counts: np.ndarray, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, s1, s2, parities, below, prefix): s1 and s2 tell sets apart; the parities are of how many n-grams fall on each
    bit; below, how many come before each range of the order ends."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, pivots(counts)))  # CELL_BITS bound it
    names = ["doc_id", "n", "s1", "s2", *PARITY, "below", "prefix"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (counts, cut) = WordHashes(), shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                rows = batch.num_rows
                h, text = sets_of(batch.column(text_col).to_pylist(), n, hashes)
                size = np.bincount(text, minlength=rows)
                first = np.cumsum(size) - size
                often = counts[cells(h)]
                order = np.argsort(often, kind="stable")
                order = by_text(order, text)
                taken = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                prefix = h[order[np.arange(len(h)) - first[text] < taken[text]]]
                below = np.bincount(text * RANGES + np.searchsorted(cut, often, side="right"), minlength=rows * RANGES).reshape(rows, RANGES)
                lists = lambda x, sizes, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(size, pa.int32()), *map(pa.array, signs(h, text, rows)), *map(pa.array, parities(h, text, rows)),
                    lists(np.cumsum(below, axis=1).ravel(), np.full(rows, RANGES), pa.int32()), lists(prefix.view(np.int64), taken, pa.int64()),
                ], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n int, s1 long, s2 long, {', '.join(f'{p} long' for p in PARITY)}, below array<int>, prefix array<long>")


def parities(h: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """64 bits a name and text: whether an odd number of hashes fall on each. Sets differ by at least the bits that do."""
    n = 64 * len(PARITY)
    odd = np.bincount(text * n + (h & np.uint64(n - 1)).astype(np.int64), minlength=rows * n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(rows, len(PARITY)).T.copy()


def signs(h: np.ndarray, text: np.ndarray, rows: int) -> list[np.ndarray]:
    """Two sums over each text's set, 64 bits each."""
    ends = np.cumsum(np.bincount(text, minlength=rows))
    total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[np.concatenate([[0], ends])]).view(np.int64)
    return [total(h), total(mix64(h ^ K))]


def sieved(rows: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """The rows whose column may be the one column of the keys, before they are dealt out for a join with them, which still has to
    follow: all that are among the keys, and of the others those that share a bit of a table of fixed size with a key."""
    at = lambda c: F.expr(f"pmod(xxhash64({c}), {1 << SIEVE_BITS})")
    bits = keys.select(at(keys.columns[0]).alias("_at")).select(F.shiftright("_at", ROW_BITS).alias("_row"), F.col("_at").bitwiseAND((1 << ROW_BITS) - 1).alias("_bit"))
    bits = bits.distinct().repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    asked = rows.withColumn("_at", at(col)).withColumn("_row", F.shiftright("_at", ROW_BITS)).join(F.broadcast(bits), "_row")
    byte = f"CAST(conv(hex(substring(_bits, CAST(_at & {(1 << ROW_BITS) - 1} AS int) div 8 + 1, 1)), 16, 10) AS int)"
    return asked.where(f"shiftright({byte}, CAST(_at & 7 AS int)) & 1 = 1").select(*rows.columns)


class Join:
    """The steps over one input; num/den is the least similarity."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str):
        self.docs, self.n, self.num, self.den, self.id_col, self.text_col = docs, n, num, den, id_col, text_col
        counts = counted(docs, n, text_col)
        rows = written(described(docs, counts, n, num, den, id_col, text_col), "join-rows")
        one = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", *PARITY, "below", "prefix")))
        self.sets = written(one.withColumn("vid", F.monotonically_increasing_id()), "join-sets")
        self.rows = written(rows.select("doc_id", "n", "s1", "s2"), "join-rows")
        discard(rows)
        posted = self.sets.select("vid", "n", F.posexplode("prefix").alias("pos", "token"))
        # Counted before they meet: a long list is only ever dealt out, in joins that Spark can split and in salted parts.
        lists = written(posted.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "join-lists")
        part = F.expr(f"pmod(xxhash64(vid), (rows + {LIST - 1}) div {LIST})")
        posted = posted.join(lists.hint("merge"), "token").select("token", part.alias("part"), "vid", "n", "pos", F.col("vid").alias("c"))
        posted = written(posted.join(self.sets.select("vid", *PARITY), "vid"), "join-posted")
        # Only postings that some other one of their n-gram passes all filters with that need no more than this. Parts are never
        # negative; asking both sides for them has Spark deal out one table for both, as it does where their columns are the same.
        self.shared = written(posted.alias("x").join(posted.alias("y"), F.expr(f"x.token = y.token AND x.part + y.part >= 0 AND {self.may('x', 'y')}"), "left_semi"), "join-shared")
        discard(posted, lists)
        self.wanted = written(self.sets.join(self.shared.select("vid").distinct(), "vid", "left_semi").select("vid", "rep", "s1", "s2", "n", "below"), "join-wanted")
        self.texts = written(self.packed(), "join-texts")

    def packed(self) -> DataFrame:
        """(vid, z): the words of each wanted set's text, packed. Of the texts that have the set any will do."""
        n = self.n

        @tidy
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for whole in batches:
                for batch in slices(whole, "_text"):
                    texts = batch.column("_text").to_pylist()
                    z = [zlib.compress(b" ".join(words_of(t)), 1) for t in texts]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, signs(*sets_of(texts, n, hashes), len(texts))), pa.array(z, pa.binary())], ["s1", "s2", "z"])

        docs = sieved(self.docs.select(F.col(self.id_col).alias("_id"), F.col(self.text_col).alias("_text")), "_id", self.wanted.select("rep"))
        packs = docs.select("_text").mapInArrow(pack, "s1 long, s2 long, z binary")
        return packs.join(self.wanted.select("vid", "s1", "s2"), ["s1", "s2"]).groupBy("s1", "s2", "vid").agg(F.first("z").alias("z")).select("vid", "z")

    def may_link(self, n: str, m: str) -> str:
        """SQL: the sizes can link. An intersection i links if (num + den) * i >= num * (n + m)."""
        return f"({self.den} * least({n}, {m}) >= {self.num} * greatest({n}, {m}))"

    def least(self, n: str, m: str) -> str:
        return f"(({self.num}L * ({n} + {m}) + {self.num + self.den - 1}) div {self.num + self.den})"

    def placed(self, n: str, i: str, m: str, j: str) -> str:
        """SQL: with a common n-gram at places i and j, those before can meet those before, and those after those after."""
        return f"(least({i}, {j}) + least({n} - {i}, {m} - {j}) >= {self.least(n, m)})"

    def apart(self, a: str, b: str) -> str:
        """SQL: a number that the sets differ by at least: the parities that do."""
        return "(" + " + ".join(f"bit_count({a}.{p} ^ {b}.{p})" for p in PARITY) + ")"

    def suffix(self, x: str, y: str) -> str:
        """SQL: the suffix filter. What comes after the common n-gram has to meet in all that what is before it can't provide; the
        sets' numbers of n-grams after it in each range of the order show how many can't meet."""
        after = lambda a: f"greatest(0, {a}.below[k] - greatest(IF(k = 0, 0, {a}.below[greatest(k - 1, 0)]), {a}.pos + 1))"
        differ = f"aggregate(sequence(0, {RANGES - 1}), 0, (s, k) -> s + abs({after(x)} - {after(y)}))"
        return f"({differ} <= {x}.n + {y}.n - {x}.pos - {y}.pos - 2 * ({self.least(f'{x}.n', f'{y}.n')} - least({x}.pos, {y}.pos)))"

    def mixed(self, roots: DataFrame) -> DataFrame:
        """The postings of n-grams that join different components c. Such n-grams are written before they are joined with, so that
        the join is one that Spark can split or broadcast for."""
        posted = self.shared.drop("c").join(roots, F.col("vid") == F.col("v"), "left").withColumn("c", F.coalesce("root", "vid")).drop("v", "root")
        tokens = written(posted.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("token"), "join-mixed")
        return sieved(posted, "token", tokens).join(tokens, "token", "left_semi")

    def may(self, x: str, y: str) -> str:
        """SQL: length, position and parities of a pair of postings of one n-gram."""
        near = f"{self.apart(x, y)} <= {x}.n + {y}.n - 2 * {self.least(f'{x}.n', f'{y}.n')}"
        return f"{x}.vid <> {y}.vid AND {x}.c <> {y}.c AND {self.may_link(f'{x}.n', f'{y}.n')} AND {self.placed(f'{x}.n', f'{x}.pos', f'{y}.n', f'{y}.pos')} AND {near}"

    def around(self, posted: DataFrame, most: int) -> DataFrame:
        """Pairs a < b of different components with less than so many postings between them, and how far apart they are at
        least: as many rows as postings at most for each of them, however large a group is."""
        by = Window.partitionBy("token", "part").orderBy("n", "vid")
        x = F.struct("vid", "n", "pos", "c", *PARITY)
        rows = posted.select(x.alias("x"), F.array(*(F.lag(x, i).over(by) for i in range(1, most + 1))).alias("before"))
        kept = f"transform(filter(before, y -> y IS NOT NULL AND {self.may('x', 'y')}), y -> named_struct('vid', y.vid, 'pos', y.pos, 'apart', {self.apart('x', 'y')}))"
        rows = rows.select("x.vid", "x.pos", F.explode(F.expr(kept)).alias("y"))
        at = F.expr("IF(vid < y.vid, named_struct('i', pos, 'j', y.pos), named_struct('i', y.pos, 'j', pos))")
        pairs = rows.select(F.least("vid", "y.vid").alias("a"), F.greatest("vid", "y.vid").alias("b"), "y.apart", at.alias("at"))
        return self.fitting(pairs.groupBy("a", "b", "apart").agg(F.min("at").alias("at")))

    def crossing(self, posted: DataFrame) -> DataFrame:
        """All pairs of those postings, in different components, through all filters."""
        pairs = posted.alias("x").join(posted.alias("y"), F.expr(f"x.token = y.token AND x.vid < y.vid AND {self.may('x', 'y')}"))
        pairs = pairs.select(F.col("x.vid").alias("a"), F.col("y.vid").alias("b"), F.struct(F.col("x.pos").alias("i"), F.col("y.pos").alias("j")).alias("at"))
        return self.fitting(pairs.groupBy("a", "b").agg(F.min("at").alias("at")))

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ..., at) that pass the suffix filter at one of their common n-grams; pairs that link do at each of them.
        What it needs comes by set, as postings are many more than the sets and pairs that get here."""
        for v, s, pos in (("b", "y", "j"), ("a", "x", "i")):
            pairs = pairs.join(self.wanted.select(F.col("vid").alias(v), F.col("n").alias(f"{s}n"), F.col("below").alias(f"{s}b")), v).withColumn(s, F.struct(F.col(f"{s}n").alias("n"), F.col(f"at.{pos}").alias("pos"), F.col(f"{s}b").alias("below")))
        return pairs.where(self.suffix("x", "y")).drop("x", "xn", "xb", "y", "yn", "yb", "at")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. They are read more than once, and so have to be written."""
        n, num, den = self.n, self.num, self.den

        @tidy
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, last = WordHashes(), (None, None)
            for batch in batches:
                keep = []
                for i, (a, za, zb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "za", "zb")), strict=True)):
                    if last[0] != a:
                        last = (a, shingles(zlib.decompress(za).split(), n, hashes))
                    x, y = last[1], shingles(zlib.decompress(zb).split(), n, hashes)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        keep.append(i)
                keep = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

        t = sieved(self.texts, "vid", pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
        both = pairs.select("a", "b").join(t.select(F.col("vid").alias("b"), F.col("z").alias("zb")), "b").join(t.select(F.col("vid").alias("a"), F.col("z").alias("za")), "a")
        return both.select("a", "b", "za", "zb").mapInArrow(check, "a long, b long")

    def roots(self) -> DataFrame:
        """(v, root) of the vertices that have a smaller one in their component.

        Neighbours first: of the nearest on each list the one that is least apart, then up to NEAR that are still apart, then
        every pair of a list that is still apart. No pair is verified twice.
        """
        near = self.around(self.shared, 1)
        first = written(near.groupBy(F.col("b").alias("v")).agg(F.min(F.struct("apart", "a")).alias("best")).select(F.col("best.a").alias("a"), F.col("v").alias("b")), "join-near")
        roots = components(self.verified(first))
        more = written(self.around(self.mixed(roots), NEAR).select("a", "b").join(first, ["a", "b"], "left_anti"), "join-near")
        known = lambda r: r.select(F.col("v").alias("a"), F.col("root").alias("b"))
        again = components(known(roots).unionByName(self.verified(more)))
        rest = written(self.crossing(self.mixed(again)).join(first.unionByName(more), ["a", "b"], "left_anti"), "join-rest")
        last = components(known(again).unionByName(self.verified(rest)))
        discard(first, more, rest, roots, again)
        return last


def joined(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row a document, its class the smallest id that links lead to.

    Documents link when the Jaccard similarity of their sets of n-word shingles is num/den or more. Fewer than n words are one
    shingle; null texts and texts without words have none, link with nothing and are their own class. Equal texts are one
    vertex, however many. Repeated ids: each row has the class of its own text. Null ids: the smallest id that isn't null
    names the class. Other columns of the documents play no part. Sets are compared by 64-bit hashes of their shingles.
    """
    j = Join(docs, n, num, den, id_col, text_col)
    named = j.sets.select("vid", "rep", "s1", "s2").join(j.roots(), F.col("vid") == F.col("v"), "left").withColumn("c", F.coalesce("root", "vid"))
    smallest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    classes = named.join(smallest, "c").select("s1", "s2", "component_id")
    discard(j.shared, j.wanted, j.texts)
    return j.rows.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between different texts as (a, b), and membership as (doc_id, text_id); a text's id is its smallest document."""
    j = Join(docs, n, num, den, id_col, text_col)
    names = j.sets.select("vid", "rep", "s1", "s2")
    pairs = j.verified(written(j.crossing(j.shared), "join-rest")).join(names.select(F.col("vid").alias("a"), F.col("rep").alias("ra")), "a").join(names.select(F.col("vid").alias("b"), F.col("rep").alias("rb")), "b")
    members = j.rows.join(names, ["s1", "s2"]).select("doc_id", F.col("rep").alias("text_id"))
    return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")), members


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=90, den=100)


def op3_sql() -> str:
    return r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
        r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reached) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""
