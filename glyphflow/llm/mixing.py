"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents are laid end to end and cut into blocks of a fixed number of words. The slots of output shards draw
their sources, which makes a shard's counts a multinomial draw; a source's slots run through a pseudorandom permutation of its
block numbers, a new one for each epoch, and slots meet blocks by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Within a source, documents are ordered by part, a hash of id and text, then by id: positions are two sums, neither over a whole
#: source at once, and null ids are spread as well.
PARTS = 4096
#: Slots that are numbered together before a source's groups of slots are; cells that draws look their source up in.
GROUP, GRID = 1 << 16, 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, size) to one row a source: src, source, source_size, target, weight, lo, hi.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at `most`
    times its source's size and what it leaves goes to the others by weight. This is filling to one level: the level
    is the largest that a source, taken in the order of limit over weight, finds while it stays under its limit.
    lo and hi bound the source's part of the unit interval. With no words at all every target is 0.
    """
    one = Window.orderBy(F.col("source").isNull(), "source")
    by = Window.orderBy("ratio", "n")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("n", F.row_number().over(one) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")))
    s = s.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / weight_left)
    s = s.withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    s = s.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("weight"), most * F.col("source_size").cast("double"))))
    up_to = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("sum", F.sum("target").over(everything)).withColumn("hi", F.coalesce(F.sum("target").over(up_to) / F.nullif("sum", F.lit(0.0)), F.lit(0.0)))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("n")), F.lit(0.0)))
    s = s.withColumn("hi", F.when(F.col("n") == F.max("n").over(everything), F.lit(1.0)).otherwise(F.col("hi")))
    return s.select(source_key(F.col("source")).alias("src"), "source", "source_size", "target", "weight", "lo", "hi")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def permuted(x: str, n: str, key: str, rounds: int = 8) -> str:
    """SQL for the place of x in a pseudorandom permutation of 0 to n-1: each round swaps or keeps pairs that add up to a key.

    One expression, as columns that build on each other many times make the planner's work explode.
    """
    other = f"pmod(pmod(xxhash64({key}, r), {n}) - x, {n})"
    return f"aggregate(sequence(1, {rounds}), {x}, (x, r) -> IF(xxhash64({key}, r, greatest(x, {other})) % 2 = 0, x, {other}))"


class Mix:
    """The steps over written rows of uid, source, src, size, and doc_id and sign, which order them."""

    def __init__(self, rows: DataFrame, block_words: int, shard_blocks: int, weights: tuple[int, ...], most: int, seed: int):
        self.rows, self.block_words, self.shard_blocks, self.seed = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "sign"), F.lit(PARTS)).cast("int")), block_words, shard_blocks, seed
        quota = targets(rows, weights, most).withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
        slots = F.expr(f"IF(source_size = 0, 0L, least({most} * blocks, cast(round(target * blocks / source_size) AS bigint)))")
        quota = quota.withColumn("quota", slots)
        by = Window.orderBy("src")
        self.quota = written(quota.withColumn("first", F.sum("quota").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota")), "mix-targets")
        self.slots = self.quota.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    def drawn(self) -> DataFrame:
        """(id, src, slot): each slot of the output draws its source by its own uniform number, so that a shard's counts are
        multinomial; slot numbers those of a source in order."""
        step = max(1, -(-self.slots // GRID))
        grid = self.quota.where("quota > 0").select("src", "quota", "first", F.explode(F.expr(f"sequence(first div {step}, (first + quota - 1) div {step})")).alias("cell"))
        u = F.pmod(F.xxhash64(F.lit(self.seed), F.lit("slot"), "id"), F.lit(max(1, self.slots)))
        spark = self.rows.sparkSession
        found = spark.range(self.slots).withColumn("u", u).withColumn("cell", F.expr(f"u div {step}")).join(grid, "cell").where("u >= first AND u < first + quota")
        found = written(found.select("id", "src", F.expr(f"id div {GROUP}").alias("group")), "mix-drawn")
        groups = found.groupBy("src", "group").agg(F.count(F.lit(1)).alias("in_group"))
        groups = groups.withColumn("base", F.sum("in_group").over(Window.partitionBy("src").orderBy("group")) - F.col("in_group")).drop("in_group")
        nth = F.row_number().over(Window.partitionBy("src", "group").orderBy("id")) - 1
        return found.withColumn("nth", nth).join(groups, ["src", "group"]).select("id", "src", (F.col("base") + F.col("nth")).alias("slot"))

    def filled(self) -> DataFrame:
        """(shard, id, src, block, blocks): the mix. Slots that a source drew beyond its quota go to sources that drew too few, in
        order; a source's slots run through a permutation of its block numbers, a new one for each epoch."""
        drawn = written(self.drawn(), "mix-slots")
        by = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
        short = self.quota.join(drawn.groupBy("src").agg(F.count(F.lit(1)).alias("had")), "src", "left").select("src", "quota", F.coalesce("had", F.lit(0)).alias("had"))
        short = short.withColumn("over", F.greatest(F.lit(0), F.col("had") - F.col("quota"))).withColumn("under", F.greatest(F.lit(0), F.col("quota") - F.col("had")))
        short = written(short.withColumn("over_at", F.sum("over").over(by) - F.col("over")).withColumn("under_at", F.sum("under").over(by) - F.col("under")), "mix-short")
        both = drawn.join(short.select("src", "quota", "over_at"), "src")
        free = both.where("slot >= quota").select("id", F.expr("over_at + slot - quota").alias("nth"))
        open_ = short.where("under > 0").select("src", "had", "under_at", F.explode(F.expr("sequence(0L, under - 1)")).alias("j")).select("src", F.expr("had + j").alias("slot"), F.expr("under_at + j").alias("nth"))
        slots = both.where("slot < quota").select("id", "src", "slot").unionByName(free.join(open_, "nth").select("id", "src", "slot"))
        slots = slots.join(self.quota.select("src", "blocks"), "src").withColumn("_key", F.expr(f"xxhash64({self.seed}, src, slot div blocks)"))
        block = permuted("slot % blocks", "blocks", "_key")
        return slots.select(F.expr(f"id div {self.shard_blocks}").alias("shard"), "id", "src", F.expr(block).alias("block"), "blocks")

    def pieces(self) -> DataFrame:
        """(uid, size, src, block, offset, overlap): each document's words by the blocks that they lie in; a block is null where there are none."""
        inner = Window.partitionBy("src", "part").orderBy("doc_id", "size", "sign")
        offsets = self.rows.groupBy("src", "part").agg(F.sum("size").alias("in_part"))
        offsets = offsets.withColumn("base", F.sum("in_part").over(Window.partitionBy("src").orderBy("part")) - F.col("in_part")).drop("in_part")
        placed = self.rows.withColumn("inside", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        placed = placed.join(offsets, ["src", "part"]).withColumn("start", F.col("base") + F.col("inside"))
        w = self.block_words
        span = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {w}"), F.expr(f"(start + size - 1) div {w}")))
        pieces = placed.select("uid", "size", "src", "start", F.explode_outer(span).alias("block")).withColumn("offset", F.greatest(F.col("block") * w, F.col("start")) - F.col("start"))
        return pieces.withColumn("overlap", F.least((F.col("block") + 1) * w, F.col("start") + F.col("size")) - F.col("offset") - F.col("start")).drop("start")

    def taken(self) -> DataFrame:
        """The pieces with times: how often the mix takes each."""
        times = self.filled().groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
        # Slots look small to the planner, since they come from a few rows: they must not be broadcast.
        return self.pieces().join(times.hint("merge"), ["src", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """The rows that a mix is made of, written, since their numbers have to last."""
    source = F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), source.alias("source"), source_key(source).alias("src"), size.alias("size"), F.xxhash64(text_col).alias("sign"), *more), "mix-sizes")


def mix(docs: DataFrame, block_words: int = 128, shard_blocks: int = 1024, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken.

    size counts words; taken, the words of the document that the mix takes, with repeats. A shard's counts are a multinomial
    draw; what it leaves between a source's slots and its quota is then moved, so that a source's taken words are within one and
    a half blocks of its target. A block comes at most `most` times, as no quota is larger.
    Null text, empty text: size 0, taken 0. Null source: a source of its own. Null or repeated ids, repeated rows: every row
    counts and is returned. The result depends on the rows and the seed only, not on their order or partitions.
    """
    rows = sized(docs, id_col, text_col, source_col)
    m = Mix(rows, block_words, shard_blocks, weights, most, seed)
    taken = m.taken().groupBy("uid").agg(F.sum(F.coalesce(F.col("times") * F.col("overlap"), F.lit(0))).alias("taken"))
    out = rows.join(taken, "uid").join(m.quota.select("src", "source_size", "target"), "src")
    return out.select("doc_id", "size", "source", "source_size", "target", "taken")


def mixed(docs: DataFrame, block_words: int = 128, shard_blocks: int = 1024, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents with the words that the mix takes of them: a row for the first time, one for the second, and so on.

    A row's text is the whole text where all of it is taken that often, else the words of the blocks that are, in their order and
    with one space between them. Words of a source thus come to within one and a half blocks of its target. Documents that
    nothing is taken of, those without words among them, are gone. Columns and their names stay; rows with one id are rows of
    their own.
    """
    rows = sized(docs, id_col, text_col, source_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    m = Mix(rows.drop("doc"), block_words, shard_blocks, weights, most, seed)
    piece = F.struct("offset", "overlap", "times")
    found = m.taken().where("times > 0").groupBy("uid").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("times").alias("most"))
    out = rows.select("uid", "size", "doc").join(found, "uid").withColumn("time", F.explode(F.expr("sequence(1L, most)")))
    out = out.withColumn("pieces", F.expr("filter(pieces, p -> p.times >= time)"))
    text = F.col(f"doc.`{text_col}`")
    out = out.withColumn("words", F.when(F.expr("aggregate(pieces, 0L, (a, p) -> a + p.overlap) < size"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    some = F.expr("array_join(flatten(transform(pieces, p -> slice(words, cast(p.offset AS int) + 1, cast(p.overlap AS int)))), ' ')")
    out = out.withColumn("text", F.coalesce(some, text))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
