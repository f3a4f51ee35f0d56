"""Nearest neighbours by largest inner product: vectors are dealt to cells by their nearest pivot, with a vantage-point tree a shard.

In a shard, one more coordinate gives all vectors the same length, so that a larger inner product is a smaller distance and the
triangle inequality prunes. What a side of a node could hold at best is set `factor` times as far away as the inequality
proves: factor 1 finds exactly the nearest, larger factors skip more. A query first searches the cell whose pivot it goes with
best; what it finds there is the bar that other cells have to reach, by their pivot and radius, to be searched at all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidy, written

#: Pivots at most, all dimensions together; they and the cells' radii are what the driver holds. Queries that meet a shard at once.
MOST_CELLS, SLICE = 4096, 1 << 17
#: Share of the lengths' product that rounding may move an inner product by.
ROUNDING = 1e-9


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components: the same anywhere."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i].astype(np.float64) * y[:, i]
    return out


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k largest scores, ties to the smaller id, in order by query."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return order[nth < k]


class Tree:
    """Distinct vectors of a shard with the ids that bear each, the smallest `k`+1 of them; leaves of up to `leaf` vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leaf: int = 256, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, same = np.unique(vectors.view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(same, kind="stable")
        starts = np.searchsorted(same[by], np.arange(len(first)))
        few = by[np.arange(len(by)) - starts[same[by]] <= k]
        self.ids, self.bears = ids[few], np.searchsorted(same[few], np.arange(len(first) + 1))
        self.x = vectors[first]
        x = self.x.astype(np.float64)
        norms = (x * x).sum(axis=1)
        self.top = float(norms.max())
        whole = np.concatenate([x, np.sqrt(np.maximum(self.top - norms, 0))[:, None]], axis=1)
        rng, self.nodes = np.random.default_rng(seed), []
        self.root = self.grow(whole, np.arange(len(x)), leaf, rng)

    def grow(self, whole: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= leaf:
            self.nodes[me] = (rows,)
            return me
        vantage = int(rows[rng.integers(len(rows))])
        d = np.sqrt(((whole[rows] - whole[vantage]) ** 2).sum(axis=1))
        half = np.argpartition(d, len(rows) // 2)
        near, far = half[: len(rows) // 2], half[len(rows) // 2 :]
        sides = tuple((self.grow(whole, rows[s], leaf, rng), float(d[s].min()), float(d[s].max())) for s in (near, far))
        self.nodes[me] = (vantage, *sides)
        return me

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k best but for its own id: at factor 1 all that are no worse than its bar."""
        q, x = queries.astype(np.float64), self.x.astype(np.float64)
        lengths = (q * q).sum(axis=1)
        margin = ROUNDING * np.sqrt(lengths * max(self.top, 1e-300))
        bar = np.full(len(q), -np.inf) if bar is None else bar.astype(float).copy()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(n := self.nodes[node]) == 1:
                row, col = np.nonzero(q[who] @ x[n[0]].T >= (bar[who] - margin[who])[:, None])
                row, col = who[row], n[0][col]
                score = products(self.x[col], q[row])
                many = self.bears[col + 1] - self.bears[col]
                at = np.repeat(self.bears[col], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                row, score, ids = np.repeat(row, many), np.repeat(score, many), self.ids[at]
                ok = (ids != own[row]) & (score >= bar[row])
                row, ids, score = (np.concatenate([a, b[ok]]) for a, b in zip(found, (row, ids, score), strict=True))
                best = best_of(row, score, ids, k)
                found[:] = row[best], ids[best], score[best]
                ends = np.searchsorted(found[0], who, side="right")
                full = ends - np.searchsorted(found[0], who) == k
                bar[who[full]] = found[2][ends[full] - 1]
                return
            d = np.sqrt(np.maximum(lengths[who] + self.top - 2 * (q[who] @ x[n[0]]), 0))
            gaps = [np.maximum(0, np.maximum(lo - d, d - hi)) for _, lo, hi in n[1:]]
            nearer = np.abs(d - (n[1][1] + n[1][2]) / 2) <= np.abs(d - (n[2][1] + n[2][2]) / 2)
            for turn in (nearer, ~nearer):
                for side, gap, mine in zip(n[1:], gaps, (turn, ~turn), strict=True):
                    most = np.maximum(lengths[who] + self.top - 2 * (bar[who] - margin[who]), 0)
                    visit(side[0], who[mine & ((factor * gap) ** 2 <= most * (1 + ROUNDING))])

        visit(self.root, np.arange(len(q)))
        return found[0], found[1], found[2]


def usable(vector: str) -> str:
    """SQL: neither null nor zero, no null or non-finite component."""
    return f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vector}, x -> x <> 0)"


def stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy())


class Cells:
    """Pivots of each length of vectors, and of each cell the radius and the number of its shards."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.radius = {d: np.full(len(p), -np.inf) for d, p in pivots.items()}
        self.parts = {d: np.zeros(len(p), np.int64) for d, p in pivots.items()}

    @classmethod
    def of(cls, rows: DataFrame, n: int, shard_rows: int) -> Cells:
        """The vectors of least hash, as many as shards, from about four times as many."""
        wanted = min(MOST_CELLS, max(1, -(-n // shard_rows)))
        hashed = rows.withColumn("hash", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)))
        some = hashed.where(F.col("hash") <= int(min(1.0, 4 * wanted / max(1, n)) * (1 << 30))).orderBy("hash", "id").limit(wanted).collect()
        dims = [r["dim"] for r in rows.select("dim").distinct().limit(MOST_CELLS).collect()]
        found = {d: [r["v"] for r in some if r["dim"] == d] for d in dims}
        return cls({d: np.unique(np.array(v or [[0.0] * d], np.float64), axis=0) for d, v in found.items()})

    def cell(self, x: np.ndarray) -> np.ndarray:
        p = self.pivots[x.shape[1]]
        return ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)


def dealt(rows: DataFrame, cells: Cells) -> DataFrame:
    """(id, v, dim, cell)"""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # MOST_CELLS bound it
    kind = rows.schema["v"].dataType.simpleString()

    @tidy
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, same in part.groupby("dim"):
                yield same.assign(cell=shared.value.cell(stacked(same["v"]).astype(np.float64)).astype(np.int32))

    return rows.select("id", "v", "dim").mapInPandas(run, f"id long, v {kind}, dim int, cell int")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, shard_rows: int = 8192, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every`, the k nearest of all others.

    All candidates, if there are fewer. Ties go to the smaller id, however many there are; scores are summed in one order, so
    that equal vectors have equal scores in any shard. Vectors that are null, zero or have null or non-finite components, and
    null ids, take no part; vectors of another length than the query's aren't its candidates. Repeated rows are candidates
    each; a repeated query id is searched once, with its first vector in order.
    """
    rows = vectors.where(F.expr(usable(f"`{vector_col}`"))).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"))
    cells = Cells.of(rows, rows.count(), shard_rows)
    kind = rows.schema["v"].dataType.simpleString()
    placed = written(dealt(rows, cells), "ann-cells")
    queries = 0
    for r in placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") % every == 0).alias("queries")).collect():
        cells.parts[r["dim"]][r["cell"]] = -(-r["rows"] // shard_rows)
        queries += r["queries"]
    slices = max(1, -(-queries // SLICE))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        x, dim, cell = stacked(part["v"]), int(part["dim"].iloc[0]), int(part["cell"].iloc[0])
        radius = float(np.sqrt(((x.astype(np.float64) - cells.pivots[dim][cell]) ** 2).sum(axis=1)).max())
        return pd.DataFrame({"dim": [dim], "cell": [cell], "part": part["part"].iloc[:1].to_numpy(), "radius": [radius], "tree": [pickle.dumps(Tree(part["id"].to_numpy(), x, k))]})

    sizes = F.create_map(*(F.lit(x) for d, p in cells.parts.items() for i, n in enumerate(p.tolist()) for x in (f"{d} {i}", n))) if cells.parts else F.create_map(F.lit("0 0"), F.lit(1))
    shard = F.pmod(F.xxhash64("id", "v"), sizes[F.concat_ws(" ", "dim", "cell")]).cast("int")
    trees = written(placed.withColumn("part", shard).groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell int, part int, radius double, tree binary"), "ann-trees")
    for r in trees.groupBy("dim", "cell").agg(F.max("radius").alias("radius")).collect():
        cells.radius[r["dim"]][r["cell"]] = r["radius"]
    asked = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    packs = f"dim int, cell int, part int, slice long, ids array<long>, vectors array<{kind}>, bars array<double>"

    def visiting(again: bool):
        """Queries by shard that they are to search: the cell that they go with best, or all others that can reach the bar."""

        @tidy
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = shared.value
            for whole in parts:
                for dim, every_ in whole.groupby("dim"):
                    for at in range(0, len(every_), query_rows):
                        part = every_.iloc[at : at + query_rows]
                        q = stacked(part["v"]).astype(np.float64)
                        near = q @ cells.pivots[dim].T
                        reach = near + np.sqrt((q * q).sum(axis=1))[:, None] * cells.radius[dim] / factor
                        home = np.where(cells.parts[dim] > 0, near, -np.inf).argmax(axis=1)
                        go = np.zeros(near.shape, bool)
                        go[np.arange(len(q)), home] = True
                        bars = np.full(len(q), -np.inf)
                        if again:
                            bars = part["bar"].to_numpy(float)
                            length = np.sqrt((q * q).sum(axis=1)[:, None]) * (np.sqrt((cells.pivots[dim] ** 2).sum(axis=1)) + np.maximum(cells.radius[dim], 0))
                            go = (reach + ROUNDING * length >= bars[:, None]) & ~go & (cells.parts[dim] > 0)
                        rows = []
                        for cell in np.flatnonzero(go.any(axis=0)).tolist():
                            who = np.flatnonzero(go[:, cell])
                            rows += [(dim, cell, p, int(part["id"].iloc[0]) // every % slices, part["id"].to_numpy()[who], list(part["v"].to_numpy()[who]), bars[who]) for p in range(cells.parts[dim][cell])]
                        yield pd.DataFrame(rows, columns=["dim", "cell", "part", "slice", "ids", "vectors", "bars"])

        return run

    def search(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ask) and len(have):
            tree = pickle.loads(have["tree"].iloc[0])
            for ids, x, bars in zip(ask["ids"], ask["vectors"], ask["bars"], strict=True):
                query, id_, score = tree.search(ids, np.stack(list(x)), k, factor, bars)
                out.append((ids[query], id_, score))
        query, id_, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": query, "vec_id": id_, "score": score})

    def searched(queries: DataFrame, again: bool) -> DataFrame:
        """Queries meet a shard in slices, so that no task holds all of them."""
        ask = queries.mapInPandas(visiting(again), packs)
        have = trees.select("dim", "cell", "part", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
        keys = ["dim", "cell", "part", "slice"]
        return ask.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    home = written(ranked(searched(asked, False)), "ann-home")
    bars = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar"))
    rest = asked.join(bars, asked["id"] == bars["query_id"], "left").select("id", "dim", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
    return ranked(home.drop("rank").unionByName(searched(rest, True))).select("query_id", "rank", "vec_id", "score")


def op10_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, factor=FACTOR)


#: How far pruning is relaxed in the query; 1 is exact.
FACTOR = 1.0


def op10_sql() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(c.e, q.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""
