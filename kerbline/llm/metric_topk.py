"""Exact top-k by inner product: best-first search in M-trees.

Integer vectors v get one more component, sqrt(M - |v|^2) with M the greatest squared length, and queries
a zero. Then |q - v|^2 = |q|^2 + M - 2 q.v: the highest inner products are the nearest in a metric space.

Vectors go to the nearest of about sqrt(n) / 4 pivots; a cell of more than ``TREE_ROWS`` rows becomes
several trees by a hash. A tree is built in a task and kept as pages: an inner page holds, per child, the
routing vector, the covering radius and the distance to the page's own routing vector; a leaf holds
vectors and these distances. Trees are dealt to groups of bounded size, and a task searches the trees of a
group for a block of queries at once. It opens the page with the best bound first. For the queries that
the page may still serve, the stored parent distances rule entries out by the triangle inequality before any
distance to them is computed; what is left is one matrix product of queries and entries. Scores of leaf
entries are exact integers; bounds have slack, so ties are never lost.

Every query first searches the group of its own cell. Its k-th score then tells which cells may still hold
a hit, and it goes on to the groups that hold one. Queries travel as packed blocks, one row per block and
group, with the vectors of those that can't be ruled out. Where vectors have no structure little can be
ruled out and the work grows with queries times rows; exactness demands it.

Equal vectors are folded into one entry with their k + 1 smallest ids: more can't be among the k best.
Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as padded
with zeros. Rows equal in id and vector count once; an id never meets itself.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import stored

TREE_ROWS = 4096
#: Rows that the trees of one group hold together, at most; fewer where cores would be idle.
GROUP_ROWS = 1 << 17
#: Queries that a task holds together.
QUERY_BLOCK = 1 << 17
LEAF = 96
FANOUT = 16
_EXACT = 1 << 53


def integer_vector(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def finite(vector: str) -> Column:
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))


def _padded(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _lifted(m: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([m, np.sqrt(np.maximum(0.0, longest - np.einsum("ij,ij->i", m, m)))])


def _distances(m: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = m - point
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build_tree(m: np.ndarray, root: np.ndarray) -> list[dict]:
    """Pages of a tree over the rows of ``m``; page 0 is the root, whose routing vector is ``root``."""
    pages: list[dict] = []

    def add(rows: np.ndarray, parent: np.ndarray) -> int:
        page = len(pages)
        pages.append({})
        if len(rows) <= LEAF:
            pages[page] = {"leaf": True, "at": rows, "radius": np.zeros(len(rows)), "away": _distances(m[rows], parent)}
            return page
        fan = min(FANOUT, -(-len(rows) // LEAF))
        routing = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        apart = np.stack([_distances(m[rows], m[r]) for r in routing])
        group = apart.argmin(axis=0)
        if np.bincount(group, minlength=fan).max() > 0.9 * len(rows):  # hardly told apart: cut by place
            group = np.arange(len(rows)) * fan // len(rows)
        children, radius, kept = [], [], []
        for g in range(fan):
            inside = group == g
            if inside.any():
                children.append(add(rows[inside], m[routing[g]]))
                radius.append(apart[g][inside].max())
                kept.append(routing[g])
        kept = np.array(kept)
        pages[page] = {"leaf": False, "at": kept, "child": np.array(children), "radius": np.array(radius), "away": _distances(m[kept], parent)}
        return page

    add(np.arange(len(m)), root)
    return pages


@dataclass
class Page:
    """Entries with their points, radii, distances to the page's routing vector, and children or ids."""

    leaf: bool
    points: np.ndarray
    radius: np.ndarray
    away: np.ndarray
    child: list["Page"]
    ids: list[list[int]]


class Block:
    """Queries that search together: ids, vectors, and per query the k best so far and the least score that counts."""

    def __init__(self, own: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, longest: float) -> None:
        self.own, self.whole, self.least, self.k = own, q, least.copy(), k
        self.q = q.astype(float)
        self.exact = longest < _EXACT
        self.reach = np.einsum("ij,ij->i", self.q, self.q) + longest
        self.slack = 0.25 + 1e-9 * self.reach
        self.pad = 1e-6 + 4 * np.sqrt(np.finfo(float).eps * self.reach)
        self.best: list[list[tuple[int, int]]] = [[] for _ in own]  # heaps, the worst on top

    def bound(self, at: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        """The best score that something no nearer than ``nearest`` can have, for the queries ``at``."""
        near = np.maximum(nearest - self.pad[at, None], 0.0)
        return (self.reach[at, None] - near * near) / 2 + self.slack[at, None]

    def distances(self, at: np.ndarray, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.reach[at, None] - 2 * products, 0.0))

    def take(self, at: int, scores: np.ndarray, entries: np.ndarray, page: Page) -> None:
        heap, own = self.best[at], self.own[at]
        for i in np.argsort(-scores, kind="stable"):
            score = scores[i]
            if len(heap) == self.k and score < self.least[at]:
                break
            entry = entries[i]
            exact = int(score) if self.exact else int((page.points[entry, :-1].astype(np.int64).astype(object) * self.whole[at].astype(object)).sum())
            for other in page.ids[entry]:
                if other != own:
                    if len(heap) < self.k:
                        heapq.heappush(heap, (exact, -other))
                    elif (exact, -other) > heap[0]:
                        heapq.heapreplace(heap, (exact, -other))
            if len(heap) == self.k:
                worst = float(heap[0][0])
                self.least[at] = max(self.least[at], worst if self.exact else worst - self.slack[at])

    def search(self, roots: list[tuple[Page, np.ndarray]]) -> None:
        """``roots``: root pages and the distances of all queries to their routing vectors."""
        everyone = np.arange(len(self.own))
        nearest_first = sorted(roots, key=lambda r: float(r[1].min()))
        queue = [(-math.inf, n, page, everyone, np.full(len(everyone), math.inf), here) for n, (page, here) in enumerate(nearest_first)]
        heapq.heapify(queue)
        opened = len(queue)
        while queue:
            _, _, page, at, hope, here = heapq.heappop(queue)
            on = hope >= self.least[at]
            if not on.any():
                continue
            at, here = at[on], here[on]
            able = self.bound(at, np.abs(here[:, None] - page.away) - page.radius) >= self.least[at, None]
            rows, columns = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
            if not len(rows):
                continue
            at, able = at[rows], able[np.ix_(rows, columns)]
            products = self.q[at] @ page.points[columns, :-1].T
            if page.leaf:
                able &= products + (0.0 if self.exact else self.slack[at, None]) >= self.least[at, None]
                for r in np.flatnonzero(able.any(axis=1)):
                    some = np.flatnonzero(able[r])
                    self.take(int(at[r]), products[r, some] + (0.0 if self.exact else self.slack[at[r]]), columns[some], page)
            else:
                away = self.distances(at, products)
                further = np.where(able, self.bound(at, away - page.radius[columns]), -math.inf)
                for c in range(len(columns)):
                    able_c = np.flatnonzero(further[:, c] >= self.least[at])
                    if len(able_c):
                        opened += 1
                        heapq.heappush(queue, (-float(further[able_c, c].max()), opened, page.child[columns[c]], at[able_c], further[able_c, c], away[able_c, c]))


def top_inner_products(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id: str = "vec_id", vector: str = "embedding", tree_rows: int = TREE_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): rows whose id is divisible by ``every`` against all other rows."""
    clean = vectors.where(F.col(id).isNotNull() & finite(vector)).select(F.col(id).alias("id"), integer_vector(vector, scale).alias("v"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = clean.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    entries = stored(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    queries = clean.where(F.col("id") % every == 0).distinct().select("id", "v")

    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = entries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("longest")).first()
    n, dim, longest = shape["n"], shape["dim"] or 0, float(shape["longest"] or 0.0)
    # Grows with the square root of the table: a proven bound for what every task is sent.
    some = entries.orderBy(F.xxhash64("v"), "v").limit(max(1, math.ceil(math.sqrt(n) / 4))).toPandas()
    pivots = _lifted(_padded(some["v"], dim), longest)

    def to_pivots(m: np.ndarray) -> np.ndarray:
        """Inner products with the pivots: all lifted vectors are equally long, so the greatest is the nearest."""
        return m @ pivots.T

    @F.pandas_udf("cell int, away double")
    def nearest(column: pd.Series) -> pd.DataFrame:
        m = _lifted(_padded(column, dim), longest)
        cell = to_pivots(m).argmax(axis=1) if len(m) else np.zeros(0, dtype=int)
        return pd.DataFrame({"cell": cell.astype("int32"), "away": np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1))})

    if not n:
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id), F.lit(0).cast("long").alias("score")).limit(0)
    assigned = stored(entries.withColumn("c", nearest("v")).select("ids", "v", "c.*"))
    cells = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas()
    radius = np.full(len(pivots), -np.inf)
    size = np.zeros(len(pivots), dtype=int)
    size[cells["cell"]], radius[cells["cell"]] = cells["n"], cells["radius"]
    trees = -(-size // tree_rows)
    cores = max(vectors.sparkSession.sparkContext.defaultParallelism, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group_rows = max(1, min(group_rows, -(-n // cores)))
    # Trees in the order of their cells, cut into groups of even size.
    per_tree = np.repeat(size / np.maximum(trees, 1), trees)
    groups = ((np.cumsum(per_tree) - per_tree / 2) // group_rows).astype(int)
    first_tree = np.concatenate([[0], np.cumsum(trees)[:-1]])
    group_cells = [np.unique(np.repeat(np.arange(len(pivots)), trees)[groups == g]) for g in range(groups.max() + 1)]
    of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
    dealt = assigned.withColumn("tree", F.pmod(F.xxhash64("v"), of(trees)).cast("int"))
    dealt = dealt.withColumn("grp", F.element_at(F.array(*[F.lit(int(g)) for g in groups]), (of(first_tree) + F.col("tree") + 1).cast("int")))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", ignore_index=True)
        m = _lifted(_padded(part["v"], dim), longest)
        pages = build_tree(m, pivots[part["cell"].iat[0]])
        rows = []
        for i, p in enumerate(pages):
            rows.append((
                part["grp"].iat[0], part["cell"].iat[0], part["tree"].iat[0], i, p["leaf"], m[p["at"]].tobytes(), p["radius"].tobytes(), p["away"].tobytes(),
                [] if p["leaf"] else p["child"].tolist(), [list(part["ids"].iat[a]) for a in p["at"]] if p["leaf"] else []))
        return pd.DataFrame(rows, columns=["grp", "cell", "tree", "page", "leaf", "points", "radius", "away", "child", "ids"])

    pages = stored(dealt.withColumn("key", F.element_at("ids", 1)).groupBy("grp", "cell", "tree").applyInPandas(
        build, "grp int, cell int, tree int, page int, leaf boolean, points binary, radius binary, away binary, child array<int>, ids array<array<bigint>>"))

    def load(part: pd.DataFrame) -> list[tuple[int, Page]]:
        """(cell, root page) of every tree."""
        loaded: dict[tuple, Page] = {}
        for r in part.itertuples():
            ids = [list(x) for x in r.ids] if r.leaf else []
            loaded[r.cell, r.tree, r.page] = Page(
                r.leaf, np.frombuffer(r.points).reshape(-1, dim + 1), np.frombuffer(r.radius), np.frombuffer(r.away), list(r.child), ids)
        for (cell, tree, _), page in loaded.items():
            page.child = [loaded[cell, tree, c] for c in page.child]
        return [(cell, page) for (cell, _, number), page in sorted(loaded.items(), key=lambda x: x[0]) if number == 0]

    answer = "query_id bigint, other bigint, score bigint"
    packed = "grp int, part int, ids binary, v binary, least binary"

    def visit(blocks: pd.DataFrame, stored_pages: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(blocks) and len(stored_pages):
            roots = load(stored_pages)
            for ids, v, least in zip(blocks["ids"], blocks["v"], blocks["least"]):
                own = np.frombuffer(ids, dtype=np.int64)
                block = Block(own, np.frombuffer(v, dtype=np.int64).reshape(len(own), -1), np.frombuffer(least), k, longest)
                here = block.distances(np.arange(len(own)), to_pivots(np.column_stack([block.q, np.zeros(len(own))])))
                block.search([(page, here[:, cell]) for cell, page in roots])
                rows.extend((int(o), -other, min(max(score, -(1 << 63)), (1 << 63) - 1)) for o, heap in zip(own, block.best) for score, other in heap)
        return pd.DataFrame(rows, columns=["query_id", "other", "score"]).astype("int64")

    parts = max(1, -(-queries.count() // QUERY_BLOCK))

    def searched(blocks: DataFrame) -> DataFrame:
        """``blocks``: rows of ``packed``."""
        copied = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else pages.withColumn("part", F.lit(0))
        return blocks.groupBy("grp", "part").cogroup(copied.groupBy("grp", "part")).applyInPandas(visit, answer)

    def pack(group: int, ids: np.ndarray, v: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
        part = ids % parts
        for p in np.unique(part):
            on = part == p
            yield group, int(p), ids[on].tobytes(), v[on].tobytes(), least[on].tobytes()

    def table_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in packed.split(", ")])

    def own_group(m: np.ndarray) -> np.ndarray:
        """The group of a tree of the nearest cell that has any."""
        near = to_pivots(np.column_stack([m, np.zeros(len(m))]))
        near[:, trees == 0] = -np.inf
        return groups[first_tree[near.argmax(axis=1)]]

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m, ids = _padded(batch["v"], dim), batch["id"].to_numpy()
            home = own_group(m)
            yield table_of([row for g in np.unique(home) for row in pack(
                int(g), ids[home == g], m[home == g].astype(np.int64), np.full((home == g).sum(), -np.inf))])

    first_hits = stored(searched(queries.mapInPandas(at_home, packed)))
    kth = first_hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "other"))).where(F.col("r") == k)
    known = queries.join(kth.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth")), "id", "left")

    def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m, ids = _padded(batch["v"], dim), batch["id"].to_numpy()
            block = Block(ids, m.astype(np.int64), batch["kth"].fillna(-np.inf).to_numpy(dtype=float), k, longest)
            least = block.least if block.exact else block.least - block.slack
            everyone = np.arange(len(ids))
            away = block.distances(everyone, to_pivots(np.column_stack([m, np.zeros(len(m))])))
            able = block.bound(everyone, away - radius) >= least[:, None]
            home, rows = own_group(m), []
            for g, inside in enumerate(group_cells):
                on = able[:, inside].any(axis=1) & (home != g)
                if on.any():
                    rows.extend(pack(g, ids[on], block.whole[on], least[on]))
            if rows:
                yield table_of(rows)

    further = searched(known.select("id", "v", "kth").mapInPandas(onward, packed))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "other"))
    hits = first_hits.unionAll(further).distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", F.col("other").alias(id), "score")
