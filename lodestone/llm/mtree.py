"""Exact top-k search by inner product over M-trees, searched best node first.

Vectors become integer arrays. Each x gets one more coordinate sqrt(M - |x|^2), M the table's largest squared norm, so
that the Euclidean order from a query equals the order of inner products: squared distance is |q|^2 + M - 2 q.x. A tree
has pages of vectors, each with a routing vector, a covering radius and its distance from the parent's routing vector.
Pages are visited by their least possible distance; entries whose stored parent distance already excludes them by the
triangle inequality are never compared. Queries are searched side by side: in each round, every query that still has a
promising page visits its best one, and those at the same page share products.

The table is dealt out by distance: each vector goes to the nearest of at most ``CELLS`` pivots, fitted on a bounded
sample, and a cell with many vectors becomes several trees. The sample also bounds each query's k-th best score from
below. A query is sent only to the cells whose pivot and covering radius leave room for a better score, with that bound
to start from; where vectors have no clusters, these are all cells, and queries pass each tree in Arrow batches. What
reaches the driver is the sample, and a row a cell. The k best of each tree are merged by rank.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; rows with equal id
and vector count once; rows with the query's own id are not its candidates; ties go to the smaller id; vectors of
different lengths compare over their common components; an empty table gives no rows; ids that are null take no part;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import tidy, written
from lodestone.session import ensure_importable

PAGE, FANOUT, SLACK = 2048, 8, 1e-7
#: Pivots at most, and rows of the sample they are fitted on; both are broadcast.
CELLS, SAMPLE = 1024, 4096
GROUP = 256  # queries that share a product
_RANK = 20  # bits of a key for the place of an id in its tree


class Node:
    """An inner node has children; a leaf has the rows [lo, hi) of the tree's arrays."""

    __slots__ = ("children", "hi", "lo", "parent_distance", "radius", "route")

    def __init__(self, route: int, radius: float, lo: int, hi: int):
        self.route, self.radius, self.lo, self.hi = route, radius, lo, hi
        self.children: list[Node] = []
        self.parent_distance = 0.0


class MTree:
    """``top``: a bound of the squared norms, the largest by default. ``computed`` counts distances and products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT, top: float = 0.0):
        self.ids, self.x, self.page, self.fanout = ids, vectors.astype(np.float64), page, fanout
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        self.top = max(top, float(self.norms.max())) if len(ids) else top
        self.last = np.sqrt(np.maximum(self.top - self.norms, 0.0))
        self.order = np.arange(len(ids))
        self.computed = 0
        self.pages: list[Node] = []
        self.root = self._grow(0, len(ids)) if len(ids) else None
        self.x, self.ids, self.last, self.norms = self.x[self.order], self.ids[self.order], self.last[self.order], self.norms[self.order]
        self.place = np.empty(len(ids), np.int64)
        self.place[self.order] = np.arange(len(ids))
        self.parent = np.zeros(len(ids))
        if self.root:
            self._measure(self.root)
            # Entries of a page lie in the order of their parent distance, so those in reach are a range.
            sort = np.concatenate([p.lo + np.argsort(self.parent[p.lo : p.hi], kind="stable") for p in self.pages])
            moved = np.empty(len(ids), np.int64)
            moved[sort] = np.arange(len(ids))
            self.x, self.ids, self.parent, self.last, self.norms = self.x[sort], self.ids[sort], self.parent[sort], self.last[sort], self.norms[sort]
            self._renumber(self.root, moved)
            by_id = np.argsort(self.ids, kind="stable")
            self.rank = np.empty(len(ids), np.int64)
            self.rank[by_id] = np.arange(len(ids))
            self.by_id = by_id
        # Doubles hold the inner products exactly unless components are large.
        self.exact = self.x.astype(np.int64) if len(ids) and np.abs(self.x).max() >= 2**22 else None

    def _between(self, a: int, rows: np.ndarray) -> np.ndarray:
        """Distances among vectors of the tree, with the added coordinate."""
        square = self.norms[a] + self.norms[rows] - 2 * (self.x[rows] @ self.x[a]) + (self.last[rows] - self.last[a]) ** 2
        return np.sqrt(np.maximum(square, 0.0))

    def _grow(self, lo: int, hi: int) -> Node:
        rows = self.order[lo:hi]
        route = int(rows[0])
        node = Node(route, 0.0, lo, hi)
        if hi - lo <= self.page:
            return node
        # Farthest-point routing objects; each vector goes to its nearest.
        routes, nearest, owner = [route], self._between(route, rows), np.zeros(hi - lo, np.int64)
        for k in range(1, self.fanout):
            far = int(np.argmax(nearest))
            if nearest[far] == 0:
                break
            routes.append(int(rows[far]))
            distance = self._between(routes[-1], rows)
            closer = distance < nearest
            nearest[closer], owner[closer] = distance[closer], k
        if len(routes) == 1:
            return node  # equal vectors: one page, whatever its length
        sort = np.argsort(owner, kind="stable")
        self.order[lo:hi] = rows[sort]
        ends = np.cumsum(np.bincount(owner, minlength=len(routes)))
        for k, end in enumerate(ends):
            start = 0 if k == 0 else int(ends[k - 1])
            if end > start:
                at = lo + start + int(np.flatnonzero(self.order[lo + start : lo + int(end)] == routes[k])[0])
                self.order[[lo + start, at]] = self.order[[at, lo + start]]
                node.children.append(self._grow(lo + start, lo + int(end)))
        return node

    def _measure(self, node: Node) -> None:
        node.route = int(self.place[node.route])
        rows = np.arange(node.lo, node.hi)
        distance = self._between(node.route, rows)
        node.radius = float(distance.max())
        if not node.children:
            self.pages.append(node)
            self.parent[node.lo : node.hi] = distance
        for child in node.children:
            self._measure(child)
            child.parent_distance = float(self._between(node.route, np.array([child.route]))[0])

    def _renumber(self, node: Node, moved: np.ndarray) -> None:
        node.route = int(moved[node.route])
        for child in node.children:
            self._renumber(child, moved)

    def search_many(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``search``, for each query, if scores fit a key of score and id; else one by one.

        ``least``: a score that the k-th best of the whole table has at least; what is below may be left out.
        """
        largest = max(float(np.abs(self.x).max(initial=0)), float(np.abs(queries).max(initial=0)))
        if self.root is None or len(self.ids) >= 1 << _RANK or largest**2 * self.x.shape[1] >= 1 << 42:
            return [self.search(q, o, k, x) for q, o, x in zip(queries, own.tolist(), least if least is not None else [-np.inf] * len(queries), strict=True)]
        n, none = len(queries), -(1 << 63)
        base = np.einsum("ij,ij->i", queries, queries) + self.top
        slack = SLACK * (1 + base)
        routes = np.array([p.route for p in self.pages])
        radius = np.array([p.radius for p in self.pages])
        # Bounds pass down the tree: a page is as far as the farthest bound among the nodes that hold it.
        at = np.sqrt(np.maximum(base[:, None] - 2 * (queries @ self.x[routes].T), 0))
        bound = np.maximum(at - radius, 0)
        self._narrow(self.root, queries, base, bound)
        self.computed += n * len(routes)
        order = np.argsort(bound, axis=1, kind="stable")
        best = np.full((n, k), none, np.int64)
        worst = np.full(n, np.inf) if least is None else base - 2.0 * least + 2
        lo_own, hi_own = np.searchsorted(self.ids[self.by_id], own, "left"), np.searchsorted(self.ids[self.by_id], own, "right")
        live = np.arange(n)
        for turn in range(len(routes)):
            page_of = order[live, turn]
            least = bound[live, page_of]
            going = least * least <= worst[live] + slack[live]
            live, page_of = live[going], page_of[going]
            if not live.size:
                break
            for number in np.unique(page_of):
                page, who = self.pages[number], live[page_of == number]
                reach, near = np.sqrt(np.maximum(worst[who] + slack[who], 0)), at[who, number]
                lows = page.lo + np.searchsorted(self.parent[page.lo : page.hi], near - reach, "left")
                highs = page.lo + np.searchsorted(self.parent[page.lo : page.hi], near + reach, "right")
                by_low = np.argsort(lows, kind="stable")
                by_low = by_low[lows[by_low] < highs[by_low]]
                for some in np.split(by_low, range(GROUP, len(by_low), GROUP)):  # queries whose ranges are alike
                    if some.size:
                        self._compare(queries, who[some], int(lows[some].min()), int(highs[some].max()), k, best, worst, base, lo_own, hi_own)
        out = []
        for row in np.sort(best, axis=1)[:, ::-1]:
            row = row[row != none]
            rank = -row & (1 << _RANK) - 1
            out.append((self.ids[self.by_id[rank]], row + rank >> _RANK))
        return out

    def _compare(self, queries, who, lo, hi, k, best, worst, base, lo_own, hi_own) -> None:
        """Products of queries with the entries from lo to hi, into their best and worst."""
        none = -(1 << 63)
        self.computed += (hi - lo) * len(who)
        key = (queries[who] @ self.x[lo:hi].T).astype(np.int64) << _RANK
        key -= self.rank[lo:hi]
        for row in np.flatnonzero(hi_own[who] > lo_own[who]).tolist():
            mine = self.by_id[lo_own[who[row]] : hi_own[who[row]]]
            key[row, mine[(mine >= lo) & (mine < hi)] - lo] = none
        better = np.flatnonzero((key > best[who].min(axis=1)[:, None]).any(axis=1))
        if better.size:
            mine = who[better]
            both = np.concatenate([best[mine], key[better]], axis=1)
            best[mine] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            low = best[mine].min(axis=1)
            worst[mine] = np.minimum(worst[mine], np.where(low == none, np.inf, base[mine] - 2.0 * (low + (1 << _RANK) >> _RANK) + 2))

    def _narrow(self, node: Node, queries: np.ndarray, base: np.ndarray, bound: np.ndarray) -> None:
        if not node.children:
            return
        distance = np.sqrt(np.maximum(base - 2 * (queries @ self.x[node.route]), 0))
        self.computed += len(queries)
        inside = [i for i, p in enumerate(self.pages) if node.lo <= p.lo and p.hi <= node.hi]
        bound[:, inside] = np.maximum(bound[:, inside], np.maximum(distance - node.radius, 0)[:, None])
        for child in node.children:
            self._narrow(child, queries, base, bound)

    def search(self, q: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ids and inner products of the k best candidates, ties to the smaller id."""
        if self.root is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = float(q @ q) + self.top
        slack = SLACK * (1 + base)

        def distance(rows) -> np.ndarray:
            self.computed += len(rows) if not np.isscalar(rows) else 1
            return np.sqrt(np.maximum(base - 2 * (self.x[rows] @ q), 0.0))

        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        worst = base - 2 * least + 2  # squared distance of the k-th best
        first = float(distance(np.array([self.root.route]))[0])
        heap = [(max(0.0, first - self.root.radius), 0, self.root, first)]
        n = 1
        while heap:
            least, _, node, at = heapq.heappop(heap)
            if least * least > worst + slack:
                break
            reach = np.sqrt(max(worst + slack, 0.0))
            if node.children:
                near = [c for c in node.children if abs(at - c.parent_distance) - c.radius <= reach]
                if near:
                    for c, d in zip(near, distance(np.array([c.route for c in near])), strict=True):
                        bound = max(0.0, float(d) - c.radius)
                        if bound * bound <= worst + slack:
                            heapq.heappush(heap, (bound, n, c, float(d)))
                            n += 1
                continue
            rows = np.arange(node.lo, node.hi)
            rows = rows[np.abs(at - self.parent[rows]) <= reach]
            rows = rows[self.ids[rows] != own]
            if not len(rows):
                continue
            self.computed += len(rows)
            score = (self.x[rows] @ q).astype(np.int64) if self.exact is None else self.exact[rows] @ q.astype(np.int64)
            best, best_ids = np.concatenate([best, score]), np.concatenate([best_ids, self.ids[rows]])
            if len(best) > k:
                kept = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[kept], best_ids[kept]
            if len(best) == k:
                worst = min(worst, base - 2 * float(best.min()))
        kept = np.lexsort((best_ids, -best))
        return best_ids[kept], best[kept]


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    width = width or int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    take = np.minimum(sizes, width)
    rows = np.repeat(np.arange(len(sizes)), take)
    cols = np.arange(len(rows)) - np.repeat(np.cumsum(take) - take, take)
    out[rows, cols] = flat[np.repeat(offsets[:-1] - offsets[0], take) + cols]
    return out


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def pivots_of(x: np.ndarray, cells: int, top: float, rounds: int = 5) -> np.ndarray:
    """Centres of at most ``cells`` groups of the sample, with the added coordinate; by a few rounds of k-means."""
    x = np.column_stack([x, np.sqrt(np.maximum(top - _squares(x), 0.0))])
    draw = np.random.default_rng(1)
    centres = x[draw.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        owner = np.argmin(_squares(centres) - 2 * (x @ centres.T), axis=1)
        held = np.bincount(owner, minlength=len(centres))
        sums = np.stack([np.bincount(owner, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def _gaps(x: np.ndarray, added: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors, whose added coordinate is given, from pivots; missing components count as zero."""
    width = min(x.shape[1], pivots.shape[1] - 1)
    inner = x[:, :width] @ pivots[:, :width].T + added[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum((_squares(x) + added**2)[:, None] + _squares(pivots) - 2 * inner, 0.0))


def _dealer(pivots: np.ndarray, top: float, sample_ids: np.ndarray, sample: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each vector's cell and distance, and to queries the k-th best score of the sample."""
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            x = _matrix(batch.column("v"))
            gaps = _gaps(x, np.sqrt(np.maximum(top - _squares(x), 0.0)), pivots)
            cell = np.argmin(gaps, axis=1)
            ask = batch.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            least = np.full(len(x), -np.inf)
            if len(sample) > k and ask.any():
                width = min(x.shape[1], sample.shape[1])
                score = x[ask, :width] @ sample[:, :width].T
                score[batch.column("vec_id").to_numpy()[ask][:, None] == sample_ids] = -np.inf
                kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
                least[ask] = kth - 1e-9 * np.abs(kth)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("ask"), pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(x)), cell]), pa.array(least)], ["vec_id", "v", "ask", "cell", "gap", "least"])

    return run


def _router(pivots: np.ndarray, top: float, radius: np.ndarray, parts: np.ndarray):
    every = np.repeat(np.arange(len(parts)), parts)
    nth = np.arange(len(every)) - np.repeat(np.cumsum(parts) - parts, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, to each tree of the cells in reach."""
        step = max(1, 16_384 // max(1, len(every)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            x = _matrix(batch.column("v"))
            base = _squares(x) + top
            worst = base - 2 * batch.column("least").to_numpy() + 2
            near = _gaps(x, np.zeros(len(x)), pivots) - radius
            row, tree = np.nonzero((near <= np.sqrt(np.maximum(worst + SLACK * (1 + base), 0.0))[:, None])[:, every])
            asked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(every[tree].astype(np.int32)), pa.array(nth[tree].astype(np.int32)), pa.array(np.ones(len(row), bool)), asked.column("vec_id"), asked.column("v"), asked.column("least")], ["cell", "part", "ask", "vec_id", "v", "least"])

    return run


def _searcher(k: int, page: int, top: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tree, its vectors before the queries."""
        part, ids, rows, tree = None, [], [], None
        for batch in batches:
            parts = batch.column("cell").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    part, ids, rows, tree = parts[lo], [], [], None
                piece = batch.slice(lo, hi - lo)
                asks = piece.column("ask").to_numpy(zero_copy_only=False).astype(bool)
                own = piece.filter(pa.array(~asks))
                if own.num_rows:
                    ids.append(own.column("vec_id").to_numpy())
                    rows.append(_matrix(own.column("v")))
                queries = piece.filter(pa.array(asks))
                if not queries.num_rows or not ids:
                    continue
                if tree is None:
                    width = max(r.shape[1] for r in rows)
                    tree = MTree(np.concatenate(ids), np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]), page, top=top)
                asked, least = queries.column("vec_id").to_numpy(), queries.column("least").to_numpy()
                for at in range(0, len(asked), 1024):
                    found = tree.search_many(_matrix(queries.column("v").slice(at, 1024), tree.x.shape[1]), asked[at : at + 1024], k, least[at : at + 1024])
                    columns = [np.repeat(asked[at : at + 1024], [len(v) for v, _ in found]), np.concatenate([v for v, _ in found]), np.concatenate([s for _, s in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["query_id", "vec_id", "score"])

    return run


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as double; null where x is not finite, for floor would make a number of it."""
    return F.transform(vector, lambda x: F.when(_finite(x.cast("double")), F.floor(x.cast("double") * scale).cast("double")))


def search(vectors: DataFrame, is_query: Column, k: int = 20, tree_rows: int = 16_384, page: int = PAGE, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """``vectors``: vec_id, v (array<double> of whole numbers). Per query row its k best: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ensure_importable(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", _finite)).distinct()
    rows = written(rows.withColumn("ask", F.coalesce(is_query, F.lit(False))), "topk-rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, top = rows.agg(F.count(F.lit(1)), F.max(square)).head()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    seen = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    seen_x = _matrix(seen.column("v").combine_chunks())
    cells = min(cells, max(1, -(-n // tree_rows), min(spark.sparkContext.defaultParallelism, n // 1024)))
    pivots = pivots_of(seen_x, cells, top)
    kinds = "vec_id long, v array<double>, ask boolean, cell int, gap double, least double"
    dealt = written(rows.mapInArrow(tidy(_dealer(pivots, top, seen.column("vec_id").to_numpy(), seen_x, k)), kinds), "topk-cells")
    radius, parts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for cell, held, far in dealt.groupBy("cell").agg(F.count(F.lit(1)), F.max("gap")).collect():  # a row a cell
        radius[cell], parts[cell] = far + SLACK * (1 + top**0.5), -(-held // tree_rows)
    split = F.create_map(*[F.lit(x) for c in np.flatnonzero(parts > 1).tolist() for x in (c, int(parts[c]))]) if (parts > 1).any() else F.create_map(F.lit(-1), F.lit(1))
    part = F.pmod(F.xxhash64("vec_id"), F.coalesce(F.element_at(split, F.col("cell")), F.lit(1)).cast("long")).cast("int")
    stored = dealt.select("cell", part.alias("part"), F.lit(False).alias("ask"), "vec_id", "v", F.lit(None).cast("double").alias("least"))
    asking = dealt.filter("ask").select("vec_id", "v", "least").mapInArrow(tidy(_router(pivots, top, radius, parts)), "cell int, part int, ask boolean, vec_id long, v array<double>, least double")
    streams = stored.unionByName(asking).repartition(max(1, int(parts.sum())), "cell", "part").sortWithinPartitions("cell", "part", "ask", "vec_id")
    found = streams.mapInArrow(tidy(_searcher(k, page, top)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
