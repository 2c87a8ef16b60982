"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Vectors become whole numbers, ``floor(64 * x)``. Rows go to the nearest of at most ``PIVOTS`` pivots, chosen from a bounded
sample; neighbouring small pivots share a cell, and a cell of more than ``DATA_BLOCK`` rows is split into blocks by hash.
Each block's cover tree is built once and written; the queries are gathered and indexed in the same way, in groups.

A pair of a query group and a cell, and later a pair of tree nodes, is left out when its upper bound is under the worst
kth score of the query side. Groups visit cells from the best bound on, in rounds of 1, 4, 16, ... cells; each query's
kth score so far travels with its group, so later rounds and nodes are cut by it. A task holds one block while the groups
that visit it stream past; a block that very many groups visit is dealt in parts of ``GROUPS_AT_ONCE``. The pivots and
the cells' centres and radii are all that is sent to every task, at most ``PIVOTS`` of each.

An inner node of a cover tree is covered by children of at most half its radius. A node stays a leaf where it has at most
``leaf`` rows, or where such a cover would take a centre for fewer than ``mean_child`` rows: vectors that lie equally far
apart, as random ones in many dimensions do, can't be told apart by any such bound, and their leaf is scored as a matrix.

Defined cases: a vector that is null, empty, or holds a null or non-finite component (or one whose 64-fold isn't finite)
takes no part; vectors of unequal length are compared on their common components; ties go to the smaller id. Rows are
told apart, not ids: a query never answers itself, but its copies do, each of the rows of a repeated query id is a query
of its own, and copies of one id each take a rank. With fewer than k candidates all are given; a null id takes no part; an
empty table gives an empty table; other columns are ignored. Scores are exact whole numbers of any size of component;
those beyond 64 bits are given, and ranked, as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seamline.llm.arrow import quoted
from seamline.llm.storage import scratch, written

SCALE = 64
#: Rows that pivots are chosen from, bytes of their vectors at most, and pivots.
SAMPLE_ROWS, SAMPLE_BYTES, PIVOTS = 4096, 16 << 20, 256
#: Rows of a block of data and of a group of queries; groups that one copy of a block serves; rows scored at once, at first and at most.
DATA_BLOCK, QUERY_GROUP, GROUPS_AT_ONCE, FIRST_SCORED, SCORED_ROWS = 8192, 256, 64, 64, 2048
#: Least rows of an inner node, and rows of its children on average: of data, and of queries, whose nodes are few.
LEAF, MEAN_CHILD = 32, 8
QUERY_LEAF, QUERY_MEAN_CHILD = 8, 2
#: Rounds visit so many times more cells than the round before.
GROWTH = 4
#: Up to this size sums of products are exact in double precision.
EXACT = float(1 << 53)
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


@dataclass
class Tree:
    """A cover tree over rows; node ``i`` has rows ``starts[i]:stops[i]``, its centre first, and children ``first[i]:first[i] + count[i]``."""

    x: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @cached_property
    def norms(self) -> np.ndarray:
        """The largest norm of each node's rows."""
        norms = np.linalg.norm(self.x, axis=1)
        return np.array([norms[a:b].max() for a, b in zip(self.starts, self.stops, strict=True)])

    @cached_property
    def centres(self) -> np.ndarray:
        return self.x[self.starts]

    @cached_property
    def most(self) -> float:
        return float(np.abs(self.x).max(initial=0))


def distances(x: np.ndarray, norms: np.ndarray, at: int) -> np.ndarray:
    """Euclidean distances to row ``at``, from squared ``norms``, never too small by more than rounding."""
    return np.sqrt(np.maximum(norms + norms[at] - 2 * (x @ x[at]), 0))


def cover_tree(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, mean_child: int = MEAN_CHILD) -> Tree:
    """The cover tree of ``x``, rows laid out so that each node's are together."""
    order = np.arange(len(x))
    squares = (x * x).sum(1)
    slack = 1e-7 * float(np.sqrt(squares.max(initial=0)))  # what rounding may take from a distance
    starts, stops, radii, first, count = [0], [len(x)], [0.0], [0], [0]
    i = 0
    while i < len(starts):
        a, b = starts[i], stops[i]
        mine = order[a:b]
        near, norms = x[mine], squares[mine]
        nearest = distances(near, norms, 0)
        radius = float(nearest.max())
        radii[i] = radius + slack
        centres, owner = [0], np.zeros(b - a, dtype=np.int64)
        most = (b - a) // mean_child if b - a > leaf and radius > 0 else 0
        while len(centres) <= most and nearest.max() > radius / 2:
            new = int(nearest.argmax())
            d = distances(near, norms, new)
            owner[d < nearest] = len(centres)
            nearest = np.minimum(nearest, d)
            centres.append(new)
        if 1 < len(centres) <= most:
            place = np.ones(b - a)
            place[centres] = 0
            dealt = np.lexsort((place, owner))
            order[a:b] = mine[dealt]
            cuts = a + np.searchsorted(owner[dealt], np.arange(len(centres) + 1))
            first[i], count[i] = len(starts), len(centres)
            starts += cuts[:-1].tolist()
            stops += cuts[1:].tolist()
            for values in (radii, first, count):
                values += [0] * len(centres)
        i += 1
    whole = [np.array(v, dtype=np.int64) for v in (starts, stops, first, count)]
    return Tree(x[order], ids[order], rows[order], whole[0], whole[1], np.array(radii, dtype=float), whole[2], whole[3])


def upper_bounds(centre: np.ndarray, radius: float, norm: float, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """No product of a vector of the first ball with one of each other ball is larger; ``norm`` and ``norms`` are largest norms."""
    with np.errstate(over="ignore", invalid="ignore"):
        dot = centres @ centre
        own, theirs = np.linalg.norm(centre), np.linalg.norm(centres, axis=1)
        both = norm * norms
        ball = dot + own * radii + theirs * radius + radius * radii
        gap = np.maximum(np.sqrt(np.maximum(own**2 + theirs**2 - 2 * dot, 0)) - radius - radii, 0)
        # 2 q.x = |q|^2 + |x|^2 - |q - x|^2
        found = np.fmin(np.fmin(ball, (norm**2 + norms**2 - gap**2) / 2), both)
        return np.nan_to_num(found + 1e-6 * (both + own * theirs), nan=np.inf) + 1e-3


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products, as doubles where they fit and as whole numbers otherwise; ``most`` bounds a product of components."""
    if most * q.shape[1] < EXACT:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, LEAST_LONG, MOST_LONG)


class Search:
    """The best ``k`` of what beats each query's carried kth score and id, by walking a query tree and data trees together."""

    def __init__(self, queries: Tree, k: int, score: np.ndarray | None = None, name: np.ndarray | None = None):
        n = len(queries.x)
        self.q, self.k, self.scored = queries, k, 0
        self.least = np.full(n, -np.inf, dtype=object) if score is None else score
        self.least_id = np.full(n, MOST_LONG, dtype=np.int64) if name is None else name
        self.found: list[list[tuple]] = [[] for _ in range(n)]

    def visit(self, data: Tree) -> None:
        """Takes in the rows of one data tree."""
        q = self.q
        width = max(q.x.shape[1], data.x.shape[1])
        if q.x.shape[1] < width:
            q = self.q = Tree(padded(q.x, width), q.ids, q.rows, q.starts, q.stops, q.radii, q.first, q.count)
        if data.x.shape[1] < width:
            data = Tree(padded(data.x, width), data.ids, data.rows, data.starts, data.stops, data.radii, data.first, data.count)
        if not len(q.x) or not len(data.x):
            return
        most, twins = q.most * data.most, bool(np.isin(q.rows, data.rows).any())
        floor = self.least.astype(float)
        stack = [(0, np.zeros(1, dtype=np.int64))]
        while stack:
            i, nodes = stack.pop()
            a, b = int(q.starts[i]), int(q.stops[i])
            bound = upper_bounds(q.centres[i], q.radii[i], q.norms[i], data.centres[nodes], data.radii[nodes], data.norms[nodes])
            near = bound >= floor[a:b].min()
            nodes, bound = nodes[near], bound[near]
            inner = (data.count[nodes] > 0) & ((data.radii[nodes] >= q.radii[i]) | (q.count[i] == 0))
            if inner.any():
                split = nodes[inner]
                children = np.repeat(data.first[split] - np.cumsum(data.count[split]) + data.count[split], data.count[split]) + np.arange(data.count[split].sum())
                stack.append((i, np.concatenate([nodes[~inner], children])))
            elif len(nodes) and q.count[i]:
                stack += [(c, nodes) for c in range(q.first[i], q.first[i] + q.count[i])]
            elif len(nodes):
                order = np.argsort(-bound, kind="stable")
                nodes, bound = nodes[order], bound[order]
                ends = np.cumsum(data.stops[nodes] - data.starts[nodes])
                at, room = 0, FIRST_SCORED
                while at < len(nodes) and bound[at] >= floor[a:b].min():
                    stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, side="right")))
                    rows = np.concatenate([np.arange(data.starts[n], data.stops[n]) for n in nodes[at:stop]])
                    self._score(a, b, data, rows, most, twins)
                    floor[a:b] = self.least[a:b].astype(float)
                    at, room = stop, min(2 * room, SCORED_ROWS)

    def _score(self, a: int, b: int, data: Tree, rows: np.ndarray, most: float, twins: bool) -> None:
        scores, ids = products(self.q.x[a:b], data.x[rows], most), data.ids[rows]
        self.scored += scores.size
        least = self.least[a:b]
        if scores.dtype != object:
            least = least.astype(float)
        better = (scores > least[:, None]) | (scores == least[:, None]) & (ids < self.least_id[a:b, None])
        if twins:
            better &= self.q.rows[a:b, None] != data.rows[rows]
        for i in np.flatnonzero(better.any(1)):
            which = np.flatnonzero(better[i])
            if len(which) > self.k:
                # A cut at the kth score first, so that only it and its ties are sorted.
                least_of = np.sort(scores[i, which])[-self.k]
                which = which[scores[i, which] >= least_of]
                which = which[np.lexsort((ids[which], -scores[i, which]))[: self.k]]
            mine = self.found[a + i]
            mine += [(-int(scores[i, w]), int(ids[w]), int(data.rows[rows[w]])) for w in which]
            mine.sort()
            del mine[self.k :]
            if len(mine) == self.k:
                self.least[a + i], self.least_id[a + i] = -mine[-1][0], mine[-1][1]


def dual_tree(queries: Tree, blocks: list[Tree], k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Best ``k`` (score, id) of each query row over all blocks, ties to the smaller id, in the order of ``queries.rows``; pairs scored."""
    search = Search(queries, k)
    for block in blocks:
        search.visit(block)
    return [[(-s, i) for s, i, _ in mine] for mine in search.found], search.scored


# ---- vectors in columns


def padded(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` with columns of zeros added, or columns left out, to ``width``."""
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x[:, :width]
    return out


def as_matrix(values: list[bytes]) -> np.ndarray:
    """Rows of doubles in bytes as a matrix, shorter ones filled with zeros."""
    width = max(map(len, values), default=0) // 8
    return np.frombuffer(b"".join(v.ljust(8 * width, b"\0") for v in values), dtype="<f8").reshape(len(values), width)


def pivots_of(x: np.ndarray) -> np.ndarray:
    """At most ``PIVOTS`` rows, each the farthest from those before, laid out as a cover tree so that neighbours are close."""
    if not len(x):
        return x
    squares = (x * x).sum(1)
    chosen, nearest = [0], distances(x, squares, 0)
    while len(chosen) < PIVOTS and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(x, squares, chosen[-1]))
    picked = x[chosen]
    at = np.arange(len(picked))
    return picked[cover_tree(picked, at, at).rows]


def dealt_cells(counts: dict[int, int], limit: int) -> list[tuple[int, int, int]]:
    """``(pivot, cell, parts)``: neighbouring pivots share a cell of up to ``limit`` rows; a larger one has its own, in parts."""
    out, cell, held = [], -1, limit + 1
    for pivot, n in sorted(counts.items()):
        if held + n > limit:
            cell, held = cell + 1, 0
        out.append((pivot, cell, -(-n // limit)))
        held += n
    return out


VECTOR = "row long, id long, asks boolean, pivot int, v binary"
TREE = "rows array<long>, ids array<long>, x binary, starts array<long>, stops array<long>, radii array<double>, first array<long>, count array<long>"
TREE_COLUMNS = [f.split(" ")[0] for f in TREE.split(", ")]
SUMMARY = "centre array<double>, radius double, norm double"


def _tree_row(tree: Tree) -> dict[str, list]:
    return {"rows": [tree.rows], "ids": [tree.ids], "x": [tree.x.astype("<f8").tobytes()], "starts": [tree.starts], "stops": [tree.stops], "radii": [tree.radii], "first": [tree.first], "count": [tree.count]}


def _tree_at(batch: pa.RecordBatch, i: int) -> Tree:
    part = {c: batch.column(batch.schema.get_field_index(c))[i] for c in TREE_COLUMNS}
    listed = lambda c: part[c].values.to_numpy(zero_copy_only=False)
    x = np.frombuffer(part["x"].as_py(), dtype="<f8").reshape(len(listed("rows")), -1)
    return Tree(x, listed("ids"), listed("rows"), listed("starts"), listed("stops"), listed("radii"), listed("first"), listed("count"))


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (row, id, asks, v) with whole-number vectors as bytes and the nearest pivot."""
    squares = (pivots**2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = batch.column(3), batch.column(3).offsets.to_numpy()
            flat = np.floor(values.values.to_numpy(zero_copy_only=False) * SCALE).astype("<f8")
            parts = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            x = padded(as_matrix(parts), pivots.shape[1])
            near = np.argmin(squares - 2 * (x @ pivots.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.int32()), pa.array(parts, pa.binary())], ["row", "id", "asks", "pivot", "v"])

    return rows.select("row", "id", "asks", "v").mapInArrow(assign, VECTOR)


def _indexed(rows: DataFrame, cells: list[tuple[int, int, int]], pivots: np.ndarray, leaf: int = LEAF, mean_child: int = MEAN_CHILD) -> DataFrame:
    """A table of blocks ``(cell, part)``: their trees, and a ball around the cell's first pivot that holds them."""
    head: dict[int, int] = {}
    for pivot, cell, _ in cells:
        head.setdefault(cell, pivot)
    total = sum({cell: parts for _, cell, parts in cells}.values())
    side = rows.sparkSession.createDataFrame(cells, "pivot int, cell int, parts int")
    placed = rows.join(F.broadcast(side), "pivot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        x = as_matrix(table.column("v").to_pylist())
        tree = cover_tree(x, np.asarray(table.column("id")), np.asarray(table.column("row")), leaf, mean_child)
        cell = table.column("cell")[0].as_py()
        centre = pivots[head[cell]]
        width = max(len(centre), x.shape[1])
        far = np.linalg.norm(padded(x, width) - padded(centre[None], width), axis=1).max()
        summary = {"centre": [centre], "radius": [float(far) * (1 + 1e-9)], "norm": [float(np.linalg.norm(x, axis=1).max())]}
        return pa.table({"cell": [cell], "part": [table.column("part")[0].as_py()], **_tree_row(tree), **summary}, schema=kinds)

    spec = f"cell int, part int, {TREE}, {SUMMARY}"
    listed = {"array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    kinds = pa.schema([(f.split(" ")[0], listed[f.split(" ")[1]]) for f in spec.split(", ")])
    placed = placed.select("row", "id", "v", "cell", "part").repartition(max(1, total), "cell", "part")
    return placed.groupBy("cell", "part").applyInArrow(build, spec)


def _visits(groups: DataFrame, cells: list[tuple[int, int, list[float], float, float]], lo: int, hi: int) -> DataFrame:
    """``(group, cell, parts)``: of each group's cells from the best bound on, those numbered ``lo`` to ``hi`` that its worst kth score allows."""
    names, parts = np.array([c[0] for c in cells], dtype=np.int64), np.array([c[1] for c in cells], dtype=np.int64)
    width = max(len(c[2]) for c in cells)
    centres, radii, norms = padded(np.array([c[2] for c in cells]), width), np.array([c[3] for c in cells]), np.array([c[4] for c in cells])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, centre, radius, norm, worst in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                bound = upper_bounds(np.array(centre), radius, norm, centres, radii, norms)
                order = np.argsort(-bound, kind="stable")[lo:hi]
                order = order if worst is None else order[bound[order] >= worst]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(order), pa.int64()), pa.array(names[order], pa.int32()), pa.array(parts[order], pa.int32())], ["group", "cell", "parts"])

    return groups.select("group", "centre", "radius", "norm", "worst").mapInArrow(route, "group long, cell int, parts int")


FOUND = "group long, query long, query_id long, row long, vec_id long, score long"


def _searched(groups: DataFrame, blocks: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """What the visits find that beats each query's kth score so far."""
    wanted = visits.select("group", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    load = wanted.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / GROUPS_AT_ONCE).cast("int").alias("shares"))
    load = written(load, "load")
    tasks = load.agg(F.sum("shares")).first()[0] or 1
    share = F.pmod(F.xxhash64("group"), F.col("shares")).cast("int").alias("share")
    sent = wanted.join(load, ["cell", "part"]).select("group", "cell", "part", share)
    sent = sent.join(groups.select("group", "kth", *TREE_COLUMNS), "group")
    held = blocks.join(load, ["cell", "part"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    held = held.select(F.lit(-1).cast("long").alias("group"), "cell", "part", "share", F.lit(None).cast(groups.schema["kth"].dataType).alias("kth"), *TREE_COLUMNS)
    key = ["cell", "part", "share"]
    both = held.unionByName(sent).repartition(max(1, tasks), *key).sortWithinPartitions(*key, "group")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i, group in enumerate(batch.column(0).to_pylist()):
                tree = _tree_at(batch, i)
                if group < 0:
                    block = tree
                    continue
                search = Search(tree, k)
                at = {row: n for n, row in enumerate(tree.rows.tolist())}
                for known in batch.column(4)[i].as_py() or []:
                    search.least[at[known["query"]]], search.least_id[at[known["query"]]] = known["score"], known["id"]
                search.visit(block)
                rows = [(group, int(tree.rows[n]), int(tree.ids[n]), row, name, -score) for n, mine in enumerate(search.found) for score, name, row in mine]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["group", "query", "query_id", "row", "vec_id", "score"])

    return both.mapInArrow(walk, FOUND)


def top_inner_products(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` best rows. See the module docstring."""
    spark = df.sparkSession
    v = F.col(quoted(vector_col)).cast(T.ArrayType(T.DoubleType()))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < F.lit(float("inf"))))
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    sample = rows.select("v", F.xxhash64("id").alias("at"), "id").orderBy("at", "id").limit(SAMPLE_ROWS)
    room = Window.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    sample = sample.withColumn("bytes", F.sum(8 * F.size("v")).over(room)).where(f"bytes <= {SAMPLE_BYTES}").select("v").collect()
    pivots = pivots_of(np.floor(as_matrix([np.array(r["v"], dtype="<f8").tobytes() for r in sample]) * SCALE))
    if not len(pivots):
        pivots = np.zeros((1, 1))
    with scratch(spark):
        vectors = written(_assigned(rows.withColumn("row", F.monotonically_increasing_id()), pivots), "vectors")
        counts = vectors.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).collect()
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
        best = spark.createDataFrame([], FOUND + ", rank int")
        if any(c["q"] for c in counts):
            blocks = written(_indexed(vectors, dealt_cells({c["pivot"]: c["n"] for c in counts}, DATA_BLOCK), pivots), "blocks")
            groups = _indexed(vectors.where("asks"), dealt_cells({c["pivot"]: c["q"] for c in counts if c["q"]}, QUERY_GROUP), pivots, QUERY_LEAF, QUERY_MEAN_CHILD)
            groups = written(groups.withColumn("group", F.col("cell").cast("long") * (1 << 31) + F.col("part")).drop("cell", "part"), "groups")
            balls = blocks.groupBy("cell").agg((F.max("part") + 1).alias("parts"), F.first("centre").alias("centre"), F.max("radius").alias("radius"), F.max("norm").alias("norm"))
            cells = [tuple(r) for r in balls.orderBy("cell").collect()]  # at most PIVOTS
            lo, hi = 0, 1
            while lo < len(cells):
                # A kth score counts only where a query has k answers; a group is cut by the worst of them once all have.
                kth = best.where(F.col("rank") == k).groupBy("group").agg(F.collect_list(F.struct("query", "score", F.col("vec_id").alias("id"))).alias("kth"), F.min("score").alias("least"))
                worst = F.when(F.size("kth") == F.size("rows"), F.col("least").cast("double"))
                state = groups.join(kth, "group", "left").withColumn("worst", worst)
                visits = written(_visits(state, cells, lo, hi), "visits")
                new = written(_searched(state, blocks, visits, k), "found")
                ranked = new.unionByName(best.drop("rank")).withColumn("rank", F.row_number().over(order))
                best = written(ranked.where(F.col("rank") <= k), "best")
                lo, hi = hi, hi + GROWTH * (hi - lo)
        best = written(best.select("query_id", "rank", "vec_id", "score"), "answers", read_later=True)
    return best
