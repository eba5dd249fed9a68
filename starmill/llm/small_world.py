"""Near duplicates of embeddings by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class, named by the smallest id, before anything is compared. Classes
are dealt by a hash into shards of so many rows and bytes at most; each shard is indexed whole by
one graph:

* A class within half the link angle of a node that the graph already has joins that node's
  ball; all others become nodes. Two classes of one ball are linked for certain (the angles
  add up), so a large group of near copies costs a node and no pairs.
* Nodes are levelled geometrically and inserted top level first, in batches that at most
  double the graph; each is joined to neighbours picked for spread, and links are made both
  ways and pruned by the same rule.

The graphs are one table with a row per class: its vector, its ball and, if it is a node, its
neighbours. So no row is large, a graph reaches a task in batches, and a task holds one shard:
its vectors once as they are and once in single precision, and the neighbours.

Every class queries every shard: tasks are (shard, block of shards). A task reads its shard's
rows of the table and then streams the block's vectors from the same table; nothing is shuffled
or copied for that, and jobs are of ``JOB`` tasks or three per core. A beam search over the graph finds the nodes that may have links. A query whose beam is full
of such nodes is searched again with a beam twice as wide. Then a ball counts whole where its
angles leave no doubt, and member by member otherwise, by cosines in double precision. Links
are counted, not listed; a task keeps only a spanning forest of its links, and components
are the union of all forests.

An audit draws ``AUDIT`` classes by a hash, compares them with all classes by brute force and
counts the links that were found. While fewer than ``RECALL`` are found, all beams are
widened to twice their width and queried again, at most until a beam is as wide as a shard.

Defined results. A vector that is null, empty, zero or holds null or non-finite entries, and a
row without an id, has no links, its own id as component and ``kept`` true; a null id keeps a
null component. Vectors of different widths are never linked. Rows that repeat an id are
vectors of their own: each counts as a link, and they share a component only if linked; ``kept``
compares with the row's own id. Equal vectors are always linked. No rows: no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.functions.shared import shared_dir
from starmill.llm.components import components
from starmill.llm.stored import stored

LEAST = 0.95
#: Rows of a shard and bytes of its vectors at most (in the mean), shards at least, queries that make a block, tasks of a job.
SHARD, BYTES, SHARDS, BLOCK, JOB = 160_000, 40 << 20, 4, 16_384, 16
#: Neighbours of a node above level 0 (twice as many on it), beam when building and when asking.
NEAR, BUILD, ASK = 12, 32, 16
AUDIT, RECALL = 2048, 0.97
#: Queries searched side by side, and radians by which a certain answer must be clear of rounding.
SIDE, MARGIN = 512, 1e-6
#: Rows of a batch that a task hands on, entries of beams and numbers of vectors worked on at once.
BATCH, BEAMS, CELLS = 8192, 1 << 19, 1 << 19


class Graph:
    """Nodes sorted by falling level, so each level holds a prefix of them."""

    def __init__(self, points: np.ndarray, counts: list[int], near: list[np.ndarray]):
        self.points, self.counts, self.near = points, counts, near

    def beam(self, level: int, asked: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines), best first, that a beam search from ``start`` finds; -1 where there are fewer."""
        near, n = self.near[level], len(asked)
        nodes = np.full((n, width), -1, np.int32)
        cosines = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        nodes[:, 0] = start
        cosines[:, 0] = np.einsum("qd,qd->q", self.points[start], asked)
        open_[:, 0] = True
        left = np.arange(n)
        while len(left):
            at = np.where(open_[left], cosines[left], -np.inf).argmax(1)
            going = open_[left, at]
            left, at = left[going], at[going]
            if not len(left):
                break
            open_[left, at] = False
            there = near[nodes[left, at]]
            found = np.einsum("qmd,qd->qm", self.points[there], asked[left])
            found[there < 0] = -np.inf
            own = nodes[left]
            row, at = np.nonzero(found > cosines[left, -1:])
            known = (own[row] == there[row, at][:, None]).any(1)
            fits = np.zeros(found.shape, bool)
            fits[row[~known], at[~known]] = True
            found[~fits] = -np.inf
            better = np.flatnonzero(fits.any(1))
            if not len(better):
                continue
            rows = left[better]
            both = np.concatenate((cosines[rows], found[better]), 1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :width]
            cosines[rows] = np.take_along_axis(both, best, 1)
            fresh = np.concatenate((own[better], there[better]), 1)
            nodes[rows] = np.where(cosines[rows] > -np.inf, np.take_along_axis(fresh, best, 1), -1)
            unseen = np.concatenate((open_[rows], found[better] > -np.inf), 1)
            open_[rows] = np.take_along_axis(unseen, best, 1) & (cosines[rows] > -np.inf)
        return nodes, cosines

    def search(self, asked: np.ndarray, width: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """As ``beam``, from the top; side by side only as many as bound the neighbours' vectors and the beams."""
        side = min(SIDE, BEAMS // width, 4 * CELLS // (4 * NEAR * self.points.shape[1]))
        parts = [self._search(asked[a:b], width, level) for a, b in _slices(len(asked), side)]
        return (np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])) if parts else self._search(asked, width, level)

    def _search(self, asked: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros(len(asked), np.int32)
        for above in range(len(self.near) - 1, level, -1):
            start = self.beam(above, asked, start, 1)[0][:, 0]
        return self.beam(level, asked, start, width)


def _spread(points: np.ndarray, own: np.ndarray, nodes: np.ndarray, cosines: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (best first), none nearer to a picked one than to the row's own."""
    picked = np.full((len(own), most), -1, np.int32)
    for a, b in _slices(len(own), CELLS // (nodes.shape[1] * max(nodes.shape[1], points.shape[1]))):
        some, to_own = nodes[a:b], cosines[a:b]
        held = points[some]
        between = held @ held.transpose(0, 2, 1)
        fits = (some >= 0) & (some != own[a:b, None])
        taken, count = np.zeros(some.shape, bool), np.zeros(b - a, np.int64)
        for j in range(some.shape[1]):
            taken[:, j] = fits[:, j] & (count < most) & ~(taken[:, :j] & (between[:, :j, j] > to_own[:, j:j + 1])).any(1)
            count += taken[:, j]
        rank = np.where(taken, 0, np.where(fits, 1, 2))  # room that is left goes to the nearest others
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        picked[a:b, : first.shape[1]] = np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(some, first, 1), -1)
    return picked


def _linked_back(graph: Graph, level: int, new: np.ndarray) -> None:
    """Give the neighbours of new nodes a link back; lists that overflow are pruned to half their room."""
    near = graph.near[level]
    room = near.shape[1]
    source, target = np.repeat(new, room), near[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    held, first, size = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, size)
    side = min(SIDE, 4 * CELLS // (graph.points.shape[1] * (room + int(size.max(initial=0)))))
    for a, b in _slices(len(held), side):
        some, most = held[a:b], int(size[a:b].max())
        lists = np.full((len(some), room + most), -1, np.int32)
        lists[:, :room] = near[some]
        mine = slice(*np.searchsorted(target, [some[0], some[-1] + 1]))
        lists[np.searchsorted(some, target[mine]), room + place[mine]] = source[mine]
        lists[:, room:][(lists[:, room:, None] == lists[:, None, :room]).any(2)] = -1
        order = np.argsort(lists < 0, axis=1, kind="stable")
        lists = np.take_along_axis(lists, order, 1)
        over = lists[:, room] >= 0
        near[some] = lists[:, :room]
        if over.any():
            own, lists = some[over], lists[over]
            cosines = np.einsum("qmd,qd->qm", graph.points[lists], graph.points[own])
            cosines[lists < 0] = -np.inf
            best = np.argsort(-cosines, axis=1, kind="stable")
            near[own] = -1
            near[own, : room // 2] = _spread(
                graph.points, own, np.take_along_axis(lists, best, 1), np.take_along_axis(cosines, best, 1), room // 2)


def _joined_up(graph: Graph) -> None:
    """Give nodes that no path on level 0 reaches a link from the nearest that one does."""
    near = graph.near[0]
    for _ in range(20):
        reached = np.zeros(len(near), bool)
        edge = np.zeros(1, np.int64)
        while len(edge):
            reached[edge] = True
            there = np.zeros(len(near) + 1, bool)  # the last stands for no neighbour
            for a, b in _slices(len(edge), BATCH):
                there[near[edge[a:b]]] = True
            edge = np.flatnonzero(there[:-1] & ~reached)
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        for a in range(0, len(lost), SIDE):
            some = lost[a: a + SIDE]
            for node, host in zip(some.tolist(), graph.search(graph.points[some], BUILD)[0][:, 0].tolist(), strict=True):
                free = np.flatnonzero(near[host] < 0)
                near[host, free[0] if len(free) else near.shape[1] - 1] = node


def build(vectors: np.ndarray, least: float = LEAST) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph, node of each row, row of each node) of rows, of which there is at least one."""
    n = len(vectors)
    half = math.cos(math.acos(least) / 2 - MARGIN)
    draw = np.random.default_rng(n).random(n)
    level = np.minimum((-np.log(1 - draw) / math.log(NEAR)).astype(int), 12)
    order = np.argsort(-level, kind="stable")
    ball, heads = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    top = int(level.max())
    lists = [np.full((int((level >= k).sum()), NEAR * (4 if k == 0 else 2)), -1, np.int32) for k in range(top + 1)]
    graph = Graph(np.zeros(vectors.shape, np.float32), [0] * (top + 1), lists)
    made, done = 0, 0
    while done < n:
        batch = order[done: done + max(1, min(done, SIDE))]
        done += len(batch)
        fresh, light = batch, unit(vectors[batch]).astype(np.float32)
        if made:
            nodes, cosines = graph.search(light, BUILD)
            joins = cosines[:, 0] >= half
            ball[batch[joins]] = nodes[joins, 0]
            fresh, light = batch[~joins], light[~joins]
        # what joins no ball of the graph may join one that the batch itself begins
        cross = light @ light.T
        begun: list[int] = []
        for k in range(len(fresh)):
            if begun and cross[k, begun].max() >= half:
                ball[fresh[k]] = made + int(cross[k, begun].argmax())
            else:
                ball[fresh[k]] = made + len(begun)
                begun.append(k)
        if not begun:
            continue
        head = np.array(begun)
        new, inside = fresh[head], cross[np.ix_(head, head)]
        np.fill_diagonal(inside, -np.inf)
        own = np.arange(made, made + len(head), dtype=np.int32)
        graph.points[own], heads[own] = light[head], new
        made += len(head)
        for k in range(top, -1, -1):
            here = np.flatnonzero(level[new] >= k)
            if not len(here):
                continue
            # the batch's own best join the candidates, since they are not in the graph yet
            close = inside[np.ix_(here, here)]
            few = np.argsort(-close, axis=1, kind="stable")[:, :NEAR]
            cosines = np.take_along_axis(close, few, 1)
            nodes = np.where(cosines > -np.inf, own[here][few], -1)
            if graph.counts[k]:
                old = graph.search(graph.points[own[here]], BUILD, k)
                nodes, cosines = np.concatenate((old[0], nodes), 1), np.concatenate((old[1], cosines), 1)
            best = np.argsort(-cosines, axis=1, kind="stable")
            nodes, cosines = np.take_along_axis(nodes, best, 1), np.take_along_axis(cosines, best, 1)
            half_room = graph.near[k].shape[1] // 2
            graph.near[k][own[here], :half_room] = _spread(graph.points, own[here], nodes, cosines, half_room)
            _linked_back(graph, k, own[here])
            graph.counts[k] = int(own[here][-1]) + 1
    graph.points = graph.points[:made]
    graph.near = [x[:c] for x, c in zip(graph.near, graph.counts, strict=True)]
    while len(graph.near) > 1 and not len(graph.near[-1]):
        graph.near.pop(), graph.counts.pop()
    _joined_up(graph)
    return graph, ball, heads[:made]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; very large and very small entries are scaled first."""
    made = vectors.astype(float)
    made /= np.abs(made).max(1, keepdims=True)
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    return made


class Shard:
    """A shard's graph with the balls of its nodes, each sorted by angle from the node; the first rows are the nodes."""

    def __init__(self, near: list[np.ndarray], raw: np.ndarray, ids: np.ndarray, sizes: np.ndarray, ball: np.ndarray,
                 least: float = LEAST):
        self.raw, self.ids, self.sizes, self.ball = raw, ids, sizes, ball
        self.nodes, self.least, self.reach = len(near[0]), least, math.acos(least)
        light = np.empty((self.nodes, raw.shape[1]), np.float32)
        for a, b in _slices(self.nodes, CELLS // raw.shape[1]):
            light[a:b] = unit(raw[a:b])
        self.graph = Graph(light, [len(x) for x in near], near)
        angle = np.zeros(len(raw))
        for a, b in _slices(len(raw), CELLS // raw.shape[1], self.nodes):
            angle[a:b] = np.arccos(np.clip(np.einsum("qd,qd->q", unit(raw[a:b]), unit(raw[ball[a:b]])), -1, 1))
        self.order = np.lexsort((angle, ball))
        self.key = 10.0 * ball[self.order] + angle[self.order]
        self.end = np.searchsorted(ball[self.order], np.arange(self.nodes), "right")
        self.summed = np.concatenate(([0], np.cumsum(sizes[self.order])))
        self.widest = angle[self.order][self.end - 1]
        self.by_id = np.argsort(ids)

    def near_nodes(self, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of nodes near enough to have links, by beams that widen while full of them."""
        bound = math.cos(min(self.reach + float(self.widest.max()) + MARGIN, math.pi)) - 1e-5
        found, left, width = [], np.arange(len(asked)), min(width, self.nodes)
        while len(left):
            again = []
            for a, b in _slices(len(left), BEAMS // width):
                some = left[a:b]
                nodes, cosines = self.graph.search(asked[some], width)
                wider = (nodes[:, -1] >= 0) & (cosines[:, -1] >= bound) & (width < self.nodes)
                row, at = np.nonzero((cosines >= bound) & ~wider[:, None])
                found.append((some[row], nodes[row, at].astype(np.int64)))
                again.append(some[wider])
            left, width = np.concatenate(again), min(2 * width, self.nodes)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2

    def links(self, ids: np.ndarray, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(links of each query beside itself, queries and nodes of a (query, node) list where one holds)."""
        row, node = self.near_nodes(asked.astype(np.float32), width)
        place = self.by_id[np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), len(self.ids) - 1)]
        inside = self.ids[place] == ids
        own, own_size = np.where(inside, self.ball[place], -1), np.where(inside, self.sizes[place], 0)
        here = np.flatnonzero(inside)
        pair = np.unique(np.concatenate((row * self.nodes + node, here * self.nodes + own[here])))
        row, node = pair // self.nodes, pair % self.nodes
        away = np.arccos(np.clip(self._cosines(asked, row, node), -1, 1))
        begin = np.concatenate(([0], self.end[:-1]))[node]
        # up to ``sure`` all are linked, from ``far`` on none before ``sure`` was: between them they are compared
        sure = np.maximum(np.searchsorted(self.key, 10.0 * node + np.maximum(self.reach - away - MARGIN, -1), "right"), begin)
        first = np.maximum(np.searchsorted(self.key, 10.0 * node + np.maximum(away - self.reach - MARGIN, 0), "left"), sure)
        count = self.summed[sure] - self.summed[begin]
        open_ = np.maximum(self.end[node] - first, 0)
        for a, b in _pieces(open_, 100_000):
            which = np.repeat(np.arange(a, b), open_[a:b])
            at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(open_[a:b]) - open_[a:b], open_[a:b])
            member = self.order[at]
            fits = self._cosines(asked, row[which], member) >= self.least
            np.add.at(count, which[fits], self.sizes[member[fits]])
        mine = node == own[row]
        some = count > np.where(mine, own_size[row], 0)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, row, count)
        return total - own_size, row[some], node[some]

    def _cosines(self, asked: np.ndarray, row: np.ndarray, member: np.ndarray) -> np.ndarray:
        made = np.empty(len(row))
        for a, b in _slices(len(row), CELLS // self.raw.shape[1]):
            made[a:b] = np.einsum("qd,qd->q", asked[row[a:b]], unit(self.raw[member[a:b]]))
        return made


def _slices(n: int, most: int, start: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges from ``start`` to n of ``most`` entries, one at least."""
    for a in range(start, n, max(1, most)):
        yield a, min(a + max(1, most), n)


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add up to about ``most``."""
    a, ends = 0, np.cumsum(sizes)
    while a < len(sizes):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")), a + 1)
        yield a, b
        a = b


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of edges that alone connect what all of them connect."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One list of so many values per row."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


LINKS = "c bigint, other bigint, links bigint"
#: ``place``: nodes as the graph numbers them, then all others; ``near``: a node's neighbours, level by level.
INDEX = "width int, place int, rows int, nodes int, c bigint, size bigint, vector array<{}>, ball int, near array<int>, shard int"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's rows with its graph."""
    vectors, ids, sizes = [], [], []
    for batch in batches:
        width, shard = batch.column("width")[0].as_py(), batch.column("shard")[0].as_py()
        vectors.append(_rows(batch.column("vector"), width))
        ids.append(batch.column("c").to_numpy())
        sizes.append(batch.column("size").to_numpy())
    raw, ids, sizes = (np.concatenate(x) for x in (vectors, ids, sizes))
    vectors.clear()
    graph, ball, heads = build(raw)
    n, nodes = len(raw), len(heads)
    others = np.ones(n, bool)
    others[heads] = False
    order = np.concatenate((heads, np.flatnonzero(others)))
    del graph.points
    for a, b in _slices(n, BATCH):
        some, m = order[a:b], max(0, min(b, nodes) - a)
        held = [max(0, min(m, c - a)) for c in graph.counts]  # nodes of the slice that each level has
        rooms = [x.shape[1] for x in graph.near]
        length = np.zeros(b - a, np.int64)
        for h, room in zip(held, rooms, strict=True):
            length[:h] += room
        flat, at = np.empty(int(length.sum()), np.int32), np.cumsum(length) - length
        for h, room, near in zip(held, rooms, graph.near, strict=True):
            flat[at[:h, None] + np.arange(room)] = near[a: a + h]
            at[:h] += room
        every = np.ones(b - a, np.int32)
        yield pa.RecordBatch.from_pydict({
            "width": every * raw.shape[1], "place": np.arange(a, b, dtype=np.int32), "rows": every * n, "nodes": every * nodes,
            "c": ids[some], "size": sizes[some], "vector": _lists(raw[some].ravel(), np.full(b - a, raw.shape[1])),
            "ball": ball[some].astype(np.int32), "near": _lists(flat, length), "shard": every * shard})


class _Loading:
    """A shard on its way in, row by row in the order of ``place``."""

    def __init__(self, first: pa.RecordBatch):
        n, nodes, self.width = (first.column(x)[0].as_py() for x in ("rows", "nodes", "width"))
        self.raw = np.empty((n, self.width), first.column("vector").type.value_type.to_pandas_dtype())
        self.ids, self.sizes, self.ball = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        self.near, self.nodes, self.upper, self.done = np.empty((nodes, 4 * NEAR), np.int32), nodes, [], 0

    def add(self, rows: pa.RecordBatch) -> None:
        to = slice(self.done, self.done + rows.num_rows)
        assert rows.column("place")[0].as_py() == self.done and to.stop <= len(self.raw)
        self.raw[to] = _rows(rows.column("vector"), self.width)
        for into, name in ((self.ids, "c"), (self.sizes, "size"), (self.ball, "ball")):
            into[to] = rows.column(name).to_numpy()
        near = rows.column("near")
        length, values = near.value_lengths().to_numpy(), near.flatten().to_numpy(zero_copy_only=False)
        at, m = np.cumsum(length) - length, max(0, min(to.stop, self.nodes) - to.start)
        self.near[to.start: to.start + m] = values[at[:m, None] + np.arange(4 * NEAR)]
        for k in range(int(length.max() - 4 * NEAR) // (2 * NEAR)):
            here = np.flatnonzero(length >= 4 * NEAR + 2 * NEAR * (k + 1))
            if k == len(self.upper):
                self.upper.append([])
            self.upper[k].append(values[at[here, None] + 4 * NEAR + 2 * NEAR * k + np.arange(2 * NEAR)])
        self.done = to.stop

    def shard(self) -> Shard:
        assert self.done == len(self.raw)
        return Shard([self.near, *(np.concatenate(x) for x in self.upper)], self.raw, self.ids, self.sizes, self.ball)


def _asker(beam: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each query (``other`` -1), then a forest of its shard's edges."""
        loading = shard = asked = None
        for batch in batches:
            place = batch.column("place").fill_null(-1).to_numpy()
            kind = np.stack((batch.column("shard").to_numpy(), batch.column("width").to_numpy(), place < 0), 1)
            cuts = [0, *(np.flatnonzero((kind[1:] != kind[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                rows, of = batch.slice(a, b - a), tuple(kind[a, :2])
                if place[a] >= 0:
                    if of != asked:
                        loading = shard = None  # before the next one takes room
                        loading, asked = _Loading(rows), of
                    loading.add(rows)
                    continue
                if of != asked:
                    continue  # the shard has no vector of this width
                shard = shard or loading.shard()
                yield _answers(shard, rows.column("c").to_numpy(), _rows(rows.column("vector"), shard.raw.shape[1]), beam)

    return ask


def _answers(shard: Shard, ids: np.ndarray, raw: np.ndarray, beam: int) -> pa.RecordBatch:
    made = {"c": [], "other": [], "links": []}
    for a, b in _slices(len(ids), SIDE):
        part = ids[a:b]
        total, row, node = shard.links(part, unit(raw[a:b]), beam)
        some = np.flatnonzero(total)
        one, two = part[row], shard.ids[node]
        kept = forest(one, two)
        made["c"] += [part[some], one[kept]]
        made["other"] += [np.full(len(some), -1), two[kept]]
        made["links"] += [total[some], np.zeros(len(kept), np.int64)]
    return pa.RecordBatch.from_pydict({k: np.concatenate(v).astype(np.int64) for k, v in made.items()})


def _task(index: DataFrame, shard: int, block: list[int]) -> DataFrame:
    """One partition: by width, the rows of a shard in their order, then those of a block of shards, without place."""
    return index.where(F.col("shard") == shard).unionByName(
        index.where(F.col("shard").isin(block)).select("width", "c", "vector"), allowMissingColumns=True).withColumn(
        "shard", F.lit(shard)).coalesce(1).sortWithinPartitions("width", F.asc_nulls_last("place"))


def _tasks(index: DataFrame, some: list[tuple[int, list[int]]]) -> DataFrame:
    """A partition for each (shard, block).

    Spark puts single partitions together if all children of a union have one (spark.sql.unionOutputPartitioning);
    a scan without rows, whose partitioning is not known, keeps them apart.
    """
    return reduce(DataFrame.unionByName, [_task(index, *x) for x in some], index.where("shard < 0"))


def _asked(index: DataFrame, shards: int, blocks: int, beam: int) -> DataFrame:
    """c, other, links of all classes and shards; block b holds the shards that leave b when divided by ``blocks``."""
    spark, path = index.sparkSession, shared_dir(index.sparkSession, "small-world-links")
    every = [(s, list(range(b, shards, blocks))) for s in range(shards) for b in range(blocks)]
    for a, b in _slices(len(every), max(JOB, 3 * spark.sparkContext.defaultParallelism)):
        _tasks(index, every[a:b]).mapInArrow(_asker(beam), LINKS).write.mode("append").parquet(path)
    return spark.read.schema(LINKS).parquet(path)


def _audited(classes: DataFrame, found: DataFrame) -> tuple[int, int]:
    """(links found, links there) of ``AUDIT`` classes drawn by a hash, against brute force."""
    drawn = classes.orderBy(F.xxhash64("c"), "c").limit(AUDIT).select("c", "width", "vector")
    sample = drawn.toArrow().combine_chunks()
    ids, widths = sample.column("c").to_numpy(), sample.column("width").to_numpy()
    points = {int(w): unit(_rows(sample.filter(pa.array(widths == w)).column("vector").combine_chunks(), int(w))) for w in np.unique(widths)}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for w in np.unique(batch.column("width").to_numpy()).tolist():
                if w not in points:
                    continue
                part = batch.filter(pa.array(batch.column("width").to_numpy() == w))
                other, size, own = _rows(part.column("vector"), w), part.column("size").to_numpy(), part.column("c").to_numpy()
                for a, b in _slices(len(own), SIDE):
                    near = unit(other[a:b]) @ points[w].T >= LEAST
                    near &= own[a:b, None] != ids[widths == w][None]
                    total += int((near * size[a:b, None]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    there = classes.select("c", "width", "vector", "size").mapInArrow(compare, "n bigint").agg(F.sum("n")).first()[0] or 0
    names = classes.sparkSession.createDataFrame([(int(c),) for c in ids], "c bigint")
    seen = found.where("other = -1").join(F.broadcast(names), "c").agg(F.sum("links")).first()[0] or 0
    return seen, there


def near_duplicates(table: DataFrame, vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``table``."""
    double = dict(table.dtypes)[vector_column] != "array<float>"
    kind = "double" if double else "float"
    vector = F.transform(vector_column, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    sound = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(vector_column, lambda x: x != 0)
    rows = table.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.when(F.col("vec_id").isNotNull() & F.col(vector_column).isNotNull() & sound & some, vector).alias("vector")).withColumn(
        "h1", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn(
        "h2", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector")))
    classes = stored(rows.where("vector is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("vector").alias("vector")).select(
        "*", F.size("vector").alias("width"), F.monotonically_increasing_id().alias("c")), "small-world-classes")
    n, cells = (x or 0 for x in classes.agg(F.count("*"), F.sum("width")).first())
    shards = max(SHARDS, -(-n // SHARD), -(-cells * (8 if double else 4) // BYTES))
    blocks = max(1, min(shards, -(-n // BLOCK)))
    path = shared_dir(table.sparkSession, "small-world-index")
    classes.select("c", "size", "vector", "width", F.expr(f"cast(pmod(xxhash64(c), {shards}) as int)").alias("shard")).groupBy(
        "width", "shard").applyInArrow(_indexed, INDEX.format(kind)).write.partitionBy("shard").parquet(path)
    index = table.sparkSession.read.schema(INDEX.format(kind)).parquet(path)
    beam = ASK
    while True:
        found = _asked(index, shards, blocks, beam)
        seen, there = _audited(classes, found)
        if seen >= RECALL * there or beam >= max(SHARD, n):
            break
        beam *= 2
    joined = components(found.where("other <> -1").select(F.col("c").alias("a"), F.col("other").alias("b")))
    named = classes.select("c", "h1", "h2", "node", "size").join(
        joined.select(F.col("node").alias("c"), "component"), "c", "left").join(
        found.where("other = -1").groupBy("c").agg(F.sum("links").alias("links")), "c", "left").withColumn(
        "component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("node").alias("component_id"))
    of_class = named.join(least, "component").select(
        "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    made = rows.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return made.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
