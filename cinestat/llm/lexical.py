"""Exact ranked lexical search by inner products over sparse ball trees.

A document's vector holds, for each term, ``(10^9 tf) div (1000 tf + 20 m)`` with its length
factor ``m = 50 + (50 n N) div L``; an item's vector holds its terms' weights
``floor(1000 ln((2N + 2) / (2 df + 1)))``.  The score is their inner product in 64-bit integers.

Documents are read once: their number of terms and the counts of those terms that some item
holds.  Each task then builds ball trees over blocks of its documents and searches them for
every item.  A ball is a centroid and a radius; no document inside scores above
``q . centroid + |q| radius``.  Documents are sparse and an item touches few terms, so the
radius is also kept term by term (how far a document inside goes beyond the centroid there),
which gives the bound ``q . (centroid + radii)``; the smaller one counts.  Both sides are scaled
by the square roots of the weights, which leaves inner products as they are and keeps frequent
terms from blowing up radii.  Balls are opened in the order of their bounds until the next
bound lies below the k-th score found so far in the task; leaves are scored in integers.
Bounds are worked out in double precision and rounded up (see ``_UP``), so rounding never
hides a document.

Terms are maximal runs of digits, letters and everything outside ASCII, A-Z lower-cased; a null
text has none.  Rows that share an item number are one item with the terms of all; items
without a term get no rows.  Repeated documents count and appear as often as they occur; equal
scores go by ``doc_id``, nulls last.
"""

from __future__ import annotations

import heapq
import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cinestat.session import kept

_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+").findall  # after lower(), which on bytes is A-Z only
#: A dot product of d non-negative doubles is off by d * 2^-53 of itself at most; d stays under 10^6.
_UP = 1 + 1e-9
_BLOCK_ROWS, _BLOCK_ENTRIES, _LEAF = 16_384, 2_000_000, 48
_PASS_TERMS = 200_000  # (item, term) rows that reach the driver and a broadcast at once
_ITEMS, _VOCABULARY = 256, 4_096  # of one tree; an item with more terms is alone in its tree


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``term`` (bytes), without repetition."""
    def run(batches):
        for batch in batches:
            found = [list(dict.fromkeys(_TERMS((t or b"").lower()))) for t in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(at, pa.int64())), pa.array([t for x in found for t in x], pa.binary())], names=["item_id", "term"])

    plain = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(run, "item_id long, term binary").distinct()


def counted(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (terms of the whole text), ``ids`` and ``tfs`` of its terms in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = shared.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, ids, tfs = [], [], []
                for value in part.column("text").to_pylist():
                    terms = _TERMS((value or b"").lower())
                    known, times = np.unique(np.array([k for k in map(number, terms) if k is not None], np.int32), return_counts=True)
                    n.append(len(terms)); ids.append(known); tfs.append(times)
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tfs).astype(np.int64)))], names=["doc_id", "n", "ids", "tfs"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


class Rows:
    """Sparse rows: entries ``col``, ``val`` of row ``row`` (ascending), every row with an entry."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int):
        self.row, self.col, self.val, self.n = row, col, val, n
        self.start = np.searchsorted(row, np.arange(n))

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.col] * self.val, self.start)

    def part(self, which: np.ndarray) -> "Rows":
        """The rows of a mask."""
        entry = which[self.row]
        return Rows((np.cumsum(which) - 1)[self.row[entry]], self.col[entry], self.val[entry], int(which.sum()))


class BallTree:
    """Nodes in the order they were split: ``centroid``, ``radius``, ``highest`` (centroid + radius by term),
    ``children``; leaves name their rows."""

    def __init__(self, rows: Rows, width: int, leaf: int):
        self.centroid, self.radius, self.highest, self.children, self.leaves = [], [], [], [], []
        open_ = [(rows, np.arange(rows.n), None)]
        while open_:
            rows, names, parent = open_.pop()
            k = len(self.radius)
            if parent is not None:
                self.children[parent].append(k)
            centre = np.bincount(rows.col, rows.val, width) / rows.n
            square = np.add.reduceat(rows.val**2, rows.start)
            far = self._squares(rows, square, centre)
            self.centroid.append(centre)
            # The squares come from a difference: rounding is bounded by what was subtracted.
            self.radius.append(math.sqrt(max(0.0, float(far.max())) + 1e-9 * float(square.max() + centre @ centre)))
            self.highest.append(np.zeros(width))
            if rows.n <= leaf:
                np.maximum.at(self.highest[k], rows.col, rows.val)
            self.children.append([])
            self.leaves.append(names if rows.n <= leaf else None)
            if rows.n > leaf:
                a = self._dense(rows, int(far.argmax()), width)
                b = self._dense(rows, int(self._squares(rows, square, a).argmax()), width)
                right = np.zeros(rows.n, bool)
                right[np.argsort(rows.dot(b - a), kind="stable")[rows.n // 2 :]] = True
                open_ += [(rows.part(~right), names[~right], k), (rows.part(right), names[right], k)]
        for k in reversed(range(len(self.radius))):  # children come after their parents
            for child in self.children[k]:
                np.maximum(self.highest[k], self.highest[child], out=self.highest[k])
        self.centroid, self.radius, self.highest = np.array(self.centroid), np.array(self.radius), np.array(self.highest)

    @staticmethod
    def _squares(rows: Rows, square: np.ndarray, point: np.ndarray) -> np.ndarray:
        return square - 2 * rows.dot(point) + point @ point

    @staticmethod
    def _dense(rows: Rows, k: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        mine = slice(rows.start[k], rows.start[k + 1] if k + 1 < rows.n else len(rows.row))
        out[rows.col[mine]] = rows.val[mine]
        return out


class Search:
    """The best documents of every item so far, block by block."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, k: int):
        self.items, self.weights, self.k = items, weights, k
        self.best = [(np.empty(0, np.int64), np.empty(0, object)) for _ in items]
        self.opened = self.leaves = 0
        self.trees, used, held = [], set(), []  # items that share a tree
        for i, (_, terms) in enumerate(items):
            if held and (len(held) >= _ITEMS or len(used | set(terms.tolist())) > _VOCABULARY):
                self.trees.append((held, np.array(sorted(used))))
                used, held = set(), []
            used |= set(terms.tolist())
            held.append(i)
        if held:
            self.trees.append((held, np.array(sorted(used))))

    def _keep(self, i: int, scores: np.ndarray, names: np.ndarray) -> None:
        scores, names = np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], names])
        order = sorted(range(len(scores)), key=lambda j: (-scores[j], names[j] is None, names[j]))[: self.k]
        self.best[i] = scores[order], names[order]

    def block(self, names: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Searches further documents: entries ``term``, ``value`` of ``names[row]``, by row."""
        for held, vocabulary in self.trees:
            at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            mine = vocabulary[at] == term
            some, back = np.unique(row[mine], return_inverse=True)
            if not len(some):
                continue
            weight = self.weights[vocabulary]
            scale = np.sqrt(weight.astype(float))
            whole = Rows(back, at[mine], value[mine], len(some))
            tree = BallTree(Rows(back, whole.col, whole.val * scale[whole.col], whole.n), len(vocabulary), _LEAF)
            asked = [np.searchsorted(vocabulary, self.items[i][1]) for i in held]
            points = np.zeros((len(vocabulary), len(held)))
            for j, terms in enumerate(asked):
                points[terms, j] = scale[terms]
            ball = tree.centroid @ points + tree.radius[:, None] * np.sqrt((points**2).sum(0))
            bounds = np.minimum(ball, tree.highest @ points) * _UP
            leaves = {}
            for node, rows in enumerate(tree.leaves):
                if rows is not None:
                    which = np.zeros(whole.n, bool)
                    which[rows] = True
                    leaves[node] = rows, None
            order = np.concatenate([rows for rows, _ in leaves.values()])
            place = np.empty(whole.n, np.int64)
            place[order] = np.arange(whole.n)
            by = np.argsort(place[whole.row], kind="stable")
            laid = Rows(place[whole.row][by], whole.col[by], whole.val[by], whole.n)  # leaf after leaf
            first = dict(zip(leaves, np.cumsum([0, *[len(r) for r, _ in leaves.values()]]).tolist()))
            self.leaves += len(leaves) * len(held)
            for j, i in enumerate(held):
                self._ask(i, asked[j], weight, tree, bounds[:, j], laid, first, names[some[order]])

    def _ask(self, i, terms, weight, tree, bound, laid, first, names) -> None:
        mine = np.zeros(len(weight), np.int64)
        mine[terms] = weight[terms]
        scores, found = self.best[i]
        least = int(scores[-1]) if len(scores) >= self.k else 1
        open_, new, where = [(-bound[0], 0)], [], []
        n_new = 0
        while open_ and -open_[0][0] >= least:
            above, node = heapq.heappop(open_)
            for child in tree.children[node]:
                heapq.heappush(open_, (max(above, -bound[child]), child))  # both bounds hold
            if tree.leaves[node] is None:
                continue
            self.opened += 1
            a = first[node]
            b = a + len(tree.leaves[node])
            entry = slice(laid.start[a], laid.start[b] if b < laid.n else len(laid.row))
            got = np.add.reduceat(mine[laid.col[entry]] * laid.val[entry], laid.start[a:b] - laid.start[a])
            good = np.flatnonzero(got >= least)
            if len(good):
                new.append(got[good]); where.append(good + a)
                n_new += len(good)
                every = np.concatenate([scores, *new])
                if len(every) >= self.k:
                    least = max(least, int(np.partition(every, len(every) - self.k)[len(every) - self.k]))
        if new:
            new, where = np.concatenate(new), np.concatenate(where)
            good = new >= least
            self._keep(i, new[good], names[where[good]])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each item: first inside groups of tasks, then of what these leave."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: each item's ``k`` best documents with a score above 0.

    Items are taken in passes of about ``_PASS_TERMS`` terms, each pass over all documents: what
    is sent to the driver and broadcast is bounded by that (and by the largest single item).
    """
    asked = kept(item_terms(items, item_id, item_text))
    passes = max(1, -(-asked.count() // _PASS_TERMS))
    mine = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(passes))
    return reduce(DataFrame.unionByName, [_search(docs, asked.where(mine == p), k, doc_id, text) for p in range(passes)])


def _search(docs: DataFrame, asked: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    held: dict[int | None, list[bytes]] = {}
    for r in asked.sort("item_id", "term").toLocalIterator():
        held.setdefault(r["item_id"], []).append(bytes(r["term"]))
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in held.values() for t in terms}))}
    rows = kept(counted(docs, vocabulary, doc_id, text))
    n_docs, n_terms = rows.where(F.col("n") > 0).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(rows.select(F.explode("ids").alias("id")).groupBy("id").count().collect())  # one row for each term at most
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    queries = [(item, np.array(sorted(vocabulary[t] for t in terms))) for item, terms in held.items()]
    shared = rows.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        found, names, parts, size = Search(*shared.value, k), [], [], 0

        def full():
            lengths = np.concatenate([p[0] for p in parts])
            row = np.repeat(np.arange(len(lengths)), lengths)
            found.block(np.array(names, object), row, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, tfs = part.column("ids"), part.column("tfs")
                lengths = np.diff(ids.offsets.to_numpy())
                tf = tfs.flatten().to_numpy()
                m = np.array([50 + 50 * n * n_docs // n_terms for n in part.column("n").to_pylist()], np.int64)
                parts.append((lengths, ids.flatten().to_numpy(), 10**9 * tf // (1000 * tf + 20 * np.repeat(m, lengths))))
                names += part.column("doc_id").to_pylist()
                size += len(tf)
                if len(names) >= _BLOCK_ROWS or size >= _BLOCK_ENTRIES:
                    full()
                    names, parts, size = [], [], 0
        if names:
            full()
        for (item, _), (scores, docs_) in zip(found.items, found.best):
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(scores), pa.int64()), pa.array(docs_.tolist(), pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    best = rows.where(F.size("ids") > 0).mapInArrow(run, "item_id long, doc_id long, score long")
    return _ranked(best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), k)
