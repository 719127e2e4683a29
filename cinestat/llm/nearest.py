"""Approximate nearest neighbours: a forest of random-projection trees, one queue, exact reranking.

A tree splits by the sign of a projection onto the difference of two random sample rows,
at the sample's median.  Trees are fitted on a bounded sample; every row is then sent down
every tree.  A query descends all trees through one shared priority queue: a waiting node is
worth its squared distance from the query, added up over the splits where the path took the
other side, and the nearest waiting node of any tree comes next until enough rows are ahead.
All rows of the leaves reached are compared exactly, in double precision.

Inner products are searched as distances by one more coordinate, ``sqrt(M^2 - |x|^2)`` for
rows and 0 for queries (M: the largest norm), which orders both alike.

Equal vectors are one row of the index with its smallest numbers, since no result can show
more of them.

Rows are not copied into the leaves of each tree, nor queries to the leaves that they reach:
the index is written once, in blocks that name the leaf of each row in each tree, and a task
reads the blocks one by one past a bounded number of queries.  So disk follows the rows, and
only the best rows of each query leave a task.  Work still follows queries times rows
compared, the square of the table where ``share`` is what ends the queue.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.session import kept

NO_ID = np.iinfo(np.int64).max


class Forest:
    """Trees as arrays: ``normal[t, node]`` and ``cut[t, node]``; node ``i`` has children ``2i + 1``, ``2i + 2``."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: int, rows: int, seed: int = 4):
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        self.scale = float(np.sqrt((sample**2).sum(1).max(initial=0.0))) or 1.0
        full = np.concatenate([sample, np.sqrt(np.maximum(self.scale**2 - (sample**2).sum(1), 0))[:, None]], axis=1).astype(np.float32)
        # No deeper than the sample can place medians: eight of its rows per leaf.
        self.depth = max(0, min(math.ceil(math.log2(max(1, rows / leaf_rows))), int(math.log2(max(1, n / 8)))))
        inner = (1 << self.depth) - 1
        self.trees = trees
        self.normal = np.zeros((trees, inner, dim + 1), np.float32)
        self.cut = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            at = np.zeros(n, np.int64)
            for node in range(inner):
                mine = np.flatnonzero(at == node)
                of = mine if len(mine) > 1 else np.arange(n)
                a, b = full[rng.choice(of, 2, replace=False)]
                normal = a - b if (a != b).any() else rng.standard_normal(dim + 1).astype(np.float32)
                normal = normal / np.linalg.norm(normal)
                across = full[of] @ normal
                self.normal[t, node], self.cut[t, node] = normal, np.median(across)
                at[mine] = 2 * node + 1 + (full[mine] @ normal > self.cut[t, node])

    def extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.scale**2 - (x**2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree, ``rows x trees``."""
        full = self.extended(x, query=False)
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + ((full * self.normal[t, at]).sum(1) > self.cut[t, at])
            out[:, t] = at - ((1 << self.depth) - 1)
        return out

    def reached(self, x: np.ndarray, sizes: np.ndarray, rows: float) -> tuple[np.ndarray, np.ndarray]:
        """Which leaves the queue gives every query until ``rows`` rows lie ahead, and its own leaf in the first tree.

        Leaves leave the queue in the order of their distances, so a line drawn through these says
        the same; leaves as far as the last one are in.  Bits, ``queries x trees x bytes``.
        """
        full, inner = self.extended(x, query=True), self.normal.shape[1]
        normal = self.normal.reshape(-1, self.normal.shape[2]).T
        bits, own = [], []
        for a in range(0, len(x), 64):
            part = full[a : a + 64]
            side = (part @ normal).reshape(len(part), self.trees, inner) - self.cut
            more = side.astype(np.float64) ** 2
            far = np.zeros((len(part), self.trees, 1))
            for level in range(self.depth):
                at = slice((1 << level) - 1, (2 << level) - 1)
                right, step = side[:, :, at] > 0, more[:, :, at]
                both = [far + np.where(right, step, 0.0), far + np.where(right, 0.0, step)]
                far = np.stack(both, axis=-1).reshape(len(part), self.trees, -1)
            flat, each = far.reshape(len(part), -1), np.arange(len(part))
            order = flat.argsort(axis=1)
            last = np.minimum((np.cumsum(sizes.ravel()[order], axis=1) < rows).sum(1), flat.shape[1] - 1)
            line = flat[each, order[each, last]]
            bits.append(np.packbits(far <= line[:, None, None], axis=-1, bitorder="little"))
            own.append(far[:, 0].argmin(1))
        return np.concatenate(bits), np.concatenate(own)


class Asked:
    """A block of queries and the ``top`` best rows that each has met so far (score, then smaller number).

    Blocks of the index come past one by one.  Products in single precision, of vectors divided
    by ``scale``, only rule rows out, by more than they can be wrong; what is left is compared in
    double precision.  Rows that no query of a group reaches are not multiplied.
    """

    GROUP, PAIRS = 256, 1 << 16

    def __init__(self, forest: Forest, sizes: np.ndarray, rows: float, x: np.ndarray, top: int, scale: float):
        bits, own = forest.reached(x, sizes, rows)
        self.order = np.argsort(own, kind="stable")  # queries of one place share a group
        self.x, self.bits, self.top, self.scale = x[self.order], bits[self.order], top, scale
        self.tree = np.arange(forest.trees)
        groups = range(0, len(x), self.GROUP)
        self.reach = [np.unpackbits(np.bitwise_or.reduce(self.bits[a : a + self.GROUP]), axis=-1, bitorder="little").view(bool) for a in groups]
        self.small = (self.x / scale).astype(np.float32)
        # Twice what rounding to, and adding up in, single precision can do to a product with a row of norm 1.
        self.slack = np.linalg.norm(self.x / scale, axis=1) * ((x.shape[1] + 16) * 2.0**-23)
        self.score, self.id = np.full((len(x), top), -np.inf), np.full((len(x), top), NO_ID)
        self.line = np.full(len(x), -np.inf)  # the last of the best, scaled
        self.most = np.finfo(np.float64).max / scale / scale  # from here on scores are equal, infinite

    def sees(self, row: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Whether the queue of query ``row`` came to one of the leaves ``leaf`` (trees x pairs)."""
        got = self.bits[row, self.tree[:, None], leaf >> 3] >> (leaf & 7).astype(np.uint8)
        return (got & 1).any(axis=0)

    def meet(self, m: np.ndarray, leaf: np.ndarray, ids: np.ndarray, start: np.ndarray) -> None:
        """``m``: rows of the index, ``leaf``: their leaves (trees x rows), ``ids[start[i]:start[i + 1]]``: the numbers of row ``i``."""
        m = m.astype(np.float64)
        small = (m / self.scale).astype(np.float32)
        slack = self.slack * np.linalg.norm(m / self.scale, axis=1).max() + m.shape[1] * 1e-37
        for k, reach in enumerate(self.reach):
            met = np.zeros(len(m), bool)
            for t in self.tree:
                met |= reach[t, leaf[t]]
                if met.all():
                    break
            cols = np.flatnonzero(met)
            if not len(cols):
                continue
            g = slice(k * self.GROUP, (k + 1) * self.GROUP)
            rough = self.small[g] @ (small if len(cols) == len(m) else small[cols]).T
            line, off = self.line[g], slack[g]
            at = self._above(rough, line - off)
            if at is None:
                first = np.minimum(self._first(rough, off, leaf[:, cols], g.start), self.most)
                at = self._above(rough, np.maximum(line, first) - off, whole=True)
            for a in range(0, len(at), self.PAIRS):
                row, col = np.divmod(at[a : a + self.PAIRS], len(cols))
                row, col = row + g.start, cols[col]
                ok = self.sees(row, leaf[:, col])
                if ok.any():
                    row, col = row[ok], col[ok]
                    score = np.einsum("ij,ij->i", self.x[row], m[col])  # the same order of additions wherever a pair meets
                    self._take(row, score, col, ids, start)

    def _above(self, rough: np.ndarray, line: np.ndarray, whole: bool = False) -> np.ndarray | None:
        """Places of the products at or above the line; None if they are many and a better line is worth its price."""
        if not whole and np.isneginf(line).any():
            return None
        hit = (rough >= line.astype(np.float32)[:, None]).ravel()
        if not whole and np.count_nonzero(hit) > self.PAIRS:
            return None
        even = len(hit) // 8 * 8  # hits are rare: eight places at once
        at = (np.flatnonzero(hit[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        return np.concatenate([at[hit[at]], even + np.flatnonzero(hit[even:])])

    def _first(self, rough: np.ndarray, off: np.ndarray, leaf: np.ndarray, a: int) -> np.ndarray:
        """A line that ``top`` of these rows reach, from the rows of the largest products that the query may see."""
        wide = min(4 * self.top, rough.shape[1])
        if wide < self.top:
            return np.full(len(rough), -np.inf)
        best = np.argpartition(rough, rough.shape[1] - wide, axis=1)[:, -wide:]
        ok = self.sees(np.repeat(np.arange(a, a + len(rough)), wide), leaf[:, best.ravel()]).reshape(best.shape)
        seen = np.where(ok, np.take_along_axis(rough, best, axis=1), -np.inf)
        return np.partition(seen, wide - self.top, axis=1)[:, wide - self.top].astype(np.float64) - off

    def _take(self, row: np.ndarray, score: np.ndarray, col: np.ndarray, ids: np.ndarray, start: np.ndarray) -> None:
        n = start[col + 1] - start[col]
        number = ids[np.repeat(start[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        touched = np.unique(row)
        row = np.concatenate([np.repeat(row, n), np.repeat(touched, self.top)])
        score = np.concatenate([np.repeat(score, n), self.score[touched].ravel()])
        number = np.concatenate([number, self.id[touched].ravel()])
        by = np.lexsort((number, -score, row))
        row, score, number = row[by], score[by], number[by]
        ok = np.arange(len(row)) - np.searchsorted(row, row) < self.top
        self.score[touched], self.id[touched] = score[ok].reshape(-1, self.top), number[ok].reshape(-1, self.top)
        self.line[touched] = np.minimum(self.score[touched, -1] / self.scale / self.scale, self.most)

    def found(self):
        """Place of each query in its block, the numbers and the scores of its best rows."""
        for i, number, score in zip(self.order.tolist(), self.id, self.score):
            ok = (number != NO_ID) | ~np.isneginf(score)
            yield i, number[ok].tolist(), score[ok].tolist()


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _unpickled(df: DataFrame) -> RDD:
    """What lies in the only column, binary, of ``df``: pickled lists.  Spark hands the bytes to Python as they are, one row at a time."""
    sc = df.sparkSession.sparkContext
    plain = getattr(df._jdf, "as")(sc._jvm.org.apache.spark.sql.Encoders.BINARY())
    return RDD(plain.javaRDD(), sc, BatchedSerializer(CPickleSerializer()))


def usable(vector: str) -> Column:
    """Not null, not empty, not zero, every component finite."""
    c = F.col(vector)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def search(
    table: DataFrame, queries: Column, k: int = 20, trees: int = 12, leaf_rows: int = 256, share: float = 0.7,
    least_rows: int = 12_000, sample_rows: int = 20_000, block_rows: int = 4096, seed: int = 4, ask_rows: int = 16_384,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest found.

    A query is a row for which ``queries`` holds; its own row is no candidate.  Rows that are
    not :func:`usable` take no part, nor do rows of another dimension than the most frequent
    (ties: the largest).  ``share`` and ``least_rows`` say how many rows, counted once per
    tree, a query is compared with; on data without structure recall needs a fixed share,
    clustered data reach it with far less.  Fewer candidates than ``k``: all.  Ties in the
    score go to the smaller number.  Rows repeated with one number count once.

    The index is kept in blocks of at most ``block_rows`` rows; a task takes about ``ask_rows`` queries.
    """
    spark = table.sparkSession
    single = table.schema[vector].dataType.elementType.typeName() == "float"  # kept as they are: half of the bytes
    v = F.col(vector) if single else F.transform(vector, lambda x: x.cast("double"))
    rows = table.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), queries.alias("q"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, of = dims["d"], np.dtype(np.float32 if single else np.float64)
    # 128 bits that stand for a vector, the same for either zero.
    rows = rows.where(F.size("v") == d).withColumn("key", F.concat_ws(":", F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v")))
    # Of equal vectors no result shows more than the k + 1 smallest numbers.
    few = rows.select("key", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    vectors = rows.groupBy("key").agg(F.first("v").alias("v"), F.max("q").alias("q"))
    index = kept(vectors.join(ids, "key"))
    n, n_asked, largest = index.agg(F.count("*"), F.count_if("q"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    # A share of the hash range that holds enough rows first: else every task would send its own smallest.
    h = F.xxhash64("key", F.lit(seed))
    some = index.where(F.pmod(h, F.lit(1 << 20)) < F.lit(min(1.0, 2 * sample_rows / max(n, 1)) * (1 << 20)))
    sample = some.orderBy(h).limit(sample_rows).select("v")
    forest = Forest(np.array([r["v"] for r in sample.collect()], np.float64), trees, leaf_rows, n, seed)
    shared = spark.sparkContext.broadcast(forest)
    leaves = 1 << forest.depth
    leaf_of = np.min_scalar_type(leaves - 1)

    def place(batches):
        f = shared.value
        for batch in (whole.slice(a, block_rows) for whole in batches for a in range(0, whole.num_rows, block_rows)):
            x, n_ids = _matrix(batch.column("v"), d), batch.column("ids").value_lengths().to_numpy()
            parts = [
                x.astype(of), f.leaves(x.astype(np.float64)).T.astype(leaf_of),
                batch.column("ids").flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(n_ids)]).astype(np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([tuple(p.tobytes() for p in parts)])], pa.binary())], names=["block"])

    # Small row groups: a reader holds a whole one.
    blocks = kept(index.select("ids", "v").mapInArrow(place, "block binary"), **{"parquet.block.size": str(1 << 24)})

    def tally(part):
        sizes = np.zeros((trees, leaves), np.int64)
        for _, leaf, _, _ in part:
            for t, at in enumerate(np.frombuffer(leaf, leaf_of).reshape(trees, -1)):
                sizes[t] += np.bincount(at, minlength=leaves)
        yield sizes

    leaf_sizes = _unpickled(blocks).mapPartitions(tally).treeReduce(np.add)
    shared_sizes = spark.sparkContext.broadcast(leaf_sizes)
    ahead = max(least_rows, share * n)
    scale = largest * math.sqrt(d)  # no norm is larger

    def gathered(batches):
        held = list(batches)
        keys = [x for batch in held for x in batch.column("key").to_pylist()]
        if keys:
            x = np.concatenate([_matrix(batch.column("v"), d) for batch in held]).astype(of)
            parts = -(-len(keys) // ask_rows)
            for at in np.array_split(np.arange(len(keys)), parts):
                yield pa.RecordBatch.from_arrays([pa.array([",".join(keys[at[0] : at[-1] + 1])]), pa.array([x[at].tobytes()], pa.binary())], names=["keys", "v"])

    # Each block of queries reads the whole index; so few queries that they keep no more tasks busy read it in parts.
    wanted = 2 * spark.sparkContext.defaultParallelism
    tasks = max(1, -(-n_asked // ask_rows), min(wanted, n_asked // 1024))
    asked = index.where("q").select("key", "v").repartition(tasks, "key").mapInArrow(gathered, "keys string, v binary")
    asked = asked.rdd.map(lambda r: (r["keys"], bytes(r["v"])))
    slices = max(1, -(-wanted // asked.getNumPartitions()))

    def compare(pairs):
        f, sizes = shared.value, shared_sizes.value
        held: dict[str, Asked] = {}
        for (keys, v), (m, leaf, numbers, start) in pairs:
            if keys not in held:
                held[keys] = Asked(f, sizes, ahead, np.frombuffer(v, of).reshape(-1, d).astype(np.float64), k + 1, scale)
            held[keys].meet(
                np.frombuffer(m, of).reshape(-1, d), np.frombuffer(leaf, leaf_of).reshape(trees, -1),
                np.frombuffer(numbers, np.int64), np.frombuffer(start, np.int64))
        for keys, block in held.items():
            names = keys.split(",")
            for i, number, score in block.found():
                yield names[i], number, score

    met = asked.cartesian(_unpickled(blocks.coalesce(slices))).mapPartitions(compare)
    best = kept(spark.createDataFrame(met, "q string, number array<long>, score array<double>", verifySchema=False))
    each = F.zip_with("number", "score", lambda i, s: F.struct((-s).alias("less"), i.alias("id"), s.alias("score")))
    # One list for each part of the index, k + 1 at most in each.
    lists = best.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("found"))
    asking = rows.where("q").select(F.col("id").alias("query_id"), F.col("key").alias("of")).distinct()
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asking.join(lists, F.col("of") == F.col("q")).select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
