"""Gradient boosting of regression trees under the Huber loss, grown level by level from histograms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from cinestat.session import kept


@dataclass
class Tree:
    """``splits``: (feature, bound) of an inner node, numbered 1, 2, 3, ... from the root; ``values`` of leaves."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def leaf(self, features: list[Column], node: int = 1) -> Column:
        """Number of the leaf that a row ends in; a null feature goes left."""
        if node not in self.splits:
            return F.lit(node)
        at, bound = self.splits[node]
        return F.when(features[at] > bound, self.leaf(features, 2 * node + 1)).otherwise(self.leaf(features, 2 * node))

    def value(self, features: list[Column], node: int = 1) -> Column:
        if node not in self.splits:
            return F.lit(self.values.get(node, 0.0))
        at, bound = self.splits[node]
        return F.when(features[at] > bound, self.value(features, 2 * node + 1)).otherwise(self.value(features, 2 * node))


@dataclass
class Boosted:
    features: list[str]
    start: float
    rate: float
    trees: list[Tree]
    gains: list[float]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        columns, total = [F.col(c).cast("double") for c in self.features], F.lit(self.start)
        for tree in self.trees:
            total = total + self.rate * tree.value(columns)
        return df.withColumn(out, total)

    def importance(self) -> list[tuple[str, float]]:
        """Loss reduction by feature, 100 at the strongest, strongest first."""
        top = max(self.gains, default=0.0)
        return sorted(((f, 100 * g / top if top else 0.0) for f, g in zip(self.features, self.gains)), key=lambda x: (-x[1], x[0]))


def _bin(bounds: list[float], x: Column) -> Column:
    """How many bounds lie below a value; none below null."""
    return F.size(F.filter(F.lit(bounds), lambda b: b < x)) if bounds else F.lit(0)


def _best(cells: list, bounds: list[list[float]]) -> dict[int, tuple[float, int, float]]:
    """For each node the split (gain, feature, bound) that lowers the squared error most; ties: the first feature and bound."""
    sums: dict[tuple[int, int], dict[int, tuple[float, int]]] = {}
    for r in cells:
        sums.setdefault((r["node"], r["f"]), {})[r["bin"]] = (r["s"], r["n"])
    out: dict[int, tuple[float, int, float]] = {}
    for (node, f), bins in sorted(sums.items()):
        s, n = (sum(x) for x in zip(*bins.values()))
        left_s, left_n = 0.0, 0
        for b in sorted(bins)[:-1]:
            left_s, left_n = left_s + bins[b][0], left_n + bins[b][1]
            gain = left_s**2 / left_n + (s - left_s) ** 2 / (n - left_n) - s**2 / n
            if gain > 1e-9 and gain > out.get(node, (0.0,))[0] * (1 + 1e-12):
                out[node] = gain, f, bounds[f][b]
    return out


def huber_boosting(
    df: DataFrame, features: list[str], label: str, *, trees: int = 1000, depth: int = 4, rate: float = 0.1, quantile: float = 0.9,
    bins: int = 64, accuracy: int = 100_000, cut_every: int = 5,
) -> Boosted:
    """Trees of ``depth`` levels on the clipped residuals, started at the median.

    A tree follows the residuals, clipped where ``quantile`` of their sizes lies.  It is grown
    level by level: each task adds up (node, feature, bin) cells of its rows, at most
    ``2^depth * features * bins`` of them reach the driver, which picks the splits.  A leaf
    gives its residuals' median and the mean of what is clipped around it.  Bounds of bins,
    medians and the clipping point are percentiles of the given ``accuracy`` (exact below
    that many rows).  Rows without a label are left out; a null feature lies left of every bound.

    Predictions are carried along and written every ``cut_every`` trees.
    """
    rows = kept(df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y")))
    xs = [F.col(f"x{i}") for i in range(len(features))]
    cuts = [k / bins for k in range(1, bins)]
    first = rows.agg(F.percentile_approx("y", 0.5, accuracy).alias("y"), *[F.percentile_approx(x, cuts, accuracy).alias(f"b{i}") for i, x in enumerate(xs)]).first()
    if first["y"] is None:
        return Boosted(features, 0.0, rate, [], [0.0] * len(features))
    bounds = [sorted(set(first[f"b{i}"] or [])) for i in range(len(features))]
    state = kept(rows.withColumn("bins", F.array(*[_bin(b, x) for b, x in zip(bounds, xs)])).withColumn("now", F.lit(float(first["y"]))))
    model = Boosted(features, float(first["y"]), rate, [], [0.0] * len(features))
    for k in range(trees):
        left = state.withColumn("r", F.col("y") - F.col("now"))
        edge = left.agg(F.percentile_approx(F.abs("r"), quantile, accuracy)).first()[0]
        clipped = left.withColumn("g", F.signum("r") * F.least(F.abs("r"), F.lit(edge)))
        tree, open_ = Tree(), {1}
        for _ in range(depth):
            here = clipped.withColumn("node", tree.leaf(xs)).where(F.col("node").isin(*open_))
            cells = here.select("node", "g", F.posexplode("bins").alias("f", "bin")).groupBy("node", "f", "bin").agg(F.sum("g").alias("s"), F.count("*").alias("n"))
            found = _best(cells.collect(), bounds)
            if not found:
                break
            for node, (gain, f, bound) in found.items():
                tree.splits[node] = f, bound
                model.gains[f] += gain
            open_ = {child for node in found for child in (2 * node, 2 * node + 1)}
        placed = left.withColumn("leaf", tree.leaf(xs))
        medians = {r["leaf"]: r["m"] for r in placed.groupBy("leaf").agg(F.percentile_approx("r", 0.5, accuracy).alias("m")).collect()}
        middle = F.element_at(F.create_map(*[F.lit(v) for x in medians.items() for v in x]), F.col("leaf"))
        off = F.col("r") - middle
        rest = placed.groupBy("leaf").agg(F.avg(F.signum(off) * F.least(F.abs(off), F.lit(edge))).alias("v")).collect()
        tree.values = {r["leaf"]: medians[r["leaf"]] + r["v"] for r in rest}
        model.trees.append(tree)
        state = state.withColumn("now", F.col("now") + rate * tree.value(xs))
        if (k + 1) % cut_every == 0 and k + 1 < trees:
            state = kept(state)
    return model
