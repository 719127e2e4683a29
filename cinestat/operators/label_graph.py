"""Discrete labelling of graphs: message passing and energies as DataFrame steps.

One row per directed edge carries the costs of both ends and the message that arrives
at its source.  A round is a window sum over the source plus arithmetic, after which
the row is turned round; there is no join.  Graphs that fit a task are placed by graph
and then need no shuffle in any round; larger ones are placed by vertex (one shuffle
per round).  Degrees are those of pixel grids, so a vertex group is small.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.session import cut_lineage, kept

Smooth = list[list[float]]


def potts(labels: list[int], weight: float, unknown: int | None = None) -> Smooth:
    """0 for equal labels, ``weight`` otherwise; the unknown label always pays."""
    return [[0.0 if a == b and a != unknown else weight for b in labels] for a in labels]


def grid_edges(sites: DataFrame, graph: str, width: int, height: int, doubled: int = 2) -> DataFrame:
    """Directed 4-neighbour edges of pixel rows ``(graph, site, costs...)``.

    ``times`` counts how often an edge was inserted: announcing each pair from both
    ends, as the original set-up does, yields every directed edge twice.
    """
    x, y = F.col("site") % width, F.floor(F.col("site") / width)
    near = F.filter(
        F.array(
            F.when(x > 0, F.col("site") - 1), F.when(x < width - 1, F.col("site") + 1),
            F.when(y > 0, F.col("site") - width), F.when(y < height - 1, F.col("site") + width),
        ),
        lambda n: n.isNotNull(),
    )
    return sites.select(
        graph, F.col("site").alias("src"), F.explode(near).alias("dst"), F.lit(float(doubled)).alias("times")
    )


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that never gathers a side at the driver: files of kept rows are far smaller than the rows."""
    return left.join(right.hint("merge"), on, how)


def with_costs(edges: DataFrame, sites: DataFrame, graph: str, n: int) -> DataFrame:
    """Attach the data costs of both ends as flat columns."""
    ends = []
    for end in ("src", "dst"):
        cols = [F.get("costs", i).alias(f"{end[0]}{i}") for i in range(n)]
        ends.append(sites.select(graph, F.col("site").alias(end), *cols))
    return _met(_met(edges, ends[0], [graph, "src"]), ends[1], [graph, "dst"])


def integer_costs(costs: Column) -> Column:
    """Data costs are stored as integers (truncated)."""
    return F.transform(costs, lambda c: c.cast("int").cast("double"))


def propagate(
    edges: DataFrame, graph: str, smooth: Smooth, rounds: int, *, by_vertex: bool = False, cut_every: int = 10
) -> DataFrame:
    """``rounds`` of synchronous min-sum messages; adds the incoming message ``m0..``."""
    place = [graph, "src"] if by_vertex else [graph]
    state = silent(edges, len(smooth))
    if not by_vertex:
        state = state.repartition(graph)
    for step in range(rounds):
        if by_vertex:
            state = state.repartition(*place)
        state = one_round(state, graph, smooth)
        if (step + 1) % cut_every == 0 and step + 1 < rounds:
            state = cut_lineage(state)
            if not by_vertex:
                state = state.repartition(graph)
    return state


def silent(edges: DataFrame, n: int) -> DataFrame:
    """Edges before any message."""
    return edges.select("*", *[F.lit(0.0).alias(f"m{i}") for i in range(n)])


def one_round(state: DataFrame, graph: str, smooth: Smooth) -> DataFrame:
    """Every edge's next message, from what has arrived at its source."""
    n = len(smooth)
    at_source = Window.partitionBy(graph, "src")
    # All messages into the source except the ones that came from the destination.
    belief = state.select(
        "*",
        *[
            (F.col(f"s{i}") + F.sum(F.col(f"m{i}") * F.col("times")).over(at_source)
             - F.col(f"m{i}") * F.col("times")).alias(f"h{i}")
            for i in range(n)
        ],
    )
    sent = belief.select(
        "*",
        *[
            F.least(*[F.col(f"h{k}") + F.lit(float(smooth[k][j])) for k in range(n)]).alias(f"o{j}")
            for j in range(n)
        ],
    )
    low = F.least(*[F.col(f"o{j}") for j in range(n)])
    return sent.select(
        graph, F.col("dst").alias("src"), F.col("src").alias("dst"), "times",
        *[F.col(f"d{i}").alias(f"s{i}") for i in range(n)],
        *[F.col(f"s{i}").alias(f"d{i}") for i in range(n)],
        *[(F.col(f"o{j}") - low).alias(f"m{j}") for j in range(n)],
    )


def _argmin(values: list[Column], labels: list[int]) -> Column:
    """Label of the smallest value; the label listed first wins ties."""
    best = F.array_min(
        F.array(*[F.struct(v.alias("v"), F.lit(i).alias("i"), F.lit(l).alias("l")) for i, (v, l) in enumerate(zip(values, labels))])
    )
    return best["l"]


def decide(sites: DataFrame, state: DataFrame, graph: str, labels: list[int]) -> DataFrame:
    """Final label and its data cost per site; sites without edges use their costs."""
    n = len(labels)
    sums = state.groupBy(graph, F.col("src").alias("site")).agg(
        *[F.sum(F.col(f"m{i}") * F.col("times")).alias(f"b{i}") for i in range(n)]
    )
    joined = _met(sites, sums, [graph, "site"], "left")
    totals = [F.get("costs", i) + F.coalesce(F.col(f"b{i}"), F.lit(0.0)) for i in range(n)]
    out = joined.select(graph, "site", "costs", _argmin(totals, labels).alias("label"))
    own = F.get("costs", F.array_position(F.array(*[F.lit(l) for l in labels]), F.col("label")).cast("int") - 1)
    return out.select(graph, "site", "label", own.alias("data_cost"))


def initial_labels(sites: DataFrame, graph: str, labels: list[int]) -> DataFrame:
    """Cheapest label of every site before any message."""
    costs = [F.get("costs", i) for i in range(len(labels))]
    return sites.select(graph, "site", _argmin(costs, labels).alias("label"), F.least(*costs).alias("data_cost"))


def energy(labelled: DataFrame, edges: DataFrame, graph: str, labels: list[int], smooth: Smooth) -> DataFrame:
    """Data plus smoothness energy per graph; directed edges count as often as inserted."""
    entries = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in labels for b in labels
    ]
    costs = [F.lit(float(v)) for row in smooth for v in row]
    table = F.map_from_arrays(F.array(*entries), F.array(*costs))
    ends = [labelled.select(graph, F.col("site").alias(e), F.col("label").alias(f"l_{e}")) for e in ("src", "dst")]
    pairs = _met(_met(edges.select(graph, "src", "dst", "times"), ends[0], [graph, "src"]), ends[1], [graph, "dst"])
    price = F.element_at(table, F.struct(F.col("l_src").alias("a"), F.col("l_dst").alias("b")))
    smoothness = pairs.groupBy(graph).agg(F.sum(price * F.col("times")).alias("smoothness"))
    data = labelled.groupBy(graph).agg(F.sum("data_cost").alias("data"))
    both = _met(data, smoothness, graph, "left")
    return both.select(graph, (F.col("data") + F.coalesce("smoothness", F.lit(0.0))).alias("energy"))


def belief_propagation(
    sites: DataFrame, edges: DataFrame, graph: str, labels: list[int], smooth: Smooth, rounds: int, **place: bool
) -> DataFrame:
    full = with_costs(edges, sites, graph, len(labels))
    return decide(sites, propagate(full, graph, smooth, rounds, **place), graph, labels)


def until_no_gain(step: Callable[[int], tuple[DataFrame, DataFrame]], max_rounds: int | None = None) -> DataFrame:
    """Grow the number of rounds until the total energy stops falling; the energy alone decides unless a bound is given.

    ``step(r)`` returns labels and per-graph energies after r rounds; one number per
    round reaches the driver.
    """
    best, last = None, None
    for r in itertools.count(1):
        if max_rounds is not None and r > max_rounds:
            raise ValueError(f"the energy still fell after {max_rounds} rounds")
        labelled, energies = step(r)
        total = energies.agg(F.sum("energy")).first()[0]
        if last is not None and total >= last and r > 1:
            return labelled if total == last else best
        best, last = labelled, total


SOLVERS = ("belief", "modes")


def settle_labels(
    sites: DataFrame, edges: DataFrame, graph: str, labels: list[int], smooth: Smooth, *, solver: str = "belief", most_rounds: int = 1000,
) -> DataFrame:
    """``graph``, ``site``, ``label``, ``data_cost``, ``rounds``, ``converged``: each graph labelled until its energy stops falling.

    A graph ends with the first round that leaves its energy as it was (``converged``) or,
    from the second round on, raises it; the labels of that round are its result.  ``solver``
    names what a round is: ``belief`` (one exchange of messages) or ``modes`` (one sweep over the
    sites).  A graph that still falls after ``most_rounds`` has ``converged`` null.

    What a round needs of the one before is carried along, not worked out again: messages, or
    labels.  Graphs that ended leave the working set, so a round costs what still moves; sites
    and edges are written anew once half of the graphs are gone, so that no plan grows by round.
    """
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}; known are {', '.join(SOLVERS)}")
    n = len(labels)
    all_sites, all_edges = sites, edges = kept(sites), kept(edges)
    now = initial_labels(sites, graph, labels)
    last = kept(energy(now, edges, graph, labels, smooth))
    state = kept(silent(with_costs(edges, sites, graph, n), n)) if solver == "belief" else kept(now)
    ended: list[DataFrame] = []
    held = last.count()
    for r in range(1, most_rounds + 1):
        if solver == "belief":
            state = kept(one_round(state.repartition(graph), graph, smooth))
            now = kept(decide(sites, state, graph, labels))
        else:
            begun = _met(sites, state.select(graph, "site", F.col("label").alias("start")), [graph, "site"])
            now = state = kept(iterated_modes(begun, edges, graph, labels, smooth, 1))
        fresh = energy(now, edges, graph, labels, smooth)
        falls = _met(last.select(graph, F.col("energy").alias("was")), fresh, graph)
        same = F.col("energy") == F.col("was")
        stops = same if r == 1 else F.col("energy") >= F.col("was")
        last = kept(falls.select(graph, "energy", same.alias("converged"), (stops if r < most_rounds else F.lit(True)).alias("stops"), (F.col("energy") >= F.col("was")).alias("rests")))
        flag = F.when(F.col("rests"), F.col("converged")).alias("converged")
        ended.append(_met(now, last.where("stops").select(graph, flag), graph).withColumn("rounds", F.lit(r)))
        going = kept(last.where("not stops").select(graph))
        left = going.count()
        if not left:
            break
        last = last.where("not stops")
        sites, edges, state = (_met(df, going, graph, "left_semi") for df in (all_sites, all_edges, state))
        if 2 * left <= held:
            all_sites, all_edges = sites, edges = kept(sites), kept(edges)
            held = left
    return reduce(DataFrame.unionByName, ended).select(graph, "site", "label", "data_cost", "rounds", "converged")


def iterated_modes(
    sites: DataFrame, edges: DataFrame, graph: str, labels: list[int], smooth: Smooth, rounds: int, *, sites_at_once: int = 1 << 16,
) -> DataFrame:
    """Sequential site-by-site minimisation; its order makes a graph one unit of work.

    A graph holds the pixels of one image.  Start labels are those in a column ``start``, or
    else the cheapest ones.  A sweep in
    site order depends only on the neighbours before a site, so sites fall into levels (on a
    grid: anti-diagonals) whose members do not touch; graphs of a batch advance level by
    level together, as many as ``sites_at_once`` allows, which gives exactly the result of going
    site by site.
    """
    beside = edges.groupBy(graph, F.col("src").alias("site")).agg(
        F.collect_list(F.struct("dst", "times")).alias("near")
    )
    whole = sites.join(beside, [graph, "site"], "left").groupBy(graph).agg(
        F.array_sort(F.collect_list(F.struct("site", "costs", "near", (F.col("start") if "start" in sites.columns else F.lit(None).cast("int")).alias("start")))).alias("sites")
    )
    price_of = np.array(smooth, float)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([0, *batch.column("sites").value_lengths().fill_null(0).to_pylist()])
            at = 0
            while at < batch.num_rows:  # a bounded number of sites at once, one graph at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + sites_at_once, side="right")) - 1)
                yield swept(batch.slice(at, to - at))
                at = to

    def swept(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("sites")
        of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        rows = lists.flatten()
        site, near, start = rows.field("site"), rows.field("near"), rows.field("start")
        cost = rows.field("costs").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), len(labels))
        # Sites are in order within a graph; a row stands for the last one of its number.
        src = np.repeat(np.arange(len(rows)), near.value_lengths().fill_null(0).to_numpy())
        links = near.flatten()
        to, times = links.field("dst"), links.field("times").to_numpy(zero_copy_only=False)
        places = pd.MultiIndex.from_arrays([of, site.to_pandas()])
        last = pd.Series(np.arange(len(rows)), places).groupby(level=[0, 1]).last()
        dst = last.index.get_indexer(pd.MultiIndex.from_arrays([of[src], to.to_pandas()]))
        if (dst < 0).any():
            raise KeyError(f"an edge leads to a site that its graph does not have: {to[int(np.flatnonzero(dst < 0)[0])]}")
        dst = last.to_numpy()[dst]
        level, before = np.zeros(len(rows), int), dst < src
        while True:
            deeper = level.copy()
            np.maximum.at(deeper, src[before], level[dst[before]] + 1)
            if (deeper == level).all():
                break
            level = deeper
        steps = []
        for k in range(level.max(initial=-1) + 1):
            mine = np.flatnonzero(level == k)
            e = np.flatnonzero(level[src] == k)
            steps.append((mine, np.searchsorted(mine, src[e]), dst[e], times[e, None]))
        cur = cost.argmin(1)
        begun = start.fill_null(labels[0]).to_numpy()
        given = np.flatnonzero(start.is_valid().to_numpy(zero_copy_only=False))
        cur[given] = [labels.index(x) for x in begun[given]]
        for _ in range(rounds):
            for mine, here, other, weight in steps:
                price = cost[mine]
                np.add.at(price, here, weight * price_of[:, cur[other]].T)
                cur[mine] = price.argmin(1)
        return pa.RecordBatch.from_arrays(
            [batch.column(graph).take(pa.array(of)), site, pa.array(np.array(labels, "int32")[cur]), pa.array(cost[np.arange(len(rows)), cur])],
            [graph, "site", "label", "data_cost"])

    kind = dict(sites.dtypes)
    out = f"{graph} {kind[graph]}, site {kind['site']}, label int, data_cost double"
    return whole.mapInArrow(sweep, out)
