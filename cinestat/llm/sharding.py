"""Shards of equal bytes by k-d tree partitioning over document metadata.

A node is split along its widest metadata dimension (extent relative to the whole table's) at
the weighted median, weights being bytes; a node that stands for an odd number of shards is
split in proportion.  Splitting goes on until every leaf holds the target bytes.

Medians are found by distributed histograms for all nodes of a level at once: bytes are
summed by bin, the bin across the line is opened again between its own least and greatest
value, until it holds one value; ties in a dimension are ordered by the text's hash in the
same manner.  The driver sees one row per node and pass.

What is placed are groups of equal texts, so that copies share a shard.  A group larger than
``1 / whole_below`` of a shard is dealt into parts first: kept whole, it would leave its
shard uneven, and no shard could take a group larger than itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinestat.llm.common import gapless
from cinestat.operators.keyed import attach_group
from cinestat.operators.ranking import global_row_number
from cinestat.session import kept

_BINS = 2048


_WHOLE = ("tinyint", "smallint", "int", "bigint")
_BOUND = 1 << 61  # differences must fit a long
_BROADCAST = 200_000  # ranks of a dimension; beyond, they are joined by value


def with_ordinal(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds a long that orders like ``column``, null where it is null.

    Whole numbers stand for themselves.  Anything else (text, fractions, times) is replaced by
    the rank of its value among all different ones, in the type's own order: common
    prefixes and magnitudes say nothing then.
    """
    if dict(df.dtypes)[column] in _WHOLE:
        return df.withColumn(out, F.greatest(F.least(F.col(column).cast("long"), F.lit(_BOUND)), F.lit(-_BOUND)))
    some = df.where(F.col(column).isNotNull())
    values = some.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows_of_value"))
    ranks = kept(global_row_number(values, ["value"], out).withColumn(out, F.col(out).cast("long")))
    if ranks.count() <= _BROADCAST:
        return df.join(F.broadcast(ranks.drop("rows_of_value")), F.col(column) == F.col("value"), "left").drop("value")
    known = attach_group(some.withColumn("value", F.col(column)), ranks, ["value"], "rows_of_value").drop("value")
    return known.unionByName(df.where(F.col(column).isNull()).withColumn(out, F.lit(None).cast("long")))


def _few(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table written into the plan itself."""
    values = ", ".join("(" + ", ".join(str(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in columns.split(", "))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(c.split()[0] for c in columns.split(', '))})")


def _line(rows: DataFrame, key: str, search: dict[int, dict]) -> dict[int, dict]:
    """For each node the value of ``key`` where its bytes, added up in order, pass ``want``.

    ``search``: per node ``lo``, ``hi`` (bounds of the key) and ``want``; adds ``at`` and
    ``below``, the bytes of all smaller values.
    """
    spark = rows.sparkSession
    found, left = {}, {k: dict(v, below=0) for k, v in search.items()}
    while left:
        for k in [k for k, v in left.items() if v["lo"] == v["hi"]]:
            found[k] = dict(left[k], at=left[k]["lo"])
            del left[k]
        if not left:
            break
        state = _few(spark, [(k, v["lo"], v["hi"]) for k, v in left.items()], "n int, lo bigint, hi bigint")
        # Differences of longs: as doubles, near neighbours among large values would fall together.
        width = (F.col("hi") - F.col("lo")).cast("double") / _BINS
        bin_ = F.least(F.floor((F.col(key) - F.col("lo")).cast("double") / width), F.lit(_BINS - 1))
        # One state row per node: at most as many as there are shards.
        bins = (
            rows.join(F.broadcast(state), F.col("node") == F.col("n")).where(F.col(key).between(F.col("lo"), F.col("hi")))
            .withColumn("bin", bin_).groupBy("n", "bin")
            .agg(F.sum("bytes").alias("b"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        )
        by_node: dict[int, list] = {}
        for r in bins.collect():  # nodes times bins at most
            by_node.setdefault(r["n"], []).append((r["bin"], r["b"], r["lo"], r["hi"]))
        for k, got in by_node.items():
            below = left[k]["below"]
            for _, b, lo, hi in sorted(got):
                if below + b >= left[k]["want"] or (_, b, lo, hi) == max(got):
                    left[k].update(below=below, lo=lo, hi=hi)
                    break
                below += b
    return found


def _split(units: DataFrame, dims: list[str], nodes: dict[int, tuple[int, int]], extent: dict[str, int]) -> tuple[DataFrame, dict]:
    """Splits every node that stands for several shards; ``nodes``: number -> (first shard, shards)."""
    many = {k: v for k, v in nodes.items() if v[1] > 1}
    facts = units.groupBy("node").agg(
        F.sum("bytes").alias("bytes"), F.min("h").alias("lo_h"), F.max("h").alias("hi_h"),
        *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    choice, search = {}, {}
    for r in facts.collect():
        if r["node"] in many:
            widest = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, extent[d]))
            choice[r["node"]] = widest
            k = many[r["node"]][1]
            search[r["node"]] = {"lo": r[f"lo_{widest}"], "hi": r[f"hi_{widest}"], "want": r["bytes"] * (k // 2) / k}
    pick = F.lit(None).cast("long")
    for d in dims:
        pick = F.when(F.col("node").isin([k for k, v in choice.items() if v == d]), F.col(d)).otherwise(pick)
    keyed = units.withColumn("key", pick)
    line = _line(keyed, "key", search)
    spark = units.sparkSession
    if line:
        at = F.broadcast(_few(spark, [(k, v["at"]) for k, v in line.items()], "m int, at bigint"))
        tied = keyed.join(at, F.col("node") == F.col("m")).where(F.col("key") == F.col("at"))
        span = {r["node"]: r for r in tied.groupBy("node").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).collect()}
        tie = _line(tied, "h", {k: {"lo": span[k]["lo"], "hi": span[k]["hi"], "want": v["want"] - v["below"]} for k, v in line.items()})
        # The unit across the line goes to the side that ends nearer.
        own = {(r["node"], r["h"]): r["b"] for r in tied.join(
            F.broadcast(_few(spark, [(k, v["at"]) for k, v in tie.items()], "q int, hq bigint")),
            (F.col("node") == F.col("q")) & (F.col("h") == F.col("hq"))).groupBy("node", "h").agg(F.sum("bytes").alias("b")).collect()}
        table = []
        for k, v in line.items():
            miss = v["want"] - v["below"] - tie[k]["below"]
            first, n = many[k]
            table.append((k, v["at"], tie[k]["at"], own[k, tie[k]["at"]] - miss < miss, first, first + n // 2))
        lines = F.broadcast(_few(spark, table, "k int, at bigint, ath bigint, with_line boolean, low int, high int"))
        low = (F.col("key") < F.col("at")) | ((F.col("key") == F.col("at")) & (
            (F.col("h") < F.col("ath")) | ((F.col("h") == F.col("ath")) & F.col("with_line"))))
        keyed = keyed.join(lines, F.col("node") == F.col("k"), "left").withColumn(
            "node", F.when(F.col("k").isNull(), F.col("node")).when(low, F.col("low")).otherwise(F.col("high")))
    after = {}
    for first, n in nodes.values():
        if n > 1:
            after[first], after[first + n // 2] = (first, n // 2), (first + n // 2, n - n // 2)
        else:
            after[first] = (first, 1)
    return kept(keyed.select(*units.columns)), after


def shard(
    docs: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("lang", "source", "n_chars"), whole_below: int = 4,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every row.

    ``size`` is the text's UTF-8 bytes plus one (null: none, so one; its checksum is that of
    no bytes).  Copies take the least metadata among them.  Dimensions that the table lacks
    are left out; without any, the text's hash alone orders.  A null in a dimension lies
    before all values.  An empty table gives no rows.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    dims = [d for d in dims if d in docs.columns]
    # A row's own number tells rows apart that have none (it is written, so it stays the same).
    rows = kept(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("t"), F.monotonically_increasing_id().alias("row"), *[F.col(f"`{d}`").alias(f"v{k}") for k, d in enumerate(dims)]))
    for k in range(len(dims)):
        rows = with_ordinal(rows, f"v{k}", f"d{k}").drop(f"v{k}")
    names = [f"d{k}" for k in range(len(dims))] or ["h0"]
    if dims:
        least = rows.agg(*[F.min(n).alias(n) for n in names]).first()
        rows = kept(rows.withColumns({n: F.coalesce(n, F.lit(-1 if least[n] is None else least[n] - 1).cast("long")) for n in names}))
    group = ["t", "size", "text_crc32"]

    def units_of(df: DataFrame) -> DataFrame:
        return df.groupBy(*group, "part").agg(
            F.sum("size").alias("bytes"), *[F.min(n).alias(n) for n in names if n != "h0"],
        ).withColumn("h", F.xxhash64(*group).bitwiseAND(F.lit((1 << 62) - (1 << 16))) + F.col("part")).withColumn("h0", F.lit(0).cast("long")).withColumn("node", F.lit(0))

    rows = rows.withColumn("part", F.lit(0))
    units = kept(units_of(rows))
    total = units.agg(F.sum("bytes")).first()[0] or 0
    most = max(1, total // (shards * whole_below))
    # Fewer than shards * whole_below groups can be larger than that.
    held = [n for n in names if n != "h0"]
    large = units.where(F.col("bytes") > most).select(*group, "bytes", *held).collect()
    if large:
        parts = _few(
            docs.sparkSession, [(*r[:3], math.ceil(8 * r["bytes"] / most), *r[4:]) for r in large],
            ", ".join(["t bigint, size bigint, text_crc32 bigint, parts int", *[f"g_{n} bigint" for n in held]]))
        # Parts share the group's metadata and lie next to each other in hash order: in as few shards as can hold them.
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.col("parts"))).cast("int")
        rows = kept(rows.drop("part").join(F.broadcast(parts), group, "left").withColumns(
            {"part": part} | {n: F.coalesce(f"g_{n}", n) for n in held}).drop("parts", *[f"g_{n}" for n in held]))
        units = kept(units_of(rows))
    lo_hi = units.agg(*[(F.max(n) - F.min(n)).alias(n) for n in names]).first()
    extent, nodes = {n: lo_hi[n] or 0 for n in names}, {0: (0, shards)}
    while total and any(n > 1 for _, n in nodes.values()):
        units, nodes = _split(units, names, nodes, extent)
    placed = rows.join(units.select(*[F.col(c).alias(f"u_{c}") for c in (*group, "part")], F.col("node").alias("shard")),
        (F.col("t") == F.col("u_t")) & (F.col("size") == F.col("u_size")) & (F.col("text_crc32") == F.col("u_text_crc32")) & (F.col("part") == F.col("u_part")))
    placed = kept(placed.select("doc_id", "size", "text_crc32", "shard", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row")))
    return gapless(placed, ["shard"], [F.col(c) for c in ("doc_id", "text_crc32", "size", "row")], "slot").drop("row")
