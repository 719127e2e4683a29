"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from cinestat.session import kept

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(df: DataFrame) -> Column:
    """128 bits that stand for a whole row: rows with one key are equal in every column."""
    return F.md5(F.concat_ws("\x00", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x01")) for c in df.columns]))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def extended(schema: StructType, **fields: str) -> StructType:
    """A new schema with more columns, which replace those of the same name."""
    out = StructType([f for f in schema.fields if f.name not in fields])
    for name, kind in fields.items():
        out = out.add(name, {"int": "integer"}.get(kind, kind))
    return out


def _slices(batches, rows: int = 1000):
    """Arrow batches in parts of a bounded number of rows, so that what is worked out from them is bounded too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def derived(df: DataFrame, sources: list[str], make: Callable, keep: list[str], **fields: str) -> DataFrame:
    """``keep`` and columns worked out from ``sources``, batch by batch.

    ``make()`` is called once in a task and gives a function from lists of values to columns
    by name.  Kept columns pass as Arrow arrays, unconverted: nulls and large numbers stay.
    """
    names = [c for c in keep if c not in fields]

    def run(batches):
        fn = make()
        for batch in _slices(batches):
            got = fn(*[batch.column(f"__in{i}").to_pylist() for i in range(len(sources))])
            new = [pa.array(got[k], _ARROW[kind], from_pandas=True) for k, kind in fields.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], names=[*names, *fields])

    taken = df.select(*names, *[F.col(c).alias(f"__in{i}") for i, c in enumerate(sources)])
    return taken.mapInArrow(run, extended(df.select(*names).schema, **fields))


def expanded(df: DataFrame, source: str, make: Callable, keep: list[str], **fields: str) -> DataFrame:
    """Like :func:`derived` with any number of rows for each: the function also gives their row numbers."""
    def run(batches):
        fn = make()
        for batch in _slices(batches):
            rows, got = fn(batch.column("__in").to_pylist())
            at = pa.array(rows, pa.int64())
            new = [pa.array(got[k], _ARROW[kind]) for k, kind in fields.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in keep], *new], names=[*keep, *fields])

    taken = df.select(*keep, F.col(source).alias("__in"))
    return taken.mapInArrow(run, extended(df.select(*keep).schema, **fields))


def gapless(df: DataFrame, keys: list[str], order: list[Column], out: str, per_task: int = 200_000) -> DataFrame:
    """Numbers the rows of each key 0, 1, 2, ... without a task that holds a whole key.

    A key's rows are dealt into salts by a hash of ``order``; a row's number is its place
    inside the salt plus the sizes of the salts before it.  The result depends on the rows
    alone, not on where they lay.  Rows equal in ``order`` are interchangeable.
    """
    n = df.count()
    salts = max(1, math.ceil(n / per_task))
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inside = Window.partitionBy(*keys, "__salt").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "__salt").agg(F.count("*").alias("__n")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__salt").alias("__of"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    same = F.col("__salt") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (
        dealt.withColumn("__at", F.row_number().over(inside) - 1).join(starts, same)
        .withColumn(out, (F.col("__at") + F.col("__before")).cast("long"))
        .drop("__at", "__before", "__salt", "__of", *[f"__{k}" for k in keys])
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): ``node``, ``root`` (its smallest node).

    Alternates two steps until nothing moves: every node's larger neighbours are hung below
    its smallest one, then its smaller ones.  Each is an aggregation with map-side minimum
    and an equi-join, so a hub with very many links is never gathered in one place.
    """
    def hang(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e  # a > b
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if larger:
            moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = kept(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    now = state(edges)
    while True:
        edges = kept(hang(hang(edges, True), False))
        now, was = state(edges), now
        if now == was:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
