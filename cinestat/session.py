"""Session defaults and lineage control."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def get_spark(app: str = "cinestat", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; where none is set, one beside the warehouse tables.

    The warehouse is the other place that driver and executors share by contract; a folder
    of one machine's own disk would be lost to all other executors.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage, so that a lost executor costs a re-read only."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, pruned by column.

    ``options`` are the writer's.  Files stay as long as the folder's owner keeps them: a later read must find them.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)  # read once or twice: small beats fast
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per session.

    Python workers import functions by module name, and neither the working folder nor
    ``PYTHONPATH`` of the driver reaches them on a cluster.
    """
    sc = spark.sparkContext
    if getattr(sc, "_cinestat_shipped", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.writestr(str(path.relative_to(_PACKAGE.parent)), path.read_bytes())
    target = Path(sc._temp_dir) / "cinestat.zip"  # Spark's own driver folder; the file server hands it out
    target.write_bytes(held.getvalue())
    sc.addPyFile(str(target))
    sc._cinestat_shipped = True


def settle(df: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Cache and fill now, so that the next step reads a known partitioning.

    Lost blocks are rebuilt from lineage; pair it with :func:`cut_lineage` every few
    rounds of a loop.  ``previous`` is released afterwards.
    """
    df = df.persist()
    df.count()
    if previous is not None:
        previous.unpersist()
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Place narrow rows that are about to be expanded many-fold.

    An explicit partition count keeps adaptive execution from merging the partitions:
    it sizes them by the bytes before the expansion.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
