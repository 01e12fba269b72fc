"""Small Spark helpers of this subpackage: written tables, checked broadcasts, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import pickle
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondus.session import checkpoint_dir, cut_lineage

#: Rows of at most two numbers that one broadcast may hold (about 32 MB); beyond, joins shuffle.
BROADCAST_ROWS = 2_000_000

_FOLDERS: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder; deleted at exit."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here, columns
    can be pruned, and no lost executor takes it along."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pondus_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._pondus_path)


def shared(spark: SparkSession, value) -> Callable[[], object]:
    """A function that gives tasks the broadcast ``value``, which the caller has bounded.
    It is packed by cloudpickle, so that classes of this package need no copy of it there."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def release() -> None:
    """Gives free memory back to the system.  Python workers outlive their tasks; without this
    they keep what a task needed at most while later stages run in the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(fn: Callable) -> Callable:
    """A generator over a task's batches that ends with ``release``."""
    @functools.wraps(fn)
    def run(*args, **options):
        try:
            yield from fn(*args, **options)
        finally:
            release()
    return run


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, else as it is.
    Only for narrow tables that are cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer until no column of ``df`` is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Large-star and small-star rounds (Kiveris and others, 2014): each round is two
    aggregations with map-side combine and joins on a node, so a node with very many
    edges is pre-aggregated or split by the skew join.  A round's edges are checkpointed.
    """
    e = cut_lineage(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
                    .filter("u > v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        e = cut_lineage(small)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
