"""Incremental panel and KPIs over arriving survey waves (A11/B2/G11 as a stream).

The reference builds its multi-wave panel in batch; here new wave files landing in a
folder are picked up by a file source.  Every KPI of the vector is a ratio of sums, so
the stream keeps only the **sums** as state (one row per area and year) and the ratios
are taken on read — exact, and the state does not grow with the number of persons.
The panel itself is appended by the file sink, whose checkpointed offsets and commit log
give exactly-once files across restarts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.expr import num

# (output name, value column, condition or None, scale)
RATIO_KPIS = [
    ("pct_secundario_completo", "secundario_completo", None, 100.0),
    ("pct_superior", "superior", None, 100.0),
    ("pct_ocupado", "ocupado", None, 100.0),
    ("score_movilidad_proxy", "score_movilidad_proxy", None, 1.0),
    ("vulnerabilidad_social", "vulnerabilidad_social", None, 1.0),
    ("pct_informal_ocupados", "informal_proxy", "ocupado = 1", 100.0),
    ("idx_exclusion_digital", "idx_exclusion_digital", None, 1.0),
]


def read_waves(spark: SparkSession, folder: str, schema: StructType,
               max_files_per_trigger: int = 8) -> DataFrame:
    """File-source stream over a landing folder of wave Parquet files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def kpi_sums(frames: DataFrame, by=("AGLOMERADO", "anio"), weight: str = "PONDERA") -> DataFrame:
    """Streaming aggregation of the sums behind each KPI (Σw·x and Σw over complete rows)."""
    w = F.col(weight)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_individuos"), F.sum(w).alias("peso_expansion")]
    for name, c, cond, _ in RATIO_KPIS:
        ok = F.col(c).isNotNull() & w.isNotNull()
        if cond:
            ok = ok & F.coalesce(F.expr(cond), F.lit(False))
        aggs += [F.sum(F.when(ok, F.col(c) * w)).alias(f"_num_{name}"),
                 F.sum(F.when(ok, w)).alias(f"_den_{name}")]
    return frames.withColumn("AGLOMERADO", num("AGLOMERADO").cast("int")).groupBy(*by).agg(*aggs)


def finalize(sums: DataFrame) -> DataFrame:
    """Sums → KPI ratios (batch read of the stream's output table)."""
    cols = [c for c in sums.columns if not c.startswith("_")]
    ratios = [(F.lit(scale) * F.col(f"_num_{name}") / F.col(f"_den_{name}")).alias(name)
              for name, _, _, scale in RATIO_KPIS]
    return sums.select(*cols, *ratios)


def start_kpi_stream(frames: DataFrame, checkpoint: str, query_name: str = "kpi_sums",
                     sink: str = "memory", path: str | None = None, trigger_once: bool = False):
    """Run the KPI-sum aggregation in ``complete`` mode (state = one row per group)."""
    w = kpi_sums(frames).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").queryName(query_name).start()
    return w.foreachBatch(lambda df, _id: df.write.mode("overwrite").parquet(path)).start()


def start_panel_append(frames: DataFrame, panel_path: str, checkpoint: str, trigger_once: bool = False):
    """Append each micro-batch of frames to the year-partitioned panel (B2)."""
    w = (frames.writeStream.outputMode("append").format("parquet").option("path", panel_path)
         .option("checkpointLocation", checkpoint).partitionBy("anio"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
