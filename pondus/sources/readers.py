"""Readers (A1–A5, A8–A14).

Files are read by Spark's own sources; the only data-dependent choices (separator,
encoding) look at the *first lines* of a file through ``spark.read.text(...).limit(n)``,
a bounded read, never the whole file on the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.schema import normalize_names
from ..session import delete_folder

SEPARATORS = [";", ",", "\t", "|"]
TEXT_SUFFIXES = (".csv", ".txt", ".dat", ".tsv")
NOT_SUPPORTED = (".xlsx", ".xls", ".dbf", ".rds")


def head_lines(spark: SparkSession, path: str, n: int = 20, encoding: str | None = None) -> list[str]:
    """The first ``n`` lines of a text file (a bounded read)."""
    reader = spark.read.option("lineSep", "\n")
    if encoding:
        reader = reader.option("encoding", encoding)
    return [r[0] for r in reader.text(path).limit(n).collect()]


def guess_encoding(spark: SparkSession, path: str) -> str:
    """A4: UTF-8 when the whole file decodes cleanly, else ISO-8859-1 (Latin-1): one
    distributed pass that ends at the first line that is not valid UTF-8."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, not of the driver's disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def sniff_separator(header: str, candidates: Sequence[str] = SEPARATORS, min_cols: int = 3) -> str | None:
    """A2: the first separator that splits the header into at least ``min_cols`` fields."""
    for sep in candidates:
        if len(header.split(sep)) >= min_cols:
            return sep
    return None


def read_delimited(spark: SparkSession, path: str, *, sep: str | None = None,
                   encoding: str | None = None, bad_lines: str = "drop",
                   decimal_comma: bool = False, nrows: int | None = None,
                   schema: StructType | None = None) -> DataFrame:
    """A2–A5: delimited text with separator sniffing, encoding guess and tolerant parse.

    Malformed lines (too few or too many fields, or a value that isn't of its column's
    type) are dropped; with ``bad_lines="permissive"`` they stay, with their text in ``_corrupt``,
    and :func:`corrupt_lines` counts them.  ``schema`` skips the inference
    pass.  With ``decimal_comma`` every column is kept as text so
    :func:`pondus.functions.expr.num_comma` can parse "12,5"."""
    encoding = encoding or guess_encoding(spark, path)
    if sep is None:
        lines = head_lines(spark, path, 1, encoding)
        sep = sniff_separator(lines[0]) if lines else None
        sep = sep or ","
    r = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    if schema is None:
        schema = r.option("inferSchema", not decimal_comma).csv(path).schema
    tagged = StructType([*schema.fields, StructField("_corrupt", StringType())])
    # all fields of a line are parsed whatever columns a query reads, or its length went unnoticed
    df = r.schema(tagged).option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    if bad_lines == "drop":
        df = df.where(F.col("_corrupt").isNull() & _reads_data(df)).drop("_corrupt")
    df = normalize_names(df).withColumnRenamed("_CORRUPT", "_corrupt")
    return df.limit(nrows) if nrows else df


def corrupt_lines(df: DataFrame) -> DataFrame:
    """A3 report: lines and malformed lines of a permissive read."""
    return df.agg(F.count_if(_reads_data(df)).alias("lineas"), F.count("_corrupt").alias("malformadas"))


def _reads_data(df: DataFrame) -> Column:
    """Always true, but reads a data column: Spark refuses plans that read the tag alone."""
    return F.length(F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit(""))) >= 0


def read_any(spark: SparkSession, path: str, *, nrows: int | None = None, **kw) -> DataFrame:
    """A1: dispatch on the file suffix; names trimmed and upper-cased."""
    low = path.lower().rstrip("/")
    if low.endswith(NOT_SUPPORTED):
        raise NotImplementedError(f"{os.path.splitext(low)[1]}: convert to Parquet or CSV upstream")
    if low.endswith(".parquet") or _is_folder(spark, path):
        df = normalize_names(spark.read.parquet(path))
    elif low.endswith(".json"):
        df = normalize_names(spark.read.json(path))
    elif low.endswith(".zip"):
        from .archives import read_archive_table
        df = read_archive_table(spark, path, **kw)
    else:
        df = read_delimited(spark, path, **kw)
    return df.limit(nrows) if nrows else df  # A9


def read_parquet(spark: SparkSession, name_or_path: str, directory: str | None = None) -> DataFrame:
    """By path, or by data-set name inside ``directory``."""
    if directory and not name_or_path.endswith(".parquet") and "/" not in name_or_path:
        name_or_path = os.path.join(directory, f"{name_or_path}.parquet")
    return spark.read.parquet(name_or_path)


def panel(waves: Sequence[tuple[int, int, DataFrame]]) -> DataFrame:
    """Tag each (year, quarter, table) wave and union by name (outer union of
    columns).  With partitioned Parquet the same is ``read.option("mergeSchema", True)``."""
    out = None
    for year, quarter, df in waves:
        t = df.withColumns({"anio": F.lit(int(year)), "trimestre": F.lit(int(quarter))})
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Read-through cache — read the Parquet at ``path`` if a finished write left it, else
    build, write (partitioned) and read back.

    A write goes to a folder of its own beside ``path`` and is renamed once it is whole, so a
    reader never sees part of it.  Of concurrent builders the first to rename wins; the others
    read its table.  A folder without the success marker is what a failed write left: it is
    moved aside (``<path>.failed-…``) and built anew."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        staged = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
        w = build().write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(staged)
        if not _exists(spark, f"{path}/_SUCCESS") and _exists(spark, path):
            _rename(spark, path, f"{path.rstrip('/')}.failed-{uuid.uuid4().hex}")
        if _exists(spark, path) or not _rename(spark, staged, path) or _exists(spark, f"{path}/{os.path.basename(staged)}"):
            delete_folder(spark, staged)  # another builder was first
            delete_folder(spark, f"{path}/{os.path.basename(staged)}")  # a rename onto a folder moves into it
        if not _exists(spark, f"{path}/_SUCCESS"):
            raise OSError(f"{path}: no finished table was left")
    return spark.read.parquet(path)


def _on(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _on(spark, path)
    return fs.exists(p)


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    fs, p = _on(spark, source)
    return fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target))


def dataset_listing(spark: SparkSession, path: str) -> DataFrame:
    """Per file: path, size in MB, rows; plus the column count (driver metadata)."""
    df = spark.read.parquet(path)
    return (df.select("_metadata.file_path", "_metadata.file_size")
              .groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("filas"))
              .select(F.col("file_path").alias("archivo"),
                      (F.col("file_size") / (1024 * 1024)).alias("mb"), "filas",
                      F.lit(len(df.columns)).alias("columnas")))


def year_range(text: str) -> list[int]:
    """A14: "2017-2022" → [2017, …, 2022]; "2019" → [2019]; "2017,2019" → both."""
    out: list[int] = []
    for part in str(text).split(","):
        part = part.strip()
        if "-" in part:
            a, b = (int(x) for x in part.split("-", 1))
            out += list(range(min(a, b), max(a, b) + 1))
        elif part:
            out.append(int(part))
    return sorted(set(out))


def period_text(years: Sequence[int], quarter: int | None = None) -> str:
    ys = sorted(years)
    base = f"{ys[0]}" if len(ys) == 1 else f"{ys[0]}-{ys[-1]}"
    return f"{base} T{quarter}" if quarter else base


def code_book(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A10: a JSON code book {section: {VARIABLE: {desc, tipo, etiquetas: {code: label}}}}
    to two dimensions — ``variables(section, variable, desc, tipo)`` and
    ``labels(variable, code, label)`` — with Spark's JSON functions (maps of raw JSON
    text, exploded level by level)."""
    raw = spark.read.text(path, wholetext=True)
    sections = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("section", "body"))
    sections = sections.where(~F.col("section").startswith("_") &
                              ~F.col("section").isin("claves_unicas", "fingerprints"))
    variables = sections.select("section", F.explode(F.from_json("body", "map<string,string>"))
                                .alias("variable", "meta"))
    variables = variables.where(F.col("meta").startswith("{"))
    var_dim = variables.select("section", F.upper("variable").alias("variable"),
                               F.get_json_object("meta", "$.desc").alias("desc"),
                               F.get_json_object("meta", "$.tipo").alias("tipo"))
    labels = variables.select(F.upper("variable").alias("variable"),
                              F.explode(F.from_json(F.get_json_object("meta", "$.etiquetas"),
                                                    "map<string,string>")).alias("code", "label"))
    return var_dim, labels


def area_book(spark: SparkSession, path: str, key: str = "aglomerados") -> DataFrame:
    """A10: {"<key>": {"code": "name"}} → (code int, name)."""
    raw = spark.read.text(path, wholetext=True)
    body = F.get_json_object("value", f"$.{key}")
    return raw.select(F.explode(F.from_json(body, "map<string,string>")).alias("code", "name")) \
              .select(F.col("code").cast("int").alias("code"), "name")


def coordinates_book(spark: SparkSession, path: str, key: str = "coordenadas") -> DataFrame:
    """A10: {"<key>": {"code": {"lat", "lon", "nombre"}}} → (code, lat, lon, name)."""
    raw = spark.read.text(path, wholetext=True)
    body = F.get_json_object("value", f"$.{key}")
    m = F.from_json(body, "map<string,struct<lat:double,lon:double,nombre:string>>")
    return raw.select(F.explode(m).alias("code", "v")).select(
        F.col("code").cast("int").alias("code"), "v.lat", "v.lon", F.col("v.nombre").alias("name"))
