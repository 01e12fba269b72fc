"""Archive members (A6, A7) as a Spark job over many archives.

``binaryFile`` gives one row per archive (an archive is not splittable, so one task per
archive is the natural unit).  A task picks the archive's member from the directory
(largest, or name containing "hog"/"ind"), and decompresses only that one, streaming its
records out in bounded batches: each record is a map from the member's own header to its
values, so archives with other headers or another column order keep their meaning.
"""

from __future__ import annotations

import codecs
import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .readers import sniff_separator

DATA_SUFFIXES = (".txt", ".csv", ".dat")
BATCH_LINES = 50_000
RECORD_SCHEMA = "archive string, member string, size long, record_no long, fields map<string,string>, extra int"


def _encoding(zf: zipfile.ZipFile, info: zipfile.ZipInfo) -> str:
    """UTF-8 if the whole member decodes, else Latin-1 (A4); read in pieces."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        with zf.open(info) as fh:
            while piece := fh.read(1 << 20):
                decoder.decode(piece)
        decoder.decode(b"", True)
        return "utf-8-sig"
    except UnicodeDecodeError:
        return "latin-1"


def _choose(zf: zipfile.ZipFile, name_contains: str | None) -> list[zipfile.ZipInfo]:
    """The largest data member, ties by name; A7: the first by name that contains
    ``name_contains`` (case-insensitive)."""
    data = [i for i in zf.infolist() if not i.is_dir() and i.filename.lower().endswith(DATA_SUFFIXES)]
    if name_contains:
        data = sorted((i for i in data if name_contains.lower() in i.filename.lower()), key=lambda i: i.filename)
    else:
        data = sorted(data, key=lambda i: (-i.file_size, i.filename))
    return data[:1]


def _records(batches, name_contains: str | None, sep: str | None):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                for info in _choose(zf, name_contains):
                    with zf.open(info) as fh, io.TextIOWrapper(fh, _encoding(zf, info), newline="") as text:
                        first = text.readline().rstrip("\r\n")
                        own = sep or sniff_separator(first) or ","
                        names = [h.strip().upper() for h in next(csv.reader([first], delimiter=own), [])]
                        rows: list[dict] = []
                        for n, row in enumerate(csv.reader(text, delimiter=own), 1):
                            if not row:
                                continue
                            rows.append({"archive": path, "member": info.filename, "size": info.file_size, "record_no": n,
                                         "fields": {k: (row[i].strip() if i < len(row) else None) for i, k in enumerate(names)},
                                         "extra": len(row) - len(names)})
                            if len(rows) == BATCH_LINES:
                                yield pd.DataFrame(rows)
                                rows = []
                        if rows:
                            yield pd.DataFrame(rows)


def member_records(spark: SparkSession, path: str, name_contains: str | None = None, sep: str | None = None) -> DataFrame:
    """(archive, member, size, record_no, fields, extra): the records of the chosen member of
    every archive; ``extra`` is the number of fields beyond (or, below 0, missing from) the
    member's header."""
    bins = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return bins.select("path", "content").mapInPandas(lambda it: _records(it, name_contains, sep), RECORD_SCHEMA)


def records_to_table(records: DataFrame) -> DataFrame:
    """One column for each name in any header, in the order of the first header that has it
    (headers are few: one distinct row for each kind of file)."""
    headers = sorted((r[0] for r in records.select(F.map_keys("fields")).distinct().collect()), key=lambda h: (-len(h), h))
    names = list(dict.fromkeys(name for h in headers for name in h))
    return records.select("archive", *[F.col("fields").getItem(n).alias(n) for n in names])


def read_archive_table(spark: SparkSession, path: str, name_contains: str | None = None,
                       sep: str | None = None, **_) -> DataFrame:
    """A6/A7 end to end: archives → chosen member per archive → table by name.  Every record
    is kept; a short one has nulls, surplus fields of a long one are reported by
    :func:`member_records` (``extra``)."""
    return records_to_table(member_records(spark, path, name_contains, sep))
