"""Readers, archives, code books, detection and sinks on hand-made files."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from pondus.operators import schema as S
from pondus.sources import archives, readers, sinks
from pondus.sources.dimensions import fingerprint_table


def write(path, text, enc="utf-8"):
    with open(path, "wb") as fh:
        fh.write(text.encode(enc))
    return path


def test_separator_sniffing_and_names(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "ind.txt"), " codusu;Nro_hogar;ch04;ch06\nA;1;2;30\nB;1;1;45\n")
    df = readers.read_any(spark, p)
    assert df.columns == ["CODUSU", "NRO_HOGAR", "CH04", "CH06"]
    assert df.count() == 2
    assert readers.sniff_separator("a|b|c") == "|"
    assert readers.sniff_separator("a b") is None


def test_latin1_guess(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "hog.csv"), "CODUSU,REGION,NOMBRE\nA,1,Córdoba\n", enc="latin-1")
    assert readers.guess_encoding(spark, p) == "ISO-8859-1"
    df = readers.read_delimited(spark, p)
    assert df.first()["NOMBRE"] == "Córdoba"


def test_bad_lines_dropped(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "bad.csv"), "A,B,C\n1,2,3\n4,5\n6,7,8\n")
    assert readers.read_delimited(spark, p, bad_lines="drop").count() >= 2


def test_archive_members_largest_and_named(spark, tmpdir_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("usu_hogar_T417.txt", "CODUSU;NRO_HOGAR;ITF\nA;1;100\n")
        zf.writestr("usu_individual_T417.txt",
                    "CODUSU;NRO_HOGAR;COMPONENTE;CH06\n" + "".join(f"A;1;{i};3{i}\n" for i in range(5)))
        zf.writestr("leeme.pdf", "x")
    zdir = os.path.join(tmpdir_path, "zips")
    os.makedirs(zdir)
    with open(os.path.join(zdir, "w1.zip"), "wb") as fh:
        fh.write(buf.getvalue())
    biggest = archives.read_archive_table(spark, zdir)
    assert "COMPONENTE" in biggest.columns and biggest.count() == 5
    hog = archives.read_archive_table(spark, zdir, name_contains="hog")
    assert hog.columns == ["archive", "CODUSU", "NRO_HOGAR", "ITF"]


def test_archive_latin1_member(spark, tmpdir_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("ind.txt", "CODUSU;NOMBRE;X\nA;Córdoba;1\n".encode("latin-1"))
    zdir = os.path.join(tmpdir_path, "z2")
    os.makedirs(zdir)
    with open(os.path.join(zdir, "a.zip"), "wb") as fh:
        fh.write(buf.getvalue())
    assert archives.read_archive_table(spark, zdir).first()["NOMBRE"] == "Córdoba"


def test_code_book_dimensions(spark, tmpdir_path):
    book = {"_meta": {"fuente": "x"}, "claves_unicas": {"hogares": ["CODUSU"]},
            "sociodemograficas": {"CH04": {"desc": "Sexo", "tipo": "categorica",
                                           "etiquetas": {"1": "Varón", "2": "Mujer"}},
                                  "CH06": {"desc": "Edad", "tipo": "int"}}}
    p = write(os.path.join(tmpdir_path, "book.json"), json.dumps(book, ensure_ascii=False))
    var_dim, labels = readers.code_book(spark, p)
    assert {r["variable"]: r["desc"] for r in var_dim.collect()} == {"CH04": "Sexo", "CH06": "Edad"}
    assert sorted((r["code"], r["label"]) for r in labels.collect()) == [("1", "Varón"), ("2", "Mujer")]
    from pondus.plans.clean import apply_labels
    df = spark.createDataFrame([("01",), ("2",), ("9",)], "CH04 string")
    assert [r[0] for r in apply_labels(df, labels).select("CH04_LABEL").collect()] == ["Varón", "Mujer", None]


def test_area_and_coordinate_books(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "a.json"), json.dumps({"aglomerados": {"2": "X", "3": "Y"}}))
    assert readers.area_book(spark, p).count() == 2
    q = write(os.path.join(tmpdir_path, "c.json"),
              json.dumps({"coordenadas": {"2": {"lat": -34.9, "lon": -57.9, "nombre": "X"}}}))
    r = readers.coordinates_book(spark, q).first()
    assert (r["code"], r["lat"]) == (2, -34.9)


def test_file_type_detection(spark):
    cols = [("p.txt", c) for c in ["CODUSU", "NRO_HOGAR", "COMPONENTE", "CH04", "CH06", "ESTADO"]]
    cols += [("h.txt", c) for c in ["CODUSU", "NRO_HOGAR", "IV1", "IV2", "ITF"]]
    cols += [("t.txt", c) for c in ["CODUSU", "NRO_HOGAR", "COMPONENTE", "IP_III_04"]]
    cols += [("x.txt", c) for c in ["FOO", "BAR"]]
    df = spark.createDataFrame(cols, "file string, column string")
    got = {r["file"]: r["tipo"] for r in S.detect_file_types(df, fingerprint_table(spark)).collect()}
    assert got == {"p.txt": "individuo", "h.txt": "hogar", "t.txt": "tic_individual", "x.txt": "desconocido"}


def test_year_range_and_listing(spark, tmpdir_path):
    assert readers.year_range("2017-2019") == [2017, 2018, 2019]
    assert readers.year_range("2019, 2017") == [2017, 2019]
    out = os.path.join(tmpdir_path, "panel")
    df = spark.range(10).withColumn("anio", (F.col("id") % 2 + 2020).cast("int"))
    sinks.write_parquet(df, out, partition_by=["anio"])
    lst = readers.dataset_listing(spark, out)
    assert lst.agg(F.sum("filas")).first()[0] == 10


def test_read_through_cache(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "cache")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    assert readers.cached_table(spark, path, build).count() == 3
    assert readers.cached_table(spark, path, build).count() == 3
    assert len(calls) == 1


def test_sinks_shape(spark):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    assert dict(sinks.to_atomic(df).dtypes)["b"] == "string"
    doc = sinks.with_meta(spark.createDataFrame([(1.5,)], "x double"), {"run": "r1"}).first()[0]
    assert json.loads(doc) == {"meta": {"run": "r1"}, "x": 1.5}
    assert sinks.readable_headers(df, {"a": "Edad"}).columns == ["Edad (a)", "b"]
