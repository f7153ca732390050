from __future__ import annotations

from datetime import date, datetime

import pytest

from costurero.schemas import TABLES
from costurero.sources.derived import ONE_PASS, TEXTS, catalog_tables, inputs, star_tables
from costurero.sources.registry import Tables, load
from costurero.sources.sinks import csv_lines, from_csv_lines, read_csv, write_csv
from tests.conftest import STAR_FOLDER


def test_a_table_comes_in_its_contract_from_any_source(spark, tmp_path):
    df = spark.createDataFrame([(1, "ROJO", "x"), (2, "AZUL", "y")], "IDMAECOMBO int, NommaeCombo string, extra string")
    df.write.parquet(str(tmp_path / "p"))
    df.drop("extra").write.option("header", True).csv(str(tmp_path / "c"))
    df.write.saveAsTable("combo_tabla")
    df.createOrReplaceTempView("combo_vista")
    confs = [
        {"format": "parquet", "path": str(tmp_path / "p")},
        {"format": "csv", "path": str(tmp_path / "c"), "options": {"header": True}},
        {"table": "spark_catalog.default.combo_tabla"},
        {"table": "combo_vista"},
        {"frame": df},
    ]
    for conf in confs:
        got = load(spark, "maeCombo", {"maeCombo": conf})
        assert got.schema == TABLES["maeCombo"], conf
        assert sorted(tuple(r) for r in got.collect()) == [(1, "ROJO"), (2, "AZUL")]
    spark.sql("DROP TABLE combo_tabla")


def test_unknown_tables_and_missing_columns_are_refused(spark):
    with pytest.raises(KeyError):
        load(spark, "otra", {})
    with pytest.raises(Exception, match="NommaeCombo"):
        load(spark, "maeCombo", {"maeCombo": {"frame": spark.range(1).toDF("IdmaeCombo")}})


@pytest.mark.parametrize("name", ["docOrdenVenta", "maeItemInventario"])
def test_a_database_table_must_be_sliced(spark, name):
    with pytest.raises(ValueError, match="partitionColumn"):
        load(spark, name, {name: {"format": "jdbc", "options": {"dbtable": name}}})


def test_tables_are_resolved_once(spark):
    asked = []

    def resolve(name):
        asked.append(name)
        return spark.range(10).toDF("k")

    tables = Tables(resolve)
    assert tables["maeCombo"] is tables["maeCombo"]
    assert asked == ["maeCombo"]


def test_every_derived_table_keeps_its_contract(spark):
    tables = star_tables(spark, STAR_FOLDER)
    for name, schema in TABLES.items():
        assert [(f.name, f.dataType) for f in tables[name].schema] == [(f.name, f.dataType) for f in schema]


@pytest.mark.parametrize("name", list(ONE_PASS))
def test_one_pass_gives_the_rows_of_its_text(spark, name):
    star = {t: spark.read.parquet(f"{STAR_FOLDER}/{t}.parquet") for t in ("orders", "lineitem")}

    def of(text):
        return spark.sql(text, **{i: star[i] if i in star else of(TEXTS[i]) for i in inputs(text)})

    ours, theirs = of(ONE_PASS[name]), of(TEXTS[name])
    assert ours.dtypes == theirs.dtypes
    assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty() and ours.count()


def test_csv_has_headers_no_index_and_empty_nulls(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a, "b"', None, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5)), (None, None, 0.1, None, None)],
        "n int, t string, x double, d date, m timestamp_ntz",
    ).coalesce(1)
    path = str(tmp_path / "out")
    write_csv(df, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["n,t,x,d,m", '1,"a, ""b""",,2024-01-02,2024-01-02 03:04:05', ",,0.1,,"]
    assert read_csv(spark, path, df.schema).collect() == df.collect()
    texts = csv_lines(df)
    assert [r.LINEA for r in texts.collect()] == lines[1:]
    assert from_csv_lines(texts, df.schema).collect() == df.collect()


def test_tables_by_three_part_names(spark):
    tables = catalog_tables(spark, STAR_FOLDER)
    flat = star_tables(spark, STAR_FOLDER)
    for name in ("docOrdenVenta", "maeTalla", "docNotaInventario", "docOrdenProduccionCalidad"):
        assert tables[name].schema == flat[name].schema
        assert tables[name].exceptAll(flat[name]).isEmpty() and flat[name].exceptAll(tables[name]).isEmpty()
    catalog_tables(spark, STAR_FOLDER)  # again: what is there stays
