"""Readers, writers, the stream, and the queries against their SQL."""

from __future__ import annotations

import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenframe.plans import catalogue
from lumenframe.sources import files
from lumenframe.streaming import activity

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_json_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"video_id": "a", "n": 1}\n{"video_id": "b", "n": 2}\n{"video_id": "a", "n": 3}\nbroken\n')
    got = files.keyed_json_lines(spark, str(tmp_path / "p.jsonl"), "video_id string, n long", "video_id").filter("video_id IS NOT NULL").collect()
    assert {r["video_id"]: r["n"] for r in got} == {"a": 3, "b": 2}
    rows = files.json_lines(spark, str(tmp_path / "p.jsonl"), "video_id string, n long").collect()
    assert [r["_corrupt_record"] for r in rows if r["_corrupt_record"]] == ["broken"]


def test_whitelist(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\n a \n\nb\na\n")
    assert {r[0] for r in files.whitelist(spark, str(tmp_path / "w.txt")).collect()} == {"a", "b"}
    assert files.whitelist(spark, str(tmp_path / "none.txt")).count() == 0


def test_path_columns(spark):
    df = spark.createDataFrame([("file:/x/chan/vid-1.jpg",), ("/c/v",)], "path string")
    assert [(r["channel"], r["video_id"]) for r in files.path_columns(df).collect()] == [("chan", "vid-1"), ("c", "v")]


def test_workbook(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="roi" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c></row></sheetData></worksheet>')
    got = files.sheet_cells(spark, str(tmp_path / "b.xlsx"), "roi").select("row", "column", "value").collect()
    assert {tuple(r) for r in got} == {(1, "A", "id"), (1, "B", "2.5")}


def test_images_and_charset(spark, tmp_path):
    (tmp_path / "chan").mkdir()
    (tmp_path / "chan" / "bad.png").write_bytes(b"not an image")
    assert files.image_files(spark, str(tmp_path / "chan")).select("channel", "video_id", "image.width").first()["video_id"] == "bad"
    (tmp_path / "c.txt").write_text("a\nb\n")
    assert files.charset(spark, str(tmp_path / "c.txt")) == "ab "


def test_reports(spark, tmp_path):
    df = spark.range(3)
    files.write_sheets({"one": df}, str(tmp_path / "book"))
    files.append_results(df, str(tmp_path / "grid"))
    files.append_results(df, str(tmp_path / "grid"))
    files.write_json_report(df.limit(1), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "book/one")).count() == 3 and spark.read.json(str(tmp_path / "grid")).count() == 6
    assert '"id" : 0' in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report")).collect())


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = activity.windowed_activity(stream).writeStream.format("memory").queryName("act").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM act").first()[0] == events.count()
    assert activity.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows
    if name not in catalogue.ORACLE_SQL:
        return
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
