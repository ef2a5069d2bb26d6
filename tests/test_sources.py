import datetime
import json

from sleuthgrid.sources import files
from sleuthgrid.streaming import events as ev


def test_csv_rows_are_numbered(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("name;age\n" + "".join(f"n{i};{i}\n" for i in range(50)) + "short\n")
    rows = files.read_csv(spark, str(p)).orderBy("_row_number").collect()
    assert [r._row_number for r in rows] == list(range(1, 52)) and rows[7].name == "n7" and rows[-1].age is None
    assert files.detect_format("x.GeoJSON") == "geojson" and files.detect_format("b.kml") == "xml" and files.detect_format("none") is None


def test_json_xml_geojson(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbad\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_json(spark, str(tmp_path / "a.jsonl"), lines=True).collect()) == [1, 2]
    (tmp_path / "b.json").write_text(json.dumps({"data": {"rows": [{"x": "q"}, {"x": "r"}]}}))
    assert files.read_json(spark, str(tmp_path / "b.json"), records_path="data.rows").count() == 2
    (tmp_path / "c.xml").write_text('<r><i k="1"><t>a</t></i><i k="2"><t>b</t></i></r>')
    assert {r["@k"] for r in files.read_xml(spark, str(tmp_path / "c.xml"), "i").collect()} == {1, 2}
    fc = {"type": "FeatureCollection", "features": [{"properties": {"n": "a"}, "geometry": {"type": "Point", "coordinates": [10.5, -3]}}, {"properties": {"n": "b"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 2], [0, 2]]]}}, {"properties": {"n": "c"}, "geometry": None}]}
    (tmp_path / "d.geojson").write_text(json.dumps(fc))
    got = {r.properties["n"]: r for r in files.read_geojson(spark, str(tmp_path / "d.geojson")).collect()}
    assert (got["a"].latitude, got["a"].longitude, got["a"].vertex_count) == (-3, 10.5, 1)
    assert (got["b"].latitude, got["b"].longitude, got["b"].bbox.max_lng) == (1, 2, 4) and got["c"].latitude is None


def test_stream_counts(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, "view" if i % 2 else "click", at + datetime.timedelta(minutes=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "user long, kind string, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ev.windowed_counts(stream, "at", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = ev.windowed_counts(df, "at", "kind").collect()
    assert sorted(spark.table("counts").collect()) == sorted(want) and sum(r.n for r in want) == 60
