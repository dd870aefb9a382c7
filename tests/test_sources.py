import json

import pytest
from pyspark.sql import functions as F

from pairlens.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_blank_missing_and_strict(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"id": 1, "x": "a"}\n\n{"id": 2, "x": null}\n')
    assert readers.jsonl(spark, p, "id int, x string").count() == 2
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "id int", missing_ok=True).count() == 0
    bad = put(tmp_path / "bad.jsonl", '{"id": 1}\n{"id": \n')
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, bad, "id int").collect()


def test_json_array_or_lines(spark, tmp_path):
    a = put(tmp_path / "a.json", '[\n {"id": 1},\n {"id": 2}\n]')
    b = put(tmp_path / "b.json", '{"id": 3}\n{"id": 4}\n')
    assert [r.id for r in readers.json_or_jsonl(spark, a, "id int").orderBy("id").collect()] == [1, 2]
    assert [r.id for r in readers.json_or_jsonl(spark, b, "id int").orderBy("id").collect()] == [3, 4]
    with pytest.raises(ValueError):
        readers.json_or_jsonl(spark, put(tmp_path / "c.json", "\n"))


def test_csv_parquet_and_ids(spark, tmp_path):
    p = put(tmp_path / "r.csv", 'id,comment\n1,"a, ""b"""\n2,\n')
    assert [tuple(r) for r in readers.csv(spark, p, "id int, comment string").collect()] == [(1, 'a, "b"'), (2, None)]
    spark.range(3).withColumnRenamed("id", "pixel_values").write.parquet(str(tmp_path / "p"))
    assert readers.parquet(spark, str(tmp_path / "p"), {"image": ["image", "pixel_values"]}).columns == ["image"]
    with pytest.raises(ValueError):
        readers.parquet(spark, str(tmp_path / "p"), {"mask": ["mask"]})
    ids = readers.id_list(spark, put(tmp_path / "ids.txt", " 1\n1\n\n2 \n"))
    assert sorted(r.id for r in ids.collect()) == ["1", "2"]


def test_annotation_formats(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 4}], "categories": [{"id": 7, "name": "cat"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 7, "area": 2.5, "bbox": [0, 0, 1, 2.5]}]}
    row = readers.coco(spark, put(tmp_path / "coco.json", json.dumps(coco))).collect()[0]
    assert (row.label, row.area, row.file_name) == ("cat", 2.5, "a.jpg")
    y = readers.yolo(spark, put(tmp_path / "y.txt", "0 .5 .5 .2 .4\nbad line\n1 x 0 0 0\n2 0 0 1 1 9\n")).orderBy("class_id").collect()
    assert [(r.class_id, round(r.area, 6)) for r in y] == [(0, 0.08), (2, 1.0)]
    xml = "<annotation><filename>v.jpg</filename><size><width>9</width><height>8</height></size><object><name>dog</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>4</xmax><ymax>3</ymax></bndbox></object></annotation>"
    v = readers.voc(spark, put(tmp_path / "v.xml", xml)).collect()
    assert [(r.name, r.area, r.width) for r in v] == [("dog", 6.0, 9)]


def test_shards_harvest_checksums_variants(spark, tmp_path):
    put(tmp_path / "s/b.jsonl", '{"id": 2}\n')
    put(tmp_path / "s/a.jsonl", '{"id": 1}\n')
    got = readers.shards(spark, str(tmp_path / "s/*.jsonl"), "id int").orderBy("shard").collect()
    assert [(r.id, r.shard) for r in got] == [(1, 0), (2, 1)]
    put(tmp_path / "h/x/n.json", '{"a": [{"sample_id": "coco-000000000001", "b": "coco-000000000002"}, "coco-000000000001", "coco-1"]}')
    assert [(r.id, r.n) for r in readers.harvest_ids(spark, str(tmp_path / "h")).collect()] == [("coco-000000000001", 2)]
    c = lambda k: f"coco-{k:012d}"
    deep = {"sample_id": c(1), "eligible_ids": [c(2), c(2), 5], "deep": {"a": [{"sample_id": c(3), "sample": c(9)}, [c(4), "coco-1"], c(5)]}, "note": c(6), "sample_ids": c(7), "other_ids": {"z": [c(8)]}}
    put(tmp_path / "deep/x/a.json", json.dumps(deep, indent=1))
    put(tmp_path / "deep/b.jsonl", json.dumps({"sample_id": c(1)}) + "\n\n" + json.dumps([c(1), {"b": [], "c": None}]) + "\n")
    got = {(r.file.rsplit("/", 1)[1], int(r.id[5:]), r.n) for r in readers.harvest_ids(spark, str(tmp_path / "deep")).collect()}
    assert got == {("a.json", 1, 1), ("a.json", 2, 2), ("a.json", 3, 1), ("a.json", 4, 1), ("a.json", 5, 1), ("a.json", 8, 1), ("b.jsonl", 1, 2)}
    put(tmp_path / "deep/c.json", '{"a": ')
    with pytest.raises(Exception, match="no JSON in .*c.json"):
        readers.harvest_ids(spark, str(tmp_path / "deep")).collect()
    c = readers.checksums(spark, str(tmp_path / "s/a.jsonl")).collect()[0]
    assert c.bytes == 10 and len(c.sha256) == 64
    p = put(tmp_path / "v.json", '{"item": "i", "variants": [{"k": 1}, {"k": 2}]}')
    assert readers.variants(spark, p, "item string, variants array<struct<k:int>>").count() == 2
    with pytest.raises(ValueError):
        readers.load(spark, "jsonl", str(tmp_path / "s/a.jsonl"), n=5, schema="id int")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 0.5), (1, "a", None)], "id int, x string, r double")
    writers.once(df, str(tmp_path / "o"))
    with pytest.raises(Exception):  # noqa: B017
        writers.once(df, str(tmp_path / "o"))
    writers.ordered_lines(df, str(tmp_path / "l"), ["id"])
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "l")).collect()]
    assert sorted(lines, key=lambda r: r["id"]) == [{"id": 1, "r": None, "x": "a"}, {"id": 2, "r": 0.5, "x": "b"}]
    writers.append(df, str(tmp_path / "j"))
    writers.append(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert writers.latex_table(df, "id", "x", "r", ["a", "b"]) == "id & a & b \\\\\n1 & -- & -- \\\\\n2 & -- & 50.0 \\\\"
    assert writers.digest({"b": 1, "a": [1]}) == writers.digest({"a": [1], "b": 1})
    note = writers.provenance(df, str(tmp_path / "p"), {}, {"seed": 1})
    assert note["rows"] == 2 and writers.complete(spark, str(tmp_path / "p"), 2, {"seed": 1}) == []
    assert writers.complete(spark, str(tmp_path / "p"), 3, {"seed": 2}) == ["rows", "config"]
    assert writers.complete(spark, str(tmp_path / "q"), 1, {}) == ["no provenance"]
    assert writers.drifted({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 0}) == ["b", "c"]
    bad = writers.leaks(df.withColumn("path", F.lit("/home/me/x")), ["id"], ["/home/"]).collect()
    assert {(r["column"], r.reason) for r in bad} == {("id", "field"), ("path", "text")}
    assert writers.public_rows(df.withColumn("truth", F.lit("m")).withColumn("model", F.lit("host"))).columns == ["truth"]
    assert note["status"] == "complete" and len(note["output"]) == 64
    again = writers.provenance(df, str(tmp_path / "p2"), {"p": str(tmp_path / "l")}, {"seed": 1})
    assert set(again["inputs"]) == {"p"} and len(again["inputs"]["p"]) == 64
    writers.one_json(spark, str(tmp_path / "one.json"), {"a": 1})
    writers.one_json(spark, str(tmp_path / "one.json"), {"a": "é"})
    assert json.loads((tmp_path / "one.json").read_text("utf-8")) == {"a": "é"}
