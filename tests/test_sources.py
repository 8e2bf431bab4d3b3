import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import barcodes, text
from quern.operators import relational as ops
from quern.sources import files, sinks
from quern.sources.shared import shared_path
from quern.streaming.events import windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"code": "1", "n": 2}\nnot json en:us\n\n{"code": "3", "tag": "en:us"}\n')
    rows = files.read_json_lines(spark, str(tmp_path), "code string, n long").collect()
    assert sorted((r.code or "", r.bad) for r in rows) == [("", True), ("1", False), ("3", False)]
    assert [r.line for r in files.read_json_lines(spark, str(tmp_path), "code string", "en:us").collect() if r.bad] == ["not json en:us"]


def test_csv_with_a_preamble(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿A list\nof things\nDate,Name ,Kind\n2020,"x, ""y""\nz",k\n2021,w\n')
    (tmp_path / "b.csv").write_text("nothing here\n")
    rows = files.read_csv_with_header_below(spark, str(tmp_path), ["name", "kind"]).collect()
    assert sorted(map(tuple, rows), key=str) == [("w", None), ('x, "y"\nz', "k")]
    with pytest.raises(ValueError, match="columns missing: other"):
        files.require_columns(spark.range(1), ["id", "other"])


def test_patterns_of_a_header_find_cells_of_their_own():
    assert files.bind({"name": "name", "key": "key"}, ["Key of name", "Name"]) == {"name": 1, "key": 0}
    assert files.bind({"name": "name", "key": "key"}, ["Key of name", "Note"]) is None
    assert files.bind({}, []) == {}


def test_shared_path_is_below_the_shared_folder(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_path(spark, "x").startswith(base) and shared_path(spark, "x") != shared_path(spark, "x")


def test_named_parts_of_malformed_texts(spark):
    from quern.functions import rules

    held = [one(spark, rules.named_parts(F.lit(t).cast("string"))) for t in (None, "", "{}", '[{"name": "a"}, {"name": null}, []]')]
    assert [[tuple(r) for r in h] for h in held] == [[], [], [], [("a", None)]]


def test_zip_members(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("d/a.json", "{}")
        z.writestr("b.txt", "x")
    (tmp_path / "z.zip").write_bytes(held.getvalue())
    assert [(r.member, bytes(r.content)) for r in files.read_zip_members(spark, str(tmp_path), ".json").collect()] == [("d/a.json", b"{}")]


def test_export_log_and_undo(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    target = spark.createDataFrame([(1, "x"), (2, "b"), (3, "y")], "k long, v string")
    plan = ops.changes(table, target, "k", "v")
    sinks.log_changes(plan, f"{tmp_path}/log", "run1")
    assert {tuple(r)[:3] for r in plan.collect()} == {(1, "a", "x"), (3, None, "y")}
    touched = spark.createDataFrame([(1, "x"), (2, "b"), (3, "later")], "k long, v string")
    assert {(r.k, r.v) for r in sinks.undo(spark, touched, f"{tmp_path}/log", "run1", "k", "v").collect()} == {(1, "a"), (2, "b"), (3, "later")}
    sinks.export_csv(table.withColumn("tags", F.array(F.lit("p"), F.lit('q"'))), f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert {(r.k, r.tags) for r in back.collect()} == {("1", 'p|q"'), ("2", 'p|q"'), ("3", 'p|q"')}


@pytest.mark.parametrize(
    ("raw", "code", "reason"),
    [("4006381333931", "4006381333931", None), ("0 36000 29145 2", "0036000291452", None), ("96385074", "96385074", None), ("4006381333930", None, "bad_check_digit"), ("", None, "empty"), (None, None, "empty"), ("12345", None, "bad_length"), ("2000000000008", None, "restricted"), ("04006381333931", "4006381333931", None)],
)
def test_barcodes(spark, raw, code, reason):
    found = one(spark, barcodes.normalize_barcode(F.lit(raw).cast("string")))
    assert (found.code, found.reason, found.ok) == (code, reason, reason is None)


def test_expanded_and_query_forms(spark):
    assert one(spark, barcodes.expand_upc_e(F.lit("04252614"))) == "042100005264"
    assert one(spark, barcodes.query_forms(F.lit("0036000291452"))) == ["0036000291452", "36000291452", "036000291452", "00036000291452"]


def test_text_functions(spark):
    assert one(spark, text.brand_key(F.lit("The Acme (US) Foods, Inc. Co"))) == "ACMEFOODS"
    assert one(spark, text.brand_key(F.lit("Co"))) == "CO"
    assert [one(spark, text.singular(F.lit(w))) for w in ("berries", "nuts", "glass", "pie")] == ["berry", "nut", "glass", "pie"]
    assert one(spark, text.contains_phrase(F.lit("Made by Acme-Foods."), F.lit("acme foods"))) and not one(spark, text.contains_phrase(F.lit("acmefoods"), F.lit("acme")))
    assert tuple(one(spark, text.title_parts(F.lit("Soup, tomato, 400 g")))) == ("Soup", "tomato, 400 g")
    assert tuple(one(spark, text.title_parts(F.lit("Soup")))) == ("Soup", None)


def test_merge_rules(spark):
    rows = "k long, pos int, organic boolean, trace boolean, note string"
    current = spark.createDataFrame([(1, 5, False, True, None), (2, 1, True, True, "kept")], rows)
    incoming = spark.createDataFrame([(1, 3, True, False, "new"), (2, 4, False, True, "late"), (3, 9, False, False, None)], rows)
    merged = ops.merge_rows(current, incoming, ["k"], {"pos": "min", "organic": "or", "trace": "and", "note": "first"})
    assert {tuple(r) for r in merged.collect()} == {(1, 3, True, False, "new"), (2, 1, True, True, "kept"), (3, 9, False, False, None)}


def test_stream_equals_batch(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    run = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 4))
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, windowed_counts(batch).collect()))


def test_columns_are_found_in_the_order_of_patterns(spark):
    assert files.find_column(["Name of nation", "Full Name", "id"], ["^(full )?name$", "name"]) == "Full Name"
    assert files.find_column(["Nation name", "b"], ["^name$", "name"]) == "Nation name"
    assert files.find_column(["a"], ["x"]) is None
    df = spark.createDataFrame([("1", "n")], "`odd.key` string, b string")
    assert [tuple(r) for r in files.with_columns_found(df, {"key": ["key"], "none": ["zzz"]}).collect()] == [("1", None)]
    records = [{"Brand name": " ", "brand": "A", "maker": "M"}, {"maker": "M"}, {}, None]
    rows = spark.createDataFrame(list(enumerate(records)), "k int, r map<string,string>").select("k", files.pick(F.col("r"), ["^brand", "maker"]).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in rows] == ["A", "M", None, None]


def test_header_in_one_file_of_several(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffPreamble\n\nNote, Key ,NAME\nx,1,\"a, \"\"b\"\"\nc\"\n,,\ny,2\nNote,Key,Name\n")
    (tmp_path / "b.csv").write_text("\ufeffname,key\nB,3\n")
    (tmp_path / "c.csv").write_text("no header here\n1,2\n")
    rows = files.read_csv_with_header_below(spark, str(tmp_path), ["key", "name"]).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("1", 'a, "b"\nc'), ("2", None), ("Key", "Name"), ("3", "B")], key=str)
