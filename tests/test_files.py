"""Sources, sinks and incremental upkeep on files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.fingerprints import feature_matrix, set_fingerprints
from kinfold.sources import readers, writers
from kinfold.streaming.incremental import current, upkeep


def test_scan_pushes_filter_and_columns(spark):
    df = readers.scan(spark, "/root/testdata/sf0.001/lineitem.parquet", F.col("l_quantity") > 49, ["l_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_list_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sid,name\nS1,one\n,none\n")
    (tmp_path / "b.csv").write_text("sid,extra\nS2,x\n")
    rows = readers.id_list_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "sid")
    assert sorted(r["sid"] for r in rows.collect()) == ["S1", "S2"]


def test_api_records_and_flattening(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"aeid": 1, "mc5Param": {"er": 0.5}, "gene": [{"symbol": "G"}]}) + "\n")
    schema = T.StructType.fromDDL("aeid int, mc5Param struct<er: double>, gene array<struct<symbol: string>>")
    rows = readers.api_records(spark, str(tmp_path / "r.json"), schema, {"aeid": "aeid", "modl_er": "mc5Param.er"})
    assert rows.first().asDict() == {"aeid": 1, "modl_er": 0.5}
    flat = readers.flattened(spark.read.schema(schema).json(str(tmp_path / "r.json")))
    assert flat.columns == ["aeid", "mc5Param.er", "gene"]


def test_neighbour_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "nn")
    rows = lambda fp, s: spark.createDataFrame([(fp, "no_filter", 1, 1, 2, s)], "fp_id string, sel_by string, id long, rank int, nn_id long, similarity double")
    writers.write_neighbors(rows("a", 0.1).unionByName(rows("b", 0.2)), path)
    writers.write_neighbors(rows("a", 0.9), path)
    assert {r["fp_id"]: r["similarity"] for r in spark.read.parquet(path).collect()} == {"a": 0.9, "b": 0.2}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    writers.export_tables({"t": (df, F.col("id") > 1)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "t")).collect()[0]["name"] == "y"
    writers.project_and_write(df, {"key": "id", "label": "name"}, str(tmp_path / "renamed"))
    assert spark.read.parquet(str(tmp_path / "renamed")).columns == ["key", "label"]
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_replace_everything(spark):
    base, new = spark.range(5), spark.range(3, 4)
    assert writers.replace_rows(base, new, everything=True).count() == 1
    assert writers.replace_rows(base, new).count() == 5


def test_matrix_refuses_wide_vocabularies(spark):
    with pytest.raises(ValueError):
        feature_matrix(spark.range(1).withColumn("bit", F.lit("x")), [str(i) for i in range(10_001)])


def test_incremental_upkeep(spark, tmp_path):
    source, out = tmp_path / "bits", tmp_path / "fp"
    write = lambda rows: spark.createDataFrame(rows, "id long, bit string").write.mode("append").parquet(str(source))
    read = lambda: spark.readStream.schema("id long, bit string").parquet(str(source))
    write([(1, "a"), (1, "b"), (2, "a")])
    upkeep(read(), str(out), str(tmp_path / "ck")).awaitTermination()
    write([(2, "c"), (3, "d")])
    upkeep(read(), str(out), str(tmp_path / "ck")).awaitTermination()
    rows = {r["id"]: r["ds"] for r in current(spark, str(out)).collect()}
    assert rows == {1: ["a", "b"], 2: ["a", "c"], 3: ["d"]}
    assert {r["id"]: r["ds"] for r in current(spark, str(out), 0).collect()} == {1: ["a", "b"], 2: ["a"]}


def test_batches_rewrite_only_their_buckets_and_old_versions_expire(spark, tmp_path):
    source, out = tmp_path / "bits", tmp_path / "fp"
    schema = "id long, bit string"
    batches = [[(i, f"b{i % 7}") for i in range(200)], [(5, "x"), (6, "y"), (None, "z")], [(5, "x"), (300, "n")]]
    files = lambda: {f.relative_to(out): f.stat().st_mtime_ns for f in out.glob("data/*/*/*.parquet")}
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        upkeep(stream, str(out), str(tmp_path / "ck"), buckets=16).awaitTermination()
        seen.append(files())
    want = {r["id"]: r["ds"] for r in set_fingerprints(spark.createDataFrame(sum(batches, []), schema).distinct()).collect()}
    assert {r["id"]: r["ds"] for r in current(spark, str(out)).collect()} == want
    wrote = [{f.parts[2] for f in s if f.parts[1] == f"batch={n}"} for n, s in enumerate(seen)]
    assert len(wrote[0]) == 16 and len(wrote[1]) <= 3 and len(wrote[2]) <= 2
    # what the second batch did not touch is as it was; what only the first version named is gone
    assert all(seen[2][f] == at for f, at in seen[0].items() if f.parts[2] not in wrote[1])
    assert not [f for f in seen[2] if f.parts[1] == "batch=0" and f.parts[2] in wrote[1]]
    assert sorted(p.name for p in (out / "manifest").iterdir()) == ["version=1", "version=2"]
