import gzip
import os
import subprocess
import sys
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from orderlens.sources import (
    SCHEMAS, bucket_load, load_csv, publish, read_bucketed, read_csv, read_ordered, run_sql, scratch, store, write_bucketed, write_ordered,
    write_result)


def test_csv_bom_crlf_zip_and_empty_field(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    text = ("seller_id,seller_zip_code_prefix,seller_city,seller_state\r\n"
            "s1,01001,sao paulo,SP\r\n"
            "s2,13023,,SP")
    path.write_bytes(b"\xef\xbb\xbf" + text.encode("utf-8"))
    df = read_csv(spark, str(path), schema="sellers")
    assert df.columns == ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]
    rows = [tuple(r) for r in df.orderBy("seller_id").collect()]
    assert rows == [("s1", "01001", "sao paulo", "SP"), ("s2", "13023", None, "SP")]
    inferred = read_csv(spark, str(path), infer_schema=True)
    assert dict(inferred.dtypes)["seller_zip_code_prefix"] == "int"


def test_schemas_cover_the_eight_tables():
    assert set(SCHEMAS) == {"customers", "order_items", "payments", "orders", "products", "sellers",
                            "category_translation", "geolocation"}


def test_parquet_sink_partitioned_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "2017-01", 1.5), ("s1", "2017-02", 2.5)],
                               "seller_id string, year_month string, v double")
    out = str(tmp_path / "out")
    write_result(df, out, partition_by=["year_month"])
    back = spark.read.parquet(out).where(F.col("year_month") == "2017-02")
    assert "PartitionFilters: [isnotnull(year_month" in back._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in back.select("seller_id", "v").collect()] == [("s1", 2.5)]


def test_publish_and_sql_source(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    names = publish({"t_a": a}, prefix="test_")
    assert names == ["test_t_a"]
    assert run_sql(spark, "SELECT v FROM test_t_a").first().v == "x"
    assert run_sql(spark, "SELECT v FROM {a} WHERE k = 1", a=a).first().v == "x"


def test_declared_driver_schemas_match_files(spark):
    from orderlens.sources.fixtures import DRIVER_SCHEMAS
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        for name, ddl in DRIVER_SCHEMAS.items():
            on_disk = spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet").schema
            declared = spark.read.schema(ddl).parquet(f"/root/testdata/{sf}/{name}.parquet").schema
            assert [(f.name, f.dataType) for f in on_disk] == [(f.name, f.dataType) for f in declared], (sf, name)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    header, row = "payment_type,order_id,payment_value,payment_sequential,payment_installments", "card,o1,10.5,1,2"
    (tmp_path / "a.csv").write_text(f"{header}\n{row}\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(f"{header}\n{row}\n".encode()))
    expected = [("o1", 1, "card", 2, 10.5)]
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), "payments").collect()] == expected
    assert [tuple(r) for r in read_csv(spark, str(tmp_path), "payments").collect()] == expected * 2
    for bad in (header.replace(",order_id", ""), header + ",more"):
        (tmp_path / "c.csv").write_text(f"{bad}\n{row}\n")
        with pytest.raises(ValueError, match="missing columns"):
            read_csv(spark, str(tmp_path / "c.csv"), "payments")
    (tmp_path / "d.csv").write_text(f"{header}\n{row.replace('10.5', 'ten')}\n")
    with pytest.raises(Exception, match="payment_value cannot be double"):
        read_csv(spark, str(tmp_path / "d.csv"), "payments").collect()
    assert read_csv(spark, str(tmp_path / "d.csv"), "payments", bad_cells="null").first().payment_value is None


def test_one_month_is_replaced_and_the_others_stay(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "seller_id string, year_month string, v double"
    write_result(spark.createDataFrame([("s1", "2017-01", 1.0), ("s1", "2017-02", 2.0), ("s2", "2017-02", 3.0)], schema), out, ["year_month"])
    untouched = sorted(p.name for p in (tmp_path / "out" / "year_month=2017-01").iterdir())
    write_result(spark.createDataFrame([("s1", "2017-02", 9.0), ("s3", "2017-03", 4.0)], schema), out, ["year_month"], mode="replace_partitions")
    rows = spark.read.schema(schema).parquet(out).select("seller_id", "year_month", "v").collect()
    assert sorted(map(tuple, rows)) == [("s1", "2017-01", 1.0), ("s1", "2017-02", 9.0), ("s3", "2017-03", 4.0)]
    assert sorted(p.name for p in (tmp_path / "out" / "year_month=2017-01").iterdir()) == untouched
    with pytest.raises(ValueError, match="partition_by"):
        write_result(spark.createDataFrame([("s1", "x", 1.0)], schema), out, mode="replace_partitions")


def test_files_keep_the_order_and_prune(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 40).alias("v"))
    write_ordered(df.repartition(3), str(out), F.col("v").desc_nulls_last(), "k", files=4)
    wanted = [tuple(r) for r in df.orderBy(F.col("v").desc_nulls_last(), "k").collect()]
    back = read_ordered(spark, str(out))
    assert [(r.k, r.v) for r in back.orderBy("position").collect()] == wanted
    parts = sorted(out.glob("part-*.parquet"))
    assert [tuple(r.values()) for p in parts for r in pq.read_table(p).to_pylist()] == wanted
    stats = [pq.ParquetFile(p).metadata.row_group(0).column(1).statistics for p in parts]
    told = [(s.min, s.max) for s in stats if s.has_min_max]
    assert len(told) >= 3 and all(a[0] >= b[1] for a, b in zip(told, told[1:]))       # ranges of v do not overlap but at their ends
    write_ordered(df.limit(0), str(tmp_path / "none"), "k")
    assert read_ordered(spark, str(tmp_path / "none")).count() == 0


def test_csv_quarantine(spark, tmp_path):
    header = "payment_type,order_id,payment_value,payment_sequential,payment_installments"
    lines = [header, "card,o1,10.5,1,2", "card,o2,ten,1,2", "slip,o3,,1,", "card,o4,many,x,1", "card,o5,1.5,1", "card,o6,1.5,1,2,extra", "card,o7,2.5,3,4"]
    text = "\n".join(lines) + "\n"
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csv").write_text(text)
    (tmp_path / "one" / "b.csv.gz").write_bytes(gzip.compress(text.encode()))
    for n, path in enumerate([tmp_path / "one" / "a.csv", tmp_path / "one" / "b.csv.gz", tmp_path / "one"]):
        files = 2 if path.is_dir() else 1
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"load {n}", "")
        good, bad = load_csv(spark, str(path), "payments", str(tmp_path / f"out{n}"))
        stages = [s for j in tracker.getJobIdsForGroup(f"load {n}") for s in tracker.getJobInfo(j).stageIds]
        spark.sparkContext.setJobGroup("rest", "")
        assert len(stages) <= 2                                # the header, and one scan that writes both
        assert good.columns == [f.name for f in SCHEMAS["payments"]]
        assert sorted(tuple(r) for r in good.collect()) == sorted([("o1", 1, "card", 2, 10.5), ("o3", 1, "slip", None, None), ("o7", 3, "card", 4, 2.5)] * files)
        told = sorted(((r.column, r.text) for r in bad.collect()), key=str)
        assert told == sorted([("payment_value", "ten"), ("payment_value", "many"), ("payment_sequential", "x"),
                               (None, "card,o5,1.5,1"), (None, "card,o6,1.5,1,2,extra")] * files, key=str)
        assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == ({path.name} if files == 1 else {"a.csv", "b.csv.gz"})
        assert good.count() + bad.select("file", "row").distinct().count() == 7 * files
    (tmp_path / "c.csv").write_text(header.replace(",order_id", "") + "\n")
    with pytest.raises(ValueError, match="missing columns"):
        load_csv(spark, str(tmp_path / "c.csv"), "payments", str(tmp_path / "out-c"))


def test_bucketed_tables(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    table = f"bucketed_{uuid.uuid4().hex}"
    back = write_bucketed(df, table, "k", 4, path=str(tmp_path / "t"), sort_by=["v"])
    try:
        assert len(list((tmp_path / "t").glob("*.parquet"))) == 4
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
        assert read_bucketed(spark, table, "k", 4).count() == 200
        for key, buckets in (("v", None), ("k", 8)):
            with pytest.raises(ValueError, match="not bucketed"):
                read_bucketed(spark, table, key, buckets)
    finally:
        spark.sql(f"DROP TABLE {table}")
    hot = df.unionByName(spark.range(300).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v")))
    load = bucket_load(hot, "k", 4).collect()
    assert sum(r.rows for r in load) == 500 and sum(r["keys"] for r in load) == 50 and max(r.rows_of_largest_key for r in load) == 304


def test_scratch_tables_lie_in_one_folder_that_is_removed_at_once(spark, monkeypatch):
    monkeypatch.setattr(scratch, "run_folder", lambda s, own=scratch.run_folder: own(s) + "-removed")       # not what other tests still read
    kept = [scratch.store(spark.range(n), "numbers") for n in (3, 5)]
    assert [df.count() for df in kept] == [3, 5]
    assert all(scratch.run_folder(spark).split(":")[-1] in f for df in kept for f in df.inputFiles())
    assert scratch.remove_run(spark) and not scratch.remove_run(spark)


def test_workers_get_the_package_from_the_shared_folder(tmp_path):
    program = tmp_path / "elsewhere.py"
    program.write_text(f"""
import sys
sys.path.insert(0, {ROOT!r})
from orderlens import build_session
from orderlens.operators.cleaning import string_columns
from orderlens.sources import remove_run, ship_package
spark = build_session("local[2]", shuffle_partitions=2, extra={{"spark.checkpoint.dir": "file://{tmp_path}/shared"}})
ship_package(spark)
ship_package(spark)

def known(batches):
    import pyarrow as pa
    import orderlens.functions
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([orderlens.functions.__file__] * batch.num_rows)], ["path"])

remove_run(spark)
ship_package(spark)
paths = {{r.path for r in spark.range(4).mapInArrow(known, "path string").collect()}}
assert len(paths) == 1 and "orderlens.zip" in paths.pop()
assert remove_run(spark)
""")
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(program)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
