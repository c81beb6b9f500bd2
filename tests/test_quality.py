from conftest import SF_SMALL
from orderlens.operators import quality
from orderlens.sources.fixtures import OrderViews


def test_clean_counts_and_null_audit(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", float("nan")), (4, "w", 4.0)],
                               "id int, s string, v double")
    c = quality.clean_counts(df).first()
    assert (c.rows_before, c.rows_after, c.rows_dropped) == (4, 2, 2)
    a = quality.null_audit(df).first().asDict()
    assert a == {"rows_total": 4, "rows_with_null": 2, "id_nulls": 0, "s_nulls": 1, "v_nulls": 1}


def test_duplicate_audit(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    r = quality.duplicate_audit(df).first()
    assert (r.rows_total, r.rows_distinct, r.duplicate_rows) == (6, 3, 3)
    empty = quality.duplicate_audit(df.where("k > 10")).first()
    assert (empty.rows_total, empty.rows_distinct, empty.duplicate_rows) == (0, 0, 0)


def test_row_count(spark):
    df = spark.range(7)
    assert quality.row_count(df).first().row_count == 7


def test_clean_figures_come_from_the_writing_job(spark, tmp_path):
    views = OrderViews(spark, SF_SMALL)
    tracker, group = spark.sparkContext.statusTracker(), "write-clean"
    spark.sparkContext.setJobGroup(group, "clean and count")
    try:
        figures = quality.write_clean(views.orders, str(tmp_path / "clean"))
        jobs = tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setJobGroup("rest", "")
    stages = [s for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert len(jobs) == 1 and len(stages) == 1               # one scan, counted while it is written
    assert figures.clean_counts.first() == quality.clean_counts(views.orders).first()
    assert figures.null_audit.first() == quality.null_audit(views.orders).first()
    written = spark.read.parquet(str(tmp_path / "clean"))
    assert figures.row_count.first().row_count == written.count() == views.clean_orders.count()
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, views.clean_orders.collect()))


def test_clean_figures_of_some_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", float("nan")), (None, "w", 4.0)], "id int, s string, v double")
    figures = quality.write_clean(df, str(tmp_path / "a"), subset=["v"], columns=["id", "s"])
    assert figures.clean_counts.first().asDict() == {"rows_before": 4, "rows_after": 3, "rows_dropped": 1}
    assert figures.null_audit.first().asDict() == {"rows_total": 4, "rows_with_null": 2, "id_nulls": 1, "s_nulls": 1}
    empty = quality.write_clean(df.limit(0), str(tmp_path / "b"))
    assert empty.row_count.first().row_count == empty.clean_counts.first().rows_before == 0
