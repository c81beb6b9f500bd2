import datetime as dt
import uuid

import pytest

from orderlens.sources.fixtures import UNDEFINED_PAYMENT_TYPE, OrderViews
from orderlens.plans import analyses as A
from orderlens.streaming import drop_repeats, payment_summary_stream, read_stream, repeat_counts, start

from conftest import SF_SMALL


def test_payment_summary_stream_matches_batch(spark, tmp_path):
    payments = OrderViews(spark, SF_SMALL).payments
    src = str(tmp_path / "payments")
    payments.repartition(3).write.parquet(src)           # three files arrive
    stream = read_stream(spark, src, payments.schema, max_files_per_trigger=1)
    name = "pay_" + uuid.uuid4().hex[:8]
    q = start(payment_summary_stream(stream, undefined=UNDEFINED_PAYMENT_TYPE), spark, name, sink="memory", output_mode="complete")
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect())
    finally:
        q.stop()
    from orderlens.operators import cleaning
    batch = A.payment_summary(cleaning.zero_undefined_installments(payments, undefined=UNDEFINED_PAYMENT_TYPE))
    assert got == sorted(tuple(r) for r in batch.collect())


def test_a_stream_needs_a_sink(spark):
    with pytest.raises(TypeError, match="sink"):
        start(spark.readStream.format("rate").load(), spark, "none")


def test_copies_in_later_files_are_dropped_once(spark, tmp_path):
    schema = "review_id string, seen timestamp, text string"
    src, out, name = str(tmp_path / "reviews"), str(tmp_path / "kept"), "dedupe_" + uuid.uuid4().hex[:8]
    day = dt.datetime(2018, 1, 1)

    def load(*rows):
        frame = spark.createDataFrame([(i, day + dt.timedelta(hours=h), t) for i, h, t in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(src)
        stream = drop_repeats(read_stream(spark, src, frame.schema), ["review_id"], "seen", "2 days")
        q = start(stream, spark, name, sink="parquet", path=out)       # each load is a run that goes on from the checkpoint
        try:
            q.processAllAvailable()
            return repeat_counts(q)
        finally:
            q.stop()

    assert load(("a", 0, "first"), ("a", 1, "again"), ("b", 2, "first"))[:3] == (3, 1, 0)
    assert load(("a", 30, "in a later file"), ("c", 200, "first"))[:2] == (2, 1)
    late = load(("d", 10, "late"), ("b", 201, "held no more"))         # the watermark stands at hour 200 less 48
    assert (late.late, late.duplicates) == (1, 0)
    assert late.keys_held <= 3                                         # a and b of the first load have left the state
    kept = spark.read.parquet(out).collect()
    assert sorted((r.review_id, r.text) for r in kept) == [("a", "first"), ("b", "first"), ("b", "held no more"), ("c", "first")] or \
        sorted((r.review_id, r.text) for r in kept) == [("a", "again"), ("b", "first"), ("b", "held no more"), ("c", "first")]
