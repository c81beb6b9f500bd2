"""Exact dedup by two passes over a Bloom filter.

Texts are equal when they are identical without white space.  Pass one keeps
a counting Bloom filter of the text hashes, distributed by filter segment: a
position counts up to two, and the positions met twice form a bitmap.  Pass
two tests each row: a hash with a position met once cannot repeat, so its row
passes straight through; only the possibly repeated rows shuffle, and these
are grouped by the full SHA-256, so a false positive costs a little traffic
and never a wrong result.

The bitmap has ``BITS_PER_ROW`` bits a row and at most ``MAX_BITS`` (128 MB),
which bounds the broadcast.  Above MAX_BITS / BITS_PER_ROW rows the filter
fills up and more rows shuffle; the result stays the same.

Defined results: a null text counts as empty; a null doc_id comes after all
others; of rows equal in text and doc_id one stays; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, join_groups, packed, store, text_of

BITS_PER_ROW = 16
HASHES = 3
MAX_BITS = 1 << 30
SEGMENT = 4096 * 8                  # bits in one bitmap of bitmap_construct_agg


def normal_sha256(text: Column) -> Column:
    """SHA-256 of the text without its white space."""
    return F.sha2(F.translate(text, WHITE, "").cast("binary"), 256)


def _positions(sha: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def repeated_positions(hashes: DataFrame, bits: int) -> DataFrame:
    """Pass one: (segment, bitmap) of the filter positions that at least two rows hit."""
    hit = hashes.select(F.explode(F.array_distinct(F.array(*_positions(F.col("sha"), bits)))).alias("position"))
    twice = hit.groupBy("position").agg(F.count("*").alias("n")).where("n > 1")
    # bitmap_construct_agg numbers a bucket's bits from 0; bucket numbers start at 1
    return (twice.groupBy(F.bitmap_bucket_number(F.col("position") + 1).alias("segment"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("position") + 1)).alias("bitmap")))


def with_repeat_flag(rows: DataFrame, filter_: DataFrame, bits: int) -> DataFrame:
    """Pass two: add ``maybe``, true where every position of the row's ``sha`` was met twice."""
    columns = rows.columns
    positions = _positions(F.col("sha"), bits)
    for i, position in enumerate(positions):
        segment = filter_.select(F.col("segment").alias(f"segment{i}"), F.col("bitmap").alias(f"bitmap{i}"))
        rows = (rows.withColumn(f"position{i}", position)
                .withColumn(f"segment{i}", F.bitmap_bucket_number(F.col(f"position{i}") + 1))
                .join(F.broadcast(segment), f"segment{i}", "left"))

    def is_set(i: int) -> Column:
        bit = F.bitmap_bit_position(F.col(f"position{i}") + 1)
        byte = F.conv(F.hex(F.substring(F.col(f"bitmap{i}"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position(position{i} + 1) % 8 as int))")) != 0, F.lit(False))

    maybe = is_set(0)
    for i in range(1, HASHES):
        maybe = maybe & is_set(i)
    return rows.select(*columns, maybe.alias("maybe"))


def _filter(digests: DataFrame) -> tuple[DataFrame, int, int]:
    rows = digests.count()
    bits = min(MAX_BITS, -(-max(1, rows) * BITS_PER_ROW // SEGMENT) * SEGMENT)
    return store(repeated_positions(digests, bits), "bloom"), bits, rows


def decide(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_of()
    digests = store(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normal_sha256(text).alias("sha"),
        F.length(text).alias("n_chars"), F.monotonically_increasing_id().alias("row")), "digests")
    filter_, bits, rows = _filter(digests)
    flagged = with_repeat_flag(digests, filter_, bits)
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    maybe = flagged.where("maybe").select("doc_id", "sha", "row", "n_chars")
    groups = store(maybe.groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    groups = groups.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    grouped = join_groups(maybe.select("sha", "doc_id", "row"), groups, "sha", "group_size", rows)
    straight = flagged.where(~F.col("maybe"))
    return straight.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    ).unionByName(grouped.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows that cannot repeat are not shuffled."""
    text = text_of()
    sha = normal_sha256(text)
    filter_, bits, _ = _filter(store(docs.select(sha.alias("sha")), "digests"))
    rows = docs.select(packed(docs).alias("row"), sha.alias("sha"))
    flagged = with_repeat_flag(rows, filter_, bits)
    doc_id = F.col("row.doc_id")
    order = F.struct(F.length(F.coalesce(F.col("row.text"), F.lit(""))), doc_id.isNotNull(), -doc_id.cast("long"),
                     F.xxhash64(F.col("row")))
    best = flagged.where("maybe").groupBy("sha").agg(F.max_by("row", order).alias("row"))
    return flagged.where(~F.col("maybe")).select("row.*").unionByName(best.select("row.*"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[ \x09-\x0D]', '', 'g')) AS sha
  FROM documents),
r AS (
  SELECT doc_id, sha, count(*) OVER (PARTITION BY sha) AS group_size,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM r
"""
