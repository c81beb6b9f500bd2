"""Merkle fixity audit of WARC replicas.

Records are laid out as WARC response records in files of ``PER_FILE`` ids,
ordered by id.  Each replica has two trees: one of its records by id, and one
of its layout by file.

In the tree by id a leaf hashes the records of one id with their lengths;
2^FANOUT_BITS neighbouring ids, which is one ordered offset range, form a
node, as many neighbouring nodes the next one, and so on up to one root for
each replica.  Two replicas are
compared from the root down: only the children of nodes that differ are read
at the next level, so an audit of sound replicas reads two rows, and damage
is located to the record.

A node hashes its children by a sum over their hashes with their places, so
it needs no list of them and map-side aggregation applies; repeated ids hash
as a multiset in one leaf.  Inside a leaf that differs the records are matched
by length and hash, with counts; what is left on both sides is paired, records
at the same file and offset first, as one corrupt record each.

In the layout tree a leaf hashes the (offset, length, sha256) of a file's
records.  Only in files that differ there the sound records' places are
compared: a record is ``moved`` if it is in another file, or at an offset
that records missing, added, corrupt or gone to another file before it do
not explain: then other bytes of the file's sound records come before it
than in the first replica.

Running offsets are summed over ranges of all records in their order, so
neither a large file nor an id that many records share is one task's work.

Defined results: null url and html count as empty; all records with a null
id are one leaf, in a branch of its own, and are spread over files by their
hash; a record without a partner in the other replica is ``missing`` there;
empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_groups, running, store

PER_FILE = 1000
FANOUT_BITS = 4                     # 16 children to a node
LOOSE_FILES = 4096                  # files for the records without an id
LEAF = ("no_id", "node")            # a record's place in the tree; records without an id are a branch beside all others
HEX_DIGITS = 14                     # of a hash in one partial sum: sums of 2^31 of them fit decimal(38)


def record_bytes(url: Column, html: Column) -> Column:
    """The WARC response record of a page."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def manifest(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """id, file, offset, length and sha256 of every record, as laid out in its file."""
    record = record_bytes(F.col("url").cast("string"), F.col("html").cast("string"))
    key = F.col(id_column).cast("long")
    rows = pages.select(key.alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha256"))
    loose = -1 - F.pmod(F.xxhash64("sha256"), F.lit(LOOSE_FILES))
    rows = store(rows.withColumn("file", F.coalesce(F.expr(f"id div {PER_FILE}"), loose).cast("long")), "records")
    return _upto(rows, "offset", [F.col("id"), F.col("sha256")])


def _upto(records: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``records`` with ``name``, the bytes of the records before each in its file, in the given order."""
    summed = store(running(records, [F.col("file"), *order], {"upto": F.col("length")}), "summed")
    starts = summed.groupBy("file").agg(F.min(F.col("upto") - F.col("length")).alias("start"), F.count("*").alias("held"))
    return (join_groups(summed, starts, "file", "held", summed.count())
            .withColumn(name, F.col("upto") - F.col("length") - F.col("start")).select(*records.columns, name))


def _sum_hash(hashes: Column) -> Column:
    """One hash of a multiset of SHA-256 values: the sums of their four parts."""
    sums = [F.sum(F.conv(F.substring(hashes, 1 + i * HEX_DIGITS, HEX_DIGITS), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.sha2(F.concat_ws("/", F.count("*").cast("string"), *[s.cast("string") for s in sums]).cast("binary"), 256)


def placed(records: DataFrame) -> DataFrame:
    """``records`` with their LEAF and ``record``, what two equal records share."""
    return records.withColumns({"no_id": F.col("id").isNull(), "node": F.coalesce("id", F.lit(0)).cast("long"), "record": F.concat_ws("/", "length", "sha256")})


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first: (no_id, node, hash), the last of one row."""
    leaf = F.sha2(F.col("record").cast("binary"), 256)
    rows = store(placed(records).select(*LEAF, leaf.alias("leaf")).groupBy(*LEAF).agg(_sum_hash(F.col("leaf")).alias("hash")), "leaves")
    found = [rows]
    child = F.sha2(F.concat_ws("/", F.col("no_id").cast("string"), "node", "hash").cast("binary"), 256).alias("child")
    for _ in range(levels):
        rows = store(rows.select("no_id", F.shiftright("node", FANOUT_BITS).alias("up"), child)
                     .groupBy("no_id", F.col("up").alias("node")).agg(_sum_hash(F.col("child")).alias("hash")), "nodes")
        found.append(rows)
    root = rows.select(F.lit(False).alias("no_id"), F.lit(0).cast("long").alias("node"), child)
    return [*found, store(root.groupBy(*LEAF).agg(_sum_hash(F.col("child")).alias("hash")), "root")]


def levels_for(largest_id: int | None, smallest_id: int | None = None) -> int:
    levels, largest = 0, max(largest_id or 0, ~(smallest_id or 0))
    while largest >> FANOUT_BITS * levels:
        levels += 1
    return levels


def damaged(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """The leaves (no_id, node, hash_a, hash_b) in which two trees of the same height differ; null where a replica has none."""
    suspects = None
    for level in reversed(range(len(a))):
        sides = [x[level].select(*LEAF, F.col("hash").alias(f"hash_{n}")) for n, x in (("a", a), ("b", b))]
        if level < len(a) - 2:                  # the root's children are the nodes 0 and -1 and that without ids: all are read
            sides = [s.join(suspects, (s["no_id"] == suspects["none"]) & (F.shiftright("node", FANOUT_BITS) == suspects["parent"]), "left_semi") for s in sides]
        differ = sides[0].join(sides[1], [*LEAF], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        differ = store(differ, "differ")
        if level == 0 or differ.isEmpty():
            return differ
        suspects = differ.select(F.col("no_id").alias("none"), F.col("node").alias("parent"))
    raise AssertionError("a tree has at least a root")


def _numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``number``, from 1 within equal ``keys``; no task sees all rows of a key."""
    rows = store(running(rows, [*[F.col(k) for k in keys], *order], {"number": F.lit(1)}), "numbered")
    starts = rows.groupBy(*keys).agg((F.min("number") - 1).alias("start"))
    return rows.join(starts, keys).withColumn("number", F.col("number") - F.col("start")).drop("start")


def _first_where(rows: DataFrame, others: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``rows`` with a mark on those whose ``keys`` are also in ``others``, and an order that has these first."""
    return rows.join(others.select(*keys).distinct().withColumn("met", F.lit(True)), keys, "left"), F.col("met").isNull()


def _judged(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every record of damaged leaves with its status, those of ``second`` only where the first replica has no partner; and the sound ones of ``second``."""
    keys = [*LEAF, "record"]
    both = first.select(*keys, F.lit(1).alias("c1"), F.lit(0).alias("c2")).unionByName(second.select(*keys, F.lit(0).alias("c1"), F.lit(1).alias("c2")))
    groups = store(both.groupBy(*keys).agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2")), "groups")
    first = store(first.join(groups, keys), "first")
    second = store(second.join(groups, keys), "second")
    even = first.where("c1 <= c2").withColumn("status", F.lit("intact"))
    left = []
    for rows, others, more, matched in ((first, second, "c1 > c2", "c2"), (second, first, "c2 > c1", "c1")):
        rows, met = _first_where(rows.where(more), others, [*keys, "file", "offset"])
        left.append(store(_numbered(rows, keys, [met, F.col("file"), F.col("offset")]).drop("met")
                          .withColumn("matched", F.col("number") <= F.col(matched)).drop("number"), "left"))
    pairs = groups.groupBy(*LEAF).agg(F.least(F.sum(F.greatest(F.expr("c1 - c2"), F.lit(0))), F.sum(F.greatest(F.expr("c2 - c1"), F.lit(0)))).alias("pairs"))
    unmatched = [rows.where("not matched") for rows in left]
    found = [even, left[0].where("matched").withColumn("status", F.lit("intact"))]
    for rows, others, status in ((*unmatched, F.when(F.col("number") <= F.col("pairs"), "corrupt").otherwise("missing_second")),
                                 (*reversed(unmatched), F.when(F.col("number") > F.col("pairs"), "missing_first"))):
        rows, met = _first_where(rows, others, [*LEAF, "file", "offset"])
        rows = _numbered(rows, [*LEAF], [met, F.col("file"), F.col("offset"), F.col("record")])
        found.append(rows.join(pairs, [*LEAF]).withColumn("status", status).where("status is not null"))
    columns = ["id", "file", "offset", "length", "sha256", "status"]
    result = found[0].select(*columns)
    for rows in found[1:]:
        result = result.unionByName(rows.select(*columns))
    return result, second.where("c2 <= c1").select(*columns[:-1]).unionByName(left[1].where("matched").select(*columns[:-1]))


def _layout(records: DataFrame) -> DataFrame:
    """The records as leaves by file, for the tree of the layout."""
    return records.select(F.col("file").alias("id"), F.concat_ws("/", "offset", "length").alias("length"), "sha256")


def _displaced(sound: DataFrame, partners: DataFrame, files: DataFrame) -> DataFrame:
    """The (no_id, node, record, file, offset) of ``sound`` records that ``partners`` have elsewhere; only ``files`` are looked at."""
    same = [*LEAF, "record", "file"]
    first, second = (store(placed(x.join(files, "file", "left_semi")), "sound") for x in (sound, partners))
    places = [*same, "offset"]
    stays = [_upto(x.join(y.select(*same).distinct(), same, "left_semi"), "ahead", [F.col("offset")]) for x, y in ((first, second), (second, first))]
    within = stays[0].join(stays[1].select(*same, "ahead"), [*same, "ahead"], "left_anti")
    return first.join(second.select(*same).distinct(), same, "left_anti").select(*places).unionByName(within.select(*places))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every record of either replica with ``status``: intact, moved, corrupt, missing_first or missing_second."""
    first, second = store(first, "replica"), store(second, "replica")

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        smallest, largest = a.select("id").unionByName(b.select("id")).agg(F.min("id"), F.max("id")).head()
        height = levels_for(largest, smallest)
        return damaged(tree(a, height), tree(b, height)).select(*LEAF)

    bad = differing(first, second)
    columns = ["id", "file", "offset", "length", "sha256"]
    judged, partners = _judged(*(placed(x).join(bad, [*LEAF], "left_semi") for x in (first, second)))
    whole, other = (placed(x).join(bad, [*LEAF], "left_anti").select(*columns) for x in (first, second))
    result = whole.withColumn("status", F.lit("intact")).unionByName(judged)
    files = differing(_layout(first), _layout(second)).select(F.col("node").alias("file"))
    if files.isEmpty():
        return result
    result = store(result, "judged")
    moved = _displaced(result.where("status = 'intact'").select(*columns), other.unionByName(partners), files)
    keys = [*LEAF, "record", "file", "offset"]
    marked = placed(result).join(moved.withColumn("gone", F.lit(True)), keys, "left")
    told = F.when(F.col("gone") & (F.col("status") == "intact"), "moved").otherwise(F.col("status"))
    return marked.select(*columns, told.alias("status"))


def aged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with planted damage: a byte is wrong in every 997th record, every 1499th is gone."""
    worn = F.when(F.col("page_id") % 997 == 5, F.concat(F.lit("?"), F.substring(F.coalesce("html", F.lit("")), 2, 1 << 30))).otherwise(F.col("html"))
    return pages.where(F.coalesce(F.col("page_id") % 1499 != 7, F.lit(True))).select("page_id", "url", worn.alias("html"))


ORACLE = r"""
WITH r AS (
  SELECT page_id AS id, page_id // 1000 AS file,
         'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e
         || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS record
  FROM pages, (SELECT chr(13) || chr(10) AS e)),
m AS (SELECT id, file, strlen(record)::BIGINT AS length, sha256(record) AS sha256 FROM r)
SELECT id, file,
       coalesce(sum(length) OVER (PARTITION BY file ORDER BY id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       length, sha256,
       CASE WHEN id % 1499 = 7 THEN 'missing_second' WHEN id % 997 = 5 THEN 'corrupt' ELSE 'intact' END AS status
FROM m
"""
