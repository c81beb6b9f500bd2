"""SimHash near-dedup with BK-trees.

Each text gets a 64-bit fingerprint of its word shingles; fingerprints that
differ in at most ``radius`` bits are linked, and links form components.

Finding the links: with ``BLOCKS`` blocks of bits, two fingerprints within
three bits agree on at least two blocks, so every pair of blocks gives a
bucket key and every link lies inside some bucket.  A bucket's distinct
fingerprints become BK-trees (children keyed by the integer Hamming distance
to the parent); a query follows only the edges within the radius of its own
distance to the node.  A bucket above ``SHARD`` fingerprints is split into
shards, and each pair of its shards is one task's work: the members of one
shard as tree, those of the other as queries.  The shard trees reach their
queries by a shuffle on the bucket, not by a driver broadcast, because all
trees together hold every fingerprint and have no size bound.

A tree reports its links as a spanning forest, never as all pairs.  The
components are found by contracting the links round by round; each round is
written to the shared folder.

Defined results: a text without words has fingerprint zero and links like
any other; a null text counts as empty; equal fingerprints share a
component; a null doc_id comes after all others; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import join_groups, packed, store, text_of

SHINGLE = 3
RADIUS = 3
BLOCKS = 5                          # RADIUS + 2: two blocks always agree
SHARD = 8192                        # fingerprints in one tree
CHUNK = 1 << 16                     # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' XXH64 (seed 42); 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()      # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1:] - 1).tolist()
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK])),
                             dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(counts * 2 > len(starts)).tolist())


def with_fingerprint(rows: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``rows`` without the column ``text``, plus ``fp`` (the fingerprint's 64 bits as a long); a column of this name is replaced."""
    rows = rows.drop(*{"fp"} - {text})
    schema = rows.drop(text).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in texts], dtype=np.uint64).view(np.int64)
            rest = [i for i, name in enumerate(batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(fps)],
                                             [*(batch.schema.names[i] for i in rest), "fp"])

    return rows.mapInArrow(run, schema)


def _bucket_keys(fps: DataFrame, blocks: int, agree: int) -> DataFrame:
    """One row for each fingerprint and choice of ``agree`` blocks: (key, fp)."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def bk_links(members: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(index of a tree member, indexes of the queries within ``radius`` of it), from a BK-tree over ``members``.

    The tree is built from its root down while the queries descend: a node's
    other members hang below the edge of their distance to it, and an edge d
    takes on the queries whose own distance to the node is within the radius of d.
    """
    found = []
    todo = [(np.arange(len(members)), np.arange(len(queries)))]
    while todo:
        node, asked = todo.pop()
        here = np.bitwise_count(queries[asked] ^ members[node[0]]).astype(np.int16)
        hits = asked[here <= radius]
        if len(hits):
            found.append((int(node[0]), hits))
        if len(node) == 1:
            continue
        below = node[1:]
        apart = np.bitwise_count(members[below] ^ members[node[0]]).astype(np.int16)
        for d in np.unique(apart).tolist():
            follow = asked[np.abs(here - d) <= radius]
            if len(follow):
                todo.append((below[apart == d], follow))
    return found


def _forest(members: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links between members and queries."""
    nodes = np.unique(np.concatenate([members, queries]))
    label = np.arange(len(nodes))
    where_m, where_q = np.searchsorted(nodes, members), np.searchsorted(nodes, queries)
    for i, hits in bk_links(members, queries, radius):
        met = np.unique(label[np.concatenate([where_q[hits], where_m[i:i + 1]])])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _links_of_buckets(radius: int):
    """mapInArrow function over rows (key, lo, hi, shard, fp) sorted by key, lo, hi: the links (u, v)."""

    def link(shards: np.ndarray, fps: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        members, queries = np.unique(fps[shards == lo]), np.unique(fps[shards == hi])
        return _forest(members, queries, radius) if len(members) and len(queries) else (fps[:0], fps[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=t) for t in ("i8", "i4", "i4", "i4", "i8")]     # the group that may go on in the next batch
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate((old, batch.column(i).to_numpy(zero_copy_only=False))) for i, old in enumerate(held)]
            key, lo, hi, shard, fp = held
            if not len(key):
                continue
            change = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            bounds = np.concatenate(([0], change, [len(key)]))
            if batch is not None:
                bounds = bounds[:-1]
            several = np.flatnonzero(np.diff(bounds) > 1)
            out = [link(shard[a:b], fp[a:b].view(np.uint64), lo[a], hi[a])
                   for a, b in zip(bounds[several].tolist(), bounds[several + 1].tolist())]
            if out:
                u, v = (pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])
            held = [x[bounds[-1]:] for x in held]

    return run


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (u, v) between the distinct long ``fp``: the spanning forests of all buckets."""
    keyed = _bucket_keys(fps, radius + 2, 2)
    large = keyed.groupBy("key").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")).where("shards > 1")
    work = (keyed.join(large, "key", "left")
            .withColumn("shards", F.coalesce("shards", F.lit(1)))
            .withColumn("shard", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, shards - 1)")))
            .select("key", F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi"), "shard", "fp"))
    return (work.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(_links_of_buckets(radius), "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge in (u, v); nodes of one component share the root.

    A round points every node at the smallest among itself and its
    neighbours, replaces both ends of the edges by what they point at, and
    drops the loops.  Node numbers must be in random order: then the nodes
    left fall geometrically, for chains and stars alike.
    """
    def ordered(frame: DataFrame, a: str, b: str) -> DataFrame:
        return (frame.where(F.col(a) != F.col(b))
                .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())

    edges = store(ordered(edges, "u", "v"), "edges")
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = store(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "to")
        labels = to if first else store(
            labels.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            .select("node", F.coalesce("next", "root").alias("root")), "labels")
        first = False
        a = to.select(F.col("node").alias("u"), F.col("root").alias("a"))
        b = to.select(F.col("node").alias("v"), F.col("root").alias("b"))
        edges = store(ordered(edges.join(a, "u").join(b, "v"), "a", "b"), "edges")
    return labels


def _groups(marked: DataFrame, radius: int, shard: int) -> DataFrame:
    """From (fp, doc_id, row): (fp, n, best), where ``best`` is the component's first (no_id, doc_id, row)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    found = store(marked.groupBy("fp").agg(first, F.count("*").alias("n")), "distinct")
    # XXH64 of eight bytes is a permutation: a distinct, randomly ordered number for every fingerprint
    edges = links(found.select("fp"), radius, shard).select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
    rooted = store(found.withColumn("node", F.xxhash64("fp")).join(components(edges), "node", "left"), "rooted")
    linked = rooted.where(F.col("root").isNotNull()).select("root", "fp", "n", "first")
    best = store(linked.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("members")), "best")
    together = join_groups(linked, best, "root", "members", found.count())
    alone = rooted.where(F.col("root").isNull()).select("fp", "n", F.col("first").alias("best"))
    return store(alone.unionByName(together.select("fp", "n", "best")), "groups")


def cluster(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its component)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    marked = store(with_fingerprint(rows, shingle), "fingerprints")
    groups = _groups(marked, radius, shard).select("fp", "n", F.col("best.doc_id").alias("component_id"))
    return (join_groups(marked, groups, "fp", "n", marked.count())
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns."""
    rows = docs.select(packed(docs).alias("document"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    marked = store(with_fingerprint(rows, shingle), "fingerprints")
    keep = _groups(marked.select("fp", "doc_id", "row"), radius, shard).select(F.col("best.row").alias("row")).distinct()
    return marked.join(keep, "row", "left_semi").select("document.*")
