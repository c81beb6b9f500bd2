"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct shingles of ``SHINGLE`` lower-cased
words; two sets link when their Jaccard similarity is at least ``PERCENT``.

The search itself: the sets of a block get an inverted list for every
shingle that two of them share.  In the order of size, each set asks for
the later ones (as large or larger) that lie in at least T of its lists.
DivideSkip takes the L longest lists aside, heap-merges the short ones and
skips ahead where fewer than T - L of them can meet, then probes the long
lists for the candidates by binary search and keeps those that reach the
overlap that both sizes require.  Sets that are already in one component
need no link between them, so a list that only holds the asking set's own
component is not read: a group of thousands of near copies costs about one
search.  What comes out is a spanning forest of the links, never all pairs.

Blocks: sets that link differ in so few shingles that, cut into somewhat
more parts than that, some of their parts are equal.  The parts' hashes are
keys.  The smallest set of a key is its pivot, and a pivot's block takes in
all sets of the keys that it is the pivot of, so sets that share a key share
a block; a set mostly has few pivots, as near copies share most keys.  A set
with fewer shared keys than any link would give it leaves before that.  A
block above ``SHARD`` shingles is split into shards, and each pair of its
shards is a block of its own.  A key's sets are streamed past, not held.

Only the texts of the sets in blocks are shuffled: a bitmap of fixed size,
broadcast, lets the others go first.  Once there are more such sets than it
has bits, it lets more texts through, and the result is the same.

Equal sets are one node, numbered by a 64-bit hash of the set; shingles are
compared by 64-bit hashes.  A wrong match needs two equal hashes.

Defined results: a document without words, or null, has an empty set and is
alone; equal sets share a component; a null doc_id comes after all others;
other columns, whatever their names, are not read; no rows give no rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import join_groups, store, text_of
from .simhash import components

SHINGLE = 4
PERCENT = 85
SHARD = 1 << 20                     # shingles of a shard
LONG_LISTS = 0.0085                 # DivideSkip: L = T / (LONG_LISTS * log2(longest list) + 1)
FILTER_BITS = 26                    # of the bitmap's size: 8 MB
BASE = np.uint64(0x9E3779B97F4A7C17)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles; of the whole sequence if it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()      # bytes: ASCII case and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    taken = min(width, len(words))
    joined = np.full(len(words) - taken + 1, taken, dtype=np.uint64)
    for i in range(taken):
        joined = joined * BASE + hashes[i:len(words) - taken + 1 + i]
    return np.unique(_mixed(joined))


def _node(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), dtype=np.uint64).view(np.int64))


def _class_limits(size: int, percent: int) -> list[tuple[int, int]]:
    """(most differing shingles, parts) of the size classes in which a set of ``size`` can meet a partner."""
    low = -(-percent // (100 - percent))                    # smaller sets only link with equal ones
    if size < low:
        return []
    limits, most = [], size * 100 // percent                # of a partner
    while low <= most:
        high = (low * 3 + 1) // 2                           # the class low .. high - 1, named by its larger partner
        if size < high:
            apart = 2 * (high - 1) * (100 - percent) // (100 + percent)
            limits.append((apart, apart + 2 + apart // 10))
        low = high
    return limits


def part_keys(found: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The keys of a set, and how many of them it shares with any set that it links with (equal ones apart)."""
    keys, least = [], []
    for apart, parts in _class_limits(len(found), percent):
        of = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)             # ascending, as the hashes are
        starts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1))
        sums = np.add.reduceat(_mixed(found + BASE), starts)
        tags = of[starts]
        least.append(max(1, len(starts) - apart))           # a differing shingle spoils one part
        if len(starts) <= apart:                            # so few parts have a shingle that equal empty ones count as well
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), tags)
            sums, tags = np.concatenate((sums, np.zeros(len(empty), np.uint64))), np.concatenate((tags, empty))
        keys.append(_mixed(sums * BASE + tags * np.uint64(0xD6E8FEB86659FD93) + np.uint64(parts)))
    return (np.concatenate(keys), min(least)) if keys else (np.empty(0, dtype=np.uint64), 0)


def merge_skip(postings, at: list[int], ends: list[int], need: int) -> Iterator[tuple[int, int]]:
    """(entry, number of lists) for the entries in at least ``need`` of the lists postings[at[i]:ends[i]], in order."""
    k = len(at)
    heap = [postings[a] * k + i for i, a in enumerate(at)]
    heapify(heap)
    while len(heap) >= need:
        top, popped = heap[0] // k, []
        while heap and heap[0] // k == top:
            popped.append(heappop(heap) % k)
        if len(popped) >= need:
            yield top, len(popped)
            target = top + 1
        else:
            while len(popped) < need - 1:
                popped.append(heappop(heap) % k)
            target = heap[0] // k                           # nothing before it can be in enough lists
        for i in popped:
            at[i] = bisect_left(postings, target, at[i], ends[i])
            if at[i] < ends[i]:
                heappush(heap, postings[at[i]] * k + i)


def block_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest (indexes) of the links between the different ``sets``."""
    by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = [len(sets[i]) for i in by_size]
    hashes = np.concatenate([sets[i] for i in by_size])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(hashes, kind="stable")               # a list's entries ascend
    hashes, owner = hashes[order], owner[order]
    edges = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True])))
    shared = np.repeat(np.diff(edges) > 1, np.diff(edges))
    hashes, owner = hashes[shared], owner[shared]
    if not len(owner):
        return []
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    length = np.diff(np.append(starts, len(owner)))
    of = np.repeat(np.arange(len(starts)), length)          # the list of each posting
    end = (starts + length)[of]
    places = np.argsort(owner, kind="stable")               # each set's postings
    begin = np.searchsorted(owner[places], np.arange(len(sets) + 1))
    postings = array("i", owner.tobytes())

    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    forest, since, known = [], 0, None
    for q, size in enumerate(sizes):
        if since * 16 >= len(sets) or (known is None and since):
            since, known = 0, np.array([root(i) for i in range(len(sets))])
            least, most = (f.reduceat(known[owner], starts) for f in (np.minimum, np.maximum))
            own = np.where(least == most, least, -1)        # the component that a list wholly belongs to
        mine = places[begin[q]:begin[q + 1]]
        mine = mine[end[mine] > mine + 1]                   # later sets hold the shingle as well
        if known is not None and len(mine):
            mine = mine[own[of[mine]] != known[q]]
        least_overlap = -(-2 * percent * size // (100 + percent))
        if len(mine) < least_overlap:
            continue
        mine = mine[np.argsort(end[mine] - mine, kind="stable")]
        at, ends = (mine + 1).tolist(), end[mine].tolist()
        aside = min(least_overlap - 1, int(least_overlap / (LONG_LISTS * log2(ends[-1] - at[-1] + 1) + 1)))
        cut = len(at) - aside
        for other, overlap in merge_skip(postings, at[:cut], ends[:cut], least_overlap - aside):
            if root(other) == root(q):
                continue
            needed = -(-percent * (size + sizes[other]) // (100 + percent))
            left = aside
            for a, b in zip(at[cut:], ends[cut:]):
                if overlap >= needed or overlap + left < needed:
                    break
                left -= 1
                place = bisect_left(postings, other, a, b)
                overlap += place < b and postings[place] == other
            if overlap >= needed:
                parent[root(other)] = root(q)
                since += 1
                forest.append((by_size[q], by_size[other]))
    return forest


def _texts(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, text_of().alias("text"))


def _marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, node, n, least) of every document; the node of an empty set is null."""
    names = ["doc_id", "node", "n", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(1)]
            columns = [_node(f) if len(f) else None for f in found], [len(f) for f in found], [part_keys(f, percent)[1] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names)

    return _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _unique_rows(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns, sorted by them from the first on, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(order) else np.zeros(0, bool)
    return [c[new] for c in columns], np.diff(np.append(np.flatnonzero(new), len(order)))


def _keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (key, node), one a batch for equal sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, np.ndarray] = {}
            for text in batch.column(0):
                found = shingles(text.as_py(), width)
                if len(found) and (node := _node(found)) not in own:
                    own[node] = part_keys(found, percent)[0]
            if own:
                nodes = np.repeat(np.array(list(own), dtype=np.int64), [len(k) for k in own.values()])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(own.values())).view(np.int64)), pa.array(nodes)], ["key", "node"])

    return _texts(docs).mapInArrow(run, "key long, node long")


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, node) sorted by both: (node, pivot, hits) for the nodes of the keys that several nodes have."""
    last_key = last_node = last_pivot = None
    told = False                                             # has the last key's pivot been given out?
    for batch in batches:
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        goes_on = key[0] == last_key
        new_key = np.concatenate(([not goes_on], key[1:] != key[:-1]))
        new_node = np.concatenate(([not goes_on or node[0] != last_node], node[1:] != node[:-1])) | new_key
        pivots = node[new_key]
        if goes_on:
            pivots = np.concatenate(([last_pivot], pivots))
        group = np.cumsum(new_key) - (0 if goes_on else 1)
        more = new_node & ~new_key
        several = np.unique(group[more])
        tells = several[several > 0] if goes_on and told else several
        (u, v), hits = _unique_rows(np.concatenate((node[more], pivots[tells])), np.concatenate((pivots[group[more]], pivots[tells])))
        told = bool(len(several)) and several[-1] == group[-1] or (told and goes_on and group[-1] == 0)
        last_key, last_node, last_pivot = key[-1], node[-1], pivots[-1]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(hits)], ["node", "pivot", "hits"])


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each node, by its lowest ``FILTER_BITS`` bits: 64 to a row, so the driver gets 2 ** (FILTER_BITS - 6) rows at most."""
    place = F.col("node").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(node & 63 AS int))")
    words = nodes.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bitmap.view(np.uint64)


def _wanted_texts(docs: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """(node, text) of the sets that may be in ``wanted``, one row a batch for equal sets."""
    given = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[int, int] = {}
            for i, text in enumerate(batch.column(0)):
                found = shingles(text.as_py(), width)
                if len(found):
                    node = _node(found)
                    place = node & ((1 << FILTER_BITS) - 1)
                    if int(given.value[place >> 6]) >> (place & 63) & 1:
                        first.setdefault(node, i)
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), batch.column(0).take(pa.array(list(first.values()), pa.int64()))], ["node", "text"])

    return _texts(docs).mapInArrow(run, "node long, text string")


def _search(width: int, percent: int):
    """mapInArrow function over rows (pivot, lo, hi, node, text) sorted by pivot, lo, hi: the links (u, v) of each block."""
    def links(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes = list(held)
        found = block_links(list(held.values()), percent) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        for batch in chain(batches, [None]):
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)) if batch is not None else [(None,) * 5]
            for *block, node, text in rows:
                if block != here:
                    if held:
                        yield links(held)
                    here, held = block, {}
                if node is not None and node not in held:
                    held[node] = shingles(text.as_py(), width)

    return run


def cluster(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, shard: int = SHARD) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id of its component)."""
    marked = store(_marked(docs, width, percent), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")
    nodes = store(marked.where("n > 0").groupBy("node").agg(
        first, F.max("n").alias("n"), F.max("least").alias("least"), F.count("*").alias("copies")), "nodes")

    shared = _keys(docs, width, percent).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_memberships, "node long, pivot long, hits long")
    shared = store(shared.groupBy("node", "pivot").agg(F.sum("hits").alias("hits")), "shared")
    enough = shared.groupBy("node").agg(F.sum("hits").alias("hits")).join(nodes.select("node", "n", "least"), "node").where("hits >= least")
    members = store(shared.select("node", "pivot").join(enough.select("node", "n"), "node"), "members")
    weights = members.groupBy("pivot").agg(F.count("*").alias("members"), F.ceil(F.sum("n") / shard).cast("int").alias("shards")).where("members > 1")
    placed = (join_groups(members, weights, "pivot", "members", members.count())
              .withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
              .withColumn("other", F.explode(F.expr("CASE WHEN shards = 1 THEN array(shard) ELSE array_except(sequence(0, shards - 1), array(shard)) END")))
              .select("node", "pivot", F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi")))
    placed = store(placed, "placed")
    work = _wanted_texts(docs, width, _bitmap(placed)).join(placed, "node").select("pivot", "lo", "hi", "node", "text")
    links = work.repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi").mapInArrow(_search(width, percent), "u long, v long")

    rooted = store(nodes.join(components(links), "node", "left"), "rooted")
    linked = rooted.where(F.col("root").isNotNull()).select("root", "node", "copies", "first")
    best = store(linked.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("members")), "best")
    together = join_groups(linked, best, "root", "members", nodes.count())
    alone = rooted.where(F.col("root").isNull()).select("node", "copies", F.col("first").alias("best"))
    groups = store(alone.unionByName(together.select("node", "copies", "best")), "groups").select("node", "copies", F.col("best.doc_id").alias("component_id"))

    filled = join_groups(marked.where("n > 0"), groups, "node", "copies", marked.count())
    empty = marked.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return filled.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        empty.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
  FROM words),
flat AS (SELECT doc_id, unnest(g) AS g FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * same >= 85 * (len(x.g) + len(y.g) - same)),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT doc_id, any_value(len(g)) AS n_shingles, min(other) AS component_id
FROM reached JOIN sets USING (doc_id) GROUP BY doc_id
"""
