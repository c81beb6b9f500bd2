"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to length one, so the largest cosine is the smallest
distance.  K-means lists are fitted on a bounded sample and every vector
joins its nearest list.  A query probes the lists with the nearest centres;
how many is set by the sample itself, so that its own true neighbours are
found with share ``TARGET``.  Every query starts with a bound: its k-th
distance to some vectors of the sample, candidates like all others, the
nearest of which are answers already.  Inside a probed list the vectors, turned by a random rotation, are
read in column blocks: after each block a hypothesis test on the partial
distance abandons the candidates that are too far already, and only
survivors reach the last block.  The bound is taken anew after ``CHUNK``
members, then after twice as many, and so on.  Survivors are scored exactly,
in double precision, on the original vectors.

Rows meet by a shuffle on (list, shard, part): a list is split into shards
of at most ``SHARD`` vectors, its queries into parts of about ``ASKS``, and
a shard is held by one task while the part's queries stream past it.  Equal
vectors are one candidate that carries its smallest vec_ids, enough for
every answer, and one query whose answer all its vec_ids share, so a very
common vector costs nothing more.

The number of lists is the square root of the number of vectors, up to an
eighth of the sample; beyond ``(SAMPLE / 8) ** 2`` vectors (9 million) the
lists get longer instead.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another dimension than the most
common one; rows equal in vec_id and vector count once; ties go to the smaller
vec_id; fewer candidates than ``k`` give fewer rows; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_groups, store

K = 5
SAMPLE = 24_000                     # bound of the vectors that lists, rotation and probes are fitted on
SEEDS = 4096                        # vectors of the sample that give a query its first bound
ROUNDS = 8                          # of k-means
TARGET = 0.985                      # share of the sample's true neighbours that the probed lists must hold
SHARD = 4096
ASKS = 16_384                       # queries of a part
BLOCK = 16                          # dimensions in a column block
CHUNK = 256                         # members of a list read before the bound is first taken anew
EPSILON = 1.2                       # of the hypothesis test


class Index(NamedTuple):
    centres: np.ndarray
    rotation: np.ndarray
    probes: int
    seeds: np.ndarray


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(points[i:i + 4096] @ centres.T, axis=1) for i in range(0, len(points), 4096)])


def fit(sample: np.ndarray, rows: int, k: int = K, seed: int = 7) -> Index:
    """Lists, rotation and number of probes from the sample's vectors, for an index of ``rows`` vectors."""
    random = np.random.default_rng(seed)
    points = _unit(sample)
    lists = int(min(max(1, round(rows ** 0.5)), max(1, len(points) // 8)))
    centres = points[random.choice(len(points), lists, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centres)
    own = _nearest_centre(points, centres)
    tried = random.choice(len(points), min(400, len(points)), replace=False)
    near = points[tried] @ points.T
    near[np.arange(len(tried)), tried] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, :min(k, len(points) - 1)]
    place = np.argsort(np.argsort(-(points[tried] @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())      # probes that reach each true neighbour
    probes = int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)]) + 1 if len(needed) else 1
    rotation = np.linalg.qr(random.standard_normal((points.shape[1],) * 2))[0]
    return Index(centres, rotation, probes, sample[:SEEDS])


def nearest_seeds(query: np.ndarray, seeds: np.ndarray, keep: int) -> tuple[np.ndarray, float]:
    """The ``keep`` nearest seeds and the largest of their squared distances (infinity if there are fewer); all unit vectors."""
    near = seeds @ query
    if len(near) <= keep:
        return np.arange(len(near)), 2 - 2 * near.min() if len(near) == keep else np.inf
    best = np.argpartition(near, len(near) - keep)[len(near) - keep:]
    return best, max(2 - 2 * near[best].min(), 0.0)


def scan(query: np.ndarray, members: np.ndarray, keep: int, bound: float = np.inf, tally: Counter | None = None) -> np.ndarray:
    """Indexes of the ``members`` that may be among the ``keep`` nearest of ``query``; all rotated unit vectors.

    ``bound`` is a squared distance that the ``keep`` nearest of all stay
    within.  ``tally`` counts the members, those abandoned before their last
    column block, and the column blocks read.
    """
    dims = len(query)
    found, distances = np.empty(0, dtype=np.int64), np.empty(0)
    at, size = 0, CHUNK
    while at < len(members):
        alive = np.arange(at, min(at + size, len(members)))
        at, size = at + size, size * 2
        partial = np.zeros(len(alive))
        whole = len(alive)
        for start in range(0, dims, BLOCK):
            stop = min(start + BLOCK, dims)
            if tally is not None:
                tally["blocks"] += len(alive)
                if stop == dims:
                    tally.update(members=whole, abandoned=whole - len(alive))
            apart = members[alive, start:stop] - query[start:stop]
            partial += np.einsum("ij,ij->i", apart, apart)
            if bound < np.inf:
                test = bound * stop / dims * (1 + EPSILON / stop ** 0.5) ** 2 if stop < dims else bound
                stay = partial <= test + 1e-9
                alive, partial = alive[stay], partial[stay]
        found, distances = np.concatenate((found, alive)), np.concatenate((distances, partial))
        if len(found) > keep:
            bound = min(bound, np.partition(distances, keep - 1)[keep - 1])
            stay = distances <= bound + 1e-9
            found, distances = found[stay], distances[stay]
    return found


def _answers(vectors: np.ndarray, norms: np.ndarray, ids: list[list[int]], found: np.ndarray, query: np.ndarray, size: float, keep: int) -> list[tuple[float, int]]:
    """(score, vec_id) of the ``keep`` best of the vectors ``found``, each under all its ids."""
    scores = (vectors[found] * query).sum(axis=1) / (norms[found] * size)
    best = sorted((-s, i) for at, s in zip(found.tolist(), scores.tolist()) for i in ids[at])[:keep]
    return [(-s, i) for s, i in best]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    value = F.col(column).cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), value.alias("vector")).where(sound)
    return store(rows, "vectors")


def search(vectors: DataFrame, is_query, k: int = K, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row that ``is_query`` (a Column on vec_id) names."""
    spark = vectors.sparkSession
    kind = "query_id long, rank int, vec_id long, score double"
    usable = _usable(vectors, id_column, column)
    sizes = usable.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").head()
    if sizes is None:
        return spark.createDataFrame([], kind)
    usable = usable.where(F.size("vector") == sizes["dims"])

    least = Window.partitionBy("vector").orderBy("vec_id")
    members = (usable.groupBy("vector", "vec_id").agg(F.lit(1).alias("one"))
               .withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
               .groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))      # k + 1 ids at most
    members = store(members, "candidates")
    sample = members.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toArrow().column("vector").combine_chunks()
    index = fit(_matrix(sample), members.count(), k)
    seed_ids = members.orderBy(F.xxhash64("vector"), "vector").limit(SEEDS).select("ids").toArrow().column("ids").to_pylist()        # in the same order
    given = spark.sparkContext.broadcast((index, seed_ids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = given.value[0].centres
        for batch in batches:
            if batch.num_rows:
                lists = np.argmax(_unit(_matrix(batch.column(1))) @ centres.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], ["ids", "vector", "list"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (centres, _, probes, seeds), ids = given.value
        units, norms = _unit(seeds), np.linalg.norm(seeds, axis=1)
        for batch in batches:
            rows = []
            for vector in _matrix(batch.column(1)):
                size = np.linalg.norm(vector)
                lists = np.argsort(-(centres @ (vector / size)), kind="stable")[:probes]
                best, bound = nearest_seeds(vector / size, units, k + 1)        # one more, as the query may be among the seeds
                rows.append((lists.tolist(), float(bound), [{"vec_id": i, "score": s} for s, i in _answers(seeds, norms, ids, best, vector, size, k + 1)]))
            if rows:
                kinds = pa.list_(pa.int32()), pa.float64(), pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["name", "vector", "lists", "bound", "seeds"])

    placed = store(members.select("ids", "vector").mapInArrow(assign, "ids array<long>, vector array<double>, list int"), "placed")
    asking = usable.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    folded = store(asking.groupBy("vector").agg(F.count("*").alias("copies")).withColumn("name", F.monotonically_increasing_id()), "folded")
    asked = store(folded.select("name", "vector").mapInArrow(
        ask, "name long, vector array<double>, lists array<int>, bound double, seeds array<struct<vec_id: long, score: double>>"), "asked")

    # both tables have a row for each list, SAMPLE / 8 at most
    parts = asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
    shards = placed.groupBy("list").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    lists = F.broadcast(store(shards.join(parts, "list"), "lists"))
    tree = placed.join(lists, "list").select(
        "list", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int").alias("shard"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"),
        F.lit(False).alias("asks"), "ids", "vector", F.lit(0.0).alias("bound"))
    asks = asked.withColumn("list", F.explode("lists")).join(lists, "list").select(
        "list", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int").alias("part"),
        F.lit(True).alias("asks"), F.array("name").alias("ids"), "vector", "bound")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, here, held, ready = given.value[0].rotation, None, [], None
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            asking, ids, all_vectors, bounds = batch.column(3).to_pylist(), batch.column(4).to_pylist(), _matrix(batch.column(5)), batch.column(6).to_pylist()
            for key, asks_, own, vector, bound in zip(keys, asking, ids, all_vectors, bounds):
                if key != here:
                    here, held, ready = key, [], None
                if not asks_:
                    held.append((own, vector))
                    continue
                if not held:
                    continue
                if ready is None:
                    originals = np.stack([v for _, v in held])
                    ready = originals, np.linalg.norm(originals, axis=1), _unit(originals) @ rotation
                originals, norms, turned = ready
                size = np.linalg.norm(vector)
                found = scan((vector / size) @ rotation, turned, k + 1, bound)
                out += [(own[0], i, s) for s, i in _answers(originals, norms, [i for i, _ in held], found, vector, size, k + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
                                                 ["name", "vec_id", "score"])

    work = tree.unionByName(asks).repartition("list", "shard", "part").sortWithinPartitions("list", "shard", "part", "asks")
    answers = work.mapInArrow(probe, "name long, vec_id long, score double")
    answers = answers.unionByName(asked.select("name", F.explode("seeds").alias("seed")).select("name", "seed.vec_id", "seed.score")).distinct()
    # k + 1 answers for each vector, one of which may be the query itself
    best = (answers.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
            .groupBy("name").agg(F.collect_list(F.struct("vec_id", "score")).alias("answers")))
    best = store(folded.join(best, "name").select("vector", "copies", "answers"), "best")
    given_to = join_groups(asking, best, "vector", "copies", usable.count()).select("query_id", F.explode("answers").alias("answer"))
    given_to = given_to.select("query_id", "answer.vec_id", "answer.score").where("vec_id <> query_id").distinct()
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (given_to.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
