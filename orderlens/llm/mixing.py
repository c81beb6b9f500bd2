"""Mixing sources to target weights by weighted fair queueing.

Within its source every document has a place in a seeded shuffle, and its
copies (one a pass, ``PASSES`` at most) get the virtual finish time
``words of the source up to and including it / target of the source``.
All copies in the order of finish time, cut where the budget of words is
reached, are the mix: each source has spent its target at finish time 1.

Targets share the budget by weight; a target stops at PASSES times the
source's size, and the excess goes to the others by weight until no target
is above.  With the sources ordered by limit over weight the limited ones
come first, so running sums give the shares without a loop.

Running sums take two steps: sums of ranges of the order, then rows within a
range, so no source and no doc_id, however many rows it has, is one task's
work.  All of this is done on narrow rows; the documents meet the copies that
are taken of them once, by a hash of all their columns, and rows equal in all
columns count as one document there.

Defined results: a null text has size 0; documents of size 0 are never
taken; null sources are one source, the last; a null doc_id is shuffled by
its text; rows equal in doc_id and size are interchangeable; no rows give no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from .common import join_groups, packed, running, store, text_of

WEIGHTS = (5, 2, 1)
PASSES = 3
SEED = "mix-1"
SLICES = 4096                       # of finish time 1


def words_in(text: Column) -> Column:
    r"""Number of matches of ``[^\x20\x09-\x0D]+``."""
    one_space = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(one_space)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Size and place of every document, written once; ``row`` tells rows apart that are equal in all else."""
    text = text_of()
    name = F.coalesce(F.col("doc_id").cast("string"), F.sha2(text.cast("binary"), 256))
    digest = F.md5(F.concat(name, F.lit(f"/{SEED}")).cast("binary"))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source_key"), words_in(text).alias("size"),
                             place.alias("place"), F.monotonically_increasing_id().alias("row"), *more), "sizes")


def _keys(docs: DataFrame) -> list[Column]:
    """128 bits of a hash over all columns, nulls in their places."""
    cells = [c for name in docs.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    return [F.xxhash64(F.lit(i), *cells).alias(f"key{i}") for i in (1, 2)]


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, passes: int = PASSES) -> DataFrame:
    """``sources`` (source_key, source_size) with ``target``, the words the source gets of ``share`` of all words."""
    ranked = running(sources, [(F.col("source_key") == ""), F.col("source_key")], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * passes)
    ordered = running(limited.drop("place"), [F.col("most") / F.col("weight"), F.col("source_key")],
                      {"most_up_to": F.col("most"), "weight_up_to": F.col("weight")})
    ordered = store(ordered, "limits")
    words, all_weight = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).head()
    budget = int(words * share)
    wide = "decimal(38,0)"
    left_words = F.lit(budget) - (F.col("most_up_to") - F.col("most"))
    left_weight = F.lit(all_weight) - (F.col("weight_up_to") - F.col("weight"))
    full = F.col("most").cast(wide) * left_weight.cast(wide) <= F.col("weight").cast(wide) * left_words.cast(wide)
    judged = ordered.withColumn("full", full)
    open_weight, full_words = judged.agg(F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)),
                                         F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0))).head()
    part = float(budget - full_words) / float(open_weight) if open_weight else 0.0
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight").cast("double") * F.lit(part))
    return judged.select("source_key", "source_size", target.alias("target"), F.lit(budget).cast("long").alias("budget"))


def _queue(rows: DataFrame, weights, share, passes) -> DataFrame:
    """``rows`` with source_size, target, budget and ``upto``, the words of the source up to and including the row."""
    sums = store(rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("held")), "sources")
    starts = running(sums, [F.col("source_key")], {"words_to": F.col("source_size")}).select(
        "source_key", "held", (F.col("words_to") - F.col("source_size")).alias("start"))
    goal = store(targets(sums.drop("held"), weights, share, passes).join(starts, "source_key"), "goal")
    summed = running(rows, [F.col(c) for c in ("source_key", "place", "doc_id", "size", "row")], {"words_to": F.col("size")})
    queue = join_groups(summed, goal, "source_key", "held", rows.count())
    return store(queue.withColumn("upto", F.col("words_to") - F.col("start")).drop("words_to", "start", "held"), "queue")


def _order(turn: Column | str) -> list[Column]:
    return [F.try_divide((F.col("upto") + F.col("source_size") * turn).cast("double"), F.col("target")).alias("finish"),
            F.col("source_key"), F.col("place"), F.col("doc_id"), turn.cast("int").alias("turn")]


def _cut(queue: DataFrame, passes: int) -> Row | None:
    """The first copy, in the order of the mix, that the budget does not reach; None if it reaches all."""
    copies = (queue.where("size > 0").withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
              .select(*_order(F.col("turn")), "size", "budget")
              .withColumn("slice", F.least(F.floor(F.col("finish") * SLICES), F.lit(SLICES * 2))))
    slices = copies.groupBy("slice").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    upto = F.sum("words").over(Window.orderBy("slice"))                 # 2 * SLICES + 1 rows at most
    crossed = slices.withColumn("upto", upto).where("upto > budget").withColumn("before", F.col("upto") - F.col("words"))
    edge = crossed.orderBy("slice").select("slice", "before").head()
    if edge is None:
        return None
    names = ["finish", "source_key", "place", "doc_id", "turn"]
    within = running(copies.where(F.col("slice") == edge["slice"]), [F.col(c) for c in names], {"words": F.col("size")})
    return within.where(F.col("words") + edge["before"] > F.col("budget")).orderBy("words").select(*names).head()


def _taken(cut: Row | None, passes: int) -> Column:
    """How many copies of the row come before ``cut``."""
    if cut is None:
        return F.when(F.col("size") > 0, passes).otherwise(0)
    limit = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(cut.__fields__, cut, ("double", "string", "long", "long", "int"))])
    count = F.lit(0)
    for turn in range(passes):
        count = count + (F.struct(*_order(F.lit(turn))) < limit).cast("int")
    return F.when(F.col("size") > 0, count).otherwise(0)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, passes: int = PASSES) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    queue = _queue(_rows(docs), weights, share, passes)
    copies = _taken(_cut(queue, passes), passes)
    return queue.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, passes: int = PASSES) -> DataFrame:
    """The mix itself: a row for each copy taken, with all columns of ``docs``, in the order of finish time."""
    keys = ["key1", "key2"]
    queue = _queue(_rows(docs, *_keys(docs)), weights, share, passes)
    taken = queue.withColumn("copies", _taken(_cut(queue, passes), passes)).where("copies > 0")
    copies = taken.withColumn("turn", F.explode(F.expr("sequence(0, copies - 1)"))).select(*keys, *_order(F.col("turn")))
    documents = docs.select(packed(docs).alias("document"), *_keys(docs)).groupBy(*keys).agg(F.first("document").alias("document"))
    return copies.join(documents, keys).orderBy("finish", "source_key", "place", "doc_id", "turn").select("document.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS size,
         ('0x' || substr(md5(doc_id || '/mix-1'), 1, 15))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source_key, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source_key = '', source_key) AS i
  FROM d GROUP BY source_key),
w AS (SELECT *, [5, 2, 1][(i - 1) % 3 + 1] AS weight, source_size * 3 AS most, sum(source_size) OVER () AS budget FROM s),
l AS (
  SELECT *, most::HUGEINT * sum(weight) OVER after <= weight::HUGEINT * (budget - coalesce(sum(most) OVER before, 0)) AS capped
  FROM w
  WINDOW after AS (ORDER BY most / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         before AS (ORDER BY most / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source_key, source_size, budget,
         CASE WHEN capped THEN most::DOUBLE
              ELSE weight::DOUBLE * ((budget - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())::DOUBLE
                                     / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE) END AS target
  FROM l),
q AS (
  SELECT d.*, source_size, budget, target,
         sum(size) OVER (PARTITION BY source_key ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t USING (source_key)),
c AS (
  SELECT q.*, turn, (upto + source_size * turn)::DOUBLE / target AS finish
  FROM q, range(3) r(turn) WHERE size > 0),
k AS (
  SELECT doc_id, size,
         sum(size) OVER (ORDER BY finish, source_key, place, doc_id, turn ROWS UNBOUNDED PRECEDING) <= budget AS inside
  FROM c),
n AS (SELECT doc_id, sum(size) FILTER (inside)::BIGINT AS taken FROM k GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN n USING (doc_id)
"""
