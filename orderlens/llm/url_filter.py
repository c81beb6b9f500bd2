"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and Spark ML.  The labelled URLs are
those that a rule judges; the trees learn from at most ``SAMPLE`` different
ones a label, those with the smallest hash.  Features: lengths, path depth,
digit ratio, character entropy, parameter counts, and statistics of the host's
suffix (its last two labels): how many different URLs have it and which share
of the judged ones is blocked.  All of these count a URL once, however many
rows have it.  A URL that the trees learn from is described by the shares of
the other ``FOLDS`` - 1 folds, so that its own label is not among its features.

Defined results: a null url, or one without ``://``, has empty host and path
and fits no rule; a rule fits literally, so a host with a port fits none; with
no judged URL, or judged URLs of one label only, the rest gets that label, or
allow; repeated rows are judged alike; no rows give no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_groups, packed, store

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SAMPLE = 5000                       # bound of the training sample, URLs of a label
TREES, DEPTH = 10, 4
FOLDS = 5
PRIOR = 20.0                        # judged URLs that a suffix's share of blocked ones starts from
FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "other_ratio", "entropy",
            "parameters", "query_length", "has_fragment", "is_https", "suffix_count", "suffix_blocked"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):           # the longest is tried first: it ends up outermost
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits a character, by the frequencies of the text's own characters."""
    chars = F.array_sort(F.split(text, ""))
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def bits(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = s["last"] == c
        return F.struct(c.alias("last"), F.when(same, s["run"] + 1.0).otherwise(1.0).alias("run"),
                        F.when(same, s["total"]).otherwise(s["total"] + bits(s["run"])).alias("total"))

    n = F.length(text).cast("double")
    summed = F.aggregate(chars, zero, step, lambda s: s["total"] + bits(s["run"]))
    return F.when(n > 0, F.log2(n) - summed / n).otherwise(0.0)


def _lexical(rows: DataFrame) -> DataFrame:
    """Rows (…, url, host, path) with the lexical features and the host's suffix."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    length = F.length(url).cast("double")

    def count(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    return rows.withColumns({
        "suffix": F.substring_index("host", ".", -2),
        "url_length": length, "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"), "depth": count(F.col("path"), "/[^/]"),
        "digit_ratio": F.coalesce(F.try_divide(count(url, "[0-9]"), length), F.lit(0.0)),
        "other_ratio": F.coalesce(F.try_divide(count(url, "[^A-Za-z0-9]"), length), F.lit(0.0)),
        "entropy": entropy(url), "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "query_length": F.length(query).cast("double"), "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "is_https": F.startswith(url, F.lit("https://")).cast("double")})


def _described(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows with a url, plus host, path, rule, the rule's verdict (``ruled``), the fold and the lexical features."""
    host, path = host_and_path(F.col("url"))
    verdict_of = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    rows = rows.withColumns({"host": host, "path": path, "fold": F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return _lexical(rows).withColumn("ruled", F.try_element_at(verdict_of, F.col("rule")))


def _counted(known: DataFrame, *by: str) -> DataFrame:
    """Different URLs, judged ones and blocked ones of each group."""
    blocked = F.count_if(F.col("ruled") == "block")
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.count("ruled").alias("judged"), blocked.alias("blocked"))


def _suffix_features(n: Column, judged: Column, blocked: Column, share: float) -> dict[str, Column]:
    return {"suffix_count": F.log1p(n), "suffix_blocked": (blocked + PRIOR * share) / (judged + PRIOR)}


def _fit(known: DataFrame, suffixes: DataFrame, share: float, sample: int, rules: dict[str, str]):
    """The trees, from the different judged URLs ``known`` (url, suffix, fold, ruled)."""
    judged = known.where("ruled is not null").select("url", "ruled")
    chosen = [judged.where(F.col("ruled") == v).orderBy(F.xxhash64("url"), "url").limit(sample) for v in ("allow", "block")]     # 2 * sample rows at most
    examples = _described(store(chosen[0].unionByName(chosen[1]).select("url"), "examples"), rules)
    names = ("n", "judged", "blocked")
    own = _counted(known, "suffix", "fold").select("suffix", "fold", *[F.col(c).alias(f"own_{c}") for c in names])
    examples = examples.join(suffixes.select("suffix", *names), "suffix").join(own, ["suffix", "fold"])
    examples = examples.withColumns(_suffix_features(*[F.col(c) - F.col(f"own_{c}") for c in names], share))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(examples)
    vectors = vectors.select("features", (F.col("ruled") == "block").cast("double").alias("label"))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1).fit(vectors)


def _learned(rows: DataFrame, suffixes: DataFrame, model, share: float, total: int) -> DataFrame:
    """``rows`` with ``learned``, block or allow, and ``blocked_chance``; ``held`` of a suffix is its number of rows."""
    wide = join_groups(rows, suffixes, "suffix", "held", total).withColumns(_suffix_features(F.col("n"), F.col("judged"), F.col("blocked"), share))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(wide))
    return scored.withColumns({"learned": F.when(F.col("prediction") == 1.0, "block").otherwise("allow"), "blocked_chance": vector_to_array("probability")[1]})


def _known(described: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The different URLs, and the numbers of blocked and allowed ones."""
    known = store(described.select("url", "suffix", "fold", "ruled").distinct(), "known")
    return known, {r["ruled"]: r["count"] for r in known.where("ruled is not null").groupBy("ruled").count().collect()}       # two rows at most


def judge(pages: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``page``, host, path, rule, verdict and blocked_chance; ``page`` holds all columns of the given row."""
    given = pages.select(packed(pages).alias("page"), F.col("url").cast("string").alias("url"))
    described = store(_described(given, rules), "urls")
    known, totals = _known(described)
    if len(totals) < 2:
        verdict = next(iter(totals), "allow")
        return described.select("page", "host", "path", "rule", F.coalesce("ruled", F.lit(verdict)).alias("verdict"),
                                F.lit(float(verdict == "block")).alias("blocked_chance"))
    share = totals["block"] / sum(totals.values())
    held = described.groupBy("suffix").agg(F.count("*").alias("held"))
    suffixes = store(_counted(known, "suffix").join(held, "suffix"), "suffixes")
    model = _fit(known, suffixes, share, sample, rules)
    judged = _learned(described, suffixes, model, share, described.count())
    return judged.select("page", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), "blocked_chance")


def held_out(pages: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row: how trees that never saw one fold of the judged URLs judge it (urls, right, blocked; right_by_share by the larger label alone)."""
    described = store(_described(pages.select(F.col("url").cast("string").alias("url")).distinct(), rules), "urls")
    seen, unseen = described.where("fold <> 0"), described.where("fold = 0 AND ruled is not null")
    known, totals = _known(seen)
    share = totals["block"] / sum(totals.values())
    suffixes = store(_counted(known, "suffix").withColumn("held", F.col("n")), "suffixes")
    model = _fit(known, suffixes, share, sample, rules)
    met = unseen.join(suffixes.select("suffix"), "suffix", "left_semi")
    new = unseen.join(suffixes.select("suffix"), "suffix", "left_anti")
    none = new.select("suffix").distinct().withColumns({c: F.lit(0).cast("long") for c in ("n", "judged", "blocked", "held")})
    rows = _learned(met, suffixes, model, share, described.count()).unionByName(_learned(new, none, model, share, described.count()))
    blocked = F.count_if(F.col("ruled") == "block")
    return rows.agg(F.count("*").alias("urls"), F.count_if(F.col("ruled") == F.col("learned")).alias("right"), blocked.alias("blocked"),
                    F.greatest(blocked, F.count("*") - blocked).alias("right_by_share"))
