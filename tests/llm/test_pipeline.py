"""The pipeline against its operators' brute-force parts on the smallest tables."""

import hashlib
import os
import sys

import pytest

import corpus_pipeline
from orderlens.llm import byte_bpe, mixing
from orderlens.llm.common import store

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm_operators import SPACE, brute_components, brute_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_stages_take_effect_and_run_agrees(spark, result):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, columns, counts = docs, docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.exceptAll(start).dropDuplicates(["doc_id"]).join(start, "doc_id", "left_anti").isEmpty()
        counts.append(docs.count())
        if name == "exact_dedup":
            texts = ["".join(r.text.split()) for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({"".join(r.text.split()) for r in before.collect()})
        if name == "mix_sources":
            assert docs.count() == sum(r.taken // r.size for r in mixing.plan(before).collect() if r.size)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[-1]
    assert sorted(map(str, result)) == sorted(map(str, last.collect()))


def brute_pipeline(rows):
    """(doc_id, tokens, digest of the ids) of every copy in the mix, from rows (doc_id, text, source), by plain loops."""
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]                          # language
    groups = {}
    for r in rows:                                                                               # exact copies
        groups.setdefault("".join(SPACE.split(r[1])), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    prints = [brute_fingerprint(r[1]) for r in rows]
    first = dict(zip([r[0] for r in rows], brute_components([r[0] for r in rows], prints)))      # near copies
    rows = [r for r in rows if first[r[0]] == r[0]]

    sizes = {r[0]: len([w for w in SPACE.split(r[1]) if w]) for r in rows}                       # the mix
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    words = {s: sum(sizes[r[0]] for r in rows if r[2] == s) for s in sources}
    budget, full = sum(words.values()), set()
    while True:
        left, shared = budget - sum(3 * words[s] for s in full), sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and weight[s] * left >= 3 * words[s] * shared}
        if not over:
            break
        full |= over
    target = {s: 3.0 * words[s] if s in full else weight[s] * (left / shared) for s in sources}
    copies = []
    for s in sources:
        upto = 0
        for place, doc_id, text in sorted((int(hashlib.md5(f"{r[0]}/mix-1".encode()).hexdigest()[:15], 16), r[0], r[1]) for r in rows if r[2] == s):
            upto += sizes[doc_id]
            copies += [((upto + words[s] * turn) / target[s], "" if s is None else f"={s}", place, doc_id, turn, text) for turn in range(3) if sizes[doc_id]]
    taken, used = [], 0
    for copy in sorted(copies):
        used += sizes[copy[3]]
        if used > budget:
            break
        taken.append(copy)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    ids = [own.encode_ordinary(c[5]) for c in taken]
    return sorted((c[3], len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for c, i in zip(taken, ids))


def test_run_against_brute_force(spark, result):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in result) == brute_pipeline(rows)
    assert len({r.doc_id for r in result}) < len(rows) and len(result) > len({r.doc_id for r in result})   # stages take effect


def test_run_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
