"""Embedding whitening, the Jaccard join and periodic runs against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from orderlens.llm import jaccard_join, period_runs, queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = ("doc_id long, text string, node long, n long, key long, u long, root string, runs string, start int, period int, "
          "collapsed string, maybe string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "r", "x", 5, 6, "y", None) for i, t in rows], SCHEMA)


# whitening --------------------------------------------------------------------------------------
def brute_whitening(rows, count=16):
    """{vec_id and vector: (n, deviation, whitened up to sign, explained)} of the usable rows."""
    sound = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in sound], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = ((n * x - total) / n).astype(float)
    own = ((n * fit - total) / n).astype(float)
    cov = own.T @ own / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return sound, n, ((n * x - total) ** 2).sum(axis=1), np.abs(centred @ vectors) / np.sqrt(np.abs(values)), values / np.trace(cov)


def held_against_brute_force(frame, rows, count=16):
    sound, n, deviation, whitened, explained = brute_whitening(rows, count)
    found = frame.collect()
    kept = whitened.shape[1]
    assert len(found) == len(sound) * kept
    want = sorted((i is None, i or 0, c + 1, n, int(d), round(float(w), 6)) for (i, _), d, ws in zip(sound, deviation, whitened) for c, w in enumerate(ws))
    got = sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n, int(r.deviation), round(abs(r.whitened), 6)) for r in found)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-5)
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-9 for r in found)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-4


def test_whitening_of_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    held_against_brute_force(queries.op11_embedding_whitening(spark, SF), rows)


def test_whitening_of_awkward_rows(spark):
    rng = random.Random(5)
    good = [(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(40)]
    good += [(3, good[3][1]), (None, good[4][1]), (90, good[0][1])] + [(100 + i, good[7][1]) for i in range(60)]
    bad = [(200, None), (201, []), (202, [None] * 5), (203, [float("nan")] + [1.0] * 4), (204, [float("inf")] + [1.0] * 4), (205, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, "k") for i, v in good + bad], "vec_id long, embedding array<double>, n long, idx long, key string")
    held_against_brute_force(whitening.components(frame), good)
    assert {r.component for r in whitening.components(frame, 2).collect()} == {1, 2}
    assert whitening.components(frame.limit(0)).count() == 0


def test_whitening_over_several_blocks_and_splits(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 35)
    monkeypatch.setattr(whitening, "SPLITS", 3)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, s) for s in (3, 2, 1, 0.5, 0.2)]) for i in range(101)]
    held_against_brute_force(whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)), rows)


def test_a_flat_component_is_null(spark):
    one = whitening.components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    line = whitening.components(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in line if r.whitened is None} == {2, 3}
    assert all(r.identity_error < 1e-4 for r in line)


def test_a_deviation_beyond_a_long_is_null_in_the_query(spark, tmp_path):
    spark.createDataFrame([(i, [float(2 ** 40 * i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op11_embedding_whitening(spark, str(tmp_path)).collect()
    assert len(found) == 8 and all(r.deviation is None for r in found)


# Jaccard join -----------------------------------------------------------------------------------
def brute_join(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and sets[j] and 100 * same >= percent * (len(a) + len(sets[j]) - same) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows):
        least[x] = i if least.get(x) is None else least[x] if i is None else min(least[x], i)
    return sorted(((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label)), key=str)


def joined(frame, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.cluster(frame, **more).collect()), key=str)


def near_copies(seed, texts, copies, lengths=(7, 9, 12, 20, 60, 200)):
    rng = random.Random(seed)
    out = []
    for _ in range(texts):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice(lengths))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["new", "X", f"y{rng.randrange(99)}"])
            if rng.random() < 0.2:
                words += [f"z{rng.randrange(9)}" for _ in range(rng.randrange(len(base) // 6 + 1))]
            out.append(" ".join(words))
    return list(enumerate(out, start=10))


def test_join_against_brute_force(spark):
    long = " ".join(f"w{i % 700} x{i}" for i in range(20_000))
    rows = near_copies(1, 12, 9) + [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A\tb "), (6, "a b c"), (7, long), (8, long + " end"),
                                    (None, "a b"), (None, None), (4, "a b"), (9, "a a a a a a a a"), (0, "a a a a a")]
    frame = docs_of(spark, rows)
    assert joined(frame) == brute_join(rows)
    assert joined(frame.repartition(7), shard=300) == brute_join(rows)  # blocks of pairs of shards
    assert joined(frame, width=2, percent=60) == brute_join(rows, 2, 60)
    assert joined(frame.limit(0)) == []


def test_join_of_a_large_group_and_a_common_passage(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(passage + [f"q{i}.{j}" for j in range(25)])) for i in range(150)]
    found = joined(docs_of(spark, rows))
    assert found == brute_join(rows)
    assert {c for d, _, c in found if d < 150} == {0} and len({c for d, _, c in found if d >= 200}) == 150


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_a_part(percent):
    rng = random.Random(percent)
    for size in [*range(1, 40), 100, 400]:
        for _ in range(20):
            common = {rng.getrandbits(64) for _ in range(size)}
            most = size * (100 - percent) // percent
            own = rng.randrange(most + 1)
            a = common | {rng.getrandbits(64) for _ in range(own)}
            b = common | {rng.getrandbits(64) for _ in range(most - own)}
            if a != b and 100 * len(a & b) >= percent * len(a | b):
                (x, least), (y, also) = (jaccard_join.part_keys(np.array(sorted(s), dtype=np.uint64), percent) for s in (a, b))
                assert len(set(x.tolist()) & set(y.tolist())) >= max(least, also, 1)


def test_merge_skip_counts_like_a_plain_merge():
    rng = random.Random(9)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 9))]
        postings = [e for part in lists for e in part]
        ends = np.cumsum([len(part) for part in lists]).tolist()
        for need in range(1, len(lists) + 1):
            counts = {e: sum(e in part for part in lists) for e in set(postings)}
            found = dict(jaccard_join.merge_skip(postings, [0, *ends[:-1]], ends, need))
            assert found == {e: c for e, c in counts.items() if c >= need}


# periodic runs ----------------------------------------------------------------------------------
def brute_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if length >= max(6, 4 * q) and not any(words[a:a + length - d] == words[a + d:a + length] for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out)


def brute_report(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    dropped = {i for a, length, q in found for i in range(a + q, a + length)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in
           ("".join(f"{a},{b},{q}\n" for a, b, q in found), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(4)):
            if len(words) > 8:
                a, p = rng.randrange(len(words)), rng.randrange(1, len(words) // 4 + 1)
                unit = words[a:a + p]
                for j in range(a, min(len(words), a + rng.randrange(p, 6 * p + 2))):
                    words[j] = unit[(j - a) % len(unit)]
        assert [r for r in period_runs.runs(np.array(words, dtype=np.int64)) if r[1] >= 6] == brute_runs(words)


def test_synchronising_positions_are_consistent_and_dense():
    rng = random.Random(4)
    words = [rng.randrange(6) for _ in range(300)]
    words = np.array(words[:200] + words[50:150] + words, dtype=np.int64)
    names = period_runs._pairs(period_runs._pairs(words, 1), 2)
    chosen = set(period_runs.synchronising(names, 4, np.zeros(len(names), bool)).tolist())
    contexts = {}
    for i in range(len(words) - 8 + 1):
        contexts.setdefault(tuple(words[i:i + 8]), set()).add(i in chosen)
        assert i + 12 > len(words) or any(j in chosen for j in range(i, i + 4))
    assert all(len(v) == 1 for v in contexts.values())


def test_runs_query_on_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("n_chars < 6000").collect()}
    found = queries.op13_period_runs(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.n_runs > 0 for r in found) > 50
    assert all(tuple(r) == brute_report(r.doc_id, texts[r.doc_id]) for r in found if r.doc_id in texts)


def test_runs_of_awkward_rows(spark):
    long = " ".join(["x y z"] * 30_000 + [f"w{i}" for i in range(50_000)])
    rows = [(i, "a b c d " * 9 + f"e{i}") for i in range(40)] + [(50, None), (51, ""), (52, " \n"), (53, "a " * 6), (54, "a " * 5), (None, "a b " * 4), (None, None),
                                                                 (53, "a " * 6), (55, " a " * 7), (-1, "q r " * 8)]
    frame = docs_of(spark, rows)
    assert sorted(map(tuple, period_runs.detect(frame, plant=True, texts=False).collect()), key=str) == sorted((brute_report(*r) for r in rows), key=str)
    whole = {r.doc_id: r for r in period_runs.detect(docs_of(spark, [(1, long), (2, "k a b a b a b a b a z")])).collect()}
    assert [tuple(x) for x in whole[1].runs] == [(0, 90_000, 3)] and whole[1].collapsed.startswith("x y z w0 w1 ")
    assert [tuple(x) for x in whole[2].runs] == [(1, 9, 2)] and whole[2].collapsed == "k a b z"
    assert period_runs.detect(frame.limit(0)).count() == 0
