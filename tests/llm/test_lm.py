import math
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import blank_words, edge_rows, prose, table
from millrace.llm import lm

FAST = {"rounds": 1, "least_steps": 5, "every": 512}


def expected(rows):
    texts = [(d, blank_words(t) + [None]) for d, t, *_ in rows]
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in texts]
    c = Counter(w for (_, ws), h in zip(texts, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    z = math.log10(n + 0.1 * (v + 1))
    return sorted((str(d), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10(c[w] + 0.1) - z for w in ws), 4))
                  for (d, ws), h in zip(texts, held))


@pytest.mark.parametrize("frequent", [500_000, 3])
def test_base_matches_brute_force(spark, frequent):
    got = lm.score(table(spark, clash=True), frequent=frequent, **FAST).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
                  for r in got) == expected(edge_rows())
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty(spark):
    assert lm.score(table(spark, []), **FAST).count() == 0


def model(seed=1, classes=12):
    counts = np.zeros(lm.END + 1)
    counts[:40] = np.arange(40, 0, -1)
    counts[lm.END] = 5
    return lm.Model(counts, classes, 4, 3, seed, 7)


def test_windows_score_each_token_once_and_only_see_the_past():
    m = model()
    ids = np.random.default_rng(2).integers(0, 40, 50)
    first = np.array([0, 1, 20, 50])
    x, y, place = m.blocks(m.symbol[ids], first)
    assert sorted(place[place >= 0]) == list(range(50))
    got = m.log_prob(m.flat, x, y)
    # brute force, one token at a time: context is its window's past in its own text
    w = m.view(m.flat)
    for a, b in zip(first[:-1], first[1:]):
        seq = np.concatenate(([m.k], m.symbol[ids[a:b]]))
        for t in range(b - a):
            lo = max(0, t // m.s * m.s - m.s)
            past = [j for j in range(lo, t + 1)]
            s = np.array([w["q"][seq[t]] @ w["k"][seq[j]] + w["far"][t - j] for j in past])
            # before-the-text is read in the first window only
            s[[j == 0 and t >= m.s for j in past]] = -1e9
            p = np.exp(s - s.max())
            h = np.tanh((p / p.sum()) @ w["v"][seq[past]] + w["r"][seq[t]])
            z, z2, y_t = h @ w["u"] + w["b"], h @ w["u2"] + w["b2"], m.symbol[ids[a + t]]
            want = z[min(y_t, 6)] - np.log(np.exp(z).sum())
            want += z2[y_t - 6] - np.log(np.exp(z2).sum()) if y_t >= 6 else 0
            assert abs(want - got[place == a + t][0]) < 1e-4


def test_gradient_matches_differences():
    m = model()
    ids = np.random.default_rng(3).integers(0, 40, 25)
    x, y, place = m.blocks(m.symbol[ids], np.array([0, 10, 25]))
    used, flat = place >= 0, m.flat.astype(np.float64)

    def loss(f):
        return -(m.log_prob(f, x, y) * used).sum() / used.sum()

    g = m.gradient(flat, x, y, used)
    for i in np.random.default_rng(4).choice(len(flat), 40, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-3
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-3 - g[i]) < 2e-3


def wide_model():
    # head and tail of more outputs than one level takes
    counts = np.zeros(lm.END + 1)
    counts[:2000] = np.arange(2000, 0, -1)
    return lm.Model(counts, 400, 4, 3, 1, 100, np.arange(lm.END + 1)[::-1])


def test_a_state_meets_few_outputs():
    m = wide_model()
    most = max(np.prod(m.shapes[n][1:]) if len(m.shapes[n]) == 2 else m.shapes[n][2] for n in m.shapes if n.startswith("o"))
    assert most <= 2 * 400 ** 0.5


def test_probabilities_of_two_levels_add_up():
    m = wide_model()
    x = np.random.default_rng(5).integers(0, 400, (1, 6))
    each = [m.log_prob(m.flat, x, np.full((1, 3), k))[0] for k in range(400)]
    assert np.abs(np.exp(np.array(each, float)).sum(0) - 1).max() < 1e-4


def test_gradient_of_two_levels_matches_differences():
    m, rng = wide_model(), np.random.default_rng(6)
    x, y, used = rng.integers(0, 400, (9, 6)), rng.integers(0, 400, (9, 3)), rng.random((9, 3)) < 0.8
    flat = m.flat.astype(np.float64)

    def loss(f):
        return -(m.log_prob(f, x, y) * used).sum() / used.sum()

    g = m.gradient(flat, x, y, used)
    for i in np.argsort(-np.abs(g))[:300:8]:
        step = np.zeros_like(flat)
        step[i] = 1e-2
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-2 - g[i]) < 2e-3


def test_targets_of_one_kind_or_none_have_a_gradient():
    m, x = wide_model(), np.full((2, 6), 7)
    for y in (0, 399):
        assert np.isfinite(m.gradient(m.flat, x, np.full((2, 3), y), np.ones((2, 3), bool))).all()
    assert not m.gradient(m.flat, x, np.zeros((2, 3), int), np.zeros((2, 3), bool)).any()


def test_ids_have_a_distribution():
    m = model()
    rest = m.symbol == m.k - 1
    assert abs(np.exp(m.within[rest].astype(float)).sum() - 1) < 1e-3


def test_words_encode_alone_as_together():
    words = [w.encode() for w in ["the", "don't", "été", "漢字😀", "x" * 300, "1,000.5", "\xa0a\xa0", "@@", "\x1c\x1d"]]
    ids, first = lm.encode_words(words, lm.VOCABULARY)
    enc, _ = lm.encoder(lm.VOCABULARY)
    for i, w in enumerate(words):
        assert enc.decode_bytes(ids[first[i]:first[i + 1]].tolist()) == b" " + w


def test_training_helps_on_held_out_text(spark):
    rows = [(i, prose(120, i), "en", "a", 1) for i in range(60)]
    some = table(spark, rows)
    start = lm.score(some, rounds=0).filter("held_out").agg({"score": "sum"}).first()[0]
    done = lm.score(some, rounds=2, every=400).filter("held_out").agg({"score": "sum"}).first()[0]
    assert done > start


def test_every_window_of_every_text_trains(spark, monkeypatch, tmp_path):
    # short texts: what the tasks' models are given, over all rounds
    seen = str(tmp_path)

    class Noted(lm.Model):
        def improve(self, flat, x, y, used, *rest):
            import uuid
            np.save(f"{seen}/{uuid.uuid4().hex}.npy", np.array([used.sum()]))
            return flat

    counts = np.ones(lm.END + 1)
    rows = [(i, prose(20 + i, i), "en", "a", 1) for i in range(40)] + [(90, None, "en", "a", 1)]
    docs = table(spark, rows).selectExpr("doc_id", "text", "doc_id % 10 = 0 AS held_out")
    lm.train(docs, Noted(counts, 12, 4, 3, 1, 7), lm.VOCABULARY, 2, 16, 0.02, 5, 3)
    enc, _ = lm.encoder(lm.VOCABULARY)
    want = sum(len(enc.encode_ordinary(" " + t)) + 1 for d, t, *_ in rows if t is not None and d % 10)
    assert sum(int(np.load(f)[0]) for f in tmp_path.glob("*.npy")) == want


def test_held_out_text_scores_above_its_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs).groupBy("held_out").agg({"score": "sum", "base_score": "sum"}).collect()
    sums = {r["held_out"]: (r["sum(score)"], r["sum(base_score)"]) for r in got}
    assert sums[True][0] > sums[True][1], sums


def test_each_text_is_in_one_round(spark):
    # with rounds=3 the last round has seven of eight texts
    rows = [(i, "a b c", "en", "a", 1) for i in range(800)]
    docs = table(spark, rows).selectExpr("doc_id", "text", "false AS held_out")
    seen = []

    kept = lm.sum_arrays
    lm.sum_arrays = lambda rows, size: (lambda t: (seen.append(t[-1]), t)[1])(kept(rows, size))
    try:
        lm.train(docs, lm.Model(np.ones(lm.END + 1), 12, 4, 3, 1, 7), lm.VOCABULARY, 3, 16, 0.02, 1, 3)
    finally:
        lm.sum_arrays = kept
    each = seen[0] + seen[1] + seen[2]
    assert each == 800 * 4 and seen[2] > 5 * (seen[0] + seen[1]) and seen[1] > seen[0]


def test_arrays_add_up_over_many_partitions(spark):
    from pyspark import TaskContext
    import pandas as pd
    from millrace.llm.common import sum_arrays

    def part(batches):
        total = sum((np.array([b["id"].sum(), len(b)], float) for b in batches), np.zeros(2))
        yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "v": [total.tobytes()]})

    rows = spark.range(0, 1000, 1, 70).mapInPandas(part, "g int, v binary")
    assert sum_arrays(rows, 2, fan=4).tolist() == [499500.0, 1000.0]
    assert sum_arrays(rows.limit(0), 2).tolist() == [0.0, 0.0]
