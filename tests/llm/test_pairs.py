"""Embedding near-duplicates and the n-gram Jaccard join against brute force."""
from fractions import Fraction

import numpy as np
import pytest

from helpers import blank_words, edge_rows, prose, table
from millrace.llm import graph, jaccard, neardup

VECS = "vec_id long, embedding array<float>, label int"


def components(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def jaccard_brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = blank_words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = components(len(rows), pairs)
    links = [sum(i in p for p in pairs) for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        group = min(ids) if ids and sets[i] else r[0]
        out.append((str(r[0]), links[i], str(group), r[0] == group))
    return sorted(out)


def near_copies():
    rows = []
    for g in range(6):
        words = prose(120, 100 + g).split()
        for c in range(g + 2):
            w = list(words)
            for k in range(c):
                w[(17 * k + c) % 120] = f"new{g}{c}{k}"
            rows.append((len(rows) + 100, " ".join(w), "en", "a", 1))
    return rows


@pytest.mark.parametrize("slice_rows", [256, 3])
def test_jaccard_matches_brute_force(spark, monkeypatch, slice_rows):
    if slice_rows == 3:
        monkeypatch.setattr(jaccard, "SLICE", 3)
        monkeypatch.setattr(jaccard.in_tiles, "__defaults__", (3,))
    rows = edge_rows() + near_copies() + near_copies()[:4]
    got = jaccard.join_groups(table(spark, rows, clash=True)).collect()
    assert sorted((str(r.doc_id), r.n_links, str(r.group_id), r.kept) for r in got) == jaccard_brute(rows)


def test_jaccard_empty(spark):
    assert jaccard.join_groups(table(spark, [])).count() == 0


def test_pruning_bound_is_the_posterior():
    from math import comb
    t, eps = Fraction(4, 5), 1e-6
    for n, m in zip((16, 96), jaccard.least_equal(t, eps, [16, 96])):
        tail = lambda k: sum(comb(n + 1, i) * 0.8 ** i * 0.2 ** (n + 1 - i) for i in range(k + 1))  # noqa: E731,B023
        assert tail(m) >= eps > tail(m - 1)


def test_shared_counts_both_ways():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(80)]
    a, b = np.triu_indices(80, 1)
    want = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (jaccard.shared_counts(sets, a, b) == want).all()
    few = np.arange(0, len(a), 40)
    assert (jaccard.shared_counts(sets, a[few], b[few]) == want[few]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (-5, 100), (7, 7)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: -5, 50: -5, 75: -5, -5: -5}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def embed_brute(rows, t=0.95):
    ok, unit = [], []
    for _, e, _ in rows:
        v = np.array([np.nan if x is None else x for x in e], dtype=np.float32).astype(float) if e else np.zeros(0)
        good = len(v) > 0 and np.isfinite(v).all() and v.any()
        ok.append(good)
        unit.append(v / np.linalg.norm(v) if good else v)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)
             if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t]
    root = components(len(rows), pairs)
    out = []
    for i, r in enumerate(rows):
        comp = min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None)
        out.append((str(r[0]), sum(i in p for p in pairs), str(comp), r[0] == comp))
    return sorted(out)


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        for _ in range(1 + 4 * (g % 4)):
            rows.append((len(rows), (centre + 0.06 * rng.normal(size=16)).astype(np.float32).tolist(), g))
    rows += [(500 + i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(60)]
    rows += [(900, rows[3][1], 1), (901, rows[3][1], 1), (901, rows[3][1], 1), (None, rows[5][1], 1)]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] + [1.0] * 15, 0),
             (1004, [float("inf")] + [1.0] * 15, 0), (1005, [None] + [1.0] * 15, 0), (1006, [1.0, 2.0], 0),
             (1007, [2.0, 4.0], 0), (1008, [1e30, 2e30], 0), (1009, [1e-30, 2e-30], 0)]
    return rows


def test_embeddings_match_brute_force(spark):
    rows = vectors()
    got = neardup.link(table(spark, rows, clash=True, schema=VECS)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == embed_brute(rows)


def test_links_between_full_lists(spark):
    # clusters of 20 whose lists hold only the own cluster; neighbours on a ring link at 0.97
    rng, rows = np.random.default_rng(11), []
    step = np.arccos(0.97)
    for c in range(4):
        centre = np.zeros(16)
        centre[:2] = np.cos(c * step), np.sin(c * step)
        for _ in range(20):
            rows.append((len(rows), (centre + 0.002 * rng.normal(size=16)).astype(np.float32).tolist(), c))
    got = neardup.link(table(spark, rows, schema=VECS)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == embed_brute(rows)


def test_audit_sees_small_groups_beside_a_large_one(spark):
    rng, rows = np.random.default_rng(12), []
    hot = rng.normal(size=16)
    rows += [(i, (hot + 0.01 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(300)]
    for g in range(60):
        centre = rng.normal(size=16)
        rows += [(1000 + 2 * g + i, (centre + 0.01 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(2)]
    got = table(spark, rows, schema=VECS).selectExpr("vec_id", "vec_id AS node", "transform(embedding, x -> double(x)) AS embedding")
    nodes = neardup.nodes_of(got)
    every = graph.connected_components(neardup.all_edges(nodes, 0.95, rows=100))
    assert every.count() == 420 and neardup.audited(nodes, every, 0.95, 500, 9) == (1.0, True)
    # a draw bounded by bytes: too few to measure, and told so
    few = neardup.audited(nodes, every, 0.95, 500, 9, room=8 * 16 * 30)
    assert few[0] == 1.0 and few[1] is False
    small = neardup.all_edges(nodes, 0.95, rows=400, room=8 * 16 * 50)
    assert sorted(graph.connected_components(small).collect()) == sorted(every.collect())
    # half of the pairs are not found: 120 of some 90,000 pairs, but of 120 nodes outside the large group 60
    some = every.filter("id < 1000 OR id >= 1060")
    assert neardup.audited(nodes, some, 0.95, 500, 9)[0] < 0.6


def test_unmeasured_recall_is_null(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).tolist(), 0) for i in range(400)]
    got = neardup.link(table(spark, rows, schema=VECS)).collect()
    assert {r.recall for r in got} == {1.0}             # every node was drawn
    real = neardup.audited
    monkeypatch.setattr(neardup, "audited", lambda *a: real(*a, room=8 * 32 * 20))
    got = neardup.link(table(spark, rows, schema=VECS)).collect()
    assert {r.recall for r in got} == {None} and all(r.n_links == 0 and r.kept for r in got)


def test_tables_hold_the_miss_probability():
    for total in (2_000, 100_000, 10_000_000):
        bits = neardup.bucket_bits(total)
        apart = 1 - (1 - np.arccos(0.95) / np.pi) ** bits
        assert apart ** neardup.tables_for(bits, 0.95, 0.01, 4) <= 0.01


def test_embeddings_empty(spark):
    assert neardup.link(spark.createDataFrame([], VECS)).count() == 0
    assert neardup.link(spark.createDataFrame([(1, None, 0)], VECS)).collect()[0].n_links == 0


def test_recall_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    extra = [(10_000 + i, (np.array(rows[i % 200][1]) + 0.02 * rng.normal(size=64)).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += extra
    want = {r[0]: r[1] for r in embed_brute(rows)}
    got = neardup.link(spark.createDataFrame(rows, VECS)).collect()
    found, true = sum(r.n_links for r in got), sum(want.values())
    assert true > 300 and found <= true and found / true >= 0.97


def test_a_task_returns_its_freed_memory():
    # blocks that outlive the task lie above the freed ones
    from millrace.llm.common import giving_back
    kept = []

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    @giving_back
    def part(batches):
        for b in batches:
            held = [bytes(2000) for _ in range(60_000)]
            kept.append([bytes(2000) for _ in range(10)])
            assert resident() > before + 80 and held
            yield b

    before = resident()
    assert list(part(iter([1]))) == [1]
    assert resident() < before + 40
