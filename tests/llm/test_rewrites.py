"""Spelling variants, byte-level BPE, fill-in-middle."""
import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from helpers import edge_rows, prose, table
from millrace.llm import bpe, fim, spelling

# ------------------------------------------------------------ spelling variants


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    long, short = (u, v) if len(u) > len(v) else (v, u)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def variants(rows):
    """Brute force: all pairs of words."""
    total = Counter()
    for doc, text, *_ in rows:
        lower = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    links = {w: [] for w in n}
    for u, v in itertools.combinations(n, 2):
        if near(u, v):
            links[u].append(v)
            links[v].append(u)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, n[w], len(links[w]), form[w], n.get(form[w]), root(w)) for w in n}


def found_variants(df):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def misspelt(seed, n_docs=40):
    """Documents of few base words, with many edits of some of them."""
    r, rows = random.Random(seed), []
    base = ["station", "stations", "nations", "aaaaaaa", "aaaaaaaa", "größe×ig", "étéÿtéa", "lanterns"]
    for doc in range(n_docs):
        words = []
        for _ in range(120):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                at, kind = r.randrange(len(w)), r.randrange(3)
                w = w[:at] + ("" if kind == 0 else r.choice("asé")) + w[at + (kind != 1):]
            words += [w.upper() if r.random() < 0.1 else w] * r.choice([1, 1, 6])
        rows.append((doc, " ".join(words), "en", "a", 0))
    return rows


@pytest.mark.parametrize("tile_words", [512, 4])
def test_variants_match_all_pairs(spark, monkeypatch, tile_words):
    monkeypatch.setattr(spelling, "TILE_WORDS", tile_words)
    rows = misspelt(3)
    want = variants(rows)
    assert len(want) > 100 and sum(w[3] is not None and w[5] != w[3] for w in want) > 3
    assert found_variants(table(spark, rows)) == want


def test_variants_in_blocks_of_cells(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE_CELLS", 200)
    names = sorted({r[0] for r in variants(misspelt(5, 20))})
    got = set()
    for m in {len(x) + d for x in names for d in (0, 1)}:
        block = [x for x in names if len(x) in (m, m - 1)]
        for x, y in spelling._tile(block, m, 0, m):
            got |= {frozenset((block[i], block[j])) for i, j in zip(x, y)}
    assert got == {frozenset(p) for p in itertools.combinations(names, 2) if near(*p)}


def test_variant_edges(spark):
    rows = edge_rows()
    rows += [(50 + k, ("longest" * 400 + " ") * 6 + ("longest" * 400 + "x ") * 40, None, None, None) for k in range(2)]
    want = variants(rows)
    assert any(len(w[0]) > 2000 and w[3] for w in want)
    assert found_variants(table(spark, rows, clash=True)) == want
    assert found_variants(table(spark, [])) == set()
    assert found_variants(table(spark, [(1, None, None, None, None), (2, "", "", "", 0)])) == set()


def test_variants_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found_variants(docs) == variants([tuple(r) for r in docs.collect()])


# ------------------------------------------------------------ byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        file = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return bpe.Encoder(file, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, tokens):
    r = random.Random(11)
    for k in range(n):
        yield ("".join(r.choice("abcdeth ins") for _ in range(r.randint(0, 60))),
               "".join(chr(r.choice([r.randint(0, 0x2ff), r.randint(0x300, 0xd7ff), r.randint(0xe000, 0x10ffff)]))
                       for _ in range(r.randint(0, 20))),
               "".join(r.choice(tokens).strip() for _ in range(r.randint(0, 20))),
               r.choice("abx é漢0. \n") * r.randint(0, 300) + r.choice(tokens))[k % 4]


def test_ids_are_the_library_s(coder):
    own, library = coder
    tokens = [library.decode([i]) for i in range(0, 50_000, 7)]
    for text in [r[1] or "" for r in edge_rows()] + list(random_texts(3000, tokens)):
        assert own.ids(text).tolist() == library.encode_ordinary(text), repr(text)


def test_newer_letters_split_as_in_the_library(coder):
    own, library = coder
    for runs in (bpe.NEWER_LETTERS, bpe.NEWER_DIGITS):
        for run in runs.split():
            for c in map(chr, {int(x, 16) for x in run.split("-")}):
                text = f"a{c}a1{c}1 {c}!{c}!"
                assert own.ids(text).tolist() == library.encode_ordinary(text), hex(ord(c))


def test_transducer_is_rebuilt_when_full(coder, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    own, library = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN), coder[1]
    for k in range(20):
        text = prose(40, k) + " unrememberableness" * 3
        assert own.ids(text).tolist() == library.encode_ordinary(text)
    assert len(own.pieces) <= 20 and len(own.pieces.transducer.branches) < 200


def test_tokens_are_written_before_the_end(coder):
    machine = coder[0].pieces.transducer
    state, written = machine.start, 0
    for k, b in enumerate(b"notwithstanding" * 40):
        state, ids = machine._step(state, b)
        written += len(ids)
        assert all(len(done) <= 40 for _, done in machine.branches[state])
    assert written > 100


def test_utf8_stream_equals_decoding_at_once():
    r = random.Random(4)
    for _ in range(4000):
        data = bytes(r.choice([r.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0x41, 0xED, 0xA0])
                     for _ in range(r.randint(0, 14)))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = r.randint(1, 3)
            out += stream.feed(data[at:at + step])
            at += step
        assert out + stream.close() == data.decode("utf-8", "replace")


def test_round_trip_of_edge_rows(spark, coder, monkeypatch):
    docs = table(spark, clash=True)
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "ids"]
    back = bpe.decode(coded, RANKS).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in edge_rows())
    assert all(r.ids == coder[1].encode_ordinary(r.text) for r in back)
    both = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded_col="row").collect()
    assert Counter((r.doc_id, tuple(r.ids), r.row) for r in both) == Counter((r.doc_id, tuple(r.ids), r.text) for r in back)
    assert bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [50_300, None, -1]), (3, [])], "k int, ids array<int>")
    assert [tuple(r) for r in bpe.decode(odd, RANKS).select("k", "text").orderBy("k").collect()] == [
        (1, None), (2, "���"), (3, "")]


def test_bpe_query_on_the_given_documents(spark, coder):
    import __spark_entry__ as entry
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for r in docs:
        ids = coder[1].encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")] += 1
    got = entry.queries()["op12_bpe_round_trip"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want


# ------------------------------------------------------------ fill-in-middle

@pytest.mark.parametrize("error", [0, 3, 2000])
def test_rank_index_is_exact(error):
    r = np.random.default_rng(3)
    for steps in (np.ones(5000, int), r.integers(0, 300, 4000), r.geometric(0.0005, 3000),
                  np.repeat([1, 9000, 0, 40], 700), np.zeros(0, int), np.array([10 ** 9, 1, 10 ** 9])):
        offsets = np.append(0, np.cumsum(steps)).astype(np.int64)
        index = fim.RankIndex(offsets, error)
        ranks = r.permutation(len(offsets))
        assert (index.offset(ranks) == offsets[ranks]).all()
        assert np.abs(index.residual.astype(int)).max() <= error + 1
    assert len(fim.RankIndex(np.arange(0, 10 ** 6, 7)).first) == 1


def cut(doc, text, seed=7, rate=100, spm_rate=50):
    """Brute force by lists of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, len(lines), "plain", None, None, text
    a, b = sorted(k % (len(lines) + 1) for k in h[:2])
    p, m, s = ("".join(part) for part in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm_rate:
        return doc, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    r, rows = random.Random(2), edge_rows()
    for k in range(300):
        text = "".join(r.choice(["\n", "a\n", "é漢😀\n", "<", "P>", "<S", ">\n", "\r\n", "x" * r.randint(0, 5000), "<M>"])
                       for _ in range(r.randint(0, 30)))
        rows.append((k, text, None, None, None))
    return rows


@pytest.mark.parametrize("kind", [{}, {"rate": 40, "spm_rate": 0, "seed": 3}])
def test_fim_matches_lists_of_lines(spark, kind):
    out = fim.fill_in_middle(table(spark, fim_rows(), clash=True), **kind)
    got = out.select("*", fim.restore(F.col("output"), F.col("form")).alias("restored")).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(cut(r[0], r[1], **kind) for r in fim_rows())
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((r[0], r[1] or "") for r in fim_rows())
    assert {r.form for r in got} == ({"plain", "spm", "psm"} if not kind else {"plain", "psm"})
    assert fim.fill_in_middle(table(spark, [])).count() == 0


def test_fim_keeps_other_id_types(spark):
    docs = spark.createDataFrame([("k1", "a\nb\n"), (None, "c")], "name string, body string")
    got = fim.fill_in_middle(docs, id_col="name", text_col="body").collect()
    assert {tuple(r) for r in got} == {cut("k1", "a\nb\n"), cut(None, "c")}
