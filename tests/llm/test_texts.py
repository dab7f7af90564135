"""Language identification, URL filter, mixing, PII, decontamination, quotes."""
import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import alnum_words, blank_words, edge_rows, prose, table
from millrace.llm import decontam, langid, mixing, pii, quotes, textscan, url_filter
from oracle_check import compare

# ------------------------------------------------------------ word scanning


@pytest.mark.parametrize("rule, words", [(textscan.NON_SPACE, blank_words), (textscan.ALNUM, alnum_words)])
def test_scan_finds_the_words(rule, words):
    texts = [r[1] for r in edge_rows()] + ["A-b  C\x0bd\x1c\x00e", "É9_x"]
    flat = [w if isinstance(w, bytes) else w.encode() for t in texts for w in words(t)]
    got, hashes, per = [], [], []
    for _, _, s in textscan.scan(texts, rule):
        got += [s.word(i) for i in range(len(s.hash))]
        hashes += s.hash.tolist()
        per += np.diff(s.first).tolist()
    assert got == flat and per == [len(words(t)) for t in texts]
    by = dict(zip(got, hashes))
    assert len(set(by.values())) == len(by) and all(by[w] == h for w, h in zip(got, hashes))
    assert (textscan.word_hash(list(by)) == np.array(list(by.values()), np.uint64)).all()


# ------------------------------------------------------------ languages

def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    got = langid.identify(table(spark, clash=True)).collect()
    assert len(got) == 14
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, r.score, r.accepted))
    for i in (0, 1, 2):
        assert by[i] == [("und", 0.0, False)]
    assert ("und", 0.0, False) in by[None] and all(r.held_out for r in got if r.doc_id is None)
    assert langid.identify(table(spark, [])).count() == 0
    unlabelled = langid.identify(table(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_language_ignores_everything_but_text(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    a = langid.identify(table(spark, rows)).select("doc_id", "lang_pred", "score").collect()
    b = langid.identify(table(spark, rows).withColumn("source", F.lit("z")).withColumn("n_chars", F.lit(1))).select(
        "doc_id", "lang_pred", "score").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_language_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << 10, 3)).astype(np.float32)
    texts = [None, "abc def", "", "été", prose(40, 1)]
    whole, has = langid.logits_of(texts, weights, (2, 3, 4), 1 << 10)
    assert has.tolist() == [False, True, False, True, True]
    for i, t in enumerate(texts):
        assert np.allclose(langid.logits_of([t], weights, (2, 3, 4), 1 << 10)[0][0], whole[i])


# ------------------------------------------------------------ URLs

URLS = [None, "", "nourl", "http://A.Net", "http://a.net/", "http://net/x", "https://x.example.net/en/a?b#c", "http://example.net/en",
        "http://EXAMPLE.com/de/1", "http://notexample.com/de/1", "https://a.b.org/fr/?q", "http://org/fr/", "http://x.org/FR/",
        "://h/p", "a://b://c/d", "http://h?x/y", "http://h#/en/", "http://h/p#x?y", "http://u@h:80/p", "http://é.net/ñ",
        "http://example.net/en/", "http://myexample.net/en/x"]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls_match_brute_force(spark):
    schema = "page_id long, url string, html string"
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(4, URLS[4], "again")]
    got = url_filter.filter_urls(table(spark, rows, clash=True, schema=schema)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(table(spark, [], schema=schema)).count() == 0
    none = url_filter.filter_urls(table(spark, [(1, "http://x.com/a", None)], schema=schema)).collect()
    assert none[0].verdict == "allow"


def test_url_model_learns_rules_it_did_not_see(spark):
    """Held-out accuracy: trained on a part of the rule-labelled URLs."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    h, p = url_filter.split_url(F.col("url"))
    rule, verdict = url_filter.longest_rule(F.col("h"), F.col("p"))
    rows = pages.select(h.alias("h"), p.alias("p")).select("h", "p", verdict.alias("v")).filter("v IS NOT NULL").limit(1000).toPandas()
    y = (rows.v == "block").to_numpy()
    w, b = url_filter.fit(rows.h[:600].tolist(), rows.p[:600].tolist(), y[:600], (3, 4, 5), 1 << 14)
    row, cell = url_filter.grams(rows.h[600:].tolist(), rows.p[600:].tolist(), (3, 4, 5), 1 << 14)
    guess = url_filter._scores(row, cell, len(rows) - 600, w, b) > 0
    assert (guess == y[600:]).mean() > 0.97


# ------------------------------------------------------------ mixing

def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(size.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * size[s]]
        for s in full or list(open_):
            target[s] = min(3.0 * size[s], level * weight[s])
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    return target


def test_targets_and_taken(spark):
    rows = edge_rows() + [(1000 + i, prose(10 + i % 200, i), "en", f"s{i % 7}" if i % 3 else "big", 1) for i in range(300)]
    got = mixing.mix_sources(table(spark, rows, clash=True), shard_words=3_000).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(blank_words(r[1]))
    target, taken = brute_targets(size), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    shards = Counter((r.source, r.shard) for r in got)
    for s in size:
        assert abs(taken[s] - target[s]) <= 48 * sum(k[0] == s for k in shards)
    again = mixing.mix_sources(table(spark, rows).repartition(5), shard_words=3_000).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_sainte_lague_is_the_highest_quotients(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        votes = [int(v) for v in rng.integers(0, 1000, 12) ** 2]
        seats = int(rng.integers(1, 60))
        df = spark.createDataFrame([(i, float(v), 0) for i, v in enumerate(votes)], "_key int, v double, g int")
        got = {r["_key"]: r["seats"] for r in mixing.sainte_lague(df, "v", F.lit(seats).cast("bigint"), ["g"], "seats").collect()}
        ranked = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats + 1)))[:seats]
        want = Counter(i for _, i in ranked)
        assert got == {i: want[i] for i in range(12)}


# ------------------------------------------------------------ personal data

CASES = ["", "a@b", "a@b.c@d.e", "x.@y.z-..q.r@s.t", "1.2.3.4.5.6.7.8", "1.2.3.45.6.7.8", "256.1.1.1 1.1.1.1", "0001.002.3.4",
         "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "+1 (456) 555-2186", "+12345678",
         "é😀 a.b@c.de 😀+1 (456) 555-2186..", "a" * 60000 + "@b." + "c." * 3000 + "d", "1 " * 9000, "1" * 9000, "a@" * 3000,
         "+1" + "(" * 5000, "a@b.c._x@d.e", "\n12 34\n4111 1111 1111 1111x", "@@a@b.c@d.e.f@",
         "+1 2 3 4 5 6 7 8 9 +44 20 7946 0958", "+4111 1111 1111 1111", prose(3000, 1)]


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 10_000 else []
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())][::-1]
        if 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(CASES)]
    got = {r.doc_id: r for r in pii.digest(pii.extract(table(spark, rows, clash=True))).collect()}
    for i, t in enumerate(CASES):
        want = brute_pii(t)
        if len(t) >= 10_000 and "@" in t:  # one address, which plain Python would search in quadratic time
            want = [(0, 0, len(t))] + want
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i].spans == text and got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in want) for j in range(4)]


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"please call phone number +1 (456) 555-{1000 + i} now") for i in range(20)]
    rows += [(100 + i, f"please call phone number 555-77{10 + i}, thanks") for i in range(3)]
    rows += [(200, "some other thing 12345678 here"), (201, None), (201, None), (None, "phone number 555-9999")]
    rows = [(*r, None, None, None) for r in rows]
    got = pii.digest(pii.extract(table(spark, rows, clash=True))).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.spans for r in got if r.n_found}
    assert found == {100: "phone:25:33", 101: "phone:25:33", 102: "phone:25:33", None: "phone:13:21"}
    out = pii.mask(table(spark, rows, clash=True))
    assert out.columns == table(spark, rows, clash=True).columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == "please call phone number [PHONE] now" and texts[100] == "please call phone number [PHONE], thanks"
    assert texts[200] == rows[23][1] and texts[201] is None and texts[None] == "phone number [PHONE]"
    assert out.count() == len(rows)


def test_pii_edges(spark):
    assert pii.digest(pii.extract(table(spark))).count() == 14
    assert pii.digest(pii.extract(table(spark, []))).count() == 0
    assert pii.mask(table(spark, [])).count() == 0


def test_rows_without_words_are_spread_over_shards(spark):
    rows = [(i, None if i % 2 else " ", "en", "blank", 0) for i in range(400)] + [(1000 + i, prose(50, i), "en", "b", 1) for i in range(4)]
    got = mixing.mix_sources(table(spark, rows), shard_rows=40).collect()
    blank = Counter(r.shard for r in got if r.source == "blank")
    assert len(got) == 404 and len(blank) == 10 and max(blank.values()) < 100
    assert all(r.taken == 0 for r in got if r.source == "blank") and sum(r.taken for r in got) > 0


# ------------------------------------------------------------ decontamination

def brute_hits(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for item, t in items:
            v = alnum_words(t)
            n = min(13, len(v))
            windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontamination_matches_brute_force(spark, block_words):
    items = [(1, prose(40, 50)), (2, prose(13, 51)), (3, "Harbour lantern"), (4, None), (5, ""), (5, prose(20, 52)),
             (None, prose(15, 53)), (10, prose(40, 50).upper()), (11, "moss"), (12, "...")]
    docs = [(r[0], r[1]) for r in edge_rows()[:-1]] + [
        (50, prose(200, 1) + " " + prose(40, 50)[20:200] + " " + prose(10, 2)), (51, prose(13, 51)), (52, prose(12, 51)),
        (53, prose(13, 51) + "-" + prose(13, 51)), (54, prose(15, 53) + " é"), (55, "été " + prose(20, 52))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("shard", "place", "items", "hits", "n_words"):
        df = df.withColumn(name, F.lit(1))
    got = decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_hits(docs, items)
    for r in got:
        assert sum(h.hi - h.lo for h in r.hits) >= r.n_hit


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [(1, prose(30, 1) + " gamma beta alpha nu mu theta zeta delta eta iota epsilon lambda kappa " + prose(30, 2)),
            (2, "alpha " + prose(100, 1) + " beta gamma delta epsilon zeta eta theta iota kappa lambda mu " + prose(90, 3) + " nu"), (3, item)]
    got = {r.doc_id: r for r in decontam.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert (got[1].n_near, got[1].n_hit) == (1, 0) and got[3].n_near == 0 and got[3].n_hit == 13


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_proximity_needs_only_the_rarest_terms(spark, parts):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [(1, prose(30, 1) + " " + item.replace("eta theta", "eta foreign") + " " + prose(30, 2)), (2, "theta " * 40),
            (3, prose(30, 3)), (4, "alpha " + prose(60, 4)), (5, prose(30, 5))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(parts, "doc_id")
    got = decontam.decontaminate(df, spark.createDataFrame([(7, item + " unheard")], "item_id long, text string"))
    assert {r.doc_id: (r.n_near, r.n_hit) for r in got.collect()} == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_decontamination_empty(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(table(spark), items).filter("n_hit > 0 OR contaminated").count() == 0
    assert decontam.decontaminate(table(spark, []), items).count() == 0


# ------------------------------------------------------------ quotations

TURNS = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, thanks\n"),
         (1, 2, "user", "> > How are you?\n> Fine, thanks\nGood.\n> nothing like it"), (1, 2, "user", "same key"),
         (2, 0, "user", ">Hello  THERE!\nnew one"), (None, 1, "user", "> Fine, thanks"), (3, None, "x", "a"), (3, 1, None, None),
         (3, 2, "u", ""), (3, 3, "u", ">\n>>\n> Good.\n\nx\n\n"), (4, 0, "u", "> new one"), (4, 1, "u", "> new one\nzz"),
         (4, 2, "u", "> zz\n> Hello there"), (5, 0, "u", "l\r\n" * 3000), (5, 1, "u", "> l\n" * 3000 + "é Ñ"), (6, 0, "u", "> é ñ\n> É Ñ")]


def test_quotes_match_sql(spark):
    from millrace.llm.queries import op8_sql
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(TURNS, schema)
    out = quotes.format_chats(df.withColumn("path", F.lit(1)).withColumn("h", F.lit(1)).withColumn("level", F.lit(1)), min_words=1)
    con = duckdb.connect()
    pdf = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", pa.Table.from_pandas(pdf))
    assert compare(out, con, op8_sql(1))["ok"]
    by = {(r.conv_id, r.turn): r for r in out.collect()}
    assert by[4, 2].path == "1:0/4:2" and by[3, 3].path == "1:0/1:1/1:2/3:3" and by[5, 1].text == "é Ñ"
    assert quotes.format_chats(spark.createDataFrame([], schema)).count() == 0


WRAPPED = [
    (1, 0, "user", "The press stops whenever the oil\ngets warm. We changed the pump\nlast week. Ok\n\nWhat else should we try next"),
    (1, 1, "assistant", "> The press stops whenever\n> the oil gets warm. We changed\n> the pump last week. Ok\n\nClean the filter first, then\nwatch the pressure for a day."),
    (1, 2, "user", "> > We changed the pump last\n> > week.\n> Clean the filter first, then watch\n> the pressure for a day.\nDone, and it helped."),
    (2, 0, "user", "> Ok\n> ok\nI agree"),                                             # short: not from another conversation
    (2, 1, "assistant", "> What else should we\n> try next\nRead the manual."),          # six words: linked across
    (2, 2, "user", ">\tI agree\n> \n> Read the\n> manual.\nThanks"),                     # two passages of two messages: more words
    (3, 0, "user", "> Clean the filter first, then\n\n> watch the pressure for a day.\nx\x01y\x02z"), (3, 1, "user", "> x y z\nno")]


def test_wrapped_quotes_are_linked_by_passage(spark):
    from millrace.llm.queries import ORACLES
    df = spark.createDataFrame(WRAPPED, "conv_id long, turn long, role string, text string")
    out = quotes.format_chats(df)
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pandas(df.toPandas()))
    assert compare(out, con, ORACLES["op8_chat_quotes"])["ok"]
    to = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in out.collect()}
    assert to == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (None, None), (2, 1): (1, 0),
                  (2, 2): (2, 1), (3, 0): (1, 1), (3, 1): (3, 0)}


def test_quotes_of_a_very_long_text(spark):
    import time
    text = "\n".join(f"line number {i} of the long message" for i in range(40000))
    rows = [(1, 0, "u", text), (1, 1, "u", "\n".join("> " + x for x in text.split("\n")) + "\nyes")]
    start = time.time()
    out = quotes.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    last = out.filter("turn = 1").first()
    assert (last.reply_conv, last.reply_turn, last.n_quoted, last.text) == (1, 0, 40000, "yes")
    assert time.time() - start < 90


def test_long_reply_chain(spark):
    rows = [(9, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)]
    out = quotes.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    last = out.filter("turn = 39").first()
    assert last.path == "/".join(f"9:{i}" for i in range(40)) and last.thread_turn == 0


def test_many_matches_in_one_text(spark):
    import time
    text = " ".join(f"{i % 200}.{i % 7}.{i % 251}.{i % 31}" for i in range(40_000))
    long_word = "x" * 300
    rows = [(1, text, None, None, None), (2, f"a {long_word} {'é' * 100} 77 b c 5", None, None, None)]
    began = time.monotonic()
    scanned = {r.doc_id: r for r in pii.scan_texts(table(spark, rows)).collect()}
    assert time.monotonic() - began < 20
    base = scanned[1].base
    assert len(base) == len(scanned[1].cands) == 40_000
    assert all(text[x.s:x.e] == x.m for x in base) and [x.s for x in base] == [c.s for c in scanned[1].cands]
    assert [c.w for c in scanned[2].cands] == [[long_word, "é" * 100], ["b", "c"]]
    met = pii._occurrences(pii.scan_texts(table(spark, rows))).collect()
    assert sum(r.kind == 1 for r in met) == 40_000 and sorted(r.i for r in met if r.kind is None) == ["5", "77"]


def test_candidates_meet_spans_by_position(spark):
    rng = np.random.default_rng(5)
    parts = ["a@b.co", "x1", "10.0.0.1", "<10.0.0.1,10.0.0.2>", "+1 (456) 555-1234", "4111 1111 1111 1111", "word", "9", "id:7@z"]
    texts = [" ".join(rng.choice(parts, 30)) for _ in range(20)]
    rows = pii.scan_texts(table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]))
    want = []
    for r in rows.collect():
        for c in r.cands:
            if c.e > c.s and not any(x.s < c.s < x.e for x in r.base):
                seed = next((x for x in r.base if c.s <= x.s < c.e), None)
                want.append((r._row, c.s, c.e, seed.m.lower() if seed else c.i, seed.k if seed else None))
    got = [(r._row, r.s, r.e, r.i, r.kind) for r in pii._occurrences(rows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(k is not None for *_, k in got)
