"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the documents into shards of about 1 MB of text and
stores, for each shard, its sorted term dictionary, every term's posting list
(word positions over the shard, one free place between documents) and the
shard's documents. A shard is a row, so a frequent term is spread over all
shards and no posting list is ever gathered in one place.

``search`` sends blocks of test windows (a stated query set, at most
``block_words`` words a block) to all shards. In a shard a window starts from
its rarest term there: that term's postings, moved by the term's offset, are
the candidate starts, and each further term, in order of growing frequency,
keeps the starts that are also in its own moved list. What is left after the
last term are exact phrase matches. A proximity match of a window is a place
where its three rarest terms, by their frequency in the whole index and among
those that occur in it, stand within ``near`` words of the rarest, in any order,
in one document. The window's other terms need not occur, and how documents are
dealt to shards has no effect.

Defined cases: a null or wordless text has no words and matches nothing; an
item of fewer words than a window is one window, an empty item none; repeated
documents are judged row by row; items that share an id count once; a null
item_id counts as the id ''; empty tables give empty or clean results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialize
from .textscan import ALNUM, scan

#: Words a window holds.
WINDOW = 13
#: candidate starts looked at once within a shard
CANDIDATES = 1_000_000

INDEX = ("shard string, doc_ids array<long>, text_keys array<long>, doc_words array<int>, terms binary, "
         "counts binary, positions binary")
MATCHES = ("shard string, place int, items array<string>, "
           "hits array<struct<lo: int, hi: int>>, near array<string>")


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: one row per shard of ``docs`` (doc_id, text)."""
    @giving_back
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b["doc_id"].astype("Int64")
            for lo, hi, s in scan(b["text"].tolist(), ALNUM):
                words = np.diff(s.first)
                position = np.arange(len(s.hash)) + np.repeat(np.arange(hi - lo), words)
                order = np.argsort(s.hash, kind="stable")
                terms, counts = np.unique(s.hash[order], return_counts=True)
                yield pd.DataFrame({
                    "shard": [f"{part}-{made}"],
                    "doc_ids": [[None if x is pd.NA else int(x) for x in ids.iloc[lo:hi]]],
                    "text_keys": [b["text_key"].iloc[lo:hi].to_numpy()],
                    "doc_words": [words.astype(np.int32)], "terms": [terms.tobytes()],
                    "counts": [counts.astype(np.int32).tobytes()],
                    "positions": [position[order].astype(np.int32).tobytes()]})
                made += 1

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                   F.xxhash64("text").alias("text_key")).mapInPandas(build, INDEX), "postings",
                       **{"parquet.block.size": str(16 << 20)})  # rows are about 3 MB


class Windows:
    """The windows of a block of items: terms (rows x WINDOW, 0 past a window's
    length), length and item of each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int):
        terms, length, item = [], [], []
        for name, words in items:
            n = min(size, len(words))
            for o in range(len(words) - n + 1 if n else 0):
                terms.append(np.pad(words[o:o + n], (0, size - n)))
                length.append(n)
                item.append(name)
        self.terms = np.array(terms, dtype=np.uint64).reshape(len(terms), size)
        self.length = np.array(length, dtype=np.int64)
        self.item = np.array(item, dtype=object)
        #: the three rarest terms, and whether a window has three that occur
        self.rare, self.has = self.terms[:, :3], np.zeros(len(length), dtype=bool)

    def rank(self, terms: np.ndarray, counts: np.ndarray) -> None:
        """Set the three rarest terms by ``counts`` of the ordered ``terms``."""
        if not len(terms) or not len(self.length) or self.terms.shape[1] < 3:
            return
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        used = (np.arange(self.terms.shape[1]) < self.length[:, None]) & (terms[at] == self.terms)
        count = np.where(used, counts[at], np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")[:, :3]
        self.rare = np.take_along_axis(self.terms, order, 1)
        self.has = np.take_along_axis(used, order, 1).all(1)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] numbers) for every i, in one array."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class Shard:
    """A shard's postings: those of term t are positions[first[t]:first[t + 1]]."""

    def __init__(self, row):
        self.words = np.asarray(row.doc_words, dtype=np.int64)
        self.doc_lo = np.cumsum(self.words + 1) - self.words - 1
        self.terms = np.frombuffer(row.terms, np.uint64)
        counts = np.frombuffer(row.counts, np.int32)
        self.first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.positions = np.frombuffer(row.positions, np.int32)
        #: the term at each position: start s is in a term's list moved by offset o
        #: exactly if term_at[s + o] is the term
        self.term_at = np.full(int((self.words + 1).sum()) + 64, -1, dtype=np.int32)
        self.term_at[self.positions] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)

    def candidates(self, w: Windows) -> Iterator[tuple]:
        """Runs of (window numbers, their terms and offsets by growing frequency,
        candidate's window, anchor position) for windows whose terms all occur."""
        if not len(self.terms) or not len(w.length):
            return
        at = np.minimum(np.searchsorted(self.terms, w.terms), len(self.terms) - 1)
        used = np.arange(w.terms.shape[1]) < w.length[:, None]
        rows = np.flatnonzero(((self.terms[at] == w.terms) | ~used).all(1))
        if not len(rows):
            return
        count = np.where(used[rows], np.diff(self.first)[at[rows]], np.iinfo(np.int64).max)
        offset = np.argsort(count, axis=1, kind="stable")
        term = np.take_along_axis(at[rows], offset, 1)
        size = np.diff(self.first)[term[:, 0]]
        run = np.cumsum(size) // CANDIDATES
        for r in np.unique(run):
            k = np.flatnonzero(run == r)
            anchor = self.positions[_ranges(self.first[term[k, 0]], size[k])].astype(np.int64)
            yield rows, term, offset, np.repeat(k, size[k]), anchor

    def exact(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact phrase match."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows, term, offset, k, anchor in self.candidates(w):
            start = anchor - offset[k, 0]
            keep = start >= 0
            k, start = k[keep], start[keep]
            for j in range(1, w.terms.shape[1]):
                keep = (j >= w.length[rows[k]]) | (self.term_at[start + offset[k, j]] == term[k, j])
                k, start = k[keep], start[keep]
            found.append((rows[k], start))
        return tuple(np.concatenate(x) for x in zip(*found))

    def close(self, w: Windows, near: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, anchor) where the three rarest terms stand within ``near``."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        width = np.int64(len(self.term_at) + 2 * near)
        key = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.first)) * width + self.positions
        if not len(self.terms) or not w.has.any():
            return found[0]
        at = np.minimum(np.searchsorted(self.terms, w.rare), len(self.terms) - 1)
        rows = np.flatnonzero((self.terms[at] == w.rare).all(1) & w.has)
        size = np.diff(self.first)[at[rows, 0]]
        run = np.cumsum(size) // CANDIDATES
        for r in np.unique(run):
            own = np.flatnonzero(run == r)
            k = np.repeat(rows[own], size[own])
            anchor = self.positions[_ranges(self.first[at[rows[own], 0]], size[own])].astype(np.int64)
            doc = np.searchsorted(self.doc_lo, anchor, side="right") - 1
            lo = np.maximum(anchor - near, self.doc_lo[doc])
            hi = np.minimum(anchor + near, self.doc_lo[doc] + self.words[doc] - 1)
            keep = np.ones(len(k), dtype=bool)
            for j in (1, 2):
                base = at[k, j] * width
                keep &= np.searchsorted(key, base + lo) < np.searchsorted(key, base + hi, side="right")
            found.append((k[keep], anchor[keep]))
        return tuple(np.concatenate(x) for x in zip(*found))


def match(row, w: Windows, near: int) -> pd.DataFrame | None:
    """The matches of one shard, one row per document that has any."""
    s = Shard(row)
    win, start = s.exact(w)
    cwin, anchor = s.close(w, near)
    doc = np.searchsorted(s.doc_lo, start, side="right") - 1
    cdoc = np.searchsorted(s.doc_lo, anchor, side="right") - 1
    out = []
    order, corder = np.argsort(doc, kind="stable"), np.argsort(cdoc, kind="stable")
    doc, win, start, cdoc, cwin = doc[order], win[order], start[order], cdoc[corder], cwin[corder]
    for d in np.union1d(doc, cdoc):
        i = slice(*np.searchsorted(doc, [d, d + 1]))
        c = slice(*np.searchsorted(cdoc, [d, d + 1]))
        lo = start[i] - s.doc_lo[d]
        hit = np.zeros(int(s.words[d]) + 1, dtype=np.int32)
        np.add.at(hit, lo, 1)
        np.add.at(hit, lo + w.length[win[i]], -1)
        flag = np.diff(np.concatenate(([0], (np.cumsum(hit) > 0).astype(np.int8))))
        items = set(w.item[win[i]])
        out.append((row.shard, int(d), sorted(items),
                    [{"lo": int(a), "hi": int(b)} for a, b in
                     zip(np.flatnonzero(flag == 1), np.flatnonzero(flag == -1))],
                    sorted(set(w.item[cwin[c]]) - items)))
    return pd.DataFrame(out, columns=["shard", "place", "items", "hits", "near"]) if out else None


def query_blocks(items: DataFrame, size: int, block_words: int) -> Iterator[Windows]:
    """The items' windows in blocks; an item of more words is cut into pieces
    that overlap by a window less one word, so no window is lost."""
    block: list[tuple[str, np.ndarray]] = []
    words = 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    for r in rows.toLocalIterator():
        for _, _, s in scan([r["text"]], ALNUM):
            for o in range(0, max(1, len(s.hash) - size + 1), block_words):
                piece = s.hash[o:o + block_words + size - 1]
                if words and words + len(piece) > block_words:
                    yield Windows(block, size)
                    block, words = [], 0
                block.append((r["i"], piece))
                words += len(piece)
    yield Windows(block, size)


def term_counts(index: DataFrame, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(terms of the windows that occur, in order; how often in the whole index)."""
    sent = index.sparkSession.sparkContext.broadcast(np.unique(w.terms))

    @giving_back
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = sent.value
        total = np.zeros(len(wanted), dtype=np.int64)
        for b in batches:
            for terms, counts in zip(b["terms"], b["counts"]):
                terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32)
                if len(terms) and len(wanted):
                    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    total += np.where(terms[at] == wanted, counts[at], 0)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": wanted[some].view(np.int64), "c": total[some]})

    got = (index.select("terms", "counts").mapInPandas(part, "term long, c long")
           .groupBy("term").agg(F.sum("c").alias("c")).toPandas())
    term = got["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(term)
    return term[order], got["c"].to_numpy(np.int64)[order]


def search(index: DataFrame, items: DataFrame, size: int = WINDOW, near: int = 26,
           block_words: int = 200_000) -> DataFrame:
    """Matches by (shard, place of the document in it): items, hit word spans
    (lo up to, not including, hi) and items with proximity matches only."""
    found = None
    for w in query_blocks(items, size, block_words):
        w.rank(*term_counts(index, w))
        sent = index.sparkSession.sparkContext.broadcast(w)

        @giving_back
        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                for row in b.itertuples(index=False):
                    got = match(row, sent.value, near)
                    if got is not None:
                        yield got

        part = (index.select("shard", "doc_words", "terms", "counts", "positions")
                .mapInPandas(run, MATCHES))
        found = part if found is None else found.unionByName(part)
    return found


def _covered(spans: str) -> str:
    """SQL: number of words in the union of an array of (lo, hi) spans."""
    return (f"aggregate(array_sort({spans}), named_struct('n', 0L, 'to', 0), (a, x) -> named_struct("
            "'n', a.n + greatest(0, x.hi - greatest(x.lo, a.to)), 'to', greatest(a.to, x.hi)), a -> a.n)")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: int = 26,
                  block_words: int = 200_000) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), n_words, n_hit,
    n_items, items_sha256, contaminated, n_near (items with proximity matches
    only), items, hits (word spans)."""
    index = build_index(docs)
    found = (search(index, items, size, near, block_words).groupBy("shard", "place")
             .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                  F.flatten(F.collect_list("hits")).alias("_spans"),
                  F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    rows = (index.select("shard", "doc_words", "text_keys", F.posexplode("doc_ids").alias("place", "doc_id"))
            .select("shard", "place", "doc_id", F.get("text_keys", F.col("place")).alias("text_key"),
                    F.get("doc_words", F.col("place")).cast("long").alias("n_words")))
    none = F.array().cast("array<string>")
    return (rows.join(found, ["shard", "place"], "left")
            .withColumn("items", F.coalesce("items", none))
            .withColumn("n_hit", F.when(F.col("_spans").isNull(), F.lit(0)).otherwise(
                F.expr(_covered("_spans"))).cast("long"))
            .select("doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
                    F.coalesce(F.size(F.array_except("near", "items")), F.lit(0)).cast("long").alias("n_near"),
                    "items", F.coalesce("_spans", F.array().cast("array<struct<lo: int, hi: int>>")).alias("hits")))
