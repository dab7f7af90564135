"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Rows of equal word sequence form one
class, and only class representatives are compared:

1. One scan gives every row its class and a MinHash signature; bands of the
   signature are the candidate buckets. Buckets with the same members count
   once, and a bucket of many members is cut into tiles, pairs of slices.
2. In a tile, signatures are compared a block at a time. After n compared
   values with m equal ones, and a uniform prior, P(similarity >= t) is
   P(Binomial(n + 1, t) <= m); pairs for which it falls below ``tolerance``
   are dropped. Pairs that last are never rows: a tile returns the forest that
   spans them, and forests give connected groups of class representatives.
3. Inside a group all pairs are pruned in the same way and the rest verified
   exactly on the whole shingle sets. A verified pair lies in one group and
   one tile, so links are counted once, in the task, as sums for each class.

A pair at similarity t is missed only if it agrees in no band (3e-6 at 0.8)
or is pruned (``tolerance`` a block).

Defined cases: A-Z are lower-cased, words are cut at blanks; a text of one to
four words is one shingle; a null or wordless text is linked with nothing,
also not with its like; a null doc_id is kept as it is; repeated rows are
members of one class; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back, materialize, small_side
from .graph import connected_components
from .textscan import NON_SPACE, SMALL_SLICE_BYTES, mix, scan

WORDS = 5
BANDS, ROWS = 24, 4
#: members of a slice, and rows of a bin of tiles that one task call handles
SLICE, BIN = 256, 2_000

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64))


class Shingled:
    """Shingle hashes of a run of texts; those of text i are first[i]:first[i + 1]."""

    def __init__(self, s):
        words = np.diff(s.first)
        count = np.where(words >= WORDS, words - WORDS + 1, (words > 0).astype(np.int64))
        self.first = np.concatenate(([0], np.cumsum(count)))
        n = len(s.hash)
        padded = np.concatenate((s.hash, np.zeros(WORDS, np.uint64)))
        end = np.repeat(s.first[1:], words)
        at = np.arange(n)
        value = np.zeros(n, np.uint64)
        for j in range(WORDS):
            value += np.where(at + j < end, padded[j:j + n] * _PLACE[j], np.uint64(0))
        start = at - np.repeat(s.first[:-1], words)
        self.hash = mix(value[start < np.repeat(count, words)])
        #: the class: the sum of every word's hash with its place
        cls = np.zeros(len(words), np.uint64)
        some = words > 0
        if n:
            placed = mix(s.hash + (start.astype(np.uint64) + np.uint64(1)) * _PLACE[63])
            cls[some] = mix(np.add.reduceat(placed, s.first[:-1][some]) + words[some].astype(np.uint64))
        self.node = cls.view(np.int64)
        self.some = some

    def signatures(self) -> np.ndarray:
        out = np.full((len(self.some), BANDS * ROWS), 0xFFFFFFFF, dtype=np.uint32)
        if len(self.hash):
            h = (self.hash >> np.uint64(32)).astype(np.uint32)
            starts = self.first[:-1][self.some]
            for k in range(BANDS * ROWS):
                out[self.some, k] = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], starts)
        return out


def _bands(sig: np.ndarray) -> np.ndarray:
    wide = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = (wide * _PLACE[:ROWS]).sum(2, dtype=np.uint64) + _PLACE[8:8 + BANDS]
    return mix(key).view(np.int64)


@giving_back
def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, keys = b["doc_id"].astype("Int64"), b["text_key"]
        for lo, hi, s in scan(b["text"].tolist(), NON_SPACE, run_bytes=SMALL_SLICE_BYTES):
            sh = Shingled(s)
            sig = sh.signatures()
            bands = _bands(sig)
            yield pd.DataFrame({
                "doc_id": ids.iloc[lo:hi].to_numpy(), "text_key": keys.iloc[lo:hi].to_numpy(),
                "node": pd.array(np.where(sh.some, sh.node, 0), dtype="Int64").copy()
                if sh.some.all() else pd.Series(sh.node).astype("Int64").where(sh.some, pd.NA),
                "sig": [x.tobytes() for x in sig], "bands": list(bands)})


@giving_back
def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for _, _, s in scan(b["text"].tolist(), NON_SPACE, run_bytes=SMALL_SLICE_BYTES):
            sh = Shingled(s)
            sig = sh.signatures()
            at = np.flatnonzero(sh.some)
            yield pd.DataFrame({
                "node": sh.node[at], "sig": [sig[i].tobytes() for i in at],
                "shingles": [np.unique(sh.hash[sh.first[i]:sh.first[i + 1]]).tobytes() for i in at]})


def least_equal(t: Fraction, tolerance: float, steps: list[int]) -> list[int]:
    """For each n of ``steps``: fewest equal values m with P(Bin(n + 1, t) <= m)
    of at least ``tolerance``."""
    out = []
    for n in steps:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * float(t) ** m * float(1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def lasting_pairs(sig: np.ndarray, a: np.ndarray, b: np.ndarray, t: Fraction, tolerance: float,
                  block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a[i], b[i]) of rows of ``sig`` that pruning leaves."""
    steps = list(range(block, sig.shape[1] + 1, block))
    same = np.zeros(len(a), dtype=np.int64)
    for n, least in zip(steps, least_equal(t, tolerance, steps)):
        same += (sig[a, n - block:n] == sig[b, n - block:n]).sum(1)
        keep = same >= least
        a, b, same = a[keep], b[keep], same[keep]
    return a, b


def tile_pairs(left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``left``, or between ``left`` and ``right``, in runs."""
    for i in range(0, len(left), 64):
        rows = left[i:i + 64]
        if right is None:
            a, b = np.meshgrid(np.arange(i, i + len(rows)), np.arange(len(left)), indexing="ij")
            keep = a < b
            yield left[a[keep]], left[b[keep]]
        else:
            a, b = np.meshgrid(rows, right, indexing="ij")
            yield a.ravel(), b.ravel()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each of n rows by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets a[i] and b[i]."""
    used, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = back[:len(a)], back[len(a):]
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    value = np.concatenate([sets[i] for i in used])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    many = np.diff(np.concatenate((start, [len(value)])))
    column = np.repeat(np.cumsum(many > 1) - 1, many)
    keep = np.repeat(many > 1, many)
    column, row = column[keep], row[keep]
    out = np.zeros(len(a), dtype=np.int64)
    width = 2_048
    cut = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    if len(a) * 8 < len(used) * len(used) and len(used) > 64:
        for i in range(len(a)):
            out[i] = len(np.intersect1d(sets[used[a[i]]], sets[used[b[i]]], assume_unique=True))
        return out
    for lo, hi in zip(cut[:-1], cut[1:]):
        dense = np.zeros((len(used), width), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] % width] = 1
        out += np.rint((dense @ dense.T)[a, b]).astype(np.int64)
    return out


def tiles_of(pdf: pd.DataFrame) -> Iterator[tuple]:
    """For each tile of a bin: its rows, those of the left and right slice."""
    pdf = pdf.sort_values(["key", "i", "j", "node"], ignore_index=True)
    new = (pdf[["key", "i", "j"]] != pdf[["key", "i", "j"]].shift()).any(axis=1).to_numpy()
    starts = np.append(np.flatnonzero(new), len(pdf))
    for lo, hi in zip(starts[:-1], starts[1:]):
        part = pdf.iloc[lo:hi].drop_duplicates("node")
        rows = np.arange(len(part))
        i, j, own = part["i"].iloc[0], part["j"].iloc[0], part["slice"].to_numpy()
        yield part, rows[own == i], (None if i == j else rows[own == j])


def _prune_bin(t: Fraction, tolerance: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, left, right in tiles_of(pdf):
            sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), -1)
            node = part["node"].to_numpy()
            found = [lasting_pairs(sig, a, b, t, tolerance) for a, b in tile_pairs(left, right)]
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, int)
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, int)
            root = roots(len(node), a, b)
            at = np.flatnonzero(root != np.arange(len(node)))
            out.append(pd.DataFrame({"a": node[at], "b": node[root[at]]}))
        give_back()
        return pd.concat(out).drop_duplicates()
    return run


def _verify_bin(t: Fraction, tolerance: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, left, right in tiles_of(pdf):
            sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), -1)
            sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
            size = np.array([len(x) for x in sets])
            node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
            links, ends = np.zeros(len(node), np.int64), [np.zeros((2, 0), int)]
            for a, b in tile_pairs(left, right):
                a, b = lasting_pairs(sig, a, b, t, tolerance)
                if not len(a):
                    continue
                both = shared_counts(sets, a, b)
                keep = both * t.denominator >= t.numerator * (size[a] + size[b] - both)
                a, b = a[keep], b[keep]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                ends.append(np.stack((a, b)))
            a, b = np.concatenate(ends, axis=1)
            root = roots(len(node), a, b)
            at = np.flatnonzero(links)
            out.append(pd.DataFrame({"node": node[at], "links": links[at], "root": node[root[at]]}))
        give_back()
        return pd.concat(out)
    return run


def in_tiles(rows: DataFrame, n: str, slice_rows: int = SLICE) -> DataFrame:
    """Rows of a key with ``n`` members, once for each pair of slices (i <= j)
    that the row's slice belongs to."""
    slices = F.ceil(F.col(n) / slice_rows).cast("int")
    return (rows.withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), slices - 1)))
            .withColumn("i", F.least("slice", "_o")).withColumn("j", F.greatest("slice", "_o")).drop("_o"))


def in_bins(tiles: DataFrame, rows: int, per_bin: int = BIN):
    """Tiles grouped into bins of about ``per_bin`` rows."""
    return (tiles.withColumn("_bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, rows // per_bin))))
            .groupBy("_bin"))


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, sig, bands) of every row, as a written table."""
    return materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                    F.xxhash64("text").alias("text_key"))
        .mapInPandas(_sign, "doc_id long, text_key long, node long, sig binary, bands array<long>"),
        "signatures")


def join_groups(docs: DataFrame, t: Fraction = Fraction(4, 5), tolerance: float = 1e-6) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of equal texts),
    n_links (other documents linked directly), group_id (smallest doc_id
    reachable by links), kept (doc_id = group_id); also text_key, a text hash."""
    rows = classify(docs)
    classes = materialize(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"),
        F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")

    placed = classes.select("node", F.explode("bands").alias("key"))
    h = F.xxhash64("node")
    buckets = (placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"),
        F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y"))
        .filter("n > 1").groupBy("n", "lo", "hi", "x", "y").agg(F.min("key").alias("key"))
        .select("key", "n"))
    members = placed.join(small_side(materialize(buckets, "buckets")), "key")
    members = materialize(members, "members")
    seen = classes.select("node", "sig").join(members, "node")
    count = members.agg(F.sum(F.ceil(F.col("n") / SLICE))).first()[0] or 0
    forest = in_bins(in_tiles(seen, "n"), count).applyInPandas(_prune_bin(t, tolerance), "a long, b long")
    groups = connected_components(forest)

    groups = materialize(groups, "groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wanted = materialize(groups.join(small_side(materialize(sizes, "sizes")), "component")
                         .join(classes.select(F.col("node").alias("id"), "class_id", "copies"), "id")
                         .select(F.col("id").alias("node"), F.col("component").alias("key"), "n",
                                 "class_id", "copies"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = small_side(materialize(wanted.select(F.col("class_id").alias("_id")).distinct(), "ids"))
    sets = (texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
            .mapInPandas(_shingle_sets, "node long, sig binary, shingles binary"))
    found = sets.join(small_side(wanted.drop("class_id")), "node")
    count = wanted.agg(F.sum(F.ceil(F.col("n") / SLICE))).first()[0] or 0
    links = materialize(in_bins(in_tiles(found, "n"), count, 500).applyInPandas(
        _verify_bin(t, tolerance), "node long, links long, root long"), "links")

    ends = materialize(connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))), "ends")
    linked = (links.groupBy("node").agg(F.sum("links").alias("links"))
              .join(ends.withColumnRenamed("id", "node"), "node", "left"))
    known = (classes.select("node", "class_id", "copies").join(linked, "node", "left")
             .filter("copies > 1 OR links > 0")
             .withColumn("component", F.coalesce("component", "node")))
    least = known.groupBy("component").agg(F.min("class_id").alias("group_id"))
    known = materialize(known.join(least, "component").select(
        "node", "class_id", "group_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    return (rows.select("doc_id", "text_key", "node").join(small_side(known), "node", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("group_id", "doc_id").alias("group_id"), "text_key")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id"))))
