"""Spelling variants: words one inserted, deleted or replaced code point apart.

Words are compared in dense tiles: the words of a block are rows of a matrix
of code points, padded from the left and from the right, and the common prefix
and suffix of all pairs of the block come from two comparisons of it. Two words
are near if both lengths together reach the longer word's length minus one.

Blocks hold words that agree outside one half: of a near pair, the first edit
lies in one half of the longer word, so the other half is the same. A block of
more than ``TILE_WORDS`` words is dealt anew by the halves of its half, and so on
down to a single position, where at most the alphabet's letters are left. So no
block is large, nothing is dropped, and each near pair is met in exactly one
block: the one that holds its first edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: words of a block that are compared as one matrix; larger blocks are dealt anew
TILE_WORDS = 512

#: cells (pairs x code points) of one comparison
TILE_CELLS = 1 << 22

#: distinct words that a task counts before it hands them on
COUNT_WORDS = 200_000

#: a run of letters, after A-Z are lower-cased
LETTERS = "[a-zÀ-ÿ]+"

TILE_OUT = "word string, n_near long, near_n long, near_word string"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_each: int = 199,
                least_chars: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n): the words of all whole texts and how often they occur.

    A run of letters loses the code point h % length if ``drop_each`` divides h,
    the crc32 of ``<id>:<run>``. Counts are summed inside tasks before the shuffle.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                       F.col(text_col).cast("string").alias("_text")).filter("_text IS NOT NULL")
    find = re.compile(LETTERS).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(find(text.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % drop_each == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= least_chars:
                        total[run] += n
                if len(total) >= COUNT_WORDS:
                    yield from _counted(total)
                    total.clear()
        yield from _counted(total)
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_n))


def _counted(total: Counter) -> Iterator[pa.RecordBatch]:
    words, counts = list(total), list(total.values())
    for k in range(0, len(words), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[k:k + 20_000], pa.string()),
                                          pa.array(counts[k:k + 20_000], pa.int64())], names=["word", "n"])


def _blocks(words: DataFrame) -> DataFrame:
    """``words`` with the block's key: the longer length m and the code points
    outside positions a to b of the longer word. A word one shorter has one
    code point less there."""
    gone = F.col("m") - F.length("word")
    return words.withColumn("block", F.xxhash64(
        "m", "a", "b", F.substring("word", F.lit(1), F.col("a")),
        F.substring(F.col("word"), F.col("b") - gone + 1, F.col("m"))))


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near_word) for the words of ``counts`` (word, n)
    that have near words: their number and the near word of largest n (ties:
    the smallest in code-point order)."""
    both = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    half = F.floor(F.col("m") / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")),
                               F.struct(half.alias("a"), F.col("m").alias("b")))).alias("piece")
    rows = _blocks(counts.select("word", "n", both).select("*", halves).select("word", "n", "m", "piece.a", "piece.b"))
    found, level = None, 0
    while True:
        rows = materialize(rows, f"blocks{level}")
        # a block is compared only if it holds a word of the longer length
        sizes = rows.groupBy("block").agg(
            F.count(F.lit(1)).alias("size"), F.max(F.length("word") == F.col("m")).alias("full"),
            F.max(F.col("b") - F.col("a")).alias("span")).filter("size > 1 AND full")
        sizes = materialize(sizes, f"sizes{level}")
        small = sizes.filter((F.col("size") <= TILE_WORDS) | (F.col("span") <= 1)).select("block")
        lists = (rows.join(small, "block").groupBy("block", "m", "a", "b")
                 .agg(F.collect_list(F.struct("word", "n")).alias("words")))
        part = lists.mapInArrow(_compare, TILE_OUT)
        part = materialize(part.groupBy("word").agg(
            F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("near_n"), "near_word")).alias("best")),
            f"near{level}")
        found = part if found is None else found.unionByName(part)
        large = sizes.filter((F.col("size") > TILE_WORDS) & (F.col("span") > 1)).select("block")
        if large.isEmpty():
            break
        mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("a", mid.alias("b")), F.struct(mid.alias("a"), "b"))).alias("piece")
        rows = _blocks(rows.join(large, "block").select("word", "n", "m", halves)
                       .select("word", "n", "m", "piece.a", "piece.b"))
        level += 1
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
            .select("word", "n_near", (-F.col("best.near_n")).alias("near_n"), "best.near_word"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each block, summed by word."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("words"))
        flat, ends = lists.flatten(), np.cumsum(np.append(0, lists.value_lengths().to_pylist())).astype(int)
        names, counts = flat.field("word").to_pylist(), flat.field("n").to_pylist()
        shape = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("m", "a", "b")))
        found = []
        for lo, hi, (m, a, b) in zip(ends[:-1], ends[1:], shape):
            links = _tile(names[lo:hi], m, a, b)
            if links:
                found.append(_best(names[lo:hi], counts[lo:hi], links))
        if found:
            word, n_near, near_n, near_word = ([x for part in column for x in part] for column in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array(n_near, pa.int64()),
                 pa.array(near_n, pa.int64()), pa.array(near_word, pa.string())],
                names=["word", "n_near", "near_n", "near_word"])


def _tile(names: list[str], m: int, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of near words of which the longer has m code points and
    whose common prefix ends at a position from a to before b."""
    lengths = np.array([len(x) for x in names])
    left = np.zeros((len(names), m), dtype=np.uint32)
    right = np.zeros((len(names), m), dtype=np.uint32)
    for i, x in enumerate(names):
        points = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32)
        left[i, :len(x)] = points
        right[i, :len(x)] = points[::-1]
    out = []
    side = max(1, min(len(names), int((TILE_CELLS // max(m, 1)) ** 0.5)))
    for i in range(0, len(names), side):
        for j in range(i, len(names), side):
            prefix = _common(left[i:i + side], left[j:j + side])
            suffix = _common(right[i:i + side], right[j:j + side])
            longer = np.maximum(lengths[i:i + side, None], lengths[None, j:j + side])
            shorter = np.minimum(lengths[i:i + side, None], lengths[None, j:j + side])
            prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
            near = ((longer == m) & (prefix + suffix >= m - 1) & (prefix >= a) & (prefix < b)
                    & ~((prefix == longer) & (longer == shorter)))
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                out.append((x + i, y + j))
    return out


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal code points from the left, for each row of x with each of y."""
    other = x[:, None, :] != y[None, :, :]
    return np.where(other.any(axis=2), other.argmax(axis=2), x.shape[1])


def _best(names: list[str], counts: list[int], links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, ...]:
    """(word, near words, n of the best, the best) for the words of a block."""
    x = np.concatenate([np.concatenate((i, j)) for i, j in links])
    y = np.concatenate([np.concatenate((j, i)) for i, j in links])
    # larger n first, then the smaller word
    place = np.empty(len(names), dtype=np.int64)
    place[sorted(range(len(names)), key=lambda k: (-counts[k], names[k]))] = np.arange(len(names))
    order = np.lexsort((place[y], x))
    x, y = x[order], y[order]
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return ([names[k] for k in x[at]], np.diff(np.append(at, len(x))).tolist(),
            [counts[k] for k in y[at]], [names[k] for k in y[at]])


def group_variants(docs: DataFrame, factor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each word with its usual form.

    Returns (word, n, n_near, form, form_n, root). The form is the near word of
    largest n (ties: the smallest in code-point order) if that n is at least
    ``factor`` times the word's; the root is the last word that following forms
    leads to, the word itself without a form. As n grows with every step there
    is no circle and the path is short: it is halved each round.

    Null and empty texts have no words, a null id counts as no characters,
    repeated rows count as often as they stand there, other columns are not
    read. A table without words gives no rows.
    """
    counts = materialize(word_counts(docs, id_col, text_col), "words")
    near = near_words(counts)
    chosen = F.col("near_n") >= factor * F.col("n")
    words = materialize(counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, F.col("near_word")).alias("form"), F.when(chosen, F.col("near_n")).alias("form_n")), "variants")
    up = words.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        next_up = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        up = materialize(up.join(next_up, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if up.filter("moved").isEmpty():
            break
        up = up.select("word", "root")
    return words.join(up.select("word", "root"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
