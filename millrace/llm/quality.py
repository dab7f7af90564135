"""Quality classifier by co-training a text view and a page-metadata view.

Two logistic regressions see different sides of a document: the text view its
whole text (shares of character kinds, repetition, line shapes, hashed words),
the metadata view its source, language, stated length and the URL of the page
whose path names the document. Both start from the labelled rows. In each round
a view's confident verdicts on unlabelled documents become pseudo-labels of the
other view, which is fitted again. At the end a small regression on a kept-out
fold of labelled rows calibrates and combines the two views, and every document
gets the combined probability.

Features are made in one scan of the texts and written as a narrow table; a
Newton step is one pass over that table that sums gradients and Hessians in
tasks, then level by level over neighbouring tasks, so the driver only ever adds
a fixed number of small matrices. All labelled and all unlabelled rows take part.

Defined cases: a null text counts as empty, null metadata as a value of its
own; a document's label is the majority of its non-null labels, ties count as
good; a document named by several pages takes the first URL by code point;
without labels of both kinds everything is kept with the score of the labels'
mean (1 without any); repeated rows are scored one by one; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialize, small_side, sum_arrays
from .textscan import NON_SPACE, SMALL_SLICE_BYTES, mix, scan

HASHED = 64

#: character kinds whose share of a text is a feature.
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?",
         b"*#%&$@^~", b"|<>{}[]\\/=+_", b"\n", b"'\"()-"]


def _kind_table() -> np.ndarray:
    out = np.full(256, len(KINDS), dtype=np.int64)
    for i, chars in enumerate(KINDS):
        out[list(chars)] = i
    out[0x20] = len(KINDS) + 1
    out[0x80:] = len(KINDS) + 2
    return out


_KIND = _kind_table()
N_KINDS = len(KINDS) + 3
TEXT_DIM = N_KINDS + 10 + HASHED


def text_features(texts: list) -> np.ndarray:
    """One row of TEXT_DIM numbers for each whole text."""
    out = np.zeros((len(texts), TEXT_DIM), dtype=np.float32)
    for lo, hi, s in scan(texts, NON_SPACE, lower=False, run_bytes=SMALL_SLICE_BYTES):
        m = hi - lo
        raw = np.frombuffer(s.data, np.uint8)
        text_end = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 if isinstance(t, str) else 1
                              for t in texts[lo:hi]])
        doc = np.repeat(np.arange(m), np.diff(np.concatenate(([0], text_end))))[:len(raw)]
        own = np.ones(len(raw), dtype=bool)
        own[text_end[:-1] - 1] = False    # the line feeds between texts
        size = np.maximum(np.bincount(doc[own], minlength=m), 1)
        x = np.bincount(doc[own] * N_KINDS + _KIND[raw[own]], minlength=m * N_KINDS).reshape(m, N_KINDS) / size[:, None]
        words = np.diff(s.first)
        n = np.maximum(words, 1)
        of = np.repeat(np.arange(m), words)
        length = s.end - s.start
        _, first, count = np.unique(mix(s.hash + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                    return_index=True, return_counts=True)
        distinct = np.bincount(of[first], minlength=m)
        top = np.zeros(m)
        np.maximum.at(top, of[first], count)
        twice = np.bincount(of[1:], (s.hash[1:] == s.hash[:-1]) & (of[1:] == of[:-1]), minlength=m) if len(of) > 1 else np.zeros(m)
        last = raw[s.end - 1] if len(of) else np.zeros(0, np.uint8)
        upper = (raw[s.start] >= 65) & (raw[s.start] <= 90) if len(of) else np.zeros(0, bool)
        odd = np.bincount(of, ~(((last >= 97) & (last <= 122)) | (last >= 0x80) | np.isin(last, list(b".,;:"))), minlength=m)
        more = np.stack([
            np.log1p(words), distinct / n, top / n, twice / n, np.bincount(of, length, minlength=m) / n / 10,
            np.bincount(of, length > 20, minlength=m) / n, np.bincount(of, length <= 2, minlength=m) / n,
            np.bincount(of, upper, minlength=m) / n, odd / n, np.log1p(n) * distinct / n], axis=1)
        cell = (mix(s.hash) % np.uint64(HASHED)).astype(np.int64)
        hashed = np.bincount(of * HASHED + cell, minlength=m * HASHED).reshape(m, HASHED) / n[:, None]
        out[lo:hi] = np.concatenate((x, more, hashed), axis=1)
    return out


@giving_back
def _scan_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        x = text_features(b["text"].tolist())
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"],
                            "source": b["source"], "lang": b["lang"], "n_chars": b["n_chars"].astype("Int64"),
                            "x": [r.tobytes() for r in x]})


#: the metadata view: hashed one-hot groups and three numbers
META_GROUPS, META_HASHED = ("source", "lang", "scheme", "top", "section"), 24
META_DIM = len(META_GROUPS) * META_HASHED + 3


def features(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, text_key, x (text view), the metadata columns, label (0, 1, null)."""
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"),
        "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).mapInPandas(
            _scan_rows, "doc_id long, text_key long, source string, lang string, n_chars long, x binary"),
        "quality-text")
    label = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_l"))
             .agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    url = (pages.select("url", F.try_to_number(F.regexp_extract("url", r"://[^/]*/(?:[^?#]*/)?([0-9]{1,18})", 1),
                                               F.lit("9" * 18)).cast("long").alias("_p"))
           .filter("_p IS NOT NULL").groupBy("_p").agg(F.min("url").alias("url")))
    rows = rows.join(label, F.col("doc_id") == F.col("_l"), "left").join(url, F.col("doc_id") == F.col("_p"), "left")
    return materialize(rows.select(
        "doc_id", "text_key", "x", "source", "lang", "n_chars", "label",
        F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", r"://[^/]*\.([a-z]+)(?:[/?#:]|$)", 1).alias("top"),
        F.regexp_extract("url", r"://[^/]*/([^/?#]*)/", 1).alias("section"),
        (F.xxhash64("doc_id", "text_key") % 5 == 0).alias("kept_out")), "quality-rows")


def _cells(values: pd.Series, group: int) -> np.ndarray:
    names, back = np.unique(values.fillna("\0").astype(str).to_numpy(), return_inverse=True)
    slot = [int.from_bytes(blake2b(n.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for n in names]
    return mix(np.array([(v + group) & (2 ** 64 - 1) for v in slot], dtype=np.uint64))[back] % np.uint64(META_HASHED)


def design(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(text view, metadata view) of a batch, each with a constant column."""
    n = len(b)
    x = np.frombuffer(b"".join(b["x"]), np.float32).reshape(n, TEXT_DIM).astype(np.float64)
    m = np.zeros((n, META_DIM))
    for g, name in enumerate(META_GROUPS):
        m[np.arange(n), g * META_HASHED + _cells(b[name], g).astype(np.int64)] = 1
    chars = b["n_chars"].astype("Float64").fillna(-1).to_numpy(float)
    m[:, -3], m[:, -2] = chars < 0, np.log1p(np.maximum(chars, 0)) / 10
    m[:, -1] = m[:, -2] ** 2
    one = np.ones((n, 1))
    return np.hstack((x, one)), np.hstack((m, one))


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(rows: DataFrame, size: int, add) -> np.ndarray:
    """Sum of ``add(batch)`` (``size`` numbers) over all batches of ``rows``."""
    @giving_back
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += add(b)
        yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "v": [total.tobytes()]})

    return sum_arrays(rows.mapInPandas(part, "g int, v binary"), size)


def _moments(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient, Hessian and weight of the log loss, as one run of numbers."""
    p = _p(x @ beta)
    return np.concatenate((x.T @ (w * (p - y)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel(), [w.sum()]))


def _newton(beta: np.ndarray, parts: list[tuple[np.ndarray, float]], l2: float) -> np.ndarray:
    """A step from weighted moments; the ridge spares the constant."""
    d = len(beta)
    ridge = np.full(d, l2)
    ridge[-1] = 1e-6
    g, h = ridge * beta, np.diag(ridge)
    for m, weight in parts:
        g = g + weight * m[:d]
        h = h + weight * m[d:-1].reshape(d, d)
    step = np.linalg.solve(h, g)
    return beta - step * min(1.0, 10 / max(1e-9, np.abs(step).max()))


def co_train(rows: DataFrame, rounds: int, sure: float, pseudo: float, l2: float):
    """(text weights, metadata weights, combiner, cut) or a constant score."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    if not bad or not good:
        return (good / (good + bad)) if good + bad else 1.0
    dims = (TEXT_DIM + 1, META_DIM + 1)
    size = [d + d * d + 1 for d in dims]
    betas = [np.zeros(d) for d in dims]

    def fit(betas: list, teachers: list | None, steps: int) -> list:
        for _ in range(steps):
            now = list(betas)

            def add(b: pd.DataFrame) -> np.ndarray:
                views = design(b)
                y = b["label"].astype("Float64").fillna(-1).to_numpy(float)
                known = (y >= 0) & ~b["kept_out"].to_numpy(bool)
                out = []
                for v, x in enumerate(views):
                    out.append(_moments(x[known], y[known], np.ones(known.sum()), now[v]))
                    if teachers is not None:
                        t = _p(views[1 - v] @ teachers[1 - v])
                        say = (y < 0) & ((t >= sure) | (t <= 1 - sure))
                        out.append(_moments(x[say], (t[say] >= 0.5).astype(float), np.ones(say.sum()), now[v]))
                return np.concatenate(out)

            many = 1 if teachers is None else 2
            got = np.split(_sums(rows, many * sum(size), add), np.cumsum(np.repeat(size, many))[:-1])
            for v in range(2):
                parts = [(got[v * many], 1.0)]
                if many == 2 and got[v * 2 + 1][-1]:
                    told = got[v * 2 + 1]
                    parts.append((told, pseudo * min(1.0, got[v * 2][-1] / told[-1])))
                betas[v] = _newton(betas[v], parts, l2)
        return betas

    betas = fit(betas, None, 6)
    for _ in range(rounds):
        betas = fit(betas, [b.copy() for b in betas], 3)

    some_out = rows.filter("kept_out AND label IS NOT NULL")
    mixer = np.array([1.0, 0.2, 0.0])
    for _ in range(5):
        now = mixer

        def add(b: pd.DataFrame) -> np.ndarray:
            return _moments(_logits(b, betas), b["label"].to_numpy(float), np.ones(len(b)), now)

        mixer = _newton(mixer, [(_sums(some_out, 13, add), 1.0)], 1e-2)

    def bins(b: pd.DataFrame) -> np.ndarray:
        cell = np.minimum((_p(_logits(b, betas) @ mixer) * 1000).astype(int), 999)
        return np.bincount(cell[b["label"].to_numpy(float) > 0.5], minlength=1000).astype(float)

    lost = np.cumsum(_sums(some_out, 1000, bins))
    low = int(np.searchsorted(lost, 0.002 * lost[-1], side="right"))
    return betas, mixer, min(0.5, low / 1000)


def _logits(b: pd.DataFrame, betas: list) -> np.ndarray:
    views = design(b)
    return np.stack([np.clip(x @ w, -30, 30) for x, w in zip(views, betas)] + [np.ones(len(b))], axis=1)


def score(docs: DataFrame, labels: DataFrame, pages: DataFrame, rounds: int = 3, sure: float = 0.98,
          pseudo: float = 0.5, l2: float = 1.0) -> DataFrame:
    """doc_id, text_key, p_text, p_meta, score (probability of good), kept.

    ``sure`` is the confidence that makes a pseudo-label, ``pseudo`` the most
    weight all of them together have against the true labels. A document is
    kept if its score reaches the cut: 0.5, or less if that would lose more
    than 0.2 % of the kept-out good documents.
    """
    rows = features(docs, labels, pages)
    model = co_train(rows, rounds, sure, pseudo, l2)
    if isinstance(model, float):
        return rows.select("doc_id", "text_key", F.lit(model).alias("p_text"), F.lit(model).alias("p_meta"),
                           F.lit(model).alias("score"), F.lit(True).alias("kept"))
    betas, mixer, cut = model

    @giving_back
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = _logits(b, betas)
            p = _p(z @ mixer)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "p_text": _p(z[:, 0]),
                                "p_meta": _p(z[:, 1]), "score": p, "kept": p >= cut})

    return rows.mapInPandas(judge, "doc_id long, text_key long, p_text double, p_meta double, "
                                   "score double, kept boolean")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text) is in ``dropped``
    (doc_id, text_key)."""
    gone = small_side(materialize(dropped.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
                                  .distinct(), "dropped"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_d"])
                     & (F.xxhash64(docs["text"]) == gone["_k"]), "left_anti")
