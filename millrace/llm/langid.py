"""Language identification: averaged hashed subword embeddings, linear softmax.

Every character n-gram within a word (word ends marked) is hashed to a bucket
with an embedding; the mean embedding of a text goes through a linear softmax.
The model is trained in numpy by stochastic gradient descent on a bounded
sample of labelled documents: at most ``train_per_lang`` documents of each
language, each giving ``grams_per_doc`` n-grams spread evenly over its whole
text. Because averaging and the output layer are both linear, scoring uses one
table of buckets x languages and covers every n-gram of every whole text.

Calibration: a fifth of the sample is kept out of training; it sets the softmax
temperature and the confidence under which a prediction is rejected
(``accepted`` false): the lowest one above which kept-out predictions are right
at the rate ``precision``.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
without any labelled document everything is ``und``; a null doc_id counts as
held out; ties between languages go to the first by code point; repeated rows
are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_bucket, materialize, small_side

SLICE_CHARS = 1_000_000

#: training documents of all languages; shared equally beyond 100 languages
TRAIN_ROWS = 150_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def _codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, 0 for non-letters and before each text; text ends."""
    low = ["\n" + t.lower() if isinstance(t, str) else "\n" for t in texts]
    code = np.frombuffer(("".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in low])
    return np.where(_is_letter()[code], code, np.uint32(0)), ends


def _grams(code: np.ndarray, sizes: tuple, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) per size of the n-grams with letters inside and at most
    their first and last place a word end."""
    letter = code > 0
    for n in sizes:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = np.ones(m, dtype=bool)
        for j in range(1, n - 1):
            ok &= letter[j:j + m]
        if n == 2:
            ok = letter[:m] | letter[1:]
        place = np.flatnonzero(ok)
        h = np.full(len(place), 2166136261 + n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ code[place + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        yield place, h % np.uint32(buckets)


def sample_grams(text: str, sizes: tuple, buckets: int, count: int) -> np.ndarray:
    """``count`` buckets spread evenly over the n-grams of the whole text."""
    found = [g for _, g in _grams(_codes([text])[0], sizes, buckets)]
    all_grams = np.concatenate(found) if found else np.zeros(0, np.uint32)
    if not len(all_grams):
        return all_grams.astype(np.int32)
    order = np.argsort(np.concatenate([np.arange(len(g)) / max(1, len(g)) for g in found]),
                       kind="stable")
    pick = np.linspace(0, len(order) - 1, count).round().astype(np.int64)
    return all_grams[order[pick]].astype(np.int32)


def train(grams: np.ndarray, lang: np.ndarray, langs: int, buckets: int, dim: int, epochs: int,
          seed: int, rate: float = 0.5, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """SGD on the cross entropy, rate falling to 0; returns the table buckets x
    languages (embeddings times output weights) and the output bias."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (buckets, dim))
    out, bias = np.zeros((dim, langs)), np.zeros(langs)
    share = np.maximum(np.bincount(lang, minlength=langs), 1)
    weight = (len(lang) / (langs * share))[lang]
    steps, step = epochs * max(1, -(-len(lang) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(lang))
        for lo in range(0, len(order), batch):
            at = order[lo:lo + batch]
            x = emb[grams[at]].mean(1)
            p = _softmax(x @ out + bias)
            p[np.arange(len(at)), lang[at]] -= 1
            p *= weight[at][:, None]
            r = rate * (1 - step / steps)
            back = p @ out.T / grams.shape[1]
            out -= r * x.T @ p
            bias -= r * p.sum(0) * 0.1
            np.add.at(emb, grams[at].ravel(), -r * 10 * np.repeat(back, grams.shape[1], axis=0))
            step += 1
    return emb @ out, bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrate(logits: np.ndarray, lang: np.ndarray, precision: float) -> tuple[float, float]:
    """(temperature of least log loss, least confidence of an accepted prediction)."""
    if not len(lang):
        return 1.0, 0.5
    heat = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(lang)), lang], 1e-12)).mean()
            for t in heat]
    t = float(heat[int(np.argmin(loss))])
    p = _softmax(logits / t)
    best, right = p.max(1), p.argmax(1) == lang
    order = np.argsort(-best)
    rate = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(rate >= precision)
    return t, float(best[order[good[-1]]]) if len(good) else 1.0


def fit(docs: DataFrame, train_per_lang: int, grams_per_doc: int, sizes: tuple, buckets: int,
        dim: int, epochs: int, precision: float, seed: int):
    """(languages, table, bias, temperature, floor) from training documents."""
    rank = F.xxhash64(F.lit(seed), "doc_id")
    known = docs.filter((id_bucket("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "langs")
    quota = max(1, min(train_per_lang, TRAIN_ROWS // max(1, counts.count())))
    # a language's smallest hashes, thinned to about twice the quota before they are put in order
    near = (known.select("doc_id", "lang").join(small_side(counts), "lang")
            .filter(rank / F.lit(2.0 ** 64) + 0.5 <= F.lit(2.0 * quota) / F.col("_n")))
    order = Window.partitionBy("lang").orderBy(rank, F.col("doc_id"))
    picked = (near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= quota)
              .select("doc_id", "lang").distinct())
    picked = small_side(materialize(picked, "picked"))
    rows = docs.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"], "left_semi")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sample_grams(t, sizes, buckets, grams_per_doc) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"],
                                "grams": [g.tobytes() for g in got]})

    got = rows.mapInPandas(gather, "doc_id long, lang string, grams binary").toPandas()
    got = got[got["grams"].str.len() > 0].sort_values(["doc_id", "lang", "grams"])
    langs = sorted(got["lang"].unique(), key=lambda x: x.encode())
    if not langs:
        return [], None, None, 1.0, 1.0
    grams = np.stack([np.frombuffer(g, np.int32) for g in got["grams"]])
    lang = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    fold = np.random.default_rng(seed).random(len(lang)) < (0.2 if len(lang) >= 50 else 0.0)
    table, bias = train(grams[~fold], lang[~fold], len(langs), buckets, dim, epochs, seed)
    t, floor = calibrate(table[grams[fold]].mean(1) + bias, lang[fold], precision)
    return langs, table.astype(np.float32), bias, t, floor


def logits_of(texts: list, table: np.ndarray, sizes: tuple, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean of the table rows over all n-grams, has letters) of each text."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    has = np.zeros(len(texts), dtype=bool)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < SLICE_CHARS):
            size += len(texts[hi]) if isinstance(texts[hi], str) else 0
            hi += 1
        code, ends = _codes(texts[lo:hi])
        has[lo:hi] = np.diff(np.concatenate(([0], np.cumsum(code > 0)[ends - 1]))) > 0
        for place, cell in _grams(code, sizes, buckets):
            cut = np.concatenate(([0], np.searchsorted(place, ends)))
            count[lo:hi] += np.diff(cut)
            for k in range(table.shape[1]):
                run = np.concatenate(([0.0], np.cumsum(table[cell, k], dtype=np.float64)))
                total[lo:hi, k] += np.diff(run[cut])
        lo = hi
    return total / np.maximum(count, 1)[:, None], has


def identify(docs: DataFrame, train_per_lang: int = 1_500, grams_per_doc: int = 256,
             sizes: tuple = (2, 3, 4), buckets: int = 1 << 16, dim: int = 16, epochs: int = 5,
             precision: float = 0.995, seed: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row of ``docs``.

    Learns from at most ``train_per_lang`` documents a language, those of the
    smallest hashes, and at most ``TRAIN_ROWS`` in all (one a language at least).
    """
    langs, table, bias, heat, floor = fit(docs, train_per_lang, grams_per_doc, sizes, buckets,
                                          dim, epochs, precision, seed)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if not langs:
                yield pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "accepted": False})
                continue
            z, has = logits_of(texts.tolist(), table, sizes, buckets)
            p = _softmax((z + bias) / heat)
            best = p.max(1)
            yield pd.DataFrame({
                "lang_pred": np.where(has, np.array(langs, dtype=object)[p.argmax(1)], "und"),
                "score": np.where(has, np.clip(best, 0, 1), 0.0), "accepted": has & (best >= floor)})

    return (docs.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"),
                        predict("text").alias("_p"))
            .select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.accepted"))
