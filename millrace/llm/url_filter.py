"""URL filter: rules first, then logistic regression on hashed character n-grams.

Host and path are cut from the URL with SQL functions, the longest fitting
rule decides, and URLs that no rule fits get the verdict of a logistic
regression over hashed character n-grams of host and path. It learns from a
small labelled URL table: a seeded sample of at most ``train_rows`` distinct
URLs that a rule decides, labelled by that rule. Scoring runs in Arrow batches
over all rows with a weight vector of fixed size.

Defined cases: a null URL, or one without ``://``, has empty host and path and
is scored like any other (its features are empty, so the bias decides);
without labelled rows of both verdicts every unruled URL gets the only verdict
known, or ``allow``; repeated rows are kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: characters scored at once
SLICE_CHARS = 400_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``; then up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(hosts: list, paths: list, sizes: tuple, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of ``^host$`` and ``/path``; host
    and path hash apart."""
    rows, cells = [], []
    for part, texts in enumerate((hosts, paths)):
        marked = ["\x02" + (t or "") + "\x03" for t in texts]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.array([len(t) for t in marked], dtype=np.int64)
        row = np.repeat(np.arange(len(marked)), length)
        for n in sizes:
            h = np.full(max(0, len(code) - n + 1), 0xCBF29CE484222325 + part * 977 + n, dtype=np.uint64)
            for j in range(n):
                h = (h ^ code[j:j + len(h)]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            whole = row[:len(h)] == row[n - 1:n - 1 + len(h)]
            rows.append(row[:len(h)][whole])
            cells.append((h[whole] % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cells)


def _scores(row: np.ndarray, cell: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    count = np.maximum(np.bincount(row, minlength=n), 1)
    return np.bincount(row, weights[cell], minlength=n) / np.sqrt(count) + bias


def fit(hosts: list, paths: list, blocked: np.ndarray, sizes: tuple, buckets: int,
        steps: int = 300, rate: float = 2.0, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent on the log loss, classes weighted equally."""
    row, cell = grams(hosts, paths, sizes, buckets)
    n = len(hosts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    each = np.where(blocked, 0.5 / max(1, blocked.sum()), 0.5 / max(1, (~blocked).sum()))
    weights, bias = np.zeros(buckets), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-_scores(row, cell, n, weights, bias)))
        err = (p - blocked) * each
        weights -= rate * (np.bincount(cell, (err * scale)[row], minlength=buckets) + l2 * weights)
        bias -= rate * err.sum()
    return weights, bias


def filter_urls(pages: DataFrame, rules: tuple = RULES, train_rows: int = 4_000,
                sizes: tuple = (3, 4, 5), buckets: int = 1 << 16, seed: int = 11) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (null where a rule decides)."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), verdict.alias("verdict"))

    small = (judged.filter(F.col("verdict").isNotNull()).select("host", "path", "verdict").distinct()
             .orderBy(F.xxhash64(F.lit(seed), "host", "path"), "host", "path").limit(train_rows)
             .toPandas())
    blocked = (small["verdict"] == "block").to_numpy(bool)
    if blocked.any() and not blocked.all():
        weights, bias = fit(small["host"].tolist(), small["path"].tolist(), blocked, sizes, buckets)
        weights = weights.astype(np.float32)
    else:
        weights, bias = np.zeros(buckets, np.float32), (20.0 if blocked.any() else -20.0)

    @F.pandas_udf("double")
    def p_block(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            out = np.zeros(len(hosts))
            size = (hosts.str.len() + paths.str.len()).to_numpy().cumsum() // SLICE_CHARS
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                row, cell = grams(hosts.iloc[at].tolist(), paths.iloc[at].tolist(), sizes, buckets)
                s = _scores(row, cell, len(at), weights, bias)
                out[at] = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            yield pd.Series(out)

    scored = judged.withColumn("p_block", F.when(F.col("rule").isNull(), p_block("host", "path")))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        "verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "p_block")
