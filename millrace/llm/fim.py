"""Fill-in-middle: cut each text twice at line ends and move its parts.

The boundaries of all lines of a run of texts (an Arrow batch) get one learned
rank index: straight segments, each within ``ERROR`` bytes of every boundary it
covers, and a two-byte residual per boundary. The offset of a cut is its
segment's prediction plus the residual, which is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a segment's largest distance in bytes from a boundary; fits the residuals' type
ERROR = 2_000

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


class RankIndex:
    """Offsets by rank: ``first`` (rank), ``base`` (offset) and ``slope`` of each
    segment, ``residual`` of each rank."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        first, slope = _segments(offsets, error)
        self.first = np.array(first, dtype=np.int64)
        self.slope = np.array(slope)
        self.base = offsets[self.first]
        left = offsets - self._predict(np.arange(len(offsets)))
        self.residual = left.astype(np.int16)
        if not (self.residual == left).all():
            raise ValueError(f"segments are further than two bytes hold: {np.abs(left).max()}")

    def _predict(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[at] + np.floor(self.slope[at] * (rank - self.first[at])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """The offset of each rank, without the table of offsets."""
        return self._predict(rank) + self.residual[rank]


def _segments(offsets: np.ndarray, error: int) -> tuple[list[int], list[float]]:
    """Longest segments from left to right: a segment starts on its first
    boundary, and its slope may be any that passes all others within ``error``."""
    first, slope = [], []
    start, end, width = 0, len(offsets), 64
    while start < end:
        low, high, at = -np.inf, np.inf, start + 1
        while at < end:
            run = np.arange(1, width + 1)[:end - at] + (at - start - 1)
            rise = offsets[at:at + width] - offsets[start]
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            miss = np.flatnonzero(lows > highs)
            good = int(miss[0]) if len(miss) else len(run)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            at += good
            if len(miss):
                break
            width = min(2 * width, 1 << 16)
        first.append(start)
        slope.append(0.0 if at == start + 1 else (low + high) / 2)
        start, width = at, max(64, min(width, 2 * (at - start)))
    return first, slope


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with its lines cut into prefix, middle and suffix.

    Lines are ``[^\\n]*\\n|[^\\n]+``. With h1 to h4 the first four 8-digit groups of
    the hex sha256 of ``<seed>:<id>``, the prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) lines and the middle after the larger. Of the
    texts ``rate`` per cent (h3) are cut, ``spm_rate`` per cent (h4) of these in
    the order suffix, prefix, middle.

    Returns (id, n, form, prefix_chars, middle_chars, output), a row for each row
    of ``docs``, repeated ones too; other columns are left behind, whatever their
    names. A null text counts as empty, an empty text or one that holds a marker
    is ``plain`` (n is still its number of lines), a null id counts as no digits.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _cut_batch(batch.column(0), batch.column(1), seed, rate, spm_rate)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(cut, f"_id string, {OUT}")
    return out.withColumnRenamed("_id", id_col).withColumn(id_col, F.col(id_col).cast(id_type))


def _cut_batch(ids: pa.Array, texts: pa.Array, seed: int, rate: int, spm_rate: int) -> pa.RecordBatch:
    parts = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    data = b"".join(parts)
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    # one list of boundaries for the whole run: where a text ends, the next starts
    bounds = np.union1d(np.append(ends, 0), np.flatnonzero(raw == 10) + 1)
    index = RankIndex(bounds)
    first = np.searchsorted(bounds, np.append(0, ends))
    lines = np.diff(first)

    h = np.array([[int(x[k:k + 8], 16) for k in (0, 8, 16, 24)] for x in
                  (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids.to_pylist())],
                 dtype=np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (lines + 1)[:, None], axis=1) + first[:-1, None]
    one, two = index.offset(cuts[:, 0]).tolist(), index.offset(cuts[:, 1]).tolist()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    form, output, prefix_chars, middle_chars = [], [], [], []
    start = 0
    for k, (text, end) in enumerate(zip(parts, ends.tolist())):
        if not text or h[k, 2] % 100 >= rate or any(x in text for x in marks):
            form.append("plain")
            output.append(text)
            prefix_chars.append(None)
            middle_chars.append(None)
        else:
            a, b = one[k], two[k]
            spm = h[k, 3] % 100 < spm_rate
            form.append("spm" if spm else "psm")
            output.append(b"".join((s, data[b:end], p, data[start:a], m, data[a:b]) if spm else
                                   (p, data[start:a], s, data[b:end], m, data[a:b])))
            prefix_chars.append(_chars(raw[start:a]))
            middle_chars.append(_chars(raw[a:b]))
        start = end
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(lines, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64()),
         pa.array(middle_chars, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
        names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _chars(raw: np.ndarray) -> int:
    """Code points: the bytes that continue none."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def restore(output: Column, form: Column) -> Column:
    """The text from its output and form. The parts hold no marker, and no
    marker can begin in a part and end in the next, so the first of each counts."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)

    def split(lead: str, mark: str) -> tuple[Column, Column]:
        return F.replace(F.substring_index(head, mark, 1), F.lit(lead), F.lit("")), F.substring_index(head, mark, -1)
    psm_prefix, psm_suffix = split(PREFIX, SUFFIX)
    spm_suffix, spm_prefix = split(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix))
            .when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output))
