"""Byte-level BPE by a transducer: encoding and streaming decoding.

The ranks of a vocabulary are compiled into a finite-state transducer that
reads bytes and writes token ids. Its nondeterministic form follows every
token that may be the next one; two facts keep it small: every prefix of a
piece has exactly one encoding, and two tokens may stand side by side only if
no merge across their border comes before the merges that formed them.

The deterministic form is built lazily, as bytes ask for it. One of its states
is a set of branches, each a place in the trie of tokens and the tokens that
this branch has completed and the others have not: what all branches agree on
has been written already. A token is so written as soon as no other reading of
the next bytes can undo it, which is after a lookahead bounded by the
vocabulary's tokens.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: states of a transducer before it is built afresh; pieces remembered whole, and their length
MAX_STATES, MAX_PIECES, PIECE_CHARS = 250_000, 200_000, 48

#: matches of a very long text, and ids of a very long list, that are taken at once
RUN = 1 << 16

# Letters and digits of Unicode 17 and 18, by the first and last
# code point of a run. The ``regex`` module knows them, tiktoken's matcher
# (Unicode 16) does not.
NEWER_LETTERS = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 "
    "a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11df1-11df1 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f")
NEWER_DIGITS = "11de0-11de9 1246f-1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _set(runs: str) -> str:
    return "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in (r.split("-") for r in runs.split()))


class Merges:
    """The tokens of a rank file, and which of them can be neighbours."""

    def __init__(self, file: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.token = {i: b for b, i in self.rank.items()}
        self._split: dict[int, tuple[int, int] | None] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge forms ``token``; None for a single byte."""
        if token not in self._split:
            parts = [bytes([b]) for b in self.token[token]]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], len(self.token) + i))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._split[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self._split[token]

    def apart(self, left: int, right: int) -> bool:
        """Do the bytes of both, encoded together, stay these two tokens?

        Goes back in time: the merge done last on either side is undone, and
        the two parts then at the border must not have merged before it. Of
        equal ranks the left one merges first.
        """
        before = None
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and (before is None or across < before):
                return False
            parts, other = self.split(left), self.split(right)
            if parts is None and other is None:
                return True
            if other is None or (parts is not None and left > right):
                left, before = parts[1], left
            else:
                right, before = other[0], right + 1


class Transducer:
    """States by number: ``branches[s]`` and, for each byte read in s so far,
    ``steps[s][byte]`` = (next state, ids written).

    A branch is (node of the trie, tokens): the first of its tokens has been
    written already (-1: the start, or no branch needs it any more), the others
    wait for the other branches. Branches stand by the place where their node's
    bytes began.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, data in merges.token.items():
            node = 0
            for b in data:
                below = self.child[node]
                if b not in below:
                    below[b] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = below[b]
            self.ends[node] = token
        self._fits: dict[int, dict[int, bool]] = {}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.branches: list[tuple] = []
        self.steps: list[dict[int, tuple[int, tuple]]] = []
        self.start = self._state(((0, (-1,)),))

    def _state(self, branches: tuple) -> int:
        at = self.number.setdefault(branches, len(self.branches))
        if at == len(self.branches):
            self.branches.append(branches)
            self.steps.append({})
        return at

    def _fit(self, last: int, token: int) -> bool:
        of_last = self._fits.get(last)
        if of_last is None:
            of_last = self._fits[last] = {}
        fit = of_last.get(token)
        if fit is None:
            fit = of_last[token] = last < 0 or self.merges.apart(last, token)
        return fit

    def _step(self, state: int, byte: int) -> tuple[int, tuple]:
        """Read a byte in all branches; write what they now agree on."""
        child, ends = self.child, self.ends
        going, whole = [], None
        for node, done in self.branches[state]:
            node = child[node].get(byte)
            if node is None:
                continue
            if whole is None and ends[node] >= 0 and self._fit(done[-1], ends[node]):
                whole = done + (ends[node],)    # one branch alone ends here in a token that fits
            if child[node]:
                going.append((node, done))
        going.append((0, whole))
        lead = going[0][1]
        n = short = len(lead)
        for _, done in going:
            short = min(short, len(done))
            while done[:n] != lead[:n]:
                n -= 1
        if short > n:                       # what is written has no neighbour to come
            going = [(node, (-1,) + done[n:]) for node, done in going]
        elif n > 1:
            going = [(node, done[n - 1:]) for node, done in going]
        return self._state(tuple(going)), lead[1:n]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece; a piece that is a token is that token."""
        whole = self.merges.rank.get(piece)
        if whole is not None:
            return [whole]
        if len(self.branches) > MAX_STATES:
            self._clear()
            self._fits = {}
        out: list[int] = []
        state, steps = self.start, self.steps
        for b in piece:
            found = steps[state].get(b)
            if found is None:
                found = steps[state][b] = self._step(state, b)
            state, ids = found
            out += ids
        out += self.branches[state][-1][1][1:]
        return out


class _Pieces(dict):
    """Ids of pieces, the short ones remembered: those of this generation, and
    of the one before as they are met again."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.before: dict[str, tuple] = {}

    def __missing__(self, piece: str) -> tuple:
        ids = self.before.get(piece)
        if ids is None:
            ids = tuple(self.transducer.encode(piece.encode()))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, file: bytes, pattern: str):
        self.pieces = _Pieces(Transducer(Merges(file)))
        self.find = regex.compile(pattern)
        self.newer = regex.compile(f"[{_set(NEWER_LETTERS)}{_set(NEWER_DIGITS)}]")
        letter, digit = rf"[\p{{L}}--[{_set(NEWER_LETTERS)}]]", rf"[\p{{N}}--[{_set(NEWER_DIGITS)}]]"
        older = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letter}{digit}]")
        for known, class_ in ((r" ?\p{L}", f" ?{letter}"), (r" ?\p{N}", f" ?{digit}")):
            older = older.replace(known, class_)
        self.find_older = regex.compile("(?V1)" + older)

    def ids(self, text: str) -> np.ndarray:
        find = self.find_older if not _latin(text) and self.newer.search(text) else self.find
        if len(text) <= 16 * RUN:
            return np.fromiter(itertools.chain.from_iterable(map(self.pieces.__getitem__, find.findall(text))), np.int32)
        matches, runs = (m.group() for m in find.finditer(text)), []
        while run := list(itertools.islice(matches, RUN)):
            runs.append(np.fromiter(itertools.chain.from_iterable(map(self.pieces.__getitem__, run)), np.int32))
        return np.concatenate(runs)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Utf8Stream:
    """Characters from bytes that come in pieces. The machine's state is the
    bytes of a character not complete yet; wrong bytes become U+FFFD, the same
    as when all bytes are decoded at once."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = len(data) - _unfinished(data)
        self.held = data[n:]
        return data[:n].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def _following(lead: int) -> list[tuple[int, int]]:
    """The ranges of the bytes that must follow a lead byte."""
    any_ = (0x80, 0xBF)
    if 0xC2 <= lead <= 0xDF:
        return [any_]
    if 0xE0 <= lead <= 0xEF:
        return [{0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(lead, any_), any_]
    if 0xF0 <= lead <= 0xF4:
        return [{0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, any_), any_, any_]
    return []


def _unfinished(data: bytes) -> int:
    """Bytes at the end that begin a character and may still complete it."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if not 0x80 <= lead <= 0xBF:
            rest = _following(lead)
            ok = len(rest) >= back and all(lo <= b <= hi for b, (lo, hi) in zip(data[len(data) - back + 1:], rest))
            return back if ok else 0
    return 0


def decode_stream(runs: Iterable[list[int]], token: dict[int, bytes]) -> Iterator[str]:
    """Text of ids that come in runs; an id without a token is U+FFFD."""
    stream, unknown = Utf8Stream(), "�".encode()
    for run in runs:
        yield stream.feed(b"".join([token.get(i, unknown) for i in run]))
    yield stream.close()


_made: dict[tuple[bytes, str], Encoder] = {}


def _encoder(file: bytes, pattern: str) -> Encoder:
    """One encoder for all batches of a Python worker."""
    if (file, pattern) not in _made:
        _made.clear()
        _made[file, pattern] = Encoder(file, pattern)
    return _made[file, pattern]


def _shared(spark: SparkSession, ranks_path: str):
    """The rank file, read by the driver and sent to the executors: the size of
    a vocabulary, whatever the size of the tables."""
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           decoded_col: str | None = None) -> DataFrame:
    """Token ids of each whole text: (id, ids array<int>), a row for each row of
    ``docs``, repeated ones too; other columns are left behind, whatever their
    names. A null or empty text has no ids, a null id stays null. Each match of
    ``pattern`` is encoded by itself by the ranks of the file, without special
    tokens. ``decoded_col`` adds the text of the ids, decoded as by ``decode``
    in the same pass.
    """
    file = _shared(docs.sparkSession, ranks_path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file.value, pattern)
        token = encoder.pieces.transducer.merges.token
        for batch in batches:
            with _uncollected():
                found = [encoder.ids(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found) if found else [], pa.int32()))
            out = [batch.column(0), ids]
            if decoded_col:
                out.append(pa.array([_text(x, token) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["_id", "ids", "_decoded"][:len(out)])
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, ids array<int>" + (", _decoded string" if decoded_col else "")
    return rows.mapInArrow(run, schema).withColumnsRenamed({"_id": id_col, "_decoded": decoded_col or ""})


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """Without the cycle collector: states and pieces are many, and none is in a cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` and the text of its ids in ``out_col``.

    Ids go through an incremental UTF-8 machine in runs, so the characters of a
    very long list are made while its ids are read. A null list has a null
    text; a null or unknown id, and bytes that form no character, are U+FFFD.
    """
    file = _shared(encoded.sparkSession, ranks_path)
    schema = encoded.select(*[c for c in encoded.columns if c != out_col]).schema
    rows = encoded.select(*schema.fieldNames())
    at = schema.fieldNames().index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = Merges(file.value).token
        for batch in batches:
            lists = batch.column(at)
            texts = pa.array([_text(x, token) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts],
                                             names=[*batch.schema.names, out_col])
    return rows.mapInArrow(run, schema.add(out_col, "string"))


def _text(ids: pa.ListScalar, token: dict[int, bytes]) -> str | None:
    return "".join(decode_stream(_runs(ids.values), token)) if ids.is_valid else None


def _runs(ids: pa.Array) -> Iterator[list[int]]:
    for k in range(0, len(ids), RUN):
        yield ids.slice(k, RUN).fill_null(-1).to_numpy(zero_copy_only=False).tolist()
