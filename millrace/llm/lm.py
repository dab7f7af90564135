"""Language-model scores: a small causal self-attention model over subword ids.

Passes over the documents:

1. Words of all training texts are counted (numpy within a task, then an
   aggregate on the word). These counts give the base score and, through the
   public subword vocabulary, the corpus frequency of every subword id.
2. The model predicts the next of ``classes`` symbols: the most frequent ids
   one by one, all others as one symbol whose ids are told apart by their
   corpus frequency, so every id has a probability. The softmax has two levels:
   the ``head`` most frequent symbols and "tail", then the symbols of the tail,
   which only tokens of the tail need. Either goes over groups of symbols spelled
   alike and then the symbols of one group. One layer of causal
   self-attention with a bias for each distance reads up to 2 * ``stride``
   symbols. It is trained by data-parallel averaging: every training
   text is read whole in one of the rounds, each task improves the current
   weights on all windows of its texts, a run of windows at a time, and the
   weights are averaged, weighted by the number of targets. A round has about
   seven times the texts of all rounds before it: the early ones bring all tasks
   to a common place, from where weights can be averaged.
3. Every whole text is cut into windows of 2 * ``stride`` symbols that overlap
   by half: the first half is context only, the second half is scored, so each
   token is scored once. Windows go through masked attention in batches.

Words with at least a threshold count (at most ``frequent`` of them, of at most
64 bytes) have their counts broadcast as two arrays of numbers; other words of
a text are joined with the count table.

Defined cases: a null text is empty and consists of the end token; a null
doc_id counts as held out; without training texts N and V are 0 and the model
is uniform; repeated rows are scored one by one; an empty table gives an empty
result; other columns are not read. A lone surrogate scores as a replacement
character in the model.
"""

from __future__ import annotations

import base64
import importlib.util
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, id_bucket, materialize, sum_arrays
from .onnx import Graph, session
from .textscan import NON_SPACE, Scan, scan

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
LONGEST = 64
#: larger runs repeat fewer words
RUN_BYTES = 1_000_000
#: windows of a training step
BATCH = 128
#: times as many where a task has many windows
WIDE = 4
#: outputs of a softmax of one level
FLAT = 64
#: states multiplied at once by the weights of their targets' group
CHUNK = 32
#: the score of what is left out
NEVER = -1e9
_encoders: dict[str, tuple] = {}


class Vocabulary:
    """A public rank file and its pattern, read on the driver and sent with the tasks."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.data = f.read()
        spec = importlib.util.spec_from_file_location("vocabulary", os.path.join(os.path.dirname(path), "__init__.py"))
        names = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(names)
        self.pattern = names.PATTERN


def encoder(source: str | Vocabulary) -> tuple:
    """(encoding, which ids begin with a blank) of a public rank file."""
    path = source if isinstance(source, str) else source.path
    if path not in _encoders:
        import tiktoken
        own = Vocabulary(path) if isinstance(source, str) else source
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, own.data.splitlines())}
        opens = np.zeros(END + 1, dtype=bool)
        opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        _encoders[path] = (tiktoken.Encoding("own", pat_str=own.pattern, mergeable_ranks=ranks, special_tokens={}), opens)
    return _encoders[path]


def spelling_order(source: Vocabulary) -> np.ndarray:
    """Place of every subword id in the order of their bytes."""
    token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, source.data.splitlines())}
    place = np.zeros(END + 1, dtype=np.int64)
    place[sorted(range(END + 1), key=lambda i: token.get(i, b""))] = np.arange(END + 1)
    return place


def encode_words(words: list[bytes], path: str | Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): subword ids of ``' ' + word``; those of word i are
    first[i]:first[i + 1]. A word holds no blank, so an id that begins with a
    blank begins a word."""
    enc, opens = encoder(path)
    ids, firsts, at = [], [np.zeros(0, np.int64)], 0
    for lo in range(0, len(words), 5_000):
        text = (b" " + b" ".join(words[lo:lo + 5_000])).decode("utf-8", "replace")
        part = np.array(enc.encode_ordinary(text), dtype=np.int32)
        ids.append(part)
        firsts.append(np.flatnonzero(opens[part]) + at)
        at += len(part)
    first = np.concatenate(firsts + [np.array([at])])
    assert len(first) == len(words) + 1
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), first


def _unique_words(s: Scan) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(hash, word, number of the word at each place) of a scan's distinct words,
    in order of their first places."""
    back, value = pd.factorize(s.hash)
    first = np.zeros(len(value), dtype=np.int64)
    first[back[::-1]] = np.arange(len(back))[::-1]
    return value, [s.word(i) for i in first], back


# ---------------------------------------------------------------- counting

def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the training texts of ``docs`` (held_out, text)."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, _, s in scan(b["text"].tolist(), NON_SPACE, run_bytes=RUN_BYTES):
                _, words, back = _unique_words(s)
                yield pd.DataFrame({"word": words, "c": np.bincount(back, minlength=len(words))})

    rows = docs.filter("NOT held_out").select("text").mapInPandas(giving_back(part), "word binary, c long")
    return materialize(rows.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def subword_counts(counts: DataFrame, path: str | Vocabulary) -> np.ndarray:
    """Corpus frequency of every subword id, from the count table."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(END + 1)
        for b in batches:
            ids, first = encode_words([bytes(w) for w in b["word"]], path)
            total += np.bincount(ids, np.repeat(b["c"].to_numpy(float), np.diff(first)), minlength=END + 1)
        yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "v": [total.tobytes()]})

    return sum_arrays(counts.mapInPandas(part, "g int, v binary"), END + 1)


def frequent_counts(counts: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes in order, counts, least count) of at most ``frequent`` words."""
    level = F.floor(F.log2("c") * 4)
    bins = sorted(((r["k"], r["n"], r["least"]) for r in counts.groupBy(level.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    least, many = 1 << 62, 0
    for _, n, low in bins:
        many += n
        if many > frequent:
            break
        least = low

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [bytes(w) for w in b["word"]]
            s = Scan(b"\n".join(words), np.cumsum([len(w) + 1 for w in words]), NON_SPACE)
            yield pd.DataFrame({"h": s.hash.view(np.int64), "c": b["c"].to_numpy()})

    got = (counts.filter((F.col("c") >= least) & (F.length("word") <= LONGEST))
           .mapInPandas(hashed, "h long, c long").toPandas())
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["c"].to_numpy(np.int64)[order], least


# ------------------------------------------------------------------- model

class Softmax:
    """A softmax over ``n`` outputs of a state. Beyond ``FLAT`` outputs it has two
    levels, groups of neighbours and then the outputs of the target's group, so a
    state meets some 2 * sqrt(n) of them. Weights: ``name`` [dim + 1, n or groups],
    and of the groups ``name`` + "g" [groups, dim + 1, width]; biases come last."""

    def __init__(self, n: int, dim: int, name: str):
        self.n, self.name, self.width = n, name, 1 if n <= FLAT else math.ceil(n ** 0.5)
        self.groups = -(-n // self.width)
        self.shapes = {name: (dim + 1, self.groups)}
        if self.width > 1:
            self.shapes[name + "g"] = (self.groups, dim + 1, self.width)

    def start(self, w: dict, seen: np.ndarray) -> None:
        """Biases that give the outputs the frequencies ``seen``."""
        grid = np.zeros(self.groups * self.width)
        grid[:self.n] = seen
        grid = grid.reshape(self.groups, self.width)
        w[self.name][-1] = np.log(grid.sum(1) / grid.sum())
        if self.width > 1:
            w[self.name + "g"][:, -1] = np.where(grid > 0, np.log(np.maximum(grid, 1e-300) / grid.sum(1, keepdims=True)), NEVER)

    def feed(self, rows: np.ndarray | None, t: np.ndarray, each: np.ndarray | None) -> tuple[dict, list]:
        """(the graph's inputs, for each level the target's place in its outputs and
        the number of the target) of targets ``t``, those of ``rows`` if not all."""
        group, name = t // self.width, self.name
        place = np.arange(len(t))
        found, own = {}, [(place * self.groups + group, place)]
        if rows is not None:
            found[name + "_rows"] = rows
        if each is not None:
            found[name + "_each"] = np.repeat(each, self.groups).reshape(len(t), self.groups)
            found[name + "_hot"] = _hot((len(t), self.groups), own[0][0], each)
        if self.width > 1:
            # in order of group, every group filled up to whole chunks
            order = np.argsort(group.astype(np.uint16), kind="stable")
            count = np.bincount(group, minlength=self.groups)
            chunks = -(-count // CHUNK)
            chunks[0] = max(chunks[0], not len(t))  # one at least
            shift = (np.cumsum(chunks) - chunks) * CHUNK - (np.cumsum(count) - count)
            size = int(chunks.sum())
            place = place + shift[group[order]]
            at = np.zeros(size * CHUNK, dtype=np.int64)
            at[place] = order if rows is None else rows[order]
            found |= {name + "g_rows": at, name + "g_of": np.repeat(np.arange(self.groups), chunks)}
            own.append((place * self.width + (t % self.width)[order], order))
            if each is not None:
                weight = np.repeat(_hot((len(at),), place, each[order]), self.width)
                found |= {name + "g_each": weight.reshape(size, CHUNK, self.width),
                          name + "g_hot": _hot((size, CHUNK, self.width), own[1][0], each[order])}
        return found, own

    def inputs(self, all_rows: bool, learn: bool, kind: str) -> dict[str, str]:
        levels = list(self.shapes)
        named = {} if all_rows else {self.name + "_rows": "int64"}
        if self.width > 1:
            named |= {self.name + "g_rows": "int64", self.name + "g_of": "int64"}
        return named | dict.fromkeys(levels, kind) | {n + end: kind for n in levels for end in ("_each", "_hot") if learn}

    def levels(self, g: Graph, h: str, all_rows: bool, learn: bool) -> list[tuple]:
        """For each level (scores of all outputs, sums of their exponentials) or, to
        ``learn``, (gradient of the weights, rows and gradient of the states ``h``)."""
        found = []
        for name in self.shapes:
            u, x, turn = name, h, [1, 0]
            rows = "" if all_rows and name == self.name else name + "_rows"
            if rows:
                x = g.add("Gather", h, rows)
            if name != self.name:
                u, turn = g.add("Gather", name, name + "_of"), [0, 2, 1]
                x = g.add("Reshape", x, g.fix(np.array([-1, CHUNK, self.shapes[name][1]])))
            z = g.add("MatMul", x, u)
            if not learn:
                found.append((z, g.add("ReduceSum", g.add("Exp", z), g.fix(np.array([-1])), keepdims=0)))
                continue
            dz = g.add("Sub", g.add("Mul", g.add("Softmax", z), name + "_each"), name + "_hot")
            du = g.add("MatMul", g.add("Transpose", x, perm=turn), dz)
            dx = g.add("MatMul", dz, g.add("Transpose", u, perm=turn))
            if name != self.name:
                du = g.add_rows("", name + "_of", du, self.shapes[name])
                dx = g.add("Reshape", dx, g.fix(np.array([-1, self.shapes[name][1]])))
            found.append((du, rows, dx))
        return found


def _hot(shape: tuple, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros(shape, value.dtype)
    out.reshape(-1)[at] = value
    return out


class Model:
    """Weights as one run of float32 numbers, and the meaning of ids."""

    def __init__(self, id_counts: np.ndarray, classes: int, dim: int, stride: int, seed: int, head: int,
                 spelled: np.ndarray | None = None):
        self.k, self.d, self.s, self.tail = classes, dim, stride, min(head, classes) - 1
        self.gap = (np.arange(stride)[:, None] + stride) - np.arange(2 * stride)[None, :]
        top = np.argsort(-id_counts, kind="stable")[:classes - 1]
        if spelled is not None:
            top = np.concatenate([part[np.argsort(spelled[part])] for part in (top[:self.tail], top[self.tail:])])
        self.symbol = np.full(END + 1, classes - 1, dtype=np.int32)
        self.symbol[top] = np.arange(classes - 1)
        rest = np.where(self.symbol == classes - 1, id_counts + 0.5, 0.0)
        self.within = np.where(rest > 0, np.log(np.maximum(rest, 1e-300) / rest.sum()), 0.0).astype(np.float32)
        seen = np.bincount(self.symbol, id_counts, minlength=classes) + 1.0
        k1 = classes + 1
        self.first, self.rest = Softmax(self.tail + 1, dim, "o"), Softmax(classes - self.tail, dim, "o2")
        self.shapes = ({n: (k1, dim) for n in "qkvr"} | {"far": (2 * stride,)} | self.first.shapes | self.rest.shapes)
        rng = np.random.default_rng(seed)
        flat = [rng.normal(0, 0.3 if n in "qkvr" else 0.05, s).ravel() for n, s in self.shapes.items()]
        self.flat = np.concatenate(flat).astype(np.float32)
        w = self.view(self.flat)
        self.first.start(w, np.append(seen[:self.tail], seen[self.tail:].sum()))
        self.rest.start(w, seen[self.tail:])
        w["far"][:] = -0.1 * np.arange(2 * stride)

    def view(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = math.prod(shape)
            out[name] = flat[at:at + n].reshape(shape)
            at += n
        # weights and biases of the softmax, or of its groups
        for name, end in (("o", ""), ("o2", "2")):
            out["u" + end], out["b" + end] = out[name][:-1], out[name][-1]
        return out

    def blocks(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of sequences first[i]:first[i + 1] of ``symbols``: (inputs
        [n, 2 s], targets [n, s], place of each target or -1). The symbol
        ``classes`` stands for what precedes a sequence."""
        s, length = self.s, np.diff(first)
        many = -(-length // s)
        start = np.concatenate(([0], np.cumsum(many + 1)))
        seq = np.repeat(np.arange(len(length)), length)
        at = np.arange(len(symbols)) - first[:-1][seq]
        slot = (start[:-1][seq] + 1) * s + at
        target = np.full(start[-1] * s, -1, dtype=np.int64)
        target[slot] = np.arange(len(symbols))
        inputs = np.full(start[-1] * s + 1, self.k, dtype=np.int32)
        inputs[slot + 1] = symbols
        # the first place of a sequence is read as "before the text"
        inputs[(start[:-1] + 1) * s] = self.k
        grid = inputs[:-1].reshape(-1, s)
        used = np.ones(start[-1], dtype=bool)
        used[start[:-1]] = False
        own = np.flatnonzero(used)
        place = target.reshape(-1, s)[own]
        return np.concatenate((grid[own - 1], grid[own]), axis=1), np.where(place >= 0, symbols[place], 0), place

    def _graph(self, kind: str, learn: bool) -> bytes:
        """What the levels of the softmax tell or, to ``learn``, the gradient of the
        mean loss in parts."""
        d, swap = self.d, [0, 2, 1]
        g = Graph(kind, **dict.fromkeys(["q", "k", "v", "r", "bias", "one"], kind), **dict.fromkeys(["x", "now"] * learn, "int64"),
                  **self.first.inputs(True, learn, kind), **self.rest.inputs(False, learn, kind))
        z = g.add("MatMul", "q", g.add("Transpose", "k", perm=swap))
        a = g.add("Softmax", g.add("Add", z, "bias"))
        state = g.add("Tanh", g.add("Add", g.add("MatMul", a, "v"), "r"))
        h = g.add("Concat", g.add("Reshape", state, g.fix(np.array([-1, d]))), "one", axis=1)
        levels = self.first.levels(g, h, True, learn) + self.rest.levels(g, h, False, learn)
        if not learn:
            return g.data({n: kind for v in levels for n in v})
        dh = levels[0][2]
        for _, rows, dx in levels[1:]:
            dh = g.add_rows(dh, rows, dx)
        dh = g.add("Slice", dh, g.fix(np.array([0])), g.fix(np.array([d])), g.fix(np.array([1])))
        dh = g.add("Mul", g.add("Reshape", dh, g.fix(np.array([-1, self.s, d]))),
                   g.add("Sub", g.fix(np.array(1, kind)), g.add("Mul", state, state)))
        da = g.add("Mul", a, g.add("MatMul", dh, g.add("Transpose", "v", perm=swap)))
        ds = g.add("Sub", da, g.add("Mul", a, g.add("ReduceSum", da, g.fix(np.array([-1])), keepdims=1)))
        far = g.add("ReduceSum", ds, g.fix(np.array([0])), keepdims=0)
        own = {"q": g.add("MatMul", ds, "k"), "k": g.add("MatMul", g.add("Transpose", ds, perm=swap), "q"),
               "v": g.add("MatMul", g.add("Transpose", a, perm=swap), dh), "r": dh}
        tables = [g.add_rows("", "now" if n in "qr" else "x", v, self.shapes[n]) for n, v in own.items()]
        return g.data(dict.fromkeys(tables + [far] + [v[0] for v in levels], kind))

    def _run(self, w: dict, x: np.ndarray, y: np.ndarray, used: np.ndarray | None = None) -> tuple[list, list]:
        """(what the graph tells of windows x and targets y, or to learn from those
        ``used``; the targets' places in it, see ``Softmax.feed``)."""
        s, kind, t, learn = self.s, w["q"].dtype, y.ravel(), used is not None
        now = np.ascontiguousarray(x[:, s:])
        bias = np.empty((len(x), s, 2 * s), kind)
        bias[:] = np.where(self.gap >= 0, w["far"][np.maximum(self.gap, 0)], NEVER)
        # padding is not read, but the place before a text itself may be
        hidden = x == self.k
        hidden[:, s] = False
        some = np.flatnonzero(hidden.any(1))
        bias[some] += np.where(hidden[some, None, :], kind.type(NEVER), kind.type(0))
        rare = np.flatnonzero((t >= self.tail) & used.ravel() if learn else t >= self.tail)
        each = (used.ravel() / max(1, used.sum())).astype(kind) if learn else None
        one, own = self.first.feed(None, np.minimum(t, self.tail), each if learn else None)
        two, more = self.rest.feed(rare, t[rare] - self.tail, each[rare] if learn else None)
        feed = {n: w[n].take(now if n in "qr" else x, 0) for n in "qkvr"} | one | two | {
            n: w[n] for n in self.shapes if n.startswith("o")} | {"bias": bias, "one": np.ones((len(t), 1), kind)}
        if learn:
            feed |= {"x": x, "now": now}
        graph = session(("lm", learn, kind.name, *self.shapes.items()), lambda: self._graph(kind.name, learn))
        return graph.run(None, feed), own + [(place, rare[number]) for place, number in more]

    def log_prob(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, batch: int = 512) -> np.ndarray:
        """Log probabilities of the targets, in batches that stay in cache."""
        w, out = self.view(flat.copy()), np.empty(y.shape, dtype=np.float32)
        for n in self.shapes:
            if n.startswith("o"):
                # a state's numbers are at most 1: with one bound for all scores no exponential overflows
                w[n][..., -1, :] -= max(0.0, (np.abs(w[n][..., :-1, :]).sum(-2) + w[n][..., -1, :]).max() - 60)
        for lo in range(0, len(x), batch):
            got = np.zeros(y[lo:lo + batch].size)
            found, places = self._run(w, x[lo:lo + batch], y[lo:lo + batch])
            for z, total, (place, number) in zip(found[::2], found[1::2], places):
                got[number] += z.reshape(-1).take(place) - np.log(total.reshape(-1).take(place // z.shape[-1]))
            out[lo:lo + batch] = got.reshape(-1, self.s)
        return out

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
        found = dict(zip(self.shapes, self._run(self.view(flat), x.astype(np.int64, copy=False), y, used)[0]))
        found["far"] = np.bincount(np.maximum(self.gap, 0).ravel(), found["far"].ravel(), minlength=2 * self.s)
        return np.concatenate([found[n].ravel() for n in self.shapes], dtype=flat.dtype)

    def improve(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, used: np.ndarray, rate: float,
                least_steps: int, seed: int, batch: int = BATCH) -> np.ndarray:
        """Adam over all windows, at least once and until ``least_steps`` steps.
        Where windows are enough for these, ``WIDE`` times as many make a step and
        the rate grows with the root."""
        flat, m, v, part = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        x = x.astype(np.int64, copy=False)
        rng, each = np.random.default_rng(seed), -(-len(x) // batch)
        epochs = min(20, max(1, -(-least_steps // each)))
        if each >= least_steps:
            batch, rate = WIDE * batch, rate * WIDE ** 0.5
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo:lo + batch]
                g = self.gradient(flat, x.take(at, 0), y.take(at, 0), used.take(at, 0))
                step += 1
                # sums of 0.9 ** age * g and of 0.99 ** age * g * g
                m *= 0.9
                m += g
                v *= 0.99
                g *= g
                v += g
                spread = math.sqrt(0.01 / (1 - 0.99 ** step))
                np.sqrt(v, out=part)
                part += 1e-6 / spread
                np.divide(m, part, out=part)
                part *= rate * (1 - 0.9 * step / steps) * 0.1 / (1 - 0.9 ** step) / spread
                flat -= part
        return flat


def _sequences(s: Scan, words: list[bytes], back: np.ndarray, path: str | Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids with an END after every text, first) of a scan whose
    distinct words are known."""
    ids, first = encode_words(words, path)
    size = np.diff(first)[back]
    ends = np.cumsum(size)
    flat = ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first[back], size)]
    cut = np.concatenate(([0], ends))[s.first]
    return np.insert(flat, cut[1:], END), cut + np.arange(len(cut))


def improve_on_runs(model: Model, flat: np.ndarray, windows: Iterator[tuple], every: int, rate: float,
                    least_steps: int, seed: int) -> tuple[np.ndarray, int]:
    """(weights, number of targets) after all ``windows`` (runs of inputs, targets
    and which targets count), about ``every`` windows shuffled at a time. A run's
    rate falls with the root of its number."""
    held, size, steps, targets, runs = [], 0, 0, 0, 0

    def learn():
        nonlocal flat, held, size, steps, targets, runs
        x, y, used = (np.concatenate(p) for p in zip(*held))
        flat = model.improve(flat, x, y, used, rate / (runs + 1) ** 0.5, max(0, least_steps - steps), seed + runs)
        steps, targets, runs = steps + -(-size // BATCH), targets + int(used.sum()), runs + 1
        held, size = [], 0

    for x, y, used in windows:
        for lo in range(0, len(x), every):
            held.append((x[lo:lo + every], y[lo:lo + every], used[lo:lo + every]))
            size += len(held[-1][0])
            if size >= every:
                learn()
    if size:
        learn()
    return flat, targets


def train(docs: DataFrame, model: Model, path: str | Vocabulary, rounds: int, every: int, rate: float,
          least_steps: int, seed: int) -> np.ndarray:
    """Average of the weights that the tasks reach, ``rounds`` times. Every training
    text is in one round."""
    texts = docs.filter("NOT held_out AND text IS NOT NULL")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(8 ** 12))
    flat = model.flat
    for r in range(rounds):
        now = flat

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def windows():
                for b in batches:
                    for _, _, s in scan(b["text"].tolist(), NON_SPACE, run_bytes=RUN_BYTES):
                        ids, first = _sequences(s, *_unique_words(s)[1:], path)
                        x, y, place = model.blocks(model.symbol[ids], first)
                        yield x, y, place >= 0

            got, n = improve_on_runs(model, now, windows(), every, rate / (r + 1), least_steps, seed + r)
            if n:
                yield pd.DataFrame({"g": [TaskContext.get().partitionId()],
                                    "v": [np.concatenate((got.astype(np.float64) * n, [float(n)])).tobytes()]})

        # of the texts, a round leaves one in eight to those before it
        left = draw % 8 ** (rounds - 1 - r) == 0
        own = texts.filter(left & (draw % 8 ** (rounds - r) != 0) if r else left).select("text")
        total = sum_arrays(own.mapInPandas(giving_back(part), "g int, v binary"), len(flat) + 1)
        if total[-1] > 0:
            flat = (total[:-1] / total[-1]).astype(np.float32)
    return flat


# ----------------------------------------------------------------- scoring

SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, "
          "score double, rare array<binary>")


def score(docs: DataFrame, path: str = VOCABULARY, classes: int = 1024, head: int = 128, dim: int = 16, stride: int = 12,
          frequent: int = 500_000, rounds: int = 2, every: int = 100_000,
          rate: float = 0.02, least_steps: int = 500, seed: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    All training texts train the model, about ``every`` windows shuffled at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       (id_bucket("doc_id", 10) == 0).alias("held_out"))
    path = Vocabulary(path)
    counts = count_words(docs)
    texts = docs.filter("NOT held_out").count()
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = whole["n"] + texts, whole["v"] + (texts > 0)
    ids = subword_counts(counts, path)
    ids[END] = texts
    model = Model(ids, classes, dim, stride, seed, head, spelling_order(path))
    flat = train(docs, model, path, rounds, every, rate, least_steps, seed)
    known_hash, known_count, least = frequent_counts(counts, frequent)
    table = spark.sparkContext.broadcast((model, flat, known_hash, known_count))
    end_log = float(np.log10(texts + 0.1))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, flat, hashes, found_counts = table.value
        logs = np.log10(found_counts + 0.1)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            doc_ids, held = b["doc_id"].astype("Int64"), b["held_out"]
            for lo, hi, s in scan(b["text"].tolist(), NON_SPACE, run_bytes=RUN_BYTES):
                value, words, back = _unique_words(s)
                at = np.minimum(np.searchsorted(hashes, value), max(0, len(hashes) - 1))
                hit = hashes[at] == value if len(hashes) else np.zeros(len(value), bool)
                of = np.repeat(np.arange(hi - lo), np.diff(s.first))
                base = np.bincount(of, np.where(hit, logs[at] if len(logs) else 0.0, 0.0)[back], minlength=hi - lo)
                known = np.bincount(of, hit[back], minlength=hi - lo)
                rare = np.flatnonzero(~hit[back])
                cut = np.searchsorted(rare, s.first)
                ids, first = _sequences(s, words, back, path)
                symbols = model.symbol[ids]
                x, y, place = model.blocks(symbols, first)
                each = model.within[ids].astype(np.float64)
                got = model.log_prob(flat, x, y)
                each[place[place >= 0]] += got[place >= 0]
                total = np.add.reduceat(each, first[:-1]) / np.log(10)
                yield pd.DataFrame({
                    "row": np.arange(row, row + hi - lo), "doc_id": doc_ids.iloc[lo:hi].to_numpy(),
                    "held_out": held.iloc[lo:hi].to_numpy(), "n_tokens": np.diff(s.first) + 1,
                    "known": known.astype(np.int64) + (texts > 0), "logs": base + end_log, "score": total,
                    "rare": [[s.word(i) for i in rare[cut[k]:cut[k + 1]]] for k in range(hi - lo)]})
                row += hi - lo

    rows = materialize(docs.mapInPandas(giving_back(part), SCORED), "scored")
    others = counts.filter((F.col("c") < least) | (F.length("word") > LONGEST))
    told = (rows.select("row", F.explode("rare").alias("word")).join(others, "word", "left")
            .groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"),
                                F.count("c").alias("more_known")))
    per_token = float(np.log10(tokens + 0.1 * (distinct + 1)))
    return rows.drop("rare").join(told, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"), "score")
