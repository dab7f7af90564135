"""Small ONNX graphs, written node by node and run by onnxruntime on one thread.

Tasks use them where numpy's own loops are slow (exponentials, products of many
small matrices, sums of rows by number)."""

from __future__ import annotations

import numpy as np

_CODES = {"float32": 1, "int64": 7, "float64": 11}
_sessions: dict[tuple, object] = {}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


class Graph:
    """Nodes of a graph; values are known by their names."""

    def __init__(self, kind: str, **inputs: str):
        self.kind, self.inputs, self.nodes, self.fixed = kind, inputs, [], []

    def fix(self, value: np.ndarray) -> str:
        """A constant."""
        name = f"c{len(self.fixed)}"
        value = np.asarray(value)
        self.fixed.append(b"".join(_field(1, n) for n in value.shape) + _field(2, _CODES[value.dtype.name])
                          + _field(8, name) + _field(9, value.tobytes()))
        return name

    def add(self, op: str, *inputs: str, **attributes: int | str | list[int]) -> str:
        name, kept = f"n{len(self.nodes)}", b""
        for key, v in attributes.items():
            # types of an attribute: 2 a number, 3 a string, 7 numbers
            if isinstance(v, int):
                own = _field(3, v) + _field(20, 2)
            elif isinstance(v, str):
                own = _field(4, v) + _field(20, 3)
            else:
                own = b"".join(_field(8, i) for i in v) + _field(20, 7)
            kept += _field(5, _field(1, key) + own)
        self.nodes.append(b"".join(_field(1, i) for i in inputs) + _field(2, name) + _field(3, name) + _field(4, op) + kept)
        return name

    def add_rows(self, table: str, rows: str, values: str, shape: tuple | None = None) -> str:
        """``values`` added to the numbered rows of ``table``, or of zeros of ``shape``."""
        if shape:
            table = self.fix(np.zeros(shape, self.kind))
        return self.add("ScatterND", table, self.add("Unsqueeze", rows, self.fix(np.array([-1]))), values, reduction="add")

    def data(self, outputs: dict[str, str]) -> bytes:
        """The model; ``outputs`` are the types of the named values."""
        def typed(name: str, kind: str) -> bytes:
            return _field(1, name) + _field(2, _field(1, _field(1, _CODES[kind])))
        body = (b"".join(_field(1, n) for n in self.nodes) + _field(2, "g") + b"".join(_field(5, f) for f in self.fixed)
                + b"".join(_field(11, typed(*i)) for i in self.inputs.items())
                + b"".join(_field(12, typed(*o)) for o in outputs.items()))
        return _field(1, 9) + _field(7, body) + _field(8, _field(1, "") + _field(2, 18))


def session(key: tuple, data):
    """The session of a model (``data()``), kept in this process under ``key``."""
    if key not in _sessions:
        import onnxruntime
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        _sessions[key] = onnxruntime.InferenceSession(data(), options, providers=["CPUExecutionProvider"])
    return _sessions[key]
