"""A tiny ONNX file (softmax of a linear map), written field by field."""

import numpy as np


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _int(field, n):
    return _varint(field << 3) + _varint(n)


def _data(field, value):
    value = value.encode() if isinstance(value, str) else value
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _value(name, dims):
    shape = b"".join(_data(1, _data(2, d) if isinstance(d, str) else _int(1, d)) for d in dims)
    return _data(1, name) + _data(2, _data(1, _int(1, 1) + _data(2, shape)))


def linear_softmax(weights: np.ndarray) -> bytes:
    tensor = b"".join(_int(1, d) for d in weights.shape) + _int(2, 1) + _data(8, "w") + _data(
        9, weights.astype("<f4").tobytes())
    node = lambda op, inputs, output: _data(1, b"".join(_data(1, i) for i in inputs) + _data(2, output) + _data(4, op))
    graph = (node("MatMul", ["x", "w"], "z") + node("Softmax", ["z"], "p") + _data(2, "g") + _data(5, tensor)
             + _data(11, _value("x", ["n", weights.shape[0]])) + _data(12, _value("p", ["n", weights.shape[1]])))
    return _int(1, 8) + _data(7, graph) + _data(8, _data(1, "") + _int(2, 13))
