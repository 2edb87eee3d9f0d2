"""The attention layer of ``lm`` as graphs that onnxruntime runs on one thread.

The same sums as the numpy code in ``lm``, in single precision; exponentials take a
third of the time. Weights are inputs of the graphs, so a process reads a graph once.
Without the package ``lm`` runs its numpy code.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

FLOAT, INT32, INT64 = 1, 6, 7
KINDS = {np.dtype("float32"): FLOAT, np.dtype("int32"): INT32, np.dtype("int64"): INT64}
LIMIT = 15.0  # of what attention takes the exponential of


@cache
def runtime():
    """The package, or None; loaded by the processes that run graphs only."""
    try:
        import onnxruntime
    except ImportError:
        return None
    return onnxruntime


# -- the file format: protocol buffers, of which a few fields are needed ---------
def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _part(field: int, x: bytes | str) -> bytes:
    x = x.encode() if isinstance(x, str) else x
    return _varint(field << 3 | 2) + _varint(len(x)) + x


def _attribute(name: str, value: int | str) -> bytes:  # of one number or one word
    return _part(1, name) + (_number(3, value) + _number(20, 2) if isinstance(value, int) else _part(4, value) + _number(20, 3))


class Graph:
    """Nodes in their order; each call of ``add`` gives the name of a new value."""

    def __init__(self):
        self.nodes, self.held, self.ins, self.names = [], [], [], 0

    def input(self, name: str, rank: int, kind: int = FLOAT) -> str:
        self.ins.append(self.value(name, rank, kind))
        return name

    def value(self, name: str, rank: int, kind: int = FLOAT) -> bytes:
        shape = b"".join(_part(1, _part(2, f"{name}{k}")) for k in range(rank))
        return _part(1, name) + _part(2, _part(1, _number(1, kind) + _part(2, shape)))

    def constant(self, x: np.ndarray) -> str:
        self.names += 1
        self.held.append(b"".join(_number(1, n) for n in x.shape) + _number(2, KINDS[x.dtype]) + _part(8, f"_{self.names}") + _part(9, x.tobytes()))
        return f"_{self.names}"

    def add(self, op: str, *ins: str, outs: int = 1, domain: str = "", **attributes) -> str | list[str]:
        names = []
        for k in range(outs):
            self.names += 1
            names.append(f"_{self.names}")
        body = b"".join(_part(1, x) for x in ins) + b"".join(_part(2, x) for x in names) + _part(4, op)
        self.nodes.append(body + b"".join(_part(5, _attribute(k, v)) for k, v in attributes.items()) + (_part(7, domain) if domain else b""))
        return names[0] if outs == 1 else names

    def product(self, a: str, b: str, left: int = 0, right: int = 0) -> str:
        """A product of matrices, or of stacks of them, either of which may be turned."""
        return self.add("FusedMatMul", a, b, domain="com.microsoft", transA=left, transB=right)

    def shaped(self, x: str, *shape: int) -> str:
        return self.add("Reshape", x, self.constant(np.array(shape, np.int64)))

    def session(self, outs: list[tuple[str, int]]):
        body = b"".join(_part(1, x) for x in self.nodes) + _part(2, "lm") + b"".join(_part(5, x) for x in self.held)
        body += b"".join(_part(11, x) for x in self.ins) + b"".join(_part(12, self.value(*x)) for x in outs)
        sets = b"".join(_part(8, _part(1, name) + _number(2, n)) for name, n in (("", 17), ("com.microsoft", 1)))
        options = runtime().SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        return runtime().InferenceSession(_number(1, 8) + _part(7, body) + sets, options, providers=["CPUExecutionProvider"])


# -- the layer -----------------------------------------------------------------
def _forward(g: Graph, window: int, stride: int, width: int) -> dict[str, str]:
    """All values up to the outputs, for ids of windows and the weights as inputs."""
    g.input("ids", 2, INT32)
    for name in ("E", "P", "Q", "KV", "A", "B", "C"):
        g.input(name, 2)
    for name in ("b", "c"):
        g.input(name, 1)
    one = lambda *x: g.constant(np.array(x, np.int64))
    v = {"x3": g.add("Add", g.add("Gather", "E", "ids"), "P")}
    v["x"] = g.shaped(v["x3"], -1, width)
    v["xq"] = g.shaped(g.add("Slice", v["x3"], one(window - stride), one(window), one(1)), -1, width)
    v["K"], v["V"] = g.add("Split", "KV", one(width, width), outs=2, axis=1)
    v["k"], v["v"] = (g.shaped(g.add("MatMul", v["x"], v[n]), -1, window, width) for n in "KV")
    v["q"] = g.shaped(g.add("MatMul", v["xq"], "Q"), -1, stride, width)
    v["s"] = g.product(v["q"], v["k"], right=1)
    later = np.where(np.tril(np.ones((stride, window)), window - stride) > 0, 0, -1e9).astype(np.float32)
    v["e"] = g.add("Softmax", g.add("Add", g.add("Min", v["s"], g.constant(np.float32(LIMIT))), g.constant(later)), axis=-1)
    v["h3"] = g.add("MatMul", v["e"], v["v"])
    v["h"] = g.shaped(v["h3"], -1, width)
    v["y"] = g.add("Tanh", g.add("Gemm", v["h"], "B", g.add("Gemm", v["xq"], "A", "b")))
    v["z"] = g.add("Gemm", v["y"], "C", "c")
    return v


@cache
def scorer(window: int, stride: int, width: int):
    """ln P(class) of ``goal(n, 1)``, a class a place."""
    g = Graph()
    v = _forward(g, window, stride, width)
    own = g.add("GatherElements", g.add("LogSoftmax", v["z"], axis=-1), g.input("goal", 2, INT64), axis=1)
    return g.session([(own, 2)])


ORDER = ("C", "c", "B", "b", "A", "Q", "KV", "P")


@cache
def gradients(window: int, stride: int, width: int):
    """Gradients in ``ORDER``, then those of all inputs, for ``goal(n, 1)`` and ``weight(n, 1)``, a place each."""
    g = Graph()
    v = _forward(g, window, stride, width)
    g.input("goal", 2, INT64)
    g.input("weight", 2)
    g.input("less", 2)  # -1 for each place
    one = lambda *x: g.constant(np.array(x, np.int64))
    out = g.add("ScatterElements", g.add("Softmax", v["z"], axis=-1), "goal", "less", axis=1, reduction="add")
    scaled = g.add("Mul", v["y"], "weight")
    last, bias = g.add("Split", g.product(g.add("Concat", scaled, "weight", axis=1), out, left=1), one(width, 1), outs=2, axis=0)
    got = {"C": last, "c": g.shaped(bias, -1)}
    slope = g.add("Sub", "weight", g.add("Mul", scaled, v["y"]))  # of tanh, 1 - y * y
    dy = g.add("Mul", g.product(out, "C", right=1), slope)
    got |= {"B": g.product(v["h"], dy, left=1), "b": g.add("ReduceSum", dy, one(0), keepdims=0), "A": g.product(v["xq"], dy, left=1)}
    # back through attention
    dh = g.shaped(g.product(dy, "B", right=1), -1, stride, width)
    inner = g.add("ReduceSum", g.add("Mul", dh, v["h3"]), one(2), keepdims=1)
    ds = g.add("Mul", g.add("Sub", g.product(dh, v["v"], right=1), inner), v["e"])
    ds = g.add("Mul", ds, g.add("Cast", g.add("Less", v["s"], g.constant(np.float32(LIMIT))), to=FLOAT))
    dk, dv = (g.shaped(g.product(a, b, left=1), -1, width) for a, b in ((ds, v["q"]), (v["e"], dh)))
    dq = g.shaped(g.add("MatMul", ds, v["k"]), -1, width)
    got["Q"] = g.product(v["xq"], dq, left=1)
    got["KV"] = g.add("Concat", g.product(v["x"], dk, left=1), g.product(v["x"], dv, left=1), axis=1)
    dx = g.add("Gemm", dv, v["V"], g.product(dk, v["K"], right=1), transB=1)
    late = g.add("Gemm", dq, "Q", g.product(dy, "A", right=1), transB=1)
    late = g.add("Pad", g.shaped(late, -1, stride, width), one(0, window - stride, 0, 0, 0, 0))
    dx = g.add("Add", g.shaped(dx, -1, window, width), late)
    got["P"] = g.add("ReduceSum", dx, one(0), keepdims=0)
    return g.session([(got[k], 1 if k in "bc" else 2) for k in ORDER] + [(dx, 3)])


@cache
def spread():
    """Rows added to the rows of a table that ``at(n, 1)`` names."""
    g = Graph()
    g.input("table", 2), g.input("at", 2, INT64), g.input("rows", 2)
    return g.session([(g.add("ScatterND", "table", "at", "rows", reduction="add"), 2)])
