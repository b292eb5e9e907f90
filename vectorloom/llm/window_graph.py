"""Scores and gradients of an attention layer over windows of vectors, as graphs that ONNX Runtime runs in a task.

A graph takes windows of vectors `x` (windows x places x width), the weights and the class of each place from
`first` on, row by row. The places before are context only. Weights are inputs, so one session serves all steps;
sessions are kept per worker process and use one thread. Graphs are written in the ONNX format directly.
"""

from __future__ import annotations

import struct

import numpy as np

from vectorloom.llm.text import worker_cache

WEIGHTS = ("query", "key", "value", "mix", "mix_add", "out", "out_add")
FUSED = "com.microsoft"
FLOATS, LONGS = 1, 7  # element types


def runtime():
    """ONNX Runtime where it is installed, or None."""
    try:
        import onnxruntime
    except ImportError:
        return None
    return onnxruntime


# ---- the ONNX format: tagged fields -----------------------------------------------------------------


def varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, value: int | float | str | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def attribute(name: str, value: int | float | str) -> bytes:
    place, kind = {int: (3, 2), float: (2, 1), str: (4, 3)}[type(value)]
    return field(1, name) + field(place, value) + field(20, kind)


def node(kind: str, inputs: str, outputs: str, domain: str = "", **attributes) -> bytes:
    names = [field(1, x) for x in inputs.split()] + [field(2, x) for x in outputs.split()]
    return b"".join([*names, field(4, kind), *(field(5, attribute(*x)) for x in attributes.items()), field(7, domain)])


def constant(name: str, value: np.ndarray) -> bytes:
    kind = LONGS if value.dtype == np.int64 else FLOATS
    return b"".join(field(1, int(d)) for d in value.shape) + field(2, kind) + field(8, name) + field(9, value.tobytes())


def shape(name: str, kind: int, sizes: list) -> bytes:
    dims = b"".join(field(1, field(2 if isinstance(d, str) else 1, d)) for d in sizes)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, dims)))


def session(nodes: list[bytes], inputs: list[tuple], outputs: list[tuple], constants: dict[str, np.ndarray]):
    graph = b"".join(field(1, n) for n in nodes) + field(2, "windows")
    graph += b"".join(field(5, constant(*x)) for x in constants.items())
    graph += b"".join(field(11, shape(*x)) for x in inputs) + b"".join(field(12, shape(*x)) for x in outputs)
    versions = [field(8, field(1, domain) + field(2, version)) for domain, version in (("", 18), (FUSED, 1))]
    runs = runtime()
    options = runs.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return runs.InferenceSession(field(1, 9) + b"".join(versions) + field(7, graph), options, providers=["CPUExecutionProvider"])


# ---- the graphs ----------------------------------------------------------------------------------


def build(first: int, sizes: tuple[int, int, int, int], gradient: bool):
    """Session for windows scored from place `first` on; `sizes`: places, width, hidden values, classes."""
    window, width, hidden, classes = sizes
    scored, scale = window - first, float(width**-0.5)
    nodes = [
        node("Slice", "x from to axis", "xq"),
        node("FusedMatMul", "xq query", "q", FUSED, alpha=scale),
        node("MatMul", "x key", "k"),
        node("MatMul", "x value", "v"),
        node("FusedMatMul", "q k", "scores", FUSED, transB=1),
        node("Add", "scores mask", "masked"),
        node("Softmax", "masked", "weight", axis=-1),
        node("MatMul", "weight v", "seen"),
        node("Concat", "xq seen", "pair", axis=2),
        node("Reshape", "pair to_pair", "both"),
        node("Gemm", "both mix mix_add", "mixed"),
        node("Tanh", "mixed", "hidden"),
        node("Gemm", "hidden out out_add", "logits"),
        node("LogSoftmax", "logits", "logs", axis=-1),
        node("GatherElements", "logs label", "found", axis=1),
    ]
    inputs = [
        ("x", FLOATS, ["count", window, width]),
        *[(name, FLOATS, [width, width]) for name in WEIGHTS[:3]],
        ("mix", FLOATS, [2 * width, hidden]),
        ("mix_add", FLOATS, [hidden]),
        ("out", FLOATS, [hidden, classes]),
        ("out_add", FLOATS, [classes]),
        ("label", LONGS, ["rows", 1]),
    ]
    constants = {
        "from": np.array([first]),
        "to": np.array([window]),
        "axis": np.array([1]),
        "mask": np.triu(np.full((1, window, window), -1e9, np.float32), 1)[:, first:],
        "to_pair": np.array([-1, 2 * width]),
    }
    if not gradient:
        return session(nodes, inputs, [("found", FLOATS, ["rows", 1])], constants)
    nodes = nodes[:-2] + [
        # Cross-entropy of the classes, each place by its `share`.
        node("Softmax", "logits", "chance", axis=-1),
        node("Mul", "chance share", "d_chance"),
        node("Neg", "share", "less"),
        node("ScatterElements", "d_chance label less", "d", axis=1, reduction="add"),
        node("Gemm", "hidden d", "g_out", transA=1),
        node("ReduceSum", "d rows_axis", "g_out_add", keepdims=0),
        node("Gemm", "d out", "d_hidden", transB=1),
        node("Mul", "hidden hidden", "square"),
        node("Sub", "one square", "slope"),
        node("Mul", "d_hidden slope", "d_mixed"),
        node("Gemm", "both d_mixed", "g_mix", transA=1),
        node("ReduceSum", "d_mixed rows_axis", "g_mix_add", keepdims=0),
        node("Gemm", "d_mixed mix", "d_both", transB=1),
        node("Reshape", "d_both from_pair", "d_pair"),
        node("Split", "d_pair", "d_own d_seen", axis=2, num_outputs=2),
        # The attention: d_masked = weight * (d_weight - sum of weight * d_weight), that sum being d_seen * seen.
        node("FusedMatMul", "d_seen v", "d_weight", FUSED, transB=1),
        node("FusedMatMul", "weight d_seen", "d_v", FUSED, transA=1),
        node("Mul", "d_seen seen", "parts"),
        node("ReduceSum", "parts last_axis", "mean", keepdims=1),
        node("Sub", "d_weight mean", "apart"),
        node("Mul", "weight apart", "d_masked"),
        node("FusedMatMul", "d_masked k", "d_q", FUSED, alpha=scale),
        node("FusedMatMul", "d_masked q", "d_k", FUSED, transA=1),
    ]
    for x, d, name in (("xq", "d_q", "query"), ("x", "d_k", "key"), ("x", "d_v", "value")):
        nodes += [
            node("Reshape", f"{x} to_width", f"{x}_for_{name}"),
            node("Reshape", f"{d} to_width", f"{d}_rows"),
            node("Gemm", f"{x}_for_{name} {d}_rows", f"g_{name}", transA=1),
            node("Gemm", f"{d}_rows {name}", f"d_x_{name}", transB=1),
        ]
    nodes += [
        node("Add", "d_x_key d_x_value", "d_x_context"),
        node("Reshape", "d_x_context to_x", "d_x"),
        node("Reshape", "d_x_query to_xq", "d_x_asked"),
        node("Add", "d_own d_x_asked", "d_xq"),
    ]
    constants |= {
        "rows_axis": np.array([0]),
        "last_axis": np.array([2]),
        "one": np.ones(1, np.float32),
        "from_pair": np.array([-1, scored, 2 * width]),
        "to_width": np.array([-1, width]),
        "to_x": np.array([-1, window, width]),
        "to_xq": np.array([-1, scored, width]),
    }
    kinds = {i[0]: i[1:] for i in inputs}
    outputs = [(f"g_{name}", *kinds[name]) for name in WEIGHTS]
    outputs += [("d_x", FLOATS, ["count", window, width]), ("d_xq", FLOATS, ["count", scored, width])]
    return session(nodes, [*inputs, ("share", FLOATS, ["rows", 1])], outputs, constants)


def kept(first: int, sizes: tuple[int, int, int, int], gradient: bool):
    cache, key = worker_cache(), ("window graph", first, sizes, gradient)
    if key not in cache:
        cache[key] = build(first, sizes, gradient)
    return cache[key]


def sizes_of(w: dict[str, np.ndarray]) -> tuple[int, int, int, int]:
    return *w["place"].shape, *w["out"].shape


def vectors(w: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    x = w["input"].take(rows, axis=0)
    x += w["place"]
    return x


def log_chances(w: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray, first: int) -> np.ndarray:
    """Log probability of the `classes` (windows x scored places) from place `first` on."""
    fed = {name: w[name] for name in WEIGHTS} | {"x": vectors(w, rows), "label": classes.reshape(-1, 1)}
    return kept(first, sizes_of(w), False).run(None, fed)[0].reshape(classes.shape)


def gradient(w: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray, first: int, total: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradient of the cross-entropy of the `classes` (-1: not scored), a `total`-th each, by the weights and by the vectors."""
    share = np.where(classes >= 0, np.float32(1 / total), np.float32(0)).reshape(-1, 1)
    fed = {name: w[name] for name in WEIGHTS} | {"x": vectors(w, rows), "label": np.maximum(classes, 0).reshape(-1, 1), "share": share}
    found = dict(zip([*WEIGHTS, "d_x", "d_xq"], kept(first, sizes_of(w), True).run(None, fed)))
    d_x = found.pop("d_x")
    d_x[:, first:] += found.pop("d_xq")
    return found, d_x
