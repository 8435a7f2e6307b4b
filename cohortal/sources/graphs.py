"""Small ONNX models from their parts: stand-ins for networks whose weights are not at hand."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence

# Field numbers and kinds of the format.
FLOAT, INT64 = 1, 7
ATTRIBUTE_KIND = {"float": 1, "int": 2, "string": 3, "floats": 6, "ints": 7, "strings": 8}


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: int | bytes | str) -> bytes:
    """One field: a whole number, or bytes with their length."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def attribute(name: str, value) -> bytes:
    many = isinstance(value, list | tuple)
    first = value[0] if many else value
    kind = "string" if isinstance(first, str) else "int" if isinstance(first, int) else "float"
    if kind == "float":
        body = field(7, struct.pack(f"<{len(value)}f", *value)) if many else varint(2 << 3 | 5) + struct.pack("<f", value)
    else:
        number = {"string": (4, 9), "int": (3, 8)}[kind][many]
        body = b"".join(field(number, v) for v in (value if many else [value]))
    return field(1, name) + body + field(20, ATTRIBUTE_KIND[kind + "s" * many])


def node(op: str, inputs: Sequence[str], outputs: Sequence[str], domain: str = "", **attributes) -> bytes:
    parts = [*(field(1, i) for i in inputs), *(field(2, o) for o in outputs), field(3, outputs[0]), field(4, op)]
    return b"".join([*parts, *(field(5, attribute(k, v)) for k, v in attributes.items()), field(7, domain)])


def tensor(name: str, shape: Sequence[int], values: Sequence[float]) -> bytes:
    return b"".join(field(1, d) for d in shape) + field(2, FLOAT) + field(8, name) + field(9, struct.pack(f"<{len(values)}f", *values))


def value(name: str, shape: Sequence[int | str], kind: int = FLOAT) -> bytes:
    """A named input or output; names in a shape are free dimensions."""
    dims = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in shape)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, dims)))


def model(nodes: Sequence[bytes], inputs: Sequence[bytes], outputs: Sequence[bytes], weights: Sequence[bytes] = (), name: str = "graph") -> bytes:
    """The bytes of a model file."""
    graph = b"".join([*(field(1, n) for n in nodes), field(2, name), *(field(5, w) for w in weights), *(field(11, i) for i in inputs), *(field(12, o) for o in outputs)])
    versions = field(8, field(1, "") + field(2, 13)) + field(8, field(1, "ai.onnx.ml") + field(2, 1))
    return field(1, 8) + field(7, graph) + versions


def mean_over(axes: Sequence[int], shape: Sequence[int | str], out: Sequence[int | str], keep: bool) -> bytes:
    """A network that averages its input over some axes."""
    return model([node("ReduceMean", ["input"], ["out"], axes=list(axes), keepdims=int(keep))], [value("input", shape)], [value("out", out)])


def linear_head(weights: Sequence[Sequence[float]], bias: Sequence[float]) -> bytes:
    """A head of labels and probabilities, as tree models have them: softmax of a linear map."""
    n, k = len(weights), len(bias)
    nodes = [node("Gemm", ["input", "w", "b"], ["z"]), node("Softmax", ["z"], ["probabilities"], axis=1), node("ArgMax", ["z"], ["label"], axis=1, keepdims=0)]
    flat = [v for row in weights for v in row]
    return model(nodes, [value("input", ["n", n])], [value("label", ["n"], INT64), value("probabilities", ["n", k])], [tensor("w", [n, k], flat), tensor("b", [k], list(bias))])


def tree_head(trees: Sequence[Mapping[str, Sequence]], n_features: int, classes: int) -> bytes:
    """A head of trees: per tree ``feature, mode, value, true, false`` by node and ``leaf`` as (node, class, weight)."""
    at: dict[str, list] = {k: [] for k in ("nodes_treeids", "nodes_nodeids", "nodes_featureids", "nodes_modes", "nodes_values", "nodes_truenodeids", "nodes_falsenodeids", "class_treeids", "class_nodeids", "class_ids", "class_weights")}
    for t, tree in enumerate(trees):
        size = len(tree["feature"])
        at["nodes_treeids"] += [t] * size
        at["nodes_nodeids"] += list(range(size))
        for key, source in (("nodes_featureids", "feature"), ("nodes_modes", "mode"), ("nodes_values", "value"), ("nodes_truenodeids", "true"), ("nodes_falsenodeids", "false")):
            at[key] += list(tree[source])
        for n, c, w in tree["leaf"]:
            for key, v in (("class_treeids", t), ("class_nodeids", n), ("class_ids", c), ("class_weights", float(w))):
                at[key].append(v)
    at["nodes_values"] = [float(v) for v in at["nodes_values"]]
    op = node("TreeEnsembleClassifier", ["input"], ["label", "probabilities"], "ai.onnx.ml", classlabels_int64s=list(range(classes)), post_transform="NONE", **at)
    return model([op], [value("input", ["n", n_features])], [value("label", ["n"], INT64), value("probabilities", ["n", classes])])
