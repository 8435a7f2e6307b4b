"""Data sources of binary files: nodes of tree models in ONNX graphs, and arrays in npz archives.

``register`` makes the formats ``onnx_trees`` and ``npz`` known to a session. Files are read on
the executors, from any file system that Arrow opens; a file that cannot be read becomes a
row with an ``error`` and does not end the job.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NODES = (
    "path string, node string, op string, tree_id long, node_id long, feature_id long, mode string, value double, "
    "true_id long, false_id long, error string"
)
ARRAYS = "path string, member string, dtype string, shape array<long>, row long, values array<double>, error string"
#: Bytes of an uncompressed member that a task reads, and rows of an Arrow batch in bytes.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20

# Numbers of the protobuf fields that hold a tree model.
MODEL_GRAPH, GRAPH_NODE = 7, 1
NODE_NAME, NODE_OP, NODE_ATTRIBUTE = 3, 4, 5
ATTRIBUTE_NAME, ATTRIBUTE_FLOATS, ATTRIBUTE_INTS, ATTRIBUTE_STRINGS = 1, 7, 8, 9
# Operators with trees, and their attributes by column.
TREE_OPS = ("TreeEnsembleClassifier", "TreeEnsembleRegressor")
TREE_COLUMNS = {
    "tree_id": "nodes_treeids",
    "node_id": "nodes_nodeids",
    "feature_id": "nodes_featureids",
    "mode": "nodes_modes",
    "value": "nodes_values",
    "true_id": "nodes_truenodeids",
    "false_id": "nodes_falsenodeids",
}


def varint(data: memoryview, at: int) -> tuple[int, int]:
    """A base-128 number and where it ends."""
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def wire_fields(data: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """``number, kind, value`` of the fields of one protobuf message; bytes are views, not copies."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield number, kind, value
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size, at = varint(data, at)
        if size is None or at + size > len(data):
            raise ValueError(f"field {number} of kind {kind} does not end")
        yield number, kind, data[at : at + size]
        at += size


def inner(data: memoryview, number: int) -> Iterator[memoryview]:
    """Messages or strings of one field."""
    return (v for n, kind, v in wire_fields(data) if n == number and kind == 2)


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def attribute(data: memoryview) -> tuple[str, list]:
    """Name and values of an attribute that holds a list of integers, floats or strings, packed or not."""
    name, values = "", []
    for n, kind, v in wire_fields(data):
        if n == ATTRIBUTE_NAME and kind == 2:
            name = bytes(v).decode()
        elif n == ATTRIBUTE_STRINGS and kind == 2:
            values.append(bytes(v).decode())
        elif n == ATTRIBUTE_INTS:
            if kind == 0:
                values.append(signed(v))
            else:
                at = 0
                while at < len(v):
                    x, at = varint(v, at)
                    values.append(signed(x))
        elif n == ATTRIBUTE_FLOATS:
            values += struct.unpack(f"<{len(v) // 4}f", v)
    return name, values


def tree_nodes(data: bytes) -> Iterator[dict[str, list | str]]:
    """Per tree operator of a model its name, kind and node columns of equal length."""
    for graph in inner(memoryview(data), MODEL_GRAPH):
        for node in inner(graph, GRAPH_NODE):
            op = "".join(bytes(v).decode() for v in inner(node, NODE_OP))
            if op not in TREE_OPS:
                continue
            found = dict(attribute(a) for a in inner(node, NODE_ATTRIBUTE))
            columns = {c: found.get(a, []) for c, a in TREE_COLUMNS.items()}
            if len({len(v) for v in columns.values()}) > 1:
                raise ValueError(f"{op}: node attributes differ in length: {', '.join(f'{c} {len(v)}' for c, v in columns.items())}")
            yield {"node": "".join(bytes(v).decode() for v in inner(node, NODE_NAME)), "op": op, **columns}


class FileRange(InputPartition):
    """One file, or rows ``first`` to ``end`` of one member of it (``end`` -1: all)."""

    def __init__(self, path: str, member: str | None = None, first: int = 0, end: int = -1, error: str | None = None):
        self.path, self.member, self.first, self.end, self.error = path, member, first, end, error


def opened(path: str):
    """An Arrow file system and the path in it; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[str]:
    """The file, or all files below the folder that end in ``suffix``, by name."""
    from pyarrow import fs

    system, inside = opened(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    found = [info.path] if info.type == fs.FileType.File else [i.path for i in system.get_file_info(fs.FileSelector(inside, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(suffix)]
    return sorted(f"{scheme}{p}" for p in found)


class Binary(DataSource):
    """What both formats share: a path, options, one reader."""

    def need(self, option: str) -> str:
        if option not in self.options:
            raise ValueError(f"{self.name()}: the option {option} is needed")
        return self.options[option]


class OnnxTrees(Binary):
    """``onnx_trees``: a row per node of the tree models in ONNX files. Option ``ops``: only these operators."""

    @classmethod
    def name(cls) -> str:
        return "onnx_trees"

    def schema(self) -> str:
        return NODES

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.need("path"), self.options.get("ops"))


class TreeReader(DataSourceReader):
    def __init__(self, path: str, ops: str | None):
        self.path, self.ops = path, {o.strip() for o in ops.split(",")} if ops else None

    def partitions(self) -> Sequence[InputPartition]:
        return [FileRange(p) for p in listed(self.path, ".onnx")]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NODES.split(", ")]
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NODES.split(", ")])
        try:
            system, inside = opened(partition.path)
            with system.open_input_file(inside) as f:
                models = list(tree_nodes(f.read()))
        except Exception as e:
            yield pa.RecordBatch.from_pylist([{"path": partition.path, "error": f"{type(e).__name__}: {e}"}], schema)
            return
        for m in models:
            n = len(m["tree_id"])
            if n and (self.ops is None or m["op"] in self.ops):
                whole = {"path": [partition.path] * n, "node": [m["node"]] * n, "op": [m["op"]] * n, "error": [None] * n}
                columns = whole | {c: m[c] for c in TREE_COLUMNS}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], schema.field(c).type) for c in names], schema=schema)


class Npz(Binary):
    """``npz``: a row per row of each array. Option ``members``: only these arrays are opened.

    Rows of an array of more than two dimensions are flattened; a single number is one row.
    Booleans, integers and floats become doubles. A stored member is cut into ranges of rows, a
    compressed one is read by one task, as a stream. Writing: see ``ArrayWriter``.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return ARRAYS

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.need("path"), self.options.get("members"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(self.need("path"), overwrite, int(self.options.get("rows", 65_536)), self.options.get("compressed", "false").lower() == "true")


@dataclass
class Written(WriterCommitMessage):
    """Names of the archives of one task."""

    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """Archives with an array per column: numbers make a vector, arrays of one length a matrix.

    A task writes an archive for every ``rows`` rows, so that is what it holds. Archives are written to a
    folder of this attempt and moved when all tasks are done; a job that fails leaves nothing.
    Nulls and arrays of unequal lengths have no place in a matrix and raise.
    """

    def __init__(self, path: str, overwrite: bool, rows: int, compressed: bool):
        self.path, self.overwrite, self.rows, self.compressed = path.rstrip("/"), overwrite, rows, compressed
        self.part = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    @staticmethod
    def matrix(column: pa.ChunkedArray, name: str) -> np.ndarray:
        if column.null_count:
            raise ValueError(f"{name} has nulls")
        if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
            return column.to_numpy()
        flat = [np.asarray(v) for v in column.to_pylist()]
        if len({len(v) for v in flat}) > 1:
            raise ValueError(f"{name} has arrays of unequal lengths")
        return np.stack(flat) if flat else np.zeros((0, 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = opened(self.part)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        names, held, n = [], [], 0

        def flush() -> None:
            nonlocal held, n
            table = pa.Table.from_batches(held)
            name = f"part-{context.partitionId():05d}-{len(names):05d}-{context.taskAttemptId()}.npz"
            with system.open_output_stream(f"{folder}/{name}") as raw:
                save = np.savez_compressed if self.compressed else np.savez
                save(raw, **{c: self.matrix(table[c], c) for c in table.column_names})
            names.append(name)
            held, n = [], 0

        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                take = min(self.rows - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == self.rows:
                    flush()
        if n:
            flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = opened(self.path)
        _, part = opened(self.part)
        if self.overwrite and system.get_file_info(folder).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.path.endswith(".npz"):
                    system.delete_file(old.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{part}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, part = opened(self.part)
        if system.get_file_info(part).type == fs.FileType.Directory:
            system.delete_dir(part)


def array_header(f) -> tuple[np.dtype, tuple[int, ...], bool]:
    """Kind, shape and order of an open member, which then stands at its first value."""
    version = np.lib.format.read_magic(f)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.kind not in "biuf":
        raise ValueError(f"values of kind {kind} are not numbers")
    return kind, shape, by_column


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, members: str | None):
        self.path, self.members = path, [m.strip() for m in members.split(",")] if members else None

    def wanted(self, name: str) -> bool:
        return name.endswith(".npy") and (self.members is None or name[:-4] in self.members)

    def partitions(self) -> Sequence[InputPartition]:
        """From the archives' directories alone: a task per member, or per range of rows of a stored one."""
        out = []
        for path in listed(self.path, ".npz"):
            try:
                system, inside = opened(path)
                with system.open_input_file(inside) as raw, zipfile.ZipFile(raw) as z:
                    for info in z.infolist():
                        if self.wanted(info.filename):
                            out += self.ranges(z, info, path)
                    missing = set(self.members or ()) - {n[:-4] for n in z.namelist()}
                    out += [FileRange(path, m, error=f"KeyError: no array {m}") for m in sorted(missing)]
            except Exception as e:
                out.append(FileRange(path, error=f"{type(e).__name__}: {e}"))
        return out

    def ranges(self, z: zipfile.ZipFile, info: zipfile.ZipInfo, path: str) -> list[FileRange]:
        name = info.filename[:-4]
        if info.compress_type != zipfile.ZIP_STORED or info.file_size <= RANGE_BYTES:
            return [FileRange(path, name)]
        with z.open(info) as f:
            kind, shape, by_column = array_header(f)
        if by_column or not shape:
            return [FileRange(path, name)]
        rows = max(1, RANGE_BYTES // max(1, kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))))
        return [FileRange(path, name, lo, min(shape[0], lo + rows)) for lo in range(0, shape[0], rows)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("row", pa.int64()), ("values", pa.list_(pa.float64())), ("error", pa.string())])
        failed = lambda error: pa.RecordBatch.from_pylist([{"path": partition.path, "member": partition.member, "error": error}], schema)
        if partition.error:
            yield failed(partition.error)
            return
        try:
            system, inside = opened(partition.path)
            with system.open_input_file(inside) as raw, zipfile.ZipFile(raw) as z, z.open(f"{partition.member}.npy") as f:
                for kind, shape, first, block in self.blocks(f, partition):
                    n, width = block.shape
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(1, width)) if width else np.zeros(n + 1), pa.int32()), pa.array(block.astype(np.float64).ravel()))
                    same = lambda v, kind, n=n: pa.array([v] * n, kind)
                    yield pa.RecordBatch.from_arrays(
                        [same(partition.path, pa.string()), same(partition.member, pa.string()), same(kind, pa.string()), same(shape, pa.list_(pa.int64())),
                         pa.array(np.arange(first, first + n), pa.int64()), values, pa.nulls(n, pa.string())], schema=schema,
                    )
        except Exception as e:
            yield failed(f"{type(e).__name__}: {e}")

    def blocks(self, f, partition: FileRange) -> Iterator[tuple[str, list[int], int, np.ndarray]]:
        """Rows of a member as matrices of bounded size, in turn."""
        kind, shape, by_column = array_header(f)
        n, width = (shape[0], int(np.prod(shape[1:], dtype=np.int64))) if shape else (1, 1)
        end = n if partition.end < 0 else partition.end
        if by_column and len(shape) > 1:
            # Columns come first in the file: the array has to be whole.
            whole = np.frombuffer(f.read(), kind).reshape(shape, order="F").reshape(n, width)
            yield str(kind), list(shape), 0, whole
            return
        row = kind.itemsize * width
        f.seek(f.tell() + partition.first * row)
        step = max(1, BATCH_BYTES // max(1, row))
        for lo in range(partition.first, end, step):
            hi = min(end, lo + step)
            data = f.read((hi - lo) * row)
            if len(data) < (hi - lo) * row:
                raise ValueError(f"{partition.member} ends after {len(data)} bytes of rows {lo} to {hi}")
            yield str(kind), list(shape), lo, np.frombuffer(data, kind).reshape(hi - lo, width)


def register(spark: SparkSession) -> None:
    """Make the formats known to the session; to register again changes nothing."""
    for source in (OnnxTrees, Npz):
        spark.dataSource.register(source)


def read_tree_nodes(spark: SparkSession, path: str, ops: Sequence[str] = ()) -> DataFrame:
    """Nodes of the tree models below ``path``: see ``OnnxTrees``."""
    register(spark)
    return spark.read.format("onnx_trees").options(**{"ops": ",".join(ops)} if ops else {}).load(path)


def read_arrays(spark: SparkSession, path: str, members: Sequence[str] = ()) -> DataFrame:
    """Rows of the arrays in the archives below ``path``: see ``Npz``."""
    register(spark)
    return spark.read.format("npz").options(**{"members": ",".join(members)} if members else {}).load(path)


def write_arrays(df: DataFrame, path: str, rows: int = 65_536, compressed: bool = False, mode: str = "overwrite") -> None:
    """Columns of a table as arrays in archives of at most ``rows`` rows: see ``ArrayWriter``."""
    register(df.sparkSession)
    df.write.format("npz").mode(mode).options(rows=rows, compressed=str(compressed)).save(path)


def joined_features(arrays: DataFrame, parts: Sequence[str]) -> DataFrame:
    """``path, row, features``: the named arrays of a file side by side, in the given order.

    A row that one of the arrays lacks stays, without features; ``present`` is the number of arrays
    that have it. Failed members have no rows.
    """
    own = arrays.where(F.col("error").isNull() & F.col("member").isin(*parts))
    each = [F.max(F.when(F.col("member") == p, F.col("values"))).alias(f"_{k}") for k, p in enumerate(parts)]
    wide = own.groupBy("path", "row").agg(*each)
    present = sum((F.col(f"_{k}").isNotNull().cast("int") for k in range(len(parts))), F.lit(0))
    return wide.select("path", "row", F.concat(*[f"_{k}" for k in range(len(parts))]).alias("features"), present.alias("present"))
