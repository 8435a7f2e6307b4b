"""Networks in ONNX files as steps of a plan: what lies between them are array expressions, and failures are values."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.operators import classify as C
from cohortal.operators import picture as P

RESULT = "struct<values: array<double>, error: string>"


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of one model file, by any path that Spark reads."""
    rows = spark.read.format("binaryFile").load(path).select("content").take(2)
    if len(rows) != 1:
        raise ValueError(f"{path}: {'no' if not rows else 'more than one'} model file")
    return bytes(rows[0].content)


@dataclass(frozen=True)
class Net:
    """A network of a step: its file, the ``values`` it sees, and the network of the same step whose output follows them."""

    model: bytes
    values: Column
    shape: Sequence[int] | None = None
    output: int = 0
    after: str | None = None


def run_model(spark: SparkSession, model: bytes, values: Column, shape: Sequence[int] | None = None, output: int = 0, batch: int = 16) -> Column:
    """A network's output of each row as ``values`` (flat) and ``error``, one of which is null.

    ``values`` is an array with as many entries as ``shape`` asks for (none: a vector, as long as it is). A task opens
    the model once, from a broadcast of its bytes, and shows it ``batch`` rows at a time; a batch that
    fails is tried row by row. A row of another length or on which the network fails has its error
    and the rest goes on. A null has the error ``missing``.
    """
    return run_models(spark, {"only": Net(model, values, shape, output)}, batch)["only"]


def run_models(spark: SparkSession, nets: Mapping[str, Net], batch: int = 16) -> Column:
    """What ``run_model`` gives for each of several networks, as a struct by their names, from one Arrow step.

    A step is a Python worker a task, so networks without plan expressions between them share one. A worker
    holds an Arrow batch of floats and ``batch`` answers. A network ``after`` another sees its own values
    and then what that one, which stands before it, says; where that failed it has the error ``missing``.
    """
    names = list(nets)
    contents = [spark.sparkContext.broadcast(n.model) for n in nets.values()]
    steps = [(n.shape, n.output, None if n.after is None else names.index(n.after)) for n in nets.values()]

    @F.arrow_udf(f"struct<{', '.join(f'`{k}`: {RESULT}' for k in names)}>")
    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        sessions = [functools.cache(functools.partial(lambda c: opened(c.value), c)) for c in contents]
        for part in parts:
            columns = [arrays(c) for c in (part if isinstance(part, tuple) else (part,))]
            for lo in range(0, len(columns[0]), batch):
                said: list[list[tuple]] = []
                for session, own, (shape, output, after) in zip(sessions, columns, steps, strict=True):
                    rows = own[lo : lo + batch]
                    if after is not None:
                        rows = [None if v is None or more is None else np.concatenate([v, more]) for v, (more, _) in zip(rows, said[after], strict=True)]
                    said.append(answers(session, rows, shape, output))
                yield pa.StructArray.from_arrays([answered(a) for a in said], names)

    # Said to vary, so that no optimiser moves a run of the network into the lambdas that use its result.
    return run.asNondeterministic()(*[n.values.cast("array<float>") for n in nets.values()])


def arrays(column: pa.Array) -> list[np.ndarray | None]:
    """The rows of a column of arrays, as views of one array; entries that are null become NaN."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [flat[lo:hi] if there else None for lo, hi, there in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]


def answers(session: Callable, rows: Sequence[np.ndarray | None], shape: Sequence[int] | None, output: int) -> list[tuple]:
    """What a network says of each row, or else why not."""
    there = [v for v in rows if v is not None]
    try:
        said = iter([(v, None) for v in outputs(session(), np.stack(there), shape, output)] if there else [])
    except Exception:
        said = (one(session, v, shape, output) for v in there)
    return [(None, "missing") if v is None else next(said) for v in rows]


def one(session: Callable, v: np.ndarray, shape: Sequence[int] | None, output: int) -> tuple:
    try:
        return outputs(session(), v[None], shape, output)[0], None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def answered(said: Sequence[tuple]) -> pa.Array:
    values = pa.array([v for v, _ in said], pa.list_(pa.float64()))
    return pa.StructArray.from_arrays([values, pa.array([e for _, e in said], pa.string())], ["values", "error"])


def opened(content: bytes):
    """A session of one thread: tasks are the parallelism."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 4
    return ort.InferenceSession(content, options, providers=["CPUExecutionProvider"])


def outputs(session, rows: np.ndarray, shape: Sequence[int] | None, output: int) -> list[np.ndarray]:
    """What the model says about some rows, flat, in doubles; a value that is not finite is a failure."""
    shape = rows.shape[1:] if shape is None else shape
    if rows.shape[1] != math.prod(shape):
        raise ValueError(f"{rows.shape[1]} values, not {math.prod(shape)}")
    name = session.get_inputs()[0].name
    found = np.asarray(session.run(None, {name: rows.astype(np.float32).reshape(len(rows), *shape)})[output], np.float64).reshape(len(rows), -1)
    if not np.isfinite(found).all():
        raise ValueError("the output is not finite")
    return list(found)


def stage(df: DataFrame, nets: Mapping[str, Net], batch: int = 16) -> DataFrame:
    """Add a column by the name of each network with what it says; the first error of a row stays in ``error``."""
    out = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
    # A value that may vary stays a column of its own: Python takes no arguments with nested lambdas.
    out = out.withColumns({f"_in{k}": F.when(F.spark_partition_id() >= 0, n.values.cast("array<float>")) for k, n in enumerate(nets.values())})
    own = {name: replace(n, values=F.col(f"_in{k}")) for k, (name, n) in enumerate(nets.items())}
    out = out.withColumn("_r", run_models(df.sparkSession, own, batch))
    said = {name: F.col(f"_r.`{name}`.values") for name in nets}
    return out.withColumns({**said, "error": F.coalesce("error", *[F.col(f"_r.`{name}`.error") for name in nets])}).drop("_r", *[f"_in{k}" for k in range(len(nets))])


def classify_pictures(
    df: DataFrame, models: Mapping[str, bytes], width: int | Column, sizes: Mapping[str, int], handcraft: Column | None = None, dehaired: Sequence[Column] | None = None,
    channels: Sequence[str] = ("b", "g", "r"), batch: int = 16,
) -> DataFrame:
    """The whole readout of pictures: all columns, ``coverage, probs, pred_class, score_nevus, score_mel, score_atyp, verdict, non_benign, error``.

    1. ``models["mask"]`` sees the picture in ``sizes["mask"]`` squared and gives logits; the mask is stretched back.
    2. ``models["lesion"]`` sees what lies under the mask, ``models["dehair"]`` the picture without hair (the channels
       ``dehaired``, by default the picture itself), both in ``sizes["view"]`` squared.
    3. ``models["trees_a"]`` and ``models["trees_c"]`` see ``handcraft`` (an array, by default none) before the features of one
       view each, and say probabilities, which are averaged (their output 1, as tree models put labels first).

    Rows that fail somewhere keep nulls from there on and their first error. The mask is one Arrow step, the two
    views and the trees after them another; masks, resizing and means are expressions of the plan. ``width`` may vary by row.
    """
    own = list(df.columns)
    b, g, r = (F.col(f"`{c}`") for c in channels)
    n, v = sizes["mask"], sizes["view"]
    w = F.lit(width) if isinstance(width, int) else width
    height = F.ceil(F.size(b) / w).cast("int")
    input_of = lambda planes, size: P.network_input(*planes, w, size)
    out = stage(df, {"_logits": Net(models["mask"], input_of((b, g, r), n), (3, n, n))}, batch)
    out = out.withColumn("_mask", stretched(P.mask_from_logits(F.col("_logits")), n, height, w))
    out = out.withColumn("coverage", P.coverage(F.col("_mask")))
    lesion = [P.apply_mask(c, F.col("_mask")) for c in (b, g, r)]
    views = {"_lesion": input_of(lesion, v), "_dehair": input_of(dehaired or (b, g, r), v)}
    first = F.array().cast("array<double>") if handcraft is None else handcraft
    nets = {k: Net(models[k[1:]], view, (3, v, v)) for k, view in views.items()}
    nets |= {f"_p_{k}": Net(models[f"trees_{k}"], first, None, 1, view) for k, view in zip("ac", views, strict=True)}
    out = stage(out, nets, batch)
    probs = C.mean_vectors(F.col("_p_a"), F.col("_p_c"))
    out = out.withColumn("probs", F.when(F.col("error").isNull(), probs))
    scores = [F.get("probs", F.lit(k)) for k in range(3)]
    out = out.withColumns({"score_nevus": scores[0], "score_mel": scores[1], "score_atyp": scores[2], "pred_class": F.when(F.col("probs").isNotNull(), C.argmax(F.col("probs")))})
    cuts = [F.lit(C.THRESHOLDS[k]) for k in ("melanoma", "atypical")]
    judged = lambda f: F.when(F.col("probs").isNotNull(), f(F.col("score_mel"), F.col("score_atyp"), *cuts))
    out = out.withColumns({"verdict": judged(C.verdict), "non_benign": judged(C.non_benign)})
    return out.select(*own, "coverage", "probs", "pred_class", "score_nevus", "score_mel", "score_atyp", "verdict", "non_benign", "error")


@P.bound
def stretched(mask: Column, side: int, height: Column, width: Column) -> Column:
    """A square mask as a picture of another size: each pixel is the one under its corner."""
    pick = lambda i: F.get(mask, F.floor(F.floor(i / width) * side / height).cast("int") * side + F.floor(F.pmod(i, width) * side / width).cast("int"))
    return F.transform(F.sequence(F.lit(0), height * width - 1), pick)
