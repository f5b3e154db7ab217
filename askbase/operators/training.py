"""Training in steps, with evaluations on the way and the best step kept.

The reference trains for a number of steps, evaluates on the held-out rows every 50
of them, saves what it has, and goes on with the best at the end.  Here a
step is one Spark job: every task adds up the gradient of its rows, and the sums are
added up by task groups before they reach the driver, which holds the weights (classes
x hashed words, sized by ``WEIGHT_BYTES``) and nothing that grows with the rows.

The weights of every evaluated step are published with its loss (``commit_log``).  A run
that finds steps there goes on after the last one, with the weights and the momentum it had; the
losses are a table, from which ``evaluate.best_checkpoint`` names the step to load.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase import constants as K
from askbase.functions.text import tokenize_clean
from askbase.session import scratch_path
from askbase.sources.commit_log import CommitLog

#: Steps between evaluations.
EVAL_STEPS = K.EVAL_EVERY_STEPS
#: Bytes that the weights may take on the driver and in each task.
WEIGHT_BYTES = 64 << 20
#: Task groups that sums pass through before the driver.
GROUPS = 8
#: Rows whose words are looked at together in a task.
ROWS = 4096


@dataclass
class Settings:
    classes: int
    width: int = 1 << 14
    steps: int = 200
    rate: float = 0.5
    momentum: float = 0.9
    decay: float = 1e-4


def examples(df: DataFrame, settings: Settings, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """``label, idx, val`` per row, written once: hashed words with 1 + log(count), scaled to length 1.
    A row without words has none; a null label or one that is no class is left out."""
    words = F.transform(tokenize_clean(text_col), lambda w: F.pmod(F.xxhash64(w), F.lit(settings.width)).cast("int"))
    df = df.select(F.col(label_col).cast("int").alias("label"), F.coalesce(words, F.array().cast("array<int>")).alias("w"))
    df = df.filter(F.col("label").between(0, settings.classes - 1)).withColumn("w", F.sort_array("w"))
    path = scratch_path(df.sparkSession, "examples")
    df.select("label", "w").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sparse(batch: pa.RecordBatch, width: int):
    """Rows as (row, column, value) of their scaled word counts."""
    lists = batch.column("w")
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    col = lists.flatten().to_numpy(zero_copy_only=False)
    cell, count = np.unique(row.astype(np.int64) * width + col, return_counts=True)
    row, col, val = cell // width, cell % width, 1 + np.log(count)
    length = np.sqrt(np.bincount(row, weights=val ** 2, minlength=batch.num_rows))
    return row, col, val / length[row]


def _probabilities(rows: int, sparse, weights: np.ndarray) -> np.ndarray:
    """Softmax of the linear scores; the last column of the weights is the bias."""
    row, col, val = sparse
    scores = np.tile(weights[:, -1], (rows, 1))
    for c in range(len(weights)):
        scores[:, c] += np.bincount(row, weights=val * weights[c, col], minlength=rows)
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def _gradient(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, gradient) added up over a batch."""
    n, y = batch.num_rows, batch.column("label").to_numpy()
    sparse = row, col, val = _sparse(batch, weights.shape[1] - 1)
    p = _probabilities(n, sparse, weights)
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).sum()
    p[np.arange(n), y] -= 1
    g = np.empty_like(weights)
    for c in range(len(weights)):
        g[c, :-1] = np.bincount(col, weights=val * p[row, c], minlength=weights.shape[1] - 1)
    g[:, -1] = p.sum(axis=0)
    return float(loss), g


_SUMS = "n bigint, loss double, g binary"


def _add(n: int, loss: float, g: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([g.tobytes()], pa.binary())],
                                      names=["n", "loss", "g"])


def loss_and_gradient(data: DataFrame, weights: np.ndarray, gradient: bool = True) -> tuple[int, float, np.ndarray]:
    """(rows, mean loss, mean gradient) over ``examples``: one job."""
    empty = np.zeros_like(weights) if gradient else np.zeros((0, 0))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, empty.copy()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = pa.RecordBatch.from_struct_array(pa.concat_arrays([b.slice(i, ROWS).to_struct_array()]))
                some, g = _gradient(part, weights)
                n, loss = n + part.num_rows, loss + some
                if gradient:
                    total += g
        if n:
            yield _add(n, loss, total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, empty.copy()
        for b in batches:
            for i in range(b.num_rows):
                n, loss = n + b.column("n")[i].as_py(), loss + b.column("loss")[i].as_py()
                total += np.frombuffer(b.column("g")[i].as_py()).reshape(total.shape)
        if n:
            yield _add(n, loss, total)

    rows = data.mapInArrow(partial, _SUMS).repartition(GROUPS).mapInArrow(merge, _SUMS).collect()
    n = sum(r["n"] for r in rows)
    # in a fixed order, so that a run repeated gives the same numbers
    rows = sorted(rows, key=lambda r: (r["n"], r["loss"]))
    total = sum((np.frombuffer(r["g"]).reshape(empty.shape) for r in rows), empty.copy())
    return n, sum(r["loss"] for r in rows) / max(n, 1), total / max(n, 1)


class Checkpoints:
    """Evaluated steps of a run: loss, weights and momentum, a version per evaluation."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def save(self, step: int, loss: float, weights: np.ndarray, speed: np.ndarray, settings: Settings) -> None:
        folder = uuid.uuid4().hex
        row = [(bytearray(weights.tobytes()), bytearray(speed.tobytes()))]
        self.spark.createDataFrame(row, "weights binary, speed binary").coalesce(1).write.parquet(f"{self.log.path}/data/{folder}")
        version = self.log.latest()[0] + 1
        if not self.log.publish(version, {"step": step, "loss": loss, "folder": folder, "settings": vars(settings)}):
            raise RuntimeError("another run trains into the same folder")

    def steps(self) -> list[dict]:
        return [self.log.read(v) for v in self.log.versions()]

    def history(self) -> DataFrame:
        """``step, loss``: what A6 reads."""
        return self.spark.createDataFrame([(s["step"], s["loss"]) for s in self.steps()], "step bigint, loss double")

    def load(self, step: int) -> tuple[np.ndarray, np.ndarray, Settings]:
        found = next(s for s in self.steps() if s["step"] == step)
        settings = Settings(**found["settings"])
        row = self.spark.read.parquet(f"{self.log.path}/data/{found['folder']}").first()
        shape = (settings.classes, settings.width + 1)
        return np.frombuffer(row["weights"]).reshape(shape).copy(), np.frombuffer(row["speed"]).reshape(shape).copy(), settings


def train(data: DataFrame, held_out: DataFrame, path: str, settings: Settings) -> Checkpoints:
    """Gradient steps with momentum over ``examples``, evaluated and saved every ``EVAL_STEPS``;
    goes on after the last step saved at ``path``."""
    shape = (settings.classes, settings.width + 1)
    if 8 * shape[0] * shape[1] > WEIGHT_BYTES:
        raise ValueError(f"{shape[0]} classes x {shape[1]} places exceed {WEIGHT_BYTES} bytes; hash to fewer places")
    saved = Checkpoints(data.sparkSession, path)
    weights, speed, step = np.zeros(shape), np.zeros(shape), 0
    if saved.steps():
        step = saved.steps()[-1]["step"]
        weights, speed, known = saved.load(step)
        if json.dumps(vars(known) | {"steps": 0}, sort_keys=True) != json.dumps(vars(settings) | {"steps": 0}, sort_keys=True):
            raise ValueError("the steps saved there were trained with other settings")
    while step < settings.steps:
        _, _, g = loss_and_gradient(data, weights)
        speed = settings.momentum * speed - settings.rate * (g + settings.decay * weights)
        weights = weights + speed
        step += 1
        if step % EVAL_STEPS == 0:
            n, loss, _ = loss_and_gradient(held_out, weights, gradient=False)
            saved.save(step, loss if n else float("inf"), weights, speed, settings)
    return saved


def predict(data: DataFrame, weights: np.ndarray) -> DataFrame:
    """``label, pred`` of ``examples``; of equal scores the first class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = pa.RecordBatch.from_struct_array(pa.concat_arrays([b.to_struct_array()]))
            p = _probabilities(part.num_rows, _sparse(part, weights.shape[1] - 1), weights)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(p.argmax(axis=1).astype(np.int32))], names=["label", "pred"])

    return data.mapInArrow(run, "label int, pred int")
