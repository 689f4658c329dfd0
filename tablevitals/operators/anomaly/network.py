"""Reconstruction error of a trained autoencoder (dense 64-32-16-32-64, relu, linear output).

Training is data-parallel: one Spark job per epoch sends the current weights to every partition,
each partition runs mini-batch Adam over its own rows and returns its weights, and Spark averages
them weighted by row count (parameter averaging). All rows take part; no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.config import AutoencoderParams
from tablevitals.functions.columns import clean
from tablevitals.operators.anomaly.forest import as_matrix
from tablevitals.operators.anomaly.reconstruction import feature_stats, standardized
from tablevitals.session import materialize

#: Partial averages on the way to the final one.
AVERAGING_GROUPS = 64

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7

STATE_SCHEMA = "state array<double>, rows double, loss double, held double"


def layer_sizes(k: int, params: AutoencoderParams) -> list[int]:
    hidden = list(params.hidden_layers)
    return [k, *hidden, params.encoding_dim, *reversed(hidden), k]


def initial_weights(sizes: list[int], seed: int) -> np.ndarray:
    """Glorot-uniform matrices and zero biases, flattened."""
    rng = np.random.default_rng(seed)
    parts = []
    for n_in, n_out in zip(sizes, sizes[1:]):
        limit = np.sqrt(6.0 / (n_in + n_out))
        parts += [rng.uniform(-limit, limit, n_in * n_out), np.zeros(n_out)]
    return np.concatenate(parts)


def _layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and bias views into the flat weights."""
    out, at = [], 0
    for n_in, n_out in zip(sizes, sizes[1:]):
        matrix = flat[at:at + n_in * n_out].reshape(n_in, n_out)
        at += n_in * n_out
        out.append((matrix, flat[at:at + n_out]))
        at += n_out
    return out


def reconstruct(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The activations of all layers, input first."""
    values = [x]
    layers = _layers(flat, sizes)
    for i, (matrix, bias) in enumerate(layers):
        y = values[-1] @ matrix + bias
        values.append(y if i == len(layers) - 1 else np.maximum(y, 0.0))
    return values


def gradient(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Gradient of the mean squared error over a mini-batch."""
    values = reconstruct(x, flat, sizes)
    out = np.empty_like(flat)
    slots, layers = _layers(out, sizes), _layers(flat, sizes)
    delta = 2.0 * (values[-1] - x) / x.size
    for i in range(len(layers) - 1, -1, -1):
        slots[i][0][...] = values[i].T @ delta
        slots[i][1][...] = delta.sum(axis=0)
        if i:
            delta = (delta @ layers[i][0].T) * (values[i] > 0)
    return out


def _train_partition(batches: Iterator[pa.RecordBatch], state: np.ndarray, step: int, sizes: list[int],
                     params: AutoencoderParams, learn: bool) -> Iterator[pa.RecordBatch]:
    """One pass over a partition: hold-out loss of the given weights, then Adam steps on the rest."""
    w, m, v = (part.copy() for part in np.split(state, 3))
    given = w.copy()
    rows, held, loss = 0, 0, 0.0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        x, hold = np.column_stack(columns[:-1]), columns[-1].astype(bool)
        if hold.any():
            loss += float(np.square(reconstruct(x[hold], given, sizes)[-1] - x[hold]).mean(axis=1).sum())
            held += int(hold.sum())
        x = x[~hold]
        rows += len(x)
        for start in range(0, len(x) if learn else 0, params.batch_size):
            step += 1
            g = gradient(x[start:start + params.batch_size], w, sizes)
            m += (1 - BETA1) * (g - m)
            v += (1 - BETA2) * (g * g - v)
            rate = params.learning_rate * np.sqrt(1 - BETA2 ** step) / (1 - BETA1 ** step)
            w -= rate * m / (np.sqrt(v) + EPSILON)
    if rows or held:
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.concatenate([w, m, v])], pa.list_(pa.float64())), pa.array([float(rows)]),
             pa.array([loss]), pa.array([float(held)])], names=["state", "rows", "loss", "held"])


def _epoch(data: DataFrame, state: np.ndarray, step: int, sizes: list[int], params: AutoencoderParams,
           learn: bool = True) -> tuple[np.ndarray, float | None, int]:
    """Averaged new state, hold-out loss of the old one, and the largest number of steps taken."""
    sent = data.sparkSession.sparkContext.broadcast(state)  # three numbers per network weight

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _train_partition(batches, sent.value, step, sizes, params, learn)

    trained = data.mapInArrow(train, STATE_SCHEMA).select(
        array_to_vector("state").alias("state"), "rows", "loss", "held",
        (F.spark_partition_id() % AVERAGING_GROUPS).alias("bucket"))
    # Averaged in two levels, so that no task merges the states of all partitions. A partition with
    # held-out rows only has a weight next to nothing, as the average needs a positive one.
    weight = F.greatest(F.col("rows"), F.lit(1e-12))
    partial = trained.groupBy("bucket").agg(
        Summarizer.mean(F.col("state"), weight).alias("state"), F.sum("rows").alias("rows"),
        F.max("rows").alias("most"), F.sum("loss").alias("loss"), F.sum("held").alias("held"))
    row = partial.agg(
        Summarizer.mean(F.col("state"), weight).alias("state"), F.max("most").alias("most"),
        F.sum("loss").alias("loss"), F.sum("held").alias("held"),
    ).select(vector_to_array("state").alias("state"), "most", "loss", "held").first()
    sent.destroy()
    loss = row["loss"] / row["held"] if row["held"] else None
    return np.array(row["state"]), loss, int(np.ceil(row["most"] / params.batch_size))


def fit_network(df: DataFrame, columns: Sequence[str], params: AutoencoderParams = AutoencoderParams(),
                key: Sequence[str] = ()) -> dict:
    """Train with early stopping on a held-out share and keep the best weights.

    An epoch's hold-out loss is measured while the next one runs, which saves a pass per epoch.
    """
    mean, sd = feature_stats(df, columns)
    z = [c.alias(f"z{i}") for i, c in enumerate(standardized(df, columns, mean, sd))]
    identity = [clean(df, k) for k in (key or columns)]
    # Held out by hash, so that a retried or repartitioned task holds out the same rows.
    parts = 1000
    hold = F.pmod(F.xxhash64(F.lit(params.random_state), *identity), F.lit(parts)) < int(
        params.validation_split * parts)
    # Every epoch reads the standardised features; written once, they outlive lost executors.
    data = materialize(df.select(*z, hold.cast("int").alias("hold")))
    return {"mean": mean, "sd": sd, **_train(data, layer_sizes(len(columns), params), params)}


def _train(data: DataFrame, sizes: list[int], params: AutoencoderParams) -> dict:
    weights = initial_weights(sizes, params.random_state)
    state = np.concatenate([weights, np.zeros(2 * len(weights))])
    best, best_loss, waited, step, epochs = weights, float("inf"), 0, 0, 0
    for epoch in range(params.epochs + 1):
        last = epoch == params.epochs  # one more pass, to measure the last weights
        new_state, loss, steps = _epoch(data, state, step, sizes, params, learn=not last)
        if loss is None or loss < best_loss:
            best, best_loss, waited = np.split(state, 3)[0], float("inf") if loss is None else loss, 0
        else:
            waited += 1
        if last or waited >= params.early_stopping_patience:
            break
        state, step, epochs = new_state, step + steps, epoch + 1
    return {"weights": best, "sizes": sizes, "epochs": epochs,
            "validation_loss": None if best_loss == float("inf") else best_loss}


def network_error(df: DataFrame, columns: Sequence[str], model: dict) -> Column:
    """Mean squared reconstruction error per row."""
    sent = df.sparkSession.sparkContext.broadcast((model["weights"], model["sizes"]))

    @F.pandas_udf("double")
    def error(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        weights, sizes = sent.value
        for batch in batches:
            x = as_matrix(batch)
            yield pd.Series(np.square(reconstruct(x, weights, sizes)[-1] - x).mean(axis=1))

    return error(*standardized(df, columns, model["mean"], model["sd"]))
