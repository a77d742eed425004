"""A perceptron trained on a bounded table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that train, at most.
ROWS = 100_000


def train_step(weights: list[float], bias: float, rate: float, inputs: Sequence[float], target: float) -> tuple[list[float], float, float]:
    """(weights, bias, error) after one record: each weight moves by rate * error * input."""
    out = 1.0 if sum(w * x for w, x in zip(weights, inputs)) + bias >= 0 else 0.0
    error = target - out
    n = min(len(weights), len(inputs))
    return [w + rate * error * inputs[i] if i < n else w for i, w in enumerate(weights)], bias + rate * error, error


def train(df: DataFrame, inputs: str, target: str, order: str, rate: float = 0.1, rounds: int = 10) -> tuple[list[float], float]:
    """Weights and bias after some rounds over the rows in order, or after one without an error. Tables of
    more than ROWS rows raise: the update is sequential.
    """
    rows = df.select(F.col(inputs).alias("x"), F.col(target).cast("double").alias("y")).where("x is not null and y is not null") if order is None else df.orderBy(order).select(F.col(inputs).alias("x"), F.col(target).cast("double").alias("y"))
    got = [r for r in rows.limit(ROWS + 1).collect() if r.x is not None and r.y is not None]
    if len(got) > ROWS:
        raise ValueError(f"a perceptron is trained on at most {ROWS} rows")
    weights, bias = [0.0] * (len(got[0].x) if got else 0), 0.0
    for _ in range(rounds):
        wrong = 0
        for r in got:
            weights, bias, error = train_step(weights, bias, rate, [float(v) for v in r.x], r.y)
            wrong += error != 0
        if not wrong:
            break
    return weights, bias
