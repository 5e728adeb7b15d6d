"""Least squares of any number of columns in each group, by tall-skinny QR.

A task folds the rows of a group into the triangular factor of [features, target], and what it sends on has the size of that factor, whatever
the number of rows.  Factors are stacked and factored again in two rounds, by parts of a group and then by group, so a group that all tasks have
a part of is no burden of one.  Products of columns, which lose half the digits, are never formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are factored at once, groups that a task folds side by side, and parts of a group in the first round.
ROWS, GROUPS, PARTS = 4096, 256, 32
_FACTOR = "part int, n long, factor binary"


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor, filled up to a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def solved(factor: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients (of the least length where columns depend on each other) and the residual sum of squares."""
    k = len(factor) - 1
    return np.linalg.lstsq(factor[:k, :k], factor[:k, k], rcond=None)[0], float(factor[k, k] ** 2)


def least_squares(df: DataFrame, key: str, features: list[str], target: str) -> DataFrame:
    """key, n (rows), coefficients (by feature) and rss of each group; features and target are SQL expressions.  Rows with a null among them
    are left out; a null key is a group; a table without rows has no groups."""
    kind, wide = dict(df.dtypes)[key], len(features) + 1
    names = [f"__v{i}" for i in range(wide)]
    rows = df.select(F.col(key), *[F.expr(x).cast("double").alias(v) for x, v in zip([*features, target], names, strict=True)]).dropna(subset=names)

    def batch(keys: list, n: list, factors: list[np.ndarray], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array([part] * len(keys), pa.int32()), pa.array(n, pa.int64()), pa.array([f.tobytes() for f in factors], pa.binary())], names=[key, "part", "n", "factor"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(df.schema[key].dataType)

    def fold(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % PARTS, {}
        for b in batches:
            keys = b.column(0).to_pylist()
            values = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(wide)], axis=1)
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in zip(edges, edges[1:], strict=False):
                for at in range(low, high, ROWS):
                    own = values[at : min(high, at + ROWS)]
                    n, factor = held.pop(keys[low], (0, np.zeros((0, wide))))
                    held[keys[low]] = n + len(own), _factor(np.vstack([factor, own]))
                if len(held) > GROUPS:
                    yield batch([*held], [n for n, _ in held.values()], [f for _, f in held.values()], part)
                    held = {}
        if held:
            yield batch([*held], [n for n, _ in held.values()], [f for _, f in held.values()], part)

    def joined(batches):
        now, n, factor, part = None, 0, None, 0
        for b in batches:
            for k, p, m, f in zip(*(b.column(c).to_pylist() for c in (key, "part", "n", "factor")), strict=True):
                if factor is not None and (k, p) != now:
                    yield batch([now[0]], [n], [factor], now[1])
                    n, factor = 0, None
                own = np.frombuffer(f).reshape(wide, wide)
                now, n, factor = (k, p), n + m, own if factor is None else _factor(np.vstack([factor, own]))
        if factor is not None:
            yield batch([now[0]], [n], [factor], now[1])

    def ended(batches):
        for b in batches:
            found = [solved(np.frombuffer(f).reshape(wide, wide)) for f in b.column("factor").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("n"), pa.array([c.tolist() for c, _ in found], pa.list_(pa.float64())), pa.array([r for _, r in found], pa.float64())], names=[key, "n", "coefficients", "rss"])

    schema = f"`{key}` {kind}, {_FACTOR}"
    parts = rows.mapInArrow(fold, schema).repartition(key, "part").sortWithinPartitions(key, "part").mapInArrow(joined, schema)
    whole = parts.withColumn("part", F.lit(0)).repartition(key).sortWithinPartitions(key).mapInArrow(joined, schema)
    return whole.mapInArrow(ended, f"`{key}` {kind}, n long, coefficients array<double>, rss double")
