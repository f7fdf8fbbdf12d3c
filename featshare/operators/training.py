"""Fit and score (A4, D3).

A4 solves ordinary least squares from sufficient statistics (count, means, centred cross
products). Tasks compute them on Arrow batches, groups of tasks are merged on the executors,
and at most ``MERGED`` small matrices of d x d (d = number of features) reach the driver. The
path is the same for every width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshare.functions.model import LinearModel, predict
from featshare.operators.lookup import feature_lookup
from featshare.sources.requests import parse_score_requests

#: groups that the tasks' statistics are merged to before they reach the driver
MERGED = 32


def _moments(frames, d: int):
    """(rows, complete rows, means, centred cross products) of some statistics, merged."""
    seen, n, mean, cross = 0, 0, np.zeros(d), np.zeros((d, d))
    for more, m, other, products in frames:
        seen += more
        if m:
            step = other - mean
            cross = cross + products + np.outer(step, step) * (n * m / (n + m))
            mean = mean + step * (m / (n + m))
            n += m
    return seen, n, mean, cross


def _sufficient(df: DataFrame, columns: list[str]):
    """Statistics of the rows whose columns are all finite."""
    d = len(columns)

    def batch(pdf: pd.DataFrame):
        x = pdf.to_numpy(np.float64)
        x = x[np.isfinite(x).all(axis=1)]
        mean = x.mean(axis=0) if len(x) else np.zeros(d)
        return len(pdf), len(x), mean, (x - mean).T @ (x - mean)

    def row(key, stats):
        seen, n, mean, cross = stats
        return pd.DataFrame({"part": [key], "seen": [seen], "n": [n], "mean": [mean.tobytes()], "cross": [cross.tobytes()]})

    def read(pdf):
        return ((r.seen, r.n, np.frombuffer(r.mean), np.frombuffer(r.cross).reshape(d, d))
                for r in pdf.sort_values("part").itertuples())

    def task(frames):
        yield row(TaskContext.get().partitionId(), _moments(map(batch, frames), d))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return row(int(pdf["part"].min()), _moments(read(pdf), d))

    schema = "part int, seen long, n long, mean binary, cross binary"
    parts = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInPandas(task, schema)
    merged = parts.groupBy((F.col("part") % MERGED).alias("_g")).applyInPandas(merge, schema)
    return _moments(read(merged.toPandas()), d)


def train_linear(df: DataFrame, features, label: str) -> LinearModel:
    """A4: OLS with intercept, for any number of features. Rows with a null, NaN or infinite
    feature or label are dropped and counted. Collinear features get the minimum-norm
    solution (predictions are still the least-squares fit). Without a complete row there is
    nothing to fit: an error."""
    features = list(features)
    seen, n, mean, cross = _sufficient(df, [*features, label])
    if n == 0:
        raise ValueError("no complete rows to fit")
    d = len(features)
    cov = cross / n
    coef = np.linalg.lstsq(cov[:d, :d], cov[:d, d], rcond=None)[0] if d else np.zeros(0)
    return LinearModel(tuple(features), tuple(float(c) for c in coef), float(mean[d] - coef @ mean[:d]), label,
                       n, int(seen - n))


def model_frame(spark: SparkSession, model: LinearModel, digits: int = 6) -> DataFrame:
    """The fitted model as a one-row frame (rows used, rows dropped, coefficients)."""
    cols = {"n_rows": model.n_rows, "n_dropped": model.n_dropped,
            "intercept": round(model.intercept, digits)}
    for f, c in zip(model.features, model.coefficients):
        cols[f"coef_{f}"] = round(c, digits + 4)
    schema = ", ".join(f"{k} {'bigint' if k.startswith('n_') else 'double'}" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema)


def score_batch(requests: DataFrame, body_col: str, record_schema, model: LinearModel,
                features: DataFrame | None = None, lookup_key=None, table_key=None,
                id_cols=()) -> DataFrame:
    """D3: parse requests (S6), look up the model's features by key (J1) unless the
    request carries them all, and predict (D2)."""
    recs = parse_score_requests(requests, body_col, record_schema, id_cols)
    if not all(f in recs.columns for f in model.features):
        if features is None or lookup_key is None:
            raise ValueError("requests lack features and no feature table was given")
        missing = [f for f in model.features if f not in recs.columns]
        recs = feature_lookup(recs, features, lookup_key, missing, table_key)
    return predict(recs, model)
