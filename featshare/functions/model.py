"""Model application as column expressions (D1, D2) and schema signatures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of an ordinary least squares fit; small enough to ship as literals."""

    features: tuple
    coefficients: tuple
    intercept: float
    label: str = "target"
    n_rows: int = 0
    n_dropped: int = 0


def predict_col(model: LinearModel) -> Column:
    """``intercept + sum(coef * feature)`` as one codegen'd expression, so the same
    prediction runs in batch and on streams."""
    expr = F.lit(float(model.intercept))
    for name, coef in zip(model.features, model.coefficients):
        expr = expr + F.lit(float(coef)) * F.col(name).cast("double")
    return expr


def predict(df: DataFrame, model: LinearModel, out_col: str = "prediction") -> DataFrame:
    """D2 on a frame."""
    return df.withColumn(out_col, predict_col(model))


@dataclass(frozen=True)
class FeatureFunction:
    """An on-demand feature. ``expr`` is a SQL expression string (preferred: stays in
    codegen) or a pandas function ``f(*series) -> series`` run as an Arrow-batched
    pandas UDF when no expression fits."""

    output: str
    expr: object
    inputs: tuple = field(default_factory=tuple)
    return_type: str = "double"


def feature_function(df: DataFrame, fn: FeatureFunction) -> DataFrame:
    """Add the on-demand feature column."""
    if isinstance(fn.expr, str):
        return df.withColumn(fn.output, F.expr(fn.expr))
    udf = F.pandas_udf(fn.expr, returnType=fn.return_type)
    return df.withColumn(fn.output, udf(*[F.col(c) for c in fn.inputs]))


# ---------------------------------------------------------------- P2 signatures

def infer_signature(df: DataFrame, outputs=()) -> dict:
    """Input and output columns with their types, from the schema alone."""
    outputs = set(outputs)
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return {"inputs": [f for f in fields if f[0] not in outputs],
            "outputs": [f for f in fields if f[0] in outputs]}


_SIG_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("expected_type", T.StringType()),
    T.StructField("actual_type", T.StringType()),
    T.StructField("problem", T.StringType()),
])


def check_signature(df: DataFrame, signature: dict) -> DataFrame:
    """Missing, extra and mistyped input columns as rows (metadata only; no scan)."""
    expected = dict(signature["inputs"])
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for name, typ in expected.items():
        if name not in actual:
            rows.append((name, typ, None, "missing"))
        elif actual[name] != typ:
            rows.append((name, typ, actual[name], "mistyped"))
    out_names = {n for n, _ in signature.get("outputs", [])}
    for name, typ in actual.items():
        if name not in expected and name not in out_names:
            rows.append((name, None, typ, "extra"))
    return df.sparkSession.createDataFrame(rows, _SIG_SCHEMA)
