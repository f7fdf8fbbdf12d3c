"""Message and state classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featshare.functions.names import as_col

# Case-blind substrings that classify an error message. The first class
# whose list matches wins, in this order.
ERROR_CLASSES = [
    ("not_found", ["not found", "does not exist", "not_found", "notfound"]),
    ("already_exists", ["already exists", "already_exists"]),
    ("conflict", ["conflict", "in progress"]),
]


def error_class(c) -> Column:
    """``not_found``, ``already_exists``, ``conflict`` or ``other``."""
    low = F.lower(F.coalesce(as_col(c), F.lit("")))
    expr = None
    for label, needles in ERROR_CLASSES:
        cond = None
        for n in needles:
            hit = low.contains(n)
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("other"))


def _upper(c) -> Column:
    return F.upper(F.coalesce(as_col(c).cast("string"), F.lit("")))


def last_token(c) -> Column:
    """Last dot-separated token, upper case (an SDK enum prints as ``Class.VALUE``)."""
    return F.element_at(F.split(_upper(c), r"\.", -1), -1)


def online_table_state(c) -> Column:
    """C6, online table: ready if it says ONLINE and not OFFLINE; else failed if it says
    FAILED; else waiting. Ready is tested first, as the reference does."""
    s = _upper(c)
    return (F.when(s.contains("ONLINE") & ~s.contains("OFFLINE"), F.lit("ready"))
            .when(s.contains("FAILED"), F.lit("failed"))
            .otherwise(F.lit("waiting")))


def online_store_state(c, compat: bool = False) -> Column:
    """C6, online store: ready when AVAILABLE; never failed. ``compat`` keeps the
    substring rule, under which UNAVAILABLE also counts as ready."""
    ok = _upper(c).contains("AVAILABLE") if compat else (last_token(c) == F.lit("AVAILABLE"))
    return F.when(ok, F.lit("ready")).otherwise(F.lit("waiting"))


def endpoint_state(ready_col, config_col, compat: bool = False) -> Column:
    """C6, endpoint ready for an update: (READY and not IN_PROGRESS) or NOT_UPDATING.
    ``compat`` keeps the substring rule, under which NOT_READY contains READY."""
    if compat:
        r, u = _upper(ready_col), _upper(config_col)
        ok = (r.contains("READY") & ~u.contains("IN_PROGRESS")) | u.contains("NOT_UPDATING")
    else:
        r, u = last_token(ready_col), last_token(config_col)
        ok = ((r == F.lit("READY")) & (u != F.lit("IN_PROGRESS"))) | (u == F.lit("NOT_UPDATING"))
    return F.when(ok, F.lit("ready")).otherwise(F.lit("waiting"))


def state_class(kind: str, *cols, compat: bool = False) -> Column:
    """C6 dispatcher: ``online_table``, ``online_store`` or ``endpoint``."""
    if kind == "online_table":
        return online_table_state(cols[0])
    if kind == "online_store":
        return online_store_state(cols[0], compat)
    if kind == "endpoint":
        return endpoint_state(cols[0], cols[1], compat)
    raise ValueError(f"unknown state kind {kind!r}")
