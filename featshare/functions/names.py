"""Name rewriting as column expressions (C1, C2, C7). No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """A column name or Column, as a Column."""
    return F.col(c) if isinstance(c, str) else c


def as_value(v) -> Column:
    """A literal value or a Column, as a Column (strings here are literals, not names)."""
    return v if isinstance(v, Column) else F.lit(v)


def dns_name(c) -> Column:
    """``_`` to ``-``, drop characters outside ``[a-zA-Z0-9-]``, lower case, strip
    leading and trailing ``-``, collapse runs of ``-`` (in this order)."""
    s = F.replace(as_col(c), F.lit("_"), F.lit("-"))
    s = F.regexp_replace(s, "[^a-zA-Z0-9-]", "")
    s = F.lower(s)
    s = F.btrim(s, F.lit("-"))
    return F.regexp_replace(s, "-+", "-")


def name_parts(c) -> Column:
    """Split a dotted name keeping empty parts (``a..b`` has three parts)."""
    return F.split(as_col(c), r"\.", -1)


def short_name(c) -> Column:
    """Last dotted part of a name."""
    return F.element_at(name_parts(c), -1)


def shared_name(c, catalog) -> Column:
    """Swap the catalog of a three-part name; other names are unchanged."""
    parts = name_parts(c)
    swapped = F.concat_ws(".", as_value(catalog), F.element_at(parts, 2), F.element_at(parts, 3))
    return F.when(F.size(parts) == 3, swapped).otherwise(as_col(c))


def online_name(c, catalog, schema) -> Column:
    """``<catalog>.<schema>.<last part>_online``."""
    return F.concat(as_value(catalog), F.lit("."), as_value(schema), F.lit("."),
                    short_name(c), F.lit("_online"))


def endpoint_name(model_col) -> Column:
    """Target endpoint name, ``target-<dns(short model name)>-endpoint``."""
    return F.concat(F.lit("target-"), dns_name(short_name(model_col)), F.lit("-endpoint"))


def source_endpoint_name(model_short_col) -> Column:
    """Source (demo) endpoint name, ``source-<name>-endpoint``, with no DNS step."""
    return F.concat(F.lit("source-"), as_col(model_short_col), F.lit("-endpoint"))


def invocation_url(host, endpoint_col) -> Column:
    """``<host>/serving-endpoints/<endpoint>/invocations``."""
    return F.concat(as_value(host), F.lit("/serving-endpoints/"), as_col(endpoint_col),
                    F.lit("/invocations"))
