"""Score request bodies (JSON) to one row per input record, good and bad ones apart; P2: the
signature that a set of bodies shows. Bodies are parsed once, to a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BY_TEXT = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
_BIG = ("NaN", "Infinity", "-Infinity")


def _schema(record_schema) -> T.StructType:
    if isinstance(record_schema, str):
        return T._parse_datatype_string(record_schema)
    return record_schema


def _at(name: str) -> str:
    if '"' in name or "\\" in name:
        raise ValueError(f"a field name with a quote or backslash has no path: {name}")
    return f'$["{name}"]'


def _typed(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A VARIANT as a SQL type, and whether it is of another JSON type. A JSON null is a null
    of any type. Types are told by what JSON says, not by what a cast could make of it: the
    text ``"5"`` is no number, 2.5 no whole one."""
    none = value.isNull() | F.is_variant_null(value)
    own = F.schema_of_variant(value)
    if isinstance(kind, T.StructType):
        fields = [(f.name, *_typed(F.try_variant_get(value, _at(f.name), "variant"), f.dataType)) for f in kind.fields]
        absent, bad = F.lit(True), F.lit(False)
        for f in kind.fields:
            absent = absent & F.try_variant_get(value, _at(f.name), "variant").isNull()
        for _, _, b in fields:
            bad = bad | b
        # a value that shows one of the fields is an object
        bad = ~none & (bad | (absent & ~own.startswith("OBJECT")))
        return F.when(~none, F.struct(*[t.alias(n) for n, t, _ in fields])), bad
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        bad = items.isNull() | F.exists(items, lambda v: _typed(v, kind.elementType)[1])
        return F.transform(items, lambda v: _typed(v, kind.elementType)[0]), ~none & bad
    if isinstance(kind, T.MapType):
        items = F.try_variant_get(value, "$", "map<string,variant>")
        bad = items.isNull() | F.exists(F.map_values(items), lambda v: _typed(v, kind.valueType)[1])
        return F.transform_values(items, lambda _, v: _typed(v, kind.valueType)[0]), ~none & bad
    if isinstance(kind, T.VariantType):
        return value, F.lit(False)
    text = F.try_variant_get(value, "$", "string")
    if isinstance(kind, T.StringType):  # other values give their JSON text
        return F.when(own == "STRING", text).when(~none, F.to_json(value)), F.lit(False)
    out = F.try_variant_get(value, "$", kind.simpleString())
    if isinstance(kind, _WHOLE):
        fits = own == "BIGINT"
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        fits = own.isin("BIGINT", "DOUBLE") | own.startswith("DECIMAL") | text.isin(*_BIG)
    elif isinstance(kind, T.DecimalType):
        fits = own.isin("BIGINT", "DOUBLE") | own.startswith("DECIMAL")
    elif isinstance(kind, T.BooleanType):
        fits = own == "BOOLEAN"
    elif isinstance(kind, _BY_TEXT):
        fits = own == "STRING"
    else:
        raise ValueError(f"no JSON form of {kind.simpleString()}")
    return out, ~none & (~fits | out.isNull())


def read_score_requests(df: DataFrame, body_col: str, record_schema, id_cols=(), inputs_field: str = "inputs",
                        required=()) -> DataFrame:
    """Every record received: ``(*id_cols, pos, rec, record, reason)``.

    A body is ``{"inputs": [{...}, ...]}`` or a single record ``{...}``. ``rec`` is the typed
    record (null where there is none), ``record`` its JSON text, ``reason`` null for a good record, else ``malformed`` (the
    body is no JSON object, names a field twice or exceeds the size of a VARIANT, 128 MB),
    ``inputs_not_a_list``, ``null_record``, ``mistyped`` (no object, or
    a field that is not of its type) or ``missing`` (a ``required`` field is absent or null).
    A bad record leaves its neighbours alone; a bad body counts as one record; an empty list
    has none. Fields the schema doesn't name and text behind a body's end are ignored. Built-in functions only; each body
    is parsed once, its list and its records are cut from the VARIANT.
    """
    rec = _schema(record_schema)
    if inputs_field in rec.fieldNames():
        raise ValueError(f"record fields may not be named {inputs_field!r}")
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    # each generator keeps what it makes in one place; a projection would repeat it per use
    rows = df.select(*id_cols, F.col(body_col).alias("_body"),
                     F.explode(F.array(F.try_parse_json(F.col(body_col)))).alias("_v"))
    # a body that parses is an object if it opens like one
    is_object = F.col("_v").isNotNull() & F.expr(r"startswith(trim(LEADING ' \t\r\n' FROM _body), '{')")
    listed = F.try_variant_get("_v", _at(inputs_field), "variant").isNotNull()
    entry = F.struct(listed.alias("_listed"),
                     F.when(is_object, F.when(listed, F.try_variant_get("_v", _at(inputs_field), "array<variant>"))
                            .otherwise(F.array("_v"))).alias("_records"))
    rows = rows.select(*id_cols, "_body", is_object.alias("_object"), F.explode(F.array(entry)).alias("_e"))
    wrong = F.when(~F.col("_object"), F.lit("malformed")).when(F.col("_e._records").isNull(), F.lit("inputs_not_a_list"))
    rows = rows.select(*id_cols, "_body", F.col("_e._listed").alias("_listed"), wrong.alias("_wrong"),
                       F.coalesce("_e._records", F.array(F.lit(None).cast("variant"))).alias("_records"))
    rows = rows.select(*id_cols, "_body", "_listed", "_wrong", F.posexplode("_records").alias("pos", "_r"))
    typed, bad = _typed(F.col("_r"), rec)
    rows = rows.select(*id_cols, "pos", "_wrong", "_body", "_listed", "_r",
                       F.explode(F.array(F.struct(typed.alias("rec"), bad.alias("bad")))).alias("_t"))
    reason = (F.when(F.col("_wrong").isNotNull(), F.col("_wrong"))
              .when(F.col("_r").isNull() | F.is_variant_null("_r"), F.lit("null_record"))
              .when(F.col("_t.bad"), F.lit("mistyped")))
    for name in required:
        reason = reason.when(F.col("_t.rec")[name].isNull(), F.lit("missing"))
    # an entry of a list has its own text, without one for a JSON null; all else is the body as it came
    text = (F.when(F.col("_wrong").isNotNull() | ~F.col("_listed"), F.col("_body"))
            .when(~F.is_variant_null("_r"), F.to_json("_r")))
    return rows.select(*id_cols, "pos", F.col("_t.rec").alias("rec"), text.alias("record"), reason.alias("reason"))


def parse_score_requests(df: DataFrame, body_col: str, record_schema, id_cols=(),
                         inputs_field: str = "inputs", required=()) -> DataFrame:
    """The good records as rows ``(*id_cols, pos, *record fields)``; with
    :func:`request_rejects` they are all that was received."""
    rows = read_score_requests(df, body_col, record_schema, id_cols, inputs_field, required).where("reason is null")
    return rows.select(*[c for c in rows.columns if c not in ("rec", "record", "reason")], "rec.*")


def request_rejects(df: DataFrame, body_col: str, record_schema, id_cols=(), inputs_field: str = "inputs",
                    required=()) -> DataFrame:
    """The bad records: ``(*id_cols, pos, reason, record)``."""
    rows = read_score_requests(df, body_col, record_schema, id_cols, inputs_field, required)
    return rows.where("reason is not null").drop("rec").select(
        *[c for c in rows.columns if c not in ("rec", "record", "reason")], "reason", "record")


def infer_request_signature(df: DataFrame, body_col: str, group_cols=(), inputs_field: str = "inputs") -> DataFrame:
    """P2 from data: the fields that the records of JSON bodies show, one row per group and field
    name: ``(*group_cols, column_name, type, n_records, n_present, n_null, required)``.

    Bodies are read as in :func:`read_score_requests`, but no schema is known yet: each is parsed
    once to a VARIANT. ``type`` is the SQL type that ``schema_of_variant_agg`` merges all values to
    (whole and decimal numbers to a decimal that holds every bigint, mixed types to ``VARIANT``,
    nulls alone to ``VOID``); ``required`` says that every record of the group
    has the field with a value. Bodies that are no object, list fields that hold no list and
    entries that are no object count for nothing; a group without any field has no row. One
    aggregation with partial types per task, so a group with a third of the bodies is not hot.
    """
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    path = f'$["{inputs_field}"]'
    # generators keep the parse and the map in one place; a projection would repeat them per use
    parsed = df.select(*group_cols, F.explode(F.array(F.try_parse_json(F.col(body_col)))).alias("_v"))
    listed = F.try_variant_get("_v", path, "array<variant>")
    records = (F.when(listed.isNotNull(), listed)
               .when(F.try_variant_get("_v", path, "variant").isNull(), F.array("_v")))
    fields = F.map_entries(F.try_variant_get("_r", "$", "map<string,variant>"))
    # an entry without a name stands for the record itself
    marker = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    rows = (parsed.select(*group_cols, F.explode(records).alias("_r"))
            .select(*group_cols, F.explode(F.concat(marker, fields)).alias("_f"))
            .select(*group_cols, F.col("_f.key").alias("column_name"), F.col("_f.value").alias("_value")))
    seen = rows.groupBy(*group_cols, "column_name").agg(
        F.schema_of_variant_agg("_value").alias("type"), F.count(F.lit(1)).alias("n_present"),
        F.count_if(F.is_variant_null("_value")).alias("n_null"))
    group = Window.partitionBy(*group_cols)  # over the fields of a group, not over its records
    out = seen.withColumn("n_records", F.max(F.when(F.col("column_name").isNull(), F.col("n_present"))).over(group))
    return out.where("column_name is not null").select(
        *group_cols, "column_name", "type", "n_records", "n_present", "n_null",
        (F.col("n_present") - F.col("n_null") == F.col("n_records")).alias("required"))
