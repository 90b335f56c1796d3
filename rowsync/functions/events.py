"""Row -> event shaping and the consumer's message parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PRODUCT_COLUMNS

# Parse error texts.
ERR_INVALID_JSON = "invalid json"
ERR_NOT_OBJECT = "body is not an object"
ERR_NO_EVENT_ID = "missing event_id"
ERR_NO_IDS = "missing product_id/version"


def project_record(products: DataFrame) -> DataFrame:
    """The fixed column list of a source row; numerics as double."""
    return products.select(*[F.col(c).cast("double").alias(c) if c == "price" else F.col(c)
                             for c in PRODUCT_COLUMNS])


def event_id(key: Column, version: Column) -> Column:
    """``"<id>:<version>"``: the idempotency key of the consumer."""
    return F.concat_ws(":", key.cast("string"), version.cast("string"))


def to_event(rows: DataFrame, op: Column | str = "op", emitted_at=None, default_op: str = "update") -> DataFrame:
    """One event per row: id, product id, op (unknown op -> update), version,
    the whole row as a nested struct, and ``emitted_at`` (an argument, so a
    replayed batch produces the same event)."""
    op_col = F.col(op) if isinstance(op, str) else op
    cols = [c for c in PRODUCT_COLUMNS if c in rows.columns]
    emitted = emitted_at if emitted_at is not None else F.lit(None).cast("timestamp_ntz")
    return rows.select(
        event_id(F.col("id"), F.col("version")).alias("event_id"),
        F.col("id").alias("product_id"),
        F.coalesce(op_col, F.lit(default_op)).alias("op"),
        F.col("version"),
        F.struct(*[F.col(c) for c in cols]).alias("product"),
        emitted.alias("emitted_at"),
    )


_NUMERIC_KINDS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def _kind(v: Column, path: str) -> Column:
    """Variant type name of the value at ``path`` (null when absent)."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _number_of(kind: Column, as_double: Column) -> Column:
    """A finite number from a JSON number or numeric string, else null.
    Booleans, empty strings, arrays and objects count as missing."""
    numeric_kind = kind.isin(*_NUMERIC_KINDS) | kind.startswith("DECIMAL") | (kind == F.lit("STRING"))
    return F.when(numeric_kind & (F.abs(as_double) < F.lit(float("inf"))), as_double)


def _present_of(kind: Column) -> Column:
    return kind.isNotNull() & (kind != F.lit("VOID"))


def parse_event(deliveries: DataFrame, body: str = "body", message_id: str = "message_id") -> DataFrame:
    """Raw delivery -> event columns or an error, in the rule order:
    invalid JSON; not an object (arrays count as objects and fail later);
    event id = non-empty string in the body, else the message id; product id
    and version = body value, or ``product.id`` / ``product.version`` only when
    the body value is absent or null; op = body string else ``update``.

    The body is wrapped in ``[...]`` and must parse to exactly one element, so
    trailing text (``{} junk``), ``1,2`` and the empty string are rejected.

    Staged: the body is parsed once, each field's kind and value is read from
    the variant once into a column, and the rules combine those columns, so
    nothing is parsed or read again inside the conditional branches."""
    keep = deliveries.columns
    wrapped = F.concat(F.lit("["), F.col(body), F.lit("]"))
    v = F.col("_v")
    paths = {"eid": "$[0].event_id", "pid": "$[0].product_id", "ppid": "$[0].product.id",
             "ver": "$[0].version", "pver": "$[0].product.version", "op": "$[0].op"}
    numeric = ("pid", "ppid", "ver", "pver")
    parsed = deliveries.select(*keep, F.try_parse_json(wrapped).alias("_v"), F.json_array_length(wrapped).alias("_n"))
    reads = [F.col("_n").alias("_n"), v.isNotNull().alias("_parsed"), _kind(v, "$[0]").alias("_top"),
             *[_kind(v, pth).alias(f"_k_{k}") for k, pth in paths.items()],
             *[F.try_variant_get(v, paths[k], "double").alias(f"_d_{k}") for k in numeric],
             F.try_variant_get(v, paths["eid"], "string").alias("_s_eid"),
             F.try_variant_get(v, paths["op"], "string").alias("_s_op")]
    # the reads come out of a one-element generator: a later filter on the
    # error (callers keep the good rows) cannot be rewritten below it into
    # expressions that parse and read the JSON again for every reference
    read = parsed.select(*keep, F.inline(F.array(F.struct(*reads))))
    k = {x: F.col(f"_k_{x}") for x in paths}
    num = {x: _number_of(k[x], F.col(f"_d_{x}")) for x in numeric}
    eid_body = F.when(k["eid"] == F.lit("STRING"), F.col("_s_eid"))
    fields = read.select(
        *keep,
        (F.col("_parsed") & (F.col("_n") == 1)).alias("_valid"),
        (F.col("_top").startswith("OBJECT") | F.col("_top").startswith("ARRAY")).alias("_obj"),
        F.coalesce(F.when(eid_body != F.lit(""), eid_body),
                   F.when(F.col(message_id) != F.lit(""), F.col(message_id))).alias("_eid"),
        # null also where the number is no long: an error, not an event without an id
        F.round(F.when(_present_of(k["pid"]), num["pid"]).otherwise(num["ppid"])).try_cast("long").alias("_pid"),
        F.round(F.when(_present_of(k["ver"]), num["ver"]).otherwise(num["pver"])).try_cast("long").alias("_ver"),
        F.when(k["op"] == F.lit("STRING"), F.col("_s_op")).otherwise(F.lit("update")).alias("_op"))
    error = (F.when(~F.col("_valid"), F.lit(ERR_INVALID_JSON))
             .when(~F.col("_obj"), F.lit(ERR_NOT_OBJECT))
             .when(F.col("_eid").isNull(), F.lit(ERR_NO_EVENT_ID))
             .when(F.col("_pid").isNull() | F.col("_ver").isNull(), F.lit(ERR_NO_IDS)))
    good = F.col("error").isNull()
    return fields.withColumn("error", error).select(
        *keep,
        F.when(good, F.col("_eid")).alias("event_id"),
        F.when(good, F.col("_pid")).alias("product_id"),
        F.when(good, F.col("_op")).alias("op"),
        F.when(good, F.col("_ver")).alias("version"),
        "error",
    )
