"""Strict per-record schema enforcement as column expressions.

Rule (the document sink's strict contract): a record is rejected iff its
attributes are not a JSON object, carry a key outside the mapping, or hold a
non-null value that cannot be read as the field's type. Numeric strings pass
for numeric fields. Null is always accepted. The rejected record stands alone;
the rest of the batch is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ATTRIBUTE_FIELDS

# Error texts (our own wording, stable for the oracle).
ERR_NOT_OBJECT = "document_parsing_exception: failed to parse field [attributes]"
ERR_UNKNOWN = "strict_dynamic_mapping_exception: unknown field(s) [{}] in [attributes]"
ERR_TYPE = "document_parsing_exception: failed to parse field [attributes.{}] of type [{}]"

_TARGET = {"string": "keyword", "double": "double", "array<string>": "keyword"}


def _kind(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, f"$.{field}", "variant"))


def _reads(attributes: Column, v: Column) -> dict[str, Column]:
    """What the rules look at, each read once: kind of the whole value, keys outside the
    mapping, kind of each field, and whether a number cannot be read."""
    allowed = F.array(*[F.lit(k) for k in ATTRIBUTE_FIELDS])
    # keys from the parsed value (a second text parse would cost as much again)
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    reads = {"given": attributes.isNotNull(), "parsed": v.isNotNull(), "top": F.schema_of_variant(v),
             "unknown": F.sort_array(F.array_except(keys, allowed))}
    for field, typ in ATTRIBUTE_FIELDS.items():
        reads[f"kind_{field}"] = _kind(v, field)
        if typ == "double":
            reads[f"unread_{field}"] = F.try_variant_get(v, f"$.{field}", "double").isNull()
    return reads


def _checks(r: dict[str, Column]) -> list[Column]:
    """One nullable message per rule, in check order (null = rule holds)."""
    is_obj = r["top"].startswith("OBJECT")
    not_object = r["given"] & (~r["parsed"] | (~is_obj & (r["top"] != F.lit("VOID"))))
    checks = [F.when(not_object, F.lit(ERR_NOT_OBJECT))]
    checks.append(F.when(is_obj & (F.size(r["unknown"]) > 0),
                         F.format_string(ERR_UNKNOWN.replace("{}", "%s"), F.array_join(r["unknown"], ","))))
    for field, typ in ATTRIBUTE_FIELDS.items():
        kind = r[f"kind_{field}"]
        present = is_obj & kind.isNotNull() & (kind != F.lit("VOID"))
        bad = r[f"unread_{field}"] | (kind == F.lit("BOOLEAN")) if typ == "double" else kind.contains("OBJECT")
        checks.append(F.when(present & bad, F.lit(ERR_TYPE.format(field, _TARGET[typ]))))
    return checks


def _violations(reads: dict[str, Column]) -> Column:
    # the messages are distinct, so removing the nulls by set difference keeps
    # every violation in check order; unlike filter(lambda) it is code-generated
    return F.array_except(F.array(*_checks(reads)), F.array(F.lit(None).cast("string")))


def violations(attributes: Column, parsed: Column | None = None) -> Column:
    """``array<string>`` of violations of one raw attributes value (empty = valid).
    ``parsed`` is the already parsed variant column, when the caller has one."""
    return _violations(_reads(attributes, parsed if parsed is not None else F.try_parse_json(attributes)))


def validate_strict(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Add ``violations`` and ``error`` (first violation, null when valid)."""
    # parse once into a column; the checks read the parsed value (keeps the
    # generated code small instead of re-parsing the text for every field)
    keep = [c for c in df.columns if c not in ("violations", "error")]
    reads = _reads(F.col(attributes), F.col("_attrs_v"))
    out = df.withColumn("_attrs_v", F.try_parse_json(F.col(attributes)))
    # the reads come out of a one-element generator: a filter on the error (or on an
    # outcome made of it) cannot be rewritten below it into expressions that parse and
    # read the JSON again for every reference
    out = out.select(*keep, F.inline(F.array(F.struct(*[c.alias(f"_r_{n}") for n, c in reads.items()]))))
    out = out.select(*keep, _violations({n: F.col(f"_r_{n}") for n in reads}).alias("violations"))
    return out.withColumn("error", F.try_element_at(F.col("violations"), F.lit(1)))


def typed_attributes(attributes: Column) -> Column:
    """The typed document form of valid attributes (numeric strings coerced)."""
    v = F.try_parse_json(attributes)
    return F.struct(*[
        (F.try_variant_get(v, f"$.{k}", t)).alias(k) for k, t in ATTRIBUTE_FIELDS.items()
    ])


def set_json_field(rows: DataFrame, ids: DataFrame, field: str, value_json: str, as_of: Column,
                   key: str = "id", attributes: str = "attributes") -> DataFrame:
    """Replace one top-level field of the JSON attributes for the rows whose key
    is in ``ids`` (used to break and to repair rows), following the update rule:
    version + 1 and ``updated_at = as_of``. Other keys keep their values and
    types (the object is edited as ``map<string, variant>``)."""
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_hit", F.lit(True))
    j = rows.join(hit, key, "left")
    m = F.from_json(F.col(attributes), "map<string,variant>")
    edited = F.to_json(F.map_concat(F.map_filter(m, lambda k, v: k != F.lit(field)),
                                    F.create_map(F.lit(field), F.parse_json(F.lit(value_json)))))
    h = F.col("_hit").isNotNull()
    return (j.withColumn(attributes, F.when(h, edited).otherwise(F.col(attributes)))
             .withColumn("version", F.when(h, F.col("version") + 1).otherwise(F.col("version")))
             .withColumn("updated_at", F.when(h, as_of).otherwise(F.col("updated_at")))
             .drop("_hit"))
