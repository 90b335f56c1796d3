"""Schemas of the replicated shapes (source rows, change log, events, sinks)."""

from pyspark.sql import types as T

PRODUCTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("sku", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("stock", T.LongType()),
    T.StructField("attributes", T.StringType()),  # raw JSON text until validated
    T.StructField("version", T.LongType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("deleted_at", T.TimestampNTZType()),
])

PRODUCT_COLUMNS = [f.name for f in PRODUCTS.fields]

CHANGE_LOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("product_id", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("changed_at", T.TimestampNTZType()),
])

DELIVERY = T.StructType([
    T.StructField("delivery_id", T.LongType(), False),
    T.StructField("message_id", T.StringType()),
    T.StructField("body", T.StringType()),
])

CONSUMED_EVENTS = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("product_id", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("payload", T.StringType()),
    T.StructField("consumed_at", T.TimestampNTZType()),
])

CONSUMER_DLQ = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

DLQ = T.StructType([
    T.StructField("sink", T.StringType(), False),
    T.StructField("record_id", T.LongType(), False),
    T.StructField("version", T.LongType()),
    T.StructField("payload", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

OUTCOMES = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("sink", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("version", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
])

BULK_ITEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

RATE_SAMPLE = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("t_ms", T.LongType()),
    T.StructField("n", T.LongType()),
])

# Target typing of the document sink (the strict contract). the
# field names and types of the document mapping.
ATTRIBUTE_FIELDS = {
    "brand": "string",
    "color": "string",
    "weight_kg": "double",
    "tags": "array<string>",
    "description": "string",
}
