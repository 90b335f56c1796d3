"""Replication inputs derived from the driver tables (see FIXTURES.md §3).

The replicated table is ``products`` built from ``part``; its write history is
``events`` read as one source write per row. Every derived key adds 1 because
cursors are exclusive and start at 0. All builders are lazy DataFrames, so the
same definitions scale with the input tables.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derive import mutation_state, mutations_from_events, writes_with_op
from ..session import checkpoint_root
from .tables import table

_WRITTEN: dict[tuple, str] = {}

# Fixed values of the fixture rules (moduli select the malformed rows).
BAD_WEIGHT_MOD, BAD_WEIGHT_REM = 167, 3      # weight_kg = "not-a-number"
NUMERIC_TEXT_REM = 5                          # weight_kg = "12.5" (accepted)
UNKNOWN_FIELD_REM = 7                         # extra key -> rejected
BULK_STATUS_BY_REM = {0: 200, 1: 409, 2: 400, 3: 429, 4: 503, 5: 404, 6: 302, 7: None}
BULK_ERROR_BY_REM = {
    1: "version_conflict_engine_exception",
    2: "document_parsing_exception: failed to parse field [attributes.weight_kg]",
    3: "es_rejected_execution_exception",
}


@dataclass
class Fixtures:
    """Derived inputs. With ``materialize`` (default) each derived table is
    written once per session as Parquet under the shared checkpoint folder and
    read back: the lineage is cut, later plans scan a table (pruning and
    pushdown apply) instead of recomputing the derivation."""

    spark: SparkSession
    sf_dir: str
    materialize: bool = True

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _mat(self, name: str, df: DataFrame) -> DataFrame:
        if not self.materialize:
            return df
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        path = _WRITTEN.get(key)
        if path is None:
            tag = hashlib.md5(f"{key[0]}|{self.sf_dir}".encode()).hexdigest()[:12]
            path = f"{checkpoint_root(self.spark)}/fixtures-{tag}/{name}"
            df.write.mode("overwrite").parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(path)

    @cached_property
    def mutations(self) -> DataFrame:
        return self._mat("mutations", mutations_from_events(
            self.t("events").select("event_id", "user_id", "ts", "event_type")))

    @cached_property
    def writes(self) -> DataFrame:
        """Every source write with the op it logs."""
        return self._mat("writes", writes_with_op(self.mutations))

    @cached_property
    def change_log(self) -> DataFrame:
        return self._mat("change_log", self.writes.drop("kind"))

    @cached_property
    def first_ts(self):
        """Scalar subquery: the earliest write time (default updated_at)."""
        return self.t("events").agg(F.min("ts")).scalar()

    @cached_property
    def products(self) -> DataFrame:
        return self._mat("products", products_from_part(
            self.t("part"), mutation_state(self.writes), self.first_ts))

    @cached_property
    def docs_old(self) -> DataFrame:
        """The document sink part-way: a third missing, some current, some ahead."""
        p = self.products
        half = self.change_log.agg(F.max("seq") / 2).scalar()
        h = (self.change_log.where(F.col("seq") <= half)
             .groupBy("product_id").agg(F.max("version").alias("h_version")))
        j = p.where(F.col("id") % 3 != 0).join(h, p["id"] == h["product_id"], "left")
        version = (F.when(F.col("id") % 5 == 0, F.col("version"))
                   .when(F.col("id") % 7 == 0, F.col("version") + 1)
                   .otherwise(F.coalesce(F.col("h_version"), F.lit(0))))
        return self._mat("docs_old", j.select("id", version.alias("version"), "name", "category"))

    @cached_property
    def deliveries(self) -> DataFrame:
        """Raw stream messages: redeliveries (every 7th seq again) and malformed shapes."""
        c = self.change_log.select("seq", "product_id", "op", "version")
        d = c.unionByName(c.where(F.col("seq") % 7 == 0).withColumn("seq", F.col("seq") + 1000000000))
        pid = F.col("product_id").cast("string")
        ver = F.col("version").cast("string")
        message_id = F.when(F.col("seq") % 71 == 0, F.lit(None).cast("string")).otherwise(F.concat(pid, F.lit(":"), ver))
        body = (F.when(F.col("seq") % 97 == 0, F.lit("{oops"))
                .when(F.col("seq") % 89 == 0, F.lit('"text"'))
                .when(F.col("seq") % 83 == 0, F.lit('{"event_id":"x"}'))
                .when((F.col("seq") % 79 == 0) | (F.col("seq") % 71 == 0),
                      F.concat(F.lit('{"product":{"id":'), pid, F.lit(',"version":'), ver, F.lit("}}")))
                .otherwise(F.concat(F.lit('{"event_id":"'), pid, F.lit(":"), ver,
                                    F.lit('","product_id":'), pid, F.lit(',"op":"'), F.col("op"),
                                    F.lit('","version":'), ver,
                                    F.lit(',"product":{"id":'), pid, F.lit(',"name":"item '), pid, F.lit('"}}'))))
        return self._mat("deliveries", d.select(F.col("seq").alias("delivery_id"), message_id.alias("message_id"),
                                                body.alias("body")))

    @cached_property
    def bulk_items(self) -> DataFrame:
        r = F.col("event_id") % 23
        status = F.lit(201)
        for rem in sorted(BULK_STATUS_BY_REM, reverse=True):
            v = BULK_STATUS_BY_REM[rem]
            status = F.when(r == rem, F.lit(v).cast("int") if v is not None else F.lit(None).cast("int")).otherwise(status)
        error = F.lit(None).cast("string")
        for rem in sorted(BULK_ERROR_BY_REM, reverse=True):
            error = F.when(r == rem, F.lit(BULK_ERROR_BY_REM[rem])).otherwise(error)
        return self.t("events").select((F.col("event_id") + 1).alias("id"),
                                       status.cast("int").alias("status"), error.alias("error"))

    @cached_property
    def rate_samples(self) -> DataFrame:
        e = F.col("event_id")
        return self.t("events").select(
            F.when(e % 4 == 0, "incremental").otherwise("backfill").alias("mode"),
            (e * 700).alias("t_ms"), (1 + (e * 37) % 500).alias("n"))

    @cached_property
    def dlq(self) -> DataFrame:
        """Entries left by earlier runs, open and resolved, plus one id gone from the source."""
        p = self.products
        seeded = p.where(((F.col("id") % 40).isin(1, 4)) | (F.col("id") % 167 == 4)).select(
            F.lit("es").alias("sink"), F.col("id").alias("record_id"), "version",
            F.lit("document_parsing_exception: seeded").alias("error"),
            F.lit("batch-0").alias("batch_id"), F.lit("backfill").alias("mode"),
            (1 + F.col("id") % 3).cast("int").alias("attempts"),
            F.when(F.col("id") % 2 == 0, "open").otherwise("resolved").alias("status"),
            "updated_at")
        gone = self.t("events").agg(
            F.lit("es").alias("sink"), F.lit(999999999).cast("long").alias("record_id"),
            F.lit(1).cast("long").alias("version"),
            F.lit("document_parsing_exception: seeded").alias("error"),
            F.lit("batch-0").alias("batch_id"), F.lit("backfill").alias("mode"),
            F.lit(1).cast("int").alias("attempts"), F.lit("open").alias("status"),
            F.min("ts").alias("updated_at"))
        return self._mat("dlq", seeded.unionByName(gone))

    @cached_property
    def event_log_large(self) -> DataFrame:
        """Events keyed by (orderkey:linenumber); the key repeats for real in lineitem."""
        li = self.t("lineitem")
        return li.select(
            F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("event_id"),
            F.col("l_orderkey").alias("product_id"), F.col("l_linenumber").cast("long").alias("version"),
            F.when(F.col("l_returnflag") == "A", "insert").when(F.col("l_returnflag") == "R", "delete")
             .otherwise("update").alias("op"),
            F.col("l_shipdate").alias("consumed_at"))


def products_from_part(part: DataFrame, state: DataFrame, first_ts) -> DataFrame:
    """Current source rows: ``part`` as the inserted rows, the aggregated write
    history applied on top (touches add stock, last write sets version/time,
    a delete after the last restore sets ``deleted_at``)."""
    k = F.col("p_partkey")
    weight = (F.when(k % BAD_WEIGHT_MOD == BAD_WEIGHT_REM, F.lit('"not-a-number"'))
              .when(k % BAD_WEIGHT_MOD == NUMERIC_TEXT_REM, F.lit('"12.5"'))
              .otherwise(F.concat((k % 50).cast("string"), F.lit(".25"))))
    extra = F.when(k % BAD_WEIGHT_MOD == UNKNOWN_FIELD_REM, F.lit(',"unknown_field":1')).otherwise(F.lit(""))
    attributes = F.concat(
        F.lit('{"brand":"'), F.col("p_brand"), F.lit('","color":"'), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)),
        F.lit('","weight_kg":'), weight, extra,
        F.lit(',"tags":["'), F.lower("p_type"), F.lit('","'), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)),
        F.lit('"],"description":"'), F.repeat(F.md5((k + 1).cast("string")), 4), F.lit('"}'))
    j = part.join(state, state["product_id"] == part["p_partkey"] + 1, "left")
    return j.select(
        (k + 1).alias("id"),
        F.concat(F.lit("SKU-"), F.lpad((k + 1).cast("string"), 9, "0")).alias("sku"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_size") + F.coalesce(F.col("touches"), F.lit(0))).cast("long").alias("stock"),
        attributes.alias("attributes"),
        F.coalesce(F.col("m_version"), F.lit(1)).cast("long").alias("version"),
        F.coalesce(F.col("m_updated_at"), first_ts).alias("updated_at"),
        F.when(F.col("last_delete_seq") > F.coalesce(F.col("last_restore_seq"), F.lit(0)),
               F.col("m_deleted_at")).alias("deleted_at"),
    )
