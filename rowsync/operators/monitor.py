"""Observability and reconciliation as DataFrame aggregates: rate, lag,
version sums, source-versus-sink comparison, per-record traces, status and
data-quality assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE_WINDOW_MS = 10_000


def sliding_rate(samples: DataFrame, window_ms: int = RATE_WINDOW_MS) -> DataFrame:
    """Records/s at each sample time over the last ``window_ms`` (boundary
    included): ``round(sum(n) / max(1000, now - first t) * 1000)``.

    Skew-proof: a sample's window lies in its own time bucket and the previous
    one, so each sample is also copied into the next bucket as context and the
    range window runs per (mode, bucket) — bounded by two buckets of samples,
    never one task per mode."""
    b = F.floor(F.col("t_ms") / F.lit(window_ms)).cast("long")
    own = samples.select("mode", "t_ms", "n", b.alias("_b"), F.lit(True).alias("_own"))
    ctx = samples.select("mode", "t_ms", "n", (b + 1).alias("_b"), F.lit(False).alias("_own"))
    w = Window.partitionBy("mode", "_b").orderBy("t_ms").rangeBetween(-window_ms, 0)
    x = (own.unionByName(ctx)
         .withColumn("_sum", F.sum("n").over(w))
         .withColumn("_first", F.min("t_ms").over(w))
         .where(F.col("_own")))
    span = F.greatest(F.lit(1000), F.col("t_ms") - F.col("_first"))
    rate = F.round(F.col("_sum") / span * 1000).cast("long")
    return x.select("mode", "t_ms", rate.alias("rate"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def lag(change_log: DataFrame, cursor, as_of) -> DataFrame:
    """``lag_seq = max(0, max(seq) - cursor)`` (a seq difference, includes the
    safety-window rows); ``lag_rows`` = changes after the cursor;
    ``lag_seconds`` = age of the oldest change after the cursor at ``as_of``,
    one decimal, 0 when none. One conditional aggregate pass."""
    cursor = cursor if isinstance(cursor, Column) else F.lit(cursor)
    after = F.col("seq") > cursor
    a = change_log.agg(
        F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("max_seq"),
        F.count_if(after).alias("lag_rows"),
        F.min(F.when(after, F.col("changed_at"))).alias("_oldest"))
    return a.select(
        "max_seq",
        F.greatest(F.lit(0), F.col("max_seq") - cursor).cast("long").alias("lag_seq"),
        "lag_rows",
        F.coalesce(F.round(seconds_between(F.col("_oldest"), as_of), 1), F.lit(0.0)).alias("lag_seconds"))


def version_sum(df: DataFrame, version: str = "version") -> Column:
    return F.coalesce(F.sum(version), F.lit(0)).cast("long")


def _versions_by_key(source: DataFrame, docs: DataFrame, events: DataFrame | None, key: str) -> DataFrame:
    """One row per key with the source, document and event versions: the
    inputs are tagged and unioned, then aggregated once on the key (partial
    aggregation map-side, one shuffle; a hot key is combined before it moves)
    instead of chained full outer joins."""
    null_l = F.lit(None).cast("long")
    parts = [source.select(key, F.col("version").cast("long").alias("s"), null_l.alias("d"), null_l.alias("e"),
                           F.lit(0).cast("long").alias("en")),
             docs.select(key, null_l.alias("s"), F.col("version").cast("long").alias("d"), null_l.alias("e"),
                         F.lit(0).cast("long").alias("en"))]
    if events is not None:
        parts.append(events.select(F.col("product_id").alias(key), null_l.alias("s"), null_l.alias("d"),
                                   F.col("version").cast("long").alias("e"), F.lit(1).cast("long").alias("en")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(key).agg(F.max("s").alias("s_version"), F.max("d").alias("d_version"),
                              F.max("e").alias("e_version"), F.sum("en").alias("e_n"))


def reconcile(source: DataFrame, docs: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """Source vs documents vs event store, per key and in total. Equal counts
    and sums can hide compensating errors, so the per-key classes are counted
    too. Keys are unique in the source and the document state."""
    j = _versions_by_key(source, docs, events, key)
    sv, dv, ev = F.col("s_version"), F.col("d_version"), F.col("e_version")
    return j.agg(
        F.count(sv).alias("source_n"),
        F.count(dv).alias("docs_n"),
        F.coalesce(F.sum("e_n"), F.lit(0)).cast("long").alias("events_n"),
        F.count(ev).alias("event_products"),
        F.count_if(sv.isNotNull() & dv.isNull()).alias("missing"),
        F.count_if(sv.isNull() & dv.isNotNull()).alias("extra"),
        F.count_if(dv < sv).alias("stale"),
        F.count_if(dv > sv).alias("ahead"),
        F.count_if(dv == sv).alias("equal"),
        F.count_if(sv.isNotNull() & ev.isNull()).alias("events_missing"),
        F.count_if(ev < sv).alias("events_behind"),
        F.coalesce(F.sum(sv), F.lit(0)).cast("long").alias("source_version_sum"),
        F.coalesce(F.sum(dv), F.lit(0)).cast("long").alias("docs_version_sum"),
    )


def store_in_sync(source: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Per record: source version, document version, in sync (null-safe)."""
    j = _versions_by_key(source, docs, None, key)
    return j.select(key, F.col("s_version").alias("version"), F.col("d_version").alias("doc_version"),
                    F.col("s_version").eqNullSafe(F.col("d_version")).alias("in_sync"))


def record_trace(ids: DataFrame, source: DataFrame, docs: DataFrame, events: DataFrame, dlq: DataFrame,
                 n_events: int = 10, key: str = "id") -> DataFrame:
    """One row per requested id across all stores: source and document version,
    the last ``n_events`` event ids (version desc), event count, the DLQ entry of
    the document sink, and the entries of every sink (``sink:status:attempts``).

    All stores are tagged, unioned and aggregated once by id, as in
    ``reconcile``. Events are cut to ``n`` per key with a row_number filter
    (partial group limit before the shuffle), so only a bounded list is
    collected per key, and are counted by partial sums. A DLQ holds one entry per
    sink and record."""
    kinds = {"asked": "boolean", "source_version": "bigint", "doc_version": "bigint", "last": "struct<rn:int,event_id:string>",
             "n_events": "bigint", "entry": "struct<sink:string,status:string,attempts:int>"}

    def part(df: DataFrame, id_col: str, **given) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias(key), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    w = Window.partitionBy("product_id").orderBy(F.col("version").desc(), F.col("event_id").desc())
    ev = events.select("product_id", "version", "event_id")
    last = ev.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n_events)
    parts = [part(ids, key, asked=F.lit(True)), part(source, key, source_version=F.col("version")), part(docs, key, doc_version=F.col("version")),
             part(last, "product_id", last=F.struct("rn", "event_id")), part(ev, "product_id", n_events=F.lit(1)),
             part(dlq, "record_id", entry=F.struct("sink", "status", "attempts"))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    of_docs = F.max(F.when(F.col("entry.sink") == "es", F.col("entry")))
    g = u.groupBy(key).agg(
        F.max("asked").alias("asked"), F.max("source_version").alias("source_version"), F.max("doc_version").alias("doc_version"),
        F.sort_array(F.collect_list("last")).alias("last"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"),
        F.sort_array(F.collect_list("entry")).alias("entries"), of_docs.alias("es"))

    def joined(rows, text):
        return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, text), ","))
    return g.where("asked").select(
        key, "source_version", "doc_version", joined(F.col("last"), lambda x: x["event_id"]).alias("last_events"), "n_events",
        F.col("es.status").alias("dlq_status"), F.col("es.attempts").alias("dlq_attempts"),
        joined(F.col("entries"), lambda x: F.concat_ws(":", x["sink"], x["status"], x["attempts"].cast("string"))).alias("dlq_entries"))


def status_snapshot(source: DataFrame, docs: DataFrame, events: DataFrame, dlq: DataFrame,
                    progress: DataFrame, change_log: DataFrame, cursor, as_of) -> DataFrame:
    """One status row: backfill progress and percent, incremental lag, counts
    per store with behind/ahead, open DLQ per sink, totals. Every figure is a
    scalar subquery over its own table (no cross join of the inputs)."""
    lg = lag(change_log, cursor, as_of)
    last_id = progress.agg(F.coalesce(F.max("last_id"), F.lit(0)).cast("long")).scalar()
    target = progress.agg(F.coalesce(F.max("target_max_id"), F.lit(0)).cast("long")).scalar()
    base = source.agg(F.count(F.lit(1)).alias("source_n"))
    pct = F.when(F.col("target_max_id") > 0,
                 F.least(F.lit(100.0), F.round(F.col("last_id") / F.col("target_max_id") * 1000) / 10)
                 ).otherwise(F.lit(0.0))
    out = (base
           .withColumn("docs_n", docs.agg(F.count(F.lit(1))).scalar())
           .withColumn("events_n", events.agg(F.count(F.lit(1))).scalar())
           .withColumn("event_products", events.agg(F.count_distinct("product_id")).scalar())
           .withColumn("dlq_open_es", dlq.where((F.col("status") == "open") & (F.col("sink") == "es"))
                       .agg(F.count(F.lit(1))).scalar())
           .withColumn("dlq_open_rabbitmq", dlq.where((F.col("status") == "open") & (F.col("sink") == "rabbitmq"))
                       .agg(F.count(F.lit(1))).scalar())
           .withColumn("last_id", last_id)
           .withColumn("target_max_id", target)
           .withColumn("lag_seq", lg.select("lag_seq").scalar())
           .withColumn("lag_seconds", lg.select("lag_seconds").scalar()))
    return (out.withColumn("pct", pct)
               .withColumn("docs_behind", F.greatest(F.lit(0), F.col("source_n") - F.col("docs_n")))
               .withColumn("docs_ahead", F.greatest(F.lit(0), F.col("docs_n") - F.col("source_n"))))


def quality_checks(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows ``(check, expected, actual, pass)`` from one-row DataFrames with
    ``expected`` and ``actual``; compared null-safely, union of the rows."""
    out = None
    for name, df in checks:
        r = df.select(F.lit(name).alias("check"), F.col("expected").cast("long").alias("expected"),
                      F.col("actual").cast("long").alias("actual"))
        out = r if out is None else out.unionByName(r)
    return out.withColumn("pass", F.col("expected").eqNullSafe(F.col("actual")))


def job_status(counters: DataFrame, attempts: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each writer mode, and one for the consumer, from the tables the
    jobs keep: batches, batches that were repeated, what came of the rows, messages
    published, the time of the last batch, the rate at that time (records/s over the
    last ten seconds, as ``sliding_rate``) and the key a repeated backfill wave went
    on from. A mode's rows are batches, so all this is small; events are combined by
    flush before they move. A mode without batches has no row."""
    n = lambda c: F.coalesce(F.col("counts")[c], F.lit(0)).cast("long")
    done = F.when(F.col("job") == "consumer", n("received")).otherwise(n("ok") + n("duplicate") + n("dlq"))
    each = counters.select("job", "mode", "batch_id", "attempt", done.alias("n"), n("ok").alias("ok"), n("stored").alias("stored"),
                           (n("duplicate") + n("duplicates")).alias("absorbed"), (n("dlq") + n("malformed")).alias("rejected"), n("published").alias("published"))
    totals = each.groupBy("mode").agg(
        F.count_distinct("batch_id").alias("batches"), F.sum("n").alias("records"), F.sum(F.col("ok") + F.col("stored")).alias("written"),
        F.sum("absorbed").alias("absorbed"), F.sum("rejected").alias("rejected"), F.sum("published").alias("published"))
    of_writers = attempts.join(each.select("mode", "batch_id", "attempt", "n"), ["mode", "batch_id", "attempt"], "left")
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    samples = of_writers.select("mode", millis("started_at").alias("t_ms"), F.coalesce("n", F.lit(0)).alias("n"))
    flushes = events.groupBy("consumed_at").agg(F.count(F.lit(1)).alias("n"))
    samples = samples.unionByName(flushes.select(F.lit("consumer").alias("mode"), millis("consumed_at").alias("t_ms"), "n"))
    rates = sliding_rate(samples).groupBy("mode").agg(F.max_by(F.struct("t_ms", "rate"), F.col("t_ms")).alias("last"))
    rates = rates.select("mode", F.col("last.rate").alias("rate"))
    times = attempts.select("mode", F.col("started_at").alias("at")).unionByName(
        flushes.select(F.lit("consumer").alias("mode"), F.col("consumed_at").cast("timestamp_ntz").alias("at")))
    times = times.groupBy("mode").agg(F.max("at").alias("last_batch_at"))
    # a wave's batch id is its run's id and its number, which gives the key it starts after
    again = attempts.where((F.col("mode") == "backfill") & (F.col("attempt") > 1)).select(
        F.regexp_extract("batch_id", r"^(.*)-w(\d+)$", 1).alias("run_id"), F.regexp_extract("batch_id", r"^(.*)-w(\d+)$", 2).try_cast("long").alias("wave"))
    start = F.least(F.col("wave") * F.col("ranges_per_wave") * F.col("range_width"), F.col("target_max_id"))
    resumed = again.join(runs, "run_id").agg(F.max(start)).scalar()
    repeated = attempts.where(F.col("attempt") > 1).groupBy("mode").agg(F.count_distinct("batch_id").alias("repeated"))
    out = totals.join(rates, "mode", "left").join(times, "mode", "left").join(repeated, "mode", "left")
    return out.select("mode", "batches", F.coalesce("repeated", F.lit(0)).cast("long").alias("repeated"), "records", "written", "absorbed", "rejected",
                      "published", "last_batch_at", "rate", F.when(F.col("mode") == "backfill", resumed).alias("resumed_from"))


def replication_gates(source: DataFrame, docs: DataFrame, events: DataFrame, dlq: DataFrame, counters: DataFrame,
                      progress: DataFrame, change_log: DataFrame) -> DataFrame:
    """The gates of a drained replication, as ``quality_checks`` rows: every source
    row is a document of its version and an event, no event twice, both sinks absorbed
    replays, nothing is left to read or quarantined. The stores are compared key by key
    in one aggregate (``_versions_by_key``), so errors that cancel out in sums show."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    zero = source.sparkSession.range(0, 1, 1, 1).select(F.lit(0).cast("long").alias("expected"))
    one = zero.select(F.lit(1).cast("long").alias("expected"))
    rows = source.agg(F.count(F.lit(1)).alias("expected"))
    sv, dv = F.col("s_version"), F.col("d_version")
    keys = _versions_by_key(source, docs, events, "id")
    wrong = keys.agg(F.count_if(~sv.eqNullSafe(dv)).alias("docs"), F.count_if(sv.isNotNull() & F.col("e_version").isNull()).alias("events"),
                     F.count_if(sv.isNull() & F.col("e_version").isNotNull()).alias("unknown"))
    wrong = wrong.select(F.struct("docs", "events", "unknown").alias("s")).scalar()
    absorbed = lambda job, c: counters.where(F.col("job") == job).agg(
        (F.coalesce(F.sum(F.col("counts")[c]), F.lit(0)) > 0).cast("long")).scalar()
    cursor = progress.where(F.col("mode") == "incremental").agg(F.coalesce(F.max("cursor_seq"), F.lit(0)).cast("long").alias("c"))
    left = change_log.where(F.col("seq") > cursor.scalar())
    return quality_checks([
        ("docs_eq_source", rows.withColumn("actual", n(docs))),
        ("docs_of_other_version", zero.withColumn("actual", wrong.getField("docs"))),
        ("events_eq_products", rows.withColumn("actual", events.agg(F.count_distinct("product_id")).scalar())),
        ("events_twice", zero.withColumn("actual", events.agg(F.count(F.lit(1)) - F.count_distinct("event_id")).scalar())),
        ("products_without_event", zero.withColumn("actual", wrong.getField("events"))),
        ("events_without_product", zero.withColumn("actual", wrong.getField("unknown"))),
        ("documents_absorbed_replays", one.withColumn("actual", absorbed("writer", "duplicate"))),
        ("events_absorbed_replays", one.withColumn("actual", absorbed("consumer", "duplicates"))),
        ("changes_left", zero.withColumn("actual", n(left))),
        ("open_dlq", zero.withColumn("actual", n(dlq.where(F.col("status") == "open")))),
    ])
