"""DuckDB twins of the registered queries (same column names and types).

Fixtures are inlined as CTEs (``with_fixtures``); every text here is plain SQL
over the driver's views.
"""

from __future__ import annotations

from .fixture_sql import with_fixtures as W

ORACLE: dict[str, str] = {}

AS_OF = "(SELECT MAX(changed_at) FROM fx_change_log)"
SAFE = f"SELECT * FROM fx_change_log WHERE seq > 0 AND changed_at <= {AS_OF} - INTERVAL 1 DAY"
ALLOWED = "('brand','color','weight_kg','tags','description')"


def violation_sql(a: str = "attributes") -> str:
    """First violation of the strict contract (same order and text as Spark)."""
    unknown = f"list_sort(list_filter(json_keys({a}), lambda k: k NOT IN {ALLOWED}))"

    def field(f, bad, target):
        return (f"WHEN json_type({a}, '$.{f}') IS NOT NULL AND json_type({a}, '$.{f}') <> 'NULL' AND ({bad}) "
                f"THEN 'document_parsing_exception: failed to parse field [attributes.{f}] of type [{target}]'")
    obj = lambda f: f"json_type({a}, '$.{f}') = 'OBJECT'"
    tags_bad = (f"json_type({a}, '$.tags') = 'OBJECT' OR (json_type({a}, '$.tags') = 'ARRAY' AND "
                f"len(list_filter(json_extract({a}, '$.tags[*]'), lambda x: json_type(x) = 'OBJECT')) > 0)")
    weight_bad = (f"json_type({a}, '$.weight_kg') = 'BOOLEAN' OR "
                  f"TRY_CAST(json_extract_string({a}, '$.weight_kg') AS DOUBLE) IS NULL")
    return f"""CASE
      WHEN {a} IS NOT NULL AND (NOT json_valid({a}) OR json_type({a}) NOT IN ('OBJECT', 'NULL'))
        THEN 'document_parsing_exception: failed to parse field [attributes]'
      WHEN json_type({a}) = 'OBJECT' AND len({unknown}) > 0
        THEN 'strict_dynamic_mapping_exception: unknown field(s) [' || array_to_string({unknown}, ',') || '] in [attributes]'
      {field('brand', obj('brand'), 'keyword')}
      {field('color', obj('color'), 'keyword')}
      {field('weight_kg', weight_bad, 'double')}
      {field('tags', tags_bad, 'keyword')}
      {field('description', obj('description'), 'keyword')}
    END"""


COLLAPSED = f"SELECT product_id, arg_max(op, seq) AS op FROM ({SAFE}) s GROUP BY product_id"
BATCH = f"""SELECT p.*, c.op, {violation_sql('p.attributes')} AS error
            FROM fx_products p JOIN ({COLLAPSED}) c ON c.product_id = p.id"""
OUTCOME = """CASE WHEN error IS NOT NULL THEN 'dlq'
                  WHEN doc_version IS NULL OR version > doc_version THEN 'ok'
                  ELSE 'duplicate' END"""

ORACLE["change_batch_summary"] = W(f"""
SELECT outcome, op, count(*) AS n FROM (
  SELECT {OUTCOME} AS outcome, op FROM (
    SELECT b.*, d.version AS doc_version FROM ({BATCH}) b LEFT JOIN fx_docs_old d ON d.id = b.id) g) o
GROUP BY outcome, op""")

# ---------------------------------------------------------------- 2.1 scans
TARGET = "(SELECT COALESCE(MAX(id), 0) FROM fx_products)"
ORACLE["scan_keyset_page"] = W(f"""
SELECT id, sku, version FROM fx_products WHERE id > 500 AND id <= {TARGET} ORDER BY id LIMIT 500""")
ORACLE["scan_backfill_range"] = W(f"""
SELECT id, version, CAST(floor((id - 0 - 1) / 500) AS BIGINT) AS range_id
FROM fx_products WHERE id > 0 AND id <= {TARGET}""")
ORACLE["snapshot_high_water"] = W("SELECT CAST(COALESCE(MAX(id), 0) AS BIGINT) AS target_max_id FROM fx_products")
ORACLE["scan_changes"] = W(SAFE)
ORACLE["scan_changes_prefix_safe"] = W(f"""
SELECT * FROM fx_change_log WHERE seq > 0 AND seq < COALESCE(
  (SELECT MIN(seq) FROM fx_change_log WHERE seq > 0 AND changed_at > {AS_OF} - INTERVAL 1 DAY),
  CAST(4611686018427387904 AS BIGINT))""")
ORACLE["lookup_by_ids"] = W("""
SELECT id, version, deleted_at FROM fx_products WHERE id IN (SELECT record_id FROM fx_dlq)""")
ORACLE["source_count"] = W("SELECT count(*) AS n FROM fx_products")

# ---------------------------------------------------------------- minimum slice parts
ORACLE["collapse_changes"] = W(f"""
SELECT product_id, arg_max(op, seq) AS op, max(seq) AS last_seq, count(*) AS n_changes
FROM ({SAFE}) s GROUP BY product_id""")
ORACLE["join_changes_current"] = W(f"""
SELECT p.id, p.version, c.op, p.deleted_at FROM fx_products p JOIN ({COLLAPSED}) c ON c.product_id = p.id""")
ORACLE["validate_strict"] = W(f"SELECT id, {violation_sql()} AS error FROM fx_products")
ORACLE["gate_join"] = W("""
SELECT p.id, p.version, d.version AS doc_version FROM fx_products p LEFT JOIN fx_docs_old d ON d.id = p.id""")
ORACLE["classify_outcomes"] = W("""
SELECT id, status,
       CASE WHEN status >= 200 AND status < 300 THEN 'ok' WHEN status = 409 THEN 'duplicate'
            WHEN status = 429 OR status >= 500 THEN 'retry' ELSE 'dlq' END AS outcome,
       CASE WHEN (status >= 200 AND status < 300) OR status = 409 OR status = 429 OR status >= 500 THEN error
            ELSE COALESCE(error, 'http ' || COALESCE(CAST(status AS VARCHAR), 'null')) END AS error
FROM fx_bulk_items""")

BACKFILL_OUTCOMES = f"""
SELECT 'backfill' AS mode, 'backfill-' || CAST(CAST(floor((p.id - 1) / 500) AS BIGINT) AS VARCHAR) AS batch_id,
       p.id, p.version, {OUTCOME} AS outcome
FROM (SELECT p.*, {violation_sql('p.attributes')} AS error, d.version AS doc_version
      FROM fx_products p LEFT JOIN fx_docs_old d ON d.id = p.id WHERE p.id > 0 AND p.id <= {TARGET}) p"""
ORACLE["batch_summary"] = W(f"""
SELECT mode, batch_id, CAST(count_if(outcome = 'ok') AS BIGINT) AS written,
       CAST(count_if(outcome = 'duplicate') AS BIGINT) AS duplicates,
       CAST(count_if(outcome = 'dlq') AS BIGINT) AS dlq, CAST(count_if(outcome = 'retry') AS BIGINT) AS retry,
       CAST(1 AS BIGINT) AS attempts
FROM ({BACKFILL_OUTCOMES}) o GROUP BY mode, batch_id""")


# ======================================================================
# shared derived inputs
def _num(path: str) -> str:
    x = f"TRY_CAST(json_extract_string(jb, '{path}') AS DOUBLE)"
    return (f"CASE WHEN json_type(jb, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') "
            f"AND isfinite({x}) THEN {x} END")


def _present(path: str) -> str:
    return f"COALESCE(json_type(jb, '{path}'), 'NULL') <> 'NULL'"


PARSED = f"""
SELECT delivery_id, message_id, body,
       CASE WHEN error IS NULL THEN eid END AS event_id,
       CASE WHEN error IS NULL THEN CAST(round(pid) AS BIGINT) END AS product_id,
       CASE WHEN error IS NULL THEN op0 END AS op,
       CASE WHEN error IS NULL THEN CAST(round(ver) AS BIGINT) END AS version,
       error
FROM (
  SELECT *, CASE WHEN jb IS NULL THEN 'invalid json'
                 WHEN json_type(jb) NOT IN ('OBJECT', 'ARRAY') THEN 'body is not an object'
                 WHEN eid IS NULL THEN 'missing event_id'
                 WHEN pid IS NULL OR ver IS NULL THEN 'missing product_id/version' END AS error
  FROM (
    SELECT *,
      CASE WHEN json_type(jb, '$.event_id') = 'VARCHAR' AND json_extract_string(jb, '$.event_id') <> ''
             THEN json_extract_string(jb, '$.event_id')
           WHEN message_id <> '' THEN message_id END AS eid,
      CASE WHEN {_present('$.product_id')} THEN {_num('$.product_id')} ELSE {_num('$.product.id')} END AS pid,
      CASE WHEN {_present('$.version')} THEN {_num('$.version')} ELSE {_num('$.product.version')} END AS ver,
      CASE WHEN json_type(jb, '$.op') = 'VARCHAR' THEN json_extract_string(jb, '$.op') ELSE 'update' END AS op0
    FROM (SELECT *, CASE WHEN COALESCE(json_valid(body), false) THEN body END AS jb FROM fx_deliveries) d0
  ) d1
) d2"""

GOOD = "SELECT * FROM parsed WHERE error IS NULL"
CONSUMED = """
SELECT f.event_id, f.product_id, f.op, f.version, f.payload, c.changed_at AS consumed_at
FROM (SELECT event_id, arg_min(product_id, delivery_id) AS product_id, arg_min(op, delivery_id) AS op,
             arg_min(version, delivery_id) AS version, arg_min(body, delivery_id) AS payload
      FROM parsed WHERE error IS NULL GROUP BY event_id) f
LEFT JOIN fx_change_log c ON c.product_id = f.product_id AND c.version = f.version"""
P_CTES = (("parsed", PARSED),)
C_CTES = (("parsed", PARSED), ("consumed", CONSUMED))

MID = """(SELECT make_timestamp(CAST(floor((epoch_us(MIN(consumed_at)) + epoch_us(MAX(consumed_at))) / 2) AS BIGINT))
          FROM fx_event_log_large)"""
LARGE_STORE = f"SELECT * FROM fx_event_log_large WHERE consumed_at < {MID}"
NOW = AS_OF
HALF = "(SELECT CAST(floor(MAX(seq) / 2) AS BIGINT) FROM fx_change_log)"

# ---------------------------------------------------------------- 2.3
ORACLE["project_record"] = W("""
SELECT id, sku, name, category, CAST(price AS DOUBLE) AS price, stock, attributes, version, updated_at, deleted_at
FROM fx_products""")
ORACLE["to_event"] = W(f"""
SELECT CAST(p.id AS VARCHAR) || ':' || CAST(p.version AS VARCHAR) AS event_id, p.id AS product_id,
       COALESCE(c.op, 'update') AS op, p.version, p.name, {AS_OF} AS emitted_at
FROM fx_products p JOIN ({COLLAPSED}) c ON c.product_id = p.id""")
ORACLE["parse_event"] = W("SELECT delivery_id, event_id, product_id, op, version, error FROM parsed", *P_CTES)
ORACLE["flatten_bulk"] = W("""
SELECT id, status,
       CASE WHEN error IS NOT NULL THEN error || ': rejected item ' || CAST(id AS VARCHAR)
            || CASE WHEN status = 400 THEN ' (illegal_argument_exception: bad value)' ELSE '' END END AS error
FROM fx_bulk_items""")
ORACLE["route_outcomes"] = W("""
SELECT r.route, COALESCE(c.n, 0) AS n FROM (VALUES ('ok'), ('duplicate'), ('retry'), ('dlq')) r(route)
LEFT JOIN (SELECT CASE WHEN status >= 200 AND status < 300 THEN 'ok' WHEN status = 409 THEN 'duplicate'
                       WHEN status = 429 OR status >= 500 THEN 'retry' ELSE 'dlq' END AS route, count(*) AS n
           FROM fx_bulk_items GROUP BY 1) c ON c.route = r.route""")
ORACLE["filter_live"] = W("SELECT id, version FROM fx_products WHERE deleted_at IS NULL")
ORACLE["filter_id_or_category"] = W("SELECT id, category FROM fx_products WHERE category = 'economy'")
ORACLE["filter_open_dlq"] = W("SELECT record_id, attempts FROM fx_dlq WHERE sink = 'es' AND status = 'open'")

# ---------------------------------------------------------------- 2.4
ORACLE["anti_absent"] = W(f"""
SELECT event_id, op, consumed_at FROM fx_event_log_large b
WHERE NOT EXISTS (SELECT 1 FROM ({LARGE_STORE}) s WHERE s.event_id = b.event_id)""")
ORACLE["insert_if_absent"] = W(f"""
SELECT event_id, product_id, version, op, consumed_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY consumed_at, op) AS rn FROM fx_event_log_large) b
WHERE rn = 1 AND event_id NOT IN (SELECT event_id FROM ({LARGE_STORE}) s)""")
ORACLE["insert_counts"] = W(f"""
SELECT CAST(count(*) AS BIGINT) AS received, CAST(count(DISTINCT event_id) AS BIGINT) AS unique,
       CAST((SELECT count(DISTINCT event_id) FROM fx_event_log_large
             WHERE event_id NOT IN (SELECT event_id FROM ({LARGE_STORE}) s)) AS BIGINT) AS stored,
       CAST(count(*) - (SELECT count(DISTINCT event_id) FROM fx_event_log_large
             WHERE event_id NOT IN (SELECT event_id FROM ({LARGE_STORE}) s)) AS BIGINT) AS duplicates
FROM fx_event_log_large""")
ORACLE["replay_missing"] = W("""
SELECT DISTINCT record_id AS id FROM fx_dlq WHERE sink = 'es' AND status = 'open'
  AND record_id NOT IN (SELECT id FROM fx_products)""")
ORACLE["requested_minus_found"] = W("SELECT record_id AS id FROM fx_dlq WHERE record_id NOT IN (SELECT id FROM fx_products)")
REJECTS = f"SELECT id, version, error, attributes FROM ({BACKFILL_OUTCOMES.replace('p.id, p.version,', 'p.id, p.version, p.error, p.attributes,')}) o WHERE outcome = 'dlq'"
ORACLE["reject_payload_join"] = W(REJECTS)
WRITTEN = f"SELECT DISTINCT id FROM ({BACKFILL_OUTCOMES}) o WHERE outcome IN ('ok', 'duplicate')"
ORACLE["written_ids"] = W(WRITTEN)
ORACLE["auto_resolve"] = W(f"""
SELECT sink, record_id, version, error, batch_id, mode, attempts,
       CASE WHEN status = 'open' AND record_id IN ({WRITTEN}) THEN 'resolved' ELSE status END AS status,
       CASE WHEN status = 'open' AND record_id IN ({WRITTEN}) THEN {NOW} ELSE updated_at END AS updated_at
FROM fx_dlq""")

# ---------------------------------------------------------------- 2.5
ORACLE["event_counts"] = W("""
SELECT count(*) AS events, count(DISTINCT product_id) AS products, count(DISTINCT event_id) AS event_ids
FROM fx_event_log_large""")
ORACLE["dlq_counts"] = W("""
SELECT CAST(count_if(sink = 'es') AS BIGINT) AS es, CAST(count_if(sink = 'rabbitmq') AS BIGINT) AS rabbitmq
FROM fx_dlq WHERE status = 'open'""")
ORACLE["lag"] = W(f"""
SELECT CAST(COALESCE(MAX(seq), 0) AS BIGINT) AS max_seq,
       CAST(greatest(0, COALESCE(MAX(seq), 0) - {HALF}) AS BIGINT) AS lag_seq,
       CAST(count_if(seq > {HALF}) AS BIGINT) AS lag_rows,
       COALESCE(round((epoch_us({AS_OF}) - epoch_us(MIN(CASE WHEN seq > {HALF} THEN changed_at END))) / 1e6, 1), 0.0)
         AS lag_seconds
FROM fx_change_log""")
ORACLE["facet_counts"] = W("""
SELECT category AS key, count(*) AS count FROM fx_products GROUP BY category ORDER BY count DESC, key LIMIT 50""")
ORACLE["version_sum"] = W("""
SELECT CAST(COALESCE(SUM(version), 0) AS BIGINT) AS source_version_sum,
       (SELECT CAST(COALESCE(SUM(version), 0) AS BIGINT) FROM fx_docs_old) AS docs_version_sum,
       MAX(version) AS source_max_version
FROM fx_products""")
ORACLE["sink_totals"] = W(f"""
SELECT 'es' AS sink, mode, CAST(count_if(outcome = 'ok') AS BIGINT) AS written,
       CAST(count_if(outcome = 'duplicate') AS BIGINT) AS duplicates, CAST(count_if(outcome = 'dlq') AS BIGINT) AS dlq,
       count(DISTINCT batch_id) AS batches
FROM ({BACKFILL_OUTCOMES}) o GROUP BY mode
UNION ALL
SELECT 'rabbitmq', mode, count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(DISTINCT batch_id)
FROM ({BACKFILL_OUTCOMES}) o GROUP BY mode""")
STORE_HALF = f"""SELECT * FROM consumed c WHERE EXISTS (SELECT 1 FROM fx_change_log l WHERE l.seq <= {HALF}
                 AND l.product_id = c.product_id AND l.version = c.version)"""
ORACLE["consumer_totals"] = W(f"""
SELECT CAST(g.n + m.n AS BIGINT) AS received, u.n AS unique, s.n AS stored,
       CAST(g.n - s.n AS BIGINT) AS duplicates, m.n AS malformed
FROM (SELECT count(*) AS n FROM parsed WHERE error IS NULL) g,
     (SELECT count(*) AS n FROM parsed WHERE error IS NOT NULL) m,
     (SELECT count(DISTINCT event_id) AS n FROM parsed WHERE error IS NULL) u,
     (SELECT count(DISTINCT event_id) AS n FROM parsed WHERE error IS NULL
        AND event_id NOT IN (SELECT event_id FROM ({STORE_HALF}) h)) s""", *C_CTES)

# ---------------------------------------------------------------- 2.6
ORACLE["sliding_rate"] = W("""
SELECT mode, t_ms, CAST(round(s / greatest(1000, t_ms - f) * 1000) AS BIGINT) AS rate FROM (
  SELECT mode, t_ms,
         SUM(n) OVER (PARTITION BY mode ORDER BY t_ms RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW) AS s,
         MIN(t_ms) OVER (PARTITION BY mode ORDER BY t_ms RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW) AS f
  FROM fx_rate_samples) r""")
ORACLE["dedupe_first"] = W("""
SELECT event_id, MIN(delivery_id) AS delivery_id, arg_min(product_id, delivery_id) AS product_id,
       arg_min(version, delivery_id) AS version
FROM parsed WHERE error IS NULL GROUP BY event_id""", *P_CTES)
ORACLE["derive_changes"] = W("SELECT * FROM fx_change_log")
ORACLE["apply_mutations"] = W("SELECT id, stock, version, updated_at, deleted_at FROM fx_products")

from .fixture_sql import FX  # noqa: E402

OLD_PRODUCTS = FX["fx_products"].replace(
    "FROM fx_mutations f JOIN fx_change_log c",
    f"FROM (SELECT * FROM fx_mutations WHERE seq <= {HALF}) f JOIN fx_change_log c")
ORACLE["snapshot_diff"] = W("""
SELECT id, op, version FROM (
  SELECT COALESCE(n.id, o.id) AS id,
         CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'gone'
              WHEN o.deleted_at IS NULL AND n.deleted_at IS NOT NULL THEN 'delete'
              WHEN o.stock IS DISTINCT FROM n.stock OR o.version IS DISTINCT FROM n.version
                OR o.updated_at IS DISTINCT FROM n.updated_at OR o.deleted_at IS DISTINCT FROM n.deleted_at
              THEN 'update' END AS op,
         n.version
  FROM old_products o FULL OUTER JOIN fx_products n ON o.id = n.id) x
WHERE op IS NOT NULL""", ("old_products", OLD_PRODUCTS))
ORACLE["last_n_per_key"] = W("""
SELECT product_id, event_id, version, rn FROM (
  SELECT product_id, event_id, version,
         ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY version DESC, event_id ASC) AS rn FROM consumed) x
WHERE rn <= 10""", *C_CTES)

# ---------------------------------------------------------------- 2.7
ORACLE["recent_events"] = W("""
SELECT event_id, product_id, op, version, consumed_at, json_extract_string(payload, '$.product.name') AS name
FROM consumed ORDER BY consumed_at DESC, event_id ASC LIMIT 50""", *C_CTES)
ORACLE["dlq_list"] = W("""
SELECT record_id, updated_at, attempts FROM fx_dlq WHERE status = 'open'
ORDER BY updated_at DESC, record_id ASC LIMIT 100""")
ORACLE["dlq_open_ids"] = W("SELECT record_id FROM fx_dlq WHERE sink = 'es' AND status = 'open' ORDER BY record_id")
ORACLE["browse_page"] = W("""
SELECT id, updated_at, (SELECT count(*) FROM fx_products) AS total FROM fx_products
ORDER BY updated_at DESC, id ASC LIMIT 25 OFFSET 50""")
ORACLE["browse_deep_page"] = """
SELECT o_orderkey + 1 AS id, o_orderdate AS updated_at, (SELECT count(*) FROM orders) AS total FROM orders
ORDER BY updated_at DESC, id ASC LIMIT 25 OFFSET 12475"""
ORACLE["random_sample"] = W("""
SELECT id, version FROM fx_products WHERE deleted_at IS NULL ORDER BY md5(CAST(id AS VARCHAR) || '42') LIMIT 25""")

# ---------------------------------------------------------------- 2.8 search
TOK = r"'[\p{L}\p{N}]+'"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {TOK})"


def search_sql(q: str, category: str | None = None) -> str:
    qt = toks(f"'{q}'")
    cat = f" AND category = '{category}'" if category else ""
    return f"""
SELECT id, count(*) OVER () AS total FROM fx_products
WHERE (list_has_any({toks('name')}, {qt})
   OR list_has_any({toks("json_extract_string(attributes, '$.description')")}, {qt})
   OR sku = '{q}' OR json_extract_string(attributes, '$.brand') = '{q}'
   OR COALESCE(list_contains(CAST(json_extract(attributes, '$.tags') AS VARCHAR[]), '{q}'), false)){cat}"""


ORACLE["search_docs"] = W(search_sql("gear"))
ORACLE["search_docs_keyword"] = W(search_sql("Brand#13", "economy"))


def bm25_sql(fields_sql: str, q: str, boosts: dict[str, float], limit: int = 50) -> str:
    boost = "1.0"
    for f, b in boosts.items():
        boost = f"CASE WHEN h.field = '{f}' THEN {float(b)} ELSE {boost} END"
    return f"""
WITH fields AS ({fields_sql}),
toks AS (SELECT id, field, {toks('text')} AS toks FROM fields WHERE text IS NOT NULL),
stats AS (SELECT field, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM toks GROUP BY field),
terms AS (SELECT DISTINCT unnest({toks(f"'{q}'")}) AS term),
hits AS (SELECT id, field, term, count(*) AS tf, max(dl) AS dl
         FROM (SELECT id, field, len(toks) AS dl, unnest(toks) AS term FROM toks) x
         WHERE term IN (SELECT term FROM terms) GROUP BY id, field, term),
dfs AS (SELECT field, term, count(*) AS df FROM hits GROUP BY field, term),
per_field AS (
  SELECT h.id, h.field,
         SUM(ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * h.tf * 2.2
             / (h.tf + 1.2 * (1 - 0.75 + 0.75 * h.dl / s.avgdl))) * {boost} AS fs
  FROM hits h JOIN dfs d ON d.field = h.field AND d.term = h.term JOIN stats s ON s.field = h.field
  GROUP BY h.id, h.field)
SELECT id, round(max(fs), 6) AS score FROM per_field GROUP BY id ORDER BY score DESC, id LIMIT {limit}"""


def search_page_sql(q: str, category: str | None, page: int, size: int) -> str:
    """Hits by the plain match, ranked by fields, terms and frequencies as rows."""
    return f"""
WITH text AS (SELECT id, 'name' AS field, {toks('name')} AS toks FROM fx_products WHERE name IS NOT NULL
  UNION ALL SELECT id, 'description', {toks("json_extract_string(attributes, '$.description')")} FROM fx_products
  WHERE json_extract_string(attributes, '$.description') IS NOT NULL),
keywords AS (SELECT id, 'sku' AS field, [sku] AS vals FROM fx_products WHERE sku IS NOT NULL
  UNION ALL SELECT id, 'brand', [json_extract_string(attributes, '$.brand')] FROM fx_products WHERE json_extract_string(attributes, '$.brand') IS NOT NULL
  UNION ALL SELECT id, 'tags', CAST(json_extract(attributes, '$.tags') AS VARCHAR[]) FROM fx_products
  WHERE json_type(attributes, '$.tags') = 'ARRAY'),
terms AS (SELECT DISTINCT unnest({toks(f"'{q}'")}) AS term),
tfs AS (SELECT id, field, term, count(*) AS tf, any_value(dl) AS dl
        FROM (SELECT id, field, len(toks) AS dl, unnest(toks) AS term FROM text) x SEMI JOIN terms USING (term) GROUP BY ALL),
lengths AS (SELECT field, count(*) AS n, avg(len(toks)) AS len FROM text GROUP BY field),
by_text AS (
  SELECT t.id, t.field, sum(ln(1 + (l.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / l.len)))
         * CASE t.field WHEN 'name' THEN 2.0 ELSE 1.0 END AS score
  FROM tfs t JOIN lengths l USING (field) JOIN (SELECT field, term, count(*) AS df FROM tfs GROUP BY ALL) d USING (field, term)
  GROUP BY t.id, t.field),
by_keyword AS (
  SELECT k.id, k.field, ln(1 + (c.n - c.df + 0.5) / (c.df + 0.5)) AS score
  FROM keywords k JOIN (SELECT field, count(*) AS n, count_if(list_contains(vals, '{q}')) AS df FROM keywords GROUP BY field) c USING (field)
  WHERE list_contains(k.vals, '{q}'))
SELECT id, score, total FROM (
  SELECT h.id, round(max(b.score), 6) AS score, any_value(h.total) AS total
  FROM ({search_sql(q, category)}) h JOIN (SELECT * FROM by_text UNION ALL SELECT * FROM by_keyword) b ON b.id = h.id GROUP BY h.id) z
ORDER BY score DESC, id LIMIT {size} OFFSET {(page - 1) * size}"""


ORACLE["search_page"] = W("SELECT * FROM (" + search_page_sql("blue gear", "economy", 3, 20) + ") y")
ORACLE["search_page_keyword"] = W("SELECT * FROM (" + search_page_sql("Brand#13", None, 2, 40) + ") y")
ORACLE["search_page_browse"] = W("""
SELECT id, CAST(NULL AS DOUBLE) AS score, (SELECT count(*) FROM fx_products WHERE category = 'economy') AS total
FROM fx_products WHERE category = 'economy' ORDER BY updated_at DESC, id LIMIT 25 OFFSET 25""")
PRODUCT_FIELDS = """SELECT id, 'name' AS field, name AS text FROM fx_products
  UNION ALL SELECT id, 'description', json_extract_string(attributes, '$.description') FROM fx_products"""
ORACLE["search_scored"] = W(bm25_sql(PRODUCT_FIELDS, "blue gear", {"name": 2.0}).replace("WITH fields", "SELECT * FROM (WITH fields", 1) + ") z")
ORACLE["search_scored_documents"] = bm25_sql(
    "SELECT doc_id AS id, 'text' AS field, text FROM documents", "the river of ouen", {})

# ---------------------------------------------------------------- DLQ life cycle
REJ = f"SELECT id, version, error FROM ({BACKFILL_OUTCOMES.replace('p.id, p.version,', 'p.id, p.version, p.error,')}) o WHERE outcome = 'dlq'"
ORACLE["dlq_upsert"] = W(f"""
SELECT COALESCE(d.sink, 'es') AS sink, COALESCE(d.record_id, r.id) AS record_id,
       CASE WHEN r.id IS NOT NULL THEN r.version ELSE d.version END AS version,
       CASE WHEN r.id IS NOT NULL THEN r.error ELSE d.error END AS error,
       CASE WHEN r.id IS NOT NULL THEN 'backfill-run-1' ELSE d.batch_id END AS batch_id,
       CASE WHEN r.id IS NOT NULL THEN 'backfill' ELSE d.mode END AS mode,
       CAST(CASE WHEN r.id IS NOT NULL AND d.status IS NOT NULL THEN d.attempts + 1
                 WHEN r.id IS NOT NULL THEN 1 ELSE d.attempts END AS INTEGER) AS attempts,
       CASE WHEN r.id IS NOT NULL THEN 'open' ELSE d.status END AS status,
       CASE WHEN r.id IS NOT NULL THEN {NOW} ELSE d.updated_at END AS updated_at
FROM fx_dlq d FULL OUTER JOIN ({REJ}) r ON d.sink = 'es' AND d.record_id = r.id""")
GONE = "SELECT record_id FROM fx_dlq WHERE record_id NOT IN (SELECT id FROM fx_products)"
ORACLE["dlq_resolve"] = W(f"""
SELECT sink, record_id, version, error, batch_id, mode, attempts,
       CASE WHEN sink = 'es' AND record_id IN ({GONE}) THEN 'resolved' ELSE status END AS status,
       CASE WHEN sink = 'es' AND record_id IN ({GONE}) THEN {NOW} ELSE updated_at END AS updated_at
FROM fx_dlq""")
ORACLE["dlq_bump"] = W(f"""
SELECT d.sink, d.record_id, d.version, COALESCE(r.error, d.error) AS error, d.batch_id, d.mode,
       CAST(CASE WHEN r.id IS NOT NULL THEN d.attempts + 1 ELSE d.attempts END AS INTEGER) AS attempts, d.status,
       CASE WHEN r.id IS NOT NULL THEN {NOW} ELSE d.updated_at END AS updated_at
FROM fx_dlq d LEFT JOIN ({REJ}) r ON d.sink = 'es' AND d.record_id = r.id""")

# ---------------------------------------------------------------- 2.12 monitoring
RECONCILE_JOIN = """
WITH s AS (SELECT id, version AS s_version FROM fx_products),
     d AS (SELECT id, version AS d_version FROM fx_docs_old),
     e AS (SELECT product_id AS id, max(version) AS e_version, count(*) AS e_n FROM consumed GROUP BY product_id),
     j AS (SELECT COALESCE(s.id, d.id) AS id, s_version, d_version FROM s FULL OUTER JOIN d ON s.id = d.id)
SELECT j.*, e.e_version, e.e_n FROM j FULL OUTER JOIN e ON j.id = e.id"""
ORACLE["reconcile"] = W(f"""
SELECT count(s_version) AS source_n, count(d_version) AS docs_n, CAST(COALESCE(SUM(e_n), 0) AS BIGINT) AS events_n,
       count(e_version) AS event_products,
       CAST(count_if(s_version IS NOT NULL AND d_version IS NULL) AS BIGINT) AS missing,
       CAST(count_if(s_version IS NULL AND d_version IS NOT NULL) AS BIGINT) AS extra,
       CAST(count_if(d_version < s_version) AS BIGINT) AS stale,
       CAST(count_if(d_version > s_version) AS BIGINT) AS ahead,
       CAST(count_if(d_version = s_version) AS BIGINT) AS equal,
       CAST(count_if(s_version IS NOT NULL AND e_version IS NULL) AS BIGINT) AS events_missing,
       CAST(count_if(e_version < s_version) AS BIGINT) AS events_behind,
       CAST(COALESCE(SUM(s_version), 0) AS BIGINT) AS source_version_sum,
       CAST(COALESCE(SUM(d_version), 0) AS BIGINT) AS docs_version_sum
FROM ({RECONCILE_JOIN}) k""", *C_CTES)


def by_digest_sql(docs: str, width: int) -> str:
    """Document figures per key, with the leaves of ``width`` ids that hold a difference."""
    return f"""
SELECT CAST(count_if(d IS NULL) AS BIGINT) AS missing, CAST(count_if(s IS NULL) AS BIGINT) AS extra,
       CAST(count_if(d < s) AS BIGINT) AS stale, CAST(count_if(d > s) AS BIGINT) AS ahead, CAST(count_if(d = s) AS BIGINT) AS equal,
       count(s) AS source_n, count(d) AS docs_n, CAST(COALESCE(SUM(s), 0) AS BIGINT) AS source_version_sum,
       CAST(COALESCE(SUM(d), 0) AS BIGINT) AS docs_version_sum, count(DISTINCT id // {width}) AS leaves,
       count(DISTINCT CASE WHEN s IS DISTINCT FROM d THEN id // {width} END) AS leaves_unlike
FROM (SELECT COALESCE(p.id, d.id) AS id, p.version AS s, d.version AS d FROM fx_products p FULL OUTER JOIN ({docs}) d ON d.id = p.id) j"""


ORACLE["reconcile_digest"] = W(by_digest_sql("SELECT id, version FROM fx_docs_old", 1024))
ORACLE["reconcile_digest_planted"] = W(by_digest_sql("""
SELECT id, version - CASE WHEN id % 701 = 7 THEN 1 ELSE 0 END AS version FROM fx_products WHERE id % 1009 <> 5
UNION ALL SELECT id + 1000000, version FROM fx_products WHERE id % 613 = 11""", 32))
ORACLE["reconcile_differences"] = W("""
SELECT COALESCE(p.id, e.id) AS id, p.version AS s_version, e.version AS e_version,
       CASE WHEN e.version IS NULL THEN 'missing' WHEN p.version IS NULL THEN 'extra' WHEN e.version < p.version THEN 'stale' ELSE 'ahead' END AS kind
FROM fx_products p FULL OUTER JOIN (SELECT product_id AS id, max(version) AS version FROM consumed GROUP BY product_id) e ON e.id = p.id
WHERE p.version IS DISTINCT FROM e.version""", *C_CTES)
ORACLE["store_in_sync"] = W("""
SELECT COALESCE(s.id, d.id) AS id, s.version, d.version AS doc_version,
       s.version IS NOT DISTINCT FROM d.version AS in_sync
FROM fx_products s FULL OUTER JOIN fx_docs_old d ON s.id = d.id""")
ORACLE["record_trace"] = W("""
SELECT p.id, p.version AS source_version, d.version AS doc_version, l.last_events,
       CAST(COALESCE(c.n_events, 0) AS BIGINT) AS n_events, q.status AS dlq_status, q.attempts AS dlq_attempts, z.entries AS dlq_entries
FROM fx_products p
LEFT JOIN fx_docs_old d ON d.id = p.id
LEFT JOIN (SELECT product_id AS id, string_agg(event_id, ',' ORDER BY rn) AS last_events FROM (
             SELECT product_id, event_id,
                    ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY version DESC, event_id DESC) AS rn
             FROM consumed) x WHERE rn <= 10 GROUP BY product_id) l ON l.id = p.id
LEFT JOIN (SELECT product_id AS id, count(*) AS n_events FROM consumed GROUP BY product_id) c ON c.id = p.id
LEFT JOIN (SELECT record_id, status, attempts FROM fx_dlq WHERE sink = 'es') q ON q.record_id = p.id
LEFT JOIN (SELECT record_id, string_agg(sink || ':' || status || ':' || CAST(attempts AS VARCHAR), ',' ORDER BY sink) AS entries
           FROM fx_dlq GROUP BY record_id) z ON z.record_id = p.id""", *C_CTES)
BRAND_LIST = "['acme','globex','initech','umbrella','stark','wayne','hooli','vandelay']"
CAT_LIST = "['electronics','books','garden','toys','sports','kitchen','fashion','auto','beauty','office','pets','music']"
COLOR_LIST = "['red','blue','green','black','white','silver','gold']"
ORACLE["scalar_functions"] = r"""
SELECT p_partkey AS k, 'SKU-' || lpad(CAST(p_partkey + 1 AS VARCHAR), 9, '0') AS sku,
       (""" + BRAND_LIST + r""")[1 + p_partkey % 8] AS brand,
       repeat(md5(CAST(p_partkey AS VARCHAR)), 2) AS filler,
       round(p_retailprice / 7, 3) AS rounded,
       CAST(round(p_retailprice) AS BIGINT) AS as_int,
       CAST(floor(p_retailprice / 7) AS BIGINT) AS floored,
       CAST(greatest(0, p_size - 25) AS BIGINT) AS clamped,
       least(100.0, round(p_size / 50 * 1000) / 10) AS pct,
       CASE WHEN p_name LIKE '%gear%' THEN 'gear' WHEN p_size BETWEEN 1 AND 10 THEN 'small'
            WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'low' ELSE 'other' END AS kind,
       left(p_type, 3) AS type3,
       trim('  ' || p_name || ' ') AS trimmed,
       regexp_full_match(p_name, '^\d+$') AS is_digits,
       COALESCE(json_extract_string('{"product":{"name":"' || p_name || '"}}', '$.product.name'), '?') AS json_name
FROM part"""
ORACLE["generate_rows"] = f"""
SELECT id, 'SKU-' || lpad(CAST(id AS VARCHAR), 9, '0') AS sku,
       upper(left(b, 1)) || substr(b, 2) || ' ' || c || ' item ' || CAST(id AS VARCHAR) AS name,
       c AS category, b AS brand, ({COLOR_LIST})[1 + (id * 7) % 7] AS color,
       repeat(md5(CAST(id AS VARCHAR)), 4) AS description
FROM (SELECT o_orderkey + 1 AS id, ({BRAND_LIST})[1 + (o_orderkey + 1) % 8] AS b,
             ({CAT_LIST})[1 + (o_orderkey + 1) % 12] AS c FROM orders) o"""

# ======================================================================
# tables, jobs and streams: expected final state
VALIDATED = f"SELECT id, version, {violation_sql('attributes')} AS error FROM fx_products"


def docs_after(products_filter: str = "") -> str:
    """Highest version wins: the seeded sink plus every valid source row written."""
    return f"""
SELECT id, version FROM (
  SELECT COALESCE(p.id, d.id) AS id,
         CASE WHEN p.id IS NOT NULL AND p.error IS NULL THEN greatest(p.version, COALESCE(d.version, p.version))
              ELSE d.version END AS version
  FROM (SELECT * FROM ({VALIDATED}) v {products_filter}) p FULL OUTER JOIN fx_docs_old d ON d.id = p.id) x
WHERE version IS NOT NULL"""


DOCS_AFTER_FULL = docs_after()
ORACLE["run_backfill"] = W(DOCS_AFTER_FULL)
ORACLE["versioned_upsert"] = W(DOCS_AFTER_FULL)
ORACLE["resume_after_crash"] = W(DOCS_AFTER_FULL)
ORACLE["run_both"] = W(DOCS_AFTER_FULL)
ORACLE["run_incremental"] = W(docs_after("WHERE id IN (SELECT product_id FROM fx_change_log)"))
RANGE_OUTCOMES = BACKFILL_OUTCOMES.replace("'backfill-' ||", "'backfill-r' ||").replace(
    "p.id, p.version,", "p.id, p.version, p.error,")
ORACLE["run_backfill_outcomes"] = W(f"SELECT outcome, count(*) AS n FROM ({RANGE_OUTCOMES}) o GROUP BY outcome")
ORACLE["dual_sink_write"] = W(f"""
SELECT mode, batch_id, CAST(count_if(outcome = 'ok') AS BIGINT) AS written,
       CAST(count_if(outcome = 'duplicate') AS BIGINT) AS duplicates,
       CAST(count_if(outcome = 'dlq') AS BIGINT) AS dlq, CAST(count_if(outcome = 'retry') AS BIGINT) AS retry,
       CAST(1 AS BIGINT) AS attempts
FROM ({RANGE_OUTCOMES}) o GROUP BY mode, batch_id""")
ORACLE["progress_commit"] = W("""
SELECT 'backfill-r' || CAST(r AS VARCHAR) AS batch_id, r AS range_id,
       CAST(least((r + 1) * 500, t) AS BIGINT) AS last_id, t AS target_max_id
FROM (SELECT t, unnest(generate_series(0, CAST(ceil(t / 500.0) AS BIGINT) - 1)) AS r
      FROM (SELECT CAST(MAX(id) AS BIGINT) AS t FROM fx_products) x) y""")
ORACLE["event_append"] = W("""
SELECT CAST(id AS VARCHAR) || ':' || CAST(version AS VARCHAR) AS message_id, 'insert' AS op FROM fx_products""")
R_REJ = f"SELECT id, version, error, batch_id FROM ({RANGE_OUTCOMES}) o WHERE outcome = 'dlq'"
R_WRITTEN = f"SELECT id FROM ({RANGE_OUTCOMES}) o WHERE outcome IN ('ok', 'duplicate')"
DLQ_AFTER_BACKFILL = f"""
SELECT COALESCE(d.sink, 'es') AS sink, COALESCE(d.record_id, r.id) AS record_id,
       CASE WHEN r.id IS NOT NULL THEN r.version ELSE d.version END AS version,
       CASE WHEN r.id IS NOT NULL THEN r.error ELSE d.error END AS error,
       CASE WHEN r.id IS NOT NULL THEN r.batch_id ELSE d.batch_id END AS batch_id,
       CASE WHEN r.id IS NOT NULL THEN 'backfill' ELSE d.mode END AS mode,
       CAST(CASE WHEN r.id IS NOT NULL AND d.record_id IS NOT NULL THEN d.attempts + 1
                 WHEN r.id IS NOT NULL THEN 1 ELSE d.attempts END AS INTEGER) AS attempts,
       CASE WHEN r.id IS NOT NULL THEN 'open'
            WHEN d.status = 'open' AND d.record_id IN ({R_WRITTEN}) THEN 'resolved' ELSE d.status END AS status,
       CASE WHEN r.id IS NOT NULL OR (d.status = 'open' AND d.record_id IN ({R_WRITTEN})) THEN {NOW}
            ELSE d.updated_at END AS updated_at
FROM fx_dlq d FULL OUTER JOIN ({R_REJ}) r ON d.record_id = r.id"""
ORACLE["run_backfill_dlq"] = W(DLQ_AFTER_BACKFILL)
ORACLE["run_consumer"] = W("""
SELECT event_id, arg_min(product_id, delivery_id) AS product_id, arg_min(op, delivery_id) AS op,
       arg_min(version, delivery_id) AS version
FROM parsed WHERE error IS NULL GROUP BY event_id""", *P_CTES)
ORACLE["consumer_dlq_append"] = W("""
SELECT COALESCE(message_id, '?') AS event_id, error, body AS raw FROM parsed WHERE error IS NOT NULL""", *P_CTES)
ORACLE["stream_change_log"] = W("SELECT * FROM fx_change_log")
ORACLE["stream_change_log_polled"] = ORACLE["stream_change_log"]
ORACLE["stream_deliveries"] = W("SELECT * FROM fx_deliveries")
ORACLE["stream_dedupe_bounded"] = W("SELECT DISTINCT event_id FROM fx_event_log_large")
# batches are years; one's watermark is the year before it less 400 days, and state made
# in year e is evicted at the end of the first batch whose watermark reaches e + 400 days
BY_YEAR = """
y AS (SELECT DISTINCT event_id, date_trunc('year', consumed_at) AS y FROM fx_event_log_large),
b AS (SELECT y, lag(y) OVER (ORDER BY y) - INTERVAL 400 DAY AS mark FROM (SELECT DISTINCT y FROM y) x),
over AS (SELECT e.y AS e, min(b.y) AS z FROM (SELECT DISTINCT y FROM y) e JOIN b ON b.mark >= e.y + INTERVAL 400 DAY GROUP BY e.y),
one AS (SELECT event_id, min(y) AS y FROM y GROUP BY event_id),
two AS (SELECT y.event_id, min(y.y) AS y FROM y JOIN one USING (event_id) JOIN over ON over.e = one.y WHERE y.y > over.z GROUP BY y.event_id),
three AS (SELECT y.event_id, min(y.y) AS y FROM y JOIN two USING (event_id) JOIN over ON over.e = two.y WHERE y.y > over.z GROUP BY y.event_id),
passed AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)"""


def by_year(body: str) -> str:
    return W("SELECT 1 FROM fx_event_log_large").replace("SELECT 1 FROM fx_event_log_large", "").rstrip() + "," + BY_YEAR + body


ORACLE["stream_dedupe_evicting"] = by_year("SELECT event_id, CAST(year(y) AS INTEGER) AS year FROM passed")
ORACLE["stream_dedupe_state"] = by_year("""
SELECT event_id, CAST(year(y) AS INTEGER) AS year FROM passed
WHERE y + INTERVAL 400 DAY > (SELECT max(y) FROM y) - INTERVAL 400 DAY""")
ORACLE["consumer_job_totals"] = W("""
SELECT count(*) AS received, count(*) FILTER (error IS NOT NULL) AS malformed,
       count(DISTINCT event_id) FILTER (error IS NULL) AS stored,
       count(*) FILTER (error IS NULL) - count(DISTINCT event_id) FILTER (error IS NULL) AS duplicates,
       CAST(4 AS BIGINT) AS batches, count(*) FILTER (error IS NOT NULL) AS dlq_size FROM parsed""", *P_CTES)
ORACLE["event_counts_approx"] = W("""
SELECT count(DISTINCT event_id) AS events, true AS products_close, true AS event_ids_close FROM fx_event_log_large""")
ORACLE["sink_job_totals"] = W(f"""
SELECT 'backfill' AS mode, count(*) FILTER (error IS NULL) AS ok, CAST(0 AS BIGINT) AS duplicate,
       count(*) FILTER (error IS NOT NULL) AS dlq, count(*) AS published FROM ({VALIDATED}) v
UNION ALL
SELECT 'incremental', CAST(0 AS BIGINT), count(*) FILTER (error IS NULL), count(*) FILTER (error IS NOT NULL), count(*)
FROM ({VALIDATED}) v WHERE id IN (SELECT product_id FROM fx_change_log)""")
ORACLE["end_to_end"] = W(f"""
SELECT count(*) AS source_n, count(*) FILTER (error IS NULL) AS docs_n, count(*) FILTER (error IS NOT NULL) AS dlq_open,
       count(*) AS events_n, count(DISTINCT id) AS event_ids, CAST(0 AS BIGINT) AS without_event,
       count(*) FILTER (id <= 500 * CAST(ceil(ceil((SELECT MAX(id) FROM fx_products) / 500.0) / 2) AS BIGINT)) AS published_again,
       true AS replays_absorbed
FROM ({VALIDATED}) v""")
ORACLE["end_to_end_events"] = W("""
SELECT CAST(id AS VARCHAR) || ':' || CAST(version AS VARCHAR) AS event_id, id AS product_id, version FROM fx_products""")
ORACLE["stateful_version_gate"] = W("""
SELECT product_id, delivery_id, version,
       CASE WHEN prev IS NULL OR version > prev THEN 'accepted' WHEN version = prev THEN 'replay' ELSE 'stale' END
         AS outcome
FROM (SELECT product_id, delivery_id, version,
             MAX(version) OVER (PARTITION BY product_id ORDER BY delivery_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM parsed WHERE error IS NULL) x""", *P_CTES)
# keys of the first wave: half of the ranges of 500 keys
FIRST_WAVE = "500 * CAST(ceil(ceil((SELECT MAX(id) FROM fx_products) / 500.0) / 2) AS BIGINT)"
CHANGED_IDS = "SELECT product_id FROM fx_change_log"
ORACLE["job_status"] = W(f"""
SELECT mode, batches, repeated, records, written, absorbed, rejected, published, {AS_OF} AS last_batch_at,
       rate, CASE WHEN repeated > 0 THEN {FIRST_WAVE} END AS resumed_from
FROM (
  SELECT 'backfill' AS mode, 1 + CAST(MAX(id) > {FIRST_WAVE} AS BIGINT) AS batches, CAST(MAX(id) > {FIRST_WAVE} AS BIGINT) AS repeated, count(*) AS records,
         count(*) FILTER (error IS NULL) AS written, CAST(0 AS BIGINT) AS absorbed, count(*) FILTER (error IS NOT NULL) AS rejected,
         count(*) AS published, count(*) AS rate FROM ({VALIDATED}) v
  UNION ALL
  SELECT 'incremental', 1, 0, count(*), 0, count(*) FILTER (error IS NULL), count(*) FILTER (error IS NOT NULL), count(*), count(*)
  FROM ({VALIDATED}) v WHERE id IN ({CHANGED_IDS})
  UNION ALL
  SELECT 'replay', 1, 0, count(*), count(*), 0, 0, 0, count(*) FROM ({VALIDATED}) v WHERE error IS NOT NULL
  UNION ALL
  SELECT 'consumer', 1, 0, count(*) + count(*) FILTER (id > {FIRST_WAVE}) + count(*) FILTER (id IN ({CHANGED_IDS})), count(*),
         count(*) FILTER (id > {FIRST_WAVE}) + count(*) FILTER (id IN ({CHANGED_IDS})), 0, 0, count(*) FROM fx_products
) x""")
EVENT_IDS = "SELECT id || ':' || version AS e, id FROM fx_products"
ORACLE["replication_gates"] = W(f"""
SELECT "check", expected, actual, expected IS NOT DISTINCT FROM actual AS pass FROM (
  SELECT unnest(['docs_eq_source', 'events_eq_products']) AS "check", count(*) AS expected, count(DISTINCT id) AS actual FROM fx_products
  UNION ALL SELECT 'events_twice', 0, count(*) - count(DISTINCT e) FROM ({EVENT_IDS}) i
  UNION ALL SELECT unnest(['docs_of_other_version', 'products_without_event', 'events_without_product', 'changes_left', 'open_dlq']), 0,
                   count(*) - count(DISTINCT id) FROM fx_products
  UNION ALL SELECT 'documents_absorbed_replays', 1, CAST(count(*) > 0 AS BIGINT) FROM ({VALIDATED}) v WHERE error IS NULL AND id IN ({CHANGED_IDS})
  UNION ALL SELECT 'events_absorbed_replays', 1, CAST(count(*) > 0 AS BIGINT) FROM fx_products WHERE id > {FIRST_WAVE} OR id IN ({CHANGED_IDS})
) c""")
OPEN_ES = "SELECT DISTINCT record_id FROM fx_dlq WHERE sink = 'es' AND status = 'open'"


def replay_sql(open_ids: str) -> str:
    return f"""
SELECT CAST(count(*) AS BIGINT) AS replayed,
       CAST(count_if(p.id IS NULL OR p.error IS NULL) AS BIGINT) AS resolved,
       CAST(count_if(p.id IS NOT NULL AND p.error IS NOT NULL) AS BIGINT) AS failed
FROM ({open_ids}) o LEFT JOIN ({VALIDATED}) p ON p.id = o.record_id"""


ORACLE["dlq_replay"] = W(replay_sql(OPEN_ES))
ORACLE["dlq_replay_one"] = W(replay_sql(
    "SELECT MIN(record_id) AS record_id FROM fx_dlq WHERE status = 'open'"))
DLQ_AFTER_REPLAY = f"""
SELECT d.record_id,
       CAST(CASE WHEN o.record_id IS NOT NULL AND p.error IS NOT NULL THEN d.attempts + 1 ELSE d.attempts END
            AS INTEGER) AS attempts,
       CASE WHEN o.record_id IS NOT NULL AND (p.id IS NULL OR p.error IS NULL) THEN 'resolved' ELSE d.status END
         AS status,
       CASE WHEN o.record_id IS NOT NULL AND p.error IS NOT NULL THEN p.error ELSE d.error END AS error
FROM fx_dlq d LEFT JOIN ({OPEN_ES}) o ON o.record_id = d.record_id
LEFT JOIN ({VALIDATED}) p ON p.id = d.record_id"""
ORACLE["dlq_replay_state"] = W(DLQ_AFTER_REPLAY)


def dlq_after(products_filter: str) -> str:
    """DLQ status after the source rows of the filter were written: rejects are
    open, written ones resolve their open entry."""
    return f"""
SELECT COALESCE(d.record_id, p.id) AS id, COALESCE(d.sink, p.sink) AS sink,
       CASE WHEN p.error IS NOT NULL THEN 'open' WHEN p.id IS NOT NULL AND d.status = 'open' THEN 'resolved'
            ELSE d.status END AS status
FROM (SELECT *, 'es' AS sink FROM ({VALIDATED}) v {products_filter}) p
FULL OUTER JOIN fx_dlq d ON d.record_id = p.id AND d.sink = p.sink
WHERE d.record_id IS NOT NULL OR p.error IS NOT NULL"""


def documents_and_dlq(docs: str, dlq: str) -> str:
    return W(f"""
SELECT 'document' AS kind, id, version, CAST(NULL AS VARCHAR) AS status FROM ({docs}) a
UNION ALL SELECT 'dlq', id, CAST(NULL AS BIGINT), status FROM ({dlq}) b""")


CHANGED = "WHERE id IN (SELECT product_id FROM fx_change_log)"
LOWER_HALF = "WHERE id <= (SELECT MAX(id) FROM fx_products) // 2"
ORACLE["replay_twice"] = documents_and_dlq(
    docs_after(f"WHERE id IN ({OPEN_ES})"), f"SELECT record_id AS id, status FROM ({DLQ_AFTER_REPLAY}) r")
ORACLE["incremental_two_runs"] = documents_and_dlq(docs_after(CHANGED), dlq_after(CHANGED))
ORACLE["run_both_at_once"] = documents_and_dlq(docs_after(), dlq_after(""))
ORACLE["resume_after_growth"] = documents_and_dlq(docs_after(LOWER_HALF), dlq_after(LOWER_HALF))
ORACLE["item_retry"] = W("""
SELECT id, CASE WHEN status IN (503, 429) THEN 201 ELSE status END AS status,
       CASE WHEN status IN (503, 429) OR (status >= 200 AND status < 300) THEN 'ok'
            WHEN status = 409 THEN 'duplicate' WHEN status >= 500 THEN 'retry' ELSE 'dlq' END AS outcome,
       CASE WHEN status = 503 THEN 2 WHEN status = 429 THEN 3 ELSE 1 END AS attempt
FROM fx_bulk_items""")
ORACLE["safety_window"] = W(f"""
SELECT count(*) AS held_back, MIN(seq) AS first_held_seq FROM fx_change_log
WHERE changed_at > {AS_OF} - INTERVAL 1 DAY""")
ORACLE["scan_docs"] = W("SELECT id, version, name, category FROM fx_docs_old")
ORACLE["doc_by_id"] = W("SELECT id, version, name FROM fx_docs_old WHERE id = (SELECT MAX(id) FROM fx_docs_old)")
ORACLE["doc_count"] = W("SELECT count(*) AS n FROM fx_docs_old")
LAG_BODY = f"""
SELECT CAST(greatest(0, COALESCE(MAX(seq), 0) - {HALF}) AS BIGINT) AS lag_seq,
       COALESCE(round((epoch_us({AS_OF}) - epoch_us(MIN(CASE WHEN seq > {HALF} THEN changed_at END))) / 1e6, 1), 0.0)
         AS lag_seconds
FROM fx_change_log"""
ORACLE["status_snapshot"] = W(f"""
SELECT s.n AS source_n, d.n AS docs_n, CAST(0 AS BIGINT) AS events_n, CAST(0 AS BIGINT) AS event_products,
       q.n AS dlq_open_es, CAST(0 AS BIGINT) AS dlq_open_rabbitmq, t.t AS last_id, t.t AS target_max_id,
       l.lag_seq, l.lag_seconds,
       CASE WHEN t.t > 0 THEN least(100.0, round(t.t / t.t * 1000) / 10) ELSE 0.0 END AS pct,
       CAST(greatest(0, s.n - d.n) AS BIGINT) AS docs_behind, CAST(greatest(0, d.n - s.n) AS BIGINT) AS docs_ahead
FROM (SELECT count(*) AS n FROM fx_products) s,
     (SELECT count(*) AS n FROM ({DOCS_AFTER_FULL}) x) d,
     (SELECT count(*) AS n FROM ({DLQ_AFTER_BACKFILL}) y WHERE status = 'open' AND sink = 'es') q,
     (SELECT CAST(MAX(id) AS BIGINT) AS t FROM fx_products) t,
     ({LAG_BODY}) l""")
ORACLE["quality_checks"] = W(f"""
SELECT "check", expected, actual, expected IS NOT DISTINCT FROM actual AS pass FROM (
  SELECT 'docs_eq_source' AS "check", (SELECT count(*) FROM fx_products) AS expected,
         (SELECT count(*) FROM ({DOCS_AFTER_FULL}) x) AS actual
  UNION ALL SELECT 'messages_unique', 0, 0
  UNION ALL SELECT 'version_sum_equal', (SELECT CAST(SUM(version) AS BIGINT) FROM fx_products),
         (SELECT CAST(SUM(version) AS BIGINT) FROM ({DOCS_AFTER_FULL}) x)
  UNION ALL SELECT 'rejects_quarantined', (SELECT count(*) FROM ({R_REJ}) r),
         (SELECT count(*) FROM ({DLQ_AFTER_BACKFILL}) y
          WHERE status = 'open' AND mode = 'backfill' AND batch_id LIKE 'backfill-r%')
  UNION ALL SELECT 'rejected_docs_not_written', 0, 0
  UNION ALL SELECT 'resume_position', (SELECT MAX(id) FROM fx_products), (SELECT MAX(id) FROM fx_products)
) c""")

BAD_IDS = f"SELECT id FROM ({VALIDATED}) v WHERE error IS NOT NULL"
ORACLE["set_json_field"] = W(f"""
SELECT id, version, TRY_CAST(json_extract_string(attributes, '$.weight_kg') AS DOUBLE) AS weight_kg,
       {violation_sql('attributes')} AS error, updated_at
FROM (SELECT p.id,
             CASE WHEN b.id IS NOT NULL THEN p.version + 1 ELSE p.version END AS version,
             CASE WHEN b.id IS NOT NULL THEN CAST(json_merge_patch(p.attributes, '{{"weight_kg":1.0}}') AS VARCHAR)
                  ELSE p.attributes END AS attributes,
             CASE WHEN b.id IS NOT NULL THEN {AS_OF} ELSE p.updated_at END AS updated_at
      FROM fx_products p LEFT JOIN ({BAD_IDS}) b ON b.id = p.id) x""")
ORACLE["join_changes_current_by_version"] = W(f"""
SELECT p.id, p.version, COALESCE(v.op, 'update') AS op
FROM fx_products p JOIN ({COLLAPSED}) c ON c.product_id = p.id
LEFT JOIN fx_change_log v ON v.product_id = p.id AND v.version = p.version""")
ORACLE["compact_docs"] = W(DOCS_AFTER_FULL)
