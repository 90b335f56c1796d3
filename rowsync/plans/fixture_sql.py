"""The fixture definitions of FIXTURES.md §3 as SQL text, for the DuckDB oracle.

DuckDB only sees the raw driver views, so each oracle query inlines the
fixtures it needs as CTEs (``with_fixtures``).
"""

from __future__ import annotations

FX = {}

FX["fx_mutations"] = """
SELECT event_id + 1 AS seq, user_id + 1 AS product_id, ts AS changed_at,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS version,
       CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'insert'
            WHEN event_type = 'error' THEN 'soft_delete'
            WHEN event_type = 'signup' THEN 'restore'
            ELSE 'touch' END AS kind
FROM events"""

FX["fx_change_log"] = """
SELECT seq, product_id,
       CASE WHEN kind = 'insert' THEN 'insert'
            WHEN kind = 'soft_delete'
                 AND ROW_NUMBER() OVER (PARTITION BY product_id, era, kind ORDER BY seq) = 1 THEN 'delete'
            ELSE 'update' END AS op,
       version, changed_at
FROM (SELECT x.*, SUM(CASE WHEN kind = 'restore' THEN 1 ELSE 0 END)
             OVER (PARTITION BY product_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS era
      FROM fx_mutations x) e"""

FX["fx_products"] = """
SELECT p.p_partkey + 1 AS id,
       'SKU-' || lpad(CAST(p.p_partkey + 1 AS STRING), 9, '0') AS sku,
       p.p_name AS name, lower(p.p_type) AS category, p.p_retailprice AS price,
       CAST(p.p_size + COALESCE(m.touches, 0) AS BIGINT) AS stock,
       '{"brand":"' || p.p_brand || '","color":"' || split_part(p.p_name, ' ', 1) || '","weight_kg":'
         || CASE WHEN p.p_partkey % 167 = 3 THEN '"not-a-number"'
                 WHEN p.p_partkey % 167 = 5 THEN '"12.5"'
                 ELSE CAST(p.p_partkey % 50 AS STRING) || '.25' END
         || CASE WHEN p.p_partkey % 167 = 7 THEN ',"unknown_field":1' ELSE '' END
         || ',"tags":["' || lower(p.p_type) || '","' || split_part(p.p_name, ' ', 2) || '"],"description":"'
         || repeat(md5(CAST(p.p_partkey + 1 AS STRING)), 4) || '"}' AS attributes,
       COALESCE(m.version, 1) AS version,
       COALESCE(m.updated_at, (SELECT MIN(ts) FROM events)) AS updated_at,
       CASE WHEN m.last_delete_seq > COALESCE(m.last_restore_seq, 0) THEN m.deleted_at END AS deleted_at
FROM part p LEFT JOIN (
  SELECT f.product_id, MAX(f.version) AS version, MAX(f.changed_at) AS updated_at,
         SUM(CASE WHEN f.kind = 'touch' THEN 1 ELSE 0 END) AS touches,
         MAX(CASE WHEN c.op = 'delete' THEN f.seq END) AS last_delete_seq,
         MAX(CASE WHEN f.kind = 'restore' THEN f.seq END) AS last_restore_seq,
         MAX(CASE WHEN c.op = 'delete' THEN f.changed_at END) AS deleted_at
  FROM fx_mutations f JOIN fx_change_log c ON f.seq = c.seq GROUP BY f.product_id) m
ON m.product_id = p.p_partkey + 1"""

FX["fx_docs_old"] = """
SELECT p.id, CASE WHEN p.id % 5 = 0 THEN p.version
                  WHEN p.id % 7 = 0 THEN p.version + 1
                  ELSE COALESCE(h.version, 0) END AS version, p.name, p.category
FROM fx_products p LEFT JOIN (
  SELECT product_id, MAX(version) AS version FROM fx_change_log
  WHERE seq <= (SELECT MAX(seq) / 2 FROM fx_change_log) GROUP BY product_id) h ON h.product_id = p.id
WHERE p.id % 3 <> 0"""

FX["fx_deliveries"] = """
SELECT seq AS delivery_id,
       CASE WHEN seq % 71 = 0 THEN NULL
            ELSE CAST(product_id AS STRING) || ':' || CAST(version AS STRING) END AS message_id,
       CASE WHEN seq % 97 = 0 THEN '{oops'
            WHEN seq % 89 = 0 THEN '"text"'
            WHEN seq % 83 = 0 THEN '{"event_id":"x"}'
            WHEN seq % 79 = 0 OR seq % 71 = 0 THEN
              '{"product":{"id":' || CAST(product_id AS STRING) || ',"version":' || CAST(version AS STRING) || '}}'
            ELSE '{"event_id":"' || CAST(product_id AS STRING) || ':' || CAST(version AS STRING)
              || '","product_id":' || CAST(product_id AS STRING) || ',"op":"' || op
              || '","version":' || CAST(version AS STRING)
              || ',"product":{"id":' || CAST(product_id AS STRING) || ',"name":"item ' || CAST(product_id AS STRING) || '"}}'
       END AS body
FROM (SELECT seq, product_id, op, version FROM fx_change_log
      UNION ALL
      SELECT seq + 1000000000, product_id, op, version FROM fx_change_log WHERE seq % 7 = 0) d"""

FX["fx_bulk_items"] = """
SELECT event_id + 1 AS id,
       CAST(CASE event_id % 23 WHEN 0 THEN 200 WHEN 1 THEN 409 WHEN 2 THEN 400 WHEN 3 THEN 429
            WHEN 4 THEN 503 WHEN 5 THEN 404 WHEN 6 THEN 302 WHEN 7 THEN NULL ELSE 201 END AS INT) AS status,
       CASE event_id % 23 WHEN 1 THEN 'version_conflict_engine_exception'
            WHEN 2 THEN 'document_parsing_exception: failed to parse field [attributes.weight_kg]'
            WHEN 3 THEN 'es_rejected_execution_exception' END AS error
FROM events"""

FX["fx_rate_samples"] = """
SELECT CASE WHEN event_id % 4 = 0 THEN 'incremental' ELSE 'backfill' END AS mode,
       event_id * 700 AS t_ms, 1 + (event_id * 37) % 500 AS n
FROM events"""

FX["fx_dlq"] = """
SELECT 'es' AS sink, id AS record_id, version, 'document_parsing_exception: seeded' AS error,
       'batch-0' AS batch_id, 'backfill' AS mode, CAST(1 + id % 3 AS INT) AS attempts,
       CASE WHEN id % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, updated_at
FROM fx_products WHERE id % 40 IN (1, 4) OR id % 167 = 4
UNION ALL
SELECT 'es', 999999999, 1, 'document_parsing_exception: seeded', 'batch-0', 'backfill', 1, 'open',
       (SELECT MIN(ts) FROM events)"""

FX["fx_event_log_large"] = """
SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS event_id,
       l_orderkey AS product_id, CAST(l_linenumber AS BIGINT) AS version,
       CASE l_returnflag WHEN 'A' THEN 'insert' WHEN 'R' THEN 'delete' ELSE 'update' END AS op,
       l_shipdate AS consumed_at
FROM lineitem"""

DEPENDS = {
    "fx_mutations": [],
    "fx_change_log": ["fx_mutations"],
    "fx_products": ["fx_mutations", "fx_change_log"],
    "fx_docs_old": ["fx_products", "fx_change_log"],
    "fx_deliveries": ["fx_change_log"],
    "fx_bulk_items": [],
    "fx_rate_samples": [],
    "fx_dlq": ["fx_products"],
    "fx_event_log_large": [],
}


def _closure(names):
    out: list[str] = []

    def visit(n):
        for d in DEPENDS[n]:
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_fixtures(body: str, *extra_ctes: tuple[str, str]) -> str:
    """Prefix ``body`` with the fixture CTEs it mentions (and their inputs),
    then any ``(name, sql)`` CTEs of the query itself."""
    used = [n for n in FX if n in body or any(n in sql for _, sql in extra_ctes)]
    ctes = [(n, FX[n]) for n in _closure(used)] + list(extra_ctes)
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({sql}\n)" for n, sql in ctes) + "\n" + body
