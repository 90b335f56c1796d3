"""Read side over the document state: search, BM25 relevance, facets, paging.

Tokens are maximal runs of letters and digits, lower-cased. Text fields match
by token; keyword fields (sku, brand, tags) match the whole query string
exactly. Everything is computed in Spark from the documents themselves
(term frequencies, document frequencies, average lengths); only the query's
own terms (bounded by the query text) are broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75  # BM25 parameters (common defaults)


def tokens(col):
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), 0)


def _query_terms(spark: SparkSession, q: str) -> DataFrame:
    """The query's distinct terms as a tiny DataFrame (tokenised by Spark)."""
    # built in the JVM (a local one-row relation), not from a Python list: the
    # plan then needs no Python worker
    return (spark.range(0, 1, 1, 1).select(F.lit(q).alias("q"))
            .select(F.explode(F.array_distinct(tokens(F.col("q")))).alias("term")))


def text_fields(docs: DataFrame) -> DataFrame:
    """(id, field, text) rows of the searchable text fields of product documents."""
    attrs = F.try_parse_json(F.col("attributes"))
    return docs.select("id", F.explode(F.array(
        F.struct(F.lit("name").alias("field"), F.col("name").alias("text")),
        F.struct(F.lit("description").alias("field"),
                 F.try_variant_get(attrs, "$.description", "string").alias("text")),
    )).alias("f")).select("id", "f.field", "f.text")


def filter_id_or_category(docs: DataFrame, q: str = "", category: str | None = None) -> DataFrame:
    """``^\\d+$`` query -> exact id; category -> exact filter; both AND-ed;
    none -> everything. The decision is made on the argument, not per row."""
    out = docs
    qq = (q or "").strip()
    if qq and re.fullmatch(r"\d+", qq):
        out = out.where(F.col("id") == int(qq))
    if category:
        out = out.where(F.col("category") == category)
    return out


def search_docs(spark: SparkSession, docs: DataFrame, q: str = "", category: str | None = None) -> DataFrame:
    """Matching documents (any query token in a text field, or the whole query
    equal to a keyword field), with the exact total as a column."""
    qq = (q or "").strip()
    if not qq or re.fullmatch(r"\d+", qq):
        hits = filter_id_or_category(docs, qq, category)
    else:
        terms = F.broadcast(_query_terms(spark, qq))
        tf = text_fields(docs).select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        by_text = tf.join(terms, "term", "left_semi").select("id")
        attrs = F.try_parse_json(F.col("attributes"))
        tags = F.try_variant_get(attrs, "$.tags", "array<string>")
        by_kw = docs.where((F.col("sku") == qq)
                           | (F.try_variant_get(attrs, "$.brand", "string") == qq)
                           | F.coalesce(F.array_contains(tags, F.lit(qq)), F.lit(False))).select("id")
        ids = by_text.unionByName(by_kw).distinct()
        hits = docs.join(ids, "id", "left_semi")
        if category:
            hits = hits.where(F.col("category") == category)
    total = hits.agg(F.count(F.lit(1))).scalar()
    return hits.withColumn("total", total)


def bm25(spark: SparkSession, fields: DataFrame, q: str, boosts: dict[str, float] | None = None,
         key: str = "id") -> DataFrame:
    """BM25 score per document: per field, sum over query terms of
    ``idf * tf*(k1+1) / (tf + k1*(1-b+b*dl/avgdl))`` with
    ``idf = ln(1 + (N-df+0.5)/(df+0.5))``; document score = max over fields of
    boost*field score. ``fields`` holds (key, field, text) rows.

    Term frequencies are computed only for the query's terms (a broadcast
    semi join right after tokenising), so the shuffle carries matches, not the
    corpus; N, df and avgdl are partial aggregates."""
    boosts = boosts or {}
    terms = F.broadcast(_query_terms(spark, q))
    toks = fields.where(F.col("text").isNotNull()).select(key, "field", tokens(F.col("text")).alias("toks"))
    stats = toks.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.avg(F.size("toks")).alias("avgdl"))
    hits = (toks.select(key, "field", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
            .join(terms, "term", "left_semi")
            .groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))
    df_ = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # df_ has at most (query terms x fields) rows; AQE sees that at runtime and
    # broadcasts it, reading the hits shuffle locally, so a term found in a
    # third of the corpus is not one partition. A broadcast hint here would
    # plan a second, column-pruned tokenisation of the corpus for df_.
    s = hits.join(df_, ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = idf * F.col("tf") * (K1 + 1) / norm
    boost = F.lit(1.0)
    for f, b in boosts.items():
        boost = F.when(F.col("field") == f, F.lit(float(b))).otherwise(boost)
    per_field = s.groupBy(key, "field").agg(F.sum(part).alias("fs")).withColumn("fs", F.col("fs") * boost)
    return per_field.groupBy(key).agg(F.round(F.max("fs"), 6).alias("score"))


def search_scored(spark: SparkSession, docs: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Products ranked by relevance: name (boost 2) and description by BM25;
    ties by id; top ``limit`` (the page)."""
    scores = bm25(spark, text_fields(docs), q, {"name": 2.0})
    return scores.orderBy(F.col("score").desc(), F.col("id").asc()).limit(limit)


TEXT_FIELDS = {"name": "name", "description": "$.description"}  # searched by token
KEYWORD_FIELDS = {"sku": "sku", "brand": "$.brand", "tags": "$.tags"}  # searched by the whole query
BOOSTS = {"name": 2.0}


def _fields(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_f``: the tokens of each text field and the values of each
    keyword field, null where a document lacks the field. JSON is parsed once a row."""
    attrs = F.col("_attrs")

    def value(path: str, kind: str):
        return F.try_variant_get(attrs, path, kind) if path.startswith("$") else F.col(path)

    text = [tokens(value(path, "string")).alias(f) for f, path in TEXT_FIELDS.items()]
    words = [(F.try_variant_get(attrs, path, "array<string>") if f == "tags" else
              F.when(value(path, "string").isNotNull(), F.array(value(path, "string")))).alias(f) for f, path in KEYWORD_FIELDS.items()]
    rows = docs.withColumn("_attrs", F.try_parse_json(F.col("attributes")))
    return rows.withColumn("_f", F.struct(*text, *words)).drop("_attrs")


def search_page(spark: SparkSession, docs: DataFrame, q: str = "", category: str | None = None, page: int = 1, size: int = 25) -> DataFrame:
    """One page of a search: (id, score, total), ``from = (max(1, page) - 1) * size``.

    A number is an exact id; other text is looked for in all five fields, by token
    in name (boost 2) and description and as a whole in sku, brand and tags. Hits
    rank by their best field's BM25 (a keyword field has no length to weigh, so its
    score is the idf), ties by id. Without a text query the page is sorted
    ``updated_at desc, id asc`` and the score is null. The category is an exact
    filter on the hits; document frequencies and lengths are those of all documents.

    Two scans and no shuffle of documents: one row of statistics (documents with
    a field, tokens, frequencies of the query's terms, hits) is a scalar subquery
    of the scan that scores, which keeps ``from + size`` rows a task."""
    qq = (q or "").strip()
    start = (max(1, page) - 1) * size
    in_category = F.col("category") == category if category else F.lit(True)
    if not qq or re.fullmatch(r"\d+", qq):
        hits = filter_id_or_category(docs, qq, category)
        total = hits.agg(F.count(F.lit(1))).scalar()
        rows = hits.orderBy(F.col("updated_at").desc(), F.col("id").asc()).offset(start).limit(size)
        return rows.select("id", F.lit(None).cast("double").alias("score"), total.alias("total"))
    terms = [r["term"] for r in _query_terms(spark, qq).collect()]  # of the query's own text
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    rows = _fields(docs)
    sought = {f: terms for f in TEXT_FIELDS} | {f: [qq] for f in KEYWORD_FIELDS}

    def held(f: str, t: str):
        return F.coalesce(F.array_contains(F.col(f"_f.{f}"), F.lit(t)), F.lit(False))

    any_text = [F.coalesce(F.arrays_overlap(F.col(f"_f.{f}"), wanted), F.lit(False)) for f in TEXT_FIELDS]
    hit = F.lit(False)
    for x in [*any_text, *[held(f, qq) for f in KEYWORD_FIELDS]]:
        hit = hit | x
    figures = [F.count_if(hit & in_category).alias("total")]
    for f, ts in sought.items():
        figures += [F.count(F.col(f"_f.{f}")).alias(f"n_{f}"), F.avg(F.size(f"_f.{f}")).alias(f"len_{f}")]
        figures += [F.count_if(held(f, t)).alias(f"df_{f}_{i}") for i, t in enumerate(ts)]
    stats = rows.agg(*figures)
    stats = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("s")).scalar()
    found = rows.where(hit & in_category).withColumn("_s", stats)

    def part(f: str, i: int, t: str):
        df, n = F.col(f"_s.df_{f}_{i}"), F.col(f"_s.n_{f}")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        tf = F.size(F.filter(f"_f.{f}", lambda x: x == F.lit(t))) if f in TEXT_FIELDS else F.lit(1)
        norm = 1 - B + B * F.size(f"_f.{f}") / F.col(f"_s.len_{f}") if f in TEXT_FIELDS else F.lit(1.0)
        return F.when(held(f, t), idf * tf * (K1 + 1) / (tf + K1 * norm)).otherwise(0.0)

    best = []
    for f, ts in sought.items():
        total_part = F.lit(0.0)
        for i, t in enumerate(ts):
            total_part = total_part + part(f, i, t)
        best.append(total_part * BOOSTS.get(f, 1.0))
    scored = found.select("id", F.round(F.greatest(*best), 6).alias("score"), F.col("_s.total").alias("total"))
    return scored.orderBy(F.col("score").desc(), F.col("id").asc()).offset(start).limit(size)


def facet_counts(docs: DataFrame, field: str = "category", top: int = 50) -> DataFrame:
    """Documents per value, top ``top`` by count (ties by value)."""
    return (docs.groupBy(F.col(field).alias("key")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("key").asc()).limit(top))


def browse_page(docs: DataFrame, page: int = 1, size: int = 25) -> DataFrame:
    """One page sorted ``updated_at desc, id asc`` with the exact total;
    from = (max(1, page) - 1) * size. Deep pages should use ``browse_deep``."""
    start = (max(1, page) - 1) * size
    total = docs.agg(F.count(F.lit(1))).scalar()
    return (docs.orderBy(F.col("updated_at").desc(), F.col("id").asc())
            .offset(start).limit(size).withColumn("total", total))


BINS = 1024          # ranges a histogram divides a key into; their counts reach the driver
SORTED_AT_ONCE = 1 << 16  # rows that a page may be sorted out of


def _micros(col):
    return F.unix_micros(col.cast("timestamp"))


def _histogram(rows: DataFrame, key, lo: int, hi: int) -> tuple[int, list[tuple[int, int]]]:
    """(width, [(bin, rows)]) of a long key over [lo, hi], at most BINS bins."""
    width = -(-(hi - lo + 1) // BINS)
    got = rows.groupBy(F.floor((key - F.lit(lo)) / F.lit(width)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    return width, sorted((r["bin"], r["n"]) for r in got)


def _pieces(rows: DataFrame, key, within, lo: int, hi: int, start: int, end: int, descending: bool, most: int, before: int = 0) -> list[tuple[int, int, int, int]]:
    """Key ranges that hold the ranks [start, end): (lo, hi, rows, rows ranked before),
    in order. A range that a histogram leaves with over ``most`` rows is divided again
    by one of its own, until it has fewer or is a single value."""
    width, bins = _histogram(rows.where(within(lo, hi)), key, lo, hi)
    out: list[tuple[int, int, int, int]] = []
    for b, n in (reversed(bins) if descending else bins):
        a, z = lo + b * width, min(hi, lo + (b + 1) * width - 1)
        if before < end and before + n > start:
            parts = [(a, z, n, before)] if n <= most or a == z else _pieces(rows, key, within, a, z, start, end, descending, most, before)
            for p in parts:
                if out and out[-1][2] + p[2] <= most:  # neighbours that are small together are one
                    q = out.pop()
                    p = (min(p[0], q[0]), max(p[1], q[1]), p[2] + q[2], q[3])
                out.append(p)
        before += n
    return out


def browse_deep(docs: DataFrame, page: int = 1, size: int = 25, most: int = SORTED_AT_ONCE) -> DataFrame:
    """The page that ``browse_page`` gives, without sorting what comes before it.

    A histogram of ``updated_at`` finds the time range that holds the page's ranks,
    and only its rows are sorted. Where one instant holds more than ``most`` rows,
    a histogram of their ids (unique longs) finds the range within it. Each histogram
    is one scan of one column with partial counts; the driver sees at most ``BINS``
    counts. Rows without a time come last, by id."""
    start = (max(1, page) - 1) * size
    t, k = F.col("updated_at"), F.col("id")
    total, timed, lo, hi = docs.agg(F.count(F.lit(1)), F.count(t), F.min(_micros(t)), F.max(_micros(t))).first()
    end = min(start + size, total)

    def at_times(a: int, z: int):  # literal bounds of the column's own type reach the scan
        kind = docs.schema["updated_at"].dataType
        return t.between(F.timestamp_micros(F.lit(a)).cast(kind), F.timestamp_micros(F.lit(z)).cast(kind))

    def cut(rows: DataFrame, piece, a: int, z: int, *order) -> DataFrame:
        return rows.orderBy(*order).offset(max(a - piece[3], 0)).limit(min(z - piece[3], piece[2]) - max(a - piece[3], 0))

    def by_id(rows: DataFrame, a: int, z: int) -> list[DataFrame]:
        """Ranks [a, z) of rows of one instant, in order of id."""
        first, last = rows.agg(F.min(k), F.max(k)).first()
        found = _pieces(rows, k, lambda x, y: k.between(x, y), first, last, a, z, False, most)
        return [cut(rows.where(k.between(p[0], p[1])), p, a, z, k.asc()) for p in found]

    parts = []
    if start < min(end, timed):
        stop = min(end, timed)
        for p in _pieces(docs, _micros(t), at_times, lo, hi, start, stop, True, most):
            rows = docs.where(at_times(p[0], p[1]))
            if p[2] > most:  # one instant
                parts += by_id(rows, max(start - p[3], 0), min(stop - p[3], p[2]))
            else:
                parts.append(cut(rows, p, start, stop, t.desc(), k.asc()))
    if end > max(start, timed):
        parts += by_id(docs.where(t.isNull()), max(start - timed, 0), end - timed)
    if not parts:
        parts.append(docs.limit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("total", F.lit(total).cast("long"))


def random_sample(docs: DataFrame, n: int, seed: int = 42, live_only: bool = True) -> DataFrame:
    """n pseudo-random live rows, reproducible: ordered by md5(id || seed)."""
    d = docs.where(F.col("deleted_at").isNull()) if live_only else docs
    h = F.md5(F.concat(F.col("id").cast("string"), F.lit(str(seed))))
    return d.withColumn("sample_key", h).orderBy("sample_key").limit(n).drop("sample_key")
