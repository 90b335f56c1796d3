"""Secret scan with corpus-wide ownership frequency (SQL functions only).

Base spans come from three patterns. A fourth kind, ``generic``, proposes long
tokens that mix letters and digits. The hash of every candidate's value is
aggregated over the corpus by distinct repositories and owners: a value in the
hands of few owners looks live, one that many owners hold is a copied example.
Generic candidates become spans only where they look live, unless base spans
cover them; base spans always stay and carry the verdict as counts.

An owner is a value of ``source``; a repository is an owner's language section
(``source`` and ``lang``). Nulls count as one owner or language of their own.

Positions are code points, end exclusive. Spans are found by cutting the text
at its matches (``split``) and adding up the lengths of pieces and matches: running
sums are taken in blocks of ``BLOCK`` matches, then over the blocks, so that the cost of a text
grows with its matches, however many it has.

Defined results: null text counts as empty and has no spans. Rows that repeat an
id with the same text get the same spans; with other text their own. Repeated
rows count once for ownership. Extra or clashing columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The contract's patterns. A run of fewer than 16 hex digits, or an
# access key of fewer than 18 characters, never hides a longer one, so the least
# length is in the pattern; an assignment may, so its length is checked after.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Long tokens with upper and lower case letters and digits.
GENERIC = r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "generic")
MIN_VALUE = 12
# A value that more owners, or more repositories, hold is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4

_SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"
BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """An array that is not empty, cut into arrays of BLOCK, by way of larger ones
    (each slice reads its whole array)."""
    def cut(of, size):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / size).cast("int")), lambda b: F.slice(of, b * size + 1, F.lit(size)))

    return F.flatten(F.transform(cut(items, BLOCK * 64), lambda x: cut(x, BLOCK)))


def _running(values: Column, combine, zero: int) -> Column:
    """``combine`` of all entries before each one, of an array of ints that is not empty."""
    def scan(items, of):
        start = F.array(F.lit(zero))
        return F.aggregate(items, start, lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), of(x)))))

    def joined(local):
        before = F.slice(scan(local, lambda x: F.element_at(x, -1)), F.lit(1), F.size(local))
        return F.flatten(F.zip_with(local, before, lambda x, c: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: combine(c, y))))

    return _let(F.transform(_blocks(values), lambda b: scan(b, lambda x: x)), joined)


def _matches(text: Column, pattern: str, rank: int, value: Column | None = None, least: int = 0) -> Column:
    """Spans of all matches as (start, rank, stop, value), in order of start."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value is None else value
    parts = F.zip_with(F.arrays_zip(found.alias("m"), values.alias("v")), F.split(text, pattern, -1), lambda z, p: F.struct(
        F.length(p).alias("gap"), F.length(z["m"]).alias("size"), z["v"].alias("value")))
    parts = F.filter(parts, lambda x: x["size"].isNotNull())  # the piece after the last match

    def spans(x):
        before = _running(F.transform(x, lambda y: y["gap"] + y["size"]), lambda a, b: a + b, 0)
        return F.zip_with(x, before, lambda y, at: F.struct(
            (at + y["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + y["gap"] + y["size"]).alias("stop"), y["value"].alias("value")))

    out = _let(parts, spans)
    if least:
        out = F.filter(out, lambda x: F.length(x["value"]) >= least)
    # a plain search first: most texts have no match and need no arrays
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(_SPAN))


def _free(generic: Column, base: Column) -> Column:
    """The generic spans that no base span overlaps, by two scans in order of start:
    the furthest stop of the base spans before, the next start of those after."""
    far = (1 << 31) - 1

    def judge(spans):
        is_base = lambda x: x["rank"] < 3
        stops = _running(F.transform(spans, lambda x: F.when(is_base(x), x["stop"]).otherwise(0)), F.greatest, 0)
        nexts = _running(F.transform(F.reverse(spans), lambda x: F.when(is_base(x), x["start"]).otherwise(far)), F.least, far)
        around = F.arrays_zip(spans.alias("span"), stops.alias("before"), F.reverse(nexts).alias("after"))
        kept = F.filter(around, lambda x: ~is_base(x["span"]) & (x["before"] <= x["span"]["start"]) & (x["after"] >= x["span"]["stop"]))
        return F.transform(kept, lambda x: x["span"])

    return _let(F.array_sort(F.concat(base, generic)), judge)


def _text_of(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang, source): doc_id, text_key and
    two span arrays, ``base`` and ``spans`` (base and live generic ones, ordered),
    each span with start, rank (of KINDS), stop and value, and how many base
    values look live or widely copied."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign_values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    rows = docs.select(
        "doc_id", F.xxhash64("doc_id", text).alias("text_key"),
        F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("owner"),
        F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("section"),
        _matches(text, ASSIGN, 0, assign_values, MIN_VALUE).alias("assign"),
        _matches(text, ACCESS, 1).alias("access"), _matches(text, HEX, 2).alias("hex"),
        _matches(text, GENERIC, 3).alias("generic"))
    base = F.array_sort(F.concat("assign", "access", "hex"))  # by start, then rank
    rows = rows.select("doc_id", "text_key", "owner", "section", base.alias("base"), "generic")
    # a generic candidate inside or across a base span adds nothing
    both = (F.size("generic") > 0) & (F.size("base") > 0)
    free = F.when(both, _free(F.col("generic"), F.col("base"))).otherwise(F.col("generic"))
    rows = written(rows.withColumn("generic", free), "secrets")

    has = rows.filter((F.size("base") > 0) | (F.size("generic") > 0))
    one = has.select("doc_id", "text_key", "owner", "section", F.explode(F.concat("base", "generic")).alias("span"))
    one = one.select("*", F.sha2(F.col("span.value"), 256).alias("hash"))
    # partial aggregates all the way: a value in a third of the rows shrinks before each shuffle
    held = one.groupBy("hash", "owner", "section").agg(F.lit(1).alias("x"))
    held = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("sections"))
    held = held.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("sections").alias("repositories"))
    live = held.select("hash", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live"))
    judged = one.select("doc_id", "text_key", "span", "hash").distinct().join(live, "hash")
    is_base = F.col("span.rank") < 3
    by_doc = judged.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.when(~is_base & F.col("live"), F.col("span"))).alias("added"),
        F.count(F.when(is_base & F.col("live"), 1)).alias("n_live"),
        F.count(F.when(is_base & ~F.col("live"), 1)).alias("n_copied"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    spans = F.when(F.size("added") > 0, F.array_sort(F.concat("base", "added"))).otherwise(F.col("base"))
    return out.select("doc_id", "text_key", "base", spans.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
                      F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_live and n_copied."""
    found = scan_secrets(docs)
    count = [F.size(F.expr(f"filter(base, s -> s.rank = {r})")).cast("long").alias(f"n_{KINDS[r]}") for r in range(3)]
    return found.select("doc_id", *count, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
                        _text_of(F.col("spans")).alias("spans"), "n_live", "n_copied")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones merged) replaced by ``mark``
    and n_chars counted anew where the text changed; no row is dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = scan_secrets(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    spans = spans.groupBy("_id", "_key").agg(F.any_value("spans").alias("_spans"))  # repeated rows
    keyed = docs.withColumn("_text_key", F.xxhash64("doc_id", text))
    out = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")

    def pieces(spans):
        """What stays before each of some spans, and the mark; a span that begins inside another only extends it."""
        back = _running(F.transform(spans, lambda s: s["stop"]), F.greatest, 0)
        return F.zip_with(spans, back, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), F.greatest(at, s["stop"]).alias("stop")))

    def rebuilt(cuts):
        """The text from the cuts; each block of them reads its own part of the text."""
        def block(b):
            first, last = F.element_at(b, 1)["at"], F.element_at(b, -1)["stop"]
            part = lambda own: F.array_join(F.transform(b, lambda c: F.when(c["start"] >= c["at"], F.concat(
                F.substring(own, c["at"] - first + 1, c["start"] - c["at"]), F.lit(mark))).otherwise(F.lit(""))), "")
            return _let(F.substring(F.col("text"), first + 1, last - first), part)

        rest = F.substring(F.col("text"), F.element_at(cuts, -1)["stop"] + 1, F.length("text"))
        return F.concat(F.array_join(F.transform(_blocks(cuts), block), ""), rest)

    done = _let(pieces(F.col("_spans")), rebuilt)
    clean = F.when(F.col("_spans").isNotNull(), done).otherwise(F.col("text"))
    out = out.withColumn("_clean", clean)
    change = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        change["n_chars"] = F.when(F.col("_spans").isNotNull(), F.length("_clean").cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[change[c].alias(c) if c in change else F.col(c) for c in docs.columns])
