"""Secret scans over an incremental blob ledger (operator 2, native).

Every historical version of a file is content-addressed by its SHA-256, so the same bytes under many paths and in many
commits are one blob. A ledger remembers which (blob, rule, rule version) were scanned; only unseen pairs are scanned,
and findings are joined back to every path that holds the blob.

Defined results: a null text is the empty blob; repeated rows and equal texts share one blob and all get its findings;
an empty table gives empty tables; columns besides the id and the text are carried through untouched, whatever their
names, inside a struct. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import let, offsets, staged, table


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` must hold ``least`` characters or more. ``version`` changes when the meaning does."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# For runs of one character class a bounded repetition finds the same maximal runs as "+" with a length test after it.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,rule:string>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All leftmost non-overlapping matches of ``rule`` as (start, rank, end, kind, rule).

    ``split`` gives the gaps and ``regexp_extract_all`` the matches of one and the same leftmost scan, so summing their
    lengths gives the offsets without a UDF.
    """
    empty = F.array().cast(SPAN)

    def positions(found: Column) -> Column:
        sizes = F.transform(found, F.length)
        gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), F.lit(1), F.size(found))
        held = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.least else sizes
        starts = F.zip_with(offsets(F.zip_with(gaps, sizes, lambda g, n: g + n)), gaps, lambda at, g: at + g)
        rows = F.arrays_zip(starts.alias("start"), sizes.alias("size"), held.alias("held"))
        good = F.filter(rows, lambda r: r["held"] >= rule.least)
        return F.transform(good, lambda r: F.struct(r["start"].alias("start"), F.lit(rank).alias("rank"), (r["start"] + r["size"]).alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"))).cast(SPAN)

    return F.when(text.rlike(rule.pattern), let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), positions)).otherwise(empty)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text[, seen]) to (blob, scanned, spans): the spans of every rule whose key is not in ``seen``."""
    keys = F.array(*[F.lit(r.key) for r in rules]).cast("array<string>")
    seen = F.coalesce(F.col("seen"), F.array().cast("array<string>")) if "seen" in blobs.columns else F.array().cast("array<string>")
    parts = [F.when(F.array_contains(seen, r.key), F.array().cast(SPAN)).otherwise(spans_of(F.col("text"), r, i)) for i, r in enumerate(rules)]
    return blobs.select("blob", F.array_except(keys, seen).alias("scanned"), F.array_sort(F.concat(*parts)).alias("spans"))


def scan(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None):
    """Scan all versions; returns (paths, findings, ledger).

    ``ledger`` (blob, rule_key) and ``findings`` (blob, spans) are what earlier calls returned. Only blobs that miss a
    rule version are read by a rule. Every span names its rule version; those of a kind that ``rules`` has in another
    version are superseded and drop out of the findings. ``paths`` has a row for every row of ``versions``: id, n_chars,
    blob, spans (of old and new findings), and the struct ``row`` with all its columns.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = versions.select(F.col(id_col).alias("id"), text.alias("text"))
    hashed = named.select("id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("blob"), "text")
    # One text a blob: the partial aggregate drops copies before the exchange, however many a blob has.
    blobs = hashed.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_key").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule_key").alias("seen"))
        blobs = blobs.join(known, "blob", "left").filter(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
    scanned = staged(scan_blobs(blobs, rules), "blobs")
    fresh = scanned.filter(F.size("spans") > 0).select("blob", "spans")
    if findings is not None:
        kinds, keys = [r.kind for r in rules], [r.key for r in rules]
        valid = findings.withColumn("spans", F.filter("spans", lambda s: s["rule"].isin(keys) | ~s["kind"].isin(kinds))).filter(F.size("spans") > 0)
        fresh = fresh.unionByName(valid).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        fresh = staged(fresh, "findings")
    entries = scanned.select("blob", F.explode("scanned").alias("rule_key"))
    entries = entries if ledger is None else ledger.unionByName(entries)
    whole = versions.select(F.struct("*").alias("row"))
    paths = whole.select(
        F.col(f"row.{id_col}").alias("id"),
        F.length(F.coalesce(F.col(f"row.{text_col}"), F.lit(""))).alias("n_chars"),
        F.sha2(F.coalesce(F.col(f"row.{text_col}"), F.lit("")), 256).alias("blob"),
        "row",
    ).join(fresh, "blob", "left")
    return paths.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN))), fresh, entries


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``, with the digest of the base kinds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths, _, _ = scan(docs)
    base = [r.kind for r in BASE_RULES]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return paths.select(
        F.col("id").alias("doc_id"),
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_joined(own), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.col("blob").alias("blob_sha256"),
    )


def _oracle() -> str:
    """The same offsets in DuckDB: gaps and matches of each rule summed up."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        base = "true" if r in BASE_RULES else "false"
        parts.append(
            f"SELECT doc_id, {i} AS o, {q(r.kind)} AS kind, {base} AS base, {r.least} AS least, regexp_extract_all(t, {q(r.pattern)}, 0) AS m, regexp_extract_all(t, {q(r.pattern)}, {r.group}) AS h, string_split_regex(t, {q(r.pattern)}) AS g FROM d WHERE regexp_matches(t, {q(r.pattern)})"
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
u AS (SELECT doc_id, o, kind, base, least, m, h, g, unnest(range(1, len(m) + 1)) AS i FROM f),
p AS (SELECT doc_id, o, kind, base, length(m[i]) AS n, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS s FROM u WHERE length(h[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) FILTER (WHERE base) AS b, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob_sha256
FROM d LEFT JOIN a USING (doc_id)"""


ORACLE = _oracle()
