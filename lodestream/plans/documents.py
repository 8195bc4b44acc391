"""Queries over documents, pages and headlines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream import frames
from lodestream.frames import read
from lodestream.functions import columns as C
from lodestream.functions import fixed
from lodestream.operators import qa, stability, text

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_quote(w)})" for w in words) + ")"


def _sum_sql(col: str, words) -> str:
    return "(" + " + ".join(f"contains({col}, {_quote(w)})::INT" for w in words) + ")"


def _list_sql(xs) -> str:
    return "[" + ", ".join(_quote(x) for x in xs) + "]"


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '\.{2,}', ' ', 'g'), '-\s*[ivx0-9]+\s*-', '', 'gi'), '\s+', ' ', 'g'))"
# RE2 has no look-behind: mark the sentence ends first, then split at the marks.
_SENTENCES = rf"""s0 AS (SELECT doc_id, string_split(regexp_replace({_CLEAN}, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
s AS (SELECT doc_id, i AS pos, trim(t) AS text FROM (SELECT doc_id, unnest(p) AS t, CAST(unnest(range(len(p))) AS INTEGER) AS i FROM s0) WHERE length(trim(t)) > 5)"""


@query
def sentence_split(spark, d):
    return text.sentences(read(spark, d, "documents"), "doc_id", "text")


SQL["sentence_split"] = f"WITH {_SENTENCES} SELECT doc_id, pos, text FROM s"


@query
def merge_fragments(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return text.merge_fragments(lines, "doc_id")


SQL["merge_fragments"] = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
m AS (SELECT *, coalesce((right(lag(t) OVER w, 1) IN ('.', '!', '?', '”', '"'))::INT, 0) AS new FROM l WHERE length(t) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS merged_id FROM m)
SELECT doc_id, CAST(merged_id AS BIGINT) AS merged_id, string_agg(t, ' ' ORDER BY pos) AS text FROM i GROUP BY 1, 2"""


@query
def noise_filter(spark, d):
    s = text.sentences(read(spark, d, "documents"), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count(F.when(C.is_noise(F.col("text")), 1)).alias("noise"), F.count(F.when(C.risk_focus(F.col("text")), 1)).alias("risk_focus"))


SQL["noise_filter"] = rf"""WITH {_SENTENCES}, t AS (SELECT doc_id, lower(text) AS t, regexp_replace(lower(text), '\s+', '', 'g') AS q FROM s)
SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE length(t) < 30 OR contains(t, 'http') OR contains(t, 'www.') OR contains(t, 'table of contents') OR len(regexp_extract_all(t, 'restricted')) >= 2
  OR regexp_matches(t, '\b(page|appendix|chapter)\s+\d+\b') OR {_sum_sql('t', fixed.NOISE_PHRASES)} >= 2 OR (regexp_matches(t, '\([a-z]\)\s') AND length(t) - length(replace(t, ';', '')) >= 2)
  OR length(regexp_replace(q, '\D', '', 'g')) / length(q) > 0.35) AS noise,
  count(*) FILTER (WHERE {_any_sql('t', fixed.RISK_HINTS + fixed.RISK_PATTERNS)}) AS risk_focus FROM t GROUP BY doc_id"""


@query
def keyword_tags(spark, d):
    hits = read(spark, d, "documents").select("doc_id", "source", C.present(F.col("text"), fixed.RISK_KEYWORDS).alias("r"), C.present(F.col("text"), fixed.COMPONENT_KEYWORDS).alias("c"))
    return hits.select(
        "doc_id", F.array_join(C.tags_of(F.col("r"), fixed.RISK_KEYWORDS), ",").alias("risk_tags"), F.array_join(C.tags_of(F.col("c"), fixed.COMPONENT_KEYWORDS), ",").alias("component_tags"),
        C.score_of(F.col("r"), fixed.RISK_KEYWORDS).alias("risk_score"), C.score_of(F.col("c"), fixed.COMPONENT_KEYWORDS).alias("component_score"), C.document_weight(F.col("source")).alias("weight"),
    )


def _tags_sql(table) -> str:
    return "array_to_string(list_sort([x FOR x IN [" + ", ".join(f"CASE WHEN {_any_sql('t', w)} THEN {_quote(k)} END" for k, w in table.items()) + "] IF x IS NOT NULL]), ',')"


SQL["keyword_tags"] = f"""SELECT doc_id, {_tags_sql(fixed.RISK_KEYWORDS)} AS risk_tags, {_tags_sql(fixed.COMPONENT_KEYWORDS)} AS component_tags,
  {' + '.join(_sum_sql('t', w) for w in fixed.RISK_KEYWORDS.values())} AS risk_score, {' + '.join(_sum_sql('t', w) for w in fixed.COMPONENT_KEYWORDS.values())} AS component_score, 0 AS weight
FROM (SELECT doc_id, lower(text) AS t FROM documents)"""


@query
def topic_rows(spark, d):
    """First five sentences of each question topic in a document."""
    return qa.topic_rows(text.sentences(read(spark, d, "documents"), "doc_id", "text"), "doc_id")


SQL["topic_rows"] = f"""WITH {_SENTENCES}, m AS (SELECT doc_id, pos, text, unnest([{", ".join(f"CASE WHEN regexp_matches(text, {_quote(p)}, 'i') THEN {_quote(t)} END" for t, p in fixed.TOPIC_PATTERNS.items())}]) AS topic FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY pos) AS rank FROM m WHERE topic IS NOT NULL) SELECT doc_id, topic, CAST(rank AS INTEGER) AS rank, pos, text FROM r WHERE rank <= 5"""


@query
def structured_fields(spark, d):
    """First matching sentence of a document per field, patterns in order."""
    s = text.sentences(read(spark, d, "documents"), "doc_id", "text")
    found = s.select("doc_id", "pos", text.first_field(F.col("text"), [r"\bthe ([a-z]+ [a-z]+)", r"\bof ([a-z ]+),"]).alias("a"), text.first_field(F.col("text"), [r"licensed under ([^.]+)"]).alias("b"))
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    return found.groupBy("doc_id").agg(F.coalesce(pick("a"), F.lit("")).alias("subject"), F.coalesce(pick("b"), F.lit("")).alias("licence"))


def _field_sql(p: str) -> str:
    v = f"trim(regexp_extract(text, '{p}', 1, 'i'), ' .;,:')"
    return f"CASE WHEN length({v}) BETWEEN 3 AND 140 THEN {v} END"


SQL["structured_fields"] = rf"""WITH {_SENTENCES}, f AS (SELECT doc_id, pos, coalesce({_field_sql(r'\bthe ([a-z]+ [a-z]+)')}, {_field_sql(r'\bof ([a-z ]+),')}) AS a, {_field_sql(r'licensed under ([^.]+)')} AS b FROM s)
SELECT doc_id, coalesce(arg_min(a, pos) FILTER (WHERE a IS NOT NULL), '') AS subject, coalesce(arg_min(b, pos) FILTER (WHERE b IS NOT NULL), '') AS licence FROM f GROUP BY doc_id"""


@query
def profile_builder(spark, d):
    return text.profiles(text.sentences(read(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query
def fair_sentence_cap(spark, d):
    """First 20 documents of each source, then the first 250 of all."""
    t = read(spark, d, "documents").filter(F.length("text") > 40).select("source", "doc_id", "n_chars")
    return frames.fair_cap(t, ["source"], 20, 250, F.col("doc_id")).select("source", "rank", "doc_id", "n_chars")


SQL["fair_sentence_cap"] = """WITH f AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE length(text) > 40),
g AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM f WHERE rank <= 20) SELECT source, CAST(rank AS INTEGER) AS rank, doc_id, n_chars FROM g WHERE i <= 250"""


@query
def query_canonicalise(spark, d):
    h = stability.synthetic_headlines(spark, 100, 20).select(F.col("headline").alias("q"))
    b = read(spark, d, "benchmark").select(F.concat(F.lit("Fed Rate Hikes and crude "), "text").alias("q"))
    return h.union(b).select("q", C.canonical_query(F.col("q")).alias("canonical"))


def _canon_sql(col: str) -> str:
    e = f"lower({col})"
    for p, to in fixed.QUERY_REWRITES:
        e = f"regexp_replace({e}, '{p}', '{to}', 'g')"
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def _headlines_sql() -> str:
    rows = ", ".join(f"({i}, {_quote(t[0])}, {_quote(t[1])}, {_list_sql(t[2])}, {_list_sql(t[3])}, {_list_sql(t[4])}, {_list_sql(t[5])})" for i, t in enumerate(fixed.TOPICS))
    fill = f"(SELECT {_list_sql(fixed.PARAPHRASES)})[1 + (v - 1) % {len(fixed.PARAPHRASES)}]"
    for n in ("catalyst", "driver", "region", "theme", "asset"):
        fill = f"replace({fill}, '{{{n}}}', {n})"
    return f"""topics(i, domain, asset, cs, ds, rs, ts) AS (VALUES {rows}),
base AS (SELECT CAST(c AS INTEGER) AS c, domain, asset, cs[1 + (c - 1) % len(cs)] AS catalyst, ds[1 + (c - 1) % len(ds)] AS driver, rs[1 + (c - 1) % len(rs)] AS region, ts[1 + (c - 1) % len(ts)] AS theme
  FROM range(1, 101) x(c) JOIN topics ON i = (c - 1) % {len(fixed.TOPICS)}),
headlines AS (SELECT c AS concept_id, domain, CAST(v AS INTEGER) AS variant_id, region AS region_anchor, theme AS theme_anchor,
  catalyst || ' signals ' || driver || ' for ' || region || ' ' || theme || ' ' || asset AS base_meaning, {fill} AS headline FROM base, range(1, 21) y(v))"""


SQL["query_canonicalise"] = f"""WITH {_headlines_sql()}, q AS (SELECT headline AS q FROM headlines UNION ALL SELECT 'Fed Rate Hikes and crude ' || text FROM benchmark) SELECT q, {_canon_sql('q')} AS canonical FROM q"""


@query
def synthetic_headlines(spark, d):
    """Every benchmark text led in by the headline that its id picks: the concept by its rest, the variant by the quotient."""
    texts = read(spark, d, "benchmark").select("item_id", "text", (F.col("item_id") % 100 + 1).cast("int").alias("concept_id"), (F.floor(F.col("item_id") / 100) % 20 + 1).cast("int").alias("variant_id"))
    j = texts.join(stability.synthetic_headlines(spark), ["concept_id", "variant_id"])
    return j.select("item_id", "concept_id", "domain", "variant_id", "region_anchor", "theme_anchor", "base_meaning", F.concat_ws(" ", "headline", "text").alias("headline"))


SQL["synthetic_headlines"] = f"""WITH {_headlines_sql()} SELECT item_id, concept_id, domain, variant_id, region_anchor, theme_anchor, base_meaning, headline || ' ' || text AS headline
FROM benchmark JOIN headlines ON concept_id = item_id % 100 + 1 AND variant_id = item_id // 100 % 20 + 1"""


@query
def doc_version_dedup(spark, d):
    """Per host the first page of each last path token, by url then id."""
    p = read(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1).alias("stem"))
    return frames.keep_first(p, ["host", "stem"], F.col("url"), F.col("page_id"))


SQL["doc_version_dedup"] = r"""WITH p AS (SELECT page_id, url, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) AS stem FROM pages)
SELECT page_id, url, host, stem FROM (SELECT *, row_number() OVER (PARTITION BY host, stem ORDER BY url, page_id) AS r FROM p) WHERE r = 1"""


@query
def latest_snapshot(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyyMMdd").alias("run"))
    return frames.latest_snapshot(e, "run").select("run", "event_id", "user_id")


SQL["latest_snapshot"] = "WITH e AS (SELECT strftime(ts, '%Y%m%d') AS run, event_id, user_id FROM events) SELECT * FROM e WHERE run = (SELECT max(run) FROM e)"


@query
def headline_extract(spark, d):
    """Distinct decoded titles with their first page."""
    t = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    for a, b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return read(spark, d, "pages").select("page_id", t.alias("title")).filter("title <> ''").groupBy("title").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


SQL["headline_extract"] = r"""WITH t AS (SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages)
SELECT title, min(page_id) AS page_id, count(*) AS pages FROM t WHERE title <> '' GROUP BY title"""


@query
def archive_calendar(spark, d):
    """Every day between the first and last event, with its count: calendar expansion."""
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"))
    days = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return days.join(e.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


SQL["archive_calendar"] = """WITH e AS (SELECT CAST(ts AS DATE) AS day FROM events), d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(e.day) AS n FROM d LEFT JOIN e USING (day) GROUP BY 1"""


@query
def text_cleaning(spark, d):
    """Normal form, first summary sentence and response gate of each document."""
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", C.normalise_text(t).alias("normal"), C.summary_sentence(t).alias("summary"), C.low_quality_response(t).alias("low"), C.language(t).alias("language"))


SQL["text_cleaning"] = r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' .;,:') AS s FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normal,
  CASE WHEN s = '' THEN '' WHEN length(s) > 220 THEN regexp_replace(left(s, 220), ' [^ ]*$', '') || '.' ELSE s || '.' END AS summary,
  length(trim(text)) < 24 OR length(regexp_replace(trim(text), '[\p{L}\p{N} \n]', '', 'g')) / length(trim(text)) > 0.6 AS low,
  CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' ELSE 'en' END AS language FROM t"""
