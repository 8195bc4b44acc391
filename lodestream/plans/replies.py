"""Queries of the batched replies, with their SQL.

The given tables hold no tickers, tags or news: the source of a document is its ticker and its id names its tag; assistant
turns are news of a ticker that their conversation names. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.frames import read
from lodestream.functions import fixed, replies
from lodestream.operators import answers, qa, retrieval
from lodestream.plans.documents import _any_sql, _quote

Q: dict = {}
SQL: dict[str, str] = {}
_TAGS = [*fixed.FEATURE_TAGS, "other"]
_LEAD = "Under the section entitled \"Fees\" the Sub-Fund , TraHK, will pay. "


def query(f):
    Q[f.__name__] = f
    return f


def _records(spark, d):
    tag = F.element_at(F.array(*[F.lit(t) for t in _TAGS]), (F.col("doc_id") % len(_TAGS)).cast("int") + 1)
    return read(spark, d, "documents").select(F.col("source").alias("ticker"), F.col("doc_id").alias("pos"), tag.alias("tag"), F.col("lang").alias("language"), F.concat(F.when(F.col("doc_id") % 4 == 0, _LEAD).otherwise(""), "text").alias("answer"))


_R = f"r AS (SELECT source AS ticker, doc_id AS pos, [{', '.join(map(_quote, _TAGS))}][doc_id % {len(_TAGS)} + 1] AS tag, lang AS language, CASE WHEN doc_id % 4 = 0 THEN {_quote(_LEAD)} ELSE '' END || text AS answer FROM documents)"


def _squeezed_sql(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _cut_sql(t, most, least, ends, more=""):
    head = f"left({t}, {most})"
    sentences = f"rtrim(regexp_extract({head}, '^(.*(?:{ends}))', 1))"
    return f"CASE WHEN length({t}) <= {most} THEN {t} WHEN length({sentences}) > {least + 1} THEN {sentences} ELSE trim(regexp_replace({head}, ' [^ ]*$', '')) || '{more}' END"


def _concise_sql(source, columns, most=420):
    """A subquery with ``short`` beside the columns."""
    split = rf"string_split(regexp_replace(regexp_replace({_squeezed_sql('answer')}, {_quote(fixed.ANSWER_LEAD)}, ''), '([.!?。！？])\s+', '\1' || chr(10), 'g'), chr(10))"
    two = f"trim(array_to_string(list_filter([trim(x) FOR x IN {split}], lambda x: x <> '')[1:2], ' '))"
    return f"(SELECT {columns}, {_cut_sql('two', most, 120, '[.!?] |。')} AS short FROM (SELECT *, {two} AS two FROM {source}))"


def _plain_sql(source, columns, text, most):
    """A subquery with ``told`` beside the columns; ``source`` has zh."""
    t = _squeezed_sql(text)
    for p in fixed.BOILERPLATE:
        t = f"regexp_replace({t}, {_quote(p)}, '', 'gi')"
    en = zh = "t0"
    for a, b in fixed.PLAIN_WORDS:
        en = f"replace({en}, {_quote(a)}, {_quote(b)})"
    for a, b in fixed.PLAIN_WORDS_ZH:
        zh = f"replace({zh}, {_quote(a)}, {_quote(b)})"
    en = rf"regexp_replace({en}, '\s+,', ',', 'g')"
    end = _quote(fixed.PLAIN_END)
    en = f"CASE WHEN contains({en}, {end}) THEN trim(string_split({en}, {end})[1]) ELSE {en} END"
    u = "t1"
    for p, by in ((r'"\s*\d+\.\s*', " "), (r"\(\.\s*$", ""), (r"\s*\(\s*$", ""), (r"\s*-\s*$", ""), (r"\s+", " ")):
        u = f"regexp_replace({u}, {_quote(p)}, '{by}', 'g')"
    u = f"trim({u}, ' ;:,-')"
    inner = f"SELECT *, CASE WHEN zh THEN {zh} ELSE {en} END AS t1 FROM (SELECT *, {t} AS t0 FROM {source})"
    return f"(SELECT {columns}, {_cut_sql('t2', most, 80, '[.] |。', '...')} AS told FROM (SELECT *, {u} AS t2 FROM ({inner})))"


@query
def plain_answers(spark, d):
    """Every document as an answer: shortened, in plain words, and as a fact; those in Spanish stand for Chinese."""
    r = _records(spark, d).select("pos", (F.col("language") == "es").alias("zh"), "answer")
    return r.select("pos", answers.concise(F.col("answer")).alias("short"), answers.plain(F.col("answer"), F.col("zh")).alias("told"), answers.known_fact(F.coalesce("answer", F.lit("")), F.col("zh")).alias("fact"))


def _fact_sql():
    cases = " ".join(f"WHEN NOT zh AND {' AND '.join(f'contains(lower(answer), {_quote(w)})' for w in words)} THEN {_quote(said)}" for words, said in fixed.KNOWN_FACTS)
    return f"CASE {cases} ELSE trim(answer, ' ') END"


SQL["plain_answers"] = f"""WITH {_R}, z AS (SELECT pos, language = 'es' AS zh, coalesce(answer, '') AS answer FROM r)
SELECT pos, short, told, {_fact_sql()} AS fact FROM {_plain_sql(_concise_sql('z', 'pos, zh, answer'), 'pos, answer, zh, short', 'answer', 240)}"""


@query
def fee_lookup(spark, d):
    """The yearly charge of every source: answers about charges first, else all."""
    return answers.fees(_records(spark, d).withColumn("answer", F.when(F.col("pos") % 7 == 0, F.concat("answer", F.lit(" Ongoing charges: "), (F.col("pos") % 90 / 10).cast("string"), F.lit("%"))).otherwise(F.col("answer"))))


SQL["fee_lookup"] = rf"""WITH {_R}, f AS (SELECT ticker, pos, tag, CASE WHEN pos % 7 = 0 THEN answer || ' Ongoing charges: ' || (pos % 90 / 10)::VARCHAR || '%' ELSE answer END AS answer FROM r),
h AS (SELECT ticker, pos, contains(tag, 'fees_charges') OR {_any_sql('lower(coalesce(answer, \'\'))', fixed.FEE_HINTS)} AS hint, list_filter([TRY_CAST(x AS DOUBLE) FOR x IN regexp_extract_all(coalesce(answer, ''), '(\d+(?:\.\d+)?)\s*%', 1)], lambda x: x > 0 AND x <= 5)[1] AS p FROM f)
SELECT ticker, CASE WHEN bool_or(hint) THEN arg_min(p, pos) FILTER (WHERE hint AND p IS NOT NULL) ELSE arg_min(p, pos) FILTER (WHERE p IS NOT NULL) END AS percent FROM h GROUP BY 1"""


@query
def feature_card_replies(spark, d):
    """The card of every source with five tags, in both languages."""
    return answers.feature_cards(_records(spark, d))


def _frame_sql(reply, i):
    return f"CASE WHEN zh THEN {_quote(reply['zh'][i])} ELSE {_quote(reply['en'][i])} END"


_LABELS = " ".join(f"WHEN {_quote(t)} THEN CASE WHEN zh THEN {_quote(zh)} ELSE {_quote(en)} END" for t, (en, zh) in fixed.FEATURE_TAGS.items())
_ORDER = " ".join(f"WHEN {_quote(t)} THEN {i}" for i, t in enumerate(fixed.FEATURE_TAGS))
SQL["feature_card_replies"] = f"""WITH {_R}, s AS (SELECT *, coalesce(CASE WHEN zh THEN language IN ('zh-HK', 'zh', 'en') ELSE language IN ('en', 'zh-HK') END, false) AS ok FROM r, (VALUES (true), (false)) v(zh)),
a AS (SELECT *, bool_or(ok) OVER (PARTITION BY ticker, zh) AS has_ok FROM s),
f AS (SELECT ticker, zh, tag, answer FROM a WHERE (ok OR NOT has_ok) AND tag <> 'other' QUALIFY row_number() OVER (PARTITION BY ticker, zh, tag ORDER BY pos) = 1),
t AS (SELECT ticker, zh, tag, told FROM {_plain_sql(_concise_sql('f', 'ticker, zh, tag'), 'ticker, zh, tag', 'short', 210)} WHERE told <> ''),
b AS (SELECT ticker, zh, string_agg('- ' || CASE tag {_LABELS} END || told, chr(10) ORDER BY CASE tag {_ORDER} END) AS body FROM t GROUP BY 1, 2)
SELECT ticker, zh, replace({_frame_sql(fixed.FEATURE_REPLY, 0)}, '{{}}', ticker) || body || {_frame_sql(fixed.FEATURE_REPLY, 1)} AS reply FROM (SELECT DISTINCT ticker, zh FROM s) LEFT JOIN b USING (ticker, zh)"""


def _turns(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", "role", "text")


_ASKED = "u AS (SELECT conv_id * 1000 + turn AS query_id, conv_id % 2 = 0 AS zh, text FROM conversations WHERE role = 'user')"
_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{4e00}-\x{9fff}]+'))"


@query
def risk_replies(spark, d):
    """Bullets about risks for every whole user turn, by the words it shares with the recorded questions."""
    p = qa.question_pairs(_turns(spark, d)).select((F.col("conv_id") * 1000 + F.col("pos")).alias("item"), "question", "answer", F.when(F.col("conv_id") % 3 > 0, "key_risks").otherwise("fees").alias("tag"))
    asked = _turns(spark, d).filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("conv_id") % 2 == 0).alias("zh"), "text")
    scored = retrieval.lexical(asked, p.select("item", F.col("question").alias("text")), 8).withColumnRenamed("overlap", "score").drop("rank")
    return answers.risk_replies(scored.join(p, "item").join(asked.select("query_id", "zh"), "query_id"))


SQL["risk_replies"] = rf"""WITH {_ASKED}, p AS (SELECT u.conv_id * 1000 + u.turn AS item, u.text AS question, a.text AS answer, CASE WHEN u.conv_id % 3 > 0 THEN 'key_risks' ELSE 'fees' END AS tag
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
q AS (SELECT query_id, zh, {_WORDS} AS qt FROM u), k AS (SELECT item, unnest({_WORDS}) AS t FROM (SELECT item, question AS text FROM p)),
h AS (SELECT query_id, zh, item, count(*) / any_value(n) AS score FROM (SELECT query_id, zh, len(qt) AS n, unnest(qt) AS t FROM q) JOIN k USING (t) GROUP BY 1, 2, 3),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS i FROM h QUALIFY i <= 8),
s AS (SELECT query_id, zh, i, answer FROM e JOIN p USING (item) WHERE score >= 0.30 AND (contains(tag, 'risk') OR {_any_sql('lower(question)', fixed.LOOKUP_WORDS['risk'])})),
c AS (SELECT query_id, zh, i, short FROM {_concise_sql('s', 'query_id, zh, i')} WHERE NOT {_any_sql('lower(short)', fixed.LEGAL_FRAGMENTS)}),
t AS (SELECT query_id, zh, i, told FROM {_plain_sql('c', 'query_id, zh, i', 'short', 220)} WHERE told <> ''),
o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, trim(regexp_replace(regexp_replace(lower(told), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) ORDER BY i) = 1),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 3)
SELECT query_id, {_frame_sql(fixed.RISK_REPLY, 0)} || string_agg('- ' || told, chr(10) ORDER BY i) || {_frame_sql(fixed.RISK_REPLY, 1)} AS reply FROM b GROUP BY query_id, zh"""


@query
def discovery_replies(spark, d):
    """Related tickers for every whole user turn, from the assistant turns as news."""
    asked = _turns(spark, d).filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("conv_id") % 2 == 0).alias("zh"), "text")
    news = _turns(spark, d).filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), F.lpad((F.col("conv_id") % 25).cast("string"), 4, "0").alias("ticker"), "text", (F.col("conv_id") % 11 / 10).alias("score"), F.concat(F.lit("turn "), "turn").alias("event"))
    found = answers.discovered(asked, news.select("item", "ticker", "text", "score"))
    return answers.discovery_replies(asked, found, news.select("item", F.col("text").alias("headline"), "event"))


def _line_sql(language):
    line = _quote(fixed.DISCOVERY_REPLY[language][1])
    for a, b in (("{i}", "rank::VARCHAR"), ("{t}", "ticker"), ("{e}", "e"), ("{h}", "h")):
        line = f"replace({line}, '{a}', {b})"
    return line


SQL["discovery_replies"] = rf"""WITH {_ASKED}, n AS (SELECT conv_id * 1000 + turn AS item, lpad((conv_id % 25)::VARCHAR, 4, '0') AS ticker, text, (conv_id % 11) / 10 AS own, 'turn ' || turn AS e, coalesce(nullif(left(text, 160), ''), 'N/A') AS h FROM conversations WHERE role = 'assistant'),
q AS (SELECT query_id, {_WORDS} AS qt FROM u), w AS (SELECT item, ticker, own, {_WORDS} AS nt FROM n),
o AS (SELECT query_id, item, count(*) / any_value(c) AS overlap FROM (SELECT query_id, len(qt) AS c, unnest(qt) AS t FROM q) JOIN (SELECT item, unnest(nt) AS t FROM w) USING (t) GROUP BY 1, 2),
s AS (SELECT q.query_id, w.item, w.ticker, own, CASE WHEN len(nt) > 0 THEN round(0.65::DOUBLE * coalesce(overlap, 0) + 0.35::DOUBLE * own, 9) ELSE 0 END AS score FROM q JOIN w ON len(qt) > 0 LEFT JOIN o ON o.query_id = q.query_id AND o.item = w.item),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, ticker ORDER BY score DESC, own DESC, item) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, own DESC, ticker) AS rank FROM b QUALIFY rank <= 3),
l AS (SELECT query_id, string_agg({_line_sql('en')}, chr(10) ORDER BY rank) AS en, string_agg({_line_sql('zh')}, chr(10) ORDER BY rank) AS zhs FROM (SELECT query_id, rank, r.ticker, e, h FROM r JOIN n USING (item)) GROUP BY 1)
SELECT query_id, CASE WHEN en IS NULL THEN CASE WHEN zh THEN {_quote(fixed.NO_DISCOVERY['zh'])} ELSE {_quote(fixed.NO_DISCOVERY['en'])} END
  ELSE {_frame_sql(fixed.DISCOVERY_REPLY, 0)} || CASE WHEN zh THEN zhs ELSE en END || {_frame_sql(fixed.DISCOVERY_REPLY, 2)} END AS reply FROM u LEFT JOIN l USING (query_id)"""


_CLAIMS = ["", "There is no ETF with the ticker 2800. ", "Please confirm if 2800 is the correct ticker.\nMaybe the ticker is incorrect\n", "這並不是一個現有的ETF。", "Local data is currently insufficient to say. ", "It isn't an ETF, the ticker is not listed.\n"]
_ENDS = ["", " Would you like more details about", " (key "]


@query
def reply_guard(spark, d):
    """Every whole assistant turn with claims before and a cut end after it, corrected for the codes that are known."""
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(by) % len(xs)).cast("int") + 1)
    t = _turns(spark, d).filter("role = 'assistant'").select("conv_id", "turn", F.concat(pick(_CLAIMS, "conv_id"), "text", pick(_ENDS, "turn")).alias("text"), F.lpad((F.col("conv_id") % 50).cast("string"), 4, "0").alias("code"))
    return t.select("conv_id", "turn", replies.clean_reply(F.col("text"), F.col("code"), F.col("conv_id") % 5 > 0, F.col("conv_id") % 7 > 0).alias("reply"))


def _stripped_sql(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _without_sql(x, patterns):
    for p in patterns:
        x = _stripped_sql(f"regexp_replace({x}, {_quote('(?i)' + p)}, '', 'g')")
    return x


_ASKED_CODE = "conv_id % 5 > 0"
_LINES = f"[{_stripped_sql('x')} FOR x IN string_split(c, chr(10))]"
SQL["reply_guard"] = f"""WITH t AS (SELECT conv_id, turn, {_stripped_sql(f"[{', '.join(map(_quote, _CLAIMS))}][conv_id % {len(_CLAIMS)} + 1] || text || [{', '.join(map(_quote, _ENDS))}][turn % {len(_ENDS)} + 1]")} AS text, lpad((conv_id % 50)::VARCHAR, 4, '0') AS code FROM conversations WHERE role = 'assistant'),
a AS (SELECT *, {_without_sql('text', fixed.CUT_TAILS[1:])} AS t FROM t), b AS (SELECT *, {_without_sql('t', fixed.CLAIM_SENTENCES)} AS c FROM a),
e AS (SELECT *, array_to_string(list_filter({_LINES}, lambda x: x <> '' AND NOT (contains(lower(x), '{fixed.CLAIM_LINE}') AND {_any_sql('lower(x)', fixed.CLAIM_LINE_WORDS)})), chr(10)) AS rest FROM b),
f AS (SELECT *, CASE WHEN NOT ({_ASKED_CODE}) THEN text WHEN {_any_sql('lower(t)', fixed.INVALID_CLAIMS)} THEN 'Using ticker `' || code || '` as the active ETF context.' || chr(10) || chr(10) || CASE WHEN rest = '' THEN 'I can continue with risk, benchmark, fee, and alternatives for this ETF.' ELSE rest END ELSE t END AS r FROM e),
g AS (SELECT *, {_stripped_sql('r')} AS s FROM f), h AS (SELECT *, CASE WHEN conv_id % 7 > 0 THEN {_without_sql('s', fixed.INSUFFICIENT)} ELSE s END AS k FROM g)
SELECT conv_id, turn, CASE WHEN {_ASKED_CODE} THEN {_without_sql('k', fixed.CUT_TAILS)} ELSE s END AS reply FROM h"""
