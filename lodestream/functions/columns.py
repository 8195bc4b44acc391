"""Column functions: identifiers, numbers, text, intents, scores. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions import fixed


def clean_numeric(c: Column) -> Column:
    """Drop everything but digits, point and minus, then cast; what does not parse is null."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def digits_code(c: Column, width: int = 4) -> Column:
    """Digits as a number without leading zeros, padded to ``width``; text without digits in upper case; else ""."""
    text = F.trim(c.cast("string"))
    digits = F.regexp_replace(text, r"\D", "").try_cast("bigint").cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.when(text.isNull() | F.lower(text).isin("", "nan", "none"), "").otherwise(F.coalesce(padded, F.upper(text)))


def raw_code(c: Column) -> Column:
    """Digits as they stand, padded to four: does not strip zeros."""
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def exchange_symbol(c: Column) -> Column:
    return F.concat(raw_code(c), F.lit(".HK"))


def file_token(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Za-z0-9]", "")


def normalise_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def clean_segment(c: Column) -> Column:
    t = F.regexp_replace(c, r"\.{2,}", " ")
    t = F.regexp_replace(t, r"(?i)-\s*[ivx0-9]+\s*-", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens; a run of Chinese characters is one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9一-鿿]+)"), F.lit(1)))


def language(c: Column) -> Column:
    return F.when(c.rlike(r"[一-鿿]"), "zh").otherwise("en")


def contains_any(c: Column, words) -> Column:
    """Substrings, not words."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def count_any(c: Column, words) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])


def intent(c: Column) -> Column:
    has = {k: contains_any(c, v) for k, v in fixed.INTENTS.items()}
    return (
        F.when(has["related"], "model1_related").when(has["news"], "model2_discovery").when(has["feature"], "etf_features")
        .when(has["fee"] | has["dividend"] | has["tracking"], "factual").when(has["risk"], "risk_explain").otherwise("general")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(c: Column, table: dict) -> Column:
    """The keywords of a table that occur in the text, each looked for once."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(w for ws in table.values() for w in ws)])
    return let(F.lower(c), lambda t: F.filter(words, lambda w: t.contains(w)))


def tags_of(hits: Column, table: dict) -> Column:
    """Sorted names of the table's entries of which a keyword is among ``hits``."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.arrays_overlap(hits, F.array(*[F.lit(w) for w in ws])), name) for name, ws in table.items()])))


def score_of(hits: Column, table: dict) -> Column:
    """Number of keywords among ``hits``; one that stands in two families counts twice."""
    return reduce(lambda a, b: a + b, [F.size(F.array_intersect(hits, F.array(*[F.lit(w) for w in ws]))) for ws in table.values()])


def matching(c: Column, table: dict) -> Column:
    return let(present(c, table), lambda hits: tags_of(hits, table))


def keyword_score(c: Column, table: dict) -> Column:
    return let(present(c, table), lambda hits: score_of(hits, table))


def asset_bucket(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return (
        F.when(t.contains("equity"), "Equity").when(t.contains("commodity"), "Commodity")
        .when(t.contains("fixed income") | t.contains("bond") | t.contains("money market"), "Fixed Income").otherwise("Other")
    )


def is_fund_category(c: Column) -> Column:
    return F.coalesce(contains_any(c, ["etf", "exchange traded fund"]), F.lit(False))


def point_label(name: Column, geo: Column) -> Column:
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("NA"))
    return F.concat(known(name), F.lit(" ("), known(geo), F.lit(")"))


def fixed_point(c: Column, digits: int) -> Column:
    """Rounds the binary value half to even, as printf does; ``format_string`` rounds its shortest decimal half up."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def percent(c: Column, digits: int = 2) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(fixed_point(c, digits), F.lit("%")))


def document_weight(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("key_facts") | n.contains("key facts") | n.contains("kfs"), 5).when(n.contains("prospectus"), 2).otherwise(0)


def canonical_query(c: Column) -> Column:
    t = F.lower(c)
    for pattern, to in fixed.QUERY_REWRITES:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def is_noise(c: Column) -> Column:
    t = F.lower(c)
    solid = F.regexp_replace(t, r"\s+", "")
    share = F.try_divide(F.length(F.regexp_replace(solid, r"\D", "")), F.length(solid))
    return (
        (F.length(t) < 30) | t.contains("http") | t.contains("www.") | t.contains("table of contents")
        | (F.regexp_count(t, F.lit("restricted")) >= 2) | t.rlike(r"\b(page|appendix|chapter)\s+\d+\b")
        | (count_any(c, fixed.NOISE_PHRASES) >= 2) | (t.rlike(r"\([a-z]\)\s") & (F.regexp_count(t, F.lit(";")) >= 2))
        | F.coalesce(share > 0.35, F.lit(False))
    )


def risk_focus(c: Column) -> Column:
    return contains_any(c, fixed.RISK_HINTS) | contains_any(c, fixed.RISK_PATTERNS)


def summary_sentence(c: Column, most: int = 220) -> Column:
    """Squeezed, stripped of edge punctuation, cut back to a word boundary, closed by a point; empty stays empty."""
    t = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ .;,:]+|[ .;,:]+$", "")
    cut = F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", "")
    return F.when(t == "", "").otherwise(F.concat(F.when(F.length(t) > most, cut).otherwise(t), F.lit(".")))


def low_quality_response(c: Column) -> Column:
    t = F.trim(c)
    odd = F.length(F.regexp_replace(t, r"[\p{L}\p{N} \n]", ""))
    return (F.length(t) < 24) | (F.try_divide(odd, F.length(t)) > 0.6)


def realistic_percents(c: Column) -> Column:
    """Percent values in (0, 5] in their order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda x: x.try_cast("double"))
    return F.filter(found, lambda x: (x > 0) & (x <= 5))


def sentiment_sign(label: Column) -> Column:
    t = F.lower(label)
    return F.when(t.startswith("pos"), 1).when(t.startswith("neg"), -1).otherwise(0)


def adjusted_score(score: Column, sign: Column, confidence: Column, weight: float = 0.25) -> Column:
    return F.round(score * (1 + F.lit(weight) * sign * confidence), 6)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean; null when any component is."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union))


def overlap(query: Column, row: Column) -> Column:
    return F.size(F.array_intersect(query, row)) / F.greatest(F.size(query), F.lit(1))


def ranked_jaccard(a: Column, b: Column) -> Column:
    """Both lists in rank order, weights 1 / log2(rank + 1)."""

    def weight(xs: Column, x: Column) -> Column:
        at = F.array_position(xs, x)
        return F.when(at > 0, 1 / F.log2(at + 1)).otherwise(0.0)

    every = F.array_union(a, b)
    total = lambda f: F.aggregate(F.transform(every, lambda x: f(weight(a, x), weight(b, x))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(every) == 0, 1.0).otherwise(F.try_divide(total(F.least), total(F.greatest)))


def question_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("？"), F.lit("?")), r"\s+", " "))


def match_key(c: Column) -> Column:
    """Lower case, white space squeezed, and nothing else, for the ratio of two questions."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_question(c: Column, spoken: Column | None = None) -> Column:
    """English by its first word and a question mark; Chinese (``spoken`` zh...) by the wide mark or an asking word, unless
    it begins as an instruction."""
    q = F.lower(squeezed(c))
    english = q.endswith("?") & q.rlike("^(" + "|".join(fixed.QUESTION_STARTS) + ")")
    if spoken is None:
        return english
    told = reduce(lambda a, b: a | b, [q.startswith(p) for p in fixed.CHINESE_INSTRUCTIONS])
    return F.when(spoken.startswith("zh"), ~told & (q.contains("？") | contains_any(q, fixed.CHINESE_ASKING))).otherwise(english)


def is_noisy_sentence(c: Column) -> Column:
    """Too short for a question's answer, or legal and technical boilerplate."""
    t = F.lower(squeezed(c))
    return reduce(lambda a, b: a | b, [t.rlike(p) for p in fixed.NOISY_SENTENCES], F.length(t) < 25)


def zero_filled(c: Column, width: int) -> Column:
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def file_stems(c: Column) -> Column:
    """Names a code's file may have: the text itself, its number in four and in five digits; each once."""
    text = F.trim(c.cast("string"))
    number = F.nullif(F.regexp_replace(F.regexp_replace(text, r"\D", ""), r"^0+(?=\d)", ""), F.lit(""))
    return F.array_distinct(F.array_compact(F.array(F.nullif(text, F.lit("")), zero_filled(number, 4), zero_filled(number, 5))))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")


def code_of_path(path: Column, default: str = "UNKNOWN") -> Column:
    """The code in five digits of the folder over a ``csv`` folder (or over two of them), where it is a code."""
    parts = F.reverse(F.split(F.regexp_replace(path, "/+$", ""), "/+"))
    name = F.trim(F.when(F.lower(F.get(parts, F.lit(1))) == "csv", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))))
    return F.when(name.rlike(r"^\d{4,5}$"), F.lpad(name, 5, "0")).otherwise(default)


def compact_answer(c: Column, most: int) -> Column:
    t = F.replace(F.replace(squeezed(c), F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit("."))
    return F.trim(F.substring(t, 1, most))


def cut_words(c: Column, most: int) -> Column:
    """Squeezed; what is longer is cut back to a word boundary and ends in three points."""
    t = squeezed(c)
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most), " [^ ]*$", ""), F.lit("..."))).otherwise(t)


def is_bad_answer(answer: Column, tag: Column) -> Column:
    a = F.lower(F.trim(F.regexp_replace(answer, r"\s+", " ")))
    bad = reduce(lambda x, y: x | y, [a.rlike(p) for p in fixed.BAD_ANSWERS])
    return (F.length(a) < 35) | bad | (F.lower(tag).contains("fees_charges") & ~a.rlike(fixed.FEE_WORDS))


def safe_title(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}\s_-]", ""), r"\s+", "_"))
    return F.when(F.coalesce(t, F.lit("")) == "", "document").otherwise(F.substring(t, 1, 60))
