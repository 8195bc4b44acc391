"""Texts around an instrument: embedding text, Chinese questions, key facts, reply clean-up, prompts and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import columns as C
from lodestream.functions import fixed


def _given(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def embedding_text(code: Column, benchmark: Column, asset: Column, geo: Column, risks: Column, profile: Column) -> Column:
    """Known parts only; the risk summary, or else the first 900 characters of the profile."""
    part = lambda name, c: F.concat(F.lit(f"{name} "), _given(c), F.lit("."))
    tail = F.coalesce(F.concat(F.lit("Risk summary: "), _given(risks)), F.substring(_given(profile), 1, 900))
    return F.concat_ws(" ", F.concat(F.lit("Ticker "), C.digits_code(code, 5), F.lit(".")), part("Benchmark", benchmark), part("Asset class", asset), part("Geographic focus", geo), tail)


def chinese_question(question: Column, code: Column) -> Column:
    """The translation of the first listed beginning that fits, with the code; null where none does."""
    found = reduce(lambda a, b: a.when(question.startswith(b[0]), b[1]), fixed.CHINESE_QUESTIONS[1:], F.when(question.startswith(fixed.CHINESE_QUESTIONS[0][0]), fixed.CHINESE_QUESTIONS[0][1]))
    return F.concat(found, F.lit("（"), code, F.lit("）？"))


def key_facts(corpus: Column) -> Column:
    """Struct of the first match of each fact in the whole text of an instrument; null where it has none."""
    return F.struct(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract(corpus, f"(?i){p}", 1), r"\s+", " ")), F.lit("")).alias(n) for n, p in fixed.KEY_FACTS.items()])


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _once(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _at_start(p: str) -> str:
    """A pattern led by ``[^..]*`` tried at the start of a sentence only: from there it takes all that it could take from any
    later place, and what it has taken ends where the next sentence starts."""
    return f"(?<!{p[: p.index(']*') + 1]}){p}" if p.startswith("[^") else p


def _without(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: _stripped(F.regexp_replace(a, f"(?i){_at_start(p)}", "")), patterns, c)


def correct_claims(reply: Column, code: Column, known: Column) -> Column:
    """For a known code: a reply with one of the listed claims that the code is unknown loses their sentences, then every line
    that still says so, and says which code it is about; a cut offer of more at the end goes in any case."""
    wrong = lambda line: F.lower(line).contains(fixed.CLAIM_LINE) & C.contains_any(line, fixed.CLAIM_LINE_WORDS)
    head = F.concat(F.lit("Using ticker `"), code, F.lit("` as the active ETF context.\n\n"))
    asked = F.coalesce(known, F.lit(False)) & (F.coalesce(code, F.lit("")) != "")

    def rest(t: Column) -> Column:
        lines = F.transform(F.split(_without(t, fixed.CLAIM_SENTENCES), "\n"), _stripped)
        return F.array_join(F.filter(lines, lambda x: (x != "") & ~wrong(x)), "\n")

    told = lambda t: F.concat(head, _once(rest(t), lambda r: F.when(r == "", "I can continue with risk, benchmark, fee, and alternatives for this ETF.").otherwise(r)))
    claims = lambda t: F.when(C.contains_any(t, fixed.INVALID_CLAIMS), told(t)).otherwise(t)
    return _once(_stripped(F.coalesce(reply, F.lit(""))), lambda text: F.when(~asked, text).otherwise(_once(_without(text, fixed.CUT_TAILS[1:]), claims)))


def trim_reply(reply: Column, code: Column, known: Column, mapped: Column) -> Column:
    """For a known code: without cut-off tails, and where its data is there (``mapped``) without sentences that deny it."""
    asked = F.coalesce(known, F.lit(False)) & (F.coalesce(code, F.lit("")) != "")
    kept = lambda text: F.when(F.coalesce(mapped, F.lit(False)), _without(text, fixed.INSUFFICIENT)).otherwise(text)
    return _once(_stripped(F.coalesce(reply, F.lit(""))), lambda text: F.when(asked, _without(kept(text), fixed.CUT_TAILS)).otherwise(text))


def clean_reply(reply: Column, code: Column, known: Column, mapped: Column | None = None) -> Column:
    """Both: first corrected, then trimmed."""
    return trim_reply(correct_claims(reply, code, known), code, known, F.lit(True) if mapped is None else mapped)


def fallback(query: Column, code: Column, alternatives: Column) -> Column:
    """A short factual reply; alternatives or risks only where the query asks for them."""
    base = F.concat(F.lit("You asked about "), C.digits_code(code), F.lit(". Confirm the exact benchmark in the fund name and the official key facts statement."))
    return (
        F.when(C.contains_any(query, fixed.INTENTS["recommendation"]) & (F.size(alternatives) > 0), F.concat(base, F.lit(" You can review: "), F.array_join(F.slice(alternatives, 1, 3), ", "), F.lit(".")))
        .when(C.contains_any(query, fixed.INTENTS["risk"]), F.concat(base, F.lit(" Check market volatility, concentration and tracking error.")))
        .otherwise(base)
    )


def fee_reply(language: Column, percent: Column) -> Column:
    """The yearly charge in either language, with up to three decimals; a general sentence where it is null."""
    digits = F.regexp_replace(C.fixed_point(percent, 3), r"\.?0+$", "")
    told = {k: F.when(percent.isNull(), b).otherwise(F.replace(F.lit(a), F.lit("{}"), digits)) for k, (a, b) in fixed.FEE_REPLIES.items()}
    return F.when(language.startswith("zh"), told["zh"]).otherwise(told["en"])


def prompt(query: Column, code: Column, context: Column, alerts: Column) -> Column:
    """User prompt with intent rules, context and alerts as JSON."""
    zh = C.language(query) == "zh"
    rules = F.to_json(F.struct(C.contains_any(query, fixed.INTENTS["risk"]).alias("risk_discussion_allowed"), C.contains_any(query, fixed.INTENTS["recommendation"]).alias("recommendation_allowed")))
    return F.concat_ws("\n", F.concat(F.when(zh, "使用者問題: ").otherwise("User query: "), query), F.concat(F.when(zh, "目標ETF: ").otherwise("Target: "), code), F.concat(F.lit("Rules: "), rules), F.concat(F.lit("Context: "), F.to_json(context)), F.concat(F.lit("Alerts: "), F.to_json(alerts)))


def only_if_any(df: DataFrame, mask: Column) -> DataFrame:
    """The rows of the mask, or all rows where it matches none."""
    return df.filter(mask) if not df.filter(mask).isEmpty() else df
