"""Preference formatting of conversations (operator 10, native).

Of a chosen and a rejected conversation the longest common turn prefix is rendered once as the prompt; what follows in
each becomes a completion, with the character spans on which a loss is taken (assistant turns, end marker included).

Defined results: a null role is "unknown" and a null text empty; turns are ordered by (turn, role, text), so ties and
repeated rows stay, in a fixed order; control markers inside a text are broken up so that no text can forge a turn; a
conversation without an assistant turn, or whose partner has none, gets a null rejected side and trains on the chosen
side alone, and so does a pair of equal conversations, which prefers nothing; other columns, whatever their names, pass
through inside ``row``; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import let, offsets, table

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row a conversation. Its turns meet in one row because the output is one row of them."""
    t = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).cast(TURNS).alias("turns"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.replace(turn["role"], F.lit("<|"), F.lit("< |")), F.lit("\n"), F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))


def _same(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & (a["text"] == b["text"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn arrays."""
    n = F.least(F.size(a), F.size(b))
    walked = F.aggregate(
        F.arrays_zip(F.slice(a, F.lit(1), n).alias("x"), F.slice(b, F.lit(1), n).alias("y")),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, p: F.struct((s["n"] + F.when(s["on"] & _same(p["x"], p["y"]), 1).otherwise(0)).alias("n"), (s["on"] & _same(p["x"], p["y"])).alias("on")),
    )
    return walked["n"]


def _after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Spans "start:end" (code points of the completion) of the assistant turns, comma-joined."""
    lead = len("<|im_start|>assistant\n")

    def spans(sizes: Column) -> Column:
        rows = F.filter(F.arrays_zip(offsets(sizes).alias("at"), sizes.alias("n"), turns.alias("t")), lambda r: r["t"]["role"] == "assistant")
        return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", (r["at"] + lead).cast("string"), (r["at"] + r["n"] - 1).cast("string"))), ",")

    return F.when(turns.isNotNull(), let(F.transform(turns, lambda t: F.length(_render(t))), spans))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with two turn-array columns (rejected may be null) to (row, n_common, prompt, completions and masks)."""
    others = [F.col(f"`{c}`") for c in pairs.columns if c not in (chosen, rejected)]
    row = F.struct(*others) if others else F.lit(None).cast("string")
    told = pairs.select(row.alias("row"), F.col(chosen).alias("c"), F.col(rejected).alias("r"))
    told = told.withColumn("common", common_turns(F.col("c"), F.col("r")))
    alike = (F.col("common") == F.size("c")) & (F.size("c") == F.size("r"))
    cut = told.select("row", "c", F.when(~alike, F.col("r")).alias("r"), F.when(F.col("r").isNull() | alike, F.greatest(F.size("c") - 1, F.lit(0))).otherwise(F.col("common")).alias("n"))
    n, c, r = F.col("n"), F.col("c"), F.col("r")
    return cut.select(
        "row", n.cast("long").alias("n_common"),
        _text(F.slice(c, F.lit(1), n)).alias("prompt"),
        _text(_after(c, n)).alias("chosen"), _mask(_after(c, n)).alias("chosen_mask"),
        _text(_after(r, n)).alias("rejected"), _mask(_after(r, n)).alias("rejected_mask"),
    )


def mismatched_pairs(convs: DataFrame) -> DataFrame:
    """Each conversation as chosen; as rejected, the same with its last assistant turn answered by its neighbour's
    (conv_id with the lowest bit flipped) last assistant turn. Null where either has none or both say the same."""
    last = F.try_element_at(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(-1))
    own = convs.select("conv_id", "turns", last.alias("mine"))
    other = own.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("conv_id").alias("other_id"), F.col("mine.text").alias("reply"))
    j = own.join(other, "conv_id", "left")
    at = (F.size("turns") - F.array_position(F.reverse("turns"), F.col("mine")) + 1).cast("int")
    swapped = F.concat(F.slice("turns", F.lit(1), at - 1), F.array(F.struct(F.col("mine.turn").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text"))).cast(TURNS))
    differs = F.col("reply") != F.col("mine.text")
    return j.select("conv_id", F.when(differs, F.col("other_id")).alias("rejected_conv_id"), F.col("turns").alias("chosen"), F.when(differs, swapped).alias("rejected"))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_preferences(mismatched_pairs(conversations(turns)))
    return out.select("row.conv_id", F.coalesce("row.rejected_conv_id", F.lit(-1)).alias("rejected_conv_id"), *[c for c in out.columns if c != "row"])


ORACLE = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations),
r AS (SELECT *, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS s FROM t),
la AS (SELECT conv_id, max(i) AS pos FROM r WHERE role = 'assistant' GROUP BY conv_id),
lt AS (SELECT la.conv_id, pos, text, turn FROM la JOIN r ON r.conv_id = la.conv_id AND r.i = la.pos),
n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
j AS (SELECT n.conv_id, n.n, a.pos, CASE WHEN b.text <> a.text THEN b.conv_id END AS other,
        a.text AS mine, b.text AS reply
      FROM n LEFT JOIN lt a ON a.conv_id = n.conv_id LEFT JOIN lt b ON b.conv_id = xor(n.conv_id, 1)),
k AS (SELECT *, CASE WHEN other IS NULL THEN n - 1 ELSE pos - 1 END AS c FROM j),
x AS (SELECT k.conv_id, r.i, r.role, r.s, k.c,
        coalesce(sum(length(r.s)) FILTER (WHERE r.i > k.c) OVER (PARTITION BY k.conv_id ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM k JOIN r ON r.conv_id = k.conv_id),
y AS (SELECT conv_id,
        coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE i <= c), '') AS prompt,
        coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE i > c), '') AS chosen,
        coalesce(string_agg(CAST(CAST(off AS BIGINT) + 22 AS VARCHAR) || ':' || CAST(CAST(off AS BIGINT) + length(s) - 1 AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i > c AND role = 'assistant'), '') AS chosen_mask
      FROM x GROUP BY conv_id),
z AS (SELECT *, CASE WHEN other IS NOT NULL THEN '<|im_start|>assistant' || chr(10) || replace(reply, '<|', '< |') || '<|im_end|>' || chr(10) END AS rs FROM k)
SELECT z.conv_id, coalesce(z.other, -1) AS rejected_conv_id, CAST(z.c AS BIGINT) AS n_common, y.prompt, y.chosen, y.chosen_mask, z.rs AS rejected,
  CASE WHEN z.rs IS NULL THEN NULL ELSE '22:' || CAST(length(z.rs) - 1 AS VARCHAR) END AS rejected_mask
FROM z JOIN y USING (conv_id)
"""
