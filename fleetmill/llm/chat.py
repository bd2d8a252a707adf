"""Preference formatting of conversations (operator 2), by DataFrame functions only.

Two conversations that begin alike are rendered as one prompt, the turns they share, and two
completions. Of a completion the assistant's turns are to be learned and all else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: before its role, between role and text, after its text.
BEFORE, BETWEEN, AFTER = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order, as role and text.

    Turns of one number are ordered by role and text; null roles and texts become empty. Turns
    without a conversation are one conversation without an id.
    """
    own = turns.select(
        turns["conv_id"].cast("bigint").alias("conv_id"),
        F.struct(
            turns["turn"].cast("bigint").alias("turn"),
            F.coalesce(turns["role"], F.lit("")).alias("role"),
            F.coalesce(turns["text"], F.lit("")).alias("text"),
        ).alias("one"),
    )
    grouped = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    bare = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select("conv_id", bare.alias("turns"))


def with_cut_answer(convs: DataFrame) -> DataFrame:
    """``(conv_id, chosen, rejected)``: a conversation up to its last answer, and with half of it.

    A conversation without an answer is chosen whole, and rejected with an empty answer.
    """
    last = F.coalesce(
        F.array_max(
            F.transform("turns", lambda x, i: F.when(x["role"] == LEARNED_ROLE, i + 1))
        ),
        F.lit(0),
    )
    convs = convs.withColumn("last", last)
    answer = F.when(F.col("last") > 0, F.col("turns")[F.col("last") - 1]["text"]).otherwise("")
    half = F.substring(answer, F.lit(1), F.floor(F.length(answer) / 2).cast("int"))
    before = F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.col("last") - 1)).otherwise(
        F.col("turns")
    )
    cut = F.array(F.struct(F.lit(LEARNED_ROLE).alias("role"), half.alias("text")))
    chosen = F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.col("last"))).otherwise(
        F.col("turns")
    )
    return convs.select("conv_id", chosen.alias("chosen"), F.concat(before, cut).alias("rejected"))


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEFORE), turn["role"], F.lit(BETWEEN), turn["text"], F.lit(AFTER))


def learned_spans(turns: Column) -> Column:
    """Places in the rendered turns that are learned, as ``start:end`` in characters.

    A span holds an answer's text and its end, not the role before it.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + len(BEFORE) + F.length(turn["role"]) + len(BETWEEN)
        end = begin + F.length(turn["text"]) + len(AFTER)
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        more = F.when(turn["role"] == LEARNED_ROLE, F.array(span)).otherwise(
            F.array().cast("array<string>")
        )
        return F.struct(end.alias("at"), F.concat(done["spans"], more).alias("spans"))

    return F.aggregate(turns, start, step, lambda done: F.array_join(done["spans"], ","))


def preferences(pairs: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """Renders pairs ``(id, chosen, rejected)`` of arrays of turns, one row per row.

    Gives ``n_shared``, ``prompt``, ``chosen``, ``rejected`` and the masks ``chosen_learned`` and
    ``rejected_learned``. Where one side is a beginning of the other its completion is empty, where
    both are equal both are; null sides count as empty. Repeated rows stay, other columns go.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    pairs = pairs.select(
        id_col, F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r")
    )
    pairs = pairs.withColumn("n_shared", shared_turns(F.col("c"), F.col("r")))
    rest = {x: F.slice(F.col(x), F.col("n_shared") + 1, F.size(x) + 1) for x in ("c", "r")}
    return pairs.select(
        id_col,
        "n_shared",
        render(F.slice("c", F.lit(1), F.col("n_shared"))).alias("prompt"),
        render(rest["c"]).alias("chosen"),
        render(rest["r"]).alias("rejected"),
        learned_spans(rest["c"]).alias("chosen_learned"),
        learned_spans(rest["r"]).alias("rejected_learned"),
    )


PREFERENCES_SQL = """
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations),
ends AS (
  SELECT conv_id, max(i) AS n, coalesce(max(i) FILTER (role = 'assistant'), 0) AS k
  FROM numbered GROUP BY conv_id),
placed AS (
  SELECT x.conv_id, i, n, k, role, text, substr(text, 1, length(text) // 2) AS half,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole
  FROM numbered x JOIN ends e ON x.conv_id IS NOT DISTINCT FROM e.conv_id),
answers AS (
  SELECT *, k > 0 AND text = half AS same FROM placed WHERE i = k
  UNION ALL
  SELECT DISTINCT conv_id, n + 1, n, k, 'assistant', '', '', '', false FROM placed WHERE k = 0),
prompts AS (
  SELECT a.conv_id, count(p.i) AS n_before,
         coalesce(string_agg(p.whole, '' ORDER BY p.i), '') AS before
  FROM answers a LEFT JOIN placed p
    ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.i < a.i
  GROUP BY a.conv_id)
SELECT a.conv_id,
       CAST(n_before + CASE WHEN same THEN 1 ELSE 0 END AS INTEGER) AS n_shared,
       before || CASE WHEN same THEN whole ELSE '' END AS prompt,
       CASE WHEN same THEN '' ELSE whole END AS chosen,
       CASE WHEN same THEN ''
            ELSE '<|assistant|>' || chr(10) || half || '<|end|>' || chr(10) END AS rejected,
       CASE WHEN same OR k = 0 THEN '' ELSE '14:' || (14 + length(text) + 8) END AS chosen_learned,
       CASE WHEN same THEN '' ELSE '14:' || (14 + length(half) + 8) END AS rejected_learned
FROM answers a JOIN prompts p ON a.conv_id IS NOT DISTINCT FROM p.conv_id
"""
