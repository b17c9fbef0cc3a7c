"""Preference formatting: a shared prompt and two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt; what
follows in each is its completion.  Loss applies to what the assistant says in a completion, its end mark
included, given as character ranges of the completion.

Defined results.  A null role is ``unknown``, a null text empty.  Turns are ordered by number (null first), then role, then
text, so repeated turns stay.  Equal conversations have empty completions and are not usable; so is a pair in which
a completion has nothing to learn.  Rows without a conversation id belong to none.  An empty
table gives no row.  Extra columns are ignored.  A conversation of any length is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import bind

END = "<|end|>\n"
LEARNT = "assistant"


def gather(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, from rows (conv_id, turn, role, text)."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    plain = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(plain.alias("turns"))


def pair_up(conversations: DataFrame) -> DataFrame:
    """Each conversation as chosen; rejected is the same with the last answer of its neighbour.

    Conversations 2k and 2k + 1 are neighbours.  Without a neighbour, or an answer of its own, the rejected one
    ends before the last answer.
    """
    last = F.try_element_at(F.filter("turns", lambda t: t["role"] == LEARNT), F.lit(-1))["text"]
    answered = conversations.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), last.alias("_other"))
    places = F.filter(
        F.transform("turns", lambda t, i: F.when(t["role"] == LEARNT, i)), lambda i: i.isNotNull()
    )
    found = conversations.join(answered, "conv_id", "left").withColumn("_at", F.coalesce(F.array_max(places), F.size("turns")))
    swapped = F.concat(
        F.slice("turns", F.lit(1), F.col("_at")),
        F.when(
            (F.col("_at") < F.size("turns")) & F.col("_other").isNotNull(),
            F.array(F.struct(F.lit(LEARNT).alias("role"), F.col("_other").alias("text"))),
        ).otherwise(F.array().cast("array<struct<role: string, text: string>>")),
    )
    return found.select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))


def _shown(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def _mask(turns: Column) -> Column:
    """Character ranges of what the assistant says, as start:end, comma-joined."""
    ranges = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, t: F.struct(
            (s["at"] + F.length(_shown(t))).alias("at"),
            F.when(
                t["role"] == LEARNT,
                F.array_append(
                    s["out"],
                    F.concat_ws(
                        ":",
                        (s["at"] + F.length(t["role"]) + 5).cast("string"),
                        (s["at"] + F.length(_shown(t))).cast("string"),
                    ),
                ),
            ).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.array_join(ranges, ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Rows (conv_id, chosen, rejected) -> prompt, both completions, their masks, and whether both can be learnt from."""
    most = F.least(F.size("chosen"), F.size("rejected"))

    def first_difference(same: Column) -> Column:
        return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, most.cast("long"))

    alike = F.transform(F.slice("chosen", F.lit(1), most), lambda t, i: t == F.get("rejected", i))
    cut = pairs.withColumn("shared_turns", bind(alike, first_difference).cast("int"))
    whole = F.lit(2**31 - 1)
    parts = cut.withColumns(
        {
            "_prompt": F.slice("chosen", F.lit(1), F.col("shared_turns")),
            "_chosen": F.slice("chosen", F.col("shared_turns") + 1, whole),
            "_rejected": F.slice("rejected", F.col("shared_turns") + 1, whole),
        }
    )
    return parts.select(
        "conv_id", "shared_turns", _rendered(F.col("_prompt")).alias("prompt"),
        _rendered(F.col("_chosen")).alias("chosen"), _rendered(F.col("_rejected")).alias("rejected"),
        _mask(F.col("_chosen")).alias("chosen_mask"), _mask(F.col("_rejected")).alias("rejected_mask"),
    ).withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS chosen FROM t GROUP BY conv_id),
a AS (SELECT *, list_filter(list_transform(range(1, len(chosen) + 1), lambda i: CASE WHEN chosen[i].role = 'assistant' THEN i END), lambda i: i IS NOT NULL) AS places FROM c),
o AS (SELECT xor(conv_id, 1) AS conv_id, chosen[places[-1]].text AS other FROM a WHERE len(places) > 0),
p AS (SELECT a.conv_id, chosen,
  CASE WHEN len(places) = 0 THEN chosen
       WHEN o.other IS NULL THEN chosen[1:places[-1] - 1]
       ELSE list_concat(chosen[1:places[-1] - 1], [{'role': 'assistant', 'text': o.other}]) END AS rejected
  FROM a LEFT JOIN o USING (conv_id)),
k AS (SELECT *, CAST(coalesce(list_position(list_transform(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] = rejected[i]), false) - 1,
  least(len(chosen), len(rejected))) AS INTEGER) AS shared_turns FROM p),
s AS (SELECT conv_id, shared_turns, chosen[1:shared_turns] AS x, chosen[shared_turns + 1:] AS y, rejected[shared_turns + 1:] AS z FROM k),
r AS (SELECT *, list_transform(x, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS xr,
  list_transform(y, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS yr,
  list_transform(z, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS zr FROM s),
m AS (SELECT *,
  coalesce(array_to_string(list_filter(list_transform(range(1, len(y) + 1), lambda i: CASE WHEN y[i].role = 'assistant'
    THEN CAST(coalesce(length(array_to_string(yr[1:i - 1], '')), 0) + 14 AS VARCHAR) || ':' || CAST(length(array_to_string(yr[1:i], '')) AS VARCHAR) END), lambda v: v IS NOT NULL), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_filter(list_transform(range(1, len(z) + 1), lambda i: CASE WHEN z[i].role = 'assistant'
    THEN CAST(coalesce(length(array_to_string(zr[1:i - 1], '')), 0) + 14 AS VARCHAR) || ':' || CAST(length(array_to_string(zr[1:i], '')) AS VARCHAR) END), lambda v: v IS NOT NULL), ','), '') AS rejected_mask
  FROM r)
SELECT conv_id, shared_turns, coalesce(array_to_string(xr, ''), '') AS prompt, coalesce(array_to_string(yr, ''), '') AS chosen,
  coalesce(array_to_string(zr, ''), '') AS rejected, chosen_mask, rejected_mask, chosen_mask <> '' AND rejected_mask <> '' AS usable
FROM m
"""
