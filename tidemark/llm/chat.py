"""Chat formatting for preference data, with DataFrame functions only.

Chosen and rejected conversations share their first turns. The longest common turn prefix is
found and rendered once as the prompt; what follows in each is rendered as a completion with
a loss mask, given as run lengths in characters (`12x0,40x1,1x0`: skip 12, train on 40, skip
1). Only assistant turns are trained on.

No text can forge a turn: in texts `<|` is written `<\\|` (and `<\\|` gets one more backslash, so that
the original can be told), and in roles all but letters, digits, `_` and `-` become `_`. Lengths in
masks are those of the written form.

Defined cases: a null or empty role is `unknown` and a null text is empty, in both functions; rows with
a null conv_id are dropped; repeated rows are repeated turns, in the order (turn, role, text);
conversations without turns give empty strings, null ones too; a pair that is equal throughout has
empty completions; a null turn differs from any other but a null one.
Extra columns are ignored. A conversation is one row of the result, so its turns meet in one
task; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _role(c: Column) -> Column:
    clean = F.regexp_replace(c.cast("string"), "[^A-Za-z0-9_-]", "_")
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit("unknown"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def gather(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), _role(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
    return conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _role(turn["role"]), F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(F.regexp_replace(_text(turn["text"]), r"<(\\*)\|", r"<\\$1|"), F.lit("<|end|>"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """Run lengths of a rendered completion."""
    flag = lambda t: F.when(t["role"] == "assistant", F.lit("x1,")).otherwise(F.lit("x0,"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(header(t)).cast("string"), F.lit("x0,"), F.length(body(t)).cast("string"), flag(t), F.lit("1x0"))), ",")


def trained(turns: Column) -> Column:
    """Characters that the mask trains on."""
    return F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + F.when(t["role"] == "assistant", F.length(body(t))).otherwise(0).cast("long"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns with the same role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda k: (_role(F.element_at(a, k)["role"]) == _role(F.element_at(b, k)["role"])) & (_text(F.element_at(a, k)["text"]) == _text(F.element_at(b, k)["text"])))
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise((first - 1).cast("int")).cast("int")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds the prompt, the completions and their masks; drops the two turn arrays."""
    a, b = (F.coalesce(F.col(c), F.array().cast(dict(pairs.dtypes)[c])) for c in (chosen, rejected))
    rest = lambda x: F.slice(x, F.col("prompt_turns") + 1, F.greatest(F.size(x) - F.col("prompt_turns"), F.lit(0)))
    df = pairs.withColumn("prompt_turns", common_prefix(a, b)).withColumn("prompt", render(F.slice(a, 1, F.col("prompt_turns"))))
    df = df.withColumn("_c", rest(a)).withColumn("_r", rest(b))
    for name, x in (("chosen", F.col("_c")), ("rejected", F.col("_r"))):
        df = df.withColumn(f"{name}_completion", render(x)).withColumn(f"{name}_mask", mask(x)).withColumn(f"{name}_trained", trained(x))
    return df.drop("_c", "_r", chosen, rejected)


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, partner_id, chosen, rejected): each conversation up to its last assistant turn,
    and the same with that turn's text replaced by the last assistant text of its neighbour
    (the id that differs in the last bit). Without an assistant turn nothing is replaced; without
    a neighbour's reply the rejected conversation ends before the turn."""
    turns = gather(conversations)
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.size("turns")), lambda k: F.when(F.element_at("turns", k)["role"] == "assistant", k).otherwise(0)))
    own = turns.select("conv_id", F.col("conv_id").bitwiseXOR(F.lit(1)).alias("partner_id"), "turns", last.alias("last"))
    reply = own.where("last > 0").select(F.col("partner_id").alias("conv_id"), F.expr("element_at(turns, last).text").alias("reply"))
    df = own.join(reply, "conv_id", "left")
    head = F.slice("turns", 1, F.greatest(F.col("last") - 1, F.lit(0)))
    swapped = F.when(F.col("reply").isNull(), F.expr(f"cast(array() as {TURNS})")).otherwise(
        F.array(F.struct(F.expr("element_at(turns, greatest(last, 1)).turn").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text"))))
    return df.select("conv_id", "partner_id", F.when(F.col("last") == 0, F.col("turns")).otherwise(F.slice("turns", 1, F.greatest("last", F.lit(1)))).alias("chosen"), F.when(F.col("last") == 0, F.col("turns")).otherwise(F.concat(head, swapped)).alias("rejected"))


def preferences(conversations: DataFrame) -> DataFrame:
    return format_pairs(swapped_replies(conversations))


ORACLE_SQL = r"""
WITH g AS (
  SELECT conv_id, list({'turn': CAST(turn AS BIGINT), 'role': clean, 'text': regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g')} ORDER BY turn NULLS FIRST, clean, coalesce(text, '')) AS turns
  FROM (SELECT *, coalesce(nullif(regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g'), ''), 'unknown') AS clean FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
own AS (
  SELECT conv_id, xor(conv_id, 1) AS partner_id, turns,
    coalesce(list_max(list_transform(range(1, len(turns) + 1), lambda k: CASE WHEN turns[k].role = 'assistant' THEN k ELSE 0 END)), 0) AS last FROM g),
j AS (
  SELECT o.*, r.turns[r.last].text AS reply FROM own o LEFT JOIN own r ON r.conv_id = o.partner_id AND r.last > 0),
p AS (
  SELECT conv_id, partner_id,
    CASE WHEN last = 0 THEN turns ELSE turns[1:last] END AS chosen,
    CASE WHEN last = 0 THEN turns WHEN reply IS NULL THEN turns[1:last - 1]
      ELSE list_concat(turns[1:last - 1], [{'turn': turns[last].turn, 'role': 'assistant', 'text': reply}]) END AS rejected FROM j),
k AS (
  SELECT *, coalesce(list_min(list_transform(range(1, least(len(chosen), len(rejected)) + 1),
    lambda k: CASE WHEN chosen[k].role = rejected[k].role AND chosen[k].text = rejected[k].text THEN 1000000000 ELSE k - 1 END)), 0) AS d FROM p),
q AS (SELECT *, CAST(least(d, len(chosen), len(rejected)) AS INTEGER) AS n FROM k),
s AS (SELECT *, chosen[n + 1:] AS c, rejected[n + 1:] AS r, chosen[1:n] AS h FROM q)
SELECT conv_id, partner_id, n AS prompt_turns,
  coalesce(array_to_string(list_transform(h, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen_completion,
  coalesce(array_to_string(list_transform(c, lambda t: (length(t.role) + 5) || 'x0,' || (length(t.text) + 7) || CASE WHEN t.role = 'assistant' THEN 'x1,' ELSE 'x0,' END || '1x0'), ','), '') AS chosen_mask,
  CAST(coalesce(list_sum(list_transform(c, lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) + 7 ELSE 0 END)), 0) AS BIGINT) AS chosen_trained,
  coalesce(array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected_completion,
  coalesce(array_to_string(list_transform(r, lambda t: (length(t.role) + 5) || 'x0,' || (length(t.text) + 7) || CASE WHEN t.role = 'assistant' THEN 'x1,' ELSE 'x0,' END || '1x0'), ','), '') AS rejected_mask,
  CAST(coalesce(list_sum(list_transform(r, lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) + 7 ELSE 0 END)), 0) AS BIGINT) AS rejected_trained
FROM s
"""
