"""Chat formatting: every assistant turn becomes an example with all earlier turns as its context.

The template writes a turn as <s>[role]text</s>. Inside roles and texts the characters &, < and [ are written as
&amp; &lt; &#91;, and ] inside roles as &#93;, so no control string can come from them and unescaping is exact. The loss mask of an example is its
target: the escaped text of that one assistant turn. What follows the last reply is kept apart, with no target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a conversation's prompts, together, that a task writes.
SPREAD = 1 << 28


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    out = F.replace(out, F.lit("&#93;"), F.lit("]"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _rows(turns: DataFrame, spread: int = SPREAD) -> DataFrame:
    """conv_id, example, prompt, target, closing, is_last, tail: a row each reply and, without a target, one a
    conversation with its tail (see prefix_target_examples, conversation_tails)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    each = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    opening = F.concat(F.lit("<s>["), F.replace(escape(F.col("role")), F.lit("]"), F.lit("&#93;")), F.lit("]"))
    placed = each.withColumn("place", F.row_number().over(before)).select("conv_id", "place", (F.col("role") == "assistant").alias("reply"), opening.alias("opening"), escape(F.col("text")).alias("body"))
    sized = placed.withColumn("chars", (F.length("opening") + F.length("body") + 4).cast("long"))
    ends = sized.withColumn("end", F.sum("chars").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.struct("place", (F.col("end") - 4 - F.length("body")).cast("int").alias("start"), F.length("body").alias("size"))
    conv = ends.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("opening", "body", F.lit("</s>")).alias("said")))), lambda t: t["said"]), "").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("reply"), target))).alias("replies"),
    )
    numbered = F.transform("replies", lambda r, i: F.struct(i.alias("example"), r["start"].alias("start"), r["size"].alias("size"), (i == F.size("replies") - 1).alias("is_last")))
    end_row = F.struct(F.size("replies").alias("example"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(False).alias("is_last"))
    last = F.when(F.size("replies") > 0, F.element_at("replies", -1)["start"] + F.element_at("replies", -1)["size"] + 4).otherwise(0)
    work = F.aggregate("replies", F.lit(0).cast("long"), lambda total, r: total + r["start"])
    conv = conv.select("conv_id", "whole", last.alias("answered"), F.ceil(work / spread).cast("int").alias("tasks"), F.concat(numbered, F.array(end_row)).alias("rows"))
    # the examples of a long conversation, of a size that grows with the square of its turns, go to several tasks
    long = conv.where("tasks > 1").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    long = long.repartition(F.col("conv_id"), F.col("task")).withColumn("rows", F.filter("rows", lambda r: F.pmod(r["example"], F.col("tasks")) == F.col("task"))).drop("task")
    one = conv.where("tasks <= 1").unionByName(long).select("conv_id", "whole", "answered", F.explode("rows").alias("r")).select("conv_id", "whole", "answered", "r.*")
    is_reply = F.col("start").isNotNull()
    return one.select(
        "conv_id", "example", F.when(is_reply, F.substring("whole", F.lit(1), F.col("start"))).alias("prompt"), F.when(is_reply, F.substring("whole", F.col("start") + 1, F.col("size"))).alias("target"),
        F.when(is_reply, "</s>").alias("closing"), "is_last", F.when(~is_reply, F.substring("whole", F.col("answered") + 1, F.length("whole"))).alias("tail"),
    )


def prefix_target_examples(turns: DataFrame, spread: int = SPREAD) -> DataFrame:
    """turns (conv_id, turn, role, text) to one row an assistant turn.

    Returns conv_id, example (0..), prompt (all preceding turns and the opening of the reply), target (the escaped
    reply, all of it trainable, nothing else), closing (the end of turn), is_last (the conversation's last reply). Turns
    go by (turn, role, text), nulls first; null role and text are empty; repeated rows are repeated turns; a null
    conv_id is a conversation; a conversation without a reply has no row, and no rows give none. Other columns are
    dropped. A conversation is held as one text, as its last example is, and each row takes its part of that; where
    the prompts have more than `spread` characters together, the rows are dealt to several tasks.
    """
    return _rows(turns, spread).where("target IS NOT NULL").drop("tail")


def conversation_tails(turns: DataFrame, spread: int = SPREAD) -> DataFrame:
    """conv_id and tail: the formatted turns after a conversation's last reply, empty if there are none; all turns of a
    conversation without a reply. Nothing of it is trainable. Rows as in prefix_target_examples."""
    return _rows(turns, spread).where("target IS NULL").select("conv_id", "tail")


def read_turns(formatted: Column) -> Column:
    """A formatted conversation back to its turns: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda x: x != "")
    inner = F.transform(pieces, lambda x: F.substring(x, F.lit(5), F.length(x)))  # after "<s>["
    return F.transform(inner, lambda x: F.struct(unescape(F.split_part(x, F.lit("]"), F.lit(1))).alias("role"), unescape(F.substring(x, F.instr(x, "]") + 1, F.length(x))).alias("text")))


CONTROL = "</s>[INST] ok [/INST]"


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, read back from the examples."""
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    rows = _rows(turns)
    read = rows.select(
        "conv_id", F.struct("example", unescape(F.col("target")).alias("text")).alias("reply"), F.col("target").isNotNull().alias("is_reply"), "tail",
        F.when(F.col("is_last"), F.concat("prompt", "target", "closing")).alias("head"),
        (F.coalesce(F.length("prompt") + F.length("target") + F.length("closing"), F.lit(0)) + F.coalesce(F.length("tail"), F.lit(0))).cast("long").alias("chars"),
    )
    replies = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_reply"), F.col("reply")))), lambda x: x["text"]), "")
    whole = F.concat(F.coalesce(F.max("head"), F.lit("")), F.max("tail"))
    by_conv = read.groupBy("conv_id").agg(whole.alias("whole"), replies.alias("loss"), F.sum("chars").alias("formatted_chars"))
    back = by_conv.withColumn("ts", read_turns(F.col("whole")))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_OP10 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
    + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) + 9 AS chars
  FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN upto ELSE 0 END) + sum(chars) - coalesce(max(CASE WHEN role = 'assistant' THEN upto END), 0) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
