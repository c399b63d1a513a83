"""Session logs: turns, histories, digests, comparison and merge of branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns_of(messages: DataFrame) -> DataFrame:
    """(session_id, turn_index, question, answer) from (conv_id, turn, role, text): each user message with the assistant's next; a last one without answer has ''."""
    talk = messages.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = talk.withColumn("nr", F.lead("role").over(w)).withColumn("nt", F.lead("text").over(w)).filter("role = 'user'")
    answer = F.when(F.col("nr") == "assistant", F.col("nt")).otherwise("")
    return rows.select(F.col("conv_id").alias("session_id"), F.row_number().over(w).alias("turn_index"), F.col("text").alias("question"), F.coalesce(answer, F.lit("")).alias("answer"))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of each session."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))
    return turns.withColumn("__r", back).filter(F.col("__r") <= n).drop("__r")


def before_turn(turns: DataFrame, session, turn_index: int) -> DataFrame:
    return turns.filter((F.col("session_id") == session) & (F.col("turn_index") < turn_index))


def rollup(turns: DataFrame) -> DataFrame:
    """Turns of each session, and its last question."""
    return turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.max("turn_index").alias("last_turn"), F.max_by("question", "turn_index").alias("last_question"))


def next_turn(turns: DataFrame, session) -> int:
    return turns.filter(F.col("session_id") == session).agg(F.coalesce(F.max("turn_index"), F.lit(0)) + 1).first()[0]


def common_prefix(turns: DataFrame, left, right) -> DataFrame:
    """(common): how many first turns two sessions share, by question and answer."""
    a = turns.filter(F.col("session_id") == left).select("turn_index", F.struct("question", "answer").alias("l"))
    b = turns.filter(F.col("session_id") == right).select("turn_index", F.struct("question", "answer").alias("r"))
    both = a.join(b, "turn_index", "full_outer").withColumn("same", F.coalesce(F.col("l") == F.col("r"), F.lit(False)))
    return both.agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("turn_index"))) - 1, F.max("turn_index"), F.lit(0)).alias("common"))


def set_delta(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values with ``side``: shared, left_only or right_only."""
    a, b = left.select(column).distinct().withColumn("l", F.lit(True)), right.select(column).distinct().withColumn("r", F.lit(True))
    both = a.join(b, column, "full_outer")
    return both.select(column, F.when(F.col("l") & F.col("r"), "shared").when(F.col("l"), "left_only").otherwise("right_only").alias("side"))


def merge_branches(turns: DataFrame, left, right, common: int | Column, into) -> DataFrame:
    """The common turns (a number, or ``common_prefix(...).scalar()``), then the rest of the left, then of the right, numbered anew."""
    a = turns.filter(F.col("session_id") == left).withColumn("__b", F.lit(0))
    b = turns.filter((F.col("session_id") == right) & (F.col("turn_index") > common)).withColumn("__b", F.lit(1))
    w = Window.partitionBy(F.lit(into)).orderBy("__b", "turn_index")
    rows = a.unionByName(b).withColumn("__n", F.row_number().over(w))
    return rows.select(F.lit(into).alias("session_id"), F.col("__n").alias("turn_index"), "question", "answer")


def digest(turns: DataFrame) -> DataFrame:
    """A session's distinct entities, tools and intents (sorted), least and largest progress without zeros, and last five questions.

    ``turns``: session_id, turn_index, question, intent, progress, entities (array), tools (array). Turns of a session are few.
    """
    uniq = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    progress = F.nullif("progress", F.lit(0))
    asked = F.array_sort(F.collect_list(F.struct("turn_index", "question")))
    return turns.groupBy("session_id").agg(
        uniq("entities").alias("entities"), uniq("tools").alias("tools"), F.array_sort(F.collect_set("intent")).alias("intents"), F.min(progress).alias("least"), F.max(progress).alias("most"),
        F.slice(asked, F.greatest(F.size(asked) - 4, F.lit(1)), 5)["question"].alias("questions"),
    )


def recent_entity(turns: DataFrame, back: int = 4) -> DataFrame:
    """Adds the last non-empty entity of the last ``back`` turns."""
    w = Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(-(back - 1), 0)
    return turns.withColumn("recent_entity", F.last(F.nullif("entity", F.lit("")), ignorenulls=True).over(w))


def trace_summary(calls: DataFrame) -> DataFrame:
    """Of (session_id, tool_name, elapsed_ms, blocked): calls, blocked ones, time in all, slowest tool."""
    return calls.groupBy("session_id").agg(F.count("*").alias("calls"), F.count_if("blocked").alias("blocked"), F.sum("elapsed_ms").alias("elapsed_ms"), F.max_by("tool_name", F.struct("elapsed_ms", "tool_name")).alias("slowest"))


def appended(turns: DataFrame, new: DataFrame) -> DataFrame:
    """``turns`` and new ones (session_id, at, question, answer; ``at`` orders a session's new ones), numbered on from each session's last."""
    last = turns.groupBy("session_id").agg(F.max("turn_index").alias("__last"))
    no = F.row_number().over(Window.partitionBy("session_id").orderBy("at"))
    rows = new.withColumn("__n", no).join(last, "session_id", "left")
    return turns.unionByName(rows.select("session_id", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("int").alias("turn_index"), "question", "answer"))


def updated(turns: DataFrame, changes: DataFrame) -> DataFrame:
    """``turns`` with the questions and answers of ``changes`` (session_id, turn_index, question, answer) where these aren't null."""
    c = changes.select("session_id", "turn_index", F.col("question").alias("__q"), F.col("answer").alias("__a"))
    rows = turns.join(c, ["session_id", "turn_index"], "left")
    return rows.withColumns({"question": F.coalesce("__q", "question"), "answer": F.coalesce("__a", "answer")}).select(*turns.columns)


def deleted(turns: DataFrame, session, turn_index: int | None = None, onwards: bool = False) -> DataFrame:
    """``turns`` without one turn, without it and all after it, or (without ``turn_index``) without the session. What is left keeps its numbers."""
    own = F.col("session_id") == session
    if turn_index is not None:
        own = own & (F.col("turn_index") >= turn_index if onwards else F.col("turn_index") == turn_index)
    return turns.filter(~own)


def branched(turns: DataFrame, session, turn_index: int, into) -> DataFrame:
    """The turns before ``turn_index`` as a new session, numbered from 1; running a turn again starts from these."""
    no = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index"))
    own = before_turn(turns, session, turn_index).withColumn("turn_index", no)
    return own.withColumn("session_id", F.lit(into)).select(*turns.columns)


def insights(pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, kind, title) from compared sessions (left_id, right_id, common, left_only, right_only (turns), left_entities, right_entities, left_tools, right_tools (arrays of what only one has)).

    One row a rule that applies: where they part, how far each goes on, and whose entities and tools differ.
    """
    apart = F.when(F.col("common") == 0, "从第一轮开始分歧").otherwise(F.concat(F.lit("共同前缀 "), "common", F.lit(" 轮")))
    length = F.when(F.col("left_only") != F.col("right_only"), "分支推进长度不同").when(F.col("left_only") > 0, "两侧都有独有推进")
    differ = lambda a, title: F.when((F.size(f"left_{a}") > 0) | (F.size(f"right_{a}") > 0), title)
    rules = [("divergence", apart), ("coverage", length), ("entity", differ("entities", "实体焦点不同")), ("tool", differ("tools", "工具调用路径不同"))]
    told = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("title")) for k, t in rules])
    return pairs.select("left_id", "right_id", F.inline(told)).filter("title is not null")
