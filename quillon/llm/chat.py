"""Chat formatting by quotation linking.

Lines that begin with quote signs (>) have a quote level, the number of signs. Neighbouring lines of one level are a passage.
Passages, and the lines of each, are normalised (letters and digits in lower case, single spaces) and hashed; so are
each message's own words: the whole, its paragraphs and its lines. A passage's original is the first message of the conversation
that has its hash among its own words and comes before the quoting one; if the whole passage has none, its lines are tried in order. A message
replies to the original of its first linked passage of level 1. Quotes, and the attribution lines before them, are taken out of the text.

Messages get the turn they reply to, the turn their thread begins with, and their depth in it; sorted by conversation,
root_turn and turn they are reply-ordered: each thread together, each message after what it replies to. conversations() puts them
together in this order, in parts of bounded size.

Cases: a null text counts as empty, and an empty text has no passage; a very long text is parsed in one pass, in time that grows with its
length; rows with a null conversation or turn are kept but neither linked nor linked to; rows that repeat a
conversation and turn are one message for linking (the first parent found counts) and each is kept; an empty table gives an
empty result; other columns are kept, unless an added column has their name.
Plan: texts are parsed in Arrow batches. Originals are pre-aggregated by (conversation, hash) to their first turn before the join, so
that a common line or a long conversation makes no pairs; threads are followed by doubling steps over (turn, parent) rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import cut, small_batches

MARK = re.compile(r"[\x20\x09]*(?:>[\x20\x09]?)+")
ATTRIBUTION = re.compile(r"\s*(?:on\b.{0,200}|.{1,80})\b(?:wrote|said|writes)\s*:\s*", re.I | re.A)
#: Turns of a part of a conversation.
PART = 1000
ADDED = ("clean_text", "n_passages", "n_linked", "max_level", "parent_turn", "root_turn", "depth")


def normal(x: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """A text without its quotes, and its quoted passages as (level, lines)."""
    if ">" not in text and "\r" not in text:
        return _trimmed(text), []
    own, passages, last, before = [], [], 0, None
    for line in re.split(r"\r?\n", text):
        m = MARK.match(line)
        if m is None:
            level = 0
            own.append(line)
        else:
            level = m[0].count(">")
            if last == 0 and before is not None and ATTRIBUTION.fullmatch(before):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        last, before = level, line
    return _trimmed("\n".join(own)), passages


def _trimmed(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip(" \t\n\x0b\f\r")


_PASSAGE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("lines", T.ArrayType(T.StringType()))])
_PARSED = T.StructType([T.StructField("own", T.StringType()), T.StructField("passages", T.ArrayType(_PASSAGE))])


def parsed(text: str | F.Column) -> F.Column:
    """parse() of each text, as a struct of own and passages."""

    @F.arrow_udf(_PARSED)
    def of(texts: pa.Array) -> pa.Array:
        rows = [{"own": own, "passages": [{"level": v, "lines": x} for v, x in passages]} for own, passages in (parse(t.as_py() or "") for t in texts)]
        passage = pa.struct([("level", pa.int32()), ("lines", pa.list_(pa.string()))])
        return pa.array(rows, pa.struct([("own", pa.string()), ("passages", pa.list_(passage))]))

    return of(text)


def _hash(x: F.Column) -> F.Column:
    return F.unhex(F.md5(normal(x).cast("binary")))


def link(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, turn, k, level, original) of all passages, k being a passage's place in its message, and the messages (conv, turn)."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{text}`").alias("text")).where("conv IS NOT NULL AND turn IS NOT NULL")
    quoting = rows.where(F.col("text").contains(">")).select("conv", "turn", parsed("text")["passages"].alias("p"))
    asked = quoting.select("conv", "turn", F.posexplode("p").alias("k", "p"))
    # the passage first, then its lines
    texts = F.concat(F.array(F.array_join("p.lines", "\n")), F.col("p.lines"))
    asked = asked.select("conv", "turn", "k", F.col("p.level").alias("level"), F.posexplode(texts).alias("i", "body")).where(normal(F.col("body")) != "").select("conv", "turn", "k", "level", "i", _hash(F.col("body")).alias("hash"))
    asked = cut(asked)
    wanted = asked.select("conv").distinct()
    mine = rows.join(wanted, "conv", "left_semi").select("conv", "turn", parsed("text")["own"].alias("own"))
    units = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", "\n")))
    given = mine.select("conv", "turn", F.explode(units).alias("u")).where(normal(F.col("u")) != "").groupBy("conv", _hash(F.col("u")).alias("hash")).agg(F.min("turn").alias("first"))
    found = asked.join(given, ["conv", "hash"], "left").withColumn("original", F.when(F.col("first") < F.col("turn"), F.col("first")))
    found = found.groupBy("conv", "turn", "k", "level").agg(F.min(F.when(F.col("original").isNotNull(), F.struct("i", "original"))).alias("best")).select("conv", "turn", "k", "level", F.col("best.original").alias("original"))
    return found, rows


def threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) of messages that reply to another. parents: conv, turn, parent (an earlier turn)."""
    state = cut(parents.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("more"))
        step = state.join(up, ["conv", "root"], "left").select("conv", "turn", "parent", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("root2").isNotNull().alias("moved"))
        step = cut(step)
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            return state


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Add ADDED to every row."""
    found, _ = link(df, conv, turn, text)
    found = cut(found)
    # of repeated rows, each passage of which is there once, too
    by = found.groupBy("conv", "turn").agg(F.count(F.lit(1)).cast("long").alias("n_passages"), F.count("original").cast("long").alias("n_linked"), F.max("level").alias("max_level"), F.min(F.when((F.col("level") == 1) & F.col("original").isNotNull(), F.struct("k", "original"))).alias("first"))
    by = by.select("conv", "turn", "n_passages", "n_linked", "max_level", F.col("first.original").alias("parent"))
    tree = threads(by.where("parent IS NOT NULL").select("conv", "turn", "parent"))
    by = by.drop("parent").join(tree, ["conv", "turn"], "left").select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), "n_passages", "n_linked", "max_level", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "depth")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ADDED]
    rows = df.select(*keep, parsed(F.col(f"`{text}`"))["own"].alias("clean_text"))
    out = rows.join(by, (rows[conv] == F.col("__c")) & (rows[turn] == F.col("__t")), "left").drop("__c", "__t")
    zero = F.lit(0).cast("long")
    return out.withColumns({"n_passages": F.coalesce("n_passages", zero), "n_linked": F.coalesce("n_linked", zero), "max_level": F.coalesce("max_level", F.lit(0)), "root_turn": F.coalesce("root_turn", F.col(f"`{turn}`")), "depth": F.coalesce("depth", F.lit(0))})


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations in reply order and without quotes: conv_id, part, chat (array of root_turn, turn, parent_turn, depth, role, text, in this order),
    n_messages, n_passages, n_linked, max_level, chat_text (a message a block, after its role).

    A conversation's parts, in the order of part, hold the messages of PART turns each, of threads that begin within PART turns; so no task
    holds more of a conversation, however long it is (but for rows that repeat a turn). Messages without a conversation or turn are put in parts by their hash."""
    rows = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    rows = format_chat(rows, "conv_id", "turn", "text")
    loose = F.col("conv_id").isNull() | F.col("turn").isNull()
    part = F.when(loose, F.struct(F.lit(-1).cast("long").alias("root"), F.pmod(F.xxhash64("turn", "role", "clean_text"), F.lit(1 << 20)).alias("turn"))).otherwise(F.struct(F.floor(F.col("root_turn") / PART).alias("root"), F.floor(F.col("turn") / PART).alias("turn")))
    message = F.struct("root_turn", "turn", "parent_turn", "depth", "role", F.col("clean_text").alias("text"))
    sums = [F.sum(c).alias(c) for c in ("n_passages", "n_linked")]
    out = rows.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(message)).alias("chat"), F.count(F.lit(1)).alias("n_messages"), *sums, F.max("max_level").alias("max_level"))
    blocks = F.transform("chat", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), m["text"]))
    return out.withColumn("chat_text", F.array_join(blocks, "\n\n"))
