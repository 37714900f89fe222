"""Pairing and truncation of (original, sampled) texts (SURVEY J6, E12-E19,
X13, A5, D5/D6).

The language model that writes the sampled text is outside the engine:
prompts are built here as a table (E16-E18), replies come back as a
table, and acceptance, prefix repair and trimming are row expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T

# Chat role and instruction per dataset for chat models.
CHAT_ROLES = {
    "xsum": "You are a News writer.",
    "writing": "You are a Fiction writer.",
    "pubmed": "You are a Technical writer.",
}
CHAT_PROMPTS = {
    "xsum": "Please write an article with about 150 words starting exactly with:",
    "writing": "Please write an article with about 150 words starting exactly with:",
    "pubmed": "Please answer the question in about 50 words.",
}
# Minimum words every reply needs, and prompt length.
MIN_WORDS = {"pubmed": 30, "default": 55}
PROMPT_TOKENS = 30


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """J6 on the fixture: user turn t (original, human) with the assistant
    turn t+1 of the same conversation (sampled, machine).  An equi-join on
    (conv_id, turn) — co-partitioned by conv_id, no cross product."""
    u = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("original"))
    a = conversations.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("sampled"))
    return (u.join(a, (u.conv_id == a._c) & (u.turn == a._t))
             .select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), "original", "sampled"))


def chat_prompt(dataset: str, prefix) -> F.Column:
    """``[{role: system, content}, {role: user, content}]`` messages
    for a dataset; the prefix drops its last word unless pubmed (E17)."""
    p = prefix if dataset == "pubmed" else T.drop_last_word(prefix)
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(CHAT_ROLES[dataset]).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 F.concat(F.lit(CHAT_PROMPTS[dataset] + " "), p).alias("content")))


def prompt_prefix(text, dataset: str) -> F.Column:
    """Pubmed prompts are the question (text before the
    separator); other datasets use the first 30 word tokens."""
    if dataset == "pubmed":
        return T.before_separator(text)
    return T.first_words(text, PROMPT_TOKENS)


def finish_pairs(df: DataFrame, dataset: str, original: str = "original", reply: str = "reply",
                 prefix: str = "prefix") -> DataFrame:
    """X13 + E19 + E11/E12 + E13: repair the reply's prefix, accept replies
    with enough words (per row, not per batch), clean the pubmed pair and
    trim both sides to the shorter one."""
    s = T.prefix_repair(reply, prefix)
    o = F.col(original)
    if dataset == "pubmed":
        s = T.truncate_at_occurrence(s, "Question:", 2)
        o = T.replace_separator(o)
    x = df.withColumn("_o", o).withColumn("_s", s)
    x = x.withColumn("accepted", T.word_count("_s") >= MIN_WORDS.get(dataset, MIN_WORDS["default"]))
    a, b = T.trim_pair_to_shorter("_o", "_s")
    return x.withColumn("original_out", a).withColumn("sampled_out", b).drop("_o", "_s")


def perturbed(text, k: int = 3) -> F.Column:
    """F7 fixture arrays: ``k`` word-dropped variants of a text (drop word
    i, i = 1..k, in ``split()`` words)."""
    ws = T.words(text)
    return F.array(*[F.array_join(F.concat(F.slice(ws, 1, i - 1),
                                           F.slice(ws, i + 1, F.greatest(F.size(ws) - i, F.lit(0)))), " ")
                     for i in range(1, k + 1)])
