"""Transcripts to turns, first question/answer pairs and the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import first_per_key
from ..functions.text import clean_message, strip

TAGS = (("Customer:", "customer"), ("Support:", "support"))


def turns_of(raw: Column) -> Column:
    """Transcript text to ``array<struct<role,text>>``; untagged parts are dropped."""
    parts = F.transform(
        F.split(strip(raw), r"\n(?=(?:Customer|Support):)"), lambda part: strip(part)
    )

    def tagged(part):
        (c_tag, c_role), (s_tag, s_role) = TAGS
        role = F.when(part.startswith(c_tag), c_role).when(part.startswith(s_tag), s_role)
        body = F.when(part.startswith(c_tag), F.substring(part, len(c_tag) + 1, 2**31 - 1)).otherwise(
            F.substring(part, len(s_tag) + 1, 2**31 - 1)
        )
        return F.struct(role.alias("role"), strip(body).alias("text"))

    return F.filter(F.transform(parts, tagged), lambda t: t["role"].isNotNull())


def parse_turns(df: DataFrame, id_col: str = "conversation_id", text_col: str = "conversation") -> DataFrame:
    """One row per turn: (id, pos, role, text)."""
    return df.select(
        id_col, F.posexplode(turns_of(F.col(text_col))).alias("pos", "turn")
    ).select(id_col, "pos", "turn.role", "turn.text")


def first_pair_of(turns: Column) -> Column:
    """First customer text (cleaned) and the first support text after it, from a turn array."""
    def place_of(array, role):
        return F.array_position(F.transform(array, lambda t: t["role"]), role).cast("int")

    asked_at = place_of(turns, "customer")
    later = F.slice(turns, asked_at + 1, F.size(turns))
    answered_at = place_of(later, "support")
    return F.struct(
        clean_message(F.get(turns, asked_at - 1)["text"]).alias("first_customer_msg"),
        F.get(later, answered_at - 1)["text"].alias("first_support_reply"),
    )


def extract_conversations(
    transcripts: DataFrame,
    brand: str | None = None,
    min_customer_len: int = 20,
    min_support_len: int = 15,
    max_conversations: int | None = None,
) -> DataFrame:
    """Transcripts of one brand with at least two turns and a usable first pair.

    ``transcripts`` has (company, conversation, conversation_id). A maximum keeps the first
    conversations by id.
    """
    kept = transcripts if brand is None else transcripts.where(F.col("company") == brand)
    out = (
        # a one-element explode keeps the filters below from parsing the text a second time
        kept.select(
            "conversation_id", "conversation",
            F.explode(F.array(turns_of(F.col("conversation")))).alias("turns"),
        )
        .where(F.size("turns") >= 2)
        .withColumn("__pair", first_pair_of(F.col("turns")))
        .select(
            "conversation_id",
            F.col("conversation").alias("full_conversation"),
            "turns",
            "__pair.first_customer_msg",
            "__pair.first_support_reply",
            F.size("turns").alias("num_turns"),
        )
        .where(usable_pair(min_customer_len, min_support_len))
    )
    if max_conversations is not None:
        out = out.orderBy("conversation_id").limit(max_conversations)
    return out


def usable_pair(min_customer_len: int = 20, min_support_len: int = 15) -> Column:
    """Both messages present and long enough, counted in characters."""
    return (
        (F.length("first_customer_msg") >= max(min_customer_len, 1))
        & (F.length("first_support_reply") >= max(min_support_len, 1))
    )


def first_pairs_from_turns(
    turns: DataFrame,
    min_customer_len: int = 20,
    min_support_len: int = 15,
    stretch: int = 10_000,
) -> DataFrame:
    """The same pairs from a turn table (conversation_id, pos, role, text), ``pos`` counting turns.

    Only aggregations combined on the map side, and a join on stretches of turns, so that a
    conversation with a very large number of turns is never gathered into one task. A usual
    conversation is one stretch.
    """
    useful = turns.where(F.col("role").isin("customer", "support"))
    openings = (
        useful.groupBy("conversation_id")
        .agg(
            F.min(F.when(F.col("role") == "customer", F.col("pos"))).alias("asked_at"),
            F.max("pos").alias("ends_at"),
            F.count("*").cast("int").alias("num_turns"),
        )
        .where((F.col("num_turns") >= 2) & F.col("asked_at").isNotNull())
    )

    def stretch_of(c):
        return F.floor(F.col(c) / F.lit(stretch))

    spread = openings.withColumn(
        "part", F.explode(F.sequence(stretch_of("asked_at"), stretch_of("ends_at")))
    ).drop("ends_at")
    parted = useful.withColumn("part", stretch_of("pos"))
    asked = F.when(F.col("role") == "customer", F.col("text"))
    answered_at = F.when(F.col("role") == "support", F.col("pos"))
    parts = (
        parted.join(spread, ["conversation_id", "part"])
        .where(
            ((F.col("role") == "customer") & (F.col("pos") == F.col("asked_at")))
            | ((F.col("role") == "support") & (F.col("pos") > F.col("asked_at")))
        )
        .groupBy("conversation_id", "part")
        .agg(
            F.first("num_turns").alias("num_turns"),
            F.max(asked).alias("asked"),
            F.min(answered_at).alias("answered_at"),
            F.min_by("text", answered_at).alias("answer"),
        )
    )
    pairs = parts.groupBy("conversation_id").agg(
        F.first("num_turns").alias("num_turns"),
        F.max("asked").alias("asked"),
        F.min_by("answer", "answered_at").alias("first_support_reply"),
    )
    return pairs.select(
        "conversation_id",
        clean_message(F.col("asked")).alias("first_customer_msg"),
        "first_support_reply",
        "num_turns",
    ).where(usable_pair(min_customer_len, min_support_len))


def build_knowledge_base(
    conversations: DataFrame, max_pairs: int | None = None, order_key: str = "conversation_id"
) -> DataFrame:
    """One entry per distinct customer message (by MD5), the earliest by ``order_key``."""
    hashed = conversations.select(
        F.md5("first_customer_msg").alias("__md5"),
        F.col(order_key).alias("__order"),
        F.col("conversation_id").alias("id"),
        F.col("first_customer_msg").alias("customer_query"),
        F.col("first_support_reply").alias("support_response"),
        "num_turns",
    )
    kb = first_per_key(hashed, ["__md5"], ["__order"])
    if max_pairs is not None:
        kb = kb.orderBy("__order").limit(max_pairs)
    return kb.select("id", "customer_query", "support_response", "num_turns")
