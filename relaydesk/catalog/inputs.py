"""How the registered queries read the given tables, and the rule pack they use.

The default pack's support vocabulary hardly occurs in the given prose, so the queries run the
same operators with a pack of terms that do.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..rules import SUPPORT_PACK, Factor
from ..sources.tables import spread

_REASON = {f.name: f.reason for f in SUPPORT_PACK.factors}

PACK = replace(
    SUPPORT_PACK,
    taxonomy=(
        ("software_troubleshooting", ("thble", "hash", "stre", "ndhe", "heitun")),
        ("battery_power", ("erwh", "ealy", "tzge", "lasque")),
        ("connectivity", ("thinou", "ingha", "éeau", "rrque", "tionth")),
        ("account_security", ("the the", "que la", "der die")),
        ("hardware_damage", ("schie", "ungsch", "queau", "erst ")),
        ("billing_store", ("nt of", "mentre", "auxque", "for a", "wither")),
    ),
    gold_triggers=(
        (SUPPORT_PACK.gold_triggers[0][0], ("token = ", "@mail")),
        (SUPPORT_PACK.gold_triggers[1][0], ("schie", "queau")),
        (SUPPORT_PACK.gold_triggers[2][0], ("is that", "erble")),
    ),
    sarcasm=("onre", "retion"),
    factors=(
        Factor("PII_EXPOSURE", 0.40, None, _REASON["PII_EXPOSURE"],
               (r"[a-z0-9]+@[a-z0-9]+\.example\.com", r"\+1 \([0-9]{3}\)", "token = ")),
        Factor("ACCOUNT_SECURITY", 0.35, "account_security", _REASON["ACCOUNT_SECURITY"],
               (r"th(at|is)\s+(the|of)", r"que\s+la")),
        Factor("HARDWARE_DAMAGE", 0.30, "hardware_damage", _REASON["HARDWARE_DAMAGE"],
               (r"(der|die)\s+(en|er)", r"schie")),
        Factor("HIGH_FRUSTRATION", 0.25, None, _REASON["HIGH_FRUSTRATION"],
               (r"is\s*that", r"ou[a-z]{2}ou")),
        Factor("BILLING_DISPUTE", 0.20, "billing_store", _REASON["BILLING_DISPUTE"],
               (r"license|copyright", r"(erst|est)\s+th")),
    ),
)

# the document sources as labels of a second dataset: 18 mapped, one stray key, two unmapped
SOURCE_MAP = tuple(
    (f"src{i}", PACK.intents[i % 5 if i % 3 else 5]) for i in range(18)
) + (("src_retired", "connectivity"),)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their long texts, over all cores."""
    return spread(read(spark, sf_dir, "documents"), "doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation table as (conversation_id, pos, role, text)."""
    role = F.col("role")
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("pos"),
        F.when(role == "user", "customer").when(role == "assistant", "support").otherwise(role).alias("role"),
        "text",
    )


def turn_id(turn: str) -> Column:
    """One number for a conversation and a turn of it, different for all turns below 2**32."""
    return F.col("conv_id") * (1 << 32) + F.col(turn)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer turns as (id, text)."""
    return read(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        turn_id("turn").alias("id"), "text"
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer turn with the support turn after it, as conversations with one pair."""
    t = read(spark, sf_dir, "conversations")
    asked = t.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("at"), F.col("text").alias("first_customer_msg")
    )
    answered = t.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("at"), F.col("text").alias("first_support_reply")
    )
    return asked.join(answered, ["conv_id", "at"]).select(
        turn_id("at").alias("conversation_id"),
        "first_customer_msg",
        "first_support_reply",
        F.lit(2).alias("num_turns"),
    )


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every support turn with the next one two turns later: (id, response, reference, decision)."""
    t = read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    first = t.select("conv_id", "turn", F.col("text").alias("response"))
    later = t.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("reference"))
    return first.join(later, ["conv_id", "turn"]).select(
        turn_id("turn").alias("id"),
        "response",
        "reference",
        F.when(F.col("turn") % 4 == 1, "ESCALATE").otherwise("AUTO_HANDLE").alias("decision"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts: lines are turns, customer and support in alternation, with
    mentions before the first message and an untagged line before English ones."""
    line = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(
            F.when(i == 0, "Customer: @help @desk  ").when(i % 2 == 0, "Customer: ").otherwise("Support: "), x
        ),
    )
    return documents(spark, sf_dir).select(
        F.col("lang").alias("company"),
        F.concat(F.when(F.col("lang") == "en", "ticket opened\n").otherwise(""),
                 F.array_join(line, "\n")).alias("conversation"),
        F.col("doc_id").alias("conversation_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec")
    )


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a labelled dataset, the source being the label."""
    return read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("label_name"))


def language_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, agent_name, truth, pred): the language of a document guessed by three rules."""
    t = F.lower("text")
    has = lambda s: F.contains(t, F.lit(s))
    first = F.when(has(" the "), "en").when(has(" die "), "de").when(has(" que "), "es").when(has(" le "), "fr").otherwise("xx")
    second = F.when(has("ß") | has("ü"), "de").when(has("ñ"), "es").when(has("é"), "fr").otherwise("en")
    guesses = F.array(
        F.struct(F.lit("words").alias("agent_name"), first.alias("pred")),
        F.struct(F.lit("letters").alias("agent_name"), second.alias("pred")),
        F.struct(F.lit("constant").alias("agent_name"), F.lit("en").alias("pred")),
    )
    return documents(spark, sf_dir).select(
        "doc_id", F.col("lang").alias("truth"), F.explode(guesses).alias("g")
    ).select("doc_id", "truth", "g.agent_name", "g.pred")
