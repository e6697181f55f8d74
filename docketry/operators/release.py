"""What may leave: release decisions, prepared prompts and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.pii import (
    blocked_category, merge_counts, prompt_build, prompt_type_union, sanitize_text, sensitivity_level,
)
from docketry.operators.access import holds_any


def may_escalate(keys: Column) -> Column:
    return holds_any(keys, [F.lit(k) for k in vocab.ESCALATION_KEYS])


def external_release_policy(
    requests: DataFrame, keys: DataFrame, configured: bool, mode: str,
    categories: list[str] = vocab.BLOCKED_CATEGORIES,
) -> DataFrame:
    """requests(user_id, text, ...) with allowed, reason and category; the first refusal counts."""
    joined = requests.join(keys.select("user_id", "keys"), "user_id", "left").withColumn(
        "found", blocked_category(F.col("text"), categories))
    reason = (
        F.when(F.lit(not configured), "openai_not_configured")
        .when(F.lit(mode == "disabled"), "escalation_disabled")
        .when(~may_escalate(F.col("keys")), "user_not_permitted")
        .when(F.col("found").isNotNull(), "blocked_category")
        .otherwise("ok")
    )
    decided = joined.withColumn("reason", reason)
    return decided.select(
        *requests.columns, (F.col("reason") == "ok").alias("allowed"), "reason",
        F.when(F.col("reason") == "blocked_category", F.col("found")).alias("category"))


def needs_escalation(answers: DataFrame, keys: DataFrame, configured: bool, mode: str) -> DataFrame:
    """answers(user_id, ok, ...) with needs_escalation: weak, and the user may ask outside."""
    available = F.lit(configured and mode in ("manual", "automatic"))
    joined = answers.join(keys.select("user_id", "keys"), "user_id", "left")
    return joined.select(*answers.columns, (
        ~F.col("ok") & available & may_escalate(F.col("keys"))).alias("needs_escalation"))


def prepare_escalations(requests: DataFrame) -> DataFrame:
    """requests(request_id, user_id, conversation_id, question, context, problem) ->
    masked prompt, kinds of data found and their sensitivity."""
    def part(name: str, default: str | None) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        return sanitize_text(text if default is None else F.when(text == "", default).otherwise(text))

    masked = requests.select(
        "request_id", "user_id", "conversation_id", part("question", None).alias("q"),
        part("context", vocab.DEFAULT_CONTEXT).alias("c"), part("problem", vocab.DEFAULT_PROBLEM).alias("p"))
    counts = [F.col(x)["counts"] for x in ("q", "c", "p")]
    return masked.select(
        "request_id", "user_id", "conversation_id",
        prompt_build(F.col("p.text"), F.col("c.text"), F.col("q.text")).alias("prompt"),
        prompt_type_union(*counts).alias("types"),
        sensitivity_level(merge_counts(*counts)).alias("sensitivity"))


def escalation_event_record(prepared: DataFrame, reason: str = "Local model low confidence") -> DataFrame:
    """What is kept of a prepared prompt; never its text."""
    return prepared.select(
        "user_id", "conversation_id", F.lit(reason).alias("reason"),
        F.col("sensitivity").alias("data_sensitivity"), F.col("types").alias("sensitive_types_detected"),
        F.lit(True).alias("prompt_generated"))
