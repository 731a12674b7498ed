"""Text sinks: metric reports and chat history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_lines(metrics: DataFrame) -> DataFrame:
    """One line per metric of ``metrics(metric, mean, n_valid)``."""
    empty = F.col("n_valid") == 0
    return metrics.select(
        F.format_string(
            "%s: %s, valid number : %d",
            F.col("metric"),
            F.when(empty, F.lit("0")).otherwise(F.format_string("%.4f", "mean")),
            F.col("n_valid"),
        ).alias("value")
    )


def write_report(metrics: DataFrame, path: str) -> None:
    report_lines(metrics).write.mode("append").text(path)


def chat_lines(messages: DataFrame, fmt: str = "json") -> DataFrame:
    """``conv_id, turn, value``: one export block per message.

    Blocks stay separate rows in (conv_id, turn) order, so a conversation of any
    length can be written without gathering it.
    """
    if fmt == "json":
        body = [c for c in messages.columns if c not in ("conv_id", "turn")]
        value = F.to_json(F.struct(*body))
    elif fmt == "markdown":
        name = F.when(F.col("role") == "user", "User").otherwise("Assistant")
        stamp = F.coalesce(F.col("timestamp"), F.lit(""))
        shown = (F.col("role") == "assistant") & F.coalesce(
            F.col("privacy_applied"), F.lit(False)
        )
        stats = F.when(
            shown,
            F.format_string(
                "\n**Privacy Stats:**\n- PII Detected: %d\n- Sentences Removed: %d\n",
                F.coalesce("pii_detected", F.lit(0)),
                F.coalesce("sentences_removed", F.lit(0)),
            ),
        ).otherwise(F.lit(""))
        value = F.concat(
            F.lit("## "), name, F.lit(" ("), stamp, F.lit(")\n"),
            F.col("content"), F.lit("\n"), stats, F.lit("\n---\n\n"),
        )
    else:
        raise ValueError("fmt must be json or markdown")
    return messages.select("conv_id", "turn", value.alias("value"))


def export_chat(messages: DataFrame, path: str, fmt: str = "json") -> None:
    """Write the blocks sorted by conversation and turn."""
    lines = chat_lines(messages, fmt)
    ordered = lines.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    ordered.select("value").write.mode("overwrite").text(path)
