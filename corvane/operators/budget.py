"""The token budget of a request: history first, then the end of its context, are cut until it fits a share of the model's window.

Defined cases: null texts are empty; a request without history has none to trim; a window that is null or not above 0 takes the default; a request that
fits stays as it is, whatever its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import token_estimate, truncate_sentences
from corvane.streaming.gateway import history_trim

#: The default window, the share that may be used, tokens of history, tokens left for a context, the cut that is told of, messages that stay.
WINDOW, SHARE, HISTORY, CONTEXT_LEAST, WARN, MESSAGES = 8192, 0.55, 2048, 500, 0.30, 2
MARKER = "[内容已截断]"


def guard(requests: DataFrame, turns: DataFrame, key: str, order: str, share: float = SHARE, history: int = HISTORY, least: int = CONTEXT_LEAST) -> DataFrame:
    """key, context (cut, if it must be), budget, total_before, total_after, history_tokens, action (none, trim_history, trim_context, trim_both) and warning.

    requests: key, system, question, context, window. turns: key, order, text. The history's own rows are kept_turns()."""
    sized = turns.select(key, order, token_estimate(F.col("text")).alias("_t"))
    whole = sized.groupBy(key).agg(F.sum("_t").alias("_whole"))
    kept = history_trim(sized, key, order, "_t", history, MESSAGES).groupBy(key).agg(F.sum("_t").alias("_kept"))
    zero, text = F.lit(0).cast("bigint"), lambda c: F.coalesce(F.col(c), F.lit(""))
    r = requests.join(whole, key, "left").join(kept, key, "left").select(
        key, text("context").alias("context"), (token_estimate(text("system")) + token_estimate(text("question"))).alias("_fixed"),
        token_estimate(text("context")).alias("_ctx"), F.coalesce("_whole", zero).alias("_whole"), F.coalesce("_kept", zero).alias("_kept"),
        F.floor(F.when(F.col("window") > 0, F.col("window")).otherwise(WINDOW) * F.lit(share)).cast("bigint").alias("budget"),
    )
    r = r.withColumn("total_before", F.col("_fixed") + F.col("_whole") + F.col("_ctx"))
    over = F.col("total_before") > F.col("budget")
    trimmed = over & (F.col("_whole") > history)
    r = r.withColumn("history_tokens", F.when(trimmed, F.col("_kept")).otherwise(F.col("_whole")))
    room = F.greatest(F.lit(least).cast("bigint"), F.col("budget") - F.col("_fixed") - F.col("history_tokens"))
    r = r.withColumn("_room", room).withColumn("_cut", over & (F.col("_ctx") > F.col("_room")))
    r = r.withColumn("context", F.when(F.col("_cut"), truncate_sentences(F.col("context"), F.col("_room"), MARKER)).otherwise(F.col("context")))
    after = F.col("_fixed") + F.col("history_tokens") + token_estimate(F.col("context"))
    action = F.when(trimmed & F.col("_cut"), "trim_both").when(F.col("_cut"), "trim_context").when(trimmed, "trim_history").otherwise("none")
    r = r.withColumn("total_after", after).withColumn("action", action)
    warning = over & (1 - F.col("total_after") / F.greatest("total_before", F.lit(1)) >= WARN)
    return r.select(key, "context", "budget", "total_before", "total_after", "history_tokens", "action", warning.alias("warning"))


def kept_turns(turns: DataFrame, guarded: DataFrame, key: str, order: str, history: int = HISTORY) -> DataFrame:
    """turns without those that guard() took from a history: the newest that fit it stay, two messages at least, where its request was trimmed."""
    trimmed = guarded.filter(F.col("action").isin("trim_history", "trim_both")).select(key, F.lit(True).alias("_trimmed"))
    told = turns.withColumn("_t", token_estimate(F.col("text")))
    short = history_trim(told.join(trimmed.select(key), key, "left_semi"), key, order, "_t", history, MESSAGES).drop("_t")
    return turns.join(trimmed.select(key), key, "left_anti").unionByName(short)
