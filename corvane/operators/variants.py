"""Variants of a question by text generation, which is a plug-in, and the merge of what they find.

A generator takes a batch of prompts and returns an answer for each, null where it has none. If a batch fails, its prompts are asked one
by one, so that only those that fail themselves are lost. Every row gets an outcome: `ok`, `kept` where the answer is no use, or `error`;
in the latter two the text is the original question, so that there is always something to search with.

Defined cases: a null question gives no variant; answers of white space alone are no use; no questions give no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.retrieval import top_k

Generator = Callable[[list[str]], Sequence[str | None]]

#: The least characters of a drafted document, the most of a rewritten question, sub-questions, merged texts, turns of history.
DRAFT_LEAST, REWRITE_MOST, SUB_QUESTIONS, MERGED, TURNS = 20, 200, 4, 12, 6
#: Fixed value: the number before a sub-question.
NUMBERED = r"^\d+[.、)\s\-]+"
#: Kinds of a compound question's variants in order, and of any other's.
COMPOUND, SINGLE = ("draft", "step_back", "sub_question"), ("draft",)
BATCH = 32


def generate(rows: DataFrame, prompt: str, original: str, generator: Generator, least: Column | int = 1, most: int | None = None, quotes: bool = False) -> DataFrame:
    """rows with text and outcome. Answers are trimmed (and freed of quotes); those of fewer than least characters or more than most are no use."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def ask(prompts: list[str]) -> list[tuple[str | None, bool]]:
        try:
            answers = list(generator(prompts))
            if len(answers) != len(prompts):
                raise ValueError("a generator answers each prompt once")
            return [(a, False) for a in answers]
        except Exception:  # whatever a plug-in raises
            return [(None, True)] if len(prompts) == 1 else [answer for p in prompts for answer in ask([p])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = batch["_prompt"].tolist()
            told = [a for k in range(0, len(prompts), BATCH) for a in ask(prompts[k : k + BATCH])]
            yield batch.drop(columns=["_prompt"]).assign(_answer=pd.Series([a for a, _ in told], dtype=object, index=batch.index), _failed=pd.Series([f for _, f in told], dtype=bool, index=batch.index))

    asked = rows.withColumn("_prompt", F.col(prompt)).filter(F.col("_prompt").isNotNull())
    answered = asked.mapInPandas(run, f"{fields}, _answer string, _failed boolean")
    space = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    answer = space(F.col("_answer"))
    answer = space(F.regexp_replace(F.regexp_replace(answer, '^"+|"+$', ""), "^'+|'+$", "")) if quotes else answer
    size = F.char_length("_clean")
    use = F.col("_clean").isNotNull() & (size >= (F.lit(least) if isinstance(least, int) else least)) & (size >= 1)
    use = use & (size <= most) if most is not None else use
    outcome = F.when(F.col("_failed"), "error").when(use, "ok").otherwise("kept")
    out = answered.withColumn("_clean", answer).withColumn("outcome", outcome)
    return out.withColumn("text", F.when(F.col("outcome") == "ok", F.col("_clean")).otherwise(F.col(original))).drop("_answer", "_failed", "_clean")


def variants(questions: DataFrame, qkey: str, question: str, compound: Column, templates: Mapping[str, str], generator: Generator) -> DataFrame:
    """qkey, pos, kind, outcome and text: a drafted document for each question; for compound ones a step back and up to four sub-questions too.

    templates: a prompt for each kind, with {question} where it goes."""
    kinds = F.when(compound, F.array(*[F.lit(k) for k in COMPOUND])).otherwise(F.array(*[F.lit(k) for k in SINGLE]))
    rows = questions.filter(F.col(question).isNotNull()).select(qkey, F.col(question).alias("_question"), F.posexplode(kinds).alias("_k", "kind"))
    template = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in templates.items()])
    told = generate(rows.withColumn("_ask", F.replace(template, F.lit("{question}"), F.col("_question"))), "_ask", "_question", generator, F.when(F.col("kind") == "draft", DRAFT_LEAST).otherwise(1))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), NUMBERED, ""))), lambda x: x != "")
    parts = F.when((F.col("kind") == "sub_question") & (F.col("outcome") == "ok"), F.slice(lines, 1, SUB_QUESTIONS)).otherwise(F.array("text"))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array("_question"))
    out = told.select(qkey, "kind", "outcome", "_k", F.posexplode(parts).alias("_n", "text"))
    return out.select(qkey, (F.col("_k") + F.col("_n")).alias("pos"), "kind", "outcome", "text")


def merge(hits: DataFrame, qkey: str, pos: str, rank: str, text: str, most: int = MERGED) -> DataFrame:
    """The hits of each question's variants in one list: equal texts once, where they came first, by variant and rank; most of them, with their place as merged_rank."""
    rest = [c for c in hits.columns if c not in (qkey, pos, rank)]
    once = hits.groupBy(qkey, F.md5(F.col(text).cast("binary")).alias("_md5")).agg(F.min(F.struct(pos, rank, *rest)).alias("_first")).select(qkey, "_first.*")
    return top_k(once, [qkey], [F.asc(pos), F.asc(rank)], most, "merged_rank")


def history_text(turns: DataFrame, key: str, order: str, role: str, text: str, most: int = TURNS) -> DataFrame:
    """key and history: the last turns as lines of role and text."""
    last = turns.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_k") <= most)
    who = F.when(F.col(role).isin("ai", "assistant"), "assistant").otherwise("user")
    line = F.struct(F.col("_k"), F.concat(who, F.lit(": "), F.coalesce(text, F.lit(""))).alias("line"))
    return last.groupBy(key).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(line))), lambda x: x["line"]), "\n").alias("history"))


def rewrite(questions: DataFrame, qkey: str, question: str, history: DataFrame, template: str, generator: Generator) -> DataFrame:
    """questions that have a history, with text and outcome: the question as it stands alone. template has {history} and {question}."""
    rows = questions.filter(F.col(question).isNotNull()).join(history.select(qkey, "history"), qkey)
    # Parted at the places, so that a text that has a place's name in it stays as it is.
    before, after = template.split("{history}")
    middle, end = after.split("{question}")
    prompt = F.concat(F.lit(before), F.col("history"), F.lit(middle), F.col(question), F.lit(end))
    return generate(rows.withColumn("_ask", prompt), "_ask", question, generator, most=REWRITE_MOST, quotes=True).drop("_ask", "history")
