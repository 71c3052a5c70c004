"""Decisions around a question as Column expressions: rewriting, checks, searches outside, refusals, cache keys, retries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import INJECTION_BLOCK, INJECTION_RULES, injection_score

# Words, texts and bounds whose results must agree with the system this engine replaces.
REWRITE_HINTS = ("它", "他", "她", "这个", "那个", "该", "此", "刚才", "上面", "以上", "这些", "那些", "呢")
REFUSAL = "抱歉，知识库中暂无与「{}」相关的可靠资料，为避免给出无依据的回答，本次不回答。\n\n建议：\n1. 换一种问法，或提供更具体的症状/场景描述；\n2. 健康问题请咨询专业医师或营养师。"
MODE_HINT = "\n\n💡 本次未开启「深度思考」。该问题涉及伤病/复杂分析，开启后可获得更深入的分析（耗时更长）。"
EXTERNAL_CTX_CHARS = 200
QUESTION_CHARS, SESSION_CHARS, PROFILE_CHARS = 1200, 64, 500
VOTES = ("up", "down")
PREVIEW_CHARS, LOG_CHARS = 150, 120
SUMMARY_LABELS = {"muscle": "肌群", "equipment": "器械", "difficulty": "难度"}
UNKNOWN_SOURCE = "未知"


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(False)


def needs_rewrite(text: Column, turns: Column, found: Column, plan_words: Sequence[str], hints: Sequence[str] = REWRITE_HINTS) -> Column:
    """After some history, a question that points back, or names no entity and asks for no plan. found: entities()."""
    return (turns > 0) & (_any(text, hints) | ((F.size(found) == 0) & ~_any(text, plan_words)))


def needs_fact_check(found: Column, engine: bool = True, injury: str = "injury", part: str = "body_part") -> Column:
    return F.lit(engine) & (found[injury].isNotNull() | found[part].isNotNull())


def needs_external(found: Column, text: Column, known: Column, ctx_chars: Column, words: Sequence[str], injury: str = "injury") -> Column:
    """An injury without known actions, with a short context, or with a word that asks for news. known: number of actions."""
    return found[injury].isNotNull() & ((known == 0) | (ctx_chars < EXTERNAL_CTX_CHARS) | _any(text, words))


def forbidden_request(text: Column, actions: Column) -> Column:
    """The longest, then first by name, of the forbidden actions of two characters or more that the text names; else null."""
    named = F.filter(actions, lambda a: (F.char_length(a) >= 2) & F.contains(text, a))
    return F.get(F.array_sort(F.transform(named, lambda a: F.struct((-F.char_length(a)).alias("n"), a.alias("a")))), F.lit(0))["a"]


def refusal(question: Column, template: str = REFUSAL) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), question, F.lit(after))


def mode_hint(tier: Column, deep: Column, hint: str = MODE_HINT) -> Column:
    return F.when(tier.isin("injury", "plan") & ~deep, hint).otherwise("")


def cache_key(question: Column, found: Column, deep: Column, version: str, fingerprint: Column, profile: Column | None = None) -> Column:
    """md5 of the stripped question and, sorted by code point, its entities and tags; profile, where given and not empty, is a tag too."""
    tags = [F.concat(F.lit("mode:"), F.when(deep, "deep").otherwise("fast")), F.lit(f"pv:{version}"), F.concat(F.lit("cd:"), fingerprint)]
    if profile is not None:
        tags.append(F.when(F.char_length(profile) > 0, F.concat(F.lit("profile:"), F.substring(F.md5(profile.cast("binary")), 1, 8))))
    names = F.concat(F.flatten(F.map_values(found)), F.array_compact(F.array(*tags)))
    return F.md5(F.concat(F.trim(question), F.lit("|"), F.array_join(F.array_sort(names), ",")).cast("binary"))


def retry_after(header: Column) -> Column:
    """Seconds that a provider asks to wait, 0 at least; null where the header is missing or no number."""
    seconds = header.try_cast("double")
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def backoff(attempt: Column, header: Column, delays: Sequence[float]) -> Column:
    """The provider's wait if it names one, else the delay of this attempt (from 0); later ones take the last."""
    at = F.least(F.greatest(attempt, F.lit(0)), F.lit(len(delays) - 1)).cast("int")
    return F.coalesce(retry_after(header), F.get(F.array(*[F.lit(float(d)) for d in delays]), at))


def request_faults(question: Column, session: Column, profile: Column, vote: Column) -> Column:
    """Names of the fields that a request may not have so; an empty array passes. profile and vote may be null."""
    n = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    faults: Mapping[str, Column] = {
        "question": ~n(question).between(1, QUESTION_CHARS), "session": ~n(session).between(1, SESSION_CHARS),
        "profile": n(profile) > PROFILE_CHARS, "vote": vote.isNotNull() & ~vote.isin(*VOTES),
    }
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in faults.items()]))


def input_guard(fields: Mapping[str, Column], flagged: Column | None = None, rules: Sequence[tuple[str, int]] = INJECTION_RULES, block: int = INJECTION_BLOCK) -> Column:
    """struct(blocked, kind, score, fields): injection, scored over all fields, is looked at before moderation. fields: the names, sorted, of those that match.

    flagged: what a moderation plug-in said of the row, null where it said nothing (which passes); it counts only where no injection is found."""
    score = injection_score(list(fields.values()), rules)
    hits = F.array_sort(F.array_compact(F.array(*[F.when(injection_score([c], rules) > 0, name) for name, c in fields.items()])))
    injected = score >= block
    kind = F.when(injected, "injection")
    kind = kind.when(F.coalesce(flagged, F.lit(False)), "moderation") if flagged is not None else kind
    named = F.when(injected, hits).otherwise(F.array().cast("array<string>"))
    return F.struct(kind.isNotNull().alias("blocked"), kind.alias("kind"), score.alias("score"), named.alias("fields"))


def forbidden_precheck(answer: Column, actions: Column) -> Column:
    """The forbidden actions that an answer has in it, in their order; any of them fails a fact check before a model is asked. A null answer has none."""
    return F.filter(F.coalesce(actions, F.array().cast("array<string>")), lambda a: F.coalesce(F.contains(answer, a), F.lit(False)))


def chunk_summary(meta: Column, text: Column, labels: Mapping[str, str] = SUMMARY_LABELS, name: str = "exercise", preview: int = PREVIEW_CHARS) -> Column:
    """A chunk in one line: its name in brackets and its labelled metadata; without a name the text's first characters on one line."""
    value = lambda k: F.when(F.char_length(meta[k]) > 0, meta[k])
    head = F.concat(F.lit("["), value(name), F.lit("]"))
    rest = [F.concat(F.lit(f" {label}:"), value(k)) for k, label in labels.items()]
    line = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    short = F.concat(F.substring(line, 1, preview), F.when(F.char_length(line) > preview, "...").otherwise(""))
    return F.when(value(name).isNotNull(), F.concat(head, *[F.coalesce(r, F.lit("")) for r in rest])).otherwise(short)


def log_entry(source: Column, page: Column, score: Column, text: Column, unknown: str = UNKNOWN_SOURCE) -> Column:
    """struct(source, page, score, snippet) of a hit for the retrieval log: the score with four decimals, the text's first 120 characters on one line."""
    snippet = F.substring(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), 1, LOG_CHARS)
    return F.struct(F.coalesce(source, F.lit(unknown)).alias("source"), page.alias("page"), F.round(score, 4).alias("score"), snippet.alias("snippet"))


def message_role(role: Column) -> Column:
    """human and ai are user and assistant; what isn't known is a user's."""
    return F.when(role == "human", "user").when(role == "ai", "assistant").when(role.isin("system", "user", "assistant"), role).otherwise("user")


def expectation_faults(expected: Mapping[str, Column], seen: Mapping[str, Column]) -> Column:
    """Names of the expectations of a demonstrated case that what was seen of it doesn't meet. An expectation that is null, false, 0 or empty asks for nothing.

    expected: blocked, refusal, answered, no_docs (booleans), min_docs, cites_kind, contains and excludes (arrays of words). seen: blocked, refusal, n_docs,
    kinds (of its citations), sources (their names) and snippets, both arrays. Words to be found may be in a name or a snippet; excluded ones count in names only."""
    none = F.array().cast("array<string>")
    on = lambda name: F.coalesce(expected[name], F.lit(False)) if name in expected else F.lit(False)
    words = lambda name: F.coalesce(expected[name], none) if name in expected else none
    has = lambda name: F.coalesce(seen[name], F.lit(False)) if name in seen else F.lit(False)
    told = lambda name: F.coalesce(seen[name], none) if name in seen else none
    docs = F.coalesce(seen["n_docs"], F.lit(0)) if "n_docs" in seen else F.lit(0)
    names = F.array_join(told("sources"), " ")
    blob = F.concat_ws(" ", names, F.array_join(told("snippets"), " "))
    faults = [
        F.when(on("blocked") & ~has("blocked"), "blocked"), F.when(on("refusal") & ~has("refusal"), "refusal"), F.when(on("answered") & has("refusal"), "answered"), F.when(on("no_docs") & (docs > 0), "no_docs"),
    ]
    if "min_docs" in expected:
        faults.append(F.when(docs < F.coalesce(expected["min_docs"], F.lit(0)), "min_docs"))
    if "cites_kind" in expected:
        faults.append(F.when((expected["cites_kind"] != "") & ~F.array_contains(told("kinds"), expected["cites_kind"]), "cites_kind"))
    lacks = F.transform(F.filter(words("contains"), lambda w: ~F.contains(blob, w)), lambda w: F.concat(F.lit("contains:"), w))
    bad = F.transform(F.filter(words("excludes"), lambda w: F.contains(names, w)), lambda w: F.concat(F.lit("excludes:"), w))
    return F.concat(F.array_compact(F.array(*faults)), lacks, bad)
