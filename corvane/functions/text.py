"""Text functions as Column expressions: estimates, snippets, quality, safety rules. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Classes of characters, rules and thresholds whose results must agree with the system this engine replaces.
HAN = "[一-鿿]"
VALID_CHARS = r"[一-鿿A-Za-z0-9，。、；：？！“”‘’（）【】《》…—·,.;:?!()\[\]<>%+\-*/=@#&_\s]"
SENTENCE_ENDS = "[。！？；!?;]"
SNIPPET_TAIL = r"[\d，,.;；。:：\-—]+$"
NEGATIONS = ("避免", "不要", "禁止", "不建议", "切勿", "严禁", "不宜", "不做")
EQUIPMENT_SUFFIXES = "机凳架垫器绳"
INJECTION_RULES = (
    (r"(忽略|无视|忘记|放弃|不再遵守|绕过)[^\n。]{0,12}(指令|规则|约束|提示|设定|要求|系统)", 3),
    (r"(扮演|你现在是|从现在起你是)[^\n。]{0,20}(不受(约束|限制)|无限制|开发者模式|任何角色)", 3),
    (r"(ignore|disregard|forget|bypass)\s+(all\s+)?(previous|prior|above|your)", 3),
    (r"(system\s*prompt|系统提示词|开发者指令|隐藏指令|初始指令)", 2),
    (r"(输出|打印|展示|泄露|说出)(你的|系统的)?(提示词|指令|prompt)", 2),
    (r"(DAN\s?模式|越狱|jailbreak|developer\s*mode)", 2),
    (r"请?用(中文|英文)?重复(你的|上述)?(指令|提示词)", 2),
)
INJECTION_BLOCK = 4
# Failures of a provider: kinds in the order in which they are looked for, names of types, words of messages, kinds worth another try.
ERROR_KINDS = ("timeout", "rate_limited", "auth", "quota", "context_overflow", "server", "network")
ERROR_NAMES = {
    "timeout": ("APITimeoutError", "ReadTimeout", "ConnectTimeout", "WriteTimeout", "TimeoutException"), "rate_limited": ("RateLimitError",), "auth": ("AuthenticationError",),
    "network": ("APIConnectionError", "ConnectionError", "ConnectError", "NetworkError", "RemoteProtocolError"),
}
ERROR_WORDS = {
    "timeout": ("timeout", "timed out"), "rate_limited": ("throttling", "rate limit"), "auth": ("invalid api key",), "quota": ("arrearage", "欠费", "insufficient_quota", "quota exceeded", "额度不足"),
    "context_overflow": ("maximum context", "too many tokens", "input length"), "network": ("connection",),
}
KEY_WORDS, OVERFLOW_WORDS = "invalidapikey", (("context",), ("length", "exceed", "超长", "太长"))
RETRYABLE = ("timeout", "rate_limited", "server", "network")
# Numbers that a person tells: height, weight, age.
HEIGHT, WEIGHT, AGE = r"身高\s*(\d{2,3})\s*(?:cm|厘米|公分)?", r"体重\s*(\d{1,3}(?:\.\d)?)\s*(?:kg|公斤)?", r"(\d{1,3})\s*岁"
GARBLE_MIN_CHARS, GARBLE_VALID, GARBLE_COVERAGE, GARBLE_REPEAT = 10, 0.6, 0.35, 0.3

SPACES = r"[\t\n\x0B\f\r ]"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit("\t\n\x0b\f\r "))


def token_estimate(text: Column) -> Column:
    """Han characters count 1.5 tokens, others 0.3; rounded down."""
    han = F.char_length(text) - F.char_length(F.regexp_replace(text, f"{HAN}+", ""))
    return F.coalesce(F.floor(han * F.lit(1.5) + (F.char_length(text) - han) * F.lit(0.3)), F.lit(0)).cast("bigint")


def valid_ratio(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(text, f"{VALID_CHARS}+", ""))) / n).otherwise(0.0)


def character_counts(text: Column) -> Column:
    """struct(valid, most): how many characters are valid ones, and how often the commonest is there. A count over characters has no built-in function that
    isn't one pass for each distinct one, so it is an Arrow one, which counts the valid ones in the same pass."""

    def counts(texts: pd.Series) -> pd.DataFrame:
        import numpy as np

        valid = _valid_points()

        def one(text: str | None) -> tuple[int, int]:
            points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            high = points[points > 0xFFFF]  # characters beyond the first plane are few, none is valid, and they are sorted
            low = points[points <= 0xFFFF] if high.size else points
            most = max(np.bincount(low).max(initial=0), np.unique(high, return_counts=True)[1].max(initial=0))
            return int(np.count_nonzero(valid[low])), int(most)

        return pd.DataFrame([one(t) for t in texts], columns=["valid", "most"])

    return F.pandas_udf(counts, "valid int, most int")(F.coalesce(text, F.lit("")))


@cache
def _valid_points():
    """Of each character of the first plane, whether it is one of VALID_CHARS."""
    import re

    import numpy as np

    return np.array([re.fullmatch(VALID_CHARS, chr(c), re.ASCII) is not None for c in range(0x10000)])


def repetition_ratio(text: Column) -> Column:
    """Share of the commonest character."""
    n = F.char_length(text)
    return F.when(n > 0, character_counts(text)["most"] / n).otherwise(0.0)


def is_garbled(text: Column, coverage: Column | None = None) -> Column:
    """coverage: share of dictionary words among the text's words, where a vocabulary is joined."""
    t = stripped(F.coalesce(text, F.lit("")))
    n, counts = F.char_length(t), character_counts(t)
    share = lambda part: counts[part] / F.greatest(n, F.lit(1))
    bad = (n < GARBLE_MIN_CHARS) | (share("valid") < GARBLE_VALID) | (share("most") > GARBLE_REPEAT)
    return bad | (coverage < GARBLE_COVERAGE) if coverage is not None else bad


def clean_snippet(text: Column, limit: int = 120) -> Column:
    """White space collapsed, trailing numbers and stops dropped, cut after the last sentence if it keeps half, else hard with an ellipsis."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", " ")), SNIPPET_TAIL, ""))
    cut = F.substring(t, 1, limit)
    whole = F.regexp_extract(cut, f"^(.*{SENTENCE_ENDS})", 1)
    return F.when(F.char_length(t) <= limit, t).when(F.char_length(whole) >= limit * 0.5, whole).otherwise(F.concat(cut, F.lit("…")))


def injection_score(fields: Sequence[Column], rules: Sequence[tuple[str, int]] = INJECTION_RULES) -> Column:
    """Sum over fields of the weights of the rules that match."""
    total = F.lit(0)
    for field in fields:
        for pattern, weight in rules:
            total = total + F.when(F.coalesce(field, F.lit("")).rlike(f"(?i){pattern}"), weight).otherwise(0)
    return total


def injection_hits(field: Column, rules: Sequence[tuple[str, int]] = INJECTION_RULES) -> Column:
    """(rule number, matched text) of each rule that matches."""
    found = [F.when(field.rlike(f"(?i){p}"), F.struct(F.lit(k).alias("rule"), F.regexp_extract(field, f"(?i)({p})", 1).alias("matched"))) for k, (p, _) in enumerate(rules)]
    return F.array_compact(F.array(*found))


def redact_line(text: Column, marker: str, with_: str = "[redacted]") -> Column:
    """What follows marker on its line."""
    return F.regexp_replace(text, rf"({marker})[^\n]*", f"$1{with_}")


def action_pattern(action: str) -> str:
    """A name of up to two characters isn't meant where a word for equipment goes on from it; at a line's end it is."""
    tail = f"(?![{EQUIPMENT_SUFFIXES}])" if len(action) <= 2 else ""
    return "\\Q" + action + "\\E" + tail


def hard_filter(text: Column, forbidden: Sequence[str], negations: Sequence[str] = NEGATIONS) -> Column:
    """struct(text, removed): lines that name a forbidden action, unless they warn of it, are taken out; removed: the first action of each, distinct, in order."""
    first = lambda line: F.coalesce(*[F.when(line.rlike(action_pattern(a)), F.lit(a)) for a in forbidden], F.lit(None).cast("string"))
    negated = lambda line: F.exists(F.array(*[F.lit(w) for w in negations]), lambda w: F.contains(line, w))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.when(~negated(x), first(x)).alias("hit")))
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x["hit"].isNull()), lambda x: x["line"]), "\n")
    removed = F.array_distinct(F.transform(F.filter(lines, lambda x: x["hit"].isNotNull()), lambda x: x["hit"]))
    return F.struct(kept.alias("text"), removed.alias("removed"))


def truncate_sentences(text: Column, max_tokens: int | Column, marker: str = "[truncated]") -> Column:
    """Whole sentences from the start as long as their estimates fit; a text that fits stays; where no sentence fits, a share of its characters."""
    parts = F.regexp_extract_all(text, F.lit(r"([^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+$)"), F.lit(1))
    parts = F.transform(parts, lambda p: F.struct(p.alias("part"), token_estimate(p).alias("n")))
    start = F.struct(F.lit(0).alias("parts"), F.lit(0).cast("bigint").alias("used"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        """How many parts fit; their texts are joined once, at the end."""
        fits = acc["open"] & (acc["used"] + x["n"] <= max_tokens)
        return F.struct((acc["parts"] + fits.cast("int")).alias("parts"), (acc["used"] + x["n"]).alias("used"), fits.alias("open"))

    # What is used twice is bound by a lambda over an array of one, so that it is worked out once.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    kept = once(parts, lambda ps: F.array_join(F.transform(F.slice(ps, 1, F.aggregate(ps, start, step)["parts"]), lambda x: x["part"]), ""))
    share = F.greatest(F.lit(50), F.floor(F.char_length(text) * ((max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)).cast("double") / F.greatest(token_estimate(text), F.lit(1)))).cast("int"))
    short = F.concat(F.substring(text, F.lit(1), share), F.lit("…"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(token_estimate(text) <= max_tokens, text).otherwise(once(kept, lambda k: F.when(k == "", short).otherwise(F.concat(k, F.lit(marker)))))


def bigrams(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both))


def words(text: Column) -> Column:
    """The default tokenizer: lower case, runs of letters and digits; runs of Han as their bigrams, a lone one as itself."""
    latin = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike(HAN))
    runs = F.regexp_extract_all(text, F.lit(f"({HAN}+)"), F.lit(1))
    han = F.flatten(F.transform(runs, lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.when(text.rlike(HAN), F.concat(latin, han)).otherwise(latin)


def entities(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """map type -> names found. In each type the longer names go first; one that occurs is taken once and its first occurrence leaves the text."""

    def found(names: Sequence[str]) -> Column:
        ordered = F.array(*[F.lit(n) for n in sorted(dict.fromkeys(names), key=len, reverse=True)])
        start = F.struct(text.alias("left"), F.array().cast("array<string>").alias("hits"))

        def step(acc: Column, name: Column) -> Column:
            at = F.instr(acc["left"], name)
            rest = F.concat(F.substring(acc["left"], F.lit(1), at - 1), F.substring(acc["left"], at + F.char_length(name), F.char_length(acc["left"])))
            return F.when(at > 0, F.struct(rest.alias("left"), F.concat(acc["hits"], F.array(name)).alias("hits"))).otherwise(acc)

        return F.aggregate(ordered, start, step)["hits"]

    pairs = F.array(*[F.struct(F.lit(kind).alias("key"), found(names).alias("value")) for kind, names in dictionary.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))


def standalone(text: Column, marker: str) -> Column:
    """One character anywhere; a longer marker where its first occurrence has no Han character beside it."""
    at = F.instr(text, F.lit(marker))
    if len(marker) == 1:
        return at > 0
    before, after = F.substring(text, at - 1, F.lit(1)), F.substring(text, at + len(marker), F.lit(1))
    return (at > 0) & ((at == 1) | ~before.rlike(HAN)) & ~after.rlike(HAN)


def query_class(found: Column, text: Column, markers: Sequence[str], injury: str = "injury", part: str = "body_part") -> Column:
    """simple, single_injury or compound_injury, from entities()."""
    none = F.array().cast("array<string>")
    injuries, parts = F.coalesce(F.get(F.array(found[injury]), F.lit(0)), none), F.coalesce(F.get(F.array(found[part]), F.lit(0)), none)
    extra = F.size(F.filter(parts, lambda p: ~F.exists(injuries, lambda i: F.contains(i, p))))
    marked = F.lit(False)
    for m in markers:
        marked = marked | standalone(text, m)
    return F.when(F.size(injuries) == 0, "simple").when((F.size(injuries) >= 2) | (extra > 0) | marked, "compound_injury").otherwise("single_injury")


def route_weights(found: Column, injury: str = "injury", part: str = "body_part") -> Column:
    """struct(vector, bm25, graph) weights of the three paths."""
    injuries = F.coalesce(F.size(F.coalesce(found[injury], F.array().cast("array<string>"))), F.lit(0))
    parts = F.coalesce(F.size(F.coalesce(found[part], F.array().cast("array<string>"))), F.lit(0))
    triple = lambda v, b, g: F.struct(F.lit(v).alias("vector"), F.lit(b).alias("bm25"), F.lit(g).alias("graph"))
    compound = (injuries >= 2) | ((injuries >= 1) & (parts >= 1))
    return F.when((injuries == 0) & (parts == 0), triple(0.40, 0.35, 0.25)).when(compound, triple(0.20, 0.25, 0.55)).otherwise(triple(0.30, 0.25, 0.45))


def tier(found: Column, text: Column, plan_words: Sequence[str], injury: str = "injury", part: str = "body_part") -> Column:
    planned = F.lit(False)
    for w in plan_words:
        planned = planned | F.contains(text, F.lit(w))
    return F.when(found[injury].isNotNull() | found[part].isNotNull(), "injury").when(planned, "plan").otherwise("simple")


def grounding(ctx_chars: Column, n_docs: Column, max_score: Column, relevance: Column, has_entities: Column, external: Column, min_score: float = 0.20, min_sim: float = 0.40, min_chars: int = 80, weighted: bool = True) -> Column:
    """The reason a question may (external_only, ok) or may not be answered."""
    low = (max_score < min_score) if weighted else F.lit(False)
    return (
        F.when(external & (ctx_chars > 0), "external_only").when(n_docs == 0, "no_docs")
        .when(relevance.isNotNull() & ~has_entities & (relevance < min_sim), "low_relevance").when(low, "low_score")
        .when(ctx_chars < min_chars, "ctx_too_short").otherwise("ok")
    )


def error_kind(name: Column, status: Column, message: Column) -> Column:
    """Kind of a provider's failure from its type name, status and message; the first rule that fits."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(text, w))
    told = lambda kind: name.isin(*ERROR_NAMES[kind]) if kind in ERROR_NAMES else F.lit(False)
    worded = lambda kind: has(ERROR_WORDS[kind]) if kind in ERROR_WORDS else F.lit(False)
    more = {
        "rate_limited": status == 429, "auth": (status == 401) | F.contains(F.replace(text, F.lit(" "), F.lit("")), F.lit(KEY_WORDS)), "quota": status == 403,
        "context_overflow": has(OVERFLOW_WORDS[0]) & has(OVERFLOW_WORDS[1]), "server": (status >= 500) & (status < 600),
    }
    return F.coalesce(*[F.when(told(kind) | worded(kind) | more.get(kind, F.lit(False)), F.lit(kind)) for kind in ERROR_KINDS], F.lit("unknown"))


def health_params(profile: Column, question: Column) -> Column:
    """struct(height, weight, age) named in the profile, else in the question."""

    def first(pattern: str) -> Column:
        found = [F.regexp_extract(F.coalesce(t, F.lit("")), f"(?i){pattern}", 1) for t in (profile, question)]
        return F.coalesce(*[F.when(x != "", x).cast("double") for x in found])

    return F.struct(first(HEIGHT).alias("height"), first(WEIGHT).alias("weight"), first(AGE).alias("age"))


def health_metrics(height: Column, weight: Column, age: Column) -> Column:
    """struct(bmi, band, water_ml, max_hr, fat_low, fat_high, aerobic_high); parts whose inputs are missing or 0 are null."""
    h, w, a = (F.when(x != 0, x) for x in (height, weight, age))
    bmi, top = w / ((h / 100) * (h / 100)), F.lit(220) - a
    band = F.when(bmi < 18.5, "under").when(bmi < 24, "normal").when(bmi < 28, "over").when(bmi.isNotNull(), "obese")
    return F.struct(bmi.alias("bmi"), band.alias("band"), (w * 30).alias("water_ml"), top.alias("max_hr"), (top * 0.6).alias("fat_low"), (top * 0.7).alias("fat_high"), (top * 0.8).alias("aerobic_high"))
