"""Tools: named calculations over numbers taken from texts, chosen by a generator or, where it chooses none, by keywords. Numbers never come from the generator.

Defined cases: a tool whose numbers are missing or 0 gives nothing; without any number no generator is asked; an answer that names a tool twice gets it
once; a failing or blank answer leaves the choice to the keywords; null texts have neither words nor numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import health_metrics, health_params
from corvane.operators.variants import Generator, generate


@dataclass(frozen=True)
class Tool:
    """compute takes health_params() and gives the tool's text, or null."""

    name: str
    title: str
    keywords: tuple[str, ...]
    compute: Callable[[Column], Column]


# Names, titles, keywords and texts of the tools, and the ends of the bands.
BANDS = {"under": "偏瘦（<18.5）", "normal": "正常（18.5-23.9）", "over": "超重（24-27.9）", "obese": "肥胖（≥28）"}
BMI_TEXT = "身高%scm、体重%skg → BMI=%s，属%s。BMI 仅作参考，肌肉量大者可能被高估，需结合体脂率判断。"
WATER_TEXT = "体重%skg → 基础饮水量约 %sml（约 %s 瓶 500ml），运动日建议额外补充 500-1000ml。"
HEART_TEXT = "年龄%s岁 → 最大心率≈%s 次/分；燃脂区（60-70%%）=%s-%s，有氧耐力区（70-80%%）=%s-%s。"


def _whole(x: Column) -> Column:
    """A number without decimals; a half goes to the even neighbour."""
    return F.bround(x, 0).cast("bigint").cast("string")


def _tenth(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x, 1))


def _metrics(p: Column) -> Column:
    return health_metrics(p["height"], p["weight"], p["age"])


def bmi(p: Column) -> Column:
    m = _metrics(p)
    band = F.coalesce(*[F.when(m["band"] == k, F.lit(v)) for k, v in BANDS.items()])
    return F.when(m["bmi"].isNotNull(), F.format_string(BMI_TEXT, _whole(p["height"]), _whole(p["weight"]), _tenth(m["bmi"]), band))


def water(p: Column) -> Column:
    ml = _metrics(p)["water_ml"]
    return F.when(ml.isNotNull(), F.format_string(WATER_TEXT, _whole(p["weight"]), _whole(ml), _tenth(ml / 500)))


def heart(p: Column) -> Column:
    m = _metrics(p)
    bounds = [_whole(m[x]) for x in ("max_hr", "fat_low", "fat_high", "fat_high", "aerobic_high")]
    return F.when(m["max_hr"].isNotNull(), F.format_string(HEART_TEXT, _whole(p["age"]), *bounds))


TOOLS = (
    Tool("calculate_bmi", "BMI 计算", ("bmi", "体重指数", "身高", "体重"), bmi),
    Tool("estimate_water_intake", "每日饮水量估算", ("喝水", "饮水", "喝多少", "多少水", "多喝水", "补水", "水量", "水分", "水摄入"), water),
    Tool("heart_rate_zone", "运动心率区间（最大心率法）", ("心率", "燃脂", "最大心率", "靶心率"), heart),
)


def _run(params: Column, tools: Sequence[Tool], chosen: Callable[[Tool], Column]) -> Column:
    return F.array_compact(F.array(*[F.when(chosen(t) & text.isNotNull(), F.struct(F.lit(t.name).alias("name"), F.lit(t.title).alias("title"), text.alias("content"))) for t in tools for text in [t.compute(params)]]))


def by_keywords(params: Column, question: Column, tools: Sequence[Tool] = TOOLS) -> Column:
    """array<struct(name, title, content)> of the tools one of whose keywords is in the question, in the registry's order."""
    asked = F.lower(F.coalesce(question, F.lit("")))
    return _run(params, tools, lambda t: F.exists(F.array(*[F.lit(k) for k in t.keywords]), lambda k: F.contains(asked, k)))


def resolve(rows: DataFrame, key: str, question: str, profile: str, template: str, generator: Generator | None = None, tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """key, results and decided_by (model, keyword or none). template has {question}; an answer is names of tools between commas or white space, and names that
    aren't a tool's are passed over. Numbers come from the profile, else the question. Results of a model are in the registry's order."""
    told = rows.select(key, F.col(question).alias("_question"), health_params(F.col(profile), F.col(question)).alias("_params"))
    some = F.coalesce("_params.height", "_params.weight", "_params.age").isNotNull()
    words = by_keywords(F.col("_params"), F.col("_question"), tools)
    empty = F.slice(words, 1, 0)
    told = told.withColumn("_words", F.when(some, words).otherwise(empty))
    by_model = empty
    if generator is not None:
        before, after = template.split("{question}")
        asked = told.filter(some).select(key, F.concat(F.lit(before), F.coalesce("_question", F.lit("")), F.lit(after)).alias("_ask"), F.lit("").alias("_none"))
        answers = generate(asked, "_ask", "_none", generator).select(key, F.split("text", r"[,\s]+").alias("_names"))
        told = told.join(answers, key, "left")
        by_model = _run(F.col("_params"), tools, lambda t: F.coalesce(F.array_contains("_names", t.name), F.lit(False)))
    told = told.withColumn("_model", by_model)
    results = F.when(F.size("_model") > 0, F.col("_model")).otherwise(F.col("_words"))
    source = F.when(F.size("_model") > 0, "model").when(F.size("_words") > 0, "keyword").otherwise("none")
    return told.select(key, results.alias("results"), source.alias("decided_by"))
