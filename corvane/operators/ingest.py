"""Ingestion: chunking, tables of pages, manifests, embedding caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import is_garbled

TABLE_SEPARATOR = "\x1e"
#: Characters of texts that a task cuts at a time; a longer text is cut by itself.
PART_CHARS = 1_000_000
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", ". ", ", ", " ", "")


def blocks(docs: DataFrame, key: str) -> DataFrame:
    """key, n, text: rows of files stay whole, texts with tables are cut around these, others at blank lines; blanks go.

    docs: key, text, is_row."""
    cut = F.when(F.contains("text", F.lit(TABLE_SEPARATOR)), F.split("text", TABLE_SEPARATOR)).when(F.col("is_row"), F.array("text")).otherwise(F.split("text", r"\n\s*\n"))
    parts = docs.select(key, F.posexplode(cut).alias("n", "_t")).withColumn("text", F.regexp_replace("_t", r"^\s+|\s+$", ""))
    return parts.filter("text != ''").select(key, "n", "text")


def estimate(text: str) -> int:
    han = sum("一" <= c <= "鿿" for c in text)
    return int(han * 1.5 + (len(text) - han) * 0.3)


def split_text(text: str, limit: int, overlap: int, size: Callable[[str], int] = estimate, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most limit by size, cut at the first separator that occurs, or further ones where a piece is still too long; a piece starts with the end of the one before, up to overlap."""
    if size(text) <= limit:
        return [text] if text.strip() else []
    at = next((k for k, s in enumerate(separators) if s and s in text), len(separators) - 1)
    mark = separators[at]
    units = [u + mark for u in text.split(mark)] if mark else list(text)
    if mark:
        units[-1] = units[-1][: -len(mark)]
    out, now, used = [], [], 0
    for unit in units:
        own = size(unit)
        if own > limit and mark:
            if now:
                out.append("".join(now))
            out += split_text(unit, limit, overlap, size, separators[at + 1 :])
            now, used = [], 0
            continue
        if used + own > limit and now:
            out.append("".join(now))
            while now and (used > overlap or used + own > limit):
                used -= size(now.pop(0))
        now.append(unit)
        used += own
    if now:
        out.append("".join(now))
    return [o for o in out if o.strip()]


def chunks(texts: DataFrame, key: str, limit: int = 300, overlap: float = 0.15, keep: Sequence[str] = ()) -> DataFrame:
    """key, the kept columns, n and text of each piece. Ids come from sha2(key, n), so that reruns agree."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name == key or f.name in keep)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for _, part in whole.groupby(whole["text"].map(lambda t: len(t or "")).cumsum() // PART_CHARS)):
            pieces = [split_text(t or "", limit, int(limit * overlap)) for t in batch["text"]]
            out = batch.drop(columns="text").loc[batch.index.repeat([len(p) for p in pieces])].reset_index(drop=True)
            yield out.assign(n=[k for p in pieces for k in range(len(p))], text=[x for p in pieces for x in p])

    rows = texts.select(key, *keep, "text").mapInPandas(cut, f"{fields}, n int, text string")
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("\x01", F.col(key).cast("string"), F.col("n").cast("string")), 256))


def parent_child_chunks(docs: DataFrame, key: str, parent: int = 600, child: int = 300, overlap: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Parents (key, parent_id, text) and children (key, parent_id, chunk_id, text)."""
    up = chunks(docs, key, parent, overlap).withColumnRenamed("chunk_id", "parent_id").drop("n")
    down = chunks(up, "parent_id", child, overlap, [key])
    return up, down.select(key, "parent_id", "chunk_id", "text")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and status (new, changed, unchanged, removed) of manifests path, sha."""
    a, b = old.select("path", F.col("sha").alias("_old")), new.select("path", F.col("sha").alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """texts with vec, from the cache (sha, vec) or embedded once for each distinct text; and the cache with what was missing."""
    keyed = texts.withColumn("sha", F.sha2("text", 256))
    missing = keyed.select("sha", "text").join(cache, "sha", "left_anti").dropDuplicates(["sha"])
    grown = cache.unionByName(missing.select("sha", embed(F.col("text")).alias("vec")))
    return keyed.join(grown, "sha", "left"), grown


def hash_embed(text: Column, dim: int = 64) -> Column:
    """The offline embedder: counts of words by hash, of unit length."""
    from corvane.functions.text import words

    if not 0 < dim <= 256:
        raise ValueError("dim must be from 1 to 256")
    at = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def quality_loop(pages: DataFrame, key: str, again: Callable[[DataFrame], DataFrame], garbled: Callable[[Column], Column] = is_garbled) -> tuple[DataFrame, DataFrame]:
    """Pages (key, text and more) that are fit to keep, and the keys of those dropped.

    Garbled pages, those alone, are read once more by again (rows in, key and text out: the same pages at a higher resolution, say); what is blank or garbled
    still, or doesn't come back, is dropped. tries is 1 or 2. A page that is null or blank at first is garbled too. Keys are distinct."""
    told = pages.withColumn("_bad", garbled(F.col("text")))
    fine = told.filter(~F.col("_bad")).drop("_bad").withColumn("tries", F.lit(1))
    # The poor and what is read again of them are judged once, and kept for what is mended and dropped; they spill, and are made anew if lost.
    poor = told.filter("_bad").drop("_bad").persist(StorageLevel.MEMORY_AND_DISK)
    second = again(poor).select(key, F.col("text").alias("_again"))
    second = second.filter(~garbled(F.col("_again")) & ~F.col("_again").rlike(r"^\s*$")).persist(StorageLevel.MEMORY_AND_DISK)
    mended = poor.join(second, key).withColumn("text", F.col("_again")).drop("_again").select(*pages.columns).withColumn("tries", F.lit(2))
    return fine.unionByName(mended), poor.select(key).join(second.select(key), key, "left_anti")


def real_table(rows: Column) -> Column:
    """rows (array of arrays of text) look like a table: 2 rows and columns at least, 30 % of cells filled, two rows with two filled cells."""
    filled = F.transform(rows, lambda r: F.size(F.filter(r, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")))
    cells = F.aggregate(F.transform(rows, lambda r: F.size(r)), F.lit(0), lambda s, x: s + x)
    total = F.aggregate(filled, F.lit(0), lambda s, x: s + x)
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.coalesce((F.size(rows) >= 2) & (wide >= 2) & (total >= 0.3 * cells) & (F.size(F.filter(filled, lambda n: n >= 2)) >= 2), F.lit(False))


def merge_page_tables(tables: DataFrame, doc: str = "doc") -> DataFrame:
    """Joins a page's last table with the next page's first where widths agree, the one reaches the lowest 15 % of its page and the other starts in the top 15 %; a repeated head goes.

    tables: doc, page, tbl_no, rows, top, bottom, height. Returns doc, page, tbl_no of the first part, and rows. Tables may go on over any number of pages."""
    in_doc = Window.partitionBy(doc).orderBy("page", "tbl_no")
    last = F.lead("page").over(in_doc).isNull() | (F.lead("page").over(in_doc) != F.col("page"))
    first = F.lag("page").over(in_doc).isNull() | (F.lag("page").over(in_doc) != F.col("page"))
    t = tables.withColumns({"_last": last, "_first": first, "_w": F.size(F.get("rows", F.lit(0)))})
    goes_on = F.lag(F.col("_last") & (F.col("bottom") >= 0.85 * F.col("height"))).over(in_doc) & F.col("_first") & (F.col("top") <= 0.15 * F.col("height"))
    fits = (F.lag("page").over(in_doc) == F.col("page") - 1) & (F.lag("_w").over(in_doc) == F.col("_w"))
    t = t.withColumn("_on", F.coalesce(goes_on & fits, F.lit(False)))
    t = t.withColumn("_island", F.sum((~F.col("_on")).cast("int")).over(in_doc))
    head = F.first(F.get("rows", F.lit(0))).over(Window.partitionBy(doc, "_island").orderBy("page", "tbl_no"))
    t = t.withColumn("_head", head).withColumn("_rows", F.when(F.col("_on") & (F.get("rows", F.lit(0)) == F.col("_head")), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows")))
    parts = t.groupBy(doc, "_island").agg(F.array_sort(F.collect_list(F.struct("page", "tbl_no", "_rows"))).alias("_p"))
    return parts.select(doc, F.col("_p")[0]["page"].alias("page"), F.col("_p")[0]["tbl_no"].alias("tbl_no"), F.flatten(F.transform("_p", lambda p: p["_rows"])).alias("rows"))


def markdown_table(rows: Column) -> Column:
    """The first row as the head; bars escaped, nulls empty."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def entity_labels(meta: Column) -> Column:
    """type:name labels from a map of metadata."""
    value = lambda k: F.trim(F.coalesce(meta[k], F.lit("")))
    one = lambda kind, k, least=1: F.when(F.char_length(value(k)) >= least, F.concat(F.lit(f"{kind}:"), value(k)))
    muscles = F.transform(F.filter(F.transform(F.split(value("muscle"), "[/、，,]"), lambda m: F.trim(m)), lambda m: F.char_length(m) >= 2), lambda m: F.concat(F.lit("muscle:"), m))
    return F.concat(F.array_compact(F.array(one("exercise", "exercise"))), muscles, F.array_compact(F.array(one("equipment", "equipment"), one("difficulty", "difficulty"), one("source", "source"))))


def fingerprint(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """One row: 8 hex digits that change with any group or value, not with their order."""
    each = rows.groupBy(group).agg(F.md5(F.to_json(F.array_sort(F.collect_set(F.struct(*columns)))).cast("binary")).alias("_m"))
    return each.agg(F.substring(F.md5(F.concat_ws("", F.array_sort(F.collect_list(F.concat_ws("=", group, "_m")))).cast("binary")), 1, 8).alias("fingerprint"))
