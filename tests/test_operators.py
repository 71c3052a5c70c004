import math

import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluate as E
from corvane.operators import graph as G
from corvane.operators import ingest as I
from corvane.operators import retrieval as R
from corvane.sources import readers
from corvane.streaming import gateway as W


def test_bm25_by_hand_and_zero_padding(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat fish bird"), (3, "fish"), (4, None)], "d int, text string")
    query = spark.createDataFrame([(7, "dog dog"), (8, "none")], "q int, text string")
    got = {(r.q, r.d): r.score for r in R.bm25(query, docs, "q", "d", 3).collect()}
    assert got[7, 1] == 1.0 and got[7, 2] == 0.0 and (8, 1) in got and (8, 4) not in got
    stats = {r.term: r.idf for r in R.term_stats(R.postings(docs, "d"), R.corpus_stats(docs)).collect()}
    assert stats["dog"] == pytest.approx(math.log(3.5) - math.log(1.5))


def test_fusion_floor_and_weights(spark):
    paths = spark.createDataFrame([(1, 1, "vector", 0.45), (1, 2, "vector", 0.3), (1, 3, "graph", 0.9), (1, 4, "bm25", 0.9), (1, 2, "vector", 0.3)], "q int, d int, path string, score double")
    weights = spark.createDataFrame([(1, "vector", 0.2), (1, "graph", 0.5), (1, "bm25", 0.0)], "q int, path string, weight double")
    assert [(r.d, r.rank) for r in R.weighted_fusion(paths, weights, "q", "d").orderBy("rank").collect()] == [(3, 1), (1, 2)]


def test_semantic_dedup_keeps_three(spark):
    hits = spark.createDataFrame([(1, k, k, [1.0, 0.0]) for k in range(1, 6)], "q int, d int, rank bigint, embedding array<double>")
    assert R.semantic_dedup(hits, "q", "d").count() == 3


def test_parse_ranking(spark):
    row = spark.createDataFrame([("3, 1 then 9 and 3",)], "a string")
    assert row.select(R.parse_ranking(F.col("a"), F.lit(4))).first()[0] == [3, 1, 2, 4]


def test_trails_use_an_edge_once(spark):
    edges = spark.createDataFrame([(1, "a", "b", "T", "rehab", ""), (2, "b", "a", "T", "forbidden", ""), (3, "a", "c", "T", None, "")], "edge_id int, src string, dst string, rel_type string, relation string, description string")
    seeds = spark.createDataFrame([(0, "a")], "q int, src string")
    assert {tuple(r.edge_ids) for r in G.trails(seeds, edges, "q", 3).collect()} == {(1,), (3,), (1, 2), (1, 2, 3)}
    scores = {tuple(r.edge_ids): r.score for r in G.multi_hop(seeds, edges, "q", 3).collect()}
    assert scores[(1,)] == 0.9 and scores[(1, 2)] == 0.75 and scores[(1, 2, 3)] == pytest.approx(0.25)


def test_conflicts_and_contraindications(spark):
    rows = spark.createDataFrame([(1, "x", "a", 1), (1, "x", "b", 2), (1, "y", "a", 3)], "q int, t string, l string, s int")
    assert [r.conflict for r in G.mark_conflicts(rows, "q", "t", "l", "s").orderBy("s").collect()] == [False, True, False]
    table = spark.createDataFrame([("knee", "jump", "forbidden"), ("back", "bend", "rehab")], "injury string, action string, relation string")
    aliases = spark.createDataFrame([("genu", "knee")], "alias string, canonical string")
    asked = spark.createDataFrame([(1, "knee pain"), (1, "genu"), (1, "back")], "q int, injury string")
    assert {(r.injury, *r.actions) for r in G.contraindications(asked, table, aliases, "q").collect()} == {("knee pain", "jump"), ("genu", "jump")}


def test_tables_go_on_over_three_pages(spark):
    head, row = ["a", "b"], ["1", "2"]
    t = [("d", 1, 0, [head, row], 500.0, 790.0, 800.0), ("d", 2, 0, [head, row], 10.0, 790.0, 800.0), ("d", 3, 0, [row], 10.0, 100.0, 800.0), ("d", 5, 0, [row], 10.0, 100.0, 800.0)]
    tables = spark.createDataFrame(t, "doc string, page int, tbl_no int, rows array<array<string>>, top double, bottom double, height double")
    got = {r.page: r.rows for r in I.merge_page_tables(tables).collect()}
    assert got == {1: [head, row, row, row], 5: [row]}


@pytest.mark.parametrize(("rows", "want"), [([["a", "b"], ["c", "d"]], True), ([["a", "b"]], False), ([["a"], ["b"]], False), ([["a", None], ["b", ""]], False), ([["a", "b"], ["", ""], ["c", "d"]], True)])
def test_real_table(spark, rows, want):
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    assert df.select(I.real_table(F.col("rows"))).first()[0] is want


def test_split_text_fits_and_keeps_all():
    text = "".join(f"句子{k}很长很长。" for k in range(50))
    pieces = I.split_text(text, 60, 0)
    assert "".join(pieces) == text and all(I.estimate(p) <= 60 for p in pieces)
    lapped = I.split_text(text, 60, 20)
    assert all(b.startswith(a[-9:]) or a[-9:] in b for a, b in zip(lapped, lapped[1:]))


def test_manifest_and_cache(spark):
    old, new = (spark.createDataFrame(x, "path string, sha string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert {tuple(r) for r in I.manifest_diff(old, new).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new")}
    texts = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "z")], "id int, text string")
    out, grown = I.embed_with_cache(texts, spark.createDataFrame([], "sha string, vec array<float>"), I.hash_embed)
    assert grown.count() == 2 and out.filter("vec IS NULL").count() == 0


def test_limits_cool_down():
    stamps, blocked, seen = [], 0.0, []
    for t in [*range(11), 15, 41, 75]:
        ok, stamps, blocked = W.limit_step(stamps, blocked, float(t))
        seen.append(ok)
    assert seen == [True] * 10 + [False, False, False, True]
    assert W.noise_step(["hello there"], "hello there")[0] and not W.noise_step(["hello there"], "x")[0]
    assert W.hysteresis_step(False, 2.9) and W.hysteresis_step(True, 3.5) and not W.hysteresis_step(True, 4.1)


def test_hits_and_percentiles(spark):
    r = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, False), (2, 3, True), (3, 1, False)], "q int, rank int, hit boolean")
    m = E.hit_metrics(r, "q", F.col("hit")).first()
    assert (m.n, m.hit1, m.hit3, m.mrr) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(4 / 9))
    p = E.percentiles(spark.createDataFrame([("a", float(k)) for k in range(10)], "k string, v double"), "k", "v").first()
    assert (p.p50, p.p95, p.p99) == (5.0, 9.0, 9.0)


def test_verdicts(spark):
    df = spark.createDataFrame([(1, "dose：FAIL, too much\noverall: PASS"), (2, "dose: PASS ok")], "k int, t string")
    assert {r.k: (r.failed, r.passed) for r in E.verdicts(df, "k", "t", {"dose": "dose"}).collect()} == {1: (["dose"], False), 2: ([], True)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("  \n")
    (tmp_path / "c.csv").write_text('name,steps\nsquat,"go down,\nthen up' + " slowly" * 12 + '"\nrow,pull\n')
    (tmp_path / "d.html").write_text("<p>a &amp; b</p><script>x()</script>")
    (tmp_path / "e.jsonl").write_text('{"a": 1}\nnot json\n\n{"b": "x"}\n')
    assert [r.text for r in readers.load_documents(spark, f"{tmp_path}/*.txt").collect()] == ["hello"]
    rows = readers.load_documents(spark, str(tmp_path / "c.csv")).orderBy("unit").collect()
    assert [r.unit for r in rows] == [0, 1] and rows[0].meta["name"] == "squat" and "steps" not in rows[0].meta and rows[1].text == "name: row\nsteps: pull"
    assert readers.load_documents(spark, str(tmp_path / "d.html")).first().text == "a & b"
    assert readers.json_events(spark, str(tmp_path / "e.jsonl")).count() == 2
    assert readers.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(ValueError):
        readers.load_documents(spark, "x.unknown")


def test_terms_are_counted_once(spark):
    """A search reads the texts for the terms' frequencies, for the mean length and for the scores, each once."""
    read = spark.sparkContext.accumulator(0)

    def told(texts):
        read.add(len(texts))
        return texts

    docs = spark.createDataFrame([(k, f"a b{k % 3} c{k}") for k in range(30)], "d int, text string").withColumn("text", F.pandas_udf(told, "string")("text"))
    query = spark.createDataFrame([(7, "c4 b1")], "q int, text string")
    assert [r.d for r in R.bm25(query, docs, "q", "d", 3).orderBy("rank").collect()] == [4, 1, 7]
    assert read.value <= 90
