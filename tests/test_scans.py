"""Searches that score rows as they are read, against the joins of larger sets of queries; paths through hubs against brute force."""

import itertools
import random

from corvane.operators import graph as G
from corvane.operators import ingest as I
from corvane.operators import retrieval as R


def test_scanned_bm25_agrees_with_joined_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(n, " ".join(["a", "b", "c d", "e"][: n % 5]) * (1 + n % 3)) for n in range(40)] + [(90, None), (91, "")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a b b"), (2, "zzz"), (3, None), (4, "d e")], "item_id int, text string")
    key = lambda f: sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 9)) for r in f.collect())
    monkeypatch.setattr(R, "BLOCK", 7)
    scanned = R.bm25(queries, docs, "item_id", "doc_id", 6)
    assert "MapInArrow" in scanned._jdf.queryExecution().executedPlan().toString()
    found = key(scanned)
    monkeypatch.setattr(R, "STATED", 0)
    assert found == key(R.bm25(queries, docs, "item_id", "doc_id", 6)) and len(found) == 24


def test_dense_in_small_blocks_agrees_with_join(spark, monkeypatch):
    draw = random.Random(5)
    rows = spark.createDataFrame([(n, [float(draw.randint(-2, 2)) for _ in range(4)]) for n in range(200)], "vec_id bigint, embedding array<double>")
    queries = rows.filter("vec_id % 9 = 0").withColumnRenamed("vec_id", "q")
    key = lambda f: sorted((r.q, r["rank"], r.vec_id, round(r.score, 9)) for r in f.collect())
    monkeypatch.setattr(R, "BLOCK", 50)
    found = key(R.dense(queries, rows, "q", "vec_id", 5))
    monkeypatch.setattr(R, "STATED", 0)
    assert found == key(R.dense(queries, rows, "q", "vec_id", 5))


def test_paths_through_hubs(spark):
    draw = random.Random(3)
    edges = [(n, f"n{draw.randint(0, 5)}", f"n{draw.choice([0, 0, 0, 1, 2, 3, 4, 5])}", "HAS", "other") for n in range(300)]
    seeds = [(1, "n0"), (1, "n1"), (2, "n2"), (3, "none")]
    found = G.simple_paths(spark.createDataFrame(seeds, "q bigint, src string"), spark.createDataFrame(edges, "edge_id bigint, src string, dst string, rel_type string, relation string"), "q", 3, 4)
    assert "collect_list" in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for q, mine in itertools.groupby(seeds, key=lambda s: s[0]):
        starts = [s for _, s in mine]
        quota = max(1, 4 // len(starts))
        for start in starts:
            now, out = [((), (start,))], []
            for _ in range(3):
                step = sorted(((ids + (e,), nodes + (d,)) for ids, nodes in now for e, s, d, *_ in edges if s == nodes[-1] and d not in nodes), key=lambda p: p[0])
                now = step[:quota]
                out += now
            want += [(q, start, ids) for ids, _ in sorted(out, key=lambda p: (len(p[0]), p[0]))[:quota]]
    assert sorted((r.q, r.start, tuple(r.edge_ids)) for r in found.collect()) == sorted(want)


def test_texts_are_cut_in_parts_of_a_batch(spark, monkeypatch):
    texts = spark.createDataFrame([(n, "word and more. " * (n % 9)) for n in range(60)] + [(99, None)], "k int, text string").coalesce(1)
    key = lambda f: sorted(tuple(r) for r in f.collect())
    whole = key(I.chunks(texts, "k", 10))
    monkeypatch.setattr(I, "PART_CHARS", 100)
    assert whole and key(I.chunks(texts, "k", 10)) == whole
