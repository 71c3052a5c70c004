import itertools
import math
import random

from pyspark.sql import functions as F

from corvane.functions import dictionary as Z
from corvane.functions.text import is_garbled
from corvane.operators import graph as G
from corvane.operators import retrieval as R

WORDS = {"研究": 8, "研究生": 4, "生命": 9, "命": 2, "起源": 5, "生": 1, "的": 30, "腰": 3, "腰突": 2}


def every_cut(run):
    for ends in itertools.product([False, True], repeat=len(run) - 1):
        cut, word = [], run[0]
        for end, c in zip(ends, run[1:]):
            if end:
                cut.append(word)
                word = c
            else:
                word += c
        yield [*cut, word]


def cost(words):
    total = sum(WORDS.values())
    if any(w not in WORDS and len(w) > 1 for w in words):
        return math.inf
    return sum(math.log(total) - math.log(WORDS.get(w, 1)) for w in words)


def test_the_path_is_the_most_probable_of_all(spark):
    rng = random.Random(5)
    runs = ["研究生命的起源", *("".join(rng.choices("研究生命起源的腰突鹿", k=rng.randint(1, 9))) for _ in range(60))]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(runs)], "k long, text string")
    got = {r.k: r.w for r in rows.select("k", Z.tokenizer(WORDS)(F.col("text")).alias("w")).collect()}
    assert got[0] == ["研究", "生命", "的", "起源"]
    for k, run in enumerate(runs):
        assert "".join(got[k]) == run
        assert math.isclose(cost(got[k]), min(cost(c) for c in every_cut(run)), abs_tol=1e-9)


def test_mixed_texts_coverage_and_postings(spark):
    docs = spark.createDataFrame([(1, "Squat: 腰突的 RDL3 鹿"), (2, None), (3, ""), (4, "zzqy xxkw vvbn 腰")], "id long, text string")
    cut = Z.tokenizer(WORDS)
    told = {r.id: (r.w, r.c, r.g) for r in docs.withColumn("w", cut(F.col("text"))).withColumn("c", Z.coverage(WORDS)(F.col("w"))).select("id", "w", "c", is_garbled(F.col("text"), F.col("c")).alias("g")).collect()}
    assert told[1] == (["squat", "腰突", "的", "rdl3", "鹿"], 0.6, False)
    assert told[2][:2] == (None, 0.0) and told[3][:2] == ([], 0.0) and told[4][1:] == (0.25, True)
    posted = {(r.term, r.id, r.dl) for r in R.postings(docs, "id", tokenizer=cut).collect()}
    assert {("腰突", 1, 5), ("腰", 4, 4)} <= posted and len(posted) == 9


def test_dictionary_keeps_the_most_frequent(spark):
    counted = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("", 5), (None, 7), ("d", 0)], "word string, n long")
    assert Z.dictionary(counted, most=2) == {"c": 9, "a": 2}


def test_simple_paths_agree_with_a_search_by_breadth(spark):
    rng = random.Random(11)
    edges = [(k, f"v{rng.randrange(7)}", f"v{rng.randrange(7)}", "R", rng.choice(["forbidden", "rehab", None])) for k in range(30)]
    seeds = [("p", "v0"), ("p", "v1"), ("p", "v1"), ("q", "v2"), ("q", "none"), ("r", "none")]
    df = spark.createDataFrame(edges, "edge_id long, src string, dst string, rel_type string, relation string")
    s = spark.createDataFrame(seeds, "q string, src string")
    for limit in (1, 7, 15, 1000):
        want = set()
        for q, start in set(seeds):
            quota, found, now = max(1, limit // len({x for k, x in seeds if k == q})), [], [((), (start,))]
            for _ in range(3):
                now = sorted(((*ids, e[0]), (*nodes, e[2])) for ids, nodes in now for e in edges if e[1] == nodes[-1] and e[2] not in nodes)
                found += now
            want |= {(q, *path) for path in found[:quota]}
        paths = G.simple_paths(s, df, "q", 3, limit)
        assert {(r.q, tuple(r.edge_ids), tuple(r.nodes)) for r in paths.collect()} == want
    ranked = G.rank_paths(G.simple_paths(s, df, "q", 3), "q")
    told = G.path_metrics(ranked, s, "q").first()
    assert told.n == 3 and told.recall <= 2 / 3 and 1 <= told.mean_hops <= 3
