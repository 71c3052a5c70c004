import random

from pyspark.sql.types import StructType

from corvane.sources import keyed_table as T

SCHEMA = StructType().add("src", "string").add("dst", "string").add("seq", "long").add("relation", "string")
KEYS = ["src", "dst"]


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def table(spark, root):
    return sorted(tuple(r) for r in T.read(spark, root, SCHEMA).collect())


def test_loads_in_any_order_agree_with_a_dictionary(spark, tmp_path):
    rng = random.Random(7)
    loads = [[(rng.choice("abcde"), rng.choice("vwxyz"), rng.choice([None, 1, 2, 3]), rng.choice(["p", "q", None])) for _ in range(40)] for _ in range(3)]
    best = {}
    least = lambda v: (v is not None, v if v is not None else 0)
    for s, d, q, r in (row for load in loads for row in load):
        if (s, d) not in best or (least(q), (r is not None, r or "")) > (least(best[s, d][0]), (best[s, d][1] is not None, best[s, d][1] or "")):
            best[s, d] = (q, r)
    want = sorted(((*k, *v) for k, v in best.items()), key=lambda t: t[:2])
    for name, order in (("a", loads), ("b", loads[::-1])):
        root = f"file://{tmp_path}/{name}"
        for load in order:
            T.upsert(spark.createDataFrame(load, SCHEMA), root, KEYS, "seq", buckets=4)
        assert sorted((tuple(r) for r in T.read(spark, root, SCHEMA).collect()), key=lambda t: t[:2]) == want


def test_a_repeated_load_rewrites_nothing_and_a_small_one_only_its_bucket(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(f"s{i}", "d", 1, "p") for i in range(50)], SCHEMA)
    assert len(T.upsert(rows, root, KEYS, "seq", buckets=8)) == 8
    before = files(tmp_path)
    assert T.upsert(rows, root, KEYS, "seq") == [] and files(tmp_path) == before
    assert T.upsert(spark.createDataFrame([("s3", "d", 0, "old")], SCHEMA), root, KEYS, "seq") == []
    assert len(T.upsert(spark.createDataFrame([("s3", "d", 2, "new")], SCHEMA), root, KEYS, "seq")) == 1
    assert ("s3", "d", 2, "new") in table(spark, root) and len(table(spark, root)) == 50
    assert sum("/b" in f and f in before for f in files(tmp_path)) >= 7


def test_look_up_opens_the_buckets_asked_for(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    T.upsert(spark.createDataFrame([(f"s{i}", "d", 1, "p") for i in range(50)], SCHEMA), root, KEYS, "seq", buckets=8)
    found = T.look_up(spark, root, SCHEMA, KEYS, spark.createDataFrame([("s3", "d"), ("none", "d")], "src string, dst string"))
    assert [tuple(r) for r in found.collect()] == [("s3", "d", 1, "p")]
    assert len({f.split("/")[-2] for f in found.inputFiles()}) <= 2


def test_null_keys_no_rows_and_no_table(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert table(spark, root) == []
    assert T.upsert(spark.createDataFrame([(None, "d", 1, "p")], SCHEMA), root, KEYS, "seq") == [] and table(spark, root) == []
    assert T.upsert(spark.createDataFrame([("a", "d", None, None)], SCHEMA), root, KEYS, "seq") != []
    assert table(spark, root) == [("a", "d", None, None)]
