import collections

from pyspark.sql import functions as F

from corvane.operators import retrieval as R
from corvane.operators import variants as X
from corvane.plans import data_queries
from corvane.streaming import gateway as W
from corvane.streaming import keyed as K

SF = "/root/testdata/sf0.001"
TEMPLATE = "history: {history}\nquestion: {question}"


def test_a_rewrite_falls_back_row_by_row(spark):
    def answers(prompts):
        """Named by what the prompt ends with; a failing one fails its whole batch."""
        told = {"fine": ' "a question that stands alone" ', "blank": "  \n", "long": "x" * 201, "none": None}
        if any(p.endswith("boom") for p in prompts):
            raise RuntimeError("no model")
        return [told.get(p.split()[-1], "ok") for p in prompts]

    names = ["fine", "blank", "long", "none", "boom", "other {history}"]
    questions = spark.createDataFrame([(k, n) for k, n in enumerate(names)] + [(98, None), (99, "no history")], "q long, question string")
    turns = [(k, t, r, f"m{t}") for k in [*range(len(names)), 98] for t, r in enumerate(["user", "ai", "human", "assistant", "user", "ai", "user"])]
    history = X.history_text(spark.createDataFrame(turns, "q long, turn long, role string, text string"), "q", "turn", "role", "text")
    assert history.filter("q = 0").first().history == "assistant: m1\nuser: m2\nassistant: m3\nuser: m4\nassistant: m5\nuser: m6"
    out = {r.q: (r.text, r.outcome) for r in X.rewrite(questions.coalesce(1), "q", "question", history, TEMPLATE, answers).collect()}
    assert out == {0: ("a question that stands alone", "ok"), 1: ("blank", "kept"), 2: ("long", "kept"), 3: ("none", "kept"), 4: ("boom", "error"), 5: ("ok", "ok")}
    assert X.rewrite(questions.limit(0), "q", "question", history, TEMPLATE, answers).count() == 0


def test_variants_of_compound_and_single_questions(spark):
    def generator(prompts):
        kinds = {"D": "a draft of more than twenty characters", "B": "a step back", "S": "1. one\n\n2、two\n 3) three\n- four\nfive"}
        return [kinds[p[0]] if "short" not in p else "too short" for p in prompts]

    templates = {"draft": "D {question}", "step_back": "B {question}", "sub_question": "S {question}"}
    rows = spark.createDataFrame([(1, "both", True), (2, "one", False), (3, "short", False), (4, None, True)], "q long, question string, compound boolean")
    got = [tuple(r) for r in X.variants(rows, "q", "question", F.col("compound"), templates, generator).orderBy("q", "pos").collect()]
    assert got == [
        (1, 0, "draft", "ok", "a draft of more than twenty characters"), (1, 1, "step_back", "ok", "a step back"), (1, 2, "sub_question", "ok", "one"), (1, 3, "sub_question", "ok", "two"),
        (1, 4, "sub_question", "ok", "three"), (1, 5, "sub_question", "ok", "- four"), (2, 0, "draft", "ok", "a draft of more than twenty characters"), (3, 0, "draft", "kept", "short"),
    ]


def test_merge_keeps_first_occurrences_and_no_more_than_twelve(spark):
    hits = [("q", p, r, f"t{(p * 3 + r) % 17}", 100 * p + r) for p in range(6) for r in range(1, 6)]
    want, seen = [], set()
    for _, p, r, text, key in hits:
        if text not in seen:
            seen.add(text)
            want.append((p, r, text, key))
    got = X.merge(spark.createDataFrame(hits, "q string, pos long, rank long, text string, id long").repartition(3), "q", "pos", "rank", "text")
    assert [(r.pos, r.rank, r.text, r.id) for r in got.orderBy("merged_rank").collect()] == want[:12]


def test_relevance_is_the_best_of_the_first_three(spark):
    hits = spark.createDataFrame([("a", 1, 0.2), ("a", 3, 0.4), ("a", 4, 0.9), ("b", 5, 0.7)], "q string, rank long, score double")
    assert [tuple(r) for r in R.relevance(hits, "q").collect()] == [("a", 0.4)]


def test_sessions_agree_with_an_ordered_dictionary_and_the_stream(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    buckets = {r.conv_id: r.b for r in turns.select("conv_id", F.pmod(F.xxhash64("conv_id"), F.lit(8)).alias("b")).distinct().collect()}
    stores, want = collections.defaultdict(collections.OrderedDict), set()
    for r in sorted(turns.collect(), key=lambda r: (r.turn, r.conv_id)):
        store = stores[buckets[r.conv_id]]
        store[r.conv_id] = [*store.get(r.conv_id, []), r.text][-3:]
        store.move_to_end(r.conv_id)
        gone = [str(store.popitem(last=False)[0])] if len(store) > 2 else []
        want.add((buckets[r.conv_id], r.turn, r.conv_id, len(store[r.conv_id]), tuple(gone)))
    told = lambda df: {(r.bucket, r.turn, r.conv_id, r.held, tuple(r.gone)) for r in df.collect()}
    assert any(w[4] for w in want) and told(data_queries.session_store_replay(spark, SF)) == want
    assert told(data_queries.stream_session_store(spark, SF)) == want


def test_a_restart_keeps_what_went_away(spark, tmp_path):
    shape = "bucket long, at long, session string, text string"
    step = lambda state, row: K.session_step(state, row, most=2)

    def run(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = K.stream(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), "bucket", ["at"], ["session", "text"], step, "held int, gone array<string>")
        query = out.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
        query.awaitTermination()
        return {r.at: (r.held, list(r.gone)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert run([(1, 1, "a", "x"), (1, 2, "b", "x")]) == {1: (1, []), 2: (1, [])}
    # Reading a touches it, so that b goes first; b begins anew afterwards, and a null session is none.
    told = run([(1, 3, "a", None), (1, 4, "c", "x"), (1, 5, "b", "y"), (1, 6, None, "z"), (1, 7, "a", None)])
    assert {k: told[k] for k in (3, 4, 5, 6, 7)} == {3: (1, []), 4: (1, ["b"]), 5: (1, ["a"]), 6: (None, []), 7: (0, [])}
