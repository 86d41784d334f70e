import pytest
from pyspark.sql import functions as F

from folioforge.operators import evaluation, generation
from folioforge.operators.model_calls import (
    LLMError,
    RetryExhausted,
    as_llm_error,
    gemini_client,
    judge_with_cache,
    llm_model,
    retry_call,
)
from folioforge.functions import errors, fixed_values as fv
from folioforge.plans import reports
from folioforge.session import new_table_path

JUDGED = "query_id long, rank int, relevant boolean, book string, page long, score double"


@pytest.fixture
def results(spark):
    golden = spark.createDataFrame(
        [
            (1, "g-1", "A", "easy", "q1"), (2, "g-2", "A", "hard", "q2"),
            (3, "g-3", "B", "easy", "q3"), (4, "g-4", "B", "odd", "q4"),
        ],
        "query_id long, id string, book string, difficulty string, query string",
    )
    judged = spark.createDataFrame(
        [
            (1, 1, True, "A", 10, 0.9), (1, 2, True, "A", 11, 0.8),
            (2, 1, False, "B", 20, 0.7), (2, 2, False, "A", 21, 0.6), (2, 3, True, "A", 22, 0.5),
            (3, 1, False, "B", 30, 0.4), (3, 2, False, "B", 31, 0.3),
        ],
        JUDGED,
    )
    return evaluation.query_results(golden, judged)


def test_query_results(results):
    r = {x.query_id: x for x in results.collect()}
    assert (r[1].hit, r[1]["rank"], r[1].best_score, r[1].chunk_judgments) == (True, 1, 0.9, [True, True])
    assert (r[2].hit, r[2]["rank"], r[2].best_score) == (True, 3, 0.5)
    assert (r[3].hit, r[3]["rank"], r[3].best_score) == (False, None, 0.0)
    assert (r[4].hit, r[4].chunk_judgments, r[4].retrieved) == (False, [], [])
    assert [h.page for h in r[2].retrieved] == [20, 21, 22]


def test_metrics(results):
    m = evaluation.summarize(results, 3).first()
    assert (m.n, m.k) == (4, 3)
    assert m.recall_at_1 == 0.25 and m.recall_at_k == 0.5
    assert m.mrr == pytest.approx((1 + 1 / 3) / 4) and m.precision_at_k == pytest.approx(3 / 7)
    rows = {(x.slice, x.name): x for x in evaluation.breakdown(results, 3).collect()}
    assert set(rows) == {
        ("overall", ""), ("book", "A"), ("book", "B"), ("difficulty", "easy"),
        ("difficulty", "hard"), ("difficulty", "odd"),
    }
    assert rows["overall", ""].mrr == m.mrr
    assert rows["book", "A"].recall_at_k == 1.0 and rows["book", "B"].precision_at_k == 0.0
    assert rows["difficulty", "odd"].precision_at_k == 0.0
    for x in rows.values():
        assert x.recall_at_1 <= x.mrr <= x.recall_at_k


def test_no_results(results):
    none = results.limit(0)
    assert evaluation.summarize(none, 3).count() == 0
    assert evaluation.breakdown(none, 3).count() == 0
    assert "nothing" in "\n".join(reports.head(reports.evaluated(none, 3)))


def test_failures_and_lines(results):
    f = {x.id: (x.top_book, x.top_page) for x in evaluation.failures(results).collect()}
    assert f == {"g-3": ("B", "30"), "g-4": ("?", "?")}
    text = "\n".join(reports.head(reports.evaluated(results, 3)))
    assert "n=4" in text and "recall_at_1=0.2500" in text and "name=odd" not in text
    assert text.index("name=easy") < text.index("name=hard")
    last = text.split("== each query ==")[1]
    assert "0.900" in last and "hit=no" in last and "g-2" in last and "g-4" in text


def test_written_report_has_all_lines_in_order(spark, tmp_path):
    """More rows than a console shows: the driver reads a few, tasks write all."""
    table = spark.range(0, 30_000, 1, 6).select(F.col("id").alias("query_id"), (-F.col("id") / 3).alias("x"), F.lit(" a\n b ").alias("text"))
    section = reports.Section("many rows", table, [F.desc("query_id")], ("text",))
    shown = list(reports.head([section, reports.Section("none", table.limit(0))], 5))
    assert len(shown) == 1 + 5 + 1 + 2 and shown[1] == "query_id=29999  x=-9999.6667 |  a b" and "more than 5" in shown[6]
    reports.write([section], str(tmp_path / "r"))
    lines = [line for p in sorted((tmp_path / "r" / "00-many-rows").glob("part-*")) for line in p.read_text().splitlines()]
    assert len(lines) == 30_000 and lines[0] == shown[1] + " " and lines[-1].startswith("query_id=0 ")


def test_summary_files(spark, results):
    path = new_table_path(spark, "summary")
    evaluation.write_summary(results, 3, {"k": "3", "index": "i"}, path)
    back = {(r.section, r.name): r for r in spark.read.json(path).collect()}
    assert back["config", "index"].value == "i" and back["overall", ""].recall_at_k == 0.5
    assert back["book", "B"].n == 2 and back["difficulty", "odd"].n == 1 and len(back) == 12
    assert back["query", "g-2"]["rank"] == 3 and back["query", "g-2"].top_retrieved[0].page == 20
    assert back["query", "g-4"].hit is False


@pytest.mark.parametrize(
    "response, want",
    [("YES", True), ("yes.", True), (" Yes, it does", True), (" No", False), ("", False), ("maybe YES", False)],
)
def test_decision(spark, response, want):
    df = spark.createDataFrame([(response,)], "response string")
    assert evaluation.decide(df).first().relevant is want


def test_judge_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def connect():
        def ask(system, user):
            calls.add(1)
            if user == "broken":
                raise RuntimeError("403 denied")
            return "YES" if "good" in user else "NO"

        return ask

    cache = new_table_path(spark, "judge")
    p = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good")], "query_id long, prompt string")
    run = lambda df: judge_with_cache(df, connect, cache, min_interval=0)
    assert sorted((r.query_id, r.response) for r in run(p).collect()) == [(1, "YES"), (2, "NO"), (3, "YES")]
    assert calls.value == 2
    more = p.union(spark.createDataFrame([(4, "broken"), (5, "new")], p.schema))
    with pytest.raises(Exception, match="Judging aborted"):
        run(more).collect()
    assert run(more.filter("prompt = 'good'")).count() == 2  # stored answers are kept
    seen = calls.value
    assert run(more.filter("prompt <> 'broken'")).count() == 4 and calls.value <= seen + 1
    long = spark.createDataFrame([(1, "x" * 900)], p.schema)
    run(long).collect()
    kept = spark.read.parquet(cache).select(F.max(F.length("prompt"))).first()[0]
    assert kept == fv.JUDGE_CACHE_PROMPT_CHARS


def test_final_errors_end_the_calls(spark):
    """A spent quota: a task sends nothing more, and no further round begins."""
    calls = spark.sparkContext.accumulator(0)

    def connect():
        def ask(system, user):
            calls.add(1)
            raise RuntimeError("429 quota PerDay")

        return ask

    p = spark.range(200).selectExpr("id AS query_id", "concat('p', id) AS prompt")
    with pytest.raises(Exception, match="Judging aborted"):
        judge_with_cache(p, connect, new_table_path(spark, "judge"), min_interval=0, callers=3, round_size=50).collect()
    assert calls.value <= 3


def test_two_writers_of_an_answer(spark):
    cache = new_table_path(spark, "judge")
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "query_id long, prompt string")
    yes = lambda: lambda system, user: "YES"
    judge_with_cache(p, yes, cache, min_interval=0).collect()
    spark.read.parquet(cache).write.parquet(cache + "-again")
    spark.read.parquet(cache + "-again").write.mode("append").parquet(cache)
    assert judge_with_cache(p, yes, cache, min_interval=0).count() == 3


ERRORS = [
    ("gemini", "429 quota PerDay exceeded", None, 429, False),
    ("gemini", "429 Per Day limit", None, 429, False),
    ("gemini", "429 slow down", None, 429, True),
    ("gemini", "got 404 and 503", None, 503, True),
    ("gemini", "no code", None, None, False),
    ("gemini", "no code", 408, 408, True),
    ("gemini", "400 bad", None, 400, False),
    ("other", "503", 503, None, False),
]


def test_error_classes(spark):
    class Coded(Exception):
        code = None

    rows = [(i, p, m, s) for i, (p, m, s, _, _) in enumerate(ERRORS)]
    df = spark.createDataFrame(rows, "i int, provider string, message string, status int")
    got = df.select(
        "i", errors.classify_error(F.col("provider"), F.col("message"), F.col("status")).alias("e")
    ).orderBy("i").collect()
    for r, (provider, message, status, code, retryable) in zip(got, ERRORS):
        assert (r.e.status_code, r.e.retryable) == (code, retryable), message
        exc = Coded(message)
        exc.code = status
        err = as_llm_error(exc, provider)
        assert (err.status_code, err.retryable) == (code, retryable), message


@pytest.mark.parametrize(
    "message, waits", [("500", [2, 4, 8, 16]), ("429", [20, 40, 60, 80])]
)
def test_retry_waits(message, waits):
    slept = []

    def fail():
        raise RuntimeError(message)

    with pytest.raises(RetryExhausted):
        retry_call(fail, provider="gemini", sleep=slept.append)
    assert slept == waits
    with pytest.raises(RetryExhausted):
        retry_call(fail, provider="gemini", max_attempts=9, sleep=slept.append)
    assert max(slept) == 120


def test_retry_gives_up_at_once():
    for message in ("429 PerDay", "404", "???"):
        with pytest.raises(LLMError) as e:
            retry_call(lambda m=message: (_ for _ in ()).throw(RuntimeError(m)), provider="gemini")
        assert not e.value.retryable
    assert str(LLMError("m", 404, False, "gemini")) == "[gemini status=404] m"
    left = [1, 1]

    def flaky():
        if left.pop():
            raise RuntimeError("503")

    left.insert(0, 0)
    assert retry_call(flaky, provider="gemini", sleep=lambda s: None) is None


def test_catalog():
    assert llm_model("gemini-pro")["provider"] == "gemini"
    with pytest.raises(ValueError, match="Unknown LLM model key: x"):
        llm_model("x")
    with pytest.raises(ValueError):
        gemini_client("x", 0.0)


HITS = "query_id long, rank int, score double, row long, chunk_id string, book string, page long, section string, content string"


def test_answers(spark):
    queries = spark.createDataFrame(
        [(1, "why?"), (2, " "), (3, "none"), (4, "fail")], "query_id long, query string"
    )
    hits = spark.createDataFrame(
        [
            (1, 2, 0.5, 8, "c8", "B", 4, "", " two "),
            (1, 1, 0.9, 7, "c7", "A", 3, "5.4 Hessian", "one\n"),
            (2, 1, 0.9, 7, "c7", "A", 3, "", "one"),
            (4, 1, 0.9, 7, "c7", None, None, None, "one"),
        ],
        HITS,
    )

    def connect():
        def ask(system, user):
            assert system == fv.SYSTEM_PROMPT
            if "Question: fail" in user:
                raise RuntimeError("401 key")
            return user

        return ask

    a = {r.query_id: r for r in generation.answer(queries, hits, connect).collect()}
    assert a[1].answer == (
        "Context chunks:\n\n[1] A, page 3, 5.4 Hessian\none\n\n---\n\n[2] B, page 4\ntwo"
        "\n\n---\n\nQuestion: why?\n\nAnswer using only the chunks above. "
        "If the answer is not present, say so."
    )
    assert [tuple(c) for c in a[1].citations] == [(1, "A", 3, "5.4 Hessian"), (2, "B", 4, "")]
    assert (a[2].answer, a[2].chunks, a[2].citations) == ("", [], [])
    assert (a[3].answer, a[3].chunks) == (fv.NO_ANSWER, [])
    assert a[4].answer == "[generation failed: [gemini status=401] 401 key]"
    assert len(a[4].chunks) == 1 and a[4].citations == []
    lines = "\n".join(reports.head(reports.answers(generation.answer(queries, hits, connect), True)))
    assert "number=1  book=A  page=3  section=5.4 Hessian" in lines and "== retrieved chunks ==" in lines
    assert "chunk_id=c7" in "\n".join(reports.head(reports.hits(hits.fillna({"book": "?"}), 2)))


def test_chat_history(spark):
    path = new_table_path(spark, "chat")
    schema = "conv_id long, turn long, role string, text string"
    generation.append_messages(spark.createDataFrame([(1, 1, "assistant", "b")], schema), path)
    generation.append_messages(spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "c")], schema), path)
    history = spark.read.parquet(path)
    placed = {r.place: r.text for r in generation.transcript(history).collect()}
    assert placed == {0: "a", 1: "b", 2: "c"}
    assert [r.text for r in generation.transcript(history, 2).collect()] == ["c"]
    generation.clear_history(spark.createDataFrame([], schema), path)
    assert spark.read.schema(schema).parquet(path).count() == 0


def test_history_by_ranges(spark, tmp_path):
    """Stored in ranges: stretches and conversations are filters that reach the files."""
    rows = [(c, t, "user", f"{c}-{t}") for t in range(7) for c in range(500)]
    history, path = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), str(tmp_path / "h")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    generation.compact_history(history.repartition(5), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(path)
    every = generation.transcript(stored)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and every.count() == 3500
    part = generation.stretch(stored, 700, 712)
    assert [r.text for r in part.collect()] == [f"{c}-{t}" for c in (100, 101) for t in range(7)][:12]
    one = generation.transcript(stored, 42)
    assert [r.turn for r in one.collect()] == list(range(7))
    assert "PushedFilters: [IsNotNull(conv_id), EqualTo(conv_id,42)]" in one._jdf.queryExecution().executedPlan().toString()
    files = one.select(F.input_file_name()).distinct().count()
    assert files == 1 < len(list((tmp_path / "h").glob("part-*")))


def test_shared_pace(spark):
    """Two tasks with a shared interval: starts are an interval apart, own calls two."""
    from folioforge.operators.model_calls import call_model

    def connect():
        import time

        return lambda system, user: str(time.time())

    df = spark.range(0, 4, 1, 2).select(F.col("id").cast("string").alias("prompt"))
    times = sorted(
        float(r.reply)
        for r in call_model(df, "prompt", connect, min_interval=0.4, callers=2).collect()
    )
    assert times[-1] - times[0] > 0.7
