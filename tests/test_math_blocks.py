"""Math blocks against plain loops, and how their time grows with one text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioforge.functions import math_blocks
from folioforge.plans.oracle import EQUATIONS

BLOCKS = "t string, b array<struct<placeholder:string,content:string,type:string>>"


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def restored(text, blocks):
    for mark, content, _ in blocks:
        text = text.replace(mark, content)
    return text


def mark(i, kind="INLINE_MATH"):
    return f"__{kind}_{i}__"


CASES = [
    ("", []),
    ("no marks", [(mark(0), "$x$", "m")]),
    (f"a {mark(0)} b {mark(1)}{mark(0)}", [(mark(0), "$x$", "m"), (mark(1), "$y$", "m")]),
    (f"{mark(7)} names nothing, {mark(0)} does", [(mark(0), "$x$", "m")]),
    (f"{mark(0, 'ENV_MATH')} of another kind", [(mark(0), "$x$", "m")]),
    # An original that holds a later placeholder, one that holds an earlier one.
    (f"{mark(0)} {mark(1)}", [(mark(0), f"<{mark(1)}>", "m"), (mark(1), "$y$", "m")]),
    (f"{mark(0)} {mark(1)}", [(mark(0), "$x$", "m"), (mark(1), f"<{mark(0)}>", "m")]),
    # Numbers that are not places; shared underscores.
    (f"{mark(5)} {mark(2)}", [(mark(5), "$x$", "m"), (mark(2), "$y$", "m")]),
    ("__INLINE_MATH_1__INLINE_MATH_0__", [(mark(0), "$x$", "m"), (mark(1), "$y$", "m")]),
    ("__INLINE_MATH_99999999999__", [(mark(0), "$x$", "m")]),
    (None, [(mark(0), "$x$", "m")]),
]


def test_restoring_equals_replacing_in_turn(spark):
    got = values(spark, CASES, BLOCKS, math_blocks.restore_math_blocks(F.col("t"), F.col("b")))
    assert got == [None if t is None else restored(t, b) for t, b in CASES]


def hidden(text):
    contents = [m[0] for p in patterns() for m in re.finditer(p, text)]
    for i, content in enumerate(contents):
        text = text.replace(content, f"__MATH_BLOCK_{i}__")
    return text


def patterns():
    """In the plain spelling of the SQL equivalents, which Python reads too."""
    return [p for _, p in EQUATIONS]


TOKENS = ["$", "$x$", "= 5", "= 50", "=5", "≠a", "∑", "x", " ", "\\[", "\\]", "\\(y\\)", "= a_", "_", "__M", "\\begin{align}", "\\end{align}", "≤", "(", "5"]


@pytest.mark.parametrize("few", [0, 32])
def test_hiding_equals_replacing_in_turn(spark, monkeypatch, few):
    monkeypatch.setattr(math_blocks, "FEW_EQUATIONS", few)
    rng = random.Random(9)
    texts = ["".join(rng.choices(TOKENS, k=rng.choice([3, 20, 150]))) for _ in range(300)]
    texts += ["", None, "= 50 = 5 = 50", "$a$ $b$a$c$ =1_$x$", "__MATH_BLOCK_0__ $x$"]
    got = values(spark, [(t,) for t in texts], "t string", math_blocks.hide_equations(F.col("t")))
    for text, found in zip(texts, got, strict=True):
        assert found == (None if text is None else hidden(text)), text


def test_equations_of_a_corpus_are_found_once(spark):
    """A pattern runs once over a column, twice in an expression, and hides the same."""
    few, many = "$x$ = 5 and = 50, = 5", "".join(f"$x_{i}$ = {i} and = a_ " for i in range(40))
    texts = [few, many, many.replace("a_", "a"), "__MATH_BLOCK_0__ $x$", "none", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    column, expr = math_blocks.hide_column(df, "t"), df.select(math_blocks.hide_equations(F.col("t")).alias("t"))
    for hiding, most in [(column, 1), (expr, 2)]:
        assert hiding.columns == ["t"]
        assert [r.t for r in hiding.collect()] == [None if t is None else hidden(t) for t in texts]
        plan = hiding._jdf.queryExecution().executedPlan().toString()
        assert plan.count("eqnarray\\}.*?") == most, plan


@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000])
def test_offsets_over_several_pieces(spark, n):
    text = "".join(f"w{i} $a{i}$ = {i} " for i in range(n)) + "end"
    (found,) = values(spark, [(text,)], "t string", math_blocks.extract_equations(F.col("t")))
    want = [(m[0], m.start(), m.end()) for p in patterns() for m in re.finditer(p, text)]
    assert [(e.content, e.start, e.end) for e in found] == want
    assert all(e.context == text[max(0, e.start - 100) : e.end + 100] for e in found)


def seconds(spark, text, expr):
    df = spark.createDataFrame([(text,)], "t string").select(expr.alias("x"))
    times = []
    for _ in range(3):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return min(times)


def equations(n):
    return "".join(f"some words, $x_{i}+y_{i}$ and = {i} more. " for i in range(n))


@pytest.mark.parametrize(
    "name, expr",
    [
        ("extract", lambda t: math_blocks.extract_equations(t)),
        ("hide", lambda t: math_blocks.hide_equations(t)),
        ("restore", lambda t: math_blocks.restore_math_blocks(
            math_blocks.preserve_math_blocks(t)["text"], math_blocks.preserve_math_blocks(t)["blocks"])),
    ],
)
def test_time_grows_with_the_text(spark, name, expr):
    """16,000 equations in one text: two seconds each, and twice as many not over twice that."""
    once, twice = (seconds(spark, equations(n), expr(F.col("t"))) for n in (8_000, 16_000))
    assert once < 2 and twice < 2.6 * once + 0.5, (name, once, twice)
