import pytest
from pyspark.sql import functions as F

from folioforge.functions import cleaning, math_blocks, structure

def T():
    return F.col("t")


def test_protected_blocks_in_order(spark):
    text = "a $x$ b \\(y\\) \\[z\\] $v$"
    p = one(spark, text, math_blocks.preserve_math_blocks(T()))
    marks = [b.placeholder for b in p.blocks]
    assert len(set(marks)) == len(marks) and all(p.text.count(m) == 1 for m in marks)
    assert sorted(b.content for b in p.blocks) == sorted(["$x$", "\\(y\\)", "\\[z\\]", "$v$"])
    back = math_blocks.restore_math_blocks(F.col("p.text"), F.col("p.blocks"))
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(math_blocks.preserve_math_blocks(T()).alias("p")).select(back).first()[0] == text


def test_equations_carry_their_place(spark):
    text = "let $a+b$ be. \\[ c \\] and \\begin{align}d\\end{align} end"
    found = one(spark, text, math_blocks.extract_equations(T()))
    assert {text[e.start : e.end] for e in found} == {"$a+b$", "\\[ c \\]", "\\begin{align}d\\end{align}"}
    assert all(e.context in text and e.content in e.context for e in found)


def test_word_marks(spark):
    """Without headings, a boundary stands at every 500th word."""
    text = " ".join(f"w{i}" for i in range(1501))
    marks = one(spark, text, structure.detect_section_boundaries(T()))
    assert [text[m:].split(" ")[0] for m in marks] == ["w500", "w1000", "w1500"]
    assert one(spark, " ".join(["x"] * 499), structure.detect_section_boundaries(T())) == []
    assert one(spark, "", structure.detect_section_boundaries(T())) == []


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("wordWord word3 3word a.Bc a,b x;y", "word Word word 3 3 word a. Bc a, b x; y"),
        ("f(x) (a)b x=y a<b c>d k:v %5 5%", "f (x) (a) b x = y a < b c > d k: v % 5 5 %"),
        ("Chapter 6", "Chapterer 6"),
        ("Figure 3", "Figureure 3"),
        ("Fig. 3", "Figure. 3"),
        ("Equation 2", "Equationuation 2"),
        ("Section 5.4", "Sectionion 5.4"),
        ("Apply", "Appendixly"),
        ("set also", "set al. so"),
        ("e.g. x", "e. g.. x"),
        ("Section 5 3", "Sectionion 5.3"),
        ("a\n\n \n\nb", "a\n\nb"),
        ("a\r\n\r\n\r\nb", "a\n\nb"),
        ("a \n. b", "a. b"),
        ("x \\(y\\) \\[z\\]", "x (y) [z]"),
        ("x ^ 2 y _ 3 zz--- __ **", "x^2 y_3 zz— _ *"),
        ("", ""),
        (" \xa0\u3000 ", ""),
    ],
)
def test_hand_cases(spark, raw, expected):
    assert one(spark, raw, cleaning.clean_text(T())) == expected


def test_shadowed_encoding_keys(spark):
    # The bare two-character key is replaced before the dashes that start with it.
    assert one(spark, "â€\u201c", cleaning.fix_encoding_issues(T())) == '"\u201c'
    assert one(spark, "âˆž", cleaning.fix_math_symbols(T())) == "√ž"
    assert one(spark, "âˆ†âˆ‘âŠ‚", cleaning.fix_math_symbols(T())) == "∆∑⊂"
    assert one(spark, "â‰ x", cleaning.fix_math_symbols(T())) == "≠x"


def test_flags(spark):
    raw = "wordWord Ã© âˆ†  x"
    off = cleaning.clean_text(T(), False, False, False, False)
    assert one(spark, raw, off) == raw
    assert one(spark, raw, cleaning.clean_text(T(), fix_spaces=False)) == "wordWord é ∆ x"
    assert one(spark, None, cleaning.clean_text(T())) == ""


def test_chunking_stats(spark):
    s = one(spark, "ab $x+y$ c = 3", structure.chunking_stats(T()))
    assert (s.word_count, s.char_count, s.equation_count, s.has_math) == (5, 14, 1, True)
    assert s.math_density == pytest.approx(3 / 14) and s.avg_word_length == pytest.approx(2.0)
    e = one(spark, "", structure.chunking_stats(T()))
    assert (e.word_count, e.char_count, e.math_density, e.avg_word_length, e.has_math) == (
        0, 0, 0.0, 0.0, False,
    )


def test_title_and_previews(spark):
    assert one(spark, " A: b-c (2) ", structure.sanitize_title(T())) == "A_b-c_2"
    assert one(spark, "a\nb" + "c" * 10, structure.cut_preview(T(), 5)) == "a bcc..."
    assert one(spark, "²x", structure.starts_clean(T())) and one(spark, "Éa", structure.starts_clean(T()))
    assert not one(spark, " ab", structure.starts_clean(T()))
    assert one(spark, 'ab." \n', structure.ends_clean(T())) and not one(spark, "", structure.ends_clean(T()))


MODES = [
    # A shorter key shadows a longer one (Q1, Q2), and the sign for "unequal" ends in a blank (Q3).
    ("a â€“ b â€” c", 'a "“ b "” c', "a – b — c"),
    ("âˆž âˆ« âˆš", "√ž √« √š", "∞ ∫ √"),
    ("â‰ x â‰ y", "≠x â‰ y", "≠x ≠y"),
    # Abbreviations without and with word bounds (Q4), so that captions keep their name (Q5).
    ("Chapter 6, Figure 3, Fig. 3", "Chapterer 6, Figureure 3, Figure. 3", "Chapter 6, Figure 3, Figure 3"),
    ("Apply it, e.g. here, vs them", "Appendixly it, e. g.. here, vs. them", "Apply it, e.g. here, vs. them"),
]


@pytest.mark.parametrize("text, faithful, fixed", MODES)
def test_quirks_in_both_modes(spark, text, faithful, fixed):
    assert one(spark, text, cleaning.clean_text(T())) == faithful
    assert one(spark, text, cleaning.clean_text(T(), mode="fixed")) == fixed
    again = one(spark, fixed, cleaning.clean_text(T(), mode="fixed"))
    assert again == fixed


def test_equations_survive_in_fixed_mode(spark):
    text = "wordWord $a_ 1+b ^ 2$ and \\[ x,y \\] so\r\n\r\n\r\n\r\nx=3 , 7"
    lost = one(spark, text, math_blocks.clean_for_chunking(T()))
    kept = one(spark, text, math_blocks.clean_for_chunking(T(), mode="fixed"))
    assert "MATH_BLOCK" in lost and "$a_ 1+b ^ 2$" not in lost
    assert kept == "word Word $a_ 1+b ^ 2$ and \\[ x,y \\] so\n\nx=3, 7"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r.t for r in math_blocks.clean_column_for_chunking(df, "t", mode="fixed").collect()] == [kept, ""]
    with pytest.raises(ValueError, match="mode"):
        cleaning.clean_text(T(), mode="better")


def test_rare_steps_of_one_expression_are_guarded(spark):
    """A text without mis-decoded characters used to be searched for every one of them."""
    texts = ["plain the x^2", "cafÃ© â€™ âˆ† Â±", "a--b__c \\( e.g", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cleaning.clean_text(T())).collect()] == [
        r[0] for r in cleaning.clean_column(df, "t").collect()
    ]
    plan = df.select(cleaning.clean_text(T()))._jdf.queryExecution().optimizedPlan().toJSON()
    assert "expressions.Contains" in plan


def test_longest_keys_are_found_by_their_first_character():
    """Every place of a text used to be compared with every key."""
    import random
    import re

    from folioforge.functions import corrected

    keys = corrected.longest_first(corrected.DECODING)
    pattern = corrected._any_of(keys)
    assert re.match(r"\(\?=\[", pattern)
    rng, plain = random.Random(3), "|".join(map(re.escape, keys))
    for _ in range(300):
        text = "".join(rng.choice([*keys, *"Ãâ€ ab^-]\\"]) for _ in range(30))
        assert re.findall(pattern, text) == re.findall(plain, text)
    odd = {"]x": "1", "^y": "2", "-z": "3", "\\w": "4", "a": "5", "ab": "6"}
    text = "]x ^y -z \\w ab a b"
    assert re.findall(corrected._any_of(corrected.longest_first(list(odd.items()))), text) == ["]x", "^y", "-z", "\\w", "ab", "a"]


def test_artifact_steps_are_guarded_in_both_chains(spark):
    """The corrected chain used to run all of them on every text."""
    texts = ["plain", "aaaaa!!! a--b __ ** \\( x ^ 2 y _ 3 Section 5  3", "x _ y _ z...", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = [r[0] for r in df.select(cleaning.clean_artifacts(T())).collect()]
    assert [r[0] for r in cleaning.guarded(df, "t", cleaning.artifact_steps()).collect()] == whole
    for chain in (cleaning._chain("faithful"), cleaning._chain("fixed")):
        assert {("^",), ("_",), ("\\",)} <= {needles for needles, _ in chain(True, True, True, True)}
