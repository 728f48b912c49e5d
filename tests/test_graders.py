"""Graders, trace parsing and answer specs, on cases made from the specification: kind x wrapping x right or wrong."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from tandem.functions import graders, mathgrade, text

YES_NO = "Is the valve open?\nOptions:\n- Yes\n- No"
LOGIC = "Is this deductively valid or invalid?\nOptions:\n- valid \n- invalid"
OPEN_BRACKETS = "Complete the rest of the sequence, making sure that the parentheses are closed properly. Input: [ <"
SORTING = "Sort the following words alphabetically: List: walnut fig"
LETTERED = "Which one?\nOptions:\n(A) tin\n(B) lead\n(C) zinc"
COUNT = "There are two jars and a lid. How many objects are there?"
TRUTH = "not ( False ) and ( True ) is"

WRAPS = ["Answer: {}", "So it goes.\n\nAnswer: {}", "**Answer: {}**", "answer is {}.", "Answer: **{}**", "Answer: <{}>"]


def bbh_cases():
    """(said, gold, question, right) of every kind of answer in every wrapping."""
    asked = [
        (YES_NO, ["Yes", "No"], ["{}", "({})", "{}, as it was shut"]), (LOGIC, ["valid", "invalid"], ["{}", "({})"]),
        (TRUTH, ["True", "False"], ["{}", "{} ()", "not ( False ) and True is {}"]), (COUNT, ["3", "14", "-2"], ["{}", "({})", "{} objects", "1 + 2 = {}"]),
        (SORTING, ["fig walnut", "oak elm ash"], ["{}"]), (LETTERED, ["(A)", "(B)", "(C)"], ["{}"]), (OPEN_BRACKETS, ["> ]", "> ] )"], ["{}"]),
    ]
    for question, answers, forms in asked:
        for gold, said, form, wrap in product(answers, answers, forms, WRAPS):
            if question == OPEN_BRACKETS and wrap.endswith("<{}>"):
                continue  # brackets in brackets
            yield wrap.format(form.format(said)), gold, question, said == gold
    for gold, said in product(("Yes", "No"), repeat=2):  # a letter for an option in dashes
        letter = "AB"[said == "No"]
        yield f"Answer: ({letter})", gold, YES_NO, said == gold
        yield f"Answer: ({letter}) {said}", gold, YES_NO, said == gold
        yield f"Answer: ({letter})", gold, None, False
    for gold, said in product("ABC", repeat=2):
        for form in ("{}", "{}.", "({}) the metal, I think", "({})"):
            yield "Answer: " + form.format(said), f"({gold})", LETTERED, said == gold
    yield "Answer: [ < > ]", "> ]", OPEN_BRACKETS, True
    yield "Answer: [ < > ] ]", "> ]", OPEN_BRACKETS, False
    yield "Answer: fig, walnut", "fig walnut", SORTING, True
    yield "Answer: (C)\n\nAnswer: <answer>", "(C)", LETTERED, True
    yield "It answered nothing: (A)\n(B)\n", "(B)", LETTERED, True
    yield "Answer: 1,250", "1250", COUNT, True
    for empty in ("", None):
        yield empty, "No", YES_NO, False


def gsm_cases():
    for gold, said in product(("7", "-15", "2450", "2.5"), repeat=2):
        forms = ["{}", "{}."] + (["${}.00"] if said.isdigit() else []) + (["5/2"] if said == "2.5" else []) + (["\u2212" + said[1:]] if said[0] == "-" else [])
        for form in forms:
            shown = form.format(said)
            for wrap in ("Answer: {}", "Answer: {}\n\nThis result takes 3 lines.", "The final result is {}", "See the <answer> tag.\nAnswer: {}", "9 jars, so {}"):
                yield wrap.format(shown), f"8 steps\n#### {gold}", said == gold
    yield "no digits", "#### 3", False
    yield "Answer: 3", "no gold", False
    yield "Answer: 4/0", "#### 4", False


def letter_cases(letters, wraps):
    for gold, said, wrap in product(letters, letters, wraps):
        yield wrap.format(said), gold, said == gold
    yield "nothing of the kind", letters[0], False
    yield "", letters[0], False


LSAT = ["The answer is ({}).", "**Answer:** {}", "first answer: A, then the answer is {}", "not (A) but ({})", "so {}) it is", "{}."]
CHOICE = ["Answer: {}", "**Answer:** ({})", "The answer is ({}).", "answer is option {}", "answer ({})", "So\n\n({})", "So\n\n{}",
          "The correct option is ({}).", "Answer: (A), no.\nThen, Answer: ({})", "so\n$$\\boxed{{{}}}$$", "The answer is $\\boxed{{\\text{{({})}}}}$", "Answer: {}. Option E is close"]
NO_CHOICE = ["the answer {} gave is off", "Team {} won by 3", "- ({}) is what they say - maybe", "Mr. {}.K. Lowe signed it, who else"]


def math_cases():
    """(said, gold, right): every notation of a value against every value."""
    notations = {
        "3/8": [r"\frac{3}{8}", r"\dfrac38", r"\frac 3{8}", "3/8", "0.375", ".375"],
        "7": ["7", r"\$7", "7.0", r"7^\circ", r"7\text{ cm}^2", r"7 \mbox{ jars}", "y=7", r"x \in 7", r"\square = 7", r"7\%", r"7^{\text{th}}"],
        "12500": ["12500", "12,500", r"12,\!500", r"\$12,\!500"],
        "roots": [r"2 \pm \sqrt{3}", r"2+\sqrt3, 2-\sqrt3", r"2 - \sqrt{3},\ 2 + \sqrt{3}", r"x = 2+\sqrt3,\; x = 2-\sqrt3"],
        "pair": ["(2,-9)", r"\left( 2, -9 \right)", "(p, q) = (2, -9)"],
        "list": ["4, -1", "-1,4", r"x = 4,\ x = -1"],
        "matrix": [r"\begin{pmatrix} 1/6 \\ -2 \end{pmatrix}", r"\begin{pmatrix} \frac16 \\ -2 \end{pmatrix}"],
        "based": ["2013", "2013_{5}"], "choice": [r"\text{(D)}", "D", r"\textbf{(D)}"], "word": [r"\text{North}", "north"],
        "other word": ["South"], "poly": ["x^2+5x+6"], "swapped pair": ["(-9,2)"],
    }
    for a, b in product(notations, repeat=2):
        for said, gold in product(notations[a], notations[b]):
            for wrap in (r"so \boxed{1} no, \boxed{%s}", r"\boxed{%s}"):
                yield wrap % said, gold, a == b
    yield "The final answer is 19.", "19", True
    yield "It is clear.\n19", "19", True
    yield r"\boxed{2, 4, 4}", "2, 4, 6", False
    yield r"\boxed{2, 4}", "2, 4, 6", False
    yield r"\boxed{\frac{b + 1}{2}}", r"\frac{1 + b}{2}", False  # no algebra
    yield "", "7", False


CASES = {
    "bbh": list(bbh_cases()), "gsm8k": list(gsm_cases()), "lsat": list(letter_cases("ABDE", LSAT)),
    "mmlu_pro": [*letter_cases("BDGJ", CHOICE), *((w.format(x), x, False) for w in NO_CHOICE for x in "AFI")], "math500": list(math_cases()),
}


def graded(spark, task, cases):
    rows = [(i, *(c if len(c) == 4 else (c[0], c[1], None, c[2]))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, generation string, answer string, question string, want boolean")
    out = graders.grade(df, task, question="question")
    return out.where("correct <> want").orderBy("i").collect()


@pytest.mark.parametrize("task", CASES)
def test_grader_cases(spark, task):
    assert graded(spark, task, CASES[task]) == []


def test_numeric_predictions_are_shortest_text(spark):
    df = spark.createDataFrame([("Answer: 12.0",), ("Answer: 5/2",), ("none",)], "generation string").withColumn("answer", F.lit("#### 1"))
    assert [r.pred for r in graders.grade(df, "gsm8k").collect()] == ["12", "2.5", None]


def test_math_gold_and_prediction_share_one_form():
    for _, gold, _ in CASES["math500"]:
        assert mathgrade.graded("{" + gold + "}", True, gold, False)[1], gold


def test_deep_braces_and_long_answers(spark):
    """100,000 braces, closed or not, in prediction and gold, and long runs of signs: graded in a task, without recursion."""
    deep = "{" * 100_000 + "7" + "}" * 100_000
    cases = [
        ("\\boxed{" + deep + "}", deep, True), ("\\boxed{" + deep + "}", "{" * 100_000 + "8" + "}" * 100_000, False),
        ("\\boxed{" + "{" * 100_000 + "7", "7", False), ("\\boxed{" + "\\frac{1}" * 20_000 + "}", "1", False),
        ("\\boxed{" + "\\text{cm}" * 20_000 + "}", "1", False), ("answer: " + "," * 50_000, "1", False),
    ]
    assert graded(spark, "math500", cases) == []


def test_each_distinct_answer_is_read_once(spark, monkeypatch):
    cases = [("\\boxed{\\frac{1}{2}}", "0.5")] * 500 + [("\\boxed{12}", "12")] * 500
    df = spark.createDataFrame(cases, "generation string, answer string").repartition(6)
    out = graders.grade(df, "math500")
    assert out.where("correct").count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "ArrowEvalPython" not in plan
    assert {r.pred for r in out.collect()} == {"\\frac{1}{2}", "12"}


def test_unknown_task_and_missing_columns(spark):
    df = spark.createDataFrame([("x", "y")], "generation string, answer string")
    with pytest.raises(ValueError):
        graders.grade(df, "nope")
    with pytest.raises(ValueError):
        graders.regrade(df, "gsm8k")
    assert graders.grader_version("bbh").startswith("bbh:")


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("body", ["two and two", "  \n "])
def test_traces(spark, body, closed):
    """Every way to open a trace, closed and unclosed, with and without content."""
    cut = body.strip() != "" and not closed
    ways = [
        (f"<think>{body}" + "</think>\n4" * closed, ""), (f"<THINK>{body}" + "</THINK> 4" * closed, ""),
        (body + "</think>4" * closed, "<|assistant|><think>"), (body + "</think>4" * closed, "<|assistant|><think>\n"),
        (f"<|channel|>analysis<|message|>{body}" + "<|end|><|channel|>final<|message|>4" * closed, ""),
    ]
    if not closed and not body.strip():
        return  # an opened trace that says nothing and goes nowhere is left open by its own test
    df = spark.createDataFrame(ways, "r string, p string").withColumn("a", text.assess_reasoning(F.col("r"), F.col("p")))
    assert {(r.a.has_reasoning, r.a.unclosed) for r in df.collect()} == {(body.strip() != "", cut)}


def test_no_trace(spark):
    df = spark.createDataFrame([("it is 4", ""), ("it is 4", "<|assistant|><think></think>")], "r string, p string")
    assert {(r.a.has_reasoning, r.a.unclosed) for r in df.select(text.assess_reasoning(F.col("r"), F.col("p")).alias("a")).collect()} == {(False, False)}


def test_strip_thinking(spark):
    """What is left is the answer, however the trace is written; an unclosed trace stays."""
    left = " four \n"
    ways = [left, f"<think>x</think>{left}", f"<think>x</think>no<think>y</think>{left}", f"<think>x</think><response>{left}</response> z",
            f"<response>{left}", f"<|channel|>analysis<|message|>x<|end|><|channel|>final<|message|>{left}<|return|>z"]
    df = spark.createDataFrame([(w,) for w in ways], "r string").select(text.strip_thinking(F.col("r")).alias("got"))
    assert {r.got.strip() for r in df.collect()} == {"four"}
    kept = spark.createDataFrame([("<think>never closed",)], "r string").select(text.strip_thinking(F.col("r")).alias("got"))
    assert kept.first().got == "<think>never closed"


def test_unclosed_think(spark):
    rows = [("<think>so Answer: 2. But", True), ("<think>r</think>\nAnswer: 2", False), ("Answer: 2", False),
            ("<think>a</think> b <think>c", True), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "r string, want boolean")
    assert df.where(text.think_left_open(F.col("r")) != F.col("want")).count() == 0


def test_answer_kinds_and_prompts(spark):
    rows = [(YES_NO, "yes_no"), (LOGIC, "valid_invalid"), (OPEN_BRACKETS, "dyck"), (SORTING, "word_list"),
            (LETTERED, "letter"), (COUNT, "number"), ("not ( True ) and ( True ) is", "true_false"),
            ("((-1 + 2) * 3) =", "number"), ("Does Ann tell the truth?", "yes_no"), ("free text", None)]
    df = spark.createDataFrame(rows, "q string, want string").withColumn("k", text.infer_kind(F.col("q")))
    assert df.where("not (k <=> want)").collect() == []
    shown = df.withColumn("p", text.prompt("bbh", F.col("q"))).where("want = 'true_false'").first().p
    assert "'Answer: True'" in shown and "'Answer: False'" in shown


def test_answer_specs(spark):
    listed = "Stem\n\n(A) x\n(B) y\n(C) z"
    rows = [("mmlu_pro", listed, "B", "m-1", True, "B", None),
            ("mmlu_pro", listed, "H", "m-2", False, "H", "not among options"),
            ("bbh", LETTERED, "(B)", "bbh-ruin_names-3", True, "B", None),
            ("bbh", YES_NO, "yes", "bbh-navigate-0", True, "Yes", None),
            ("bbh", "x", "invalid", "bbh-formal_fallacies-1", True, "invalid", None),
            ("bbh", COUNT, "3", "bbh-object_counting-0", False, None, "free-form")]
    for task in ("mmlu_pro", "bbh"):
        mine = [r[1:4] for r in rows if r[0] == task]
        df = spark.createDataFrame(mine, "question string, answer string, sample_id string")
        got = {r.sample_id: r for r in text.answer_specs(df, task).collect()}
        for _, _, _, sid, covered, gold, reason in (r for r in rows if r[0] == task):
            assert got[sid].covered is covered and got[sid].gold == gold, got[sid]
            assert reason is None or reason in got[sid].exclude_reason
    with pytest.raises(ValueError):
        text.answer_specs(df, "gsm8k")


def test_surface_forms_and_render(spark):
    df = spark.createDataFrame([("A", "valid", " stem ", ["p", "q"])], "a string, w string, s string, o array<string>")
    got = df.select(
        text.surface_forms(F.col("a"), "Answer:").alias("x"), text.surface_forms(F.col("a"), "Answer: (").alias("y"),
        text.surface_forms(F.col("w"), "Answer:").alias("z"), text.render_options(F.col("s"), F.col("o")).alias("r"),
    ).first()
    assert got.x == [" A", "A"] and got.y == ["A", " A"]
    assert got.z == [" valid", "valid", " Valid", "Valid"]
    assert got.r == "stem\n\n(A) p\n(B) q"


def test_regrade(spark):
    rows = [("a", "work\n#### 2", "Answer: 3", "<think>x</think>\nAnswer: 2", False, False),
            ("b", "work\n#### 2", "Answer: 2", "<think>so Answer: 2. But", True, True)]
    df = spark.createDataFrame(
        rows, "sample_id string, answer string, response_off string, response_on string, correct_off boolean, correct_on boolean")
    out = {r.sample_id: r for r in graders.regrade(df, "gsm8k").collect()}
    assert (out["a"].correct_off, out["a"].correct_on, out["a"].correct_on_stored) == (False, True, False)
    assert (out["b"].correct_on, out["b"].unclosed_think_on, out["b"].correct_on_stored) == (False, True, True)
