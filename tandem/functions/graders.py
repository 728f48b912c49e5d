"""Batch graders: ``grade(df, task)`` adds ``pred`` and ``correct`` to a whole table.

Graders are column expressions; only mathematics answers that are no plain
numbers are read outside them, each distinct pair once.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mathgrade, text
from .text import LETTERS, cut_dots, dash_options, last_line, strip

# Answer patterns ----------------------------------------------
NUMBER = r"-?\$?\d[\d,]*(?:\.\d+)?(?:\s*/\s*\d+(?:\.\d+)?)?"
ANSWER_MARK = r"(?iU)(?<![<\w])answer\b\s*(?:is\b)?\s*[:=]?\s*"
RESULT_MARK = r"(?iU)(?<![<\w])result\b\s*(?:is\b)?\s*[:=]?\s*"
MINUS_SIGN = "\u2212"
_DECIMAL = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
QUOTIENT = rf"(?U)^\s*{_DECIMAL}(?:\s*/\s*{_DECIMAL})?\s*$"
NO_PART_OF_A_NUMBER = r"(?U)[,$ ]|[\s.]+$"

MARKED_LETTER = r"(?iU)(?:answer|choice|option)\s*(?:is)?\s*[:=]?\s*\**\s*\(?([A-E])\)?\b"
BARE_LETTER = r"\([A-E]\)|(?<![A-Za-z])[A-E]\)"

# mmlu_pro: marker + letter with a separator, with "is", or wrapped; or a boxed letter.
_OPTION = r"(?:(?i:option|choice)\s+)?"
_TEXT = r"(?:\\text(?:bf)?\s*\{\s*)?"
_BOX = r"\$*\s*\\boxed\s*\{\s*"
_END = r"(?![A-Za-z0-9])"
_ANSWER = r"(?<![<\w])(?i:answer)\b\s*"
_LOOSE = rf"\s*\**\s*{_OPTION}(?:{_BOX})?{_TEXT}\(?\s*[A-J]\s*\)?{_END}"
_IN_BOX = rf"\s*\**\s*{_OPTION}{_BOX}{_TEXT}\(?\s*[A-J]\s*\)?{_END}"
_IN_PARENS = rf"\s*\**\s*{_OPTION}{_TEXT}\(\s*[A-J]\s*\){_END}"
CHOICE_LETTER = (
    rf"(?U){_ANSWER}(?:\**\s*(?i:is)\b)?\s*\**\s*[:=]{_LOOSE}"
    rf"|{_ANSWER}\**\s*(?i:is)\b\s*\**\s*{_LOOSE}"
    rf"|{_ANSWER}\**{_IN_BOX}|{_ANSWER}\**{_IN_PARENS}"
    r"|\\boxed\s*\{\s*" + _TEXT + r"\(?\s*[A-J]\s*\)?\s*\}"
)
FINAL_LINE_LETTER = (
    r"(?U)^\W*(?:(?i:the\s+)?(?:(?i:correct)\s+)?(?i:option|choice)\s*(?:(?i:is)\s*)?:?\s*)?"
    r"\(?([A-J])\)?\W*$"
)

# bbh: the first line after each marker, read ahead so markers may share a line.
MARKED_LINE = r"(?iU)(?<![<\w])answer\b\s*(?:is\b)?\s*[:=]?\s*\**\s*(?=([^\n\r]*))"
PLACEHOLDER = r"(?iU)^\W*<\s*answer\s*>\W*$"
CATEGORICAL = ["yes", "no", "true", "false", "valid", "invalid"]
MARKUP = r"\*\*|[`$]"
IN_ANGLES = r"(?sU)^\s*<\s*([^>]*?)\s*>(.*)$"
ENDS = r"(?U)^\s*\.*\s*|\s*\.*\s*$"
BRACKETS = r"^[\s()\[\]{}<>]+$"


def _last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _some(c: Column) -> Column:
    """NULL for the empty string."""
    return F.when(c != "", c)


# Numbers ---------------------------------------------------------------------

def number_value(c: Column) -> Column:
    """The value of a numeric text ("$1,234.", "3/2") as DOUBLE, else NULL."""
    shown = F.regexp_replace(F.translate(c, MINUS_SIGN, "-"), NO_PART_OF_A_NUMBER, "")
    top, low = (F.regexp_extract(shown, QUOTIENT, k) for k in (1, 2))
    over = F.when(low != "", low.try_cast("double")).otherwise(1.0)
    return F.when(top != "", F.try_divide(top.try_cast("double"), over))


def numeric_gold(answer: Column) -> Column:
    marked = F.contains(answer, F.lit("####"))
    return number_value(F.when(marked, F.substring_index(answer, "####", -1)).otherwise(answer))


def solution_gold(answer: Column) -> Column:
    """Gold number of a worked solution: after ####, else its last number."""
    marked = F.contains(answer, F.lit("####"))
    return F.when(marked, number_value(F.substring_index(answer, "####", -1))).otherwise(
        number_value(_last(_all(answer, NUMBER)))
    )


def numeric_prediction(generation: Column) -> Column:
    t = F.replace(generation, F.lit(MINUS_SIGN), F.lit("-"))

    def after(mark):
        parts = F.split(t, mark)
        return F.when(F.size(parts) > 1, _some(F.regexp_extract(_last(parts), NUMBER, 0)))

    return number_value(F.coalesce(after(ANSWER_MARK), after(RESULT_MARK), _last(_all(t, NUMBER))))


def grade_gsm8k(rows: DataFrame) -> DataFrame:
    got = rows.withColumn("__value", numeric_prediction(F.col("__gen")))
    value = F.col("__value")
    shown = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
    return got.withColumn("__ok", value == numeric_gold(F.col("__ans"))).withColumn("__pred", shown).drop("__value")


# Letters ---------------------------------------------------------------------

def letter_prediction(generation: Column) -> Column:
    marked = F.upper(_last(_all(generation, MARKED_LETTER, 1)))
    bare = _some(F.regexp_extract(_last(_all(generation, BARE_LETTER)), "[A-E]", 0))
    alone = F.upper(F.rtrim(strip(generation), F.lit(".")))
    return F.coalesce(marked, bare, F.when(alone.rlike("^[A-E]$"), alone))


def _letter_grade(rows: DataFrame, pred: Column, letters: str) -> DataFrame:
    gold = F.upper(strip(F.col("__ans")))
    return rows.withColumn("__pred", pred).withColumn(
        "__ok", gold.isin(*letters) & (F.col("__pred") == gold)
    )


def grade_lsat(rows: DataFrame) -> DataFrame:
    return _letter_grade(rows, letter_prediction(F.col("__gen")), LETTERS[:5])


def choice_prediction(generation: Column) -> Column:
    hit = _last(_all(generation, CHOICE_LETTER))
    marked = _some(F.regexp_extract(hit, r"([A-J])[^A-J]*$", 1))
    return F.coalesce(marked, _some(F.regexp_extract(last_line(generation), FINAL_LINE_LETTER, 1)))


def grade_mmlu_pro(rows: DataFrame) -> DataFrame:
    return _letter_grade(rows, choice_prediction(F.col("__gen")), LETTERS)


# Many kinds ------------------------------------------------------------------

def normalize(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    s = F.replace(F.replace(s, F.lit("**"), F.lit("")), F.lit("$"), F.lit(""))
    s = F.regexp_replace(s, r"(?U)^(?:the answer is|answer)\s*[:=]?\s*", "")
    return F.regexp_replace(strip(cut_dots(strip(s))), r"(?U)\s+", " ")


def line_prediction(generation: Column) -> Column:
    real = F.filter(_all(generation, MARKED_LINE, 1), lambda x: (strip(x) != "") & ~x.rlike(PLACEHOLDER))
    return F.coalesce(strip(_last(real)), last_line(generation))


def bare(c: Column) -> Column:
    """An answer without signs of markup, out of the angle brackets it opens with, without dots at its ends."""
    plain = F.regexp_replace(F.translate(c, MINUS_SIGN, "-"), MARKUP, "")
    inner, after = (F.regexp_extract(plain, IN_ANGLES, k) for k in (1, 2))
    return F.regexp_replace(F.when(plain.rlike(IN_ANGLES), F.concat(inner, after)).otherwise(plain), ENDS, "")


# One canonical form per kind of answer; prediction and gold take the same way to it.

def letter_form(c: Column) -> Column:
    return F.coalesce(_last(_all(c, r"\(([A-Z])\)", 1)), cut_dots(F.upper(normalize(c))))


def word_form(c: Column, options: Column, truth: Column) -> Column:
    """The first word, after an option letter if there is one; a letter alone stands for its option.

    Of a statement that ends in "is true" or "is false" the last word counts, where ``truth`` is asked for.
    """
    low = F.lower(c)
    picked = F.regexp_extract(c, r"^\(\s*([A-Z])\s*\)", 1)
    words = _all(F.when(picked != "", F.substr(low, F.locate(")", low) + 1)).otherwise(low), "[a-z]+")
    named = F.try_element_at(options, F.greatest(F.ascii(picked) - 64, F.lit(1)))
    words = F.when((picked != "") & (F.size(words) == 0), _all(F.lower(named), "[a-z]+")).otherwise(words)
    claim = truth & (F.try_element_at(words, F.lit(-2)) == "is") & _last(words).isin("true", "false")
    return F.when(F.coalesce(claim, F.lit(False)), _last(words)).otherwise(F.try_element_at(words, F.lit(1)))


def integer_form(c: Column) -> Column:
    """The first whole number after the last equals sign."""
    digits = F.regexp_extract(F.replace(F.substring_index(c, "=", -1), F.lit(","), F.lit("")), r"-?\d+", 0)
    return digits.try_cast("decimal(38,0)").cast("string")


def brackets_form(c: Column, question: Column) -> Column:
    """The closing part of a bracket sequence: what the question gave is cut off."""
    tight = lambda x: F.translate(F.regexp_replace(x, r"(?U)\s", ""), "`*", "")
    shown, given = tight(c), tight(F.substring_index(question, "Input:", -1))
    again = F.coalesce(F.contains(question, F.lit("Input:")) & F.startswith(shown, given), F.lit(False))
    return F.when(again, F.substr(shown, F.length(given) + 1)).otherwise(shown)


def list_form(c: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(c), r"(?U)[\s,]+"), lambda w: w != ""), " ")


def answer_form(c: Column, gold: Column, question: Column) -> Column:
    """``c`` in the form of the gold's kind: letter, word, whole number, brackets or list of words."""
    low = F.lower(gold)
    return (
        F.when(gold.rlike(r"^\([A-Z]\)$"), letter_form(c))
        .when(low.isin(*CATEGORICAL), word_form(bare(c), dash_options(question), low.isin("true", "false")))
        .when(gold.rlike(r"^-?\d+$"), integer_form(bare(c)))
        .when(gold.rlike(BRACKETS), brackets_form(F.when(c == gold, c).otherwise(bare(c)), question))
        .otherwise(list_form(bare(c)))
    )


def grade_bbh(rows: DataFrame) -> DataFrame:
    got = rows.withColumn("__pred", line_prediction(F.col("__gen"))).withColumn("__gold", strip(F.col("__ans")))
    pred, gold, ask = F.col("__pred"), F.col("__gold"), F.col("__ask")
    same = answer_form(pred, gold, ask) == answer_form(gold, gold, ask)
    as_said = (normalize(pred) == normalize(gold)) & pred.isNotNull()
    return got.withColumn("__ok", F.coalesce(same, F.lit(False)) | as_said).drop("__gold")


# Mathematics -----------------------------------------------------------------

def grade_math500(rows: DataFrame) -> DataFrame:
    return mathgrade.grade_rows(rows, "__gen", "__ans", "__pred", "__ok")


# Registry --------------------------------------------------------------------

GRADERS = {
    "gsm8k": grade_gsm8k,
    "lsat": grade_lsat,
    "math500": grade_math500,
    "mmlu_pro": grade_mmlu_pro,
    "bbh": grade_bbh,
}


def grader_version(task: str) -> str:
    """``<task>:<12 hex of the grader's source>``, so a label says what graded it."""
    if task not in GRADERS:
        raise ValueError(f"unknown task {task!r}")
    source = "".join(inspect.getsource(m) for m in (inspect.getmodule(grade_bbh), mathgrade, text))
    return f"{task}:{hashlib.sha256(source.encode()).hexdigest()[:12]}"


def grade(
    df: DataFrame, task: str, generation: str = "generation", answer: str = "answer",
    question: str | None = None, pred: str = "pred", correct: str = "correct",
) -> DataFrame:
    """Adds the extracted answer and whether it matches the gold; no generation is wrong."""
    if task not in GRADERS:
        raise ValueError(f"unknown task {task!r}")
    rows = (
        df.withColumn("__gen", F.coalesce(F.col(generation), F.lit("")))
        .withColumn("__ans", F.coalesce(F.col(answer).cast("string"), F.lit("None")))
        .withColumn("__ask", F.col(question) if question else F.lit(None).cast("string"))
    )
    some = F.col("__gen") != ""
    got = GRADERS[task](rows)
    return (
        got.withColumn(pred, F.when(some, F.col("__pred").cast("string")))
        .withColumn(correct, some & F.coalesce(F.col("__ok"), F.lit(False)))
        .drop("__gen", "__ans", "__ask", "__pred", "__ok")
    )


def regrade(df: DataFrame, task: str) -> DataFrame:
    """Grades both stored responses again; the old grades stay as ``*_stored``.

    A response whose last <think> never closes has no answer and is wrong.
    """
    missing = [c for c in ("response_off", "response_on", "answer") if c not in df.columns]
    if missing:
        raise ValueError(f"cannot regrade without {missing}")
    question = "question" if "question" in df.columns else None
    out = df
    for mode in ("off", "on"):
        response = F.coalesce(F.col(f"response_{mode}"), F.lit(""))
        stored = F.col(f"correct_{mode}") if f"correct_{mode}" in df.columns else F.lit(False)
        out = (
            out.withColumn(f"correct_{mode}_stored", F.coalesce(stored, F.lit(False)))
            .withColumn(f"unclosed_think_{mode}", text.think_left_open(response))
            .withColumn("__body", text.strip_thinking(response))
        )
        out = grade(out, task, "__body", "answer", question, "__said", "__right")
        out = out.withColumn(
            f"correct_{mode}", ~F.col(f"unclosed_think_{mode}") & F.col("__right")
        ).drop("__body", "__said", "__right")
    return out
