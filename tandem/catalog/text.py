"""Queries for traces, prompts, options and graders.

SQL engines without look-behind cannot run the graders' patterns, so grader
queries plant a known answer in every row and the SQL states what must come out.
"""

from pyspark.sql import functions as F

from ..functions import graders, text
from ..sources.captures import benchmark
from .base import GEN, query

NL = "chr(10)"


def trim(x: str) -> str:
    return f"trim({x}, concat(' ', chr(9), chr(10), chr(13)))"


@query("t01_strip_thinking", f"""with {GEN} select sample_id, md5({trim("case when conv_id % 7 = 0 then response_on else concat('Answer: ', cast(turn + (conv_id % 2) as varchar)) end")}) as answer from gen""")
def t01(t):
    return t.gen().select("sample_id", F.md5(text.strip_thinking(F.col("response_on"))).alias("answer"))


@query("t02_assess_reasoning", f"""with {GEN} select sample_id, {trim("text")} <> '' as has_reasoning, exp_unclosed_on as unclosed, true as prompt_has,
 conv_id % 7 = 0 as prompt_unclosed from gen""")
def t02(t):
    g = t.gen()
    plain = text.assess_reasoning(F.col("response_on"))
    opened = text.assess_reasoning(F.replace("response_on", F.lit("<think>"), F.lit("so ")), F.lit("<|assistant|><think>\n"))
    return g.withColumn("a", plain).withColumn("p", opened).select(
        "sample_id", "a.has_reasoning", "a.unclosed", F.col("p.has_reasoning").alias("prompt_has"), F.col("p.unclosed").alias("prompt_unclosed"))


@query("t03_t04_open_think", f"with {GEN} select sample_id, exp_unclosed_on as unclosed, false as off_unclosed, false as null_unclosed from gen")
def t03(t):
    return t.gen().select(
        "sample_id", text.think_left_open(F.col("response_on")).alias("unclosed"),
        text.think_left_open(F.col("response_off")).alias("off_unclosed"),
        text.think_left_open(F.lit(None).cast("string")).alias("null_unclosed"))


_PROMPT_SQL = " union all ".join(
    f"select '{task}' as task, doc_id, sha256(concat('{head.replace(chr(39), chr(39) * 2)}', {trim('text')})) as prompt from documents"
    for task, head in text.PROMPTS.items())


@query("t05_prompts", _PROMPT_SQL)
def t05(t):
    parts = [t.documents.select(F.lit(task).alias("task"), "doc_id", F.sha2(text.prompt(task, F.col("text")), 256).alias("prompt"))
             for task in text.PROMPTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("t06_render_options", f"""with w as (select doc_id, lang, string_split(replace(text, {NL}, ' '), ' ') as w from documents)
 select doc_id, md5(array_to_string(list_concat([lang, ''], list_transform(range(1, least(len(w), 10) + 1), lambda i: concat('(', chr((64 + i)::int), ') ', w[i]))), {NL})) as shown from w""")
def t06(t):
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    stem = F.concat(F.lit(" "), "lang", F.lit("\n"))
    return t.documents.select("doc_id", F.md5(text.render_options(stem, words)).alias("shown"))


@query("t07_prompt_hash", "select doc_id, sha256(text) as prompt_hash from documents")
def t07(t):
    return t.documents.select("doc_id", text.sha256(F.col("text")).alias("prompt_hash"))


@query("t08_dash_options", f"""with {GEN}, o as (select sample_id, list_transform(string_split(text, {NL}), lambda x: {trim('x')}) as o from gen)
 select sample_id, len(o) as n, md5(array_to_string(o, '|')) as options, true as none_without_list from o""")
def t08(t):
    q = F.concat(F.lit("Which?\nOptions:\n- "), F.replace("text", F.lit("\n"), F.lit("\n - ")))
    g = t.gen().withColumn("o", text.dash_options(q))
    return g.select("sample_id", F.size("o").alias("n"), F.md5(F.array_join("o", "|")).alias("options"),
                    text.dash_options(F.col("text")).isNull().alias("none_without_list"))


_KIND_CASES = [  # (what surrounds the text, kind)
    ("", "\nOptions:\n(A) red\n(B) blue", "letter"),
    ("", "\nOptions:\n- valid \n- invalid", "valid_invalid"),
    ("", "\nOptions:\n- Yes\n- No", "yes_no"),
    ("Make sure that the parentheses are closed properly. ", " Input: [ (", "dyck"),
    ("Sort the following words alphabetically: ", "", "word_list"),
    ("", " Does Ann tell the truth?", "yes_no"),
    ("", " How many objects do I have?", "number"),
    ("", " ((1 + 2) * 3) =", "number"),
    ("", "", None),
]


def _cased(t, cases=_KIND_CASES):
    n, pick = F.col("conv_id") % len(cases), F.lit(None).cast("string")
    for i, (head, tail, _) in enumerate(cases):
        pick = F.when(n == i, F.concat(F.lit(head), "text", F.lit(tail))).otherwise(pick)
    return t.gen().withColumn("question", pick)


_KIND_SQL = "case conv_id % 9 " + " ".join(
    f"when {i} then {repr(k) if k else 'null'}" for i, (_, _, k) in enumerate(_KIND_CASES)) + " end"


@query("t09_answer_kind", f"with {GEN} select sample_id, {_KIND_SQL} as kind from gen")
def t09(t):
    return _cased(t).select("sample_id", text.infer_kind(F.col("question")).alias("kind"))


@query("t05_prompt_tails", f"with {GEN} select coalesce({_KIND_SQL}, 'none') as kind, count(*) as n from gen group by 1")
def t05_tails(t):
    """Which tail each question's prompt ends with."""
    g = _cased(t).withColumn("p", text.prompt("bbh", F.col("question")))
    kind = F.lit("none")
    for name, tail in text.BBH_TAILS.items():
        kind = F.when(F.endswith("p", F.lit(tail)), name).otherwise(kind)
    return g.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("t10_normalize", f"""with {GEN} select sample_id, md5(regexp_replace({trim("trim(" + trim("lower(text)") + ", '.')")}, '\\s+', ' ', 'g')) as norm from gen""")
def t10(t):
    dressed = F.concat(F.lit("  Answer: **"), "text", F.lit("**."))
    return t.gen().select("sample_id", F.md5(graders.normalize(dressed)).alias("norm"))


@query("p04_regrade", f"""with {GEN} select sample_id, exp_correct_off as correct_off, exp_correct_on as correct_on, exp_unclosed_on as unclosed_think_on,
 false as unclosed_think_off, true as correct_off_stored, false as correct_on_stored from gen""")
def p04(t):
    g = t.gen().withColumn("correct_off", F.lit(True)).withColumn("correct_on", F.lit(False))
    return graders.regrade(g, "gsm8k").select(
        "sample_id", "correct_off", "correct_on", "unclosed_think_on", "unclosed_think_off", "correct_off_stored", "correct_on_stored")


@query("f20_numeric_grader", f"""with {GEN} select sample_id, cast(turn + conv_id % 3 as varchar) as pred, exp_correct_off as correct from gen""")
def f20(t):
    """The whole text is read; the planted line is its last answer marker."""
    g = t.gen().withColumn("generation", F.concat("text", F.lit("\nSo the result is 7.\n"), "response_off"))
    return graders.grade(g, "gsm8k").select("sample_id", "pred", "correct")


@query("f21_letter_grader", f"""with {GEN} select sample_id, chr((65 + conv_id % 5)::int) as pred, conv_id % 5 = turn % 5 as correct from gen""")
def f21(t):
    letter = F.substring(F.lit("ABCDE"), (F.col("conv_id") % 5 + 1).cast("int"), F.lit(1))
    gold = F.substring(F.lit("ABCDE"), (F.col("turn") % 5 + 1).cast("int"), F.lit(1))
    tail = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("\nThe answer is ("), letter, F.lit(").")))\
        .otherwise(F.concat(F.lit("\nI take ("), letter, F.lit(") then")))
    g = t.gen().withColumn("generation", F.concat("text", tail)).withColumn("answer", gold)
    return graders.grade(g, "lsat").select("sample_id", "pred", "correct")


@query("f22_choice_grader", f"""with {GEN} select sample_id, case when conv_id % 6 = 5 then null else chr((65 + conv_id % 10)::int) end as pred,
 conv_id % 6 <> 5 and conv_id % 10 = turn % 10 as correct from gen""")
def f22(t):
    at = lambda c: F.substring(F.lit(text.LETTERS), (F.col(c) % 10 + 1).cast("int"), F.lit(1))
    letter, form = at("conv_id"), F.col("conv_id") % 6
    body = F.concat(F.lit("\nAnswer: Z\n"), "text")
    tail = (
        F.when(form == 0, F.concat(F.lit("\n**Answer:** ("), letter, F.lit(") since")))
        .when(form == 1, F.concat(F.lit("\n$$\\boxed{\\text{("), letter, F.lit(")}}$$ done.")))
        .when(form == 2, F.concat(F.lit("\nthe answer is option "), letter, F.lit(".")))
        .when(form == 3, F.concat(F.lit("\n\n("), letter, F.lit(")")))
        .when(form == 4, F.concat(F.lit("\nanswer \\boxed{"), letter, F.lit("} I got")))
        .otherwise(F.concat(F.lit("\nthe answer "), letter, F.lit(" gave was off")))
    )
    g = t.gen().withColumn("generation", F.concat(body, tail)).withColumn("answer", at("turn"))
    return graders.grade(g, "mmlu_pro").select("sample_id", "pred", "correct")


_BBH = [  # (question tail, answer line, gold, right)
    ("\nOptions:\n(A) red\n(B) blue", "(B) blue", "(B)", True),
    ("\nOptions:\n(A) red\n(B) blue", "(A)", "(B)", False),
    ("\nOptions:\n- Yes\n- No", "(B)", "No", True),
    ("\nOptions:\n- Yes\n- No", "(A)", "No", False),
    ("", "False ()", "False", True),
    (" How many?", "(C) 1,029 items", "1029", True),
    (" How many?", "(2 + 3) = 5", "6", False),
    (" Input: [ (", "[ ( ) ]", ") ]", True),
    (" Input: [ (", "] )", ") ]", False),
    ("", "apple, pear", "apple pear", True),
    ("", "pear apple", "apple pear", False),
    ("", "**valid**\n\nAnswer: <answer>", "valid", True),
]
_BBH_SQL = "case conv_id % 12 " + " ".join(f"when {i} then {str(r).lower()}" for i, (*_, r) in enumerate(_BBH)) + " end"


def _bbh(t):
    n = F.col("conv_id") % len(_BBH)
    cols = {"question": F.lit(""), "line": F.lit(""), "answer": F.lit("")}
    for i, (q, line, gold, _) in enumerate(_BBH):
        cols = {"question": F.when(n == i, F.concat("text", F.lit(q))).otherwise(cols["question"]),
                "line": F.when(n == i, line).otherwise(cols["line"]),
                "answer": F.when(n == i, gold).otherwise(cols["answer"])}
    g = t.gen().withColumns(cols)
    return g.withColumn("generation", F.concat(F.lit("Answer: none\n"), "text", F.lit("\nAnswer: "), "line"))


@query("f23_many_kind_grader", f"with {GEN} select sample_id, {_BBH_SQL} as correct from gen")
def f23(t):
    return graders.grade(_bbh(t), "bbh", question="question").select("sample_id", "correct")


@query("f24_math_grader", f"""with {GEN} select sample_id, case conv_id % 4 when 0 then concat('\\frac{{', turn, '}}{{', conv_id + 3, '}}')
 when 1 then cast(turn + 1000 as varchar) when 2 then concat(turn, ',', conv_id) else cast(conv_id as varchar) end as pred, turn % 3 <> 0 as correct from gen""")
def f24(t):
    """Four notations; every third row's gold is off by one."""
    c, k = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    form = F.col("conv_id") % 4
    said = (
        F.when(form == 0, F.concat(F.lit("\\boxed{\\dfrac{"), k, F.lit("}{"), (F.col("conv_id") + 3).cast("string"), F.lit("}}")))
        .when(form == 1, F.concat(F.lit("\\boxed{\\$1,\\!"), F.lpad(k, 3, "0"), F.lit("\\text{ cm}^2}")))
        .when(form == 2, F.concat(F.lit("\\boxed{x = "), k, F.lit(",\\; "), c, F.lit("}")))
        .otherwise(F.concat(F.lit("The final answer is "), c, F.lit(".")))
    )
    off = F.when(F.col("turn") % 3 == 0, 1).otherwise(0)
    gold = (
        F.when(form == 0, F.concat(F.lit("\\frac{"), (F.col("turn") + off).cast("string"), F.lit("}{"), (F.col("conv_id") + 3).cast("string"), F.lit("}")))
        .when(form == 1, (F.col("turn") + 1000 + off).cast("string"))
        .when(form == 2, F.concat((F.col("conv_id") + 5000 * off).cast("string"), F.lit(", "), k))
        .otherwise(F.concat((F.col("conv_id") + off).cast("string"), F.lit(".0")))
    )
    g = t.gen().withColumn("generation", F.concat("text", F.lit("\n"), said)).withColumn("answer", gold)
    return graders.grade(g, "math500").select("sample_id", "pred", "correct")


@query("f25_f26_math_forms", f"""with {GEN} select sample_id, concat(cast(turn + 3 as varchar), '-2\\sqrt{{', conv_id + 2, '}}') as pred, conv_id % 2 = 0 as correct from gen""")
def f25(t):
    """A gold with a plus-minus stands for two answers, in any order; one alone is wrong."""
    a, r = (F.col("turn") + 3).cast("string"), (F.col("conv_id") + 2).cast("string")
    root = F.concat(F.lit("2\\sqrt{"), r, F.lit("}"))
    one = F.concat(a, F.lit(" - "), root)
    two = F.concat(one, F.lit(",\\ "), a, F.lit("+"), root)
    even = F.col("conv_id") % 2 == 0
    g = t.gen().withColumn("generation", F.concat("text", F.lit(" \\boxed{"), F.when(even, two).otherwise(one), F.lit("}")))
    g = g.withColumn("answer", F.concat(a, F.lit(" \\pm "), root))
    got = graders.grade(g, "math500")
    return got.select("sample_id", F.regexp_extract("pred", "^([^,]*)", 1).alias("pred"), "correct")


@query("f27_grader_registry", f"""with {GEN} select t as task, count(*) as n, case when t in ('gsm8k', 'math500') then count(*) else 0 end as n_correct,
 true as versioned from gen, (values ('gsm8k'), ('lsat'), ('math500'), ('mmlu_pro')) v(t) group by t""")
def f27(t):
    """Every plain grader on the same numeric answer; versions carry the task name."""
    parts = []
    for task in ("gsm8k", "lsat", "math500", "mmlu_pro"):
        g = t.gen().withColumn("generation", F.concat(F.lit("so it is.\nAnswer: "), "answer"))
        v = F.lit(graders.grader_version(task))
        parts.append(graders.grade(g, task).groupBy(F.lit(task).alias("task")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"),
            F.min(v.rlike(f"^{task}:[0-9a-f]{{12}}$")).alias("versioned")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _b(n: str, easy: str, medium: str) -> str:
    return f"case when {n} {easy} then 'easy' when {n} {medium} then 'medium' else 'hard' end"


@query("p12_difficulty", f"""with d as (select doc_id, text, len(list_filter(string_split(text, {NL}), lambda x: {trim('x')} <> '' and not starts_with(x, '####'))) as steps,
 len(list_filter(string_split_regex(regexp_replace(split_part(text, 'Q:', 1), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trim('x')} <> '')) as sents,
 length(text) as n, case when doc_id % 7 < 5 then doc_id % 7 + 1 end as level from documents)
 select doc_id, {_b('steps', '<= 2', '<= 4')} as gsm8k, {_b('sents', '<= 4', '<= 7')} as lsat,
 case when level is null then 'medium' else {_b('level', '<= 2', '= 3')} end as math, {_b('(n + 2)', '< 900', '< 1400')} as mmlu, {_b('n', '< 250', '< 700')} as bbh from d""")
def p12(t):
    level = F.when(F.col("doc_id") % 7 < 5, F.col("doc_id") % 7 + 1)
    return t.documents.select(
        "doc_id", text.difficulty_gsm8k(F.col("text")).alias("gsm8k"), text.difficulty_lsat(F.col("text")).alias("lsat"),
        text.difficulty_math(level).alias("math"), text.difficulty_mmlu(F.col("text"), F.array(F.lit("a"), F.lit("b"))).alias("mmlu"),
        text.difficulty_bbh(F.col("text")).alias("bbh"))


_SPEC_SQL = """case when kind in ('number', 'dyck', 'word_list') or kind is null then concat('free-form answer (', coalesce(kind, 'None'), ')') end"""


@query("p13_answer_specs", f"""with {GEN}, k as (select sample_id, conv_id, {_KIND_SQL} as kind from gen)
 select sample_id, kind, coalesce(kind in ('letter', 'yes_no', 'valid_invalid') and (conv_id % 2 = 0), false) as covered,
 case kind when 'letter' then 'A,B' when 'yes_no' then 'Yes,No' when 'valid_invalid' then 'valid,invalid' end as options,
 case when kind is null or kind in ('number', 'dyck', 'word_list') then concat('free-form answer (', coalesce(kind, 'None'), ')')
 when conv_id % 2 = 1 then concat('gold ''nothing'' not among options [', case kind when 'letter' then '''A'', ''B''' when 'yes_no' then '''Yes'', ''No''' else '''valid'', ''invalid''' end, ']') end as exclude_reason
 from k""")
def p13(t):
    """Every second row has a gold outside its options."""
    kind = F.col("conv_id") % len(_KIND_CASES)
    gold = F.when(F.col("conv_id") % 2 == 1, "nothing").when(kind == 0, "(B)").when(kind == 1, "Valid").otherwise("no")
    q = _cased(t).withColumn("answer", gold).withColumn("sample_id2", F.col("sample_id"))
    got = text.answer_specs(q, "bbh", sample_id="sample_id2")
    return got.select("sample_id", "kind", F.coalesce("covered", F.lit(False)).alias("covered"), F.array_join("options", ",").alias("options"), "exclude_reason")


@query("s11_benchmark_tables", f"""select 'gsm8k' as task, concat('gsm8k-test-', doc_id) as key, md5(text) as question, cast(n_chars as double) as gold, null as answer from documents
 union all select 'lsat', concat('lsat-test-', doc_id), md5(text), null, chr((65 + doc_id % 7)::int) from documents where doc_id % 7 < 5
 union all select 'math500', concat('math500-test-', doc_id), md5(text), null, cast(n_chars as varchar) from documents
 union all select 'mmlu_pro', concat('mmlupro-test-', doc_id), md5(concat({trim('text')}, {NL}, {NL}, '(A) ', lang, {NL}, '(B) ', source)), null, chr((65 + doc_id % 3)::int) from documents where doc_id % 3 < 2
 union all select 'bbh', concat('bbh-', lang, '-', doc_id), md5(text), null, source from documents""", "gold")
def s11(t):
    d = t.documents
    n = F.col("n_chars").cast("string")
    raw = {
        "gsm8k": d.select(F.col("doc_id").alias("idx"), F.col("text").alias("question"), F.concat(F.lit("steps 3\n#### "), n).alias("answer")),
        "lsat": d.select(F.col("doc_id").alias("idx"), F.col("text").alias("query"), F.array("lang").alias("choices"),
                         F.array((F.col("doc_id") % 7).cast("int")).alias("gold")),
        "math500": d.select(F.col("doc_id").alias("idx"), F.col("text").alias("problem"), n.alias("answer"),
                            (F.col("doc_id") % 5 + 1).alias("level"), F.col("source").alias("subject")),
        "mmlu_pro": d.select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("idx"), F.col("text").alias("question"),
                             F.array("lang", "source").alias("options"), (F.col("doc_id") % 3).alias("answer_index"), F.col("source").alias("category")),
        "bbh": d.select(F.col("doc_id").alias("idx"), F.col("text").alias("input"), F.col("source").alias("target"), F.col("lang").alias("subtask")),
    }
    out = None
    for task, df in raw.items():
        got = benchmark(df, task).select(
            F.lit(task).alias("task"), "key", F.md5("question").alias("question"),
            F.when(F.lit(task) == "gsm8k", F.col("extra").try_cast("double")).alias("gold"),
            F.when(F.lit(task) != "gsm8k", F.col("answer")).alias("answer"))
        out = got if out is None else out.unionByName(got)
    return out
