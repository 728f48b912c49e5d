"""Registry of queries and the tables they read.

Each query is an operator applied to a view of the given tables. The same
views exist as Spark DataFrames and as SQL, so a query and its SQL twin start
from identical rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rand import hash01

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
DIGITS = 9


class Tables:
    """Lazy readers of one data folder, plus the derived views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def doc(self) -> DataFrame:
        """Documents as items: quality is the cheap outcome, non-toxic the expensive one."""
        d = self.documents.select("doc_id", "lang", "source", "n_chars")
        return d.join(self.labels, "doc_id").select(
            "doc_id",
            F.concat_ws("-", F.lit("doc"), "lang", F.col("doc_id").cast("string")).alias("sample_id"),
            F.col("source").alias("task"),
            F.col("lang").alias("family"),
            F.when(F.col("n_chars") < 1000, "easy").when(F.col("n_chars") < 4000, "medium")
            .otherwise("hard").alias("difficulty"),
            (F.col("quality") == 1).alias("correct_off"),
            (F.col("toxic") == 0).alias("correct_on"),
            F.col("n_chars").alias("n_tokens_off"),
            F.col("n_chars").cast("double").alias("score"),
        )

    def evt(self) -> DataFrame:
        """Events as items with hashed outcomes, a tied and a continuous score."""
        e = self.events
        ident = F.col("event_id").cast("string")
        conf = F.least(F.col("value") / 250.0, F.lit(1.0))
        return e.select(
            F.concat_ws("-", F.lit("evt"), "event_type", ident).alias("sample_id"),
            F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("task"),
            F.col("event_type").alias("family"),
            (hash01(F.concat(ident, F.lit(":off"))) < 0.45 + 0.4 * conf).alias("correct_off"),
            (hash01(F.concat(ident, F.lit(":on"))) < 0.80).alias("correct_on"),
            conf.alias("conf"),
            F.col("value").alias("score_a"),
            (F.col("user_id") % 7).cast("double").alias("score_b"),
            (F.lit(20) + F.col("event_id") % 180).alias("n_tokens_off"),
            (F.lit(200) + F.col("event_id") % 1800).alias("n_tokens_on"),
            (F.col("event_id") % 37 == 0).alias("truncated_on"),
            (F.col("event_id") % 11 == 0).alias("truncated_off"),
            (F.col("event_id") % 8).alias("shard"),
            "event_id",
        )

    def rdo(self) -> DataFrame:
        """Events as readout rows: a first-tier answer with its confidence, beside both policies."""
        e, i = self.evt(), F.col("event_id")
        key = i.cast("string")
        letter = i % 3 == 0
        return e.select(
            "event_id", "sample_id", "correct_off", "correct_on", "n_tokens_off", "n_tokens_on",
            "truncated_off", "truncated_on", "conf", "family",
            F.when(F.col("task") == "t0", "bbh").when(F.col("task") == "t1", "mmlu_pro")
            .otherwise(F.col("task")).alias("task"),
            F.when(letter, "letter").otherwise("yes_no").alias("kind"),
            F.when(letter, 4).otherwise(2).alias("n_options"),
            (i % 29 != 0).alias("covered"),
            F.when(i % 58 == 0, "free-form answer (number)").when(i % 29 == 0, "prompt_hash_mismatch")
            .alias("exclude_reason"),
            (F.lit(0.25) + F.lit(0.75) * F.col("conf")).alias("p_max"),
            (hash01(F.concat(key, F.lit(":s1"))) < 0.3 + 0.5 * F.col("conf")).alias("s1_correct"),
            (F.lit(0.5) + (i % 50) / 100.0).alias("option_mass"),
            F.array_compact(F.array(
                F.when(i % 5 == 0, "alt_path_unavailable"), F.when(i % 7 == 0, "capture_prompt_truncated")
            )).alias("flags"),
            F.concat(F.lit("g"), (i % 2).cast("string")).alias("grader_version"),
            (i % 41 == 0).alias("unclosed_think_on"),
        )

    def lin(self) -> DataFrame:
        """Order lines as items: heavy ties and no row id, aggregates only."""
        line = self.lineitem.select(
            "l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount"
        )
        order = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
        return line.join(order, "l_orderkey").select(
            F.col("o_orderpriority").alias("family"),
            (F.col("l_returnflag") != "R").alias("correct_off"),
            (F.col("l_linestatus") == "F").alias("correct_on"),
            F.col("l_extendedprice").alias("score_a"),
            F.col("l_discount").alias("score_b"),
        )

    def gen(self) -> DataFrame:
        """Assistant turns as generations with a known answer line and known grades."""
        turn = F.col("turn").cast("string")
        answer = F.concat(F.lit("Answer: "), (F.col("turn") + F.col("conv_id") % 3).cast("string"))
        on = F.when(
            F.col("conv_id") % 7 == 0,
            F.concat(F.lit("<think>"), "text", F.lit(" Answer: "), turn),
        ).otherwise(
            F.concat(
                F.lit("<think>"), "text", F.lit("</think>\nAnswer: "),
                (F.col("turn") + F.col("conv_id") % 2).cast("string"),
            )
        )
        return self.conversations.where("role = 'assistant'").select(
            F.concat_ws("-", F.lit("conv"), F.col("conv_id").cast("string"), turn).alias("sample_id"),
            turn.alias("answer"),
            "conv_id",
            "turn",
            "text",
            answer.alias("response_off"),
            on.alias("response_on"),
            (F.col("conv_id") % 3 == 0).alias("exp_correct_off"),
            ((F.col("conv_id") % 7 != 0) & (F.col("conv_id") % 2 == 0)).alias("exp_correct_on"),
            (F.col("conv_id") % 7 == 0).alias("exp_unclosed_on"),
        )

    def act(self) -> DataFrame:
        """Embeddings cut into four layers of 16: (vec_id, y, layer, vec)."""
        parts = F.array(*[
            F.struct(F.lit(k).alias("layer"), F.slice("embedding", 1 + 16 * k, 16).alias("vec"))
            for k in range(4)
        ])
        return self.embeddings.select(
            "vec_id", "label", (F.col("label") >= 5).alias("y"), F.inline(parts)
        )


def h32(key: str) -> str:
    return f"('0x'||substr(md5({key}),1,8))::bigint"


def h01(key: str) -> str:
    return f"({h32(key)}/4294967296.0::double)"


DOC = """doc as (select d.doc_id, concat('doc-', d.lang, '-', cast(d.doc_id as varchar)) as sample_id,
 d.source as task, d.lang as family,
 case when d.n_chars < 1000 then 'easy' when d.n_chars < 4000 then 'medium' else 'hard' end as difficulty,
 l.quality = 1 as correct_off, l.toxic = 0 as correct_on, d.n_chars as n_tokens_off,
 cast(d.n_chars as double) as score from documents d join labels l on d.doc_id = l.doc_id)"""
EVT = f"""evt as (select concat('evt-', event_type, '-', cast(event_id as varchar)) as sample_id,
 concat('t', cast(user_id % 4 as varchar)) as task, event_type as family,
 {h01("concat(cast(event_id as varchar), ':off')")} < 0.45::double + 0.4::double * least(value / 250.0::double, 1.0::double) as correct_off,
 {h01("concat(cast(event_id as varchar), ':on')")} < 0.80::double as correct_on,
 least(value / 250.0::double, 1.0::double) as conf, value as score_a, cast(user_id % 7 as double) as score_b,
 20 + event_id % 180 as n_tokens_off, 200 + event_id % 1800 as n_tokens_on,
 event_id % 37 = 0 as truncated_on, event_id % 11 = 0 as truncated_off, event_id % 8 as shard, event_id
 from events)"""
RDO = f"""{EVT}, rdo as (select event_id, sample_id, correct_off, correct_on, n_tokens_off, n_tokens_on, truncated_off, truncated_on,
 conf, family, case task when 't0' then 'bbh' when 't1' then 'mmlu_pro' else task end as task,
 case when event_id % 3 = 0 then 'letter' else 'yes_no' end as kind, case when event_id % 3 = 0 then 4 else 2 end as n_options,
 event_id % 29 <> 0 as covered, case when event_id % 58 = 0 then 'free-form answer (number)'
 when event_id % 29 = 0 then 'prompt_hash_mismatch' end as exclude_reason, 0.25::double + 0.75::double * conf as p_max,
 {h01("concat(cast(event_id as varchar), ':s1')")} < 0.3::double + 0.5::double * conf as s1_correct,
 0.5::double + (event_id % 50)/100.0::double as option_mass,
 list_filter([case when event_id % 5 = 0 then 'alt_path_unavailable' end, case when event_id % 7 = 0 then 'capture_prompt_truncated' end], lambda x: x is not null) as flags,
 concat('g', cast(event_id % 2 as varchar)) as grader_version, event_id % 41 = 0 as unclosed_think_on from evt)"""
LIN = """lin as (select o.o_orderpriority as family, l.l_returnflag <> 'R' as correct_off,
 l.l_linestatus = 'F' as correct_on, l.l_extendedprice as score_a, l.l_discount as score_b
 from lineitem l join orders o on l.l_orderkey = o.o_orderkey)"""
GEN = """gen as (select concat('conv-', cast(conv_id as varchar), '-', cast(turn as varchar)) as sample_id,
 cast(turn as varchar) as answer, conv_id, turn, text,
 concat('Answer: ', cast(turn + (conv_id % 3) as varchar)) as response_off,
 case when conv_id % 7 = 0 then concat('<think>', text, ' Answer: ', cast(turn as varchar))
 else concat('<think>', text, '</think>', chr(10), 'Answer: ', cast(turn + (conv_id % 2) as varchar)) end as response_on,
 conv_id % 3 = 0 as exp_correct_off, (conv_id % 7 <> 0 and conv_id % 2 = 0) as exp_correct_on,
 conv_id % 7 = 0 as exp_unclosed_on from conversations where role = 'assistant')"""
ACT = """act as (select vec_id, label, label >= 5 as y, k as layer, embedding[1 + 16*k : 16 + 16*k] as vec
 from embeddings, range(4) t(k))"""


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded and whole numbers widened, so engines compare equal."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # + 0.0 turns a negative zero into zero
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, dbl: str = "", big: str = ""):
    """Register a query; ``dbl`` and ``big`` name DOUBLE columns and whole numbers to widen in the SQL result."""
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: tidy(fn(Tables(spark, folder)))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            fixes = [f"round(cast({c} as double), {DIGITS}) + 0.0 as {c}" for c in dbl.split()]
            fix = ", ".join(fixes + [f"cast({c} as bigint) as {c}" for c in big.split()])
            # CTEs stay outermost so one wrapper fits every query
            SQL[name] = f"select * {'replace (' + fix + ')' if fix else ''} from ({sql}) as q"
        return fn

    return wrap


#: The scramble in steps: DuckDB keeps every product below 2^64.
SCRAMBLE = """select *, xor(z3, z3 >> 16) as {out} from (select *, (xor(z2, z2 >> 15) * 2221713035::ubigint) & 4294967295::ubigint as z3 from (
  select *, (xor(z1, z1 >> 16) * 2146121005::ubigint) & 4294967295::ubigint as z2 from (select *, {x} as z1 from {src})))"""


def _scrambled(src: str, x: str, out: str) -> str:
    return f"(select * exclude (z1, z2, z3) from ({SCRAMBLE.format(src=src, x=x, out=out)}))"


def draws(cells: str, cols: str, n_boot: int, seed: int = 0) -> str:
    """CTEs for ``drawn(cols, key, b, w)``: Poisson weights of the cells, as in functions.rand.

    Each binary digit of a count is one draw from its Poisson table.
    """
    counter = _scrambled(
        f"(select b, p from range({n_boot}) r(b), range(40) d(p) where p <= (select floor(log2(max(c))) from {cells}))",
        "((b * 64 + p + 1) & 4294967295)::ubigint", "k")
    high = _scrambled("pieces", "xor(w1, k)", "hi")
    low = _scrambled(high, "xor(hi, w2)", "lo")
    return f"""counters as materialized (select b, p, k from {counter}),
 worded as (select *, ('0x'||substr(h, 1, 8))::ubigint as w1, ('0x'||substr(h, 9, 8))::ubigint as w2
  from (select *, md5(concat('{seed}:', cast(key as varchar))) as h from {cells})),
 pieces as (select x.* exclude (h), b, p, k from worded x join counters on (c >> p) & 1 = 1),
 uni as (select {cols}, key, b, p, (hi::double * 2097152 + (lo >> 11)::double) / 9007199254740992.0::double as u from {low}),
 pois as (select p, n, sum(exp(n * ln(lam) - lam - lgamma(n + 1))) over (partition by p order by n) as cdf from (
  select p, lam, unnest(range(greatest(0, floor(lam - 12 * sqrt(lam) - 40))::bigint, floor(lam + 12 * sqrt(lam) + 40)::bigint + 1)) as n
  from (select distinct p, pow(2, p) as lam from counters))),
 firsts as (select p, min(n) as n0 from pois group by p),
 drawn as (select {cols}, key, b, sum(coalesce(n + 1, n0))::double as w from (select u.*, t.n from uni u asof left join pois t on u.p = t.p and u.u >= t.cdf)
  join firsts using (p) group by all)"""


def tree_draws(cells: str, cols: str, strata: str, n_boot: int, seed: int = 0, top: int = 17) -> str:
    """CTEs for ``drawn(cols, b, w)``: exact resamples of the rows in ``cells`` (key, c), as functions.rand.multinomial_weights draws them.

    Rows of a stratum (2^top at most) are leaves of a binary tree; each CTE splits the draws of one level's nodes.
    """
    part = f"partition by {strata} " if strata else ""
    name = "concat_ws(':', " + ", ".join(f"coalesce({c.strip()}::varchar, '')" for c in strata.split(",")) + ")" if strata else "''"
    order = f"{part}order by {h32(f"concat('{seed}:pos:', cast(key as varchar))")}, key rows unbounded preceding"
    out = [f"""placed as materialized (select *, z - c as a, sum(c) over ({part})::bigint as size from (
  select *, {name} as stratum, sum(c) over ({order})::bigint as z from {cells})),
 bounds as materialized (select distinct stratum, size, x from (select stratum, size, a as x from placed union all select stratum, size, z from placed) where x > 0 and x < size),
 nodes as materialized (select *, ('0x'||substr(h, 1, 8))::ubigint as w1, ('0x'||substr(h, 9, 8))::ubigint as w2, least(m, 1 << (e - 1)) as lf from (
  select *, md5(concat('{seed}:', stratum, ':', e, ':', idx)) as h, least(size - (idx << e), 1 << e) as m from (
   select distinct stratum, size, e, x >> e as idx from bounds, range(1, {top + 1}) r(e) where x & ((1 << e) - 1) <> 0))),
 shares as (select distinct lf // gcd(lf, m) as lf, m // gcd(lf, m) as m from nodes where lf < m),
 pmf as (select lf, m, p, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(q) + (n - k) * ln(1 - q))) over (partition by lf, m, p order by k) as cdf from (
  select lf, m, p, n, q, unnest(range(greatest(0, floor(n * q - reach))::bigint, least(n, floor(n * q + reach))::bigint + 1)) as k from (
   select *, 12 * sqrt(n * q * (1 - q)) + 40 as reach from (select lf, m, p, (1 << p) as n, lf::double / m as q from shares, range({top + 1}) d(p)
    where p <= (select floor(log2(greatest(max(size), 1))) from nodes))))),
 firsts as (select lf, m, p, min(k) as k0 from pmf group by lf, m, p),
 counters as materialized (select b, p, k from {_scrambled(f"(select b, p from range({n_boot}) r(b), range({top + 1}) d(p))", "((b * 64 + p + 1) & 4294967295)::ubigint", "k")})"""]
    for e in range(top, 0, -1):
        source = f"nodes n, range({n_boot}) r(b)" if e == top else f"nodes n join split{e + 1} u on u.stratum = n.stratum and u.idx = n.idx >> 1"
        drawn = "size" if e == top else "case when n.idx & 1 = 0 then l else c - l end"
        high = _scrambled(f"(select h.stratum, h.idx, h.b, h.p, h.lf, h.m, w1, w2, t.k from halves{e} h join counters t on t.b = h.b and t.p = h.p)", "xor(w1, k)", "hi")
        low = _scrambled(high, "xor(hi, w2)", "lo")
        out.append(f"""drawn{e} as materialized (select n.stratum, n.idx, b, {drawn} as c, lf, m, w1, w2 from {source} where n.e = {e}),
 halves{e} as (select stratum, idx, b, p, lf // gcd(lf, m) as lf, m // gcd(lf, m) as m, w1, w2 from drawn{e}, range({top + 1}) d(p) where lf < m and (c >> p) & 1 = 1),
 went{e} as (select stratum, idx, b, sum(coalesce(t.k + 1, f.k0))::bigint as l from (select *, (hi::double * 2097152 + (lo >> 11)::double) / 9007199254740992.0::double as u from {low}) y
  asof left join pmf t on y.lf = t.lf and y.m = t.m and y.p = t.p and y.u >= t.cdf join firsts f on f.lf = y.lf and f.m = y.m and f.p = y.p group by stratum, idx, b),
 split{e} as materialized (select d.stratum, d.idx, d.b, c, case when lf = m then c else coalesce(l, 0) end as l from drawn{e} d left join went{e} w on w.stratum = d.stratum and w.idx = d.idx and w.b = d.b)""")
    every = " union all ".join(f"select {e} as e, stratum, idx, b, l from split{e}" for e in range(1, top + 1))
    out.append(f"""before as materialized (select x.stratum, x.x, s.b, sum(l)::bigint as f from (select stratum, x, e from bounds, range(1, {top + 1}) r(e) where (x >> (e - 1)) & 1 = 1 and x & ((1 << e) - 1) <> 0) x
  join ({every}) s on s.stratum = x.stratum and s.e = x.e and s.idx = x.x >> x.e group by x.stratum, x.x, s.b),
 drawn as (select {cols}, b, (case when z = size then size else fz end - case when a = 0 then 0 else fa end)::double as w from (
  select p.*, r.b, o.f as fz, i.f as fa from (placed p cross join range({n_boot}) r(b)) left join before o on o.stratum = p.stratum and o.x = p.z and o.b = r.b
   left join before i on i.stratum = p.stratum and i.x = p.a and i.b = r.b))""")
    return ",\n ".join(out)


def auroc_sql(src: str, by: str, y: str = "y", score: str = "s", weight: str = "1.0::double") -> str:
    """Subquery: by, p, n, u from rows (y boolean)."""
    keys = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""(select {keys}sum(p) as p, sum(n) as n, sum(p * (coalesce(nb, 0) + n / 2)) as u from (
  select *, sum(n) over ({part} order by s rows between unbounded preceding and 1 preceding) as nb from (
   select {keys}{score} as s, sum(case when {y} then {weight} else 0.0 end) as p,
    sum(case when {y} then 0.0 else {weight} end) as n from {src} group by {keys}{score})) {'group by ' + by if by else ''})"""


def logistic_sql(src: str, key: str, steps: int = 25) -> str:
    """CTEs st (scaler), fits (coefficients) and scored (src with ``s``) of a balanced two-column logistic fit per key, C = 1.

    src has key, split, y, x1, x2. Newton's method as a recursion over the steps, its 3 x 3 system by cofactors.
    """
    return f"""st as materialized (select {key}, avg(x1) as m1, case when stddev_pop(x1) < 1e-6 then 1.0 else stddev_pop(x1) end as d1, avg(x2) as m2,
  case when stddev_pop(x2) < 1e-6 then 1.0 else stddev_pop(x2) end as d2, count(*)::double as rows, count(*) filter (where y)::double as ones from {src} where split = 'train' group by {key}),
 z as materialized (select r.{key}, (x1 - m1)/d1 as a, (x2 - m2)/d2 as c, y::int as hit, case when y then rows/(2*greatest(ones, 1)) else rows/(2*greatest(rows - ones, 1)) end as w
  from {src} r join st on r.{key} = st.{key} where split = 'train'),
 newton as (select {key}, 0 as step, 0.0::double as w1, 0.0::double as w2, 0.0::double as b from st union all
  select {key}, step + 1, w1 - (g1*(h22*h00 - h20*h20) - h12*(g2*h00 - h20*g0) + h10*(g2*h20 - h22*g0))/det,
   w2 - (h11*(g2*h00 - h20*g0) - g1*(h12*h00 - h20*h10) + h10*(h12*g0 - g2*h10))/det,
   b - (h11*(h22*g0 - g2*h20) - h12*(h12*g0 - g2*h10) + g1*(h12*h20 - h22*h10))/det from (
   select *, h11*(h22*h00 - h20*h20) - h12*(h12*h00 - h20*h10) + h10*(h12*h20 - h22*h10) as det from (
    select {key}, step, w1, w2, b, sum(w*(q - hit)*a) + w1 as g1, sum(w*(q - hit)*c) + w2 as g2, sum(w*(q - hit)) as g0, sum(w*q*(1 - q)*a*a) + 1 as h11,
     sum(w*q*(1 - q)*a*c) as h12, sum(w*q*(1 - q)*c*c) + 1 as h22, sum(w*q*(1 - q)*a) as h10, sum(w*q*(1 - q)*c) as h20, sum(w*q*(1 - q)) as h00 from (
     select z.*, step, w1, w2, b, 1/(1 + exp(-(w1*a + w2*c + b))) as q from newton n join z on n.{key} = z.{key} where step < {steps}) group by {key}, step, w1, w2, b))),
 fits as materialized (select * from newton where step = {steps}),
 scored as (select r.*, 1/(1 + exp(-(w1*(x1 - m1)/d1 + w2*(x2 - m2)/d2 + b))) as s from {src} r join st on r.{key} = st.{key} join fits on r.{key} = fits.{key})"""


def segments_sql(src: str, by: str, score: str, weight: str = "1.0::double",
                 off: str = "correct_off", on: str = "correct_on") -> str:
    """Subquery of curve segments: by, s, n, gain, k0, k1, g0, g1, cnt, base, gall, helped, hurt."""
    keys = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    run = f"over ({part} order by s desc rows unbounded preceding)"
    tot = f"over ({part})"
    return f"""(select {keys}s, n, gain, sum(n) {run} - n as k0, sum(n) {run} as k1,
  sum(gain) {run} - gain as g0, sum(gain) {run} as g1, sum(n) {tot} as cnt, sum(base) {tot} as base,
  sum(gain) {tot} as gall, sum(helped) {tot} as helped, sum(hurt) {tot} as hurt from (
  select {keys}{score} as s, sum({weight}) as n, sum({weight} * ({on}::int - {off}::int)) as gain,
   sum({weight} * {off}::int) as base, sum({weight} * ({on} and not {off})::int) as helped,
   sum({weight} * ({off} and not {on})::int) as hurt
  from {src} group by {keys}{score}) where n > 0)"""


def _area_sql(lo: float, hi: float) -> str:
    a, b = f"greatest(k0/cnt, {lo}::double)", f"least(k1/cnt, {hi}::double)"
    acc = lambda x: f"(base + g0 + gain/n * ({x}*cnt - k0))/cnt"
    return f"sum(case when {b} > {a} then ({b} - {a}) * ({acc(a)} + {acc(b)})/2 else 0.0 end)"


def nauc_sql(seg: str, by: str, lo: float = 0.0, hi: float = 0.5) -> str:
    """Subquery: by, nauc, mean_accuracy, random_mean_accuracy, oracle_mean_accuracy.

    The oracle area is taken from its own three-piece curve by trapezoids on its breakpoints.
    """
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    w = hi - lo
    orc = lambda x: f"(b0 + least({x}, h) - greatest(0.0::double, {x} - (1.0::double - u)))"
    c1, c2 = f"least(greatest(h, {lo}), {hi})", f"least(greatest(1.0::double - u, {lo}), {hi})"
    pts = [f"{lo}::double", c1, c2, f"{hi}::double"]
    o = " + ".join(f"(({q}) - ({p})) * ({orc(p)} + {orc(q)})/2" for p, q in zip(pts, pts[1:]))
    return f"""(select {keys}case when o - r > 1e-12 then (a - r)/(o - r) end as nauc, a/{w}::double as mean_accuracy,
  r/{w}::double as random_mean_accuracy, o/{w}::double as oracle_mean_accuracy from (
  select *, {o} as o, (b0 + ga * ({lo}+{hi})/2.0::double) * {w}::double as r from (
  select {keys}{_area_sql(lo, hi)} as a, max(base/cnt) as b0, max(gall/cnt) as ga, max(helped/cnt) as h,
   max(hurt/cnt) as u from {seg} {group})))"""
