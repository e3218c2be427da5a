"""Quality rules: robust multivariate outliers by minimum covariance determinant (operator 10).

Every document gets counts of its words, symbols, repeated lines and repeated 8-word windows. Two
plain rules reject the worst. The others give a vector of transformed statistics, and for each
language and source the minimum-covariance-determinant estimate (mean and scatter of the half of
the documents that lie closest together, found by concentration steps from a median start) tells
how far each document lies from the bulk. Documents beyond a chi-square cutoff are rejected.

Everything is DataFrame and SQL expressions. Statistics are whole numbers (thousandths), so sums
are exact and don't depend on the order of rows. Quantiles come from counts per (group, value),
so no group is ever gathered in one task; a group that holds a third of all rows is summed map-side.

Defined results: a null text has no words and fails the base rules; null language or source is a
group of its own; repeated rows count once each; groups under ``min_rows`` documents are pooled by
language, then over all, and a pool that is still smaller rejects nothing; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK, materialise, null_safe_text

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30  # percent of the words
MIN_ROWS = 100
STEPS = 3
#: Squared robust distance beyond which a document is rejected: far outside the chi-square law of
#: five dimensions (its 1 - 1e-9 quantile is 52), as transformed statistics are not exactly normal.
CUTOFF = 60.0
#: Median of the chi-square law with five degrees of freedom.
CHI2_MEDIAN = 4.35146
#: Groups up to which their parameters (some 30 numbers each) are broadcast, and the tasks over which a group is dealt beyond.
FEW_GROUPS, SALTS = 20_000, 32
#: Distances are compared in bins of 1/BINS of ln(1 + d2).
BINS = 200

#: name: (expression in thousandths over the base counts, least standard deviation in thousandths)
STATISTICS = {
    "x1": ("cast(round(1000 * ln((word_chars + 50.0) / (n_words + 10.0))) as bigint)", 60.0),
    "x2": ("cast(round(1000 * ln(1.0 + 50.0 * n_symbols / (word_chars + 50.0))) as bigint)", 80.0),
    "x3": ("cast(round(1000 * ln(1.0 + 20.0 * n_upper / (word_chars + 50.0))) as bigint)", 120.0),
    "x4": ("cast(round(1000.0 * n_dup_lines / (n_lines + 5.0)) as bigint)", 90.0),
    "x5": ("cast(round(1000.0 * n_repeat_words / (n_words + 20.0)) as bigint)", 60.0),
}
X = list(STATISTICS)
D = len(X)


def statistics(docs: DataFrame) -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in {*counts, "base_failed", "text"}]
    text = F.col("_text")
    df = docs.select(*kept, null_safe_text().alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split(text, BLANK), "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size("_words")
    # 8-word windows: different hashes prove different windows, so only texts with an equal pair go on to compare words
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1)))
    df = df.withColumn("_hashes", F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    df = df.withColumn("_twice", F.size("_hashes") > F.size(F.array_distinct("_hashes")))
    df = df.withColumn(
        "_sorted",
        F.when(F.col("_twice"), F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice("_words", i, WINDOW)).alias("w"), i.alias("i"))))),
    )
    s = F.col("_sorted")
    same = lambda x, k: (F.get(s, k - 1)["w"].eqNullSafe(x["w"])) | (F.get(s, k + 1)["w"].eqNullSafe(x["w"]))
    df = df.withColumn("_at", F.when(F.col("_twice"), F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def moments_sql() -> list[str]:
    """Exact sums over the rows of a group."""
    return ["count(1) as n", *(f"sum({a}) as s_{a}" for a in X), *(f"sum({a} * {b}) as s_{a}_{b}" for i, a in enumerate(X) for b in X[: i + 1])]


def scatter_sql() -> list[tuple[str, str]]:
    """(name, expression) one after another: m_* the mean and p_*_* the inverse of the covariance with least variances added, by Cholesky."""
    out = [(f"m_{a}", f"cast(s_{a} as double) / n") for a in X]
    for i, a in enumerate(X):
        for b in X[: i + 1]:
            least = f" + {STATISTICS[a][1] ** 2}" if a == b else ""
            out.append((f"c_{a}_{b}", f"cast(s_{a}_{b} as double) / n - m_{a} * m_{b}{least}"))
    for i, a in enumerate(X):
        for j, b in enumerate(X[: i + 1]):
            inner = "".join(f" - l_{a}_{X[k]} * l_{b}_{X[k]}" for k in range(j))
            out.append((f"l_{a}_{b}", f"sqrt(c_{a}_{a}{inner})" if a == b else f"(c_{a}_{b}{inner}) / l_{b}_{b}"))
    return out


def distance_sql() -> str:
    """Squared Mahalanobis distance of a row by forward substitution in l_*_*, nested."""
    z: list[str] = []
    for i, a in enumerate(X):
        inner = "".join(f" - l_{a}_{X[k]} * z{k}" for k in range(i))
        z.append(f"(({a} - m_{a}){inner}) / l_{a}_{a}")
    return z


def _bin(d2: str) -> str:
    return f"cast(floor({BINS} * ln(1.0 + {d2})) as bigint)"


def _lowest_half(df: DataFrame, keys: list[str], value: str, count: str, at) -> DataFrame:
    """For each key the least value up to which there are `at` of the total count; df has a row for each key and value."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_upto", F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum(count).over(w))
    return df.where(F.col("_upto") >= at(F.col("_total"))).groupBy(*keys).agg(F.min(value).alias("_value"))


def met(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table of groups (checkpointed, unique by keys): broadcast if it has few rows, else with the rows of a group dealt over SALTS tasks."""
    if groups.count() <= FEW_GROUPS:
        return rows.join(F.broadcast(groups), keys, how)
    salt = F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(dealt, [*keys, "_salt"], how).drop("_salt")


def grouped(stats: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) keys of rows that pass the base rules -> group id and its number of rows."""
    n = stats.where("not base_failed").groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("_g", F.when(F.col("n") >= min_rows, F.concat_ws("\x01", F.lit("s"), "_lang", "_source")))
    pool = n.where("_g is null").groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    n = n.join(pool, "_lang", "left")
    return n.select("_lang", "_source", F.coalesce("_g", F.when(F.col("n_lang") >= min_rows, F.concat_ws("\x01", F.lit("l"), "_lang")), F.lit("a")).alias("_g"))


def judge(docs: DataFrame, min_rows: int = MIN_ROWS, steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """docs with the counts of statistics(), base_failed, distance (null: not estimated) and kept.

    The text itself isn't returned. Columns of docs with the names of results are replaced.
    """
    own = [c for c in docs.columns if c not in {"text", "distance", "kept"}]
    lang, source = ((F.coalesce(F.col(c), F.lit("\x02")) if c in docs.columns else F.lit("\x02")).alias(f"_{c}") for c in ("lang", "source"))
    s = statistics(docs.select(*own, *(["text"] if "text" in docs.columns else []), lang, source))
    s = s.select("*", *(F.expr(e).alias(x) for x, (e, _) in STATISTICS.items()))
    s = materialise(s)
    rows = met(s, materialise(grouped(s, min_rows)), ["_lang", "_source"], "left")
    rows = materialise(rows.withColumn("_g", F.when(~F.col("base_failed"), F.col("_g"))))
    fit = rows.where("_g is not null").select("_g", *X)

    # start: distance from the medians in units of the median absolute deviation
    values = fit.select("_g", F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.col(x).alias("v")) for x in X))).alias("s")).groupBy("_g", "s.x", "s.v").agg(F.count(F.lit(1)).alias("n"))
    values = materialise(values)
    half = lambda t: F.floor((t + 1) / 2)
    med = _lowest_half(values, ["_g", "x"], "v", "n", half).withColumnRenamed("_value", "med")
    away = values.join(med, ["_g", "x"]).withColumn("v", F.abs(F.col("v") - F.col("med"))).groupBy("_g", "x", "med", "v").agg(F.sum("n").alias("n"))
    mad = _lowest_half(away, ["_g", "x", "med"], "v", "n", half)
    start = mad.groupBy("_g").agg(*(F.max(F.when(F.col("x") == x, F.col("med"))).alias(f"m_{x}") for x in X), *(F.max(F.when(F.col("x") == x, F.greatest(1.4826 * F.col("_value"), F.lit(STATISTICS[x][1])))).alias(f"d_{x}") for x in X))
    now, distance = materialise(start), [f"({x} - m_{x}) / d_{x}" for x in X]

    for step in range(steps + 1):
        scored = met(rows, now, ["_g"])
        for k, z in enumerate(distance):
            scored = scored.withColumn(f"z{k}", F.expr(z))
        scored = scored.withColumn("_b", F.expr(_bin(" + ".join(f"z{k} * z{k}" for k in range(D)))))
        bins = scored.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("n"))
        most = materialise(_lowest_half(bins, ["_g"], "_b", "n", lambda t: F.floor((t + D + 1) / 2)).withColumnRenamed("_value", "_most"))
        if step == steps:
            break
        now = met(scored, most, ["_g"]).where("_b <= _most").groupBy("_g").agg(*(F.expr(e) for e in moments_sql()))
        for name, e in scatter_sql():
            now = now.withColumn(name, F.expr(e))
        now = materialise(now.select("_g", *(f"m_{a}" for a in X), *(f"l_{a}_{b}" for i, a in enumerate(X) for b in X[: i + 1])))
        distance = distance_sql()

    enough = materialise(rows.where("_g is not null").groupBy("_g").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows))
    last = materialise(now.join(most, "_g").join(enough, "_g"))  # small tables, a row a group
    out = met(rows, last, ["_g"], "left")
    for k, z in enumerate(distance):
        out = out.withColumn(f"z{k}", F.expr(z))
    # consistency: the bulk's median distance is that of the chi-square law, never less than the plain estimate
    d2, bulk = " + ".join(f"z{k} * z{k}" for k in range(D)), f"greatest((exp((_most + 1.0) / {BINS}) - 1.0) / {CHI2_MEDIAN}, 1.0)"
    out = out.withColumn("distance", F.expr(f"({d2}) / {bulk}"))
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*(c for c in own if c not in counts), *counts, "distance", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The digest columns of judge() for all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")).select(*COLUMNS)


def oracle_sql() -> str:
    """The same verdicts in DuckDB SQL, step by step."""
    cte = [
        r"""docs as (select doc_id, coalesce(text, '') as t, coalesce(lang, chr(2)) as lang, coalesce(source, chr(2)) as source from documents)""",
        r"""cut as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
 list_filter(string_split(t, chr(10)), lambda w: regexp_matches(w, '[^\x20\x09-\x0D]')) as lines from docs)""",
        f"""win as (select doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as w from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from cut))""",
        f"""rep as (select doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt
 from (select doc_id, i, count(*) over (partition by doc_id, w) as c from win) where c > 1) group by doc_id)""",
        r"""base as (select c.doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
 cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) as bigint) as n_upper,
 cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
 from cut c left join rep using (doc_id))""",
        f"""judged as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed, {", ".join(f"{e} as {x}" for x, (e, _) in STATISTICS.items())} from base)""",
        "sizes as (select lang, source, count(*) as n from judged where not base_failed group by all)",
        f"pools as (select lang, sum(n) as n from sizes where n < {MIN_ROWS} group by all)",
        f"""groups as (select s.lang, s.source, case when s.n >= {MIN_ROWS} then 's' || chr(1) || s.lang || chr(1) || s.source when p.n >= {MIN_ROWS} then 'l' || chr(1) || s.lang else 'a' end as g from sizes s left join pools p using (lang))""",
        "rows as (select j.*, case when not base_failed then g end as g from judged j left join groups using (lang, source))",
        "vals as (select g, x, v, count(*) as n from (" + " union all ".join(f"select g, '{x}' as x, {x} as v from rows where g is not null" for x in X) + ") group by all)",
        "med as (select g, x, min(v) as med from (select *, sum(n) over (partition by g, x order by v) as upto, sum(n) over (partition by g, x) as total from vals) where upto >= floor((total + 1) / 2) group by all)",
        "away as (select g, x, med, abs(v - med) as v, sum(n) as n from vals join med using (g, x) group by all)",
        "mad as (select g, x, med, min(v) as mad from (select *, sum(n) over (partition by g, x order by v) as upto, sum(n) over (partition by g, x) as total from away) where upto >= floor((total + 1) / 2) group by all)",
        "p0 as (select g, " + ", ".join(f"max(med) filter (where x = '{x}') as m_{x}, greatest(1.4826 * max(mad) filter (where x = '{x}'), {STATISTICS[x][1]}) as d_{x}" for x in X) + " from mad group by g)",
    ]
    distance = [f"({x} - m_{x}) / d_{x}" for x in X]
    d2 = " + ".join(f"z{k} * z{k}" for k in range(D))
    for step in range(STEPS + 1):
        source = f"rows join p{step} using (g)"
        for k, z in enumerate(distance):
            source = f"(select *, {z} as z{k} from {source})"
        cte.append(f"q{step} as materialized (select *, {_bin(d2)} as b from {source})")
        cte.append(f"h{step} as materialized (select g, min(b) as most from (select *, sum(n) over (partition by g order by b) as upto, sum(n) over (partition by g) as total from (select g, b, count(*) as n from q{step} group by all)) where upto >= floor((total + {D + 1}) / 2) group by g)")
        if step == STEPS:
            break
        source = f"(select g, {', '.join(moments_sql())} from q{step} join h{step} using (g) where b <= most group by g)"
        for name, e in scatter_sql():
            source = f"(select *, {e} as {name} from {source})"
        cte.append(f"p{step + 1} as materialized (select g, {', '.join(f'm_{a}' for a in X)}, {', '.join(f'l_{a}_{b}' for i, a in enumerate(X) for b in X[: i + 1])} from {source})")
        distance = distance_sql()
    bulk = f"greatest((exp((most + 1.0) / {BINS}) - 1.0) / {CHI2_MEDIAN}, 1.0)"
    return (
        "with " + ",\n".join(cte) + f"""
select r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
 not r.base_failed and coalesce(d.distance, 0.0) <= {CUTOFF} as kept from judged r
left join (select doc_id, ({d2}) / {bulk} as distance from q{STEPS} join h{STEPS} using (g) where g in (select g from rows where g is not null group by g having count(*) >= {MIN_ROWS})) d using (doc_id)"""
    )
