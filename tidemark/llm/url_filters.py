"""URL filters: empirical-Bayes host reputation (operator 3).

Listed rules decide first: a rule fits its host and all subdomains where the path starts with the
rule's, and the longest (host, then path) wins; of equal rules the first listed. All other urls are judged
by their host's reputation. Labelled page outcomes are counted by host, host counts are summed by
registered domain and suffix, and at each level the spread of the children around their parents gives
the strength of a beta prior by the method of moments. From the whole to the suffix, to the registered
domain, to the host, each child's prior is what its siblings and its parent's own prior say of the
parent's rate, with that rate's uncertainty: its own pages are left out, siblings count by their
effective number of pages, and an only child has its parent's prior. A host is blocked if the lower
posterior bound of its rate of bad pages is over a threshold.

DataFrame expressions only. Outcomes are summed map-side, so a host with a third of all pages is a
few partial sums, and host rates are joined back where Spark splits skewed partitions.

Defined results: a url that is null or has no ``://`` has an empty host and path, like any other host
its pages are counted under; a page without an outcome (null) is judged but not counted; repeated
rows count once each; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule); the host ends at the first slash, the path starts there.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Rule lists up to this length become one expression; longer ones are joined by host suffix.
INLINE_RULES = 200
#: Second-level labels under which names are registered in two-letter suffixes (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Posterior standard deviations of the lower bound, and the rate over which it blocks.
Z, MOST_BAD = 1.645, 0.25
#: Least and most prior strength, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path (both empty without ://)."""
    pages = pages.drop("host", "path")
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    pages = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    pages = pages.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0)
    return pages.withColumn("host", F.translate("_host", UPPER, LOWER)).withColumn("path", path).drop("_rest", "_host")


def _cut(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, f"/{path}"


def _ordered(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), the longest first, without those that say where an earlier one has spoken."""
    first: dict[tuple[str, str], tuple[str, str]] = {}
    for verdict, rule in rules:
        first.setdefault(_cut(rule), (verdict, rule))
    return sorted(((*said, *cut) for cut, said in first.items()), key=lambda x: (-len(x[2]), -len(x[3]), x[1]))


def apply_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages (host, path) with rule and rule_verdict of the longest fitting rule, else null."""
    pages = pages.drop("rule", "rule_verdict")
    ordered = _ordered(rules)
    if len(ordered) <= INLINE_RULES:
        hit = F.lit(None).cast("struct<rule:string,verdict:string>")
        for verdict, rule, host, path in reversed(ordered):
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            hit = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
        return pages.withColumn("_hit", hit).withColumn("rule", F.col("_hit.rule")).withColumn("rule_verdict", F.col("_hit.verdict")).drop("_hit")
    table = pages.sparkSession.createDataFrame(ordered, "verdict string, rule string, rule_host string, rule_path string")
    keys = pages.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = keys.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("rule_host"))
    fits = suffixes.join(table, "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule_host"), F.length("rule_path"))).alias("_hit"))
    return pages.join(best, ["host", "path"], "left").withColumn("rule", F.col("_hit.rule")).withColumn("rule_verdict", F.col("_hit.verdict")).drop("_hit")


SUFFIX = "element_at(split(host, '[.]'), -1)"


def _domain() -> str:
    two = f"size(split(host, '[.]')) > 2 and length({SUFFIX}) = 2 and element_at(split(host, '[.]'), -2) in ({', '.join(repr(x) for x in SECOND_LEVEL)})"
    return f"substring_index(host, '.', case when {two} then -3 else -2 end)"


#: level: (columns of its key, of its parent's)
LEVELS = [("suffix", "one"), ("domain", "suffix"), ("host", "domain")]


def spread_sql(level: str, parent: str) -> tuple[str, str]:
    """Of one parent's labelled children: their spread beyond chance, and what it would be if each child were all good or all bad."""
    n, k, p = f"n_{level}", f"k_{level}", f"(k_{parent} / n_{parent})"
    spread = f"sum({n} * ({k} / {n} - {p}) * ({k} / {n} - {p})) - {p} * (1 - {p}) * (count(1) - 1)"
    return spread, f"{p} * (1 - {p}) * (n_{parent} - sum({n} * {n}) / n_{parent} - (count(1) - 1))"


#: Strength of a level's prior from the sums of both over all parents.
STRENGTH = f"case when sum(room) is null or sum(room) <= 0 or sum(spread) <= sum(room) * {1 / (1 + STRONGEST)} then {STRONGEST} when sum(spread) >= sum(room) * {1 / (1 + WEAKEST)} then {WEAKEST} else sum(room) / sum(spread) - 1 end"


def weight_sql(level: str) -> str:
    """Effective pages of a child: those of one child say less the more there are."""
    return f"case when n_{level} > 0 then n_{level} * (s_{level} + 1) / (s_{level} + n_{level}) else 0.0 end"


def prior_sql(level: str, parent: str) -> tuple[str, str]:
    """Mean and strength of a child's prior: its parent's, with the evidence e of which b is bad, of its siblings."""
    others = f"(e_{parent} - e)"
    known = f"(a_{parent} + {others})"
    mean = f"(a_{parent} * m_{parent} + b_{parent} - b) / {known}"
    return mean, f"case when {others} <= 1e-9 then a_{parent} else 1 / (1 / (s_{level} + 1) + 1 / ({known} + 1)) - 1 end"


#: The whole's own prior: mean and strength.
ROOT = (0.5, 1.0)
POSTERIOR = "(k_host + a_host * m_host) / (n_host + a_host)"
LOWER_BOUND = f"mean - {Z} * sqrt(mean * (1 - mean) / (n_host + a_host + 1))"
#: Rows up to which the table of a level is broadcast.
FEW = 50_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= FEW else table


def reputation(pages: DataFrame) -> DataFrame:
    """host, suffix, domain, n, k (labelled and bad pages), mean and lower (posterior) of every host; pages: host and bad (boolean or null)."""
    n = F.count("bad").cast("double")
    k = F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0))
    hosts = pages.groupBy("host").agg(n.alias("n_host"), k.alias("k_host"))
    tables = {"host": materialise(hosts.selectExpr("*", f"{SUFFIX} as suffix", f"{_domain()} as domain"))}
    for level, child, above in (("domain", "host", ["suffix"]), ("suffix", "domain", []), ("one", "suffix", [])):
        rows = tables[child] if level != "one" else tables[child].withColumn("one", F.lit(1))
        tables[level] = materialise(rows.groupBy(level).agg(F.sum(f"n_{child}").alias(f"n_{level}"), F.sum(f"k_{child}").alias(f"k_{level}"), *(F.first(c).alias(c) for c in above)))
    prior = tables["one"].selectExpr("one", f"{ROOT[0]}D as m_one", f"{ROOT[1]}D as a_one")
    for level, parent in LEVELS:
        rows = tables[level] if parent != "one" else tables[level].withColumn("one", F.lit(1))
        above = _small(tables[parent].select(parent, f"n_{parent}", f"k_{parent}"))
        spread, room = spread_sql(level, parent)
        each = rows.join(above, parent).where(f"n_{level} > 0").groupBy(parent, f"n_{parent}", f"k_{parent}").agg(F.expr(spread).alias("spread"), F.expr(room).alias("room"))
        rows = rows.crossJoin(F.broadcast(each.agg(F.expr(STRENGTH).cast("double").alias(f"s_{level}"))))  # one row
        rows = rows.withColumn("e", F.expr(weight_sql(level))).withColumn("b", F.when(F.col(f"n_{level}") > 0, F.expr(f"e * k_{level} / n_{level}")).otherwise(F.lit(0.0)))
        known = rows.groupBy(parent).agg(F.sum("e").alias(f"e_{parent}"), F.sum("b").alias(f"b_{parent}")).join(prior, parent)
        mean, strength = prior_sql(level, parent)
        found = rows.join(_small(materialise(known)), parent).withColumn(f"m_{level}", F.expr(mean)).withColumn(f"a_{level}", F.expr(strength))
        prior = found.select(level, f"m_{level}", f"a_{level}")
    out = found.withColumn("mean", F.expr(POSTERIOR)).withColumn("lower", F.expr(LOWER_BOUND))
    return out.select("host", "domain", "suffix", F.col("n_host").alias("n"), F.col("k_host").alias("k"), "mean", "lower")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, most_bad: float = MOST_BAD, url: str = "url") -> DataFrame:
    """pages (url, bad) with host, path, rule (or null), reputation_mean, reputation_lower and verdict."""
    pages = apply_rules(url_parts(pages.drop("reputation_mean", "reputation_lower", "verdict"), url), rules)
    known = reputation(pages).selectExpr("host", "mean as reputation_mean", "lower as reputation_lower")
    pages = pages.join(known, "host", "left")
    own = F.when(F.col("reputation_lower") > most_bad, "block").otherwise("allow")
    return pages.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict")


#: Outcome of a page: bad if symbols or capitals make up too much of its visible text.
SYMBOLS, MOST_SYMBOLS, MOST_CAPITALS = "#*$%&|<>", 0.03, 0.2
#: A script or style that isn't closed hides the rest, which also keeps the search linear.
HIDDEN, TAGS = r"<(script|style)[^<>]*>.*?(</(script|style)>|\z)", "<[^<>]*>"


def outcomes(pages: DataFrame) -> DataFrame:
    """pages without html, with the outcome bad, judged from the visible text; null html: null."""
    text = F.regexp_replace(F.regexp_replace("html", f"(?s){HIDDEN}", ""), TAGS, " ")
    pages = pages.drop("bad").withColumn("_t", text)
    size = F.length("_t") + 1
    bad = ((size - 1 - F.length(F.translate("_t", SYMBOLS, ""))) / size > MOST_SYMBOLS) | ((size - 1 - F.length(F.translate("_t", UPPER, ""))) / size > MOST_CAPITALS)
    return pages.withColumn("bad", bad).drop("_t", "html")


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    pages = outcomes(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    domain = f"""case when len(l) > 2 and length(l[-1]) = 2 and l[-2] in ({', '.join(repr(x) for x in SECOND_LEVEL)}) then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end"""
    ordered = _ordered(RULES)
    case = lambda what: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(v, r)[what]}'" for v, r, h, p in ordered) + " end"
    sql = f"""with cut as (select page_id, case when contains(url, '://') then url[instr(url, '://') + 3:] else '' end as rest,
 regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'gs'), '{TAGS}', ' ', 'g') as t from pages),
parts as (select page_id, coalesce(rest, '') as rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0) as raw, t from cut),
urls as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*', 0) as path,
 (length(t) - length(translate(t, '{SYMBOLS}', ''))) / (length(t) + 1) > {MOST_SYMBOLS} or (length(t) - length(translate(t, '{UPPER}', ''))) / (length(t) + 1) > {MOST_CAPITALS} as bad from parts),
h0 as (select host, string_split(host, '.') as l, count(bad)::double as n_host, coalesce(sum(bad::int), 0)::double as k_host from urls group by host),
host as (select host, n_host, k_host, l[-1] as suffix, {domain} as domain from h0),
domain as (select domain, suffix, sum(n_host) as n_domain, sum(k_host) as k_domain from host group by all),
suffix as (select suffix, 1 as one, sum(n_domain) as n_suffix, sum(k_domain) as k_suffix from domain group by suffix),
one as (select one, sum(n_suffix) as n_one, sum(k_suffix) as k_one from suffix group by one),
p_one as (select one, {ROOT[0]} as m_one, {ROOT[1]} as a_one from one)"""
    for level, parent in LEVELS:
        (spread, room), (mean, strength) = spread_sql(level, parent), prior_sql(level, parent)
        sql += f""",
x_{level} as (select {STRENGTH} as s_{level} from (select {spread} as spread, {room} as room from {level} join (select {parent}, n_{parent}, k_{parent} from {parent}) using ({parent}) where n_{level} > 0 group by {parent}, n_{parent}, k_{parent})),
w_{level} as (select *, case when n_{level} > 0 then e * k_{level} / n_{level} else 0.0 end as b from (select *, {weight_sql(level)} as e from {level}, x_{level})),
p_{level} as (select w.*, {mean} as m_{level}, {strength} as a_{level} from w_{level} w join (select {parent}, sum(e) as e_{parent}, sum(b) as b_{parent} from w_{level} group by {parent}) using ({parent}) join (select {parent}, m_{parent}, a_{parent} from p_{parent}) using ({parent}))"""
    return sql + f""",
judged as (select host, {LOWER_BOUND} as low from (select *, {POSTERIOR} as mean from p_host))
select page_id, host, path, {case(1)} as rule, coalesce({case(0)}, case when low > {MOST_BAD} then 'block' else 'allow' end) as verdict from urls join judged using (host)"""
