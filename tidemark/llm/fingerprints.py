"""Document fingerprints: a homomorphic multiset hash of paragraphs, by expressions alone.

Every paragraph (a line with a word) has a wide vector of 120 lanes, four bits each, hashed from it; its sentences, where it
has several, add theirs. A text's fingerprint is the lane-wise sum modulo 2^24, with the number of summands in front. So the
order of paragraphs doesn't matter, equal texts have equal fingerprints, and a paragraph is inserted or deleted by adding or
subtracting its vector, without a look at the rest (``inserted``, ``deleted``). Lanes around their mean are a random
projection of the multiset, whose cosine tells how much two texts share (``likeness``).

Defined results: a null text is empty; a text without a word has the zero fingerprint; two equal fingerprints have
likeness 1, else a zero one has 0. Documents are ordered by doc_id (null first), those that share one by text; each is
followed by the next row in that order, the last one by the first. Repeated rows are fingerprinted each. Other columns of the
table are ignored. An empty table gives no rows. Lanes wrap at 2^24: equality, insertion and deletion hold at any length,
likeness up to two million repeats of one paragraph.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import null_safe_text, table

SEEDS, DIGITS, WORDS = ("0", "1"), 15, 4
LANES = len(SEEDS) * WORDS * DIGITS
MODULUS, COUNT_MODULUS = 1 << 24, 1 << 32
#: Two digits of a word, 32 bits apart, are summed in one number: sums stay apart for 2^27 summands.
PACKED = 15 | 15 << 32
SENTENCE_ENDS = (". ", "? ", "! ")
#: Documents of a range of ids that are ordered in one task, as long as there are at most MOST_RANGES ranges (their bounds are kept in the plan).
RANGE_DOCS, MOST_RANGES = 1024, 1 << 16
LEAST = -(1 << 63)


def units(text: Column) -> Column:
    """The paragraphs of a text and the sentences of those that have several; blank ones are left out."""

    def parts(p: Column) -> Column:
        cut = p
        for end in SENTENCE_ENDS:
            cut = F.replace(cut, F.lit(end), F.lit(end[0] + "\n"))
        sentences = F.split(cut, "\n", -1)
        return F.when(F.size(sentences) > 1, F.concat(F.array(p), sentences)).otherwise(F.array(p))

    return F.filter(F.flatten(F.transform(F.split(text, "\n", -1), parts)), lambda u: u.rlike(r"[^\x20\x09-\x0D]"))


def lanes(df: DataFrame, keys: list[str], unit: str = "unit") -> DataFrame:
    """keys and v, the sum of the units' vectors as an array: their number, then the lanes; null units add nothing."""
    hashed = df.select(*keys, unit, *(F.sha2(F.concat(F.lit(s), F.col(unit)), 256).alias(f"h{s}") for s in SEEDS))
    words = [F.conv(F.substring(f"h{s}", 1 + DIGITS * j, DIGITS), 16, 10).cast("bigint") for s in SEEDS for j in range(WORDS)]
    named = hashed.select(*keys, unit, *(w.alias(f"w{i}") for i, w in enumerate(words)))
    half = 8  # digits i and i + 8 of a word are summed together; there is no sixteenth digit
    sums = [F.sum(F.shiftright(f"w{i}", 4 * d).bitwiseAND(F.lit(PACKED))).alias(f"s{i}_{d}") for i in range(len(words)) for d in range(half)]
    summed = named.groupBy(*keys).agg(F.count(unit).alias("n"), *sums)
    digit = lambda i, d: F.col(f"s{i}_{d}").bitwiseAND(F.lit((1 << 32) - 1)) if d < half else F.shiftright(f"s{i}_{d - half}", 32)
    order = [digit(i, d) for i in range(len(words)) for d in reversed(range(DIGITS))]  # as the hexadecimal digits are written
    values = [F.coalesce(x, F.lit(0).cast("bigint")).bitwiseAND(F.lit(MODULUS - 1)) for x in order]
    return summed.select(*keys, F.array(F.col("n").bitwiseAND(F.lit(COUNT_MODULUS - 1)), *values).alias("v"))


def _modulo(x: Column, i: Column) -> Column:
    return F.when(i == 0, F.pmod(x, F.lit(COUNT_MODULUS))).otherwise(F.pmod(x, F.lit(MODULUS)))


def inserted(v: Column, more: Column) -> Column:
    """v with the paragraphs summed in more."""
    return F.transform(F.zip_with(v, more, lambda a, b: a + b), _modulo)


def deleted(v: Column, less: Column) -> Column:
    """v without the paragraphs summed in less."""
    return F.transform(F.zip_with(v, less, lambda a, b: a - b), _modulo)


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), 1 + LANES)


def centred(v: Column) -> Column:
    """Twice the lanes' distances from their mean, without their number."""
    n = F.element_at(v, 1)
    return F.transform(F.slice(v, 2, LANES), lambda x: F.pmod(2 * x - 15 * n + F.lit(MODULUS), F.lit(2 * MODULUS)) - F.lit(MODULUS))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness, from 0 to 1, of the fingerprints in columns a and b: the cosine of their centred lanes, negative ones being 0."""
    own = df.withColumns({"_a": centred(F.col(a)), "_b": centred(F.col(b))})
    own = own.withColumns({"_ab": _dot(F.col("_a"), F.col("_b")), "_aa": _dot(F.col("_a"), F.col("_a")), "_bb": _dot(F.col("_b"), F.col("_b"))})
    cosine = F.col("_ab") / (F.sqrt(F.col("_aa").cast("double")) * F.sqrt(F.col("_bb").cast("double")))
    value = F.when(F.col(a) == F.col(b), 1.0).when((F.col("_aa") == 0) | (F.col("_bb") == 0), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), 9))
    return own.withColumn(name, value).drop("_a", "_b", "_ab", "_aa", "_bb")


def as_text(v: Column) -> Column:
    """The number in 8 and each lane in 6 hexadecimal digits."""
    return F.array_join(F.transform(v, lambda x, i: F.lpad(F.lower(F.hex(x)), F.when(i == 0, 8).otherwise(6), F.lit("0"))), "")


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, which name a row, and v, the fingerprint of its text."""
    return lanes(docs.select(*keys, F.explode_outer(units(null_safe_text(text))).alias("unit")), keys)


def successors(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs in ranges of ids (part, place from 1), where extra rows at a range's end repeat the first rows of the range behind it.

    The next row in a range is therefore the next document, the first one coming behind the last. Bounds come from approximate
    quantiles of doc_id; texts are shuffled once, by range.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", null_safe_text().alias("text"), F.coalesce("doc_id", F.lit(LEAST)).alias("key"))
    n = own.count()
    parts = min(MOST_RANGES, -(-n // RANGE_DOCS))
    bounds: list[int] = []
    if parts > 1:
        shares = F.split(F.lit(",".join(repr(i / parts) for i in range(1, parts))), ",").cast("array<double>")
        bounds = sorted(set(own.agg(F.percentile_approx("key", shares, F.lit(max(10_000, 4 * parts)))).first()[0]))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if bounds:  # the number of bounds that aren't above the key, by bisection
        known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(known, at + s - 1) <= F.col("key"), at + s).otherwise(at))
    else:
        part = F.lit(0)
    own = own.withColumn("part", part)
    first = sorted((r["part"], r["key"]) for r in own.groupBy("part").agg(F.min("key").alias("key")).collect())  # a row for each range
    behind = [{"first": key, "to": first[i - 1][0]} for i, (_, key) in enumerate(first)]
    ahead = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(behind)), "array<struct<first: bigint, to: int>>")))
    extra = own.join(F.broadcast(ahead), own["key"] == ahead["first"])  # at most MOST_RANGES rows are broadcast
    both = own.select("part", "doc_id", "key", "text", F.lit(False).alias("extra")).unionByName(extra.select(F.col("to").alias("part"), "doc_id", "key", "text", F.lit(True).alias("extra")))
    w = Window.partitionBy("part").orderBy("extra", F.col("key"), F.col("doc_id").asc_nulls_first(), "text")
    return both.select("part", "doc_id", "text", "extra", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, v, edited and next_v (fingerprints of the text, the edited text and the next document) for each row of docs.

    The edited fingerprint isn't summed anew: what the edit removes is deleted from v, what it brings is inserted.
    """
    rows = successors(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumns({"kept": F.left("text", F.col("n_chars").cast("int") - half), "new": F.when(~F.col("extra"), F.left("next", half))})
    open_ = F.substring_index("kept", "\n", -1)  # the beginning of the paragraph that the edit cuts
    rows = rows.withColumn("same", F.char_length("kept") - F.char_length(open_))
    of = lambda text, kind: F.transform(units(text), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit")))
    rest = lambda text: F.substr(text, F.col("same") + 1)
    after = F.concat(rest(F.col("kept")), F.coalesce("new", F.lit("")))
    same = F.left("text", F.col("same"))
    every = F.concat(of(same, 0), of(rest(F.col("text")), 1), F.when(~F.col("extra"), of(after, 2)).otherwise(F.array().cast("array<struct<kind: int, unit: string>>")))
    keys = ["part", "place", "doc_id", "extra", "n_chars", "edited_sha256"]
    edited = F.when(~F.col("extra"), F.sha2(F.concat("kept", F.coalesce("new", F.lit(""))), 256))
    whole_rows = rows.select("part", "place", "doc_id", "extra", "n_chars", edited.alias("edited_sha256"), every.alias("every"))  # before the rows are multiplied
    exploded = whole_rows.select(*keys, F.explode_outer("every").alias("u")).select(*keys, "u.kind", "u.unit")
    kinds = [F.max(F.when(F.coalesce("kind", F.lit(0)) == k, F.col("v"))).alias(f"v{k}") for k in range(3)]
    summed = lanes(exploded, [*keys, "kind"]).groupBy(*keys).agg(*kinds)
    whole = summed.withColumns({f"v{k}": F.coalesce(f"v{k}", zero()) for k in range(3)})
    whole = whole.withColumn("v", inserted(F.col("v0"), F.col("v1"))).withColumn("edited", inserted(deleted(F.col("v"), F.col("v1")), F.col("v2")))
    w = Window.partitionBy("part").orderBy("place")
    return whole.withColumn("next_v", F.lead("v").over(w)).where("not extra").select("doc_id", "n_chars", "edited_sha256", "v", "edited", "next_v")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_edits(table(spark, sf_dir, "documents"))
    rows = likeness(likeness(rows, "v", "edited", "near_edited"), "v", "next_v", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next")


def oracle_sql() -> str:
    """DuckDB: both texts summed in full, digit by digit; no ranges, no insertion or deletion, no packed sums."""
    return r"""
with d as (select row_number() over w as r, doc_id, coalesce(text, '') as t,
  coalesce(lead(coalesce(text, '')) over w, first_value(coalesce(text, '')) over (order by doc_id nulls first, coalesce(text, ''))) as nx
  from documents window w as (order by doc_id nulls first, coalesce(text, ''))),
e as (select *, length(t) as n, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) as ed from d),
texts as (select r, 'own' as which, t from e union all select r, 'edited', ed from e),
paragraphs as (select r, which, unnest(string_split(t, chr(10))) as p from texts),
sentences as (select r, which, p, string_split(replace(replace(replace(p, '. ', '.' || chr(10)), '? ', '?' || chr(10)), '! ', '!' || chr(10)), chr(10)) as s from paragraphs),
unit as (select r, which, p as u from paragraphs union all select r, which, unnest(s) from sentences where len(s) > 1),
word as (select r, which, u from unit where regexp_matches(u, '[^\x20\x09-\x0D]')),
hashed as (select r, which, substr(sha256('0' || u), 1, 60) || substr(sha256('1' || u), 1, 60) as h from word),
digits as (select r, which, unnest(range(1, 121)) as lane, unnest(string_split(h, '')) as c from hashed),
lane as (select r, which, lane, sum(instr('0123456789abcdef', c) - 1) as s, count(*) as k from digits group by all),
own as (select r, which, list(s order by lane) as s, max(k) as k from lane group by r, which),
every as (select t.r, t.which, coalesce(o.k, 0) as k, coalesce(o.s, list_transform(range(120), lambda x: 0)) as s from texts t left join own o on o.r = t.r and o.which = t.which),
written as (select r, which, k, s, format('{:08x}', k) || list_aggregate(list_transform(s, lambda x: format('{:06x}', (x % 16777216)::bigint)), 'string_agg', '') as f, list_transform(s, lambda x: (2 * x - 15 * k)::double) as v from every),
near as (select a.r, a.f, b.f as ef, x.f as xf, a.v, b.v as ev, x.v as xv from written a join written b on a.r = b.r and a.which = 'own' and b.which = 'edited'
  join written x on x.which = 'own' and x.r = case when a.r = (select max(r) from d) then 1 else a.r + 1 end)
select doc_id, n as n_chars, sha256(ed) as edited_sha256, f as fingerprint, ef as edited_fingerprint,
 case when f = ef then 1.0 when list_dot_product(v, v) = 0 or list_dot_product(ev, ev) = 0 then 0.0
  else round(greatest(0.0, least(1.0, list_dot_product(v, ev) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(ev, ev))))), 9) end as near_edited,
 case when f = xf then 1.0 when list_dot_product(v, v) = 0 or list_dot_product(xv, xv) = 0 then 0.0
  else round(greatest(0.0, least(1.0, list_dot_product(v, xv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(xv, xv))))), 9) end as near_next
from e join near using (r)"""
