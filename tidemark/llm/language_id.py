"""Language ID: Bayesian fusion of evidence (operator 9).

For each page the log-probabilities of the languages add up from

- its visible text: byte pairs under a model of each language, counted over all labelled documents;
  the sum is tempered, as neighbouring bytes aren't independent;
- the language its markup declares: how often that goes with each language among the other pages, smoothed;
- its address: the languages of the other pages of its host, smoothed towards those of the registered
  domain, these towards those of the suffix, and these towards those of all. So the suffix speaks once,
  as the level above the domain.

Counts come from grouped aggregation over the pages whose text alone makes the language clear. A page's
own count is left out at every level, so it doesn't vote for itself. Groups are summed map-side, so a
host with a third of all pages is a few partial sums.

Defined results: a null or empty html has no text and no declaration, a null url no host; such pages
go by the evidence they have, at last by the shares of all pages; ties go to the language first in
order; a table without labelled documents gives a null language, and one with more than MOST_LANGS an error; repeated rows are judged each; extra
columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, materialise, sliced, tidied, utf8
from .url_filters import SUFFIX, _domain, url_parts

#: Weight of the text's log-likelihood, and the most bytes it counts for.
TEMPER, MOST_BYTES = 0.1, 2000.0
#: Pages whose text gives a language this probability are counted.
CLEAR = 0.9
#: Strength, in pages, of each level's prior from the one above, and of the evidence tables'.
STRENGTH, SMOOTH = 5.0, 1.0

#: Languages whose models the driver holds (half a MB each).
MOST_LANGS = 500

HIDDEN = re.compile(rb"(?i)<(!--|(?:script|style|nav|footer|aside|noscript)\b)")
TAG = re.compile(rb"<[^<>]*>")
ENTITY = re.compile(rb"&[#\w]{1,10};")
DECLARED = r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?([a-z]{2,3})"


def visible(html: bytes) -> bytes:
    """The text outside tags, comments and elements that hold no prose; what isn't closed hides nothing, and is looked for once."""
    out, open_, at, start = [], set(), 0, 0
    while found := HIDDEN.search(html, at):
        name, at = found[1].lower(), found.end()
        if name in open_:
            continue
        end = re.compile(rb"-->" if name == b"!--" else rb"(?i)</" + name + rb"\s*>").search(html, at)
        if end is None:
            open_.add(name)
            continue
        out.append(html[start : found.start()])
        at = start = end.end()
    return ENTITY.sub(b" ", TAG.sub(b" ", b" ".join([*out, html[start:]])))


_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256)], np.int64)


def pairs(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs within texts (letters lower-cased, others blank), without pairs of blanks, and their text numbers."""
    b = _FOLD[body]
    pair = b[:-1] * 256 + b[1:]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = (doc[1:] == doc[:-1]) & (pair != 32 * 257) if len(body) else np.zeros(0, bool)
    return pair[keep], doc[1:][keep]


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and (languages, 65,536) log-probabilities of a byte after another, from all labelled documents."""
    from pyspark.sql.types import StringType

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text", 1 << 20):
            pair, doc = pairs(*utf8(batch.column("text")))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + np.bincount(pair[langs[doc] == lang] if len(doc) else pair, minlength=65536)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "pair", "n"])

    labelled = docs.where("lang is not null and text is not null").select(F.col("lang").cast(StringType()), "text")
    counted = materialise(labelled.mapInArrow(tidied(run), "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")))
    if (many := counted.select("lang").distinct().count()) > MOST_LANGS:
        raise ValueError(f"{many} languages; models of at most {MOST_LANGS} fit the driver")
    rows = counted.toPandas()  # at most 65,536 rows a language
    langs = sorted(rows["lang"].unique())
    n = np.zeros((len(langs), 256, 256))
    for i, lang in enumerate(langs):
        part = rows[rows["lang"] == lang]
        n[i].reshape(-1)[part["pair"].to_numpy()] = part["n"].to_numpy()
    p = (n + 0.05) / (n.sum(axis=2, keepdims=True) + 256 * 0.05)
    return langs, np.log(p).reshape(len(langs), 65536)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """pages (page_id, url, html) without html, with lang, probability, text_lang, declared and suffix."""
    out = ["lang", "probability", "text_lang", "declared", "suffix", "domain"]
    langs, model = text_model(docs)
    pages = pages.drop(*out)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.drop("html").select("*", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("suffix"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    n_langs = len(langs)

    def make():
        model = shared.value

        def work(batch):
            texts = [visible((h or "").encode("utf-8", "surrogatepass")) for h in batch.column("html").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            pair, doc = pairs(np.frombuffer(b"".join(texts), np.uint8), at)
            size = np.bincount(doc, minlength=len(texts))
            weight = TEMPER * np.minimum(1.0, MOST_BYTES / np.maximum(size, 1))
            sums = np.stack([np.bincount(doc, m[pair], len(texts)) * weight for m in model], axis=1)
            sums -= sums.max(axis=1, keepdims=True)
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n_langs, dtype=np.int32)), pa.array(sums.ravel()))]

        return work

    declared = F.lower(F.nullif(F.regexp_extract(F.col("html"), DECLARED, 1), F.lit("")))
    judged = append_columns(pages.withColumn("declared", declared), make, "_text array<double>", most_bytes=1 << 20, column="html", drop=("html",))
    judged = url_parts(judged).selectExpr(*[f"`{c}`" for c in pages.columns if c not in ("html", "host", "path")], "host", "declared", "_text", f"{SUFFIX} as suffix", f"{_domain()} as domain")
    # probabilities of the text alone: exp over their sum; clear ones count for the language
    p = F.transform("_text", lambda x: F.exp(x))
    total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
    judged = judged.withColumn("_p", p).withColumn("_p", F.transform("_p", lambda x: x / total)).withColumn("_top", F.array_max("_p"))
    judged = judged.withColumn("_own", F.when(F.col("_top") >= CLEAR, F.array_position("_p", F.col("_top")).cast("int") - 1))
    judged = materialise(judged)
    known = judged.where("_own is not null")
    counts = [F.coalesce(F.count_if(F.col("_own") == i), F.lit(0)).cast("double").alias(f"n{i}") for i in range(n_langs)]
    host = known.groupBy("host", "domain", "suffix").agg(*counts)
    add = [F.sum(f"n{i}").alias(f"n{i}") for i in range(n_langs)]
    domain = host.groupBy("domain", "suffix").agg(*add)
    suffix = domain.groupBy("suffix").agg(*add)
    every = suffix.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(n_langs)]).first()
    array = lambda: F.array(*(f"n{i}" for i in range(n_langs)))
    levels = host.select(F.col("host").alias("_h"), "domain", "suffix", array().alias("_host"))
    levels = levels.join(domain.select("domain", "suffix", array().alias("_domain")), ["domain", "suffix"])
    levels = levels.join(suffix.select("suffix", array().alias("_suffix")), "suffix").drop("domain", "suffix")
    # hosts without a clear page go by their domain, else their suffix
    nothing = F.array(*(F.lit(0.0) for _ in langs))
    full = judged.join(levels, F.col("host") == F.col("_h"), "left").drop("_h")
    for column, table in (("domain", domain), ("suffix", suffix)):
        above = table.groupBy(F.col(column).alias("_k")).agg(*add).select("_k", array().alias("_other"))
        full = full.join(above, F.col(column) == F.col("_k"), "left").withColumn(f"_{column}", F.coalesce(f"_{column}", "_other")).drop("_k", "_other")
    seen = known.groupBy("declared").agg(*counts).where("declared is not null").select(F.col("declared").alias("_k"), array().alias("_declared"))
    many = seen.count()
    full = full.join(seen, F.col("declared") == F.col("_k"), "left").drop("_k")
    full = full.withColumns({c: F.coalesce(c, nothing) for c in ("_host", "_domain", "_suffix", "_declared")})
    own = lambda i: F.coalesce((F.col("_own") == i).cast("double"), F.lit(0.0))
    one = F.col("_own").isNotNull().cast("double")
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    terms = []
    for i in range(n_langs):
        p = (F.lit(every[i]) - own(i) + SMOOTH) / (F.lit(float(sum(every))) - one + SMOOTH * n_langs)
        for c in ("_suffix", "_domain", "_host"):
            p = (F.get(c, F.lit(i)) - own(i) + STRENGTH * p) / (size(c) - one + STRENGTH)
        # a page of this declaration is among those counted, if it is clear
        said = F.log((F.get("_declared", F.lit(i)) - own(i) + SMOOTH) / (F.lit(every[i]) - own(i) + SMOOTH * (many + 1)))
        terms.append(F.log(p) + F.get("_text", F.lit(i)) + F.when(F.col("declared").isNotNull(), said).otherwise(F.lit(0.0)))
    logs = F.array(*terms)
    full = full.withColumn("_z", logs).withColumn("_m", F.array_max("_z"))
    names = F.array(*(F.lit(x) for x in langs))
    return full.select(
        *[f"`{c}`" for c in pages.columns if c not in ("html", "host", "path")],
        F.get(names, F.array_position("_z", F.col("_m")).cast("int") - 1).alias("lang"),
        F.round(1 / F.aggregate(F.transform("_z", lambda x: F.exp(x - F.col("_m"))), F.lit(0.0), lambda a, x: a + x), 9).alias("probability"),
        F.get(names, F.col("_own")).alias("text_lang"), "declared", "suffix",
    )


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """page_id, lang, probability, text_lang, declared and suffix of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return identify(pages, spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")).drop("url")
