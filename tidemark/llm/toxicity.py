"""Toxicity: a classifier chain over labelled categories (operator 1).

The categories are predicted one after another. The linear model of each category sees the words of
a text, the beginnings of its longer words, and the log-odds of all earlier categories. For training,
those log-odds are out-of-fold: each row's come from models fitted without its fold; for prediction
they come from the models fitted on all rows. Every model is a logistic regression with an L1
penalty on the features that a chi-square screening keeps, of those that speak for the category; their weights
are not negative, so no length of ordinary words excuses a toxic one.

A text is judged in windows of WINDOW words that overlap by half, and its odds are the root of the mean of their squared odds (a
power mean of order ORDER): one strong window decides a long text too, yet must say more the longer the text is,
so that a long clean text doesn't add up to a toxic one. A passage of half a window is whole in some window wherever it starts.

The models are fitted on the driver on at most SAMPLE rows for each combination of labels (those of
least hashed id), of whole texts; a row drawn stands for as many as its combination has for each one
drawn, so that probabilities are those of all labelled rows. Copies of a text share a fold, and of rows
that share a doc_id one is trained on. Prediction is one pass over the whole texts, without a shuffle.

Defined results: a null or empty text has no words and gets the models' constants; unlabelled rows
and labels without a document aren't trained on; with no labelled rows, or only one value of a
label, its probability is the share of positive rows (0 without rows); repeated rows are judged
alike; extra columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, append_columns, give_back, null_safe_text

#: Most training rows for each combination of labels.
SAMPLE = 3000
FOLDS = 3
#: Features that a screening keeps, the fewest rows a feature must be in, and the penalty for a row.
FEATURES, LEAST_ROWS, PENALTY, STEPS = 3000, 4, 1e-4, 300
#: Lengths, in bytes, of the word beginnings that are features of longer words.
BEGINNINGS = (4, 5, 6)
#: A text is toxic from this probability on.
THRESHOLD = 0.4
#: Words whose evidence adds up, and the order of the mean over a text's windows: 1 lets long texts hide a passage, the maximum flags whatever is long.
WINDOW, ORDER = 200, 2
CACHE = 200_000

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SYMBOLS, _CAPITALS = b"#*$%&|<>", bytes(range(65, 91))


def windows(text: str, size: int) -> list[set[bytes]]:
    """The different words of each window of a text (windows of size words that overlap by half; one if the text isn't longer), lower-cased A-Z and without ASCII punctuation, and the text's shares of symbols and capitals as pseudo-words."""
    raw = text.encode("utf-8", "surrogatepass")
    share = lambda kind: min(9, 20 * (len(raw) - len(raw.translate(None, kind))) // (len(raw) + 1))
    every, shares = raw.translate(_WORDS).split(), (b"\x00s%d" % share(_SYMBOLS), b"\x00u%d" % share(_CAPITALS))
    if len(every) <= size:
        return [{*every, *shares}]
    halves = -(-len(every) // max(1, size // 2))  # of equal length, but for a word
    at = [len(every) * k // halves for k in range(halves + 1)]
    return [{*every[at[k] : at[k + 2]], *shares} for k in range(halves - 1)]


def words(text: str) -> set[bytes]:
    """All words of a text, as one window."""
    return windows(text, len(text) + 1)[0]


def features(word: bytes) -> list[int]:
    return [zlib.crc32(word), *(zlib.crc32(word[:n] + b"\x00") for n in BEGINNINGS if len(word) > n)]


@dataclass
class Linear:
    """weight of each feature (by its 32-bit hash), of the earlier categories' log-odds, and the constant."""

    weight: dict[int, float] = field(default_factory=dict)
    links: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float = 0.0


class Rows:
    """Binary features of rows: features of row i are cols[at[i]:at[i + 1]], numbers into names. least: features in fewer rows are left out."""

    def __init__(self, found: list[np.ndarray], least: int = 1):
        self.n = len(found)
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        flat.sort()  # a row holds a feature once: one in `least` rows or more is found again least - 1 places further
        begins = flat[: max(0, len(flat) - least + 1)]
        self.names = np.unique(begins[begins == flat[least - 1 :]])
        del flat, begins
        kept = []
        for f in found:
            at = np.searchsorted(self.names, f).astype(np.int32)
            inside = at < len(self.names)
            inside[inside] = self.names[at[inside]] == f[inside]
            kept.append(at[inside])
        self.cols = np.concatenate(kept) if kept else np.zeros(0, np.int32)
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(k) for k in kept])


def fit_linear(x: Rows, links: np.ndarray, y: np.ndarray, use: np.ndarray, stands: np.ndarray) -> Linear:
    """Logistic regression with an L1 penalty on the screened features, by accelerated proximal gradients; stands: how many rows each row stands for, 1 on the average."""
    share = float(np.average(y[use], weights=stands[use])) if use.any() else 0.0
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if share in (0.0, 1.0):
        return Linear(links=np.zeros(links.shape[1]), constant=base)
    keep = use[x.rows]
    rows, cols = x.rows[keep], x.cols[keep]
    df = np.bincount(cols, minlength=len(x.names)).astype(float)
    hits = np.bincount(cols, y[rows], len(x.names))
    n = float(use.sum())
    expected = df * share
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.where((df >= LEAST_ROWS) & (hits > expected), (hits - expected) ** 2 / (expected * (1 - share) * np.maximum(1 - df / n, 1e-9)), 0.0)
    best = np.sort(np.argsort(-chi2, kind="stable")[:FEATURES])
    best = best[chi2[best] > 0]
    place = np.full(len(x.names), -1)
    place[best] = np.arange(len(best))
    inside = place[cols] >= 0
    rows, cols, m = rows[inside], place[cols[inside]], len(best)
    at = np.cumsum(use) - 1
    rows, t, extra, each = at[rows], y[use].astype(float), links[use], stands[use]
    k = extra.shape[1]
    scale = np.sqrt(n / df[best])  # columns of equal length, so that rare words learn as fast as frequent ones
    forward = lambda w: np.bincount(rows, (w[:m] * scale)[cols], len(t)) + extra @ w[m : m + k] + w[-1]
    back = lambda r: np.r_[np.bincount(cols, r[rows], m) * scale, extra.T @ r, r.sum()]
    # the curvature is at most a quarter of the largest eigenvalue of X'X / n, found by power iteration
    v = np.ones(m + k + 1)
    for _ in range(12):
        v = back(each * forward(v / np.linalg.norm(v)))
    rate = 4.0 * n / (1.05 * np.linalg.norm(v))
    w = np.zeros(m + k + 1)
    w[-1] = base
    v, step = w, 1.0
    shrink = PENALTY * scale
    for _ in range(STEPS):
        new = v - rate * back(each * (1 / (1 + np.exp(-forward(v))) - t) / n)
        new[:m] = np.maximum(new[:m] - rate * shrink, 0)
        after = (1 + np.sqrt(1 + 4 * step * step)) / 2
        v, w, step = new + (step - 1) / after * (new - w), new, after
    names, w[:m] = x.names[best], w[:m] * scale
    return Linear({int(names[i]): float(w[i]) for i in np.flatnonzero(w[:m])}, w[m : m + k].copy(), float(w[-1]))


def log_odds(model: Linear, x: Rows, links: np.ndarray) -> np.ndarray:
    weight = np.array([model.weight.get(int(f), 0.0) for f in x.names])
    z = np.bincount(x.rows, weight[x.cols], x.n) if len(x.cols) else np.zeros(x.n)
    return np.clip(z + links @ model.links + model.constant, -8, 8)


def fit_chain(x: Rows, labels: np.ndarray, folds: np.ndarray, stands: np.ndarray | None = None) -> list[Linear]:
    """A model for each column of labels; folds: each row's fold; stands: how many rows it stands for, 1 on the average."""
    stands = np.ones(x.n) if stands is None else stands
    chain, links = [], np.zeros((x.n, 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(fit_linear(x, links, y, np.ones(x.n, bool), stands))
        if c + 1 < labels.shape[1]:
            out = np.zeros(x.n)
            for f in range(FOLDS):
                part = fit_linear(x, links, y, folds != f, stands)
                out[folds == f] = log_odds(part, x, links)[folds == f]
            links = np.column_stack([links, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> list[Linear]:
    """The chain fitted on a bounded sample of the documents that labels (doc_id and 0/1 categories) covers."""
    labels = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*(F.max(F.col(c).cast("int")).alias(f"_y{i}") for i, c in enumerate(categories)))
    labels = labels.withColumn("_h", F.xxhash64("doc_id"))
    ys = [f"_y{i}" for i in range(len(categories))]
    parts = []
    for combination in range(2 ** len(ys)):
        want = [F.col(y) == (combination >> i & 1) for i, y in enumerate(ys)]
        part = labels
        for w in want:
            part = part.where(w)
        parts.append(part.orderBy("_h", "doc_id").limit(sample))
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)

    def make():
        def work(batch):
            found = [np.unique(np.array([f for w in words(t) for f in features(w)], np.uint32)).tobytes() for t in batch.column("text").to_pylist()]
            return [pa.array(found, pa.binary())]

        return work

    rows = docs.select("doc_id", null_safe_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample rows a combination
    rows = append_columns(rows, make, "_f binary", drop=("text",)).groupBy("doc_id", "_h", *ys).agg(F.min("_f").alias("_f")).select("_h", "_f", *ys).toArrow()
    rows = rows.sort_by([("_h", "ascending"), ("_f", "ascending")]) if len(rows) else rows
    # a row stands for as many as its combination of labels has in all
    total = {tuple(r[y] for y in ys): r["n"] for r in labels.groupBy(*ys).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a combination
    own = np.array([rows.column(y).to_numpy() for y in ys], int).T.reshape(len(rows), len(ys))
    drawn = Counter(map(tuple, own.tolist()))
    stands = np.array([total[c] / drawn[c] for c in map(tuple, own.tolist())])
    found = [np.frombuffer(f.as_buffer(), np.uint32) for f in rows.column("_f")]
    folds = np.array([zlib.crc32(f) % FOLDS for f in found], int)  # copies of a text share a fold
    x = Rows(found, LEAST_ROWS)  # no model of any fold takes a feature in fewer rows
    del rows, found
    chain = fit_chain(x, own, folds, stands / max(stands.mean(), 1e-300) if len(stands) else stands)
    del x
    give_back()
    return chain


def predict(docs: DataFrame, chain: list[Linear], categories: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """docs with p_<category> of each category, and toxic by the category of that name (else the first)."""
    names, verdict = [*(f"p_{c}" for c in categories), "toxic"], categories.index("toxic") if "toxic" in categories else 0
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES weights a category

    def make():
        chain = shared.value
        table: dict[int, np.ndarray] = {}
        for c, model in enumerate(chain):
            for f, w in model.weight.items():
                table.setdefault(f, np.zeros(len(chain)))[c] = w
        nothing = np.zeros(len(chain))
        cache = Recent(CACHE)

        def work(batch):
            rows = [windows(t, WINDOW) for t in batch.column("text").fill_null("").to_pylist()]
            for w in cache.missing(set().union(*(w for r in rows for w in r))):
                known = [table[f] for f in features(w) if f in table]
                cache.new[w] = sum(known) if known else nothing
            get = cache.new.__getitem__
            odds = np.zeros((len(rows), len(chain)))
            for i, r in enumerate(rows):
                each = np.zeros((len(r), len(chain)))
                for k, window in enumerate(r):
                    if said := [v for v in map(get, window) if v is not nothing]:
                        each[k] = np.sort(np.array(said), axis=0).sum(axis=0)  # in an order that no set decides
                odds[i] = (np.logaddexp.reduce(ORDER * each, axis=0) - np.log(len(r))) / ORDER
            z = np.zeros((len(rows), 0))
            for c, model in enumerate(chain):
                z = np.column_stack([z, np.clip(odds[:, c] + z @ model.links + model.constant, -8, 8)])
            p = 1 / (1 + np.exp(-z))
            return [*(pa.array(p[:, c]) for c in range(len(chain))), pa.array(p[:, verdict] >= threshold)]

        return work

    return append_columns(docs.drop(*names), make, ", ".join(f"p_{c} double" for c in categories) + ", toxic boolean")


#: In the order of the chain: the verdict's model sees what the one before it made of a text.
CATEGORIES = ["junk", "toxic"]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with p_junk, p_toxic and toxic; labels: doc_id, quality (0 is junk) and toxic."""
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return predict(docs, train(docs, labels, CATEGORIES), CATEGORIES)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, the probabilities of the chain's categories and the verdict, for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
