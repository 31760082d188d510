"""Toxicity classifier with counterfactual regularisation.

A logistic regression over words and the beginnings of words (so that unseen
forms of a known stem count). Training texts that name a group are paired with
a copy in which every identity term is replaced by another one of its kind;
the loss adds ``COUNTERFACTUAL`` times the squared difference of the two
scores, so that the mention of a group does not move the score by itself.

Fitting sees a bounded sample: ``MAX_TRAIN`` labelled rows, those with the
smallest hash of doc_id among rows that are not held out. Document frequencies
of all features in that sample are counted in Spark; the ``MAX_FEATURES`` whose
frequency differs most between the classes are kept, and only their counts go
to the driver (at most ``MAX_TRAIN`` short rows). Scoring covers all rows and
whole texts; the weights travel with the task.

The score reads the text only. Rows whose crc32 of doc_id modulo 3 is 1 are
held out.

Defined results: a null or empty text gets the score of a text without known
features; a null doc_id is never labelled nor held out; labels that are null
count as none, and of several labels of one doc_id toxic wins; without labels
of both classes every score is the share of toxic labels; an empty table gives
an empty result; repeated rows get equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import col, unpack, whole_row
from shortlist.session import cut_lineage

MAX_TRAIN = 20_000
MAX_FEATURES = 3_000
MIN_DOCUMENTS = 4
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
#: Weight of the squared weights against the summed losses of all rows.
L2 = 0.3
COUNTERFACTUAL = 1.0
STEPS = 250
KNOWN = 500_000
ROWS = 10_000

#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"), ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrant", "native", "refugee", "citizen"), ("immigrants", "natives", "refugees", "citizens"),
    ("old", "young", "elderly", "teenage"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
NEXT_IDENTITY = {t: kind[(i + 1) % len(kind)] for kind in IDENTITIES for i, t in enumerate(kind)}

WORDS = regex.compile(r"[\p{L}\p{M}]+").findall


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: float


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a dash)."""
    return [word] + [word[:n] + "-" for n in PREFIXES if len(word) > n]


def counts_of(text: str) -> Counter:
    return Counter(WORDS(text.lower()))


def swapped(words: Counter) -> Counter | None:
    """The words with every identity term replaced; None if there is none."""
    if not any(w in NEXT_IDENTITY for w in words):
        return None
    out: Counter = Counter()
    for w, n in words.items():
        out[NEXT_IDENTITY.get(w, w)] += n
    return out


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str,
                    max_train: int) -> DataFrame:
    """(text, y) of at most ``max_train`` labelled documents that are not
    held out. The sampled labels are bounded, so they are broadcast; of rows
    with one id the one with the smallest text hash counts."""
    known = labels.select(col(doc_id).alias("__id"), col(label).cast("int").alias("__y")).filter(
        F.col("__id").isNotNull() & F.col("__y").isNotNull()).filter(~held_out("__id"))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    return docs.select(col(doc_id).alias("__doc"), col(text).alias("text")).join(
        F.broadcast(known), F.col("__doc") == F.col("__id")).groupBy("__id").agg(
            F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.first("__y").alias("y")).drop("__id")


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, n_toxic, n of the sample, pre-aggregated in each task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_docs: Counter = Counter()
        toxic: Counter = Counter()
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1)):
                found = {f for w in counts_of(t.as_py() or "") for f in features_of(w)}
                all_docs.update(found)
                if y.as_py():
                    toxic.update(found)
        names = list(all_docs)
        table = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([all_docs[f] for f in names], pa.int64()),
             pa.array([toxic[f] for f in names], pa.int64())], ["feature", "n", "n_toxic"])
        for at in range(0, len(names), ROWS):
            yield table.slice(at, ROWS)

    each = sample.mapInArrow(count, "feature string, n bigint, n_toxic bigint")
    return each.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def select_features(counts: DataFrame, n_docs: int, n_toxic: int, max_features: int) -> list[str]:
    """The features whose document frequency differs most between classes,
    by the z value of two shares; identity terms always belong."""
    share = F.col("n") / n_docs
    gap = F.col("n_toxic") / n_toxic - (F.col("n") - F.col("n_toxic")) / (n_docs - n_toxic)
    z = F.abs(gap) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / (n_docs - n_toxic)) + 1e-12)
    best = counts.filter(F.col("n") >= MIN_DOCUMENTS).orderBy(F.desc(z), "feature").limit(max_features)
    return list(dict.fromkeys([r["feature"] for r in best.select("feature").collect()] + sorted(NEXT_IDENTITY)))


def vector(words: Counter, features: dict[str, int]) -> dict[int, float]:
    """Feature number -> log(1 + occurrences)."""
    got: Counter = Counter()
    for w, n in words.items():
        for f in features_of(w):
            i = features.get(f)
            if i is not None:
                got[i] += n
    return {i: math.log1p(n) for i, n in got.items()}


def vectors(sample: DataFrame, features: dict[str, int]) -> pd.DataFrame:
    """y, ids, values and those of the swapped text (null without one)."""
    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t, y in zip(frame["text"], frame["y"]):
                words = counts_of(t or "")
                other = swapped(words)
                v, u = vector(words, features), vector(other, features) if other else None
                rows.append((y, list(v), list(v.values()), list(u) if other else None,
                             list(u.values()) if other else None))
            yield pd.DataFrame(rows, columns=["y", "ids", "vals", "ids2", "vals2"])

    schema = "y int, ids array<int>, vals array<float>, ids2 array<int>, vals2 array<float>"
    return sample.mapInPandas(make, schema).toPandas()


def _flat(ids: list, vals: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) arrays of a list of sparse rows."""
    rows = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0)
    return rows, np.concatenate([np.asarray(i, np.int64) for i in ids]), np.concatenate(
        [np.asarray(v, float) for v in vals])


def train(data: pd.DataFrame, n_features: int, counterfactual: float = COUNTERFACTUAL, l2: float = L2,
          steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole bounded sample."""
    y = data["y"].to_numpy(float)
    l2 = l2 / len(y)
    r, f, v = _flat(list(data["ids"]), list(data["vals"]))
    paired = np.flatnonzero(data["ids2"].notna().to_numpy())
    pr, pf, pv = _flat([data["ids2"][i] for i in paired], [data["vals2"][i] for i in paired])
    base = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    w, b = np.zeros(n_features), math.log(base / (1 - base))
    m, s = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = np.bincount(r, v * w[f], len(y)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        e = (p - y) / len(y)
        g = np.bincount(f, v * e[r], n_features) + 2 * l2 * w
        if len(paired):
            d = np.zeros(len(y))
            d[paired] = z[paired] - (np.bincount(pr, pv * w[pf], len(paired)) + b)
            k = 2 * counterfactual / len(paired)
            g += k * (np.bincount(f, v * d[r], n_features) - np.bincount(pf, pv * d[paired][pr], n_features))
        grad = np.r_[g, e.sum()]
        m = 0.9 * m + 0.1 * grad
        s = 0.99 * s + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES,
        counterfactual: float = COUNTERFACTUAL) -> Model:
    sample = cut_lineage(training_sample(docs, labels, doc_id, text, label, max_train))
    n_docs, n_toxic = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    n_toxic = n_toxic or 0
    if not 0 < n_toxic < n_docs:
        share = min(max(n_toxic / n_docs if n_docs else 0.0, 1e-6), 1 - 1e-6)
        return Model({}, np.zeros(0), math.log(share / (1 - share)))
    names = select_features(feature_counts(sample), n_docs, n_toxic, max_features)
    features = {f: i for i, f in enumerate(names)}
    return Model(features, *train(vectors(sample, features), len(names), counterfactual))


def scored(df: DataFrame, text: str, model: Model) -> DataFrame:
    """df with the column ``__score``. Works on batches of whole rows; only
    the text is read, and of a batch one text at a time is a Python string."""
    weights, bias, features = model.weights.tolist(), model.bias, model.features

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}
        for batch in texts:
            out = []
            for t in batch:
                words, got = counts_of(t.as_py() or ""), Counter()
                for w, n in words.items():
                    ids = known.get(w)
                    if ids is None:
                        if len(known) > KNOWN:
                            known.clear()
                        ids = known[w] = [i for i in map(features.get, features_of(w)) if i is not None]
                    for i in ids:
                        got[i] += n
                z = bias + sum(weights[i] * math.log1p(n) for i, n in sorted(got.items()))
                out.append(1 / (1 + math.exp(-min(max(z, -40.0), 40.0))))
            yield pa.array(out, pa.float64())

    return df.withColumn("__score", F.arrow_udf(score, "double")(col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, doc_id, text, label)
    two = docs.select(col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), col(text).alias("text"))
    return scored(two, "text", model).select(
        "doc_id", "held_out", F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = fit(docs, labels, doc_id, text, label)
    rows = docs.select(whole_row(docs), col(text).alias("__text"))
    return unpack(scored(rows, "__text", model).filter(F.col("__score") < threshold), docs.columns)
