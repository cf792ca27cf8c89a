"""Toxicity: a logistic model with a counterfactual penalty on swapped identity terms."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled documents that are read for fitting; most features that the model keeps.
LABELLED, FEATURES = 20_000, 4096
#: Strength of the L2 and of the counterfactual penalty; word prefixes that are features, in characters.
RIDGE, COUNTERFACTUAL, PREFIXES = 1e-4, 1.0, (4, 5, 6, 7)
#: Groups of identity terms; within one, each term may stand for any other.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"), ("deaf", "blind", "disabled"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def features_of(word: str) -> list[str]:
    return [word] + [word[:n] + "~" for n in PREFIXES if len(word) > n]


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}


def swaps(text: str, identity=IDENTITY) -> list[tuple[set[str], set[str]]]:
    """(features lost, features gained) for each labelled sentence with an identity term and each other term of its group."""
    group = {t: g for g in identity for t in g}
    out = []
    for sentence in SENTENCE.split(text.lower()):
        words = WORD.findall(sentence)
        for term in {w for w in words if w in group}:
            before = {f for w in set(words) for f in features_of(w)}
            for other in group[term]:
                if other != term:
                    after = {f for w in {other if w == term else w for w in words} for f in features_of(w)}
                    out.append((before - after, after - before))
    return out


def fit(rows: list[tuple[np.ndarray, int]], n: int, pairs: list[tuple[np.ndarray, np.ndarray, int]], ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + ridge |w|^2 + counterfactual * mean (w . (x - swapped x))^2, by Adam on the whole sample (deterministic). pairs: (features lost, features gained, how often)."""
    lengths = np.array([len(x) for x, _ in rows])
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *(x for x, _ in rows)])
    at = np.repeat(np.arange(len(rows)), lengths)
    y = np.array([t for _, t in rows], dtype=float)
    lost = np.concatenate([np.zeros(0, dtype=np.int64), *(a for a, _, _ in pairs)])
    lost_at = np.repeat(np.arange(len(pairs)), [len(a) for a, _, _ in pairs])
    gained = np.concatenate([np.zeros(0, dtype=np.int64), *(b for _, b, _ in pairs)])
    gained_at = np.repeat(np.arange(len(pairs)), [len(b) for _, b, _ in pairs])
    often = np.array([k for _, _, k in pairs], dtype=float)
    w, b = np.zeros(n), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, weights=w[flat], minlength=len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        r = (p - y) / len(rows)
        g = np.bincount(flat, weights=r[at], minlength=n) + 2 * ridge * w
        if pairs:
            d = np.bincount(lost_at, weights=w[lost], minlength=len(pairs)) - np.bincount(gained_at, weights=w[gained], minlength=len(pairs))
            e = 2 * counterfactual * d * often / often.sum()
            g += np.bincount(lost, weights=e[lost_at], minlength=n) - np.bincount(gained, weights=e[gained_at], minlength=n)
        full = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _bits(features: set[str], index: dict[str, int]) -> np.ndarray:
    return np.array(sorted(index[f] for f in features if f in index), dtype=np.int64)


class Model:
    def __init__(self, index: dict[str, int], w: np.ndarray, b: float):
        self.index, self.w, self.b = index, w, b
        self.words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        on: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            got = self.words.get(word)
            if got is None:
                if len(self.words) > 300_000:
                    self.words.clear()
                got = self.words[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
            on.update(got)
        z = self.b + math.fsum(self.w[i] for i in on)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def __getstate__(self):
        return {"index": self.index, "w": self.w, "b": self.b, "words": {}}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, identity=IDENTITY, counterfactual: float = COUNTERFACTUAL, learn_from: Column | None = None) -> Model:
    """A model fitted on at most about `most` labelled documents (chosen by a hash of the id) for which learn_from holds (default: all).

    The features are words and word prefixes, present or not. Executors count in how many documents of either label each occurs; the FEATURES ones of largest z-score of the log odds, and all those of the identity
    terms, stay. Only they, and the swaps' feature differences with their counts, reach the driver. Null labels, labels of unknown documents, and those of documents whose labels disagree are ignored; each row of a
    repeated id counts. Without labels of both kinds the model is an intercept.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    rows = (rows.filter(learn_from) if learn_from is not None else rows).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    share = min(1.0, most / max(rows.count(), 1))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)).withColumn("label", (F.col("label") == 1).cast("int"))
    # at most about `most` ids and labels are broadcast, so the corpus is filtered where it is read
    sample = common.written(common.named(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), "toxicity")
    found = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n = [found.get(0, 0), found.get(1, 0)]
    terms = {f for g in identity for t in g for f in features_of(t)}
    if not min(n):
        return Model({}, np.zeros(0), math.log((n[1] + 0.01) / (n[0] + 0.01)) if any(n) else 0.0)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(common.strings(batch, "text"), common.column(batch, "label").to_pylist()):
                for f in features(text):
                    counts.setdefault(f, [0, 0])[label] += 1
            if len(counts) > 400_000:
                yield _pairs(counts)
                counts = {}
        yield _pairs(counts)

    def _pairs(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "n0", "n1"])

    odds = F.log((F.col("n1") + 0.5) / (n[1] - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (n[0] - F.col("n0") + 0.5))
    z = odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    counted = sample.mapInArrow(occurrences, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 >= 3").withColumn("z", z)
    best = [r[0] for r in counted.orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).collect()]
    index = {f: i for i, f in enumerate(sorted(set(best) | terms))}
    lists = spark.sparkContext.broadcast((index, identity))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, groups = lists.value
        for batch in batches:
            texts = common.strings(batch, "text")
            made = [_bits(features(t), where).tolist() for t in texts]
            pairs = [[[_bits(a, where).tolist(), _bits(b, where).tolist()] for a, b in swaps(t, groups)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [common.column(batch, "doc_id"), common.column(batch, "label"), pa.array(made, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.list_(pa.int32()))))], names=["doc_id", "label", "bits", "pairs"]
            )

    encoded = common.written(sample.mapInArrow(encode, "doc_id long, label int, bits array<int>, pairs array<array<array<int>>>"), "toxicity-bits")
    rows_ = [(np.array(r[2], dtype=np.int64), r[1]) for r in sorted(encoded.select("doc_id", "label", "bits").toLocalIterator(), key=lambda r: (r[0], r[2]))]
    swapped = encoded.select(F.explode("pairs").alias("p")).groupBy("p").count()  # equal swaps are one row: as many as terms, their others and what a sentence shares with them
    pairs_ = [(np.array(p[0], dtype=np.int64), np.array(p[1], dtype=np.int64), k) for p, k in sorted((tuple(map(tuple, r[0])), r[1]) for r in swapped.collect())]
    w, b = fit(rows_, len(index), pairs_, counterfactual=counterfactual)
    return Model(index, w, b)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): a row for each row of docs; null and empty texts have no feature and take the score of the intercept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array([shared.value.score(t) for t in common.strings(batch, "text")], pa.float64())], names=["doc_id", "score"])

    return common.named(docs, id_col, text_col).mapInArrow(each, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; only rows that aren't held out are learned from."""
    model = train(docs, labels, learn_from=~held_out())
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
