"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
#: Most labelled documents that the target model and the cut are fitted on (the raw model always covers every document).
LABELLED = 20_000
#: Words that a worker remembers the hash of.
CACHE = 500_000
#: By default a document weighs as if it had at most this many n-grams of its mean log ratio (temper=None: as many as it has, which is the plain ratio of the two models). Untempered, a ratio of nearly 1 on each of a long text's thousands of n-grams (a language that the labels
#: have a little too rarely) would outweigh any junk.
TEMPER = 256
#: Share of the good documents of the unseen labelled sample that the cut leaves above it.
KEEP = 0.995
SEED = 17


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def ngrams(text: bytes, seen: _Hashes) -> np.ndarray:
    """Buckets of the words and word pairs, as written: case and symbols tell junk from prose."""
    words = text.split()
    h = np.fromiter((seen[w] for w in words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((np.concatenate([h, pairs]) >> np.uint64(24)) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(target_ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, raw, target = _Hashes(), np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for doc_id, text in zip(common.column(batch, "doc_id").to_pylist(), common.raw(batch, "text")):
            one = np.bincount(ngrams(text, seen), minlength=BUCKETS) if len(text) > 4 * BUCKETS else None
            if one is None:
                np.add.at(raw, grams := ngrams(text, seen), 1)
                if doc_id in target_ids:
                    np.add.at(target, grams, 1)
            else:
                raw += one
                if doc_id in target_ids:
                    target += one
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def labelled(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most about `most` rows of labels (a hash of the id decides, so reruns agree): (doc_id, label) with neither null, one for each id; ids whose labels disagree are left out."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    n = rows.count()
    share = min(1.0, most / max(n, 1))
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))


def weights(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> tuple[np.ndarray, dict[int, int]]:
    """(log p_target - log p_raw of each bucket, the part of the labelled sample that the model has not seen). Counts are summed by worker before they are shuffled; BUCKETS rows reach the driver."""
    spark = docs.sparkSession
    sample = {r[0]: r[1] for r in labelled(labels, id_col, label_col, most).collect()}  # bounded by `most`
    # A quarter of the sample is kept from the model, so that the cut is fitted on documents that it hasn't seen.
    fitted = {i for i in sample if xxhash.xxh64_intdigest(str(i), 3) % 4}
    good = spark.sparkContext.broadcast(frozenset(i for i in fitted if sample[i] == 1))
    sample = {i: y for i, y in sample.items() if i not in fitted}
    rows = common.named(docs, id_col, text_col).mapInArrow(lambda it: _counts(good.value, it), "bucket long, raw long, target long")
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)  # add-one smoothing
    for bucket, r, t in rows.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[bucket] += r
        target[bucket] += t
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS), sample
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), sample


def gumbel(doc_id: int | None, text: bytes, seed: int) -> float:
    u = (xxhash.xxh64_intdigest(f"{doc_id}:{xxhash.xxh64_hexdigest(text) if doc_id is None else ''}".encode(), seed) >> 11) + 0.5
    return -math.log(-math.log(u / (1 << 53)))


def scorer(log_ratio: np.ndarray, seed: int, temper: int | None = TEMPER):
    """(log ratio of the two models, log weight, log weight plus noise) of a document."""
    seen = _Hashes()

    def one(doc_id: int | None, text: bytes) -> tuple[float, float, float]:
        grams = ngrams(text, seen)
        plain = float(log_ratio[grams].sum()) if len(grams) else 0.0
        weight = round(plain * min(1.0, temper / len(grams)) if temper and len(grams) else plain, 9)
        return round(plain, 9), weight, weight + gumbel(doc_id, text, seed)

    return one


def scores(docs: DataFrame, log_ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, temper: int | None = TEMPER) -> DataFrame:
    """(doc_id, log_ratio, log_weight, perturbed): the log importance ratio, the (tempered) log weight, and that with Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(shared.value, seed, temper)
        for batch in batches:
            ids = common.column(batch, "doc_id")
            got = [one(i, t) for i, t in zip(ids.to_pylist(), common.raw(batch, "text"))]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i] for x in got], pa.float64()) for i in range(3))], names=["doc_id", "log_ratio", "log_weight", "perturbed"])

    return common.named(docs, id_col, text_col).mapInArrow(each, "doc_id long, log_ratio double, log_weight double, perturbed double")


def best_cut(scored: DataFrame, sample: dict[int, int]) -> float:
    """The largest weight that at least KEEP of the labelled good documents reach. Without any: below all weights."""
    ids = scored.sparkSession.createDataFrame([(i,) for i, y in sample.items() if y == 1] or [(None,)], "doc_id long")
    x = sorted(r[0] for r in scored.join(F.broadcast(ids), "doc_id").select("log_weight").collect())  # bounded like the sample
    return x[math.floor(len(x) * (1 - KEEP))] if x else -math.inf


def kth_largest(scored: DataFrame, k: int, column: str = "perturbed", few: int = 10_000) -> float:
    """The k-th largest value, exactly, without a sort: ranges are counted in 1,000 bins and the one that holds it is refined until at most `few` values (or one value) are left."""
    lo, hi = scored.agg(F.min(column), F.max(column)).first()
    while True:
        inside = scored.filter(F.col(column).between(lo, hi))
        if hi <= lo:
            return lo
        width = (hi - lo) / 1000
        bins = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(999)).alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(bins, reverse=True):
            n, least, most = bins[b]
            if k <= n:
                break
            k -= n
        lo, hi = least, most
        if n <= few:
            values = sorted((r[0] for r in scored.filter(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)
            return values[k - 1]


def resampled(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = SEED, most: int = LABELLED, temper: int | None = TEMPER) -> tuple[DataFrame, float, np.ndarray]:
    """((doc_id, log_ratio, log_weight, perturbed, selected), the least selected perturbed weight, log ratios): importance resampling without replacement.

    Target model: n-grams of the documents labelled 1; raw model: n-grams of all documents. The k documents of largest log weight plus Gumbel noise are a draw without
    replacement in proportion to the weights. k defaults to the number of documents whose weight reaches best_cut(), so it follows the data.
    Equal perturbed weights at the border are all selected (repeated rows share their noise). Null and empty texts have weight 0. Labels of unknown documents, null labels and labels of an id that disagree are ignored;
    without labels every weight is 0. An empty table gives an empty result; k above the number of rows selects all.
    """
    log_ratio, sample = weights(docs, labels, label_col, id_col, text_col, most)
    scored = common.checkpoint(scores(docs, log_ratio, id_col, text_col, seed, temper))
    n = scored.count()
    if k is None:
        cut = best_cut(scored, sample)
        k = scored.filter(F.col("log_weight") >= cut).count() if cut > -math.inf else n
    least = -math.inf if k >= n else math.inf if k <= 0 else kth_largest(scored, k)
    return scored.withColumn("selected", F.col("perturbed") >= F.lit(least)), least, log_ratio


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The selected rows of docs, with their columns: scored again in place rather than joined, so texts aren't shuffled."""
    _, least, log_ratio = resampled(docs, labels, id_col=id_col, text_col=text_col, **options)
    shared, seed = docs.sparkSession.sparkContext.broadcast(log_ratio), options.get("seed", SEED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(shared.value, seed, options.get("temper", TEMPER))
        for batch in batches:
            ids = common.column(batch, id_col).cast(pa.int64()).to_pylist()
            yield batch.filter(pa.array([one(i, t)[2] >= least for i, t in zip(ids, common.raw(batch, text_col))], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
