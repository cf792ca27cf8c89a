"""SimHash near-duplicates: pivot distance tables inside lossless bands, exact midpoints for dense bands, components; and near copies by 5-word shingles, verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common
from .components import components

#: Reference fingerprints; their distances are bytes packed in two longs.
PIVOTS = tuple(xxhash.xxh64_intdigest(f"pivot {i}".encode(), 0) for i in range(16))
RADIUS = 2
BLOCKS = 4
#: Pivots whose distances cut a band into cells; cells with more fingerprints than DENSE aren't joined pair by pair.
CELL_PIVOTS, DENSE = 2, 64


def fingerprint(text: bytes) -> int:
    """64 bits, unsigned: a bit is 1 if set in over half of the XXH64 (seed 42) of the 3-word shingles of the text in lower case (A-Z), repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - 2)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 16384):
        ones += np.unpackbits(h[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in common.raw(batch, "text")], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    return common.named(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: Column) -> tuple[Column, Column]:
    """Hamming distances to the 16 pivots, a byte each."""
    far = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in PIVOTS]
    pack = lambda xs: sum((F.shiftleft(x, 8 * i) for i, x in enumerate(xs[1:], 1)), xs[0])
    return pack(far[:8]), pack(far[8:])


def pivots_allow(a: list[Column], b: list[Column], radius: int = RADIUS) -> Column:
    """By the triangle inequality, fingerprints within radius differ by at most radius in each pivot distance."""
    ok = F.lit(True)
    for x, y in zip(a, b):
        for i in range(8):
            ok = ok & (F.abs(F.shiftright(x, 8 * i).bitwiseAND(255) - F.shiftright(y, 8 * i).bitwiseAND(255)) <= radius)
    return ok


def bands(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(band, key, fp): one row for each choice of blocks - radius of the blocks. Two fingerprints within radius agree on at least one choice, as radius bits touch at most radius blocks."""
    width = 64 // blocks
    masks = [_signed(sum(((1 << width) - 1) << (width * i) for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"), F.lit(~m).alias("free")) for i, m in enumerate(masks)])
    return prints.select("fp", F.explode(keys).alias("k")).select("k.band", "k.key", "k.free", "fp")


def cells(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows with the pivot table (p, q), once for each cell c of the first CELL_PIVOTS pivot distances in which the fingerprint is looked for; own marks the one that it lies in.

    A cell is 2 radius + 1 distances wide, so what lies within radius of a distance is in its cell or in one other: of two fingerprints within radius, each is looked for in the cell of the other.
    """
    width = 2 * radius + 1
    p, q = pivot_table(F.col("fp"))
    out = rows.withColumns({"p": p, "q": q, "c": F.lit(0), "own": F.lit(True)})
    for i in range(CELL_PIVOTS):
        d = F.shiftright("p", 8 * i).bitwiseAND(255) + radius
        here = F.floor(d / width).cast("int")
        around = F.explode(F.array_distinct(F.array(*[F.floor((d + x) / width).cast("int") for x in (-radius, 0, radius)])))
        out = out.withColumn("here", here).withColumn("near", around).withColumns({"c": F.col("c") * 64 + F.col("near"), "own": F.col("own") & (F.col("near") == F.col("here"))}).drop("here", "near")
    return out


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all pairs within 2 bits.

    Candidates agree on a lossless band and meet in a cell of the pivot table (see bands() and cells()). In cells of at most `dense` fingerprints, a pair survives if no pivot distance differs by more than 2, and
    then is verified: at most dense**2 pairs a cell. In fuller ones that would be quadratic: there, each fingerprint is tied to itself and to the 1-bit changes of its free bits; two fingerprints of a band
    lie within 2 bits exactly if they share such a midpoint, and a midpoint has at most 65 fingerprints. This is exact and linear, so no cap is needed.
    """
    banded, at = common.checkpoint(bands(prints)), ["band", "key", "c"]
    shared = banded.groupBy("band", "key").count().filter("count > 1").select("band", "key")  # most fingerprints have their bands alone, and need no cells
    rows = common.checkpoint(cells(banded.join(shared, ["band", "key"], "left_semi")).select("band", "key", "free", "fp", "p", "q", "c", "own"))
    counts = common.checkpoint(rows.groupBy(*at).agg(F.count("*").alias("n"), F.max("own").alias("some")).filter("n > 1 AND some"))
    if counts.isEmpty():
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    few = common.checkpoint(rows.join(counts.filter(F.col("n") <= dense).select(*at), at, "left_semi"))
    x, y = few.filter("own").alias("x"), few.alias("y")
    survive = pivots_allow([F.col("x.p"), F.col("x.q")], [F.col("y.p"), F.col("y.q")])
    pairs = (
        x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.c") == F.col("y.c")) & (F.col("x.fp") != F.col("y.fp")) & survive)
        .filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
        .select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))
    )
    many = counts.filter(F.col("n") > dense)
    if many.isEmpty():
        return pairs.distinct()
    flips = [F.when(F.col("free").bitwiseAND(F.lit(_signed(1 << i))) != 0, F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)))) for i in range(64)]
    near = F.filter(F.array(F.col("fp"), *flips), lambda v: v.isNotNull())
    # A hot cell is spread over tasks before its rows multiply: the join streams `rows`, and AQE splits a skewed partition of it.
    spread = rows.join(many.select(*at), at, "left_semi").select("fp", F.explode(near).alias("mid")).distinct()
    centre = spread.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = spread.join(centre.drop("n"), "mid").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    component_id is the smallest doc_id reachable over links of at most 2 differing bits. Null and empty texts have fingerprint 0 and link like any other. Rows without doc_id keep
    a null doc_id and take the component's smallest id (null if it has none). Repeated rows and ties give equal rows. An empty table gives an empty result.
    """
    own = common.written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = common.checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    edges = common.checkpoint(links(distinct.select("fp"), dense))
    labels = components(edges)
    root = F.coalesce(F.col("root"), F.col("fp"))
    placed = common.checkpoint(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", root.alias("root")))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(firsts, "root").select("fp", "component_id", "n")
    total = own.count()
    return common.hot_join(own, named, ["fp"], "n", total).select("doc_id", "fp", "component_id")


#: Words in a shingle, and least Jaccard similarity of texts that similar() links.
WORDS, SIMILARITY = 5, 0.8
#: A hash that more texts than HOT have in their prefixes isn't joined pair by pair at first; texts and most hashes of the sample that says which hashes come last in the order.
HOT, SAMPLE, LAST = 64, 20_000, 100_000


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles of the text in lower case (A-Z), sorted; of a text with fewer words, of its whole sequence; of one without words, none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    parts = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype="<u8"))


def prefix(n: int) -> int:
    """Of two sets of similarity SIMILARITY or more, one with n hashes has at least n - prefix(n) + 1 in common with the other; so their first prefix(n) hashes in any common order meet."""
    return n - math.ceil(SIMILARITY * n - 1e-6) + 1 if n else 0


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [h[: 2 * prefix(len(h))] for h in map(shingle_hashes, common.raw(batch, "text"))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype="<u8"), *parts]).view("<i8"))], names=["g"])


def _often(keyed: DataFrame, hot: int) -> np.ndarray:
    """Frequent hashes, sorted, at most LAST: by a sample of about SAMPLE rows. They come last in the order of the hashes. What is in here decides how many candidates there are, never which links are found."""
    total = max(1, keyed.count())
    share = min(1.0, SAMPLE / total)
    some = keyed.filter(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    counts = some.mapInArrow(_sampled, "g long").groupBy("g").count().filter(F.col("count") > max(4, hot * share))
    return np.sort(np.array([r["g"] for r in counts.orderBy(F.desc("count"), "g").limit(LAST).collect()], dtype="<i8").view("<u8"))


def _sketches(often: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_hashes(t) for t in common.raw(batch, "text")]
            same = [_signed(xxhash.xxh3_64_intdigest(h.tobytes())) for h in own]
            late = [np.isin(h, often, assume_unique=True) for h in own]
            first = [np.concatenate([h[~x], h[x]])[: prefix(len(h))].view("<i8") for h, x in zip(own, late)]
            yield pa.RecordBatch.from_arrays(
                [common.column(batch, "row"), common.column(batch, "doc_id"), pa.array(same, pa.int64()), pa.array([len(h) for h in own], pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=["row", "doc_id", "same", "n", "first"]
            )

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        close = []
        for x, y in zip(common.raw(batch, "x"), common.raw(batch, "y")):
            p, q = shingle_hashes(x), shingle_hashes(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            close.append(both >= SIMILARITY * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))


def _near(m: Column, n: Column) -> Column:
    return F.least(m, n) >= SIMILARITY * F.greatest(m, n) - 1e-6


def _met(x: DataFrame, y: DataFrame, unlike: bool) -> DataFrame:
    """(a, b) that can be similar, of rows (g, same, n, rest[, root]) that share hashes g; rest: the hashes of a text's prefix that aren't looked at here. unlike: only of different roots.

    Whichever prefix ends first in the order, its hashes that aren't in common aren't in the other text at all; that bounds what the texts can have in common. The bound holds whatever the hashes of `rest` do.
    """
    x, y = x.alias("x"), y.alias("y")
    on = (F.col("x.g") == F.col("y.g")) & (F.col("x.same") < F.col("y.same")) & _near(F.col("x.n"), F.col("y.n"))
    both = x.join(y, on & (F.col("x.root") != F.col("y.root")) if unlike else on)
    common_ = both.groupBy(F.col("x.same").alias("a"), F.col("y.same").alias("b")).agg(F.count("*").alias("c"), *[F.first(f"{t}.{v}").alias(f"{t}{v}") for t in "xy" for v in ("n", "rest")])
    least = F.ceil((F.col("xn") + F.col("yn")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    spare = lambda n: F.ceil(F.col(n) * SIMILARITY - 1e-6) - 1  # noqa: E731  # n less the length of its prefix
    return common_.filter(F.col("c") + F.least("xrest", "yrest") >= least - F.greatest(spare("xn"), spare("yn"))).select("a", "b")


def _links(pairs: DataFrame, texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of pairs whose texts are similar, counted exactly."""
    pairs = common.checkpoint(pairs.distinct())
    needed = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct(), "same", "left_semi").select("same", "row")
    needed = common.checkpoint(needed)
    found = common.written(common.only(keyed.select("row", "text"), needed, "row").join(needed, "row").select("same", "text"), "candidates")
    out = common.checkpoint(
        pairs.join(found.select(F.col("same").alias("a"), F.col("text").alias("x")), "a").join(found.select(F.col("same").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")
    )
    common.removed(found)
    common.swept(out.sparkSession)
    return out


def similar(keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, doc_id, root): root is equal for texts that are linked, directly or by others. keyed: (row, doc_id, text), row unique.

    Texts with equal sets of 5-word shingles are one. Others are linked if the Jaccard similarity of their sets is 0.8 or more, counted exactly. Candidates share a hash of their prefixes, see prefix(), and as many
    as _met() asks for, which loses no pair. The order of the hashes is by value, frequent ones last, so that shared passages find no candidates unless a text is hardly anything else. Hashes that more than `hot`
    texts still have (large groups of near copies) first link the texts to two centres each; then all pairs with such a hash that these links don't join yet are looked at. So components are those of all pairs;
    the cost of a hash is quadratic only in texts that have it and aren't near to each other. Texts without words are all equal.
    """
    often = _often(keyed, hot)
    common.swept(keyed.sparkSession)
    sketches = common.written(keyed.mapInArrow(_sketches(often), "row long, doc_id long, same long, n int, first array<long>"), "sketches")
    own = common.written(sketches.select("row", "doc_id", "same"), "own")
    texts = common.written(own.groupBy("same").agg(F.min("row").alias("row"), F.count("*").alias("rows")), "texts")
    marks = common.only(sketches, texts, "row").select("same", "n", F.explode("first").alias("g"))
    shared = common.written(marks.withColumn("m", F.count("*").over(W.partitionBy("g"))).filter("m > 1"), "shared")
    common.removed(sketches)
    common.swept(own.sparkSession)
    parts = shared.groupBy("same").agg(F.count_if(F.col("m") <= hot).alias("few"), F.count_if(F.col("m") > hot).alias("many"))
    rows = common.written(shared.join(parts, "same"), "prefixes")
    common.removed(shared)
    few = rows.filter(F.col("m") <= hot).select("g", "same", "n", F.col("many").alias("rest"))
    pairs = _met(few, few, False)
    many = rows.filter(F.col("m") > hot).select("g", "same", "n", F.col("few").alias("rest"))
    total = many.count()
    for by in (["g", "n"], ["g"]) if total else ():
        centre = many.groupBy(*by).agg(F.min(F.struct(F.xxhash64("same").alias("order"), "same", "n")).alias("c"), F.count("*").alias("m"))
        star = common.hot_join(many.select("same", F.col("n").alias("size"), *by), centre, by, "m", total)
        pairs = pairs.unionByName(star.filter((F.col("same") != F.col("c.same")) & _near(F.col("size"), F.col("c.n"))).select(F.least("same", "c.same").alias("a"), F.greatest("same", "c.same").alias("b")))
    links = _links(pairs, texts, keyed)
    labels = components(links).select(F.col("node").alias("same"), F.col("root"))
    if total:
        placed = common.checkpoint(many.join(labels, "same", "left").withColumn("root", F.coalesce("root", "same")))
        left = placed.join(placed.groupBy("g").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select("g"), "g", "left_semi")
        more = common.checkpoint(_met(left, left, True))
        if not more.isEmpty():
            labels = components(links.unionByName(_links(more, texts, keyed))).select(F.col("node").alias("same"), F.col("root"))
    named = texts.select("same", "rows").join(labels, "same", "left").select("same", "rows", F.coalesce("root", "same").alias("root"))
    return common.hot_join(own.select("row", "doc_id", "same"), named, ["same"], "rows", own.count()).select("row", "doc_id", "root")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs without near duplicates, with its columns: of each group of similar() texts, one row: that of the smallest doc_id (null ids last), of several the first in the input.

    A row is known by its own number, not by its id: rows of equal or null ids with texts of their own all stay. Null, empty and white texts are one group. The rows are written to the shared folder once, with their numbers.
    """
    keyed = common.written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered", "zstd")
    found = similar(common.named(keyed, id_col, text_col, row="__row"), hot)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("__row"))
    return common.only(keyed, best, "__row").drop("__row")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
