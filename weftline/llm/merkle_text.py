"""Document fingerprints: a Merkle tree over paragraphs and sections."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A phrase ends after a word whose hash is divisible by PHRASE, or after LONGEST words; a section after a paragraph whose hash is divisible by SECTION.
PHRASE, SECTION, LONGEST = 4, 8, 15
#: Bytes of text in a range of ids.
RANGE_BYTES = 8_000_000


def _node(kind: bytes, parts: list[bytes]) -> bytes:
    return hashlib.sha256(kind + b"".join(parts)).digest()


class _Ends(dict):
    """Whether a phrase ends after a word."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= 300_000:
            self.clear()
        self[word] = e = xxhash.xxh32_intdigest(word) % PHRASE == 0
        return e


_ends = _Ends()


def leaves(paragraph: str) -> str:
    """A paragraph's phrases, 7 hex digits each: 24 bits of the hash and the number of words. Phrases end where the content says so, so an edit disturbs only those that it touches."""
    out, run = [], []
    for w in paragraph.split():
        run.append(w)
        if _ends[w] or len(run) == LONGEST:
            out.append(f"{xxhash.xxh32_intdigest(' '.join(run)) >> 8:06x}{len(run):x}")
            run = []
    if run:
        out.append(f"{xxhash.xxh32_intdigest(' '.join(run)) >> 8:06x}{len(run):x}")
    return "".join(out)


def tree(text: str) -> tuple[bytes, list[tuple[bytes, list[tuple[bytes, str]]]]]:
    """(root, sections as (hash, paragraphs as (hash, leaves))).

    A paragraph is a line, white space included, so the root tells apart any two texts. A section ends at a blank line or after a paragraph whose hash is divisible by SECTION.
    """
    sections, paragraphs = [], []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        h = hashlib.sha256(b"p" + line.encode("utf-8", "surrogatepass")).digest()
        paragraphs.append((h, leaves(line)))
        if i == len(lines) - 1 or not line.strip() or h[0] % SECTION == 0:
            sections.append((_node(b"s", [p for p, _ in paragraphs]), paragraphs))
            paragraphs = []
    return _node(b"r", [h for h, _ in sections]), sections


def _written(made: tuple) -> str:
    root, sections = made
    return f"{root.hex()}:{'/'.join(h.hex()[:10] + ''.join(f',{p.hex()[:10]}{own}' for p, own in ps) for h, ps in sections)}"


def fingerprint(text: str) -> str:
    """The whole tree: root ":" sections, joined by "/": the first 10 hex digits of the section's hash, then for each paragraph a comma, 10 digits of its hash and its leaves."""
    return _written(tree(text))


def _words(own: str) -> int:
    return sum(int(n, 16) for n in own[6::7])


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the Dice coefficient of two fingerprints, below 1: twice the words of what both have, over the words of both.

    The trees are descended: sections of equal hash count whole, in the others paragraphs of equal hash count whole, and in the rest equal phrases count. Repeats count as often as both have them. Texts without
    words that differ in white space have likeness 0.
    """
    if a == b or a[:64] == b[:64]:
        return 1.0
    rest = [[(s[:10], s[11:]) for s in f[65:].split("/")] for f in (a, b)]
    total = sum(_words(p[10:]) for side in rest for _, ps in side for p in ps.split(","))
    same = 0
    for level in range(2):  # sections, then paragraphs
        left = Counter(h for h, _ in rest[0]) & Counter(h for h, _ in rest[1])
        below = []
        for i, side in enumerate(rest):
            open_, children = Counter(left), []
            for h, inner in side:
                if open_[h] > 0:
                    open_[h] -= 1
                    same += 0 if i else sum(_words(p[10:]) for p in inner.split(",")) if level == 0 else _words(inner)
                elif level == 0:
                    children += [(p[:10], p[10:]) for p in inner.split(",")]
                else:
                    children += [inner[k : k + 7] for k in range(0, len(inner), 7)]
            below.append(children)
        rest = below
    same += sum(int(p[6], 16) * n for p, n in (Counter(rest[0]) & Counter(rest[1])).items())
    return min(2 * same / total, 0.999999) if total else 0.0


def diff(a: str, b: str) -> list[tuple[str, int, int]]:
    """Paragraphs that differ, as (side, start, end) in code points: "a" for those of a that b lacks, "b" for the reverse. Sections of equal hash are passed over whole; only differing branches are descended."""
    (ra, sa), (rb, sb) = tree(a), tree(b)
    if ra == rb:
        return []
    out = []
    for side, text, own, other in (("a", a, sa, sb), ("b", b, sb, sa)):
        same, mine = {h for h, _ in other}, {h for h, _ in own}
        left: dict[bytes, int] = {}
        for h, ps in other:
            for p, _ in ps if h not in mine else ():
                left[p] = left.get(p, 0) + 1
        starts = [0, *accumulate(len(x) + 1 for x in text.split("\n"))]
        i = 0
        for h, ps in own:
            for p, _ in ps:
                if h not in same:
                    if left.get(p):
                        left[p] -= 1
                    else:
                        out.append((side, starts[i], starts[i + 1] - 1))
                i += 1
    return out


def _edited(own: str, following: str) -> str:
    half = len(own) // 2
    return own[: len(own) - half] + following[:half] if half else own


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and order; the rows of a bucket that are guests come last, and only the first counts."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        out: list[list] = [[] for _ in names]
        cols = [common.column(batch, c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")]
        for bucket, guest, doc_id, text in zip(*cols):
            text = text or ""
            if guest and (held is None or held[0] != bucket):
                continue  # a guest after the first
            own = fingerprint(text)
            if held and held[0] == bucket:
                _, h_id, h_text, h_print = held
                edited = _edited(h_text, text)
                e_print = h_print if edited == h_text else fingerprint(edited)
                row = (h_id, len(h_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), h_print, e_print, likeness(h_print, e_print), likeness(h_print, own))
                for column, value in zip(out, row):
                    column.append(value)
            held = None if guest else (bucket, doc_id, text, own)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=names)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document follows in descending doc_id, null ids last, equal ids by a hash of the text; the first follows the last, and a single document follows itself. Null texts count as empty; an empty table gives
    an empty result. The order is made without a global sort in one task: (id, hash) pairs are cut into ranges of about RANGE_BYTES of text (or `buckets` ranges; by approximate quantiles, so two longs a range
    reach the driver), ids of which there are too many are cut by the hash, and each range is a partition, sorted on its own with a copy of the following range's first document. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = common.named(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("order", F.xxhash64("text"))
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    n = buckets or max(spark.sparkContext.defaultParallelism * 2, -(-size // RANGE_BYTES))
    cuts = sorted({int(c) for c in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    edges = spark.sparkContext.broadcast(cuts)

    def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Range 0 has the largest ids, the last one the nulls."""
        for batch in batches:
            made = [len(edges.value) + 1 if x is None else len(edges.value) - bisect_left(edges.value, x + 1) for x in common.column(batch, "doc_id").to_pylist()]
            yield batch.append_column("range", pa.array(made, type=pa.int32()))

    ranged = lambda df: df.mapInArrow(ranges_of, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", range int")
    found = ranged(rows.select("doc_id", "order")).groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()  # a row for each range
    # A range of one id (or of nulls) that is too large is cut into equal parts of the hash's values.
    parts = {r["range"]: max(1, r["n"] * n // count) if r["lo"] == r["hi"] else 1 for r in found}
    first = dict(zip(sorted(parts), accumulate([0, *(parts[r] for r in sorted(parts))])))
    layout = spark.createDataFrame([(r, first[r], parts[r]) for r in parts], "range int, base int, parts int")
    part = F.least(F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * F.col("parts")), F.col("parts") - 1).cast("int")
    placed = ranged(rows).join(F.broadcast(layout), "range").select((F.col("base") + part).alias("bucket"), "doc_id", "order", "text")
    keys = ranged(rows.select("doc_id", "order")).join(F.broadcast(layout), "range").select((F.col("base") + part).alias("bucket"), "doc_id", "order")
    ahead = F.struct(F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")).alias("k"), "order", "doc_id")
    tops = sorted((r[0], r[1]["doc_id"], r[1]["order"]) for r in keys.groupBy("bucket").agg(F.min(ahead)).collect())  # a row for each bucket
    total = tops[-1][0] + 1
    # The first document of each bucket is the guest of the one before it; of equal rows, one.
    host = {b: tops[i - 1][0] for i, (b, *_) in enumerate(tops)}
    wanted = spark.createDataFrame([(host[b], i, o) for b, i, o in tops], "bucket int, top long, at long")
    guests = rows.join(F.broadcast(wanted), rows["doc_id"].eqNullSafe(F.col("top")) & (rows["order"] == F.col("at"))).groupBy("bucket", "doc_id", "order").agg(F.min("text").alias("text"))
    both = placed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    ordered = both.repartitionById(total, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "order", "text")
    return ordered.mapInArrow(_rows, SCHEMA)


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trees as rows: doc_id, level ("root", "section" or "paragraph"), ordinal, parent (ordinal, null for the root), hash. Null texts count as empty; an empty table gives no rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(common.column(batch, "doc_id").to_pylist(), common.strings(batch, "text")):
                root, sections = tree(text)
                out.append((doc_id, "root", 0, None, root.hex()))
                n = 0
                for s, (h, ps) in enumerate(sections):
                    out.append((doc_id, "section", s, 0, h.hex()))
                    for p, _ in ps:
                        out.append((doc_id, "paragraph", n, s, p.hex()))
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(map(list, zip(*out)), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "level", "ordinal", "parent", "hash"])

    return common.named(docs, id_col, text_col).mapInArrow(each, "doc_id long, level string, ordinal int, parent int, hash string")
