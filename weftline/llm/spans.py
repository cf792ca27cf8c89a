"""Substring dedup over sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Every run of RUN sentences is hashed; a longer run repeats exactly if each RUN sentences in it do, so these cover the runs of every length.
RUN = 2
#: A repeated range is removed if it has at least WORDS words or is the whole text. That is decided of the merged range after the join: single shared headings stay.
WORDS = 20
#: A sentence of more than LONG words is cut after words whose hash is divisible by CUT: where it begins doesn't matter, so a passage that begins and ends within sentences of its neighbours aligns as well.
LONG, CUT = 12, 6
END = re.compile(r"[.!?]+\s+|\n+")
WORD = re.compile(r"\S+")
#: Bits of the filter over repeated hashes: so many for each, MOST in all (16 MB).
BITS, MOST = 8, 1 << 27


def sentences(text: str) -> list[tuple[int, int]]:
    """Code-point ranges of the sentences: each ends after . ! ? and white space, or at a newline; those of more than LONG words are cut by content."""
    out, at = [], 0
    for end in [m.end() for m in END.finditer(text)] + [len(text)]:
        piece = text[at:end]
        if len(piece) > 2 * LONG and len(piece.split(None, LONG)) > LONG:
            first = None
            for m in WORD.finditer(piece):
                first = m.start() if first is None else first
                if xxhash.xxh32_intdigest(m.group()) % CUT == 0:
                    out.append((at + first, at + m.end()))
                    first = None
            if first is not None:
                out.append((at + first, at + len(piece.rstrip())))
        elif piece.strip():
            out.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())))
        at = end
    return out


DOCS = "row long, doc_id long, text_hash long, s array<long>, gap array<int>, size array<int>, words array<int>"
SPANS = "k1 long, k2 long, row long, doc_id long, text_hash long, at int, start int, stop int, first_word int, last_word int"


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: of each sentence, the 64-bit hash of its words, the code points before it since the last one, its code points and its words."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for text in common.strings(batch, "text"):
            s, gap, size, words, last = [], [], [], [], 0
            for a, b in sentences(text):
                own = text[a:b].split()
                s.append(xxhash.xxh3_64_intdigest(" ".join(own).encode("utf-8", "surrogatepass")))
                gap.append(a - last)
                size.append(b - a)
                words.append(len(own))
                last = b
            for column, value in zip(out, (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")), np.array(s, dtype="<u8").view("<i8"), gap, size, words)):
                column.append(value)
        lists = [pa.array(x, pa.list_(t)) for x, t in zip(out[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([common.column(batch, "row"), common.column(batch, "doc_id"), pa.array(np.array(out[0], dtype="<u8").view("<i8")), *lists], names=[c.split(" ")[0] for c in DOCS.split(", ")])


def ranges(spans: list[dict], n_sentences: int, words: int = WORDS) -> tuple[int, list[dict]]:
    """(sentences removed, merged ranges) from the repeated runs of RUN sentences of one document: runs that overlap form a range, which goes if it is large enough or the whole text."""
    found: list[dict] = []
    for s in sorted(spans, key=lambda s: s["at"]):
        if found and s["at"] <= found[-1]["to"]:
            found[-1] |= {"to": s["at"] + RUN - 1, "stop": s["stop"], "last_word": s["last_word"]}
        else:
            found.append(s | {"from": s["at"], "to": s["at"] + RUN - 1})
    n, out, end = 0, [], None
    for r in found:
        size = r["to"] - r["from"] + 1
        if r["last_word"] - r["first_word"] >= words or size == n_sentences:
            n += size
            if out and end == r["from"] - 1:
                out[-1]["stop"] = r["stop"]
            else:
                out.append({"start": r["start"], "stop": r["stop"]})
            end = r["to"]
    return n, out


def _merged(words: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = common.column(batch, "n_sentences")
            made = [ranges(spans or [], k, words) for spans, k in zip(common.column(batch, "spans").to_pylist(), n.to_pylist())]
            yield pa.RecordBatch.from_arrays([common.column(batch, "row"), common.column(batch, "doc_id"), n, pa.array([k for k, _ in made], pa.int32()), pa.array([r for _, r in made], type=kind)], names=["row", "doc_id", "n_sentences", "n_removed", "removed"])

    return each


def _candidates(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The spans whose mixed hash may be one of keys (h): all that are, and few others, so that only they are shuffled. A full filter passes more rows, never fewer."""
    bits = min(MOST, max(1 << 10, 1 << (BITS * keys.count()).bit_length()))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int")
    parts = keys.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("set")).toArrow()
    filled = np.zeros(bits // 64, dtype=np.uint64)
    filled[parts["word"].to_numpy()] = parts["set"].to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(filled)
    mask, six = np.uint64(bits // 64 - 1), np.uint64(6)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in SPANS.split(", ")]
            own = [common.column(batch, c).to_pylist() for c in ("row", "doc_id", "text_hash")]
            lists = [common.column(batch, c) for c in ("s", "gap", "size", "words")]
            for i, (row, doc_id, text_hash) in enumerate(zip(*own)):
                s, gap, size, words = (c[i].values.to_numpy(zero_copy_only=False) for c in lists)
                if len(s) < RUN:
                    continue
                u = s.view(np.uint64)
                h = u[:-1] ^ (u[1:] << np.uint64(1) | u[1:] >> np.uint64(63))
                at = np.flatnonzero(shared.value[(h >> six) & mask] >> (h & np.uint64(63)) & np.uint64(1))
                if len(at):
                    stop = np.cumsum(gap.astype(np.int64) + size)
                    last = np.cumsum(words)
                    for column, value in zip(made, (s[at], s[at + 1], [row] * len(at), [doc_id] * len(at), [text_hash] * len(at), at, stop[at] - size[at], stop[at + 1], last[at] - words[at], last[at + 1])):
                        column.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t.endswith("long") else pa.int32()) for c, t in zip(made, SPANS.split(", "))], names=[t.split(" ")[0] for t in SPANS.split(", ")])

    return rows.mapInArrow(each, SPANS)


def _repeated(keyed: DataFrame, floor: int, words: int) -> DataFrame:
    rows = common.written(keyed.select("row", "doc_id", "text").mapInArrow(_document_rows, DOCS), "sentences")
    pairs = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 1).bitwiseOR(F.shiftrightunsigned(b, 63))))
    often = common.checkpoint(rows.filter(F.size("s") >= RUN).select(F.explode(pairs).alias("h")).groupBy("h").count().filter("count > 1").select("h"))
    seen = common.written(_candidates(rows, often), "spans")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "text_hash", "row", "at")
    firsts = common.checkpoint(seen.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = (
        common.hot_join(seen, firsts, ["k1", "k2"], "n", seen.count(), floor=floor)
        .filter((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
        .select("row", F.struct("at", "start", "stop", "first_word", "last_word").alias("span"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("n"))
    )
    each = rows.select("row", F.lit(None).cast("struct<at:int,start:int,stop:int,first_word:int,last_word:int>").alias("span"), "doc_id", F.size("s").alias("n"))
    per = later.unionByName(each).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n_sentences"), F.collect_list("span").alias("spans"))
    return per.mapInArrow(_merged(words), "row long, doc_id long, n_sentences int, n_removed int, removed array<struct<start:int,stop:int>>")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: int = common.HOT_ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed): for each row of docs, the merged code-point ranges of the sentences covered by a repeated run of sentences that isn't the first of its kind.

    Every run of RUN consecutive sentences of every text is hashed (two 64-bit hashes of the sentences' words, white space normalised) and joined; a longer run repeats if all of these in it do, so runs of every
    length are found, and what is removed is what all of them cover. Of equal runs, the one with the smallest (doc_id, hash of the text, row, sentence) is first and stays; null ids come last. Ranges of fewer than
    `words` words stay, unless they are the whole text (0: none stays). Each row is a document of its own, whatever its id: of rows of equal id and text, one keeps
    what the others lose. Texts of one sentence, null and empty ones have no run and lose nothing (n_sentences 1 or 0). An empty table gives an empty result.
    First only mixed 64-bit hashes are counted; the spans that may be repeated pass a filter of fixed size and meet in full. A run that many documents share is found by a pre-aggregated minimum and joined by hot_join.
    """
    return _repeated(common.named(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), floor, words).drop("row")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with the removed sentences cut from the text; other columns stay, and no row is dropped. Null texts stay null, empty ones empty; a text that is removed whole becomes empty (or its outer white space).

    The rows are written to the shared folder with a number each, by which they are cut: rows of null or equal ids lose only what repeats in their own text.
    """
    keyed = common.written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = _repeated(common.named(keyed, id_col, text_col, row="__row"), common.HOT_ROWS, words).filter("n_removed > 0").select(F.col("row").alias("__row"), F.col("removed").alias("__cut"))
    kept = list(docs.columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and cut(t, c) for t, c in zip(common.column(batch, text_col).to_pylist(), common.column(batch, "__cut").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else common.column(batch, c) for c in kept], names=kept)

    return keyed.join(found, "__row", "left").mapInArrow(each, docs.schema)


def cut(text: str, ranges: list[dict] | None) -> str:
    out, at = [], 0
    for r in ranges or []:
        out.append(text[at : r["start"]])
        at = r["stop"]
    return "".join([*out, text[at:]])


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, and removed as start:stop, comma-joined."""
    text = F.concat_ws(",", F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["stop"].cast("string"))))
    return result.select("doc_id", "n_sentences", "n_removed", text.alias("removed"))
