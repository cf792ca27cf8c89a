"""Information-theoretic sanitisation of personal data."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "term")
#: A term discloses an entity if the pointwise mutual information of both, as a share of the entity's information content and weighted n / (n + PRIOR) by the number of documents that have both, is at least this.
DISCLOSURE, PRIOR = 0.97, 0.02
#: A word that stands within so many words of a mention is a candidate; rows of candidate or disclosing terms that may be broadcast.
WINDOW, BROADCAST = 8, 200_000
#: Bits of the filter over more terms than that, which lets all of them pass and few others (16 MB).
FILTER_BITS = 1 << 27
#: What a term is generalised to.
CLASSES = ("NUMBER", "NAME", "WORD")

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
DIGITS = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in linear time: at each @, a domain is sought to the right and the local part is the run of its characters to the left."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        if at > last and text[at - 1] in LOCAL and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 13 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else NOT_DIGIT.sub('', value)}"


def class_of(word: str) -> str:
    return "NUMBER" if DIGITS.search(word) else "NAME" if word[:1].isupper() else "WORD"


def terms(text: str) -> set[str]:
    """The words of at least 3 letters, in lower case."""
    return {w.lower() for w in set(WORD.findall(text)) if len(w) > 2}


def _outside(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    busy, ends, out = sorted((a, b) for _, a, b in spans), [], []
    for a, b in busy:  # spans of different kinds may overlap; ends keep the furthest so far
        ends.append(max(b, ends[-1]) if ends else b)
    for s, t in words:
        i = bisect_left(busy, (t, 0)) - 1
        if i < 0 or ends[i] <= s:
            out.append((s, t))
    return out


def candidates(text: str, spans: list[tuple[str, int, int]]) -> set[tuple[str, str]]:
    """(entity, term): the terms within WINDOW words of a mention and outside every mention."""
    words = [m.span() for m in WORD.finditer(text)]
    starts, free = [a for a, _ in words], set(_outside(words, spans))
    out = set()
    for kind, a, b in spans:
        e, lo, hi = entity(kind, text[a:b]), bisect_left(starts, a), bisect_left(starts, b)
        out.update((e, text[s:t].lower()) for s, t in words[max(0, lo - WINDOW) : lo] + words[hi : hi + WINDOW] if t - s > 2 and (s, t) in free)
    return out


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_TERM = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64()), ("ic", pa.float64())]))
_NEAR = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
FOUND = "entities array<string>, near array<struct<entity:string,term:string>>, words array<string>"
TERM = "array<struct<start:int,end:int,disclosure:double,ic:double>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with a base span: its entities, candidate pairs and all its terms."""
    for batch in batches:
        entities, near, words = [], [], []
        for text in common.strings(batch, "text"):
            if spans := base_spans(text):
                entities.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                near.append([{"entity": e, "term": t} for e, t in sorted(candidates(text, spans))])
                words.append(sorted(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(entities, pa.list_(pa.string())), pa.array(near, _NEAR), pa.array(words, pa.list_(pa.string()))], names=["entities", "near", "words"])


class Terms:
    """Which terms to look for: exactly, or by a bit filter that may let others pass."""

    def __init__(self, exact: dict[str, tuple[float, float]] | None, bits: bytes | None = None):
        self.exact, self.bits = exact, bits

    def of(self, words: set[str]) -> set[str]:
        if self.exact is not None:
            return words & self.exact.keys()
        n = len(self.bits) * 8
        return {w for w in words if self.bits[(h := xxhash.xxh64_intdigest(w) % n) >> 3] >> (h & 7) & 1}


def _lookup(rows: DataFrame, most: int, bits: int = FILTER_BITS):
    """Terms of rows (term, and disclosure and ic if there), broadcast: exact if at most `most`, else the filter, whose set bytes are made on the executors. Second: whether it is exact."""
    spark, valued = rows.sparkSession, "ic" in rows.columns
    n = rows.count()
    if n <= most:
        return spark.sparkContext.broadcast(Terms({r[0]: (r[1], r[2]) if valued else (0.0, 0.0) for r in rows.collect()})), True
    bits = min(bits, 1 << (16 * n).bit_length())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [xxhash.xxh64_intdigest(t) % bits for t in common.column(batch, "term").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x >> 3 for x in at], pa.int32()), pa.array([1 << (x & 7) for x in at], pa.int32())], names=["byte", "bit"])

    filled = bytearray(bits // 8)
    for byte, value in zip(*(c.to_pylist() for c in rows.select("term").mapInArrow(places, "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("v")).toArrow().columns)):
        filled[byte] = value
    return spark.sparkContext.broadcast(Terms(None, bytes(filled))), False


def _frequency(chosen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many of the texts each chosen term occurs, summed up by worker; and each class of words, as a space and its name."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in common.strings(batch, "text"):
            words = set(WORD.findall(text))
            counts.update(chosen.value.of({w.lower() for w in words if len(w) > 2}))
            counts.update({" " + class_of(w) for w in words})
        if len(counts) > 300_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])


def pairs(docs: DataFrame, text_col: str = "text", most: int = BROADCAST) -> tuple[DataFrame, dict[str, float]]:
    """((entity, term, n_et, n_e, n_t, disclosure, ic), share of the documents that have a word of each class): every candidate pair with document frequencies over the whole corpus.

    A row of docs is a document: n_e, n_t and n_et are the documents with a mention of the entity, with the term anywhere, and with both. PMI = ln(n_et N / (n_e n_t)), ic = ln(N / n_e); disclosure is
    PMI / ic * n_et / (n_et + PRIOR), 0 for an entity in all documents. Counts are summed by worker before they are shuffled, so a term or an entity that a third of the rows have costs no task more than others.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    found = common.written(texts.mapInArrow(_found, FOUND), "pii")
    documents = docs.count()
    near = common.checkpoint(found.select(F.explode("near").alias("p")).select("p.entity", "p.term").distinct())
    chosen, _ = _lookup(near.select("term").distinct(), most)
    counts = common.checkpoint(texts.mapInArrow(lambda it: _frequency(chosen, it), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t")))
    shares = {r[0][1:]: r[1] / documents for r in counts.filter(F.col("term").startswith(" ")).collect()}
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    both = found.select(F.explode("entities").alias("entity"), "words").select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    ic = F.log(F.lit(float(documents)) / F.col("n_e"))
    pmi = F.log(F.col("n_et") * F.lit(float(documents)) / (F.col("n_e") * F.col("n_t")))
    disclosure = F.when(F.col("n_e") < documents, pmi / ic * F.col("n_et") / (F.col("n_et") + PRIOR)).otherwise(0.0)
    return near.join(both, ["entity", "term"]).join(entities, "entity").join(counts, "term").select("entity", "term", "n_et", "n_e", "n_t", disclosure.alias("disclosure"), ic.alias("ic")), shares


def disclosing(docs: DataFrame, text_col: str = "text", threshold: float = DISCLOSURE, most: int = BROADCAST) -> tuple[DataFrame, dict[str, float]]:
    """((term, disclosure, ic, n), shares): the terms that disclose an entity, with the largest disclosure and the least information content of these, and the number of documents that have the term."""
    found, shares = pairs(docs, text_col, most)
    return common.checkpoint(found.filter(F.col("disclosure") >= threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.min("ic").alias("ic"), F.max("n_t").alias("n"))), shares


def _places(text: str, spans: list[tuple[str, int, int]], wanted: Terms) -> list[tuple[int, int]]:
    hits = wanted.of(terms(text))
    return _outside([m.span() for m in WORD.finditer(text) if m.group().lower() in hits], spans) if hits else []


def _marked(keyed: DataFrame, risky: DataFrame, most: int) -> DataFrame:
    """(row, doc_id, base, terms) of keyed (row, doc_id, text): by broadcast if at most `most` terms disclose, else by hot_join on the terms that pass a filter."""
    wanted, exact = _lookup(risky.select("term", "disclosure", "ic"), most)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, marks = [], []
            for text in common.strings(batch, "text"):
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                places = _places(text, spans, wanted.value)
                if exact:
                    marks.append([{"start": a, "end": b, **dict(zip(("disclosure", "ic"), wanted.value.exact[text[a:b].lower()]))} for a, b in places])
                else:
                    marks.append([{"term": text[a:b].lower(), "start": a, "end": b} for a, b in places])
            kind = _TERM if exact else pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([common.column(batch, "row"), common.column(batch, "doc_id"), pa.array(base, _BASE), pa.array(marks, kind)], names=["row", "doc_id", "base", "terms"])

    schema = "row long, doc_id long, base array<struct<kind:string,start:int,end:int>>, terms "
    rows = keyed.select("row", "doc_id", "text")
    if exact:
        return rows.mapInArrow(each, schema + TERM)
    made = common.written(rows.mapInArrow(each, schema + "array<struct<term:string,start:int,end:int>>"), "pii-marks")
    places = made.select("row", F.explode("terms").alias("t")).select("row", "t.*")
    hits = common.hot_join(places, risky.select("term", "disclosure", "ic", "n"), ["term"], "n", made.count())
    own = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure", "ic"))).alias("own"))  # a text's words at most
    return made.join(own, "row", "left").select("row", "doc_id", "base", F.coalesce("own", F.array().cast(TERM)).alias("terms"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = DISCLOSURE, most: int = BROADCAST) -> DataFrame:
    """(doc_id, base, terms): a row for each row of docs; base spans (kind, start, end), and the spans of disclosing terms (start, end, disclosure, ic), by start, wherever they stand in any text but within base spans.

    Null texts count as empty and have no span; ids may be null or repeat; repeated rows give equal rows, and count as documents of their own. An empty table gives an empty result.
    """
    risky, _ = disclosing(docs, text_col, threshold, most)
    return _marked(common.named(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), risky, most).drop("row")


def sanitised(text: str, marks: list[dict], shares: dict[str, float], threshold: float = DISCLOSURE) -> str:
    """text with base spans replaced by their kind, and disclosing terms by their class, or by nothing where even the class would disclose: where ln(1 / share of its documents) is `threshold` of the entity's information or more. Where spans overlap, the first and longest counts."""
    all_ = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    for m in marks:
        kind = class_of(text[m["start"] : m["end"]])
        all_.append((m["start"], m["end"], "" if -math.log(shares.get(kind, 1.0)) >= threshold * m["ic"] else f"[{kind}]"))
    out, at = [], 0
    for a, b, mark in sorted(all_, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], mark]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", threshold: float = DISCLOSURE, most: int = BROADCAST) -> DataFrame:
    """docs with sanitised texts (null stays null, empty stays empty) and, if it exists, count_col set to their code points; other columns stay, and no row is dropped.

    With at most `most` disclosing terms they are broadcast and texts are rewritten in place. With more, the rows are written with a number each, and each text's own marks are joined to it by that.
    """
    risky, shares = disclosing(docs, text_col, threshold, most)
    kept = docs.columns
    if risky.count() <= most:
        wanted, _ = _lookup(risky.select("term", "disclosure", "ic"), most)

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = []
                for text in common.strings(batch, text_col):
                    places = _places(text, base_spans(text), wanted.value)
                    marks.append([{"start": a, "end": b, "ic": wanted.value.exact[text[a:b].lower()][1]} for a, b in places])
                yield _rewritten(batch, kept, text_col, count_col, marks, shares, threshold)

        return docs.mapInArrow(rewrite, docs.schema)
    keyed = common.written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    marked = _marked(common.named(keyed, id_col, text_col, row="__row"), risky, most).select(F.col("row").alias("__row"), F.col("terms").alias("__marks"))

    def with_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rewritten(batch, kept, text_col, count_col, [m or [] for m in common.column(batch, "__marks").to_pylist()], shares, threshold)

    return keyed.join(marked, "__row").mapInArrow(with_own, docs.schema)


def _rewritten(batch: pa.RecordBatch, kept: list[str], text_col: str, count_col: str | None, marks: list[list[dict]], shares: dict[str, float], threshold: float) -> pa.RecordBatch:
    texts = [None if t is None else sanitised(t, m, shares, threshold) for t, m in zip(common.column(batch, text_col).to_pylist(), marks)]
    arrays = []
    for c in kept:
        old = common.column(batch, c)
        arrays.append(pa.array(texts, pa.string()) if c == text_col else pa.array([o if t is None else len(t) for t, o in zip(texts, old.to_pylist())], old.type) if c == count_col else old)
    return pa.RecordBatch.from_arrays(arrays, names=kept)


def _joined(kind: str, a: int, b: int) -> str:
    return f"{kind}:{a}:{b}"


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            hashes, texts = [], []
            for base, terms in zip(common.column(batch, "base").to_pylist(), common.column(batch, "terms").to_pylist()):
                own = [_joined(s["kind"], s["start"], s["end"]) for s in base]
                n = Counter(s["kind"] for s in base)
                n["term"] = len(terms)
                for k in KINDS:
                    counts[k].append(n[k])
                hashes.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                texts.append(",".join(own + [_joined("term", s["start"], s["end"]) for s in terms]))
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes), pa.array(texts, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return result.mapInArrow(each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string")
