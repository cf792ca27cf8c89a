"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Shortest tile and seed, in tokens; an item's share of tiled tokens from which a document is contaminated.
MIN_MATCH = 4
COVERAGE = 0.5
#: Characters of benchmark text in one broadcast index. A larger benchmark is taken in blocks of about this size.
BLOCK_CHARS = 16_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k token ids, modulo 2**64."""
    n = len(ids) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * BASE + ids[i : i + n]
    return out


def tiles(runs: list[tuple[int, int, int]], k: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of matches (doc position, item position, length): the longest match first (ties: smaller item, then document position); what is left of an overlapped match waits its turn. size: the item's tokens; it ends when fewer than k of them are free."""
    heap = [(-n, i, d) for d, i, n in runs if n >= k]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    found = []
    while heap and size - len(in_item) >= k:
        n, i, d = heapq.heappop(heap)
        free = [j for j in range(-n) if d + j not in in_doc and i + j not in in_item]
        if len(free) == -n:
            in_doc.update(range(d, d - n))
            in_item.update(range(i, i - n))
            found.append((d, i, -n))
            continue
        for at in range(len(free)):
            if at and free[at] == free[at - 1] + 1:
                continue
            end = at
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - at + 1 >= k:
                heapq.heappush(heap, (-(end - at + 1), i + free[at], d + free[at]))
    return sorted(found)


class Index:
    """Seeds of a block of the benchmark: window hash -> (item, position)."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.vocabulary, self.ids, self.size = k, {}, [], []
        rng = np.random.default_rng(7)
        where, words, self.short = [], [], {}
        for i, (item_id, text) in enumerate(items):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            words.append(np.array(own, dtype=np.int64))
            self.ids.append(item_id)
            self.size.append(len(own))
            where += [(i, j) for j in range(len(own) - k + 1)]
            if 0 < len(own) < k:
                self.short.setdefault(len(own), {}).setdefault(tuple(own), []).append(i)
        #: Random codes make the window hash behave like a random one.
        self.codes = np.concatenate([np.zeros(1, dtype=np.uint64), rng.integers(1, 2**63, len(self.vocabulary) + 1, dtype=np.uint64)])
        self.flat = np.concatenate([np.zeros(0, dtype=np.int64), *words])
        self.start = np.cumsum([0, *self.size])
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(rolling(self.codes[w], k) for w in words)])
        order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[order]
        self.where = np.array(where, dtype=np.int64).reshape(-1, 2)[order]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, words: list[str]) -> dict[int, tuple[float, list[tuple[int, int, int]]]]:
        """Number of the item -> (coverage, tiles), for the items that share a seed, and those too short for one that occur whole."""
        doc = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))
        out = {}
        for n, items in self.short.items():
            windows = list(zip(*(doc[i:].tolist() for i in range(n))))
            for own in items.keys() & set(windows):
                at = windows.index(own)
                out |= {i: (1.0, [(at, 0, n)]) for i in items[own]}
        k = self.k
        if len(words) < k or not len(self.sorted):
            return out
        h = rolling(self.codes[doc], k)
        at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.sorted, h[at], "left"), np.searchsorted(self.sorted, h[at], "right")
        n = hi - lo
        if not n.sum():
            return out
        # All (place in the document, seed) pairs of equal hash, checked token by token; neighbours on a diagonal of an item are one match.
        p = np.repeat(at, n)
        i, j = self.where[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())].T
        same = np.ones(len(p), dtype=bool)
        for t in range(k):
            same &= doc[p + t] == self.flat[self.start[i] + j + t]
        p, i, j = p[same], i[same], j[same]
        if not len(p):
            return out
        order = np.lexsort((p, p - j, i))
        p, i, j = p[order], i[order], j[order]
        first = np.concatenate([[True], (i[1:] != i[:-1]) | (p[1:] - j[1:] != p[:-1] - j[:-1]) | (p[1:] != p[:-1] + 1)])
        begins = np.flatnonzero(first)
        lengths = np.diff([*begins, len(p)]) + k - 1
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for item, d, s, length in zip(i[begins].tolist(), p[begins].tolist(), j[begins].tolist(), lengths.tolist()):
            runs.setdefault(item, []).append((d, s, length))
        for item, own in runs.items():
            found = tiles(own, k, self.size[item])
            out[item] = (sum(x for *_, x in found) / self.size[item], found)
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, k: int, block_chars: int) -> Iterator[Index]:
    """Indexes of blocks of the benchmark, each of about block_chars characters, made one at a time: the only data that is broadcast, and its size is checked here first."""
    rows = common.named(benchmark, id_col, text_col)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for block in range(n):
        part = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == block) if n > 1 else rows
        yield Index(sorted(((r[0], r[1] or "") for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), k)


RESULT = "n_tokens long, n_candidates long, best_item long, coverage double, tiles array<struct<doc_at:int,item_at:int,length:int>>, items array<bigint>, contaminated boolean"


def _judge(words: list[str], index: Index, least: float, old: dict | None) -> dict:
    found: dict = {}
    for i, own in index.matches(words).items():  # items of equal id count as the better one
        found[index.ids[i]] = max(found.get(index.ids[i], (-1.0, [])), own, key=lambda x: x[0])
    best = max(found.items(), key=lambda x: (x[1][0], -(x[0] if x[0] is not None else 1 << 62)), default=None)
    out = {"n_tokens": len(words), "n_candidates": len(found), "best_item": best and best[0], "coverage": best[1][0] if best else 0.0, "tiles": [dict(zip(("doc_at", "item_at", "length"), t)) for t in best[1][1]] if best else []}
    items = [i for i, (c, _) in found.items() if c >= least and i is not None]
    hit = any(c >= least for c, _ in found.values())
    if old:
        if (old["coverage"], -(old["best_item"] or 0)) >= (out["coverage"], -(out["best_item"] or 0)):
            out |= {k: old[k] for k in ("best_item", "coverage", "tiles")}
        out["n_candidates"] += old["n_candidates"]
        items += old["items"]
        hit = hit or old["contaminated"]
    return out | {"items": sorted(set(items)), "contaminated": hit}


def tiled(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with a struct column `tiling`: n_tokens, n_candidates (items sharing a seed of min_match tokens), best_item, coverage (share of its tokens in tiles), its tiles, items (all whose coverage reaches `coverage`), contaminated.

    Tokens are runs of word characters in lower case, so reordered passages, case and punctuation don't matter. Each document meets every item in one pass, without a shuffle: items
    are indexed by block and broadcast. Null and empty texts have no tokens and no match. An item with fewer than min_match tokens has no seed, and matches where it occurs whole (its one tile is shorter); one without tokens never matches. Ties of the best
    item go to the smaller id. Items of null id contaminate, but aren't listed. Repeated documents each get their row; a column `tiling` of docs is replaced.
    """
    out, shared = docs.drop("tiling"), None
    for index in blocks(benchmark, item_col, item_text, min_match, block_chars):
        if shared is not None:  # the block before is done with: one block at a time is in memory
            out = common.checkpoint(out)
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = _pass(out, text_col, shared, coverage)
    return out


def _pass(docs: DataFrame, text_col: str, shared, least: float) -> DataFrame:
    again = "tiling" in docs.columns
    kept = [c for c in docs.columns if c != "tiling"]
    kind = pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())]))
    fields = pa.struct([("n_tokens", pa.int64()), ("n_candidates", pa.int64()), ("best_item", pa.int64()), ("coverage", pa.float64()), ("tiles", kind), ("items", pa.list_(pa.int64())), ("contaminated", pa.bool_())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            old = common.column(batch, "tiling").to_pylist() if again else repeat(None)
            made = [_judge(tokens(t), index, least, o) for t, o in zip(common.strings(batch, text_col), old)]
            yield pa.RecordBatch.from_arrays([common.column(batch, c) for c in kept] + [pa.array(made, type=fields)], names=[*kept, "tiling"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "tiling")
    return docs.mapInArrow(each, f"{schema}, tiling struct<{RESULT.replace(' long', ':bigint').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array', ':array')}>")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_candidates, best_item, coverage, n_tiles, items, contaminated."""
    t = tiled(docs.select("doc_id", "text"), benchmark)
    return t.select("doc_id", "tiling.n_tokens", "tiling.n_candidates", "tiling.best_item", F.round("tiling.coverage", 6).alias("coverage"), F.size("tiling.tiles").alias("n_tiles"), "tiling.items", "tiling.contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, with the columns of docs. Each row is judged by its own text: null and empty texts stay, repeated rows stay or go together, null ids matter nothing; an empty benchmark removes nothing."""
    name = next(n for n in (f"tiling{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    held = docs.withColumnRenamed("tiling", name)  # a column of that name is docs' own
    return tiled(held, benchmark, **options).filter(~F.col("tiling.contaminated")).drop("tiling").withColumnRenamed(name, "tiling").select(*[F.col(f"`{c}`") for c in docs.columns])
