"""The training-data operators against brute force, on small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import common, decontaminate, merkle_text, mixing, pii, preference, queries, resample, simhash, spans, toxicity, warc
from weftline.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "r", "s", "") for c in ("a", "e", "o", "ix")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        s = [rng.choice(WORDS) for _ in range(rng.randint(3, 11))]
        out += [s[0].title(), *s[1:-1], s[-1] + rng.choice([".", ".", "!", ".\n"])]
    return " ".join(out)


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(20, 160)), "en", f"src{min(rng.randint(0, 5), 3)}", 0) for i in range(n)]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, "   \n ", "en", None, 5), (103, "word", "en", "src1", 4), (104, "two words", "en", "src1", 9), (None, "an odd text without an id.", None, "src2", 3)]
    rows += [(105, rows[3][1], "en", "src0", 0), (106, rows[3][1] + " x", "en", "src0", 0), rows[5], (107, prose(rng, 6000), "en", "src0", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([tuple(r) for r in corpus()], DOC).withColumn("fp", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("span", F.lit(1)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def texts():
    return [(r[0], r[1] or "") for r in corpus()]


# 1
def brute_tiles(words, item, k):
    """Greedy string tiling by trying all pairs of positions again and again."""
    a, b = [False] * len(words), [False] * len(item)
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(words)):
                n = 0
                while i + n < len(words) and j + n < len(item) and words[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return sum(b) / len(item)
        for x in range(best[0]):
            a[best[1] + x] = b[best[2] + x] = True


def test_decontaminate(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(12, 30))) for i in range(8)] + [(20, "too short"), (21, None), (22, "")]
    rows = []
    for i in range(40):
        t = decontaminate.tokens(prose(rng, 40))
        if i % 4 == 0:
            w = decontaminate.tokens(items[i % 8][1])
            half = len(w) // 2
            t = t[:10] + w[half:] + t[10:20] + w[:half] + t[20:]  # reordered
        rows.append((i, " ".join(t).upper() if i % 8 else ", ".join(t), "en", "s", 0))
    rows += [(50, None, "en", "s", 0), (51, "", "en", "s", 0), rows[0], (52, "it is Too-short, this one", "en", "s", 0), (53, "na " * 3000, "en", "s", 0)]
    items.append((30, "na " * 60))
    docs, bench = spark.createDataFrame(rows, DOC).withColumn("tiling", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 24, 300):  # one block, and several
        got = decontaminate.tiled(docs, bench, block_chars=chars).collect()
        assert len(got) == len(rows)
        for r in got:
            words = decontaminate.tokens(r["text"] or "")[:200]
            want = {i: brute_tiles(words, decontaminate.tokens(t), min(decontaminate.MIN_MATCH, len(decontaminate.tokens(t)))) for i, t in items if t and decontaminate.tokens(t)}
            assert r["tiling"]["coverage"] == pytest.approx(max([0.0, *want.values()]))
            assert r["tiling"]["items"] == sorted(i for i, c in want.items() if c >= decontaminate.COVERAGE)
        assert {r["doc_id"] for r in got if r["tiling"]["contaminated"]} == set(range(0, 40, 4)) | {52, 53}
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 32  # 45 rows, 13 of them contaminated
    assert decontaminate.tiled(docs.limit(0), bench).count() == 0
    assert decontaminate.digest(docs, bench.limit(0)).filter("contaminated").count() == 0


# 2
def test_preference(spark):
    turns = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Yes. No."), (1, 2, "user", "More"), (1, 3, "assistant", "End"), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", ""), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 1, "user", "z")]
    other = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Yes."), (1, 2, "user", "More"), (2, 0, "user", None), (2, 1, None, "x"), (4, 0, "user", "a"), (5, 1, "assistant", "only here")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r["pair_id"]: r for r in preference.preferences(spark.createDataFrame(turns, schema).withColumn("side", F.lit(9)), spark.createDataFrame(other, schema)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and got[None]["chosen"] and not got[None]["rejected"]
    r = got[1]
    assert r["n_common"] == 1 and r["prompt"] == "<|im_start|>user\nHi<|im_end|>\n"
    assert [r["chosen"][m["start"] : m["end"]] for m in r["chosen_mask"]] == ["Yes. No.<|im_end|>\n", "End<|im_end|>\n"]
    assert [r["rejected"][m["start"] : m["end"]] for m in r["rejected_mask"]] == ["Yes.<|im_end|>\n"]
    assert got[2]["n_common"] == 2 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[4]["n_common"] == 1 and got[4]["chosen"] and not got[4]["rejected"]
    assert got[3]["prompt"] == "" and got[5]["chosen"] == ""
    empty = spark.createDataFrame([], schema)
    assert preference.preferences(empty, empty).count() == 0


# 3
def brute_likeness(a, b):
    """Twice the words of the phrases that both have, by plain multisets, over all words; phrases end after words whose hash is divisible by 4, after 15 words, and at line ends."""
    if a == b:
        return 1.0
    sides = []
    for t in (a, b):
        c = Counter()
        for line in t.split("\n"):
            run = []
            for w in line.split():
                run.append(w)
                if xxhash.xxh32_intdigest(w) % 4 == 0 or len(run) == 15:
                    c[tuple(run)] += 1
                    run = []
            if run:
                c[tuple(run)] += 1
        sides.append(c)
    total = sum(len(p) * n for c in sides for p, n in c.items())
    return min(2 * sum(len(p) * n for p, n in (sides[0] & sides[1]).items()) / total, 0.999999) if total else 0.0


def test_merkle_queries(spark, docs, none):
    rows = [r[:2] for r in corpus()] + [(None, None)] * 6 + [(None, f"no id {i}") for i in range(5)] + [(7, f"again {i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash")).withColumn("guest", F.lit("clash"))
    key = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), key(r[1])))
    want = Counter()
    for i, (k, own) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half] if half else own
        want[k, len(own), hashlib.sha256(edited.encode()).hexdigest(), hashlib.sha256(own.encode()).hexdigest(), round(brute_likeness(own, edited), 9), round(brute_likeness(own, nxt), 9)] += 1
    roots = {merkle_text.tree(t)[0].hex(): hashlib.sha256(t.encode()).hexdigest() for t in {t or "" for _, t in rows}}
    assert len(roots) == len({t or "" for _, t in rows})
    for buckets in (1, 7):
        got = merkle_text.edit_fingerprints(df, buckets=buckets).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], roots[r["fingerprint"].partition(":")[0]], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert merkle_text.edit_fingerprints(none).count() == 0
    assert merkle_text.edit_fingerprints(docs.filter("doc_id = 7")).first()["near_next"] == 1.0


def test_merkle_tree(spark, docs):
    rng = random.Random(2)
    a = "\n".join(prose(rng, 12).replace("\n", " ") for _ in range(40))
    lines = a.split("\n")
    b = "\n".join([*lines[:17], "changed line", *lines[18:]])
    prints = {t: merkle_text.fingerprint(t) for t in (a, b, "quite other words", "", " ", "\n\n")}
    for x in prints:
        for y in prints:
            assert merkle_text.likeness(prints[x], prints[y]) == pytest.approx(brute_likeness(x, y))
    assert merkle_text.diff(a, a) == []
    found = {(side, (a if side == "a" else b)[s:e]) for side, s, e in merkle_text.diff(a, b)}
    assert found == {("a", lines[17]), ("b", "changed line")}
    roots = merkle_text.nodes(docs).filter("level = 'root'").collect()
    assert sorted(r["hash"] for r in roots) == sorted(merkle_text.tree(t)[0].hex() for _, t in texts())


# 4
def brute_spans(rows, words=spans.WORDS):
    """The words removed from each row, by hashing every run of two and more sentences: row -> set of sentences."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, (xxhash.xxh3_64_intdigest((rows[i][1] or "").encode()) + (1 << 63)) % (1 << 64), i))
    seen, cut, sizes = {}, {i: set() for i in order}, {}
    for i in order:
        t = rows[i][1] or ""
        own = spans.sentences(t)
        keys = [tuple(t[a:b].split()) for a, b in own]
        covered = set()  # pairs of neighbours that lie in one repeated run
        for a in range(len(own)):
            for b in range(a + 2, min(len(own), a + 12) + 1):
                if seen.setdefault(tuple(keys[a:b]), (i, a)) != (i, a):
                    covered |= {(x, x + 1) for x in range(a, b - 1)}
        x = 0
        while x < len(own) - 1:
            y = x
            while (y, y + 1) in covered:
                y += 1
            if y > x and (sum(map(len, keys[x : y + 1])) >= words or y - x + 1 == len(own)):
                cut[i] |= set(range(x, y + 1))
            x = max(y, x + 1)
        sizes[i] = len(own)
    return cut, sizes


@pytest.mark.parametrize("floor, most, words", [(1_000_000, 1 << 27, spans.WORDS), (1, 1 << 10, spans.WORDS), (1_000_000, 1 << 27, 0)])
def test_spans(spark, none, monkeypatch, floor, most, words):
    monkeypatch.setattr(spans, "MOST", most)
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = [r[:2] for r in corpus() if r[0] != 107] + [(200 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 20)) for i in range(12)] + [(300, "na " * 400)]
    rows += [(400, "Short one. Two."), (401, "Short one.  Two."), (402, "Other. Short one. Two. More."), (403, "single"), (404, "single")]
    rows += [(None, "Quite another text here. It is unlike all. " + passage), (None, "A third text that has no id. It shares nothing."), (2, "The id is taken. But not the text. " + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash")).withColumn("at", F.lit(0)).withColumn("row", F.lit("clash"))
    got = spans.repeated(df, floor=floor, words=words).collect()
    want, sizes = brute_spans(rows, words)
    assert Counter((r["doc_id"], r["n_sentences"], r["n_removed"]) for r in got) == Counter((rows[i][0], sizes[i], len(want[i])) for i in want)
    if words == 0:
        return
    # the texts, each cut at its own repeats only
    out = spans.deduplicated(df)
    texts_ = Counter()
    for i, gone in want.items():
        t, left, last = rows[i][1], "", 0
        own = spans.sentences(t or "")
        for x, (a, b) in enumerate(own):
            if x in gone:
                left += t[last : a if x - 1 not in gone else last]
                last = b
        texts_[rows[i][0], t if t is None else left + t[last:]] += 1
    assert out.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in out.collect()) == texts_
    inner = re.sub(r"\s+", " ", passage)
    for k, t in rows:
        if k is not None and 200 < k < 212:
            left = re.sub(r"\s+", " ", next(x for (d, x) in texts_ if d == k))
            assert len(left) < len(t) - 0.8 * len(inner)
    assert (401, "") in texts_ and (402, rows[[r[0] for r in rows].index(402)][1]) in texts_ and (404, "single") in texts_
    assert (105, "") in {(k, (t or "").strip()) for k, t in texts_}  # an exact copy
    assert spans.repeated(none).count() == 0 and spans.deduplicated(none).count() == 0


def test_spans_begin_anywhere(spark):
    rng = random.Random(12)
    say = lambda *sizes: " ".join(" ".join(rng.choice(WORDS) for _ in range(n)) + "." for n in sizes)
    inner, heading = say(24, 9, 17), say(4, 5)
    # the passage begins and ends within sentences of its neighbours
    around = [say(9)[:-1] + " " + say(7) + " " + inner[:-1] + " " + say(8)[:-1] + " " + say(5) for _ in range(6)]
    rows = list(enumerate(around)) + [(10 + i, say(12) + " " + heading + " " + say(11)) for i in range(4)]
    got = {r["doc_id"]: r for r in spans.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0
    for i in range(1, 6):
        assert inner[len(inner) // 3 : -len(inner) // 3] not in spans.cut(rows[i][1], got[i]["removed"]) and got[i]["n_removed"] > 1
    assert all(got[10 + i]["n_removed"] == 0 for i in range(4))


# 5
def test_resample(spark):
    rng = random.Random(5)
    good = [(i, prose(rng, 80), "en", "s", 0) for i in range(160)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(rng, 80).split()), "en", "s", 0) for i in range(160, 200)]
    rows = good + bad + [(300, None, "en", "s", 0), (301, "", "en", "s", 0), good[0]]
    docs = spark.createDataFrame(rows, DOC).withColumn("log_weight", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (2, None, 0), (9999, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    scored, least, ratio = resample.resampled(docs, labels)
    got = scored.collect()
    # brute force: the same models from plain counts
    raw, target = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    known = {i for i in range(0, 160, 2) if i != 4 and xxhash.xxh64_intdigest(str(i), 3) % 4}
    for k, t, *_ in rows:
        for g in resample.ngrams((t or "").encode(), resample._Hashes()):
            raw[g] += 1
            target[g] += k in known
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    weighed = Counter()
    for k, t, *_ in rows:
        grams = resample.ngrams((t or "").encode(), resample._Hashes())
        plain = sum(ratio[g] for g in grams)
        weight = plain * min(1, resample.TEMPER / len(grams)) if len(grams) else 0.0
        u = ((xxhash.xxh64_intdigest(f"{k}:{'' if k is not None else xxhash.xxh64_hexdigest((t or '').encode())}".encode(), resample.SEED) >> 11) + 0.5) / 2**53
        weighed[k, round(plain, 6), round(weight, 6), round(weight - math.log(-math.log(u)), 6)] += 1
    assert Counter((r["doc_id"], round(r["log_ratio"], 6), round(r["log_weight"], 6), round(r["perturbed"], 6)) for r in got) == weighed
    assert all(r["log_weight"] == r["log_ratio"] for r in resample.resampled(docs, labels, temper=None)[0].collect())
    keys = sorted((r["perturbed"] for r in got), reverse=True)
    k = sum(r["selected"] for r in got)
    assert 0 < k < len(rows) and all(r["selected"] == (r["perturbed"] >= keys[k - 1]) for r in got)
    kept = resample.kept(docs, labels)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(ids) == sorted(r["doc_id"] for r in got if r["selected"])
    assert len(set(ids) & set(range(160))) > 155 and len(set(ids) & set(range(160, 200))) < 3
    empty, _, _ = resample.resampled(docs.limit(0), labels)
    assert empty.count() == 0
    free, _, _ = resample.resampled(docs, labels.limit(0))
    assert free.filter("selected").count() == len(rows)
    assert resample.resampled(docs, labels, k=7)[0].filter("selected").count() == 7


def test_kth_largest(spark):
    rng = random.Random(1)
    xs = [round(rng.gauss(0, 3), 2) for _ in range(3000)] + [5.0] * 500 + [-1e9, 1e9]
    df = spark.createDataFrame([(x,) for x in xs], "perturbed double")
    for k in (1, 2, 700, 3502):
        assert resample.kth_largest(df, k, few=20) == sorted(xs, reverse=True)[k - 1]


# 6
def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vlark", "grozz", "snivt"]
    rows, marks = [], []
    for i in range(400):
        words = prose(rng, 50).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        if toxic and rng.random() < 0.8 or rng.random() < 0.05:
            words.insert(rng.randint(0, len(words)), "muslim")
        rows.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, 1, int(toxic)))
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (None, "no id", "en", "s", 0), rows[0]]
    docs, labels = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash")), spark.createDataFrame(marks + [(1, None, None), (7777, 1, 1), (2, 1, 1 - marks[2][2])], "doc_id long, quality int, toxic int")
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == len(rows)
    truth = dict((i, t) for i, _, t in marks)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    # the penalty: neutral mentions of the group are false positives less often than without it, and toxic texts are still found
    free, fair = (toxicity.train(docs, labels, counterfactual=c) for c in (0.0, toxicity.COUNTERFACTUAL))
    gap = lambda m: abs(m.score("A muslim man came home.") - m.score("A christian man came home."))
    assert gap(fair) < 0.5 * gap(free)
    neutral, toxic = ([" ".join([prose(rng, 40), "muslim", *extra, prose(rng, 5)]) for _ in range(60)] for extra in ([], bad))
    wrong = [sum(m.score(t) >= 0.5 for t in neutral) for m in (free, fair)]
    assert wrong[1] < wrong[0] and all(fair.score(t) >= 0.5 for t in toxic)
    assert toxicity.scored(docs.limit(0), fair).count() == 0
    assert 0 < toxicity.train(docs, labels.limit(0)).score("x") < 1


def test_toxicity_fit():
    """The fit against Newton's method on the same objective, with and without the penalty."""
    rng = np.random.default_rng(3)
    n, m = 6, 300
    x = rng.random((m, n)) < 0.4
    y = (rng.random(m) < 1 / (1 + np.exp(-(x @ rng.normal(0, 2, n) - 0.5)))).astype(int)
    pairs = [(np.array([0]), np.array([1]), 3), (np.array([2, 3]), np.array([4]), 1)]
    swap = np.zeros((2, n))
    swap[0, [0, 1]], swap[1, [2, 3, 4]] = (1, -1), (1, 1, -1)
    often = np.array([3, 1]) / 4
    for c in (0.0, 1.0):
        penalty = 2 * c * (swap.T * often) @ swap
        w, ridge = np.zeros(n + 1), np.diag([2 * toxicity.RIDGE] * n + [0])
        full = np.hstack([x.astype(float), np.ones((m, 1))])
        ridge[:n, :n] += penalty
        for _ in range(50):
            p = 1 / (1 + np.exp(-full @ w))
            w -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) / m + ridge, full.T @ (p - y) / m + ridge @ w)
        got, b = toxicity.fit([(np.flatnonzero(r), int(t)) for r, t in zip(x, y)], n, pairs, counterfactual=c)
        assert np.allclose(np.append(got, b), w, rtol=0.02)


# 7
def brute_targets(sizes: dict, epochs=1.5, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, free = epochs * sum(sizes.values()), {}, set(order)
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)


@pytest.mark.parametrize("task_rows,floor", [(500_000, 1_000_000), (3, 1)])
def test_mixing(spark, docs, none, task_rows, floor):
    out, cut = mixing.mixed(docs, block=16, shard=8, task_rows=task_rows, floor=floor)
    got = out.collect()
    assert len(got) == len(corpus())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(k), size(t)) for k, t, *_ in corpus())
    sizes = Counter()
    for _, t, _, s, _ in corpus():
        sizes[s] += size(t)
    want = brute_targets(sizes)
    by = defaultdict(lambda: [0, 0, None])
    source = {(str(r[0]), size(r[1])): r[3] for r in corpus()}
    for r in got:
        s = source[str(r["doc_id"]), r["size"]]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        by[s][0] += r["taken"]
    for s, (taken, *_) in by.items():
        assert taken == pytest.approx(want[s], abs=1)
    again = mixing.mixed(docs, block=16, shard=8)[0].collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, map(tuple, got)))
    # no block more than twice, no slot twice, shards no larger than they may be
    pieces = cut.collect()
    assert max(Counter((p["key"], p["first"], p["doc_id"], w) for p in pieces for w in range(p["low"], p["high"])).values()) <= 2
    slots = {(p["shard"], p["slot"]) for p in pieces}
    assert max(Counter(s for s, _ in slots).values()) <= 8
    unique = docs.filter("doc_id IS NOT NULL AND doc_id <> 5")
    o2, c2 = mixing.mixed(unique, block=16, shard=8)
    text = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in unique.select("doc_id", "text").collect()}
    packed = {(r["shard"], r["slot"]): r["text"] for r in mixing.packed(unique, c2).collect()}
    joined = defaultdict(list)
    for p in sorted(c2.collect(), key=lambda p: (p["shard"], p["slot"], p["first"], p["low"])):
        joined[p["shard"], p["slot"]] += text[p["doc_id"]][p["low"] : p["high"]]
    assert packed == {k: " ".join(v) for k, v in joined.items()} and max(len(v) for v in joined.values()) <= 16
    assert mixing.mixed(none)[0].count() == 0


def test_mixing_spreads_a_source(spark):
    """Slots of one source are made in many tasks, also where its row can't be broadcast; a draw's argument is computed once or twice, not for each of its places in the formula."""
    sources = spark.createDataFrame([("s", "s", 0, 50, 100_000, 150_000.0)], "key string, source string, rank long, n long, source_size long, target double")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = mixing.slots(sources, block=16, shard=64).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["words"] for r in got) == 150_000 and len({r["slot"] + f" {r['shard']}" for r in got}) == len(got)
    assert len({r["task"] for r in got}) > 1
    assert spark.range(9).select(mixing.mix(F.col("id")).alias("u"))._jdf.queryExecution().analyzed().toString().split("Range")[0].count("id#") < 10


def test_permutation(spark):
    """Every size gives a permutation, and neighbours don't keep one distance."""
    sizes = [1, 2, 3, 10, 1024]
    keys = F.transform(F.sequence(F.lit(1), F.lit(mixing.ROUNDS)), lambda r: F.pmod(F.xxhash64(r, F.lit(3)), F.col("n")))
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, i long")
    by = defaultdict(dict)
    for r in df.select("n", "i", mixing.permuted(F.col("i"), F.col("n"), keys, F.lit("t")).alias("x")).collect():
        by[r["n"]][r["i"]] = r["x"]
    for n in sizes:
        assert sorted(by[n].values()) == list(range(n))
    steps = Counter((by[1024][i + 1] - by[1024][i]) % 1024 for i in range(1023))
    assert steps.most_common(1)[0][1] < 40


# 8
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_pii_base():
    rng = random.Random(4)
    atoms = ["a@b.co", "@", ".", "-", "x_y", "1.2.3.4", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "9", "éü", "日本", "a@b@c.d", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "\n", "+49 ", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(t) == brute_base(t), t
    long = "a" * 200_000 + " " + "1" * 200_000 + "+" * 50_000 + "@" * 50_000
    assert pii.base_spans(long) == []


def brute_pairs(rows):
    """(entity, term) -> disclosure and ic, by counting documents."""
    n, texts_ = len(rows), [r[1] or "" for r in rows]
    mentions = [{pii.entity(k, t[a:b]) for k, a, b in brute_base(t)} for t in texts_]
    words = [{w.lower() for w in re.findall(r"\w+", t) if len(w) >= 3} for t in texts_]
    out = {}
    for t, own in zip(texts_, mentions):
        every = [m.span() for m in re.finditer(r"\w+", t)]
        inside = lambda s, e, t=t: any(a < e and s < b for _, a, b in brute_base(t))
        for k, a, b in brute_base(t):
            e = pii.entity(k, t[a:b])
            before, after = [w for w in every if w[0] < a], [w for w in every if w[0] >= b]
            for s, x in before[-pii.WINDOW :] + after[: pii.WINDOW]:
                term = t[s:x].lower()
                if x - s >= 3 and not inside(s, x):
                    n_e, n_t, n_et = (sum(1 for m, w in zip(mentions, words) if f(m, w)) for f in (lambda m, w, e=e: e in m, lambda m, w, x=term: x in w, lambda m, w, e=e, x=term: e in m and x in w))
                    ic = math.log(n / n_e)
                    out[e, term] = (math.log(n_et * n / (n_e * n_t)) / ic * n_et / (n_et + pii.PRIOR) if n_e < n else 0.0, ic)
    return out


def test_pii(spark, none):
    rng = random.Random(9)
    rows = [(i, prose(rng, 30), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 12)} ask Zebulonix at zeb@corp.example today {prose(rng, 30)} {i} says Zebulonix.", "en", "s", 0) for i in range(5)]
    rows += [(150, "Zebulonix came alone.", "en", "s", 0), (152, "copy that today for me", "en", "s", 0), (151, "Room B7731 is hers: +1 555 123 4567", "en", "s", 0)]
    rows += [(200, None, "en", "s", None), (201, "", "en", "s", 0), (202, "copy Marquist: m@x.org", "en", "s", 0), (203, "copy Marquist: m@x.org", "en", "s", 0), (None, "call +1 555 123 4567", "en", "s", 0), (None, "no id, 1.2.3.4 though", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOC).withColumn("base", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("terms", F.lit("clash"))
    want = brute_pairs(rows)
    risky = {t for (_, t), (d, _) in want.items() if d >= 0.9}
    assert {"zebulonix", "marquist", "b7731"} <= risky
    results = []
    for most in (50_000, 0):  # by broadcast, and by join
        found, _ = pii.pairs(docs, most=most)
        assert {(r["entity"], r["term"]): (round(r["disclosure"], 9), round(r["ic"], 9)) for r in found.collect()} == {k: (round(d, 9), round(c, 9)) for k, (d, c) in want.items()}
        got = pii.digest(pii.spans(docs, most=most, threshold=0.9)).collect()
        assert len(got) == len(rows)
        results.append(sorted(map(str, map(tuple, got))))
        expected = Counter()
        for k, t, *_ in rows:
            t = t or ""
            base = brute_base(t)
            marks = [m.span() for m in re.finditer(r"\w+", t) if m.group().lower() in risky and not any(a < m.end() and m.start() < b for _, a, b in base)]
            own = [f"{a}:{b}:{c}" for a, b, c in base]
            expected[k, hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(own + [f"term:{a}:{b}" for a, b in marks]), len(marks)] += 1
        assert Counter((r["doc_id"], r["base_sha256"], r["spans"], r["n_term"]) for r in got) == expected
    assert results[0] == results[1]
    for most in (50_000, 0):
        clean = pii.sanitise(docs, most=most, threshold=0.9)
        out = {r["doc_id"]: r for r in clean.collect()}
        assert clean.columns == docs.columns and clean.count() == len(rows)
        assert out[200]["text"] is None and out[201]["text"] == "" and out[0]["text"] == rows[0][1] and out[202]["text"] == "copy [NAME]: [EMAIL]"
        assert out[151]["text"].endswith("[PHONE]") and "B7731" not in out[151]["text"]
        assert out[150]["text"] == "[NAME] came alone."  # the name, where the entity isn't
        assert "Zebulonix" not in out[100]["text"] and "@" not in out[100]["text"] and out[100]["n_chars"] == len(out[100]["text"])
    assert pii.sanitised("x Q9", [{"start": 2, "end": 4, "ic": 5.0}], {"NUMBER": 0.001}) == "x "  # so rare a class would disclose as well
    assert pii.digest(pii.spans(none)).count() == 0 and pii.sanitise(none).count() == 0


# 9
def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, none):
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    assert len(got) == len(corpus())
    prints = {k: brute_fingerprint(t) for k, t in texts() if k is not None}
    want = brute_components(prints)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.near_duplicates(none).count() == 0


def brute_similar(rows):
    """(doc_id, text) of the first of each group of texts with 5-word Jaccard similarity of at least 0.8."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return frozenset([" ".join(w)] if 0 < len(w) < 5 else [" ".join(w[i : i + 5]) for i in range(len(w) - 4)])

    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                group[find(i)] = find(j)
    best = {}
    for i, (k, t) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, 0)), (k is None, k or 0, i)) if find(i) in best else (k is None, k or 0, i)
    return Counter(rows[i] for *_, i in best.values())


def test_representatives_of_large_groups(spark):
    """More near copies than a hash may have to find candidates."""
    rng = random.Random(14)
    rows = []
    for g in range(2):
        w = prose(rng, 200).split()
        for i in range(40):
            rows.append((100 * g + i, " ".join(w[:i] + [f"edited{g}x{i}"] + w[i + 1 :])))
    rows += [(1000 + i, prose(rng, 60)) for i in range(10)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"), hot=8)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == brute_similar(rows)


def test_representatives_far_from_centres(spark):
    """Texts made of passages that many have, so that no rare hash finds a pair of near copies, and no few centres are near to all."""
    rng = random.Random(15)
    blocks = [" ".join(prose(rng, 40).split()[:40]) + " and so it goes on" for _ in range(16)]
    rows = []
    for i in range(60):
        own = [blocks[j] for j in sorted(rng.sample(range(16), 8))]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, f"edited{i}"]))]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"), hot=4)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == brute_similar(rows)


def test_representatives(spark, docs, none):
    rng = random.Random(11)
    rows = [r[:2] for r in corpus()]
    base, long = prose(rng, 150).split(), prose(rng, 400).split()
    for i in range(30):  # near copies of two texts, some in chains
        w = list(base if i % 2 else long)
        for _ in range(rng.randint(0, 3)):
            w[rng.randint(0, len(w) - 1)] = "edited%d" % rng.randint(0, 99)
        rows.append((500 + i, " ".join(w)))
    passage = prose(rng, 60)
    rows += [(600 + i, prose(rng, 120) + passage + prose(rng, 120)) for i in range(20)]  # a shared passage makes no near copies
    rows += [(1, "A different text under an id that exists. It stays in the corpus."), (None, "Without id one, quite alone here."), (None, "Without id two, another text altogether."), (None, "without ID two, another text altogether.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("n", F.lit("clash"))
    kept = simhash.representatives(df)
    assert kept.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == brute_similar(rows)
    assert simhash.representatives(none).count() == 0


@pytest.mark.parametrize("dense", [64, 3, 1])
def test_links(spark, dense):
    """Clusters around centres, so that bands are dense: all ways give the components of all pairs within 2 bits."""
    rng = random.Random(dense)
    prints = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(40):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = {simhash._signed(p): p for p in prints}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(df, dense)
    assert all((signed[a] ^ signed[b]).bit_count() <= 2 for a, b in ((r["a"], r["b"]) for r in edges.collect()))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components({k: v for k, v in sorted(signed.items())})
    assert {k: got.get(k, k) for k in signed} == want


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(rng.randint(500, 600), rng.randint(500, 600)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for s in sorted(near):
        stack = [s] if s not in seen else []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                want[x] = s
                stack += near[x]
    assert got == want


# 10
def _laid(spark, order):
    """A manifest of one file that holds (page_id, url, payload) in this order, with nodes as their keys say."""
    rows, at, n1, n2 = [], 0, 0, 0
    for i, (k, u, h) in enumerate(order):
        body = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nContent-Type: text/html\r\nContent-Length: {len(h.encode())}\r\n\r\n{h}\r\n\r\n".encode()
        key = hashlib.md5(f"{k}:{u}".encode()).hexdigest()
        rows.append((k, u, key, 0, n2, n1, i, at, len(body), hashlib.sha256(body).hexdigest()))
        at, n1, n2 = at + len(body), n1 + key.startswith("0"), n2 + key.startswith("00")
    return spark.createDataFrame(rows, "page_id long, url string, key string, file long, node2 long, node1 long, ordinal int, start long, length long, hash string")


def test_warc_manifest(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>" * (i % 7)) for i in range(700)] + [(None, None, None)] * 40 + [(3, "http://x/3", "<p>page 3</p>" * 3), (900, "http://x/é", "日本")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hash", F.lit("clash")).withColumn("file", F.lit("clash"))
    m = warc.manifest(pages).orderBy("file", "ordinal").collect()
    bodies = sorted(((i is not None, i or 0), u or "", hashlib.sha256(b).hexdigest(), len(b), i) for i, u, h in rows for b in [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html\r\nContent-Length: {len((h or '').encode())}\r\n\r\n{h or ''}\r\n\r\n".encode()])
    assert [(r["hash"], r["length"]) for r in m] == [b[2:4] for b in bodies]
    at, file, seen = 0, 0, set()
    for r, (*_, i), (_, u, *_) in zip(m, bodies, bodies):
        assert (r["file"], r["start"]) == (file, at)
        at += r["length"]
        again = (i, u) in seen
        seen.add((i, u))
        if not again and hashlib.md5(f"{'' if i is None else i}:{u}".encode()).hexdigest().startswith("000"):
            at, file = 0, file + 1
    assert max(Counter(r["node1"] for r in m).values()) < 120  # the 40 equal records don't make one node


def test_warc_audit(spark):
    base = [(i, f"u{i}", f"payload {i}") for i in range(300)]
    tree = warc.levels(_laid(spark, base))
    variants = {
        "missing": (base[:41] + base[42:], {(41, "missing")}), "first": (base[1:], {(0, "missing")}), "extra": (base[:100] + [(1000, "new", "x")] + base[100:], {(1000, "extra")}),
        "longer": (base[:77] + [(77, "u77", "payload 77 and more")] + base[78:], {(77, "changed")}), "moved": (base[:20] + base[21:200] + [base[20]] + base[200:], {(20, "moved")}), "same": (base, set()),
        "all": ([(k, u, h + "!") for k, u, h in base], {(i, "changed") for i in range(300)}), "none": ([], {(i, "missing") for i in range(300)}),
    }
    for name, (order, want) in variants.items():
        assert {(r["page_id"], r["kind"]) for r in warc.audit(tree, warc.levels(_laid(spark, order))).collect()} == want, name


def test_warc_fixity(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>" * (i % 7)) for i in range(400)] + [(None, None, None)] * 5 + [(None, "u", None), (3, "http://x/3", "<p>page 3</p>" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    changed = lambda r: (r[0], r[1], "#" + (r[2] or "")) if r[0] in (5, 77, 350) else r
    bad = spark.createDataFrame([changed(r) for i, r in enumerate(rows) if r[0] != 41 and i != 402] + [(7, "http://other", "y")], "page_id long, url string, html string")
    got = warc.fixity(pages, bad).collect()
    assert len(got) == len(rows) + 1
    assert {(r["page_id"], r["kind"]) for r in got if r["kind"] != "whole"} == {(5, "changed"), (77, "changed"), (350, "changed"), (41, "missing"), (7, "extra"), (None, "missing")}
    assert sum(r["corrupt"] for r in got if r["page_id"] is None) == 5  # one of five equal records is missing
    assert warc.fixity(pages, pages).filter("corrupt OR kind <> 'whole'").count() == 0
    assert warc.fixity(pages.limit(0), pages.limit(0)).count() == 0


# queries and pipeline
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[rel.columns.index(c)] for c in columns)) for r in rel.fetchall())


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    sizes, before = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        rows = after.collect()
        own = {r["doc_id"]: r["text"] for r in before.collect()}
        ids = {r["doc_id"] for r in rows}
        if name == "near_duplicates":
            assert ids == {k for k, _ in brute_similar(sorted(own.items()))}
        if name == "decontamination":
            items = [decontaminate.tokens(r["text"]) for r in bench.collect()]
            hit = {k for k, t in own.items() for w in items if decontaminate.Index([(0, " ".join(w))], 4).matches(decontaminate.tokens(t or "")).get(0, (0,))[0] >= 0.5}
            assert ids == set(own) - hit
        if name == "personal_data":
            assert ids == set(own) and not any(pii.emails(r["text"] or "") for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
        sizes.append(len(rows))
        before = spark.createDataFrame(rows, docs.schema)
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert len(out) == sizes[-1] and all(r["taken"] <= 2 * r["size"] for r in out)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, out))
    assert math.isfinite(sum(r["target"] for r in whole))


def test_pipeline_hard_cases(spark, sf):
    """Each stage on null ids, repeated rows and ids, null, empty and very long texts, further columns whose names clash, and on an empty table."""
    import corpus_pipeline

    rng = random.Random(21)
    rows = [r for r in corpus(3, 20)] + [(None, prose(rng, 50), None, None, None), (None, prose(rng, 50), "en", "src1", 3), (4, prose(rng, 40), "en", "src1", 3), (900, prose(rng, 30_000), "en", "src0", 1), (901, "write to a.b@mail.example now", "en", "src0", 1)]
    for extra in ((), ("tiling", "row", "fp", "size", "key", "h1", "__row2", "base")):
        docs = spark.createDataFrame(rows, DOC)
        for c in extra:
            docs = docs.withColumn(c, F.lit("clash"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf)
            assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
            kept = after.collect()
            assert 0 < len(kept) <= len(rows) and all(r[c] == "clash" for r in kept for c in extra)
            if name == "near_duplicates":
                assert Counter((r["doc_id"], r["text"]) for r in kept) == brute_similar([r[:2] for r in rows])
            if name in ("decontamination", "personal_data"):
                assert Counter(r["doc_id"] for r in kept) == Counter(r[0] for r in rows)
            assert stage(spark, docs.limit(0), sf).count() == 0
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_representatives_move_no_texts(spark, tmp_path, monkeypatch):
    """The rows that stay, and the texts to verify, are found by bitmaps and not by shuffling all texts; tables that nothing reads any more are deleted."""
    rows = [(i, f"w{i % 300} x{i % 300} " + " ".join(f"t{i % 300}v{k}" for k in range(40)) + (" more" if i >= 300 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.representatives(docs)
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == brute_similar(rows)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert not [p for p in os.listdir(tmp_path) if p.startswith(("sketches-", "shared-", "candidates-"))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_only(spark):
    df = spark.createDataFrame([(x, x % 3) for x in (0, 1, 7, 32767, 32768, 32769, 1 << 33, (1 << 33) + 1, (5 << 33) + 40000)], "row long, v long")
    ids = spark.createDataFrame([(x,) for x in (0, 32768, (1 << 33) + 1, (5 << 33) + 40000, 99)], "row long")
    for most in (16_384, 1):
        assert {tuple(r) for r in common.only(df, ids, "row", most).collect()} == {(x, x % 3) for x in (0, 32768, (1 << 33) + 1, (5 << 33) + 40000)}
