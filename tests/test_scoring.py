from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftline.functions import scoring
from weftline.operators import evidence, profile

J, I, X, U, N, C, O, M, T = "0.55", "0.58", "0.58", "0.18", "0.20", "0.30", "0.20", "-0.30", "0.08"
CASES = [
    (["0.98"], True, "0.9800"), (["0.90", J], False, "0.9550"), ([J, U, N], False, "0.7048"), ([J, U, N, C], False, "0.7934"), ([J, U, "0.10", T], False, "0.6945"), ([I, U, C], False, "0.7589"), (["0.25"], False, "0.2500"),
    ([J, U, N, M], False, "0.4934"), (["0.72", U], False, "0.7704"), (["0.65", U], False, "0.7130"), ([X, U, N], False, "0.7245"), ([J, U, O], False, "0.7048"), ([J, "0.0666666667"], False, "0.5800"), ([J], False, "0.5500"),
    ([J, "0.05", U], False, "0.6495"), ([], False, "0.0000"), (["0.98", "0.90", "0.72", "0.70"], True, "0.9900"), (["0.98", M, M], True, "0.9500"), ([None, J], False, "0.5500"),
]


def test_noisy_or(spark):
    df = spark.createDataFrame([([x and Decimal(x) for x in s], k) for s, k, _ in CASES], "s array<decimal(12,10)>, k boolean")
    cleaned = F.filter("s", lambda x: x.isNotNull())
    assert [str(r[0]) for r in df.select(scoring.noisy_or(cleaned, F.col("k"))).collect()] == [w for *_, w in CASES]


OBS = "src_key string, tgt_key string, relation_type string, evidence_type string, source_type string, source string, score decimal(12,10), detail string, conditions string, ordinal long"


def obs(kind, score, detail, ordinal, cond=None, src="a.x", tgt="b.y", rel="CO_OCCURRENCE"):
    return (src, tgt, rel, kind, "PLAIN_SQL", "f.sql", Decimal(score), detail, cond, ordinal)


def test_repetition(spark):
    three = spark.createDataFrame([obs("SQL_LOG_JOIN", J, f"l{i}", i) for i in range(3)], OBS)
    r = evidence.relationships(three).first()
    assert str(r["confidence"]) == "0.5800" and r["observations"] == 3
    assert str(evidence.repeated(three).first()["score"]) == "0.0666666667"
    same = spark.createDataFrame([obs("SQL_LOG_JOIN", J, "l0", i) for i in range(3)], OBS)
    assert str(evidence.relationships(same).first()["confidence"]) == "0.5500"
    assert [r["occurrences"] for r in evidence.exact_fold(same).collect()] == [3]
    guards = spark.createDataFrame([obs("SQL_LOG_JOIN", J, "l0", i, f"c{i}") for i in range(2)], OBS)
    assert evidence.exact_fold(guards).count() == 2 and str(evidence.relationships(guards).first()["confidence"]) == "0.5500"
    many = evidence.summaries(spark.createDataFrame([obs("SQL_LOG_JOIN", J, f"l{i:03}", i) for i in range(100)], OBS)).first()
    assert many["observations"] == 100 and many["truncated"] and many["samples"] == [f"l{i:03}" for i in range(5)] and (many["first_detail"], many["last_detail"]) == ("l000", "l099")


def test_direction(spark):
    rows = spark.createDataFrame([obs("SQL_LOG_JOIN", J, "l", 0, src="customers.id", tgt="orders.customer_id"), obs("SQL_LOG_JOIN", J, "l", 0, src="e.id", tgt="e.boss"), obs("SQL_LOG_JOIN", J, "l", 0, src="q.q", tgt="q.q")], OBS)
    unique = spark.createDataFrame([("customers.id",)], "key string")
    got = {(r["src_key"], r["tgt_key"]): r["relation_type"] for r in evidence.directed(rows, unique).collect()}
    assert got == {("orders.customer_id", "customers.id"): "FK_LIKE", ("e.boss", "e.id"): "CO_OCCURRENCE"}
    kinds = evidence.relationships(evidence.directed(rows, unique)).collect()
    assert {r["subtype"] for r in kinds if r["relation_type"] == "FK_LIKE"} == {"INFERRED_JOIN_FK"}


@pytest.mark.parametrize(("m", "options", "declared", "conditional", "kind", "ratio", "negative"), [
    ((120, 100, 99, 1, 100), {}, False, False, "VALUE_CONTAINMENT_HIGH", "0.99", False),
    ((120, 100, 75, 25, 100), {"overlap": 0.70}, False, False, "VALUE_OVERLAP_HIGH", "0.75", False),
    ((200, 100, 20, 80, 100), {"min_rows": 50}, True, False, None, None, True),
    ((200, 100, 20, 80, 100), {"min_rows": 50}, False, False, None, None, False),
    ((200, 100, 20, 80, 100), {"min_rows": 50}, True, True, None, None, False),
    ((10, 5, 5, 0, 5), {}, False, False, None, None, False),
    ((0, 0, 0, 0, 5), {}, False, False, None, None, False),
])
def test_profile_decision(spark, m, options, declared, conditional, kind, ratio, negative):
    df = spark.createDataFrame([("a", "b", *m)], "src_key string, tgt_key string, rows long, source_distinct long, matched long, missing long, target_distinct long")
    r = profile.decide(df, profile.Options(**options), F.lit(declared), F.lit(conditional)).first()
    assert (r["evidence_type"], r["ratio"], r["negative"]) == (kind, ratio, negative)
    assert r["missing_ratio"] == ("0.8" if negative else None)


def test_words(spark):
    words = ["companies", "classes", "boxes", "branches", "dishes", "orders", "bus", "gas", "city", "series"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(scoring.singular(F.col("w"))).collect()] == ["company", "class", "box", "branch", "dish", "order", "bus", "gas", "city", "sery"]
    a, b = df.limit(1).select(scoring.stable_id("k", F.lit("ab"), F.lit("c")), scoring.stable_id("k", F.lit("a"), F.lit("bc"))).first()
    assert a != b


def test_adjusted(spark):
    df = spark.createDataFrame([obs("SQL_LOG_JOIN", J, "l", 0)], OBS)
    assert float(evidence.adjusted(df, F.col("score") / 2).first()["score"]) == 0.275
    with pytest.raises(Exception, match="adjusted score"):
        evidence.adjusted(df, F.lit(2)).collect()
