"""WARC records and their Merkle fixity audit. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: A record ends a node of level n if the hex digest of its key begins with n zeros: nodes have 16 children on average, a file 4,096 records. Where a record is lost or added, the next such end is the same in all replicas.
LEVELS, FANOUT = 3, 16
KEY = ["page_id", "url"]


def record(url: Column, payload: Column) -> Column:
    """A WARC/1.1 response record as text, with its length in UTF-8 bytes in the header."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def key_digest() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("url")))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, hash, length) of each page's record; null urls and payloads count as empty."""
    url, payload = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (url_col, payload_col))
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.sha2(record(url, payload), 256).alias("hash"), F.octet_length(record(url, payload)).cast("long").alias("length"))


def manifest(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, key, file, node2, node1, ordinal, start, length, hash), written to the shared folder: where each page's record lies when pages are written to files in ascending (id, url, hash).

    A file, and a node of each level in it, ends where the digest of a record's key says so (see LEVELS); in a run of records of one key, after each 16th, 256th and 4,096th instead, so no node grows without bound.
    Null ids come first; repeated rows are records of their own. The order is found without one global window: rows without their payload are ordered in ranges and written
    to the shared folder, the ranges are counted (a row for each), and each range is numbered on its own. Equal rows are told apart by their place in the input, so a range can end between them.
    """
    rows = records(pages, id_col, url_col, payload_col).withColumn("key", key_digest()).withColumn("place", F.monotonically_increasing_id())
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*KEY, "hash", "place"]
    laid = common.written(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "records")
    run = F.row_number().over(W.partitionBy("range", *KEY).orderBy("hash", "place"))
    ends = lambda n: F.when(F.col("run") > 1, F.col("run") % FANOUT**n == 0).otherwise(F.col("key").startswith("0" * n)).cast("long")
    levelled = laid.withColumn("run", run).select(*order, "key", "length", "range", *[ends(i).alias(f"end{i}") for i in range(1, LEVELS + 1)], F.lit(1).cast("long").alias("end0"))
    columns = [f"end{i}" for i in range(LEVELS + 1)]
    before = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    counted = levelled.withColumns({f"n{i}": F.coalesce(F.sum(c).over(before), F.lit(0)) for i, c in enumerate(columns)})
    sums = counted.groupBy("range").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = sums.select("range", *[F.coalesce(F.sum(c).over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"b{i}") for i, c in enumerate(columns)])  # a row for each range
    placed = counted.join(F.broadcast(earlier), "range").select(*KEY, "key", "hash", "length", *[(F.col(f"n{i}") + F.col(f"b{i}")).alias(a) for i, a in ((0, "number"), (1, "node1"), (2, "node2"), (3, "file"))])
    in_file = W.partitionBy("file").orderBy("number")
    start = F.coalesce(F.sum("length").over(in_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return common.written(placed.select(*KEY, "key", "file", "node2", "node1", (F.row_number().over(in_file) - 1).alias("ordinal"), start.alias("start"), "length", "hash"), "manifest")


def levels(manifest: DataFrame) -> list[DataFrame]:
    """[records, nodes of level 1, of level 2, files]: a node's hash is the SHA-256 of its children's hashes and of their offset ranges within the node, in order, so what lies before a node doesn't matter to it.

    Nodes: (file, node2, node1 as far as they have them; key, the digest of their first record's key; low, high; hash).
    """
    names = ["file", "node2", "node1", "ordinal"]
    out = [manifest.select(*names, "key", "page_id", "url", F.col("start").alias("low"), (F.col("start") + F.col("length")).alias("high"), "hash")]
    for depth in (3, 2, 1):
        group, at = names[:depth], names[depth]
        below = out[-1].groupBy(*group).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct(at, "low", "high", "hash", "key"))).alias("children"))
        text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", (c["low"] - F.col("low")).cast("string"), (c["high"] - F.col("low")).cast("string"), c["hash"])), ",")
        out.append(below.select(*group, F.col("children")[0]["key"].alias("key"), "low", "high", F.sha2(text, 256).alias("hash")))
    out[1] = common.checkpoint(out[1])  # a sixteenth of the records; the upper levels are made of it
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, hash, mine, theirs): first keys and hashes that the two sides don't have equally often."""
    both = a.select("key", "hash", F.lit(1).alias("m"), F.lit(0).alias("t")).unionByName(b.select("key", "hash", F.lit(0).alias("m"), F.lit(1).alias("t")))
    return both.groupBy("key", "hash").agg(F.sum("m").alias("mine"), F.sum("t").alias("theirs")).filter("mine <> theirs")


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """(page_id, url, hash, mine, theirs, kind): the records at which the replicas differ, found from the files' roots down; mine and theirs say how often either side has such a record.

    A node is compared by its first record's key and its hash, wherever it lies, and only the children of differing nodes are looked at. kind: "changed" (a record of the key that the replica has with other bytes
    only), "missing" (the replica lacks it), "extra" (only the replica has it) or "moved" (equal bytes, but other neighbours on both sides among the records that both have; of two neighbours that
    changed places, both). Records of equal key and bytes share a kind: they differ if one side has more of them.
    """
    names = ["file", "node2", "node1"]
    sides, bad = (primary, replica), None
    for depth in range(LEVELS, -1, -1):
        mine, theirs = (s[depth] for s in sides)
        if bad is not None:
            mine, theirs = (x.join(F.broadcast(k) if small else k, names[: LEVELS - depth], "left_semi") for x, (k, small) in zip((mine, theirs), bad))
        differing = common.checkpoint(_differing(mine, theirs))
        small = differing.count() <= 100_000  # else the join is a shuffle
        if depth:
            keep = differing.select("key", "hash")
            bad = [(common.checkpoint(x.join(F.broadcast(keep) if small else keep, ["key", "hash"], "left_semi").select(*names[: LEVELS - depth + 1])), small) for x in (mine, theirs)]
    # What each side has of the differing nodes' records: the keys, and the order of those that both have.
    per_key = differing.groupBy("key").agg(F.max((F.col("mine") > F.col("theirs")).cast("int")).alias("lost"), F.max((F.col("mine") < F.col("theirs")).cast("int")).alias("found"))
    kind = F.when(F.col("mine") > F.col("theirs"), F.when(F.col("found") == 1, "changed").otherwise("missing")).when(F.col("lost") == 0, "extra")
    identity = mine.unionByName(theirs).groupBy("key", "hash").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"))
    out = differing.join(per_key, "key").withColumn("kind", kind).filter("kind IS NOT NULL").join(identity, ["key", "hash"]).select("page_id", "url", "hash", "mine", "theirs", "kind")
    single = lambda x: x.groupBy("key").agg(F.count("*").alias("n"), F.min("hash").alias("hash"), F.min("file").alias("file"), F.min("ordinal").alias("ordinal"), F.min("page_id").alias("page_id"), F.min("url").alias("url")).filter("n = 1")
    a, b = single(mine), single(theirs)
    common_keys = common.checkpoint(a.join(b.select("key", "hash", F.col("file").alias("file2"), F.col("ordinal").alias("ordinal2")), ["key", "hash"]))
    first, second = W.partitionBy("file").orderBy("ordinal"), W.partitionBy("file2").orderBy("ordinal2")
    near = common_keys.withColumns({"p": F.lag("key").over(first), "n": F.lead("key").over(first)}).withColumns({"p2": F.lag("key").over(second), "n2": F.lead("key").over(second)})
    moved = near.filter(~F.col("p").eqNullSafe(F.col("p2")) & ~F.col("n").eqNullSafe(F.col("n2")))
    one = F.lit(1).cast("long")
    return out.unionByName(moved.select("page_id", "url", "hash", one.alias("mine"), one.alias("theirs"), F.lit("moved").alias("kind")))


def damaged(pages: DataFrame) -> DataFrame:
    """The query's replica: of some pages the first letter of the payload is another, some records are missing, some have grown, and some occur again under another url."""
    h = F.pmod(F.pmod(F.col("page_id"), F.lit(1000003)) * 2654435761, F.lit(1009))
    other = F.when(F.substring("html", 1, 1) == "~", F.lit("!")).otherwise(F.lit("~"))
    letter = (h < 19) & (F.length("html") > 0) & (F.ascii("html") < 128)
    html = F.when(letter, F.concat(other, F.expr("substring(html, 2)"))).when(h.between(27, 34), F.concat(F.coalesce("html", F.lit("")), F.lit("<!-- -->"))).otherwise(F.col("html"))
    again = pages.filter(h.between(35, 42)).withColumn("url", F.concat(F.coalesce("url", F.lit("")), F.lit("#again")))
    return pages.filter(F.coalesce(~h.between(19, 26), F.lit(True))).withColumn("html", html).unionByName(again)


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each record of pages, and one for each kind of record that only the replica has (null file, ordinal, start, length and root): page_id, file, ordinal, start, length, hash, root (of its file's tree), kind, corrupt.

    Columns page_id, url and html are read; others are ignored. kind: see audit(), or "whole"; corrupt: changed, missing or extra. A record that only lies at another offset is whole. Null ids, urls and payloads,
    and repeated rows are records like any other: of equal ones, all are corrupt if the replica has fewer. Two empty tables give an empty result.
    """
    own, other = manifest(pages), manifest(replica)
    mine = levels(own)
    bad = common.checkpoint(audit(mine, levels(other)).withColumn("key", key_digest()))
    roots = mine[-1].select("file", F.col("hash").alias("root"))
    marked = own.join(bad.filter("kind <> 'extra'").select("key", "hash", "kind"), ["key", "hash"], "left").join(roots, "file")
    kind = F.coalesce("kind", F.lit("whole"))
    here = marked.select("page_id", "file", "ordinal", "start", "length", "hash", "root", kind.alias("kind"), kind.isin("changed", "missing").alias("corrupt"))
    none = F.lit(None).cast("long")
    extra = bad.filter("kind = 'extra'").select("page_id", none.alias("file"), F.lit(None).cast("int").alias("ordinal"), none.alias("start"), none.alias("length"), "hash", F.lit(None).cast("string").alias("root"), "kind", F.lit(True).alias("corrupt"))
    return here.unionByName(extra)


_BODY = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE = rf"""
WITH rec AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, ((page_id % 1000003) * 2654435761) % 1009 AS h FROM pages),
hashed AS (SELECT page_id, url, html, h, sha256({_BODY}) AS hash, strlen({_BODY}) AS length, md5(coalesce(page_id::VARCHAR, '') || ':' || url) AS key FROM rec),
numbered AS (SELECT *, row_number() OVER o AS number, coalesce(sum((key[1:1] = '0')::INT) OVER b, 0) AS n1, coalesce(sum((key[1:2] = '00')::INT) OVER b, 0) AS n2, coalesce(sum((key[1:3] = '000')::INT) OVER b, 0)::BIGINT AS file
  FROM hashed WINDOW o AS (ORDER BY page_id NULLS FIRST, url, hash), b AS (ORDER BY page_id NULLS FIRST, url, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l0 AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY number) - 1)::INTEGER AS ordinal, coalesce(sum(length) OVER (PARTITION BY file ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM numbered),
a1 AS (SELECT *, low + length AS high, min(low) OVER (PARTITION BY n1) AS base FROM l0),
l1 AS (SELECT file, n2, n1, min(low) AS low, max(high) AS high, sha256(string_agg((low - base) || ':' || (high - base) || ':' || hash, ',' ORDER BY ordinal)) AS hash FROM a1 GROUP BY 1, 2, 3),
a2 AS (SELECT *, min(low) OVER (PARTITION BY n2) AS base FROM l1),
l2 AS (SELECT file, n2, min(low) AS low, max(high) AS high, sha256(string_agg((low - base) || ':' || (high - base) || ':' || hash, ',' ORDER BY n1)) AS hash FROM a2 GROUP BY 1, 2),
a3 AS (SELECT *, min(low) OVER (PARTITION BY file) AS base FROM l2),
l3 AS (SELECT file, sha256(string_agg((low - base) || ':' || (high - base) || ':' || hash, ',' ORDER BY n2)) AS root FROM a3 GROUP BY 1),
k AS (SELECT *, CASE WHEN h < 19 AND html <> '' AND ascii(html) < 128 OR h BETWEEN 27 AND 34 THEN 'changed' WHEN h BETWEEN 19 AND 26 THEN 'missing' ELSE 'whole' END AS kind FROM l0),
extra AS (SELECT page_id, url || '#again' AS url, html FROM rec WHERE h BETWEEN 35 AND 42)
SELECT page_id, k.file, ordinal, low AS start, length, hash, root, kind, kind <> 'whole' AS corrupt FROM k JOIN l3 USING (file)
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, sha256({_BODY}), NULL, 'extra', true FROM extra
"""
