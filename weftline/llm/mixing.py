"""Mixing sources to target weights by fixed-length blocks. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: Words in a block; slots in an output shard; share of all words that the mix has; weights of the sources in order; most times that a source is taken.
BLOCK, SHARD, EPOCHS, WEIGHTS, REPEATS = 256, 1024, 1.5, (5, 2, 1), 2
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source in one task when word offsets are summed up.
TASK_ROWS = 500_000
P = 2147483647
#: Rounds of the permutation; shards of one source in one task when their draws are summed up; slots that one task makes.
ROUNDS, SHARD_RANGE, TASK_SLOTS = 12, 4096, 100_000
#: Cells by which a slot's draw finds its source.
CELLS = 4096


def mix(x: Column) -> Column:
    """A pseudorandom number in [0, P) from a non-negative long, by three quadratic rounds modulo a prime.

    Each round is a one-element array's transform, so that its argument is computed once: written out, the last round would hold the first 27 times.
    """
    x = (x % P + F.floor(x / F.lit(P)).cast("long") * 7919 + 104729) % P
    turn = lambda a, c: lambda v: (v * v + v * a + c) % P
    for a, c in ((48271, 12345), (69621, 67890), (39373, 13579)):
        x = F.element_at(F.transform(F.array(x), turn(a, c)), 1)
    return x


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, place, size): key is source with a letter before it, so null is a key as well; place orders a source's documents pseudorandomly, and by nothing else than the id."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n")).alias("key"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit(""))).alias("place"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(rows: DataFrame, epochs: float = EPOCHS, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(key, source, rank, n, source_size, target): one row for each source.

    Sources in code-point order, null last, have the weights in turn. They share epochs times all words by weight; a target stops at `repeats` times its source's size, and the excess is
    shared again. The fixpoint of that is a water level: target = least(cap, level * weight), where level is found from the sources sorted by cap / weight. The window over
    the sources is in one task: a few numbers for each source.
    """
    per = rows.groupBy("key", "source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * float(repeats))
    full, before = W.partitionBy(), W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(full) * epochs - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(full) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    # Levels only fall from the first source that fits on, so the largest of the fitting ones is the water level.
    per = per.withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(full))
    return per.select("key", "source", F.col("rank").cast("long").alias("rank"), "n", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def placed(rows: DataFrame, sources: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows with `first`, the offset of a document's words among its source's, in (place, doc_id) order.

    A hot source isn't one task: its rows are cut by the leading hex digits of `place`, as many as leave about task_rows rows each; the sums of these parts are added up first. The offsets don't depend on the cut.
    """
    most = sources.agg(F.max("n")).first()[0] or 0
    digits = 0
    while most / 16**digits > task_rows:
        digits += 1
    rows = rows.withColumn("part", F.substring("place", 1, digits))
    inside = W.partitionBy("key", "part").orderBy("place", F.asc_nulls_first("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    parts = rows.groupBy("key", "part").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(parts.drop("s"), ["key", "part"]).withColumn("first", (F.col("within") + F.col("before")).cast("long")).drop("part", "within", "before")


def _orders(sources: DataFrame, block: int, repeats: int) -> DataFrame:
    """(key, rank, epoch, full, tail, whole, rest, slots, at): an epoch of a source takes `whole` blocks in permuted order and then `rest` words of the next one; `at` is the number of slots of its epochs before."""
    s = sources.withColumn("goal", F.least(F.round("target").cast("long"), F.col("source_size") * repeats))
    s = s.withColumn("full", F.floor(F.col("source_size") / block)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    s = s.withColumn("words", F.least(F.col("source_size"), F.greatest(F.lit(0), F.col("goal") - F.col("source_size") * F.col("epoch"))))
    s = s.withColumn("whole", F.least("full", F.floor(F.col("words") / block))).withColumn("rest", F.col("words") - F.col("whole") * block)
    s = s.withColumn("slots", F.col("whole") + (F.col("rest") > 0).cast("long"))
    return s.withColumn("at", F.coalesce(F.sum("slots").over(W.partitionBy("key").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def draws(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, seed: int = 1) -> DataFrame:
    """(shard, key, start, n): in each shard, n slots of a source, which are the source's slots start ... start + n - 1.

    A shard's `shard` slots draw their sources independently in proportion to the sources' slots: multinomial counts. A source that has been drawn more often than it has slots gives only as many
    as it has; what it lacks at the end fills further shards. So every source gives exactly its slots.
    """
    per = _orders(sources, block, repeats).groupBy("key", "rank").agg(F.sum("slots").alias("slots")).filter("slots > 0")
    line = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    per = common.checkpoint(per.withColumn("low", F.coalesce(F.sum("slots").over(line), F.lit(0))).withColumn("all", F.sum("slots").over(W.partitionBy())))
    total = (per.agg(F.max("all")).first()[0]) or 0
    shards = -(-total // shard)
    # A draw is a place on the line of all slots; cells of it find the source by an equi-join.
    cell = max(1, -(-total // CELLS))
    cells = per.select("key", "low", (F.col("low") + F.col("slots")).alias("high"), F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("low") + F.col("slots") - 1) / cell))).alias("cell"))
    tasks = max(per.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_SLOTS))
    slots = per.sparkSession.range(0, shards * shard, 1, tasks).select(F.floor(F.col("id") / shard).alias("shard"), (F.floor(mix(F.col("id") + seed * 1_000_003) / P * total)).cast("long").alias("u")).withColumn("cell", F.floor(F.col("u") / cell))
    drawn = slots.join(cells, "cell").filter("u >= low AND u < high").groupBy("shard", "key").agg(F.count("*").alias("c"))
    # What a source's earlier shards have drawn is summed up in two levels, so that a source's shards aren't one task.
    drawn = common.checkpoint(drawn.withColumn("range", F.floor(F.col("shard") / SHARD_RANGE)))
    sums = drawn.groupBy("key", "range").agg(F.sum("c").alias("s")).select("key", "range", F.coalesce(F.sum("s").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("c").over(W.partitionBy("key", "range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    drawn = common.checkpoint(drawn.withColumn("within", within).join(sums, ["key", "range"]).withColumn("start", F.col("within") + F.col("before")).join(per.select("key", "slots"), "key").withColumn("n", F.least("c", F.col("slots") - F.col("start"))).filter("n > 0").select("shard", "key", "start", "n"))
    lacking = per.join(drawn.groupBy("key").agg(F.sum("n").alias("had")), "key", "left").select("key", "rank", (F.col("slots") - F.coalesce("had", F.lit(0))).alias("n"), F.coalesce("had", F.lit(0)).alias("start")).filter("n > 0")
    rest = lacking.withColumn("q", F.coalesce(F.sum("n").over(line), F.lit(0)))
    # The slots that are left fill further shards in order: a source's run is cut where a shard ends.
    rest = rest.withColumn("k", F.explode(F.sequence(F.floor(F.col("q") / shard), F.floor((F.col("q") + F.col("n") - 1) / shard))))
    lo, hi = F.greatest(F.col("q"), F.col("k") * shard), F.least(F.col("q") + F.col("n"), (F.col("k") + 1) * shard)
    return drawn.unionByName(rest.select((F.col("k") + shards).alias("shard"), "key", (F.col("start") + lo - F.col("q")).alias("start"), (hi - lo).alias("n")))


def permuted(pos: Column, size: Column, keys: Column, tag: Column) -> Column:
    """The image of pos under a keyed permutation of 0 ... size - 1 (a swap-or-not shuffle): in each round, x and key - x modulo size change places or not, as a digest of the larger of them says."""
    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.element_at(keys, r) - x, size)
        return F.when(F.ascii(F.md5(F.concat_ws(":", tag, r, F.greatest(x, other)))) % 2 == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pos.cast("long"), turn)


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, seed: int = 1) -> DataFrame:
    """(shard, slot, key, block, words): every slot with the index of the block that it takes and how many of the block's first words.

    A source's epochs each go through its full blocks in their own pseudorandom order, see permuted(); the short last block comes last. Draws meet their epoch while they are a row for each shard and source, and are
    spread over tasks of about TASK_SLOTS slots before they become a row for each slot: joined later, a source's slots would all be in one task.
    """
    modulus, tag = F.greatest(F.col("full"), F.lit(1)).cast("long"), F.concat_ws(":", F.lit(seed), "rank", "epoch")
    keys = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", tag, r)), 1, 12), 16, 10).cast("long"), modulus))
    orders = common.checkpoint(_orders(sources, block, repeats).filter("slots > 0").withColumn("keys", keys).withColumn("tag", tag))
    drawn = draws(sources, block, shard, repeats, seed).select("shard", "key", "start", "n")
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(orders.agg(F.sum("slots")).first()[0] or 0) // TASK_SLOTS))
    low, high = F.greatest("start", "at"), F.least(F.col("start") + F.col("n"), F.col("at") + F.col("slots"))
    due = drawn.join(orders.drop("n"), "key").withColumns({"low": low, "high": high}).filter("high > low").repartition(tasks, "shard", "key", "epoch")
    found = due.withColumn("q", F.explode(F.sequence(F.col("low"), F.col("high") - 1))).withColumns({"i": F.col("q") - F.col("start"), "pos": F.col("q") - F.col("at")})
    at = F.when(F.col("pos") < F.col("full"), permuted(F.col("pos"), modulus, F.col("keys"), F.col("tag"))).otherwise(F.col("full"))
    return found.select("shard", F.concat_ws(":", "key", "i").alias("slot"), "key", at.cast("long").alias("block"), F.when(F.col("pos") < F.col("whole"), F.lit(block)).otherwise(F.col("rest")).cast("long").alias("words"))


def pieces(rows: DataFrame, taken: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, slot, key, doc_id, first, size, low, high): the words low ... high - 1 of each document that a slot takes. Documents meet slots by (source, block index)."""
    spread = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    start = F.col("block") * block
    return (
        spread.join(taken, ["key", "block"])
        .withColumn("low", F.greatest(F.lit(0), start - F.col("first")))
        .withColumn("high", F.least(F.col("size"), start + F.col("words") - F.col("first")))
        .filter("high > low")
        .select("shard", "slot", "key", "doc_id", "first", "size", "block", "low", "high")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, task_rows: int = TASK_ROWS, floor: int = common.HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_id, size, source_size, target, taken for each row of docs; pieces: see pieces().

    A source's documents are laid end to end in pseudorandom order and cut into blocks of `block` words. Every source gives round(target) words exactly: whole blocks in the order of its
    permutation, then a part of one. No block is taken more than REPEATS times, so no document's `taken` exceeds that multiple of its size. Null and empty texts have size 0 and are
    never taken; null ids and null sources count like any other; repeated rows are distinct documents. An empty table gives empty results. Sources share no task by themselves: see placed() and hot_join.
    """
    rows = common.checkpoint(sized(docs, id_col, text_col, source_col))
    sources = common.checkpoint(targets(rows))
    laid = common.checkpoint(placed(rows, sources, task_rows))
    cut = pieces(laid, slots(sources, block, shard), block)
    taken = cut.groupBy("key", "first").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    total = laid.count()
    some = laid.filter("size > 0").join(taken, ["key", "first"], "left").select("key", "doc_id", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    every = some.unionByName(laid.filter("size = 0").select("key", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    out = common.hot_join(every, sources.select("key", "n", "source_size", "target"), ["key"], "n", total, floor=floor)
    return out.select("doc_id", "size", "source_size", "target", "taken"), cut


def packed(docs: DataFrame, cut: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, slot, n_words, text): the mix itself, the words of a slot's pieces in order, joined by spaces. A slot has at most a block's words. docs must have unique ids."""
    words = F.slice(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"({WORD})")), (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    parts = cut.join(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`")), "doc_id").select("shard", "slot", F.col("high").alias("h"), "low", "first", words.alias("w"))
    grouped = parts.groupBy("shard", "slot").agg(F.array_sort(F.collect_list(F.struct("first", "low", "w"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["w"]))
    return grouped.select("shard", "slot", F.size(flat).alias("n_words"), F.array_join(flat, " ").alias("text"))


def _mixed(x: str, n: int) -> str:
    """mix() in SQL: each round is a one-element list's transform, so that its argument is computed once; n tells apart the lambdas of one statement."""
    seed = f"(({x}) % {P} + (({x}) // {P}) * 7919 + 104729) % {P}"
    for a, c in ((48271, 12345), (69621, 67890), (39373, 13579)):
        seed = f"list_transform([{seed}], lambda x{n}: (x{n} * x{n} + x{n} * {a} + {c}) % {P})[1]"
    return seed


ORACLE = rf"""
WITH d0 AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key, md5(coalesce(doc_id::VARCHAR, '')) AS place, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM d0),
s0 AS (SELECT key, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d0 GROUP BY key, source),
s1 AS (SELECT *, ([5, 2, 1])[rank % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM s1 WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN level <= cap / w THEN level END) OVER () AS top FROM s2),
s AS (SELECT key, rank, source_size, least(cap, coalesce(top * w, cap)) AS target FROM s3),
o0 AS (SELECT *, source_size // {BLOCK} AS full_, greatest(0, least(round(target)::BIGINT, source_size * 2) - source_size * epoch) AS due FROM s, (VALUES (0), (1)) e(epoch)),
o1 AS (SELECT *, least(source_size, due) AS words FROM o0),
o2 AS (SELECT *, least(full_, words // {BLOCK}) AS whole, words - least(full_, words // {BLOCK}) * {BLOCK} AS rest FROM o1),
o AS (SELECT *, whole + (rest > 0)::BIGINT AS slots, coalesce(sum(whole + (rest > 0)::BIGINT) OVER (PARTITION BY key ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM o2),
p AS (SELECT key, rank, sum(slots)::BIGINT AS slots FROM o GROUP BY 1, 2 HAVING sum(slots) > 0),
line AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low, (sum(slots) OVER ())::BIGINT AS total FROM p),
n AS (SELECT coalesce(max(total), 0) AS total, (coalesce(max(total), 0) + {SHARD - 1}) // {SHARD} AS shards FROM line),
u AS (SELECT id // {SHARD} AS shard, floor({_mixed("id + 1000003", 1)} / {P} * total)::BIGINT AS u FROM (SELECT unnest(range(shards * {SHARD})) AS id, total FROM n)),
c AS (SELECT shard, key, count(*) AS c FROM u JOIN line ON u >= low AND u < low + slots GROUP BY 1, 2),
g AS (SELECT shard, key, start, least(c, slots - start) AS n FROM (SELECT shard, key, c, coalesce(sum(c) OVER (PARTITION BY key ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c) JOIN p USING (key) WHERE slots > start),
q AS (SELECT key, unnest(range(start::BIGINT, (start + n)::BIGINT)) AS q FROM g UNION ALL SELECT key, unnest(range(had::BIGINT, slots)) FROM (SELECT p.key, p.slots, coalesce(sum(g.n), 0) AS had FROM p LEFT JOIN g USING (key) GROUP BY 1, 2)),
t AS (SELECT o.*, q - before_ AS pos FROM q JOIN o ON o.key = q.key AND q >= before_ AND q < before_ + slots),
k AS (SELECT DISTINCT key, epoch, greatest(full_, 1)::BIGINT AS m, '1:' || rank || ':' || epoch AS tag, list_transform(range(1, {ROUNDS + 1}), lambda r3: ('0x' || substr(md5('1:' || rank || ':' || epoch || ':' || r3), 1, 12))::BIGINT % greatest(full_, 1)::BIGINT) AS keys FROM o),
b AS (SELECT t.key, CASE WHEN pos < full_ THEN list_reduce([pos::BIGINT, {", ".join(map(str, range(1, ROUNDS + 1)))}], lambda x4, r4: CASE WHEN ascii(md5(tag || ':' || r4 || ':' || greatest(x4, ((keys[r4] - x4) % m + m) % m))) % 2 = 1 THEN ((keys[r4] - x4) % m + m) % m ELSE x4 END) ELSE full_ END AS block, CASE WHEN pos < whole THEN {BLOCK} ELSE rest END AS words FROM t JOIN k ON k.key = t.key AND k.epoch = t.epoch),
x AS (SELECT d.key, d.first, unnest(range(first // {BLOCK}, (first + size - 1) // {BLOCK} + 1)) AS block, size FROM d WHERE size > 0),
got AS (SELECT x.key, x.first, sum(greatest(0, least(size, x.block * {BLOCK} + words - first) - greatest(0, x.block * {BLOCK} - first)))::BIGINT AS taken FROM x JOIN b ON b.key = x.key AND b.block = x.block GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE coalesce(taken, 0) END AS taken FROM d JOIN s ON s.key = d.key LEFT JOIN got ON got.key = d.key AND got.first = d.first
"""
