"""Derived paths: edge aggregation, bounded simple paths, reverse paths over shared tables, confidence, limits, components."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .hot import hot_join

DECAY, LEAST, LONGEST, BRIDGE = "0.75", "0.10", 5, "0.55"
#: Edges that components() contracts at once in a task.
LOCAL = 1_000_000


def edges(facts: DataFrame) -> DataFrame:
    """(src, tgt, kind, confidence, support, refs) from facts (src, tgt, kind, confidence, ref): parallel facts of equal confidence become one edge with the sorted union of their references."""
    return facts.groupBy("src", "tgt", "kind", "confidence").agg(F.count("*").alias("support"), F.array_sort(F.collect_set("ref")).alias("refs"))


def bridges(fk: DataFrame) -> DataFrame:
    """From each column to the other referenced columns of its table. fk: (src, tgt) as table.column, the edge a path walks from referenced to referencing column."""
    table = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    heads = fk.select(F.col("src").alias("tgt"), table(F.col("src")).alias("t")).distinct()
    tails = fk.select(F.col("tgt").alias("src"), table(F.col("tgt")).alias("t")).distinct()
    return tails.join(heads, "t").filter("src <> tgt").select("src", "tgt", F.lit("BRIDGE").alias("kind"), F.lit(BRIDGE).cast("decimal(5,4)").alias("confidence"))


def decayed(least: Column, hops: int, decay: str = DECAY) -> Column:
    """least * decay^(hops - 1), as a decimal of 18 places."""
    return (least.cast("decimal(20,18)") * F.lit(str(Decimal(decay) ** (hops - 1))).cast("decimal(20,18)")).cast("decimal(20,18)")


def paths(graph: DataFrame, longest: int = LONGEST, least: str = LEAST, decay: str = DECAY, naming_graph: bool = False, reverse: bool = False, checkpoint=None) -> DataFrame:
    """(src, tgt, path, kinds, path_length, confidence, support): simple paths of 2 ... longest hops over edges (src, tgt, kind, confidence, support).

    Not the pairs that an edge joins already, nor paths of naming edges alone (unless naming_graph). reverse: a path doesn't start on a bridge, has no two in a row, and ends on a RELATIONSHIP. Confidence is the
    least of the edges times decay^(hops - 1); since it only falls, a prefix below `least` is dropped at once (unrounded), and it is rounded at the end. Each hop is one equi-join on the frontier; `checkpoint`, if
    given, cuts the lineage after each.
    """
    step = graph.select(F.col("src").alias("at"), F.col("tgt").alias("next"), "kind", F.col("confidence").cast("decimal(20,18)").alias("c"), F.col("support").cast("decimal(38,0)").alias("s"))
    floor = F.lit(least).cast("decimal(20,18)")
    now = step.filter("kind <> 'BRIDGE'" if reverse else "true").filter("at <> next").select(F.col("at").alias("src"), F.col("next").alias("end"), F.array("at", "next").alias("path"), F.array("kind").alias("kinds"), "c", "s")
    now = now.filter(F.col("c") >= floor)
    out = None
    for hops in range(2, longest + 1):
        met = now.join(step.withColumnsRenamed({"c": "c2", "s": "s2"}), now["end"] == F.col("at")).filter(~F.array_contains("path", F.col("next")))
        if reverse:
            met = met.filter(~((F.element_at("kinds", -1) == "BRIDGE") & (F.col("kind") == "BRIDGE")))
        now = met.select("src", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), F.least("c", "c2").alias("c"), (F.col("s") * F.col("s2")).cast("decimal(38,0)").alias("s"))
        now = now.filter(decayed(F.col("c"), hops, decay) >= floor)
        if checkpoint:
            now = checkpoint(now)
        done = now.filter(F.element_at("kinds", -1) == "RELATIONSHIP") if reverse else now
        done = done.select("src", F.col("end").alias("tgt"), "path", "kinds", F.lit(hops).alias("path_length"), F.round(decayed(F.col("c"), hops, decay), 4).cast("decimal(5,4)").alias("confidence"), F.col("s").alias("support"))
        out = done if out is None else out.unionByName(done)
    direct = graph.select("src", "tgt").distinct()
    out = out.join(direct, ["src", "tgt"], "left_anti")
    return out if naming_graph else out.filter(~F.forall("kinds", lambda k: k == "NAMING"))


def limited(found: DataFrame, per_pair: int = 0) -> DataFrame:
    """At most per_pair paths of a pair, in depth-first order (that of the paths' nodes); 0: all."""
    if not per_pair:
        return found
    return found.withColumn("__i", F.row_number().over(W.partitionBy("src", "tgt").orderBy("path"))).filter(F.col("__i") <= per_pair).drop("__i")


def derived_lineage(value_lineage: DataFrame, **options) -> DataFrame:
    """Paths over column-level VALUE lineage (src, tgt, transform, confidence); a DIRECT edge from a column to itself isn't one. Of equal paths, the most confident stands for them."""
    keep = value_lineage.filter("NOT (src = tgt AND transform = 'DIRECT')").groupBy("src", "tgt").agg(F.max("confidence").alias("confidence"), F.count("*").alias("support")).withColumn("kind", F.lit("LINEAGE"))
    found = paths(keep, **options)
    return found.groupBy("src", "tgt", "path").agg(F.max("confidence").alias("confidence"), F.max("path_length").alias("path_length"), F.max("support").alias("support"))


def derived_relationships(fk: DataFrame, naming: DataFrame | None = None, **options) -> DataFrame:
    """Paths over unconditional column keys (src, tgt, confidence), walked from referenced to referencing columns across shared tables, given in key direction."""
    flip = fk.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.lit("RELATIONSHIP").alias("kind"), "confidence", F.lit(1).alias("support"))
    every = flip.unionByName(bridges(flip).withColumn("support", F.lit(1)))
    if naming is not None:
        every = every.unionByName(naming.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.lit("NAMING").alias("kind"), "confidence", F.lit(1).alias("support")))
    return paths(every, reverse=True, **options).select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.reverse("path").alias("path"), "path_length", "confidence", "support")


def fact_budget(relationships: DataFrame, lineage: DataFrame, naming: DataFrame, most: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first `most` facts: relationships, then lineage, then naming, each sorted by confidence (falling), source, target and path; 0: all."""
    if not most:
        return relationships, lineage, naming
    out, left = [], most
    for facts in (relationships, lineage, naming):
        taken = facts.orderBy(F.desc("confidence"), "src", "tgt", "path").limit(max(left, 0))
        left -= taken.count()
        out.append(taken)
    return tuple(out)


def _contracted(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of about LOCAL rows at a time as stars (a, b): each node with the smallest one that it reaches inside these rows. (a, a) for nodes without any other; a null has a row of its own."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= (most or LOCAL):
            yield _stars(held)
            held, rows = [], 0
    if held:
        yield _stars(held)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    u, v = (table.column(c).combine_chunks() for c in "uv")
    nulls = u.null_count + v.null_count
    both = pa.concat_arrays([pc.coalesce(u, v), pc.coalesce(v, u)]).dictionary_encode()
    names = both.dictionary
    order = pc.sort_indices(names).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[both.indices.drop_null().to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, dtype=np.int64)
    x, y = np.split(ends, 2)
    root = np.arange(len(order))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    size = np.bincount(root, minlength=len(root))
    said = (root != np.arange(len(root))) | (size[root] == 1)
    a, b = names.take(pa.array(order[said])), names.take(pa.array(order[root[said]]))
    if nulls:
        a, b = (pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in (a, b))
    return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def _starred(edges: DataFrame, checkpoint, rounds: int) -> DataFrame:
    """(a, b), b the smallest node that a reaches, of distinct edges (a, b), b < a; by rounds that move a node's neighbours to its smallest one. Nodes of very many edges are joined by broadcast (hot_join)."""
    now = edges
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        ends, leaves = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.expr("n = 1 AND m < u"))).first()
        if 2 * leaves == ends:  # each edge's larger end has no other: stars
            return now
        large = checkpoint(hot_join(both, least, ["u"], "n", ends).filter("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct())
        low = checkpoint(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        moved = hot_join(large, low, ["a"], "n", large.count()).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def components(pairs: DataFrame, a: str = "src", b: str = "tgt", checkpoint=None, rounds: int = 60, local: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge; a null has itself. RuntimeError after `rounds`.

    Edges are contracted where they lie, `local` (LOCAL) at a time, to each node's smallest one there. What these stars say about each other's centres is a graph of the centres: in one task if it has at most `local`
    edges, in rounds otherwise. Rows are shuffled by their own node, never by the label that a large component shares (hot_join).
    """
    checkpoint, local = checkpoint or (lambda df: df.checkpoint()), local or LOCAL
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    kind = both.schema["u"].dataType.simpleString()
    contract = lambda df: df.mapInArrow(lambda batches: _contracted(batches, local), f"a {kind}, b {kind}")
    stars = checkpoint(contract(both))
    edges = stars.filter("a <> b")
    near = checkpoint(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    centres = checkpoint(edges.select(F.col("b").alias("a")).distinct())
    met = edges.join(near.filter("n > 1").drop("n"), "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    links = checkpoint(met.unionByName(near.join(centres, "a").select("a", F.col("m").alias("b"))).distinct())
    roots = (checkpoint(contract(links.select(F.col("a").alias("u"), F.col("b").alias("v")).coalesce(1))) if links.count() <= local else _starred(links, checkpoint, rounds)).select(F.col("a").alias("m"), F.col("b").alias("root"))
    every = near.select("a", "m").unionByName(centres.join(near, "a", "left_anti").select("a", F.col("a").alias("m")))
    named = every.groupBy("m").agg(F.count("*").alias("n")).join(roots, "m").select("m", "root", "n")
    out = hot_join(every, checkpoint(named), ["m"], "n", every.count(), "left").select(F.col("a").alias("node"), F.coalesce("root", "m").alias("component"))
    alone = stars.filter("a = b OR a IS NULL").distinct()
    if alone.isEmpty():
        return out
    return out.unionByName(alone.join(out.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("b").alias("component")))
