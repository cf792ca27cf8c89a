"""Preference formatting of chosen and rejected conversations. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def masks(turns: Column) -> Column:
    """Code-point ranges of a completion that are trained on: the text and end mark of each assistant turn."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        low = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        high = low + F.length(t["text"]) + len(CLOSE)
        return F.struct(high.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], F.array(F.struct(low.alias("start"), high.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask): one row for each pair id of either side.

    n_common is the length of the longest common turn prefix (role and text equal); these turns are rendered once as the prompt, what follows on either side is that side's completion, and its mask
    lists the code-point ranges of assistant turns. Turns are ordered by turn number, null first, ties by role and text, so repeated rows are turns of their own. A null role counts as "unknown", a null
    text as empty; a row of null pair id belongs to no other, so it is a pair of its own (with the other side empty); a side without turns has an empty completion; equal sides have two empty ones. Both sides meet in one shuffle. A row is as large as its conversation.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        turn = F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("unknown")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        alone = F.when(F.col(f"`{pair_col}`").isNull(), F.concat(F.lit(name), F.monotonically_increasing_id()))
        return df.select(F.col(f"`{pair_col}`").cast("long").alias("pair_id"), alone.alias("alone"), F.lit(name).alias("side"), turn.alias("t"))

    both = side(chosen, "c").unionByName(side(rejected, "r")).groupBy("pair_id", "alone").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in "cr"]
    )
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, shorter), F.slice("r", 1, shorter), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, False)
    both = both.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(shorter).cast("int"))
    rest = {s: F.slice(s, F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0))) for s in "cr"}
    return both.select(
        "pair_id", "n_common", rendered(F.slice("c", 1, F.col("n_common"))).alias("prompt"),
        rendered(rest["c"]).alias("chosen"), masks(rest["c"]).alias("chosen_mask"), rendered(rest["r"]).alias("rejected"), masks(rest["r"]).alias("rejected_mask"),
    )


def shortened(conversations: DataFrame) -> DataFrame:
    """The query's rejected side: in each conversation, one assistant turn (which one depends on conv_id) is cut to its first sentence."""
    replies = conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("at"))
    picked = replies.select("conv_id", F.element_at("at", (F.pmod("conv_id", F.size("at")) + 1).cast("int")).alias("picked"))
    first = F.regexp_extract("text", r"^[^.]*\.?", 0)
    return conversations.join(picked, "conv_id", "left").withColumn("text", F.when((F.col("turn") == F.col("picked")) & (F.col("role") == "assistant"), first).otherwise(F.col("text"))).drop("picked")


def digest(result: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return result.withColumn("chosen_mask", text("chosen_mask")).withColumn("rejected_mask", text("rejected_mask")).withColumnRenamed("pair_id", "conv_id")


ORACLE = r"""
WITH replies AS (SELECT conv_id, list(turn ORDER BY turn) AS spots FROM conversations WHERE role = 'assistant' GROUP BY 1),
picked AS (SELECT conv_id, spots[conv_id % len(spots) + 1] AS picked FROM replies),
sides AS (
  SELECT conv_id, 'c' AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT conv_id, 'r', turn, coalesce(role, 'unknown'), coalesce(CASE WHEN turn = picked AND role = 'assistant' THEN regexp_extract(text, '^[^.]*\.?', 0) ELSE text END, '')
  FROM conversations LEFT JOIN picked USING (conv_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM sides),
cmp AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.i, r.i) AS i, (c.role = r.role AND c.text = r.text) IS TRUE AS same
  FROM (SELECT * FROM n WHERE side = 'c') c FULL JOIN (SELECT * FROM n WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.i = r.i),
common AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i))::INTEGER AS n_common FROM cmp GROUP BY 1),
seg AS (SELECT n.conv_id, side, i, role, n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s, 12 + length(role) + 1 AS head FROM n JOIN common USING (conv_id)),
off AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM seg WHERE i > n_common)
SELECT common.conv_id, common.n_common,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM seg WHERE seg.conv_id = common.conv_id AND side = 'c' AND i <= seg.n_common), '') AS prompt,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM off WHERE off.conv_id = common.conv_id AND side = 'c'), '') AS chosen,
  coalesce((SELECT string_agg((o + head) || ':' || (o + length(s)), ',' ORDER BY i) FROM off WHERE off.conv_id = common.conv_id AND side = 'c' AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM off WHERE off.conv_id = common.conv_id AND side = 'r'), '') AS rejected,
  coalesce((SELECT string_agg((o + head) || ':' || (o + length(s)), ',' ORDER BY i) FROM off WHERE off.conv_id = common.conv_id AND side = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM common
"""
