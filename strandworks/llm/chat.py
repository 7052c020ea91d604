"""Chat formatting of logged conversations after cumulative-snapshot collapse.

Method: every turn gets two 64-bit hashes of its place, role and text; their
running sums within a conversation are rolling hashes of all its turn prefixes.
A conversation whose whole hash is a proper prefix of another one is a snapshot
of it and goes (anti join); of equal conversations the least id stays.  What
remains is rendered.  Built-in column functions only.

Results in edge cases
  * turns are ordered by turn, role, text, nulls first; repeated rows are turns.
  * null role and null text count as empty, apart from that order.
  * rows without conversation id form one conversation with a null id; of equal
    conversations one with an id is preferred.
  * other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

START, STOP = "<|im_start|>", "<|im_end|>"


def maximal_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns and rendered of the conversations that no other one continues."""
    rows = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    placed = rows.withColumn("i", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)

    def rolling(seed):  # exact sums: 38 digits hold 10^18 turns
        return F.sum(F.xxhash64(F.lit(seed), "i", role, text).cast("decimal(20,0)")).over(so_far)

    hashed = placed.withColumns({"a": rolling(1), "b": rolling(2)})
    line = F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(STOP + "\n"))
    chats = hashed.groupBy("conv_id").agg(
        F.max(F.struct("i", "a", "b")).alias("whole"),
        F.collect_list(F.struct("i", "a", "b")).alias("prefixes"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))), lambda t: t.line), "").alias("rendered"),
    )
    chats, _ = stage(chats.select("conv_id", F.col("whole.i").alias("i"), F.col("whole.a").alias("a"), F.col("whole.b").alias("b"), "prefixes", "rendered"), "chats")
    prefixes = chats.select(F.explode(F.filter("prefixes", lambda p: p.i < F.col("i"))).alias("p")).select("p.i", "p.a", "p.b").distinct()
    # equal conversations meet in the map-side part of this aggregate; the id decides, nulls last
    best = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "rendered")).alias("best")
    longest = chats.groupBy("i", "a", "b").agg(best).join(prefixes, ["i", "a", "b"], "left_anti")
    return longest.select(F.col("best.conv_id").alias("conv_id"), F.col("i").cast("long").alias("n_turns"), F.col("best.rendered").alias("rendered"))


SQL = f"""
WITH t AS (SELECT conv_id, count(*) AS n, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, n)) AS i FROM t)),
m AS (SELECT turns, min(conv_id) AS conv_id, any_value(n) AS n FROM t GROUP BY turns)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns,
  array_to_string(list_transform(turns, lambda x: '{START}' || x.r || chr(10) || x.t || '{STOP}' || chr(10)), '') AS rendered
FROM m ANTI JOIN p ON m.turns = p.turns
"""
