"""Chat formatting after collapse of cumulative snapshots.

Logs often hold a conversation again and again as it grows. The hash of a turn
prefix is the exclusive-or of the turns' hashes, each with its position, so that
it rolls along a conversation and can be put together from parts. Turns are put
in order by one sort of the whole table, so positions need no window over a
conversation; then conversations are cut into parts of ``part_turns`` rows, hashed
and counted by part, and no task holds a whole one. A conversation whose full hash
is the hash of a proper prefix of another is dropped by an anti-join; of equal
ones the smallest id stays. What remains is rendered by part. Hashes have 128
bits: two of 64 of each text, and two of each prefix.

Defined results: turns are ordered by number (null first), role and text hash;
rows without id are one conversation; null role or text is told from empty but
rendered as empty; repeated rows are turns as often as they occur; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixlake.llm.common import materialize

PART_TURNS = 256
#: parts in a group of parts; positions are summed by part, by group and by conversation
GROUP_PARTS = 256


def _placed(turns: DataFrame, part_turns: int, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(k, id, role, h, g, text, pos, n, part, many): ``pos`` counts the n rows of the conversation k from 1, ``part`` its parts from 0."""
    t = F.col(text_col)
    one = t.isNull(), F.coalesce(t, F.lit(""))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("k"),
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.xxhash64(*one).alias("h"),
        F.xxhash64(F.lit(1), *one).alias("g"),
        t.alias("text"),
    )
    # equal rows are dealt by a number of their own, so that very many of them are not one range
    rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).orderBy("k", "turn", "role", "h", "g", "salt")
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()).drop("salt", "turn"), "turns").withColumn("p", F.shiftright("at", 33))
    spans = rows.groupBy("k", "p").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("k")
    starts = spans.select("k", "p", (F.sum("m").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m") - F.col("lo")).alias("start"), F.sum("m").over(whole).alias("n"))
    placed = rows.join(starts, ["k", "p"]).withColumn("pos", F.col("start") + F.col("at") + 1)
    part = F.expr(f"(pos - 1) div {part_turns}")
    return placed.select("k", "id", "role", "h", "g", "text", "pos", "n", part.alias("part"), F.expr(f"(pos - 1) div {part_turns * GROUP_PARTS}").alias("many"))


def _maximal(placed: DataFrame) -> DataFrame:
    """(k, id, n_turns, n_logged): conversations that no longer one begins with; ``k`` is the id as a non-null text."""
    one = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("h"), F.col("g")]
    hashed = placed.select("k", "id", "pos", "n", "part", "many", F.xxhash64(*one).alias("a"), F.xxhash64(F.lit(1), *one).alias("b"))
    before = lambda c, keys, by: F.expr(f"coalesce(bit_xor({c}) over (partition by {keys} order by {by} rows between unbounded preceding and 1 preceding), 0)")
    rolled = hashed.withColumns({c: F.expr(f"bit_xor({c}) over (partition by k, part order by pos rows between unbounded preceding and current row)") for c in "ab"})
    parts = hashed.groupBy("k", "many", "part").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    groups = parts.groupBy("k", "many").agg(F.bit_xor("xa").alias("ya"), F.bit_xor("xb").alias("yb"))
    groups = groups.select("k", "many", *(before(c, "k", "many").alias(c) for c in ("ya", "yb")))
    parts = parts.select("k", "many", "part", *(before(c, "k, many", "part").alias(c) for c in ("xa", "xb")))
    parts = parts.join(groups, ["k", "many"]).select("k", "part", F.expr("xa ^ ya").alias("xa"), F.expr("xb ^ yb").alias("xb"))
    prefixes = rolled.join(parts, ["k", "part"]).select("k", "id", "pos", "n", F.expr("a ^ xa").alias("a"), F.expr("b ^ xb").alias("b"))
    full = prefixes.where("pos = n").groupBy("a", "b", F.col("n").alias("n_turns")).agg(F.min_by("k", F.struct("id", "k")).alias("k"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n_logged"))
    proper = prefixes.where("pos < n").select("a", "b", F.col("pos").alias("n_turns")).distinct()
    return full.join(proper, ["a", "b", "n_turns"], "left_anti").select("k", "id", "n_turns", "n_logged")


def maximal_conversations(turns: DataFrame, part_turns: int = PART_TURNS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_logged): conversations that no longer one begins with."""
    return _maximal(_placed(turns, part_turns, id_col, turn_col, role_col, text_col)).select(F.col("id").alias(id_col), "n_turns", "n_logged")


def render_conversations(turns: DataFrame, part_turns: int = PART_TURNS, template: str = "<|im_start|>{role}\n{text}<|im_end|>\n", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per part of each maximal conversation: id, ``part``, ``n_turns`` and ``n_logged`` of the conversation, ``part_turns``, ``rendered``."""
    placed = _placed(turns, part_turns, id_col, turn_col, role_col, text_col)
    kept = materialize(_maximal(placed), "maximal")
    head, rest = template.split("{role}")
    middle, tail = rest.split("{text}")
    line = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(tail))
    rows = placed.select("k", "part", F.struct("pos", line.alias("line")).alias("x")).join(kept, "k")
    parts = rows.groupBy("k", "part").agg(F.first("id").alias("id"), F.first("n_turns").alias("n_turns"), F.first("n_logged").alias("n_logged"), F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select(F.col("id").alias(id_col), "part", "n_turns", "n_logged", F.size("xs").cast("long").alias("part_turns"), F.expr("array_join(transform(xs, x -> x.line), '')").alias("rendered"))


def query(spark, sf_dir: str) -> DataFrame:
    out = render_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "part", "n_turns", "n_logged", "part_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role) AS l, count(*) AS n_turns,
         list('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) ORDER BY turn, role) AS lines
  FROM conversations GROUP BY conv_id
), p AS (
  SELECT DISTINCT sha256(CAST(l[1:i] AS VARCHAR)) AS h, i FROM (SELECT l, n_turns, unnest(range(1, n_turns)) AS i FROM c)
), f AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_logged, any_value(n_turns) AS n_turns, any_value(array_to_string(lines, '')) AS rendered, sha256(CAST(l AS VARCHAR)) AS h
  FROM c GROUP BY l
)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n_turns, n_logged, n_turns AS part_turns, CAST(length(rendered) AS BIGINT) AS n_chars, sha256(rendered) AS rendered_sha256
FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.h = f.h AND p.i = f.n_turns)
"""
