"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as users with their names; the mask lists the stretches (content
and end mark) that the assistant's turns take. Context roles (system) are rendered as they
are and get no perspective of their own.

A conversation may be of any length: it is cut into parts of ``part_turns`` turn numbers,
and of at most so many rows, each rendered as a row; a conversation's text is its parts' in
the order of (part, subpart). Thus no task needs more than a part's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's marks.
START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Text without the template's marks: "<|" gets a space inside."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = ("system",), part_turns: int = 256
) -> DataFrame:
    """turns -> (conv_id, perspective, part, subpart, n_turns, n_own, text, mask), a row per participant and part.

    mask: start:end of the perspective's own turns in this row's text (code points, end
    exclusive), comma-joined, empty if it has none here. Turns are ordered by turn number
    (null first), role, text; repeated rows are all rendered. A null role is the speaker
    "unknown", a null text is empty, a null conversation id is one conversation of its own.
    Other columns are ignored. Conversations with context roles only have no perspective; an
    empty table gives no rows. The result holds every conversation once for each of its
    participants: that is its size.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        _safe(F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown"))).alias("role"),
        _safe(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long"))
    speakers = rows.where(~F.col("role").isin(*context_roles)).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    order = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).withColumn("subpart", F.floor(F.col("rank") / part_turns).cast("long"))
    # at most part_turns rows in a group
    parts = ranked.groupBy("conv_id", "part", "subpart").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))

    me = F.col("perspective")
    head = lambda t: F.when(t["role"] == me, F.lit(f"{START}assistant\n")).when(t["role"].isin(*context_roles), F.concat(F.lit(START), t["role"], F.lit("\n"))).otherwise(F.concat(F.lit(f"{START}user name="), t["role"], F.lit("\n")))
    body = lambda t: F.concat(t["text"], F.lit(f"{END}\n"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(head(t))
        stop = begin + F.length(body(t))
        span = F.when(t["role"] == me, F.array(F.concat_ws(":", begin.cast("string"), (stop - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return both.select(
        "conv_id",
        "perspective",
        "part",
        "subpart",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["role"] == me)).cast("long").alias("n_own"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), body(t))), "").alias("text"),
        F.array_join(F.aggregate("turns", nothing, step, lambda a: a["spans"]), ",").alias("mask"),
    )


#: The same rows for part_turns = 256 and the context role "system".
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, coalesce(CAST(floor(turn / 256) AS BIGINT), 0) AS part
  FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1 AS rank FROM t),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
x AS (
  SELECT conv_id, perspective, part, CAST(floor(rank / 256) AS BIGINT) AS subpart, rank, role = perspective AS own,
    CASE WHEN role = perspective THEN '<|im_start|>assistant' WHEN role = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' || chr(10) AS body
  FROM r JOIN p ON conv_id IS NOT DISTINCT FROM c),
y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part, subpart ORDER BY rank) AS stop FROM x)
SELECT conv_id, perspective, part, subpart, CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (own) AS BIGINT) AS n_own,
  string_agg(head || body, '' ORDER BY rank) AS text,
  coalesce(string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY rank) FILTER (own), '') AS mask
FROM y GROUP BY conv_id, perspective, part, subpart
"""
