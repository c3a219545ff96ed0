"""Chat formatting: cumulative snapshots of a conversation are collapsed to the longest before rendering.

A log that stores a conversation anew after every turn holds each of its prefixes. Rolling hashes of the turns so far name every
prefix; a conversation whose whole hash is a proper prefix of another, or equal to that of one with a smaller id, is dropped by
anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.storage import cut

#: What stands around a turn, and the role of a turn whose role is null.
OPEN, MIDDLE, CLOSE, NO_ROLE = "<|im_start|>", "\n", "<|im_end|>\n", "unknown"
#: Turns of one conversation that are ranked and hashed together.
RUN = 256
HASHES = ("p0", "p1", "p2", "p3")


def _numbered(turns: DataFrame, seed: int) -> DataFrame:
    """Turns (conv, turn, role, text) with ``position`` from 1 and the rolling prefix hash in four sums of 32 bits.

    Turns stand by number (null first), then role, then text. They are counted in runs of turn numbers first, so that a very
    long conversation is not numbered in one place.
    """
    run = F.floor(F.col("turn") / RUN)
    order = Window.partitionBy("conv", "run").orderBy("turn", "role", "text")
    w = turns.withColumn("run", run).withColumn("at", F.row_number().over(order))
    runs = w.groupBy("conv", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(F.col("conv").alias("c"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("run").eqNullSafe(F.col("r"))
    w = w.join(bases, same).withColumn("position", F.col("base") + F.col("at")).drop("c", "r", "base", "at")
    # one hash of each turn at its place; null and empty differ
    parts = [F.col("position"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    half = lambda h: (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))
    halves = [*half(F.xxhash64(F.lit(seed), *parts)), *half(F.xxhash64(F.lit(seed + 1), *parts))]
    w = w.withColumns(dict(zip(HASHES, halves, strict=True)))
    totals = w.groupBy("conv", "run").agg(*(F.sum(p).alias(p) for p in HASHES))
    bases = totals.select(F.col("conv").alias("c"), F.col("run").alias("r"), *(F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"b_{p}") for p in HASHES))
    upto = Window.partitionBy("conv", "run").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = w.withColumns({f"s_{p}": F.sum(p).over(upto) for p in HASHES}).join(bases, same)
    return rolling.withColumns({p: F.col(f"s_{p}") + F.col(f"b_{p}") for p in HASHES}).select("conv", "turn", "role", "text", "position", *HASHES)


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", seed: int = 77) -> DataFrame:
    """The turns of the maximal conversations: (conv, turn, role, text, position).

    A conversation goes if its turns (roles and texts, in order) are the first turns of a longer one, or all the turns of one with a
    smaller id. Equal prefixes are told by 128 bits of hash and the number of turns.

    A null conversation id is an id, the smallest. Null and empty roles and texts differ. Turns with the same number stand by role, then
    text; repeated rows are turns of their own. An empty table gives none. Other columns do not matter.
    """
    named = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    numbered = cut(_numbered(named, seed))
    light = numbered.select("conv", "position", *HASHES)
    last = light.groupBy("conv").agg(F.max("position").alias("n"))
    on_conv = F.col("conv").eqNullSafe(F.col("c"))
    prefix = ["position", *HASHES]
    whole = light.join(last.withColumnRenamed("conv", "c"), on_conv & (F.col("position") == F.col("n"))).select("conv", *prefix)
    longer = light.join(last.withColumnRenamed("conv", "c"), on_conv & (F.col("position") < F.col("n"))).select(*prefix).distinct()
    first = whole.groupBy(*prefix).agg(F.min(F.struct(F.col("conv").isNotNull().alias("known"), "conv")).alias("kept"))
    kept = first.join(longer, prefix, "left_anti").select(F.col("kept.conv").alias("c"))
    return numbered.join(kept, on_conv).select("conv", "turn", "role", "text", "position")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit(NO_ROLE)), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def render(turns: DataFrame) -> DataFrame:
    """One row per turn of ``collapse``: ``piece``, its markup, and ``learn``, whether the loss counts it (assistant turns).

    A conversation's text is its pieces in order of position; they are kept as rows so that no conversation, however long, has to fit in one.
    A null role is NO_ROLE, a null text is empty; repeated rows give equal pieces. An empty table gives none. Columns named as the new ones are replaced.
    """
    return turns.withColumn("piece", rendered(F.col("role"), F.col("text"))).withColumn("learn", F.coalesce(F.col("role") == "assistant", F.lit(False)))


def op4_snapshot_collapse(spark, sf_dir: str) -> DataFrame:
    r = render(collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return r.select(F.col("conv").alias("conv_id"), "position", "piece", "learn")


OP4_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY position) AS turns, count(*) AS n FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
f AS (SELECT min(conv_id) AS conv_id, turns FROM c GROUP BY turns),
kept AS (SELECT conv_id FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = f.turns))
SELECT conv_id, position, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece, coalesce(role = 'assistant', false) AS learn
FROM t WHERE conv_id IN (SELECT conv_id FROM kept)
"""
