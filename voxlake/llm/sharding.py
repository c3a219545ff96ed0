"""Uniform sharding by a hypergeometric communication matrix, in DataFrame functions only.

Rows lie in logical partitions (a hash of the row). One exact draw of the matrix says how many rows of each
partition go to each shard: row by row multivariate hypergeometric, given the partitions' counts and the shards'
exact sizes. Each partition is permuted locally and cut by its row of the matrix, rows are exchanged, and
each shard is permuted again. The result is a uniformly random order with shard sizes at most one apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_SHARDS = 16
#: Rows of a table that may be broadcast.
MOST_SENT = 200_000


def _uniform(*parts: Column) -> Column:
    """A double in (0, 1) from a hash; 52 bits."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """Number of marked items among ``drawn`` of ``total``, by inversion of the exact distribution.

    Weights follow from the mode's, upwards and then downwards, by the ratios of neighbouring probabilities: over the whole
    support or, where that is wide, over 12 standard deviations on either side; what is beyond has less mass than
    a double's last bit.
    """
    n, m, d = (c.cast("double") for c in (total, marked, drawn))
    one = F.lit(1.0)
    mean = d * m / F.greatest(n, one)
    spread = 12 * F.sqrt(F.greatest(mean * (1 - m / F.greatest(n, one)), F.lit(0.0))) + 40
    low, high = F.greatest(F.lit(0.0), d + m - n, F.floor(mean - spread)), F.least(d, m, F.ceil(mean + spread))
    mode = F.least(F.greatest(F.floor((d + 1) * (m + 1) / (n + 2)), low), high)
    given = F.struct(n.alias("n"), m.alias("m"), d.alias("d"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), mode.cast("bigint").alias("mode"))

    def drawn_from(g: Column) -> Column:
        ratio = lambda k: (g["m"] - k) * (g["d"] - k) / ((k + 1) * (g["n"] - g["m"] - g["d"] + k + 1))
        none = F.array().cast("array<bigint>")
        up = F.when(g["mode"] < g["high"], F.sequence(g["mode"], g["high"] - 1)).otherwise(none)
        down = F.when(g["mode"] > g["low"], F.sequence(g["mode"] - 1, g["low"], F.lit(-1).cast("bigint"))).otherwise(none)
        sides = ((up, lambda w, k: w * ratio(k), 1), (down, lambda w, k: w / ratio(k), -1))

        def mass(ks: Column, step: Callable) -> Column:
            add = lambda s, k: _let(step(s["w"], k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))
            return F.aggregate(ks, F.struct(one.alias("w"), F.lit(0.0).alias("sum")), add, lambda s: s["sum"])

        def walk(state: Column, ks: Column, step: Callable, by: int) -> Column:
            start = F.struct(one.alias("w"), state["left"].alias("left"), F.when(state["left"] >= 0, g["mode"]).otherwise(state["k"]).alias("k"))
            take = lambda s, k: F.when(s["left"] < 0, s).otherwise(_let(step(s["w"], k), lambda w: F.struct(w.alias("w"), (s["left"] - w).alias("left"), (s["k"] + by).alias("k"))))
            return F.aggregate(ks, start, take)

        left = u * (1 + mass(*sides[0][:2]) + mass(*sides[1][:2])) - 1
        state = F.struct(one.alias("w"), left.alias("left"), g["mode"].alias("k"))
        for side in sides:
            state = _let(state, lambda s: walk(s, *side))  # noqa: B023 - the lambda is called at once
        return F.least(F.greatest(state["k"], g["low"]), g["high"])

    return _let(given, drawn_from)


def communication_matrix(counts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """From (part, n): (part, shard, first, last), the local ranks (from 1) that each partition sends to each shard.

    Shards' free places start at total / n_shards, rounded so that sizes are one apart at most. One row holds
    the partitions' counts, so its size is the number of partitions, not of rows.
    """
    shards = F.sequence(F.lit(0), F.lit(n_shards - 1))
    one = counts.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    size = lambda s: (F.floor(F.col("total") / n_shards) + F.when(s < F.col("total") % n_shards, 1).otherwise(0)).cast("bigint")
    longs = F.array().cast("array<bigint>")

    def sent(state: Column, p: Column) -> Column:
        """How many rows of one partition go to each shard, shard by shard, given the free places."""

        def cell(inner: Column, s: Column) -> Column:
            marked = F.element_at(state["free"], s + 1)
            x = _hypergeometric(_uniform(F.lit(seed), p["part"], s), inner["places"], marked, inner["rows"])
            return _let(x, lambda x: F.struct((inner["places"] - marked).alias("places"), (inner["rows"] - x).alias("rows"), F.concat(inner["sent"], F.array(x)).alias("sent")))

        places = F.aggregate(state["free"], F.lit(0).cast("bigint"), lambda a, x: a + x)
        start = F.struct(places.alias("places"), p["n"].cast("bigint").alias("rows"), longs.alias("sent"))
        return F.aggregate(shards, start, cell, lambda i: i["sent"])

    def fold(state: Column, p: Column) -> Column:
        take = lambda x: F.struct(F.zip_with(state["free"], x, lambda f, k: f - k).alias("free"), F.concat(state["rows"], F.array(F.struct(p["part"].cast("bigint").alias("part"), x.alias("sent")))).alias("rows"))
        return _let(sent(state, p), take)

    start = F.struct(F.transform(shards, size).alias("free"), F.array().cast("array<struct<part: bigint, sent: array<bigint>>>").alias("rows"))
    cells = one.select(F.explode(F.aggregate("parts", start, fold, lambda s: s["rows"])).alias("r")).select("r.part", F.posexplode("r.sent").alias("shard", "n"))
    w = Window.partitionBy("part").orderBy("shard")
    return cells.select("part", "shard", (F.sum("n").over(w) - F.col("n") + 1).alias("first"), F.sum("n").over(w).alias("last")).where("last >= first")


def pieces(rows: int) -> int:
    """Into how many parts rows are dealt: few enough for one row of counts, each small enough for one task."""
    return max(1, math.ceil(math.sqrt(max(rows, 0)) / 8))


def sent_whole(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast where its known number of rows is small; a join by shuffle otherwise."""
    return F.broadcast(df) if rows <= MOST_SENT else df


def shard(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 17, order_by: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard).

    Law: ``rows``, shard sizes are at most one apart. The order is a function of the rows' values in ``order_by`` (all columns
    where not given) and of the seed, so reruns agree; rows equal in all of them are interchangeable; more
    of them than a partition holds are dealt out by where they stand in the input. Nulls are values like others. An empty
    table gives none. Columns named ``shard`` and ``slot`` are replaced.

    ``docs`` has to yield its rows in the same order whenever a task runs again, as tables and checkpoints do.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    keys = order_by or own
    # where a row stands is numbered on the input itself, before any exchange
    held = docs.select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("at"), *(F.xxhash64(F.lit(seed + i), *(F.col(c) for c in keys)).alias(f"h{i}") for i in (0, 1)))
    total = docs.count()  # one number; it sets how many partitions there are
    n_parts = pieces(total)
    # rows equal in all keys share their hashes: groups above a partition's rows, at most n_parts of them, are dealt on
    hot = held.groupBy("h0", "h1").agg(F.count("*").alias("n")).where(F.col("n") > total / n_parts)
    hot = sent_whole(hot.select(F.col("h0").alias("g0"), F.col("h1").alias("g1")), n_parts)
    held = held.join(hot, (F.col("h0") == F.col("g0")) & (F.col("h1") == F.col("g1")), "left")
    salt = F.when(F.col("g0").isNotNull(), F.col("at")).otherwise(0)
    held = held.select("row", "h0", "h1", F.pmod(F.xxhash64(F.lit(seed), "h0", "h1", salt), F.lit(n_parts)).alias("part"))
    counts = held.groupBy("part").agg(F.count("*").alias("n"))
    cells = sent_whole(communication_matrix(counts, n_shards, seed).withColumnRenamed("part", "to_part"), n_parts * n_shards)
    local = Window.partitionBy("part").orderBy("h1", "h0", *(F.col(f"row.{c}") for c in keys))
    ranked = held.withColumn("rank", F.row_number().over(local))
    sent = ranked.join(cells, (F.col("part") == F.col("to_part")) & F.col("rank").between(F.col("first"), F.col("last")))
    n_blocks = pieces(total // n_shards)
    u = F.xxhash64(F.lit(seed + 2), "h0", "part", "rank")
    sent = sent.select("row", "shard", u.alias("u"), F.pmod(u, F.lit(n_blocks)).alias("block"), "part", "rank")
    sizes = sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("shard").alias("in_shard"), F.col("block").alias("in_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    again = Window.partitionBy("shard", "block").orderBy("u", "part", "rank")
    placed = sent.withColumn("at", F.row_number().over(again))
    placed = placed.join(sent_whole(bases, n_blocks * n_shards), (F.col("shard") == F.col("in_shard")) & (F.col("block") == F.col("in_block")))
    return placed.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("at") - 1).cast("long").alias("slot"))


def op6_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage_shard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of ``docs`` with their shard (0 to 15, sizes at most one apart) and slot. The id and a hash of the text stand for the whole row in its order.

    Null and empty texts and null ids are rows like others; rows equal in id and text are interchangeable. An empty table gives none. Columns named ``shard`` and
    ``slot`` are replaced; others stay.
    """
    name = "text_hash"
    while name in docs.columns:
        name += "_"
    return shard(docs.withColumn(name, F.xxhash64("text")), order_by=["doc_id", name]).drop(name)
