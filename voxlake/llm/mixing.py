"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Each source's documents, in a shuffled order, form one stream of words, cut into blocks of equal numbers of words.
Slot t of the schedule has the point frac(t * golden ratio); the sources' shares of slots, laid end to end on [0, 1),
say which source it falls to. The r-th slot of a source takes its block r, round and round. The mixed corpus is the blocks in the
order of their slots, so that every run of slots, not only the whole, holds the sources near their shares.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from voxlake.llm.sharding import sent_whole
from voxlake.storage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: The sources' weights, in order, repeating.
WEIGHTS = (3, 1, 2)
#: The fractional part of the golden ratio, in units of 2**-32; odd, so that points are distinct for 2**32 slots.
GOLDEN = 2654435769
#: Words of a block of a large source; a source is cut into FEWEST blocks at least.
BLOCK_WORDS, FEWEST = 4096, 64
#: Equal rows that are placed in the order as one.
COPIES = 64
#: Slots whose ranks are counted together.
RUN = 1 << 14


def sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, size): one row per source with source_size, weight, target, and its blocks.

    Sources stand in code-point order, null last; they are ranked in one task, a row for each. Targets are weight * level, at most ``most`` times the source's size; the
    level is where they add up to ``share`` of all sizes. Sorting sources by most * size / weight, the first k are full, for
    the smallest k at which the next one is not.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row for each source
    number = F.row_number().over(order)
    per = per.withColumn("number", number).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("number") - 1) % len(weights) + 1).cast("int")))
    full = most * F.col("source_size")
    by_ratio = Window.orderBy(full / F.col("weight"), "number")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # a source is not full if the level, with all before it full, is within its limit
    per = per.withColumn("level", F.when(level * F.col("weight") < full, level))
    per = per.withColumn("target", F.least(full, F.coalesce(F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(full / F.col("weight"), "number"))).over(everything) * F.col("weight"), full)))
    blocks = F.least(F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(FEWEST)), F.col("source_size")).cast("long")
    per = per.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("blocks") > 0, F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    return per.select("number", "source", "source_size", "rows", "weight", "target", "blocks", "slots")


def schedule(per: DataFrame) -> DataFrame:
    """(slot, number, block, epoch): which block of which source fills each slot, without gaps among a source's ranks.

    Each source gets exactly its slots: later points that fall to it are passed over, and slots that the points leave it short
    of, a few for each source, follow at the end.
    """
    spark = per.sparkSession
    total, n_sources = per.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    w = Window.orderBy("number")
    upto = F.sum("slots").over(w)
    per = per.withColumn("low", F.floor((upto - F.col("slots")) / F.lit(float(max(total, 1))) * (1 << 32)).cast("long")).withColumn("high", F.floor(upto / F.lit(float(max(total, 1))) * (1 << 32)).cast("long"))
    point = F.pmod((F.col("id") % (1 << 30)) * F.lit(GOLDEN) + F.floor(F.col("id") / (1 << 30)) * F.lit((1 << 30) * GOLDEN % (1 << 32)), F.lit(1 << 32))
    points = spark.range(total).select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / RUN).alias("run"))
    # ranges and points meet in equal steps of [0, 1), many for each source
    step = max(8, 24 - n_sources.bit_length())
    cell = lambda c: F.shiftright(c, step)
    ranges = per.where("high > low").select("number", "slots", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    points = points.withColumn("cell", cell(F.col("point")))
    dealt = points.join(ranges, "cell").where("point >= low and point < high").select("slot", "run", "number", "slots", "blocks")
    runs = dealt.groupBy("number", "run").agg(F.count("*").alias("n"))
    run_order = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("number", "run", F.coalesce(F.sum("n").over(run_order), F.lit(0)).alias("base"))
    in_run = Window.partitionBy("number", "run").orderBy("slot")
    ranked = dealt.withColumn("at", F.row_number().over(in_run)).join(bases, ["number", "run"])
    ranked = ranked.select("slot", "number", "blocks", (F.col("base") + F.col("at") - 1).alias("rank"), "slots").where("rank < slots").drop("slots")
    have = runs.groupBy("number").agg(F.sum("n").alias("have"))
    short = per.join(have, "number", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    short = short.withColumn("first", F.sum(F.col("slots") - F.col("have")).over(w) - (F.col("slots") - F.col("have")))
    more = short.select("number", "blocks", "have", "first", F.explode(F.sequence("have", F.col("slots") - 1)).alias("rank"))
    more = more.select((F.lit(total) + F.col("first") + F.col("rank") - F.col("have")).alias("slot"), "number", "blocks", "rank")
    both = ranked.unionByName(more)
    return both.select("slot", "number", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def segments(sized: DataFrame, per: DataFrame, key: list[str], n_rows: int, seed: int = 29) -> DataFrame:
    """(number, block, key..., size, group, copy, first, words): the words of each document in each block of its source's shuffled stream.

    Rows equal in key, source and size are counted first; they are copies 0, 1... of one another, COPIES of them to a group. The order is by a
    hash of key and group. Positions are summed within buckets of that hash first, about as many rows to each, so no source is summed in one place.
    """
    mine = per.select("number", F.col("source").alias("of"), "source_size", "rows", "blocks")
    equal = sized.where("size > 0").groupBy("source", "size", *key).agg(F.count("*").alias("copies"))
    rows = equal.join(sent_whole(mine, per.count()), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    rows = rows.withColumn("n", F.least(F.col("copies") - F.col("group") * COPIES, F.lit(COPIES)) * F.col("size"))
    h = lambda s: F.xxhash64(F.lit(s), "size", "group", *(F.col(c) for c in key))
    buckets = F.ceil(F.col("rows") * 8 / math.sqrt(max(n_rows, 1)))
    rows = rows.select("number", "source_size", "blocks", "size", "group", "n", *key, h(seed).alias("h"), F.pmod(h(seed + 1), buckets).alias("bucket"))
    sums = rows.groupBy("number", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("number", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("number", "bucket").orderBy("h", *key, "size", "group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n").over(within)).join(bases, ["number", "bucket"])
    placed = placed.withColumn("a", F.col("base") + F.col("upto") - F.col("n")).withColumn("z", F.col("base") + F.col("upto"))
    edge = lambda k: F.expr(f"cast({k} as decimal(38, 0)) * source_size div blocks")  # noqa: E731 - exact: block k begins here
    of = lambda c: F.expr(f"((cast({c} as decimal(38, 0)) + 1) * blocks - 1) div source_size")  # noqa: E731 - the last block that begins by this word
    cut_up = placed.withColumn("block", F.explode(F.sequence(of("a"), of("z - 1"))))
    begin, end = F.greatest(F.col("a"), edge("block")), F.least(F.col("z"), edge("(block + 1)"))
    cut_up = cut_up.withColumn("b", (begin - F.col("a")).cast("long")).withColumn("e", (end - F.col("a")).cast("long")).where("e > b")
    cut_up = cut_up.withColumn("copy", F.explode(F.expr("sequence(b div size, (e - 1) div size)")))
    first = F.greatest(F.col("b") - F.col("copy") * F.col("size"), F.lit(0))
    words = F.least(F.col("e") - F.col("copy") * F.col("size"), F.col("size")) - first
    return cut_up.select("number", "block", *key, "size", "group", (F.col("group") * COPIES + F.col("copy")).alias("copy"), first.alias("first"), words.alias("words"))


def with_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def mix(sized: DataFrame, key: list[str], source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, the schedule, and the documents' segments, of documents with ``key``, ``source_col`` and ``size`` (words).

    Joining the schedule with the segments on number and block gives the mixed corpus in slot order. A source's words in
    the mix differ from its target by at most half a block: of 4096 words, or a 64th of a smaller source. No row is
    taken more than ``most`` (rounded up) times. Everything is a function of the rows and the weights, so reruns agree.

    A null source is a source, the last; null keys are keys. Rows without words are in no segment. Rows equal in key, source and size are
    taken each for itself, as copies 0, 1...; they are interchangeable. An empty table gives empty results. ``sized`` needs no other columns.
    """
    sized = sized.withColumnRenamed(source_col, "source") if source_col != "source" else sized
    per = cut(sources(sized, weights, share, most))
    return per, schedule(per), segments(sized, per, key, sized.count())


def slots_of(slots: DataFrame) -> DataFrame:
    """(number, block, slots): the slots of each block in order, as many as its source's epochs at most."""
    return slots.groupBy("number", "block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = cut(with_size(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("text"))
    per, slots, parts = mix(docs, ["doc_id"])
    placed = parts.join(slots_of(slots), ["number", "block"], "left")
    times = F.coalesce(F.size("slots"), F.lit(0))
    # how many words a document has in the mix, and the slots of the first and the last of them
    taken = placed.groupBy("number", "doc_id", "size", "copy").agg(
        F.sum(F.col("words") * F.when(F.col("slots").isNull(), 0).otherwise(times)).alias("taken"), F.min(F.col("slots")[0]).alias("first_slot"), F.max(F.element_at("slots", -1)).alias("last_slot")
    )
    mine = per.select("number", "source", "source_size", "target")
    out = taken.join(sent_whole(mine, per.count()), "number").select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")
    wordless = docs.where("size = 0").join(sent_whole(mine.drop("number").withColumnRenamed("source", "of"), per.count()), F.col("source").eqNullSafe(F.col("of")))
    nothing = F.lit(None).cast("long")
    return out.union(wordless.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long"), nothing, nothing))


@F.pandas_udf(ArrayType(StructType().add("slot", "long").add("first", "long").add("piece", "string")))
def cut_words(text: pd.Series, size: pd.Series, taken: pd.Series) -> pd.Series:
    """Each (slot, first, words) of ``taken`` with the text from word ``first`` up to where the word after ``words`` more begins; the whole text where all is taken."""
    out = []
    for t, n, pieces in zip(text, size, taken, strict=True):
        whole = all(p["words"] == n for p in pieces)
        at = [] if whole else [m.start() for m in re.finditer(WORD, t)]
        rows = []
        for p in pieces:
            a, z = p["first"], p["first"] + p["words"]
            piece = t if p["words"] == n else t[at[a] if a else 0 : at[z] if z < n else len(t)]
            rows.append({"slot": p["slot"], "first": a, "piece": piece})
        out.append(rows)
    return pd.Series(out, dtype=object)


def stage_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus in the order of the schedule's slots: one row for each piece of a document in each slot, with the document's columns
    and the piece as its text (``n_chars``, where there is one, is the piece's).

    Rows are sorted by slot, then by document, in partitions that follow each other; a document that is taken twice is there twice, in two slots.
    Null and empty texts have no words and are not taken; a null source is a source, null ids are ids. Rows equal in all columns are taken each for itself;
    rows equal in id, text and source that differ in another column count as copies, of which one's columns are shown. An empty table gives none.
    Columns other than source, text, n_chars are the document's own.
    """
    key = ["k0", "k1"]
    others = [c for c in docs.columns if c != "text"]
    keyed = with_size(docs.select(F.struct(*others).alias("row"), "text", "source", *(F.xxhash64(F.lit(i), "doc_id", "text", "source").alias(k) for i, k in enumerate(key))))
    sized = cut(keyed.select(*key, "source", "size"))
    per, slots, parts = mix(sized, key)
    total = per.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    taken = parts.join(slots_of(slots), ["number", "block"]).select(*key, "group", F.explode("slots").alias("slot"), "first", "words")
    # at most COPIES copies of a text in a row
    taken = taken.groupBy(*key, "group").agg(F.collect_list(F.struct("slot", "first", "words")).alias("taken"))
    joined = keyed.dropDuplicates(key).join(taken, key)
    cut_up = joined.select("row", *key, F.explode(cut_words("text", "size", "taken")).alias("p"))
    # every slot holds about as many words, so equal runs of slots make equal partitions; the few slots from ``total`` on are the last's
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = F.least(F.expr(f"p.slot * {n} div {max(total, 1)}"), F.lit(n - 1)).cast("int")
    in_order = cut_up.repartitionById(n, run).sortWithinPartitions("p.slot", *key, "p.first")
    piece = {"text": F.col("p.piece"), "n_chars": F.length("p.piece").cast("long")}
    return in_order.select(*((piece[c] if c in piece else F.col("row")[c]).alias(c) for c in docs.columns))
