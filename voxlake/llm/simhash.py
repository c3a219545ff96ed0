"""SimHash near-duplicates by a vantage-point partition tree.

Fingerprints are distinct bit strings under Hamming distance. The upper tree sorts them into shards by their
distances to vantage points in a sub-metric (the distance over some bits only): by the pigeonhole principle fingerprints
within r bits agree on all bits of one of r + 1 fields, so their distances to any vantage point in that field are equal, and
one branch per field holds both. Shards that stay too large are split again by the distance to a
vantage point over all bits, into rings; fingerprints within the radius of the next ring are sent to that shard too.
Within a shard, a tree of vantage points prunes by the triangle inequality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm import filters, textops
from voxlake.llm.sharding import sent_whole
from voxlake.operators.components import Forest, connected_components
from voxlake.operators.skew import join_unique
from voxlake.storage import cut

SEED = 42
#: Fingerprints of a shard that is not split again; and of a leaf, where all pairs are compared.
SHARD_ROWS, LEAF = 20_000, 256
#: More than the rings of any shard: 64 * words + radius bits over rings of 2 * radius + 1.
N_RINGS = 1 << 10


def fingerprint(raw: bytes, k: int, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """64 bits for each seed, signed: a bit is set if it is in over half of the hashes of the k-word shingles, repeats included."""
    w = raw.lower().split()
    if not w:
        return [0] * len(seeds)
    joined = b" ".join(w)
    if len(w) <= k:
        shingles = [joined]
    else:
        size = np.fromiter(map(len, w), np.int64, len(w)) + 1
        end = np.cumsum(size)
        shingles = [joined[a:b] for a, b in zip((end - size)[: len(w) - k + 1].tolist(), (end - 1)[k - 1 :].tolist(), strict=True)]
    out = []
    for seed in seeds:
        digest = b"".join([xxhash.xxh64_digest(s, seed) for s in shingles])
        ones = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True))
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", k: int = 4, words: int = 1) -> DataFrame:
    """Every row with ``f0``, ``f1``...: ``words`` 64-bit fingerprints. Null and empty texts have zeros."""
    seeds = tuple(SEED + i for i in range(words))

    @F.pandas_udf("array<bigint>")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t.encode() if isinstance(t, str) else b"", k, seeds) for t in texts], dtype=object)

    out = docs.withColumn("f", printed(F.col(text_col)))
    return out.select(*(c for c in docs.columns), *(F.col("f")[i].alias(f"f{i}") for i in range(words)))


def fields(bits: int, radius: int, n: int) -> list[np.ndarray]:
    """Exact: sets of bits of which two fingerprints within ``radius`` agree on at least one.

    The bits are cut into radius + 1 fields; into more, of which all but ``radius`` are joined, where so many fingerprints
    would share a field.
    """
    extra = 1
    while math.comb(radius + extra + 1, radius) <= 40 and (bits * extra / (radius + extra)) < math.log2(max(n, 2)) - 6:
        extra += 1
    cuts = np.array_split(np.arange(bits), radius + extra)
    from itertools import combinations

    return [np.sort(np.concatenate(c)) for c in combinations(cuts, extra)]


def samples(bits: int, radius: int, n: int, recall: float, apart: float, seed: int = 5) -> list[np.ndarray]:
    """Random sets of bits, as many as it takes to find a pair with probability ``recall``: to differ in ``radius`` bits at most and to agree on one of the sets,
    where each bit differs with probability ``apart``. A set's size grows with the logarithm of the number n of fingerprints."""
    # about 2**8 fingerprints agree on a set by chance: comparing those costs less than the trees that larger sets would need
    size = max(8, math.ceil(math.log2(max(n, 2))) - 8)
    at = [(math.comb(bits, d) * apart**d * (1 - apart) ** (bits - d), math.comb(bits - d, size) / math.comb(bits, size)) for d in range(radius + 1)]
    if sum(p for p, _ in at) <= recall:
        raise ValueError("the radius is too small for this recall")
    count = 1
    while sum(p * (1 - (1 - same) ** count) for p, same in at) < recall:
        count += 1
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, size, replace=False)) for _ in range(count)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of fingerprints; the last axis holds their 64-bit words."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for w in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


def _masks(sets: list[np.ndarray], words: int) -> np.ndarray:
    out = np.zeros((len(sets), words), np.uint64)
    for i, bits in enumerate(sets):
        for b in bits.tolist():
            out[i, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return out


def _within(f: np.ndarray, at: np.ndarray, radius: int, forest: Forest) -> None:
    """Link all pairs within the radius among f[at]: split by the distance to a vantage point; pairs across lie in the boundary shells."""
    todo = [(at, None)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) <= LEAF:
                i, j = np.nonzero(np.triu(distance(f[a][:, None], f[a][None]) <= radius, 1))
                forest.join(a[i], a[j])
                continue
            d = distance(f[a], f[a[len(a) // 2]])
            mid = np.median(d)
            inner = d <= mid if (d > mid).any() else d < mid
            if not inner.any() or inner.all():
                inner = np.arange(len(a)) < len(a) // 2
                todo += [(a[inner], None), (a[~inner], None), (a[inner], a[~inner])]
                continue
            edge = d[inner].max()
            todo += [(a[inner], None), (a[~inner], None), (a[inner & (d >= edge + 1 - radius)], a[~inner & (d <= edge + radius)])]
        elif len(a) and len(b):
            if len(a) <= LEAF and len(b) <= LEAF:
                i, j = np.nonzero(distance(f[a][:, None], f[b][None]) <= radius)
                forest.join(a[i], b[j])
                continue
            if len(a) < len(b):
                a, b = b, a
            v = f[a[len(a) // 2]]
            da, db = distance(f[a], v), distance(f[b], v)
            mid = np.median(da)
            inner = da <= mid if (da > mid).any() else da < mid
            if not inner.any() or inner.all():
                inner = np.arange(len(a)) < len(a) // 2
                todo += [(a[inner], b), (a[~inner], b)]
                continue
            # the triangle inequality: a partner's distance to v differs by the radius at most
            for part in (inner, ~inner):
                todo.append((a[part], b[(db >= da[part].min() - radius) & (db <= da[part].max() + radius)]))


def _links(f: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within equal keys. Short runs are compared at every offset at once."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    forest = Forest(len(f))
    short = np.repeat(size <= 32, size)
    left = np.repeat(begin + size, size) - np.arange(len(key)) - 1  # how many of the run follow
    for k in range(1, int(size[size <= 32].max(initial=1))):
        i = np.flatnonzero(short & (left >= k))
        a, b = order[i], order[i + k]
        near = distance(f[a], f[b]) <= radius
        forest.join(a[near], b[near])
    for s, n in zip(begin[size > 32], size[size > 32], strict=True):
        _within(f, order[s : s + n], radius, forest)
    child = np.flatnonzero(forest.label != np.arange(len(f)))
    return child, forest.label[child]


def number(cols: list[str]) -> Column:
    """A number for each distinct fingerprint: itself, or a hash where it is longer."""
    return F.col(cols[0]) if len(cols) == 1 else F.xxhash64(*cols)


def near_links(prints: DataFrame, radius: int, sets: list[np.ndarray], words: int = 1, shard_rows: int = SHARD_ROWS, n: int | None = None) -> DataFrame:
    """(a, b): links of distinct fingerprints (f0, f1...), by their numbers, within ``radius`` bits that agree on one of ``sets``; a spanning forest
    of each shard's, so every two fingerprints linked by a chain of such pairs are linked by a chain of these. ``n``: how many fingerprints there are, counted if it isn't given; it
    bounds the large shards, whose table is sent to all tasks only while it is small."""
    cols = [f"f{i}" for i in range(words)]
    masks = _masks(sets, words)
    rng = np.random.default_rng(11)
    vantage = rng.integers(0, 1 << 64, (4, words), dtype=np.uint64)  # random points: their rings depend on no data
    paths = 65 ** len(vantage)
    schema = f"shard long, {', '.join(c + ' long' for c in cols)}"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pdf[cols].to_numpy().view(np.uint64).reshape(len(pdf), words)
            for t, m in enumerate(masks):
                path = np.zeros(len(pdf), np.int64)
                for v in vantage:
                    path = path * 65 + distance(f & m, v & m)
                yield pd.DataFrame({"shard": t * paths + path, **{c: pdf[c] for c in cols}})

    dealt = prints.select(*cols).mapInPandas(deal, schema)
    big = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select(F.col("shard").alias("s"))
    most = (prints.count() if n is None else n) * len(masks) // shard_rows  # a row for each shard_rows dealt rows
    big = dealt.join(sent_whole(big, most), F.col("shard") == F.col("s")).groupBy("s").agg(F.min(F.struct(*cols)).alias("v"))
    near = [F.bit_count(F.col(c).bitwiseXOR(F.col("v")[c])) for c in cols]
    width = 2 * radius + 1
    d = sum(near[1:], near[0])
    rings = F.when(F.col("v").isNull(), F.array(F.lit(0))).otherwise(F.array_distinct(F.array(F.floor(d / width).cast("int"), F.floor((d + radius) / width).cast("int"))))
    split = dealt.join(sent_whole(big, most), F.col("shard") == F.col("s"), "left").withColumn("ring", F.explode(rings))
    # one number names a tree's shard's ring: the rows that are exchanged hold nothing but it and the fingerprint
    split = split.select((F.col("shard") * N_RINGS + F.col("ring")).alias("shard"), *cols)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            f = pdf[cols].to_numpy().view(np.uint64).reshape(len(pdf), words)
            tree, ring = np.divmod(pdf["shard"].to_numpy(), paths * N_RINGS)
            m = f & masks[tree]
            key = tree.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (ring % N_RINGS).astype(np.uint64)
            for w in range(words):  # the tree's last levels: only equal fields can be near
                key = textops.mix(key + m[:, w])
            ids = pdf["id"].to_numpy()
            a, b = _links(f, key, radius)
            return pd.DataFrame({"a": ids[a], "b": ids[b]}).drop_duplicates()

        # a partition comes sorted by shard; whole shards are taken together up to a number of rows
        last, rows = None, 0
        for pdf in batches:
            name = pdf["shard"]
            starts = np.flatnonzero(np.concatenate([[name.iloc[0] != last if len(name) else False], name.to_numpy()[1:] != name.to_numpy()[:-1]])) if len(name) else []
            at = 0
            for s in starts:
                if rows + (s - at) >= shard_rows:
                    held.append(pdf.iloc[at:s])
                    yield done()
                    held, rows, at = [], 0, s
            if len(pdf):
                held.append(pdf.iloc[at:])
                rows += len(pdf) - at
                last = name.iloc[-1]
        if held:
            yield done()

    exchanged = split.repartition("shard").sortWithinPartitions("shard").withColumn("id", number(cols))
    return exchanged.mapInPandas(link, "a long, b long")


def components(printed: DataFrame, id_col: str, radius: int, words: int = 1, recall: float | None = None, apart: float = 0.0) -> DataFrame:
    """From rows with an id and fingerprints: (f0, f1..., component, rows): the smallest id that a chain of links within ``radius`` reaches."""
    cols = [f"f{i}" for i in range(words)]
    distinct = printed.groupBy(*cols).agg(F.min(id_col).alias("smallest"), F.count("*").alias("rows"))
    distinct = cut(distinct.withColumn("id", number(cols)))
    n = distinct.count()
    sets = fields(64 * words, radius, n) if recall is None else samples(64 * words, radius, n, recall, apart)
    linked = cut(connected_components(near_links(distinct, radius, sets, words, n=n)))
    # fingerprints that nothing is linked to keep their own smallest id
    member = distinct.join(linked.withColumnRenamed("node", "id"), "id", "left")
    linked_rows = member.where("component is not null")
    low = linked_rows.groupBy("component").agg(F.min("smallest").alias("low"), F.count("*").alias("n"))
    named = join_unique(linked_rows, low, ["component"], "n", n).select(*cols, F.col("low").alias("component"), "rows")
    return named.union(member.where("component is null").select(*cols, F.col("smallest").alias("component"), "rows"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, words: int = 1, recall: float | None = None, apart: float = 0.0) -> DataFrame:
    """(id, f0..., component) for every row of ``docs``.

    Fingerprints at most ``radius`` bits apart are linked; the component is the smallest id that links reach, the row's own
    included. ``recall`` None finds every link; else a pair whose bits differ each with probability ``apart`` is found with that probability, a closer
    one more likely.

    Null and empty texts have the fingerprint zero and are linked like any others. Repeated rows get equal results each. Null ids are
    passed over when the smallest is taken; a component of null ids only has a null component. Texts are read
    whole. An empty table gives none. Other columns of ``docs`` do not matter.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cols = [f"f{i}" for i in range(words)]
    printed = cut(with_fingerprint(own, "text", k, words).drop("text"))
    found = cut(components(printed, "id", radius, words, recall, apart))
    return join_unique(printed, found, cols, "rows", printed.count()).select(F.col("id").alias(id_col), *cols, "component")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    r = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def shingles(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each text's distinct k-word shingles, in lower case; a shorter text is one shingle."""
    docs, hashes = [], []
    for first, raw in textops.chunks(texts, lower=True):
        w = textops.words(raw)
        h = np.append(w.hashes(), np.uint64(0))
        n = np.diff(w.offset)
        count = np.maximum(n - k + 1, 1)
        doc = np.repeat(np.arange(len(raw)), count)
        at = w.offset[doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        size = np.minimum(n, k)[doc]
        s = size.astype(np.uint64)
        for j in range(k):
            s = textops.mix(s * np.uint64(0x9E3779B97F4A7C15) + np.where(j < size, h[np.minimum(at + j, len(h) - 1)], np.uint64(0)))
        order = np.lexsort((s, doc))
        doc, s = doc[order], s[order]
        once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])])
        docs.append(doc[once] + first)
        hashes.append(s[once])
    return np.concatenate(docs), np.concatenate(hashes)


def _similar(texts: list, group: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of a left and a right text of equal group whose shingle sets' cosine, the common ones over the root of the product of sizes, is at least p / q."""
    doc, s = shingles(texts, k)
    size = np.bincount(doc, minlength=len(texts))
    held = textops.mix(s + group[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(held, kind="stable")  # texts ascend within each shingle
    held, doc = held[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    runs = np.diff(np.append(begin, len(held)))
    run = np.repeat(runs, runs)
    following = np.repeat(begin + runs, runs) - np.arange(len(held)) - 1
    n = len(texts)
    common = np.zeros((n, n), np.int32)
    for o in range(1, int(runs[runs <= 32].max(initial=1))):
        at = np.flatnonzero((run <= 32) & (following >= o))
        np.add.at(common.ravel(), doc[at] * n + doc[at + o], 1)
    # shingles of many texts: products of the columns of a table
    of, rows = np.unique(held[run > 32], return_inverse=True)[1], doc[run > 32]
    for c in range(0, int(of.max(initial=-1)) + 1, 1024):
        at = slice(*np.searchsorted(of, [c, c + 1024]))
        table = np.zeros((n, 1024), np.float32)
        table[rows[at], of[at] - c] = 1
        common += np.triu(table @ table.T, 1).astype(np.int32)
    i, j = np.nonzero(common)
    p, q = similarity
    # c / sqrt(|a| |b|) >= p / q, in whole numbers
    near = (q * common[i, j].astype(np.int64)) ** 2 >= p * p * size[i] * size[j]
    near &= left[i] & right[j] | left[j] & right[i]
    forest = Forest(len(texts))
    forest.join(i[near], j[near])
    child = np.flatnonzero(forest.label != np.arange(len(texts)))
    return child, forest.label[child]


def similar_links(texts: DataFrame, k: int, similarity: tuple[int, int], block: int) -> DataFrame:
    """(a, b): links of the texts (h, text, c, m), by their hashes h, within each candidate group c of m texts, compared exactly; they join
    what all pairs join. Groups of more than ``block`` texts are dealt in blocks, and every two blocks meet in a task."""
    blocks = F.ceil(F.col("m") / block)
    dealt = texts.select("h", "text", "c", blocks.alias("blocks"), F.pmod(F.xxhash64("h"), blocks).alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("c", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "h", "text")

    def groups(pdf: pd.DataFrame) -> np.ndarray:
        """Where each (c, x, y) begins."""
        at = pdf[["c", "x", "y"]].to_numpy()
        return np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))

    def linked(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = groups(pdf)
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
        edge = starts[np.unique(starts // block, return_index=True)[1]]  # whole groups, about a block of rows at a time
        for s, e in zip(edge, np.append(edge[1:], len(pdf)), strict=True):
            part = pdf.iloc[s:e]
            own, h = part["own"].to_numpy(), part["h"].to_numpy()
            a, b = _similar(part["text"].tolist(), number[s:e], own == part["x"].to_numpy(), own == part["y"].to_numpy(), k, similarity)
            yield pd.DataFrame({"a": h[a], "b": h[b]})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = groups(rest)[-1]
            if last:
                yield from linked(rest.iloc[:last])
                rest = rest.iloc[last:]
        if rest is not None:
            yield from linked(rest)

    return dealt.repartition("c", "x", "y").sortWithinPartitions("c", "x", "y").mapInPandas(verify, "a long, b long")


#: The least similarity of linked texts: the cosine of their sets of 5-word shingles, which SimHash measures: a bit differs with probability arccos(0.8) / pi, so
#: 52 of 256 differ on average at 0.8. Candidates may differ in two and a half standard deviations more; a pair at 0.8 is proposed with ``recall``.
SIMILARITY = (4, 5)
STAGE = {"k": 5, "radius": 68, "words": 4, "recall": 0.95, "apart": math.acos(SIMILARITY[0] / SIMILARITY[1]) / math.pi}
#: Texts that are compared at once.
BLOCK = 1000


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; of rows equal in id and text one stays, and of equal ids the text with the smallest hash.

    Chains of near fingerprints only propose groups of texts; within a group texts are linked where the cosine of their
    sets of 5-word shingles is at least 0.8.

    Null and empty texts are one group each with the texts that have no words. Null ids are an id, the smallest. Columns of other names do not matter. An empty table gives none.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"), F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("key"))
    ids = keyed.select("key", "text")
    printed = near_duplicates(ids.withColumn("n", F.col("key")), "n", "text", **STAGE).select("n", F.col("n.h").alias("h"), F.xxhash64("component").alias("c"))
    per = cut(printed.groupBy("c", "h").agg(F.count("*").alias("rows"), F.min("n").alias("n")))
    groups = per.groupBy("c").agg(F.count("*").alias("m"), F.sum("rows").alias("rows")).where("rows > 1").select("c", "m", F.col("m").alias("mine"))
    members = cut(join_unique(per.select("c", "h"), groups, ["c"], "mine", per.count()))
    # rows that are alone in their group go past the exchanges; the filter lets some of them through, which does not matter
    maybe = filters.tester(members, "h")
    keyed = keyed.withColumn("maybe", maybe(F.col("key.h")))
    held = keyed.where("maybe")
    texts = held.select(F.col("key.h").alias("h"), "text").groupBy("h").agg(F.first("text").alias("text")).join(members.where("m > 1"), "h")
    linked = connected_components(similar_links(texts, STAGE["k"], SIMILARITY, BLOCK)).withColumnRenamed("node", "h")
    keep = per.join(linked, "h", "left").groupBy(F.coalesce("component", "h")).agg(F.min("n").alias("key")).select("key")
    kept = held.join(keep, "key").dropDuplicates(["key"]).select("row.*")
    return keyed.where("not maybe").select("row.*").union(kept)
