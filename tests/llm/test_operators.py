import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxlake.llm import chat, decontaminate, katz, licenses, mixing, pii, quality, queries, records, sharding, simhash

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", None), (3, "x", "a"), (3, "x", "a"), (None, "one two three", "b"), (4, "w " * 9000, "b"), (5, "mail a@b.co or +1 (234) 555-0000", "b"), (6, "é ß MIT License.\n\nMIT License.", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    names = ("key", "kind", "f", "id", "size", "h", "shard", "leaks", "license", "repetition")
    return df.select("*", *(F.lit("clash").alias(n) for n in names))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, odd, empty):
    docs = odd.where("false") if empty else odd
    n = 0 if empty else len(ODD)
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string")
    assert pii.sanitise(docs).count() == n
    leaks = decontaminate.contamination(docs, items)
    assert leaks.count() == n and leaks.where("size(leaks) > 0").count() == (0 if empty else 1)
    assert simhash.near_duplicates(docs).count() == n
    assert quality.repetition(docs).count() == n
    assert licenses.license_scan(docs).count() == n
    placed = sharding.shard(docs.drop("shard"), 3).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sum(r.n for r in placed) == n and all(r.m == r.n - 1 for r in placed) and max([r.n for r in placed], default=0) - min([r.n for r in placed], default=0) <= 1
    sized = mixing.with_size(docs.drop("size")).select("doc_id", "source", "size", "text")
    per, slots, parts = mixing.mix(sized, ["doc_id"])
    slots.count(), parts.count()
    assert per.count() == (0 if empty else 3)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert rows(ours) == rows(theirs)


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (None, 0, "user", "")]
    kept = chat.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert sorted({r.conv for r in kept.collect()}, key=str) == [2, 4, None]


def test_luhn_and_bounds():
    kinds = [(k, t) for k, t in ((s[0], x[s[1] : s[2]]) for x in ("4111 1111 1111 1111", "4111 1111 1111 1112", "256.1.1.1", "10.0.0.255", "+1 234 555 0000", "a.b@c-d.e.f") for s in pii.base_spans(x))]
    assert kinds == [("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255"), ("phone", "+1 234 555 0000"), ("email", "a.b@c-d.e.f")]


def test_links_equal_brute_force():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    f = np.concatenate([f, f[:100] ^ np.uint64(5), f[:50] ^ np.uint64(1 << 40 | 3 << 9)]).reshape(-1, 1)
    forest = simhash.Forest(len(f))
    simhash._within(f, np.arange(len(f)), 4, forest)
    label = np.arange(len(f))
    near = simhash.distance(f[:, None], f[None]) <= 4
    for _ in range(20):
        label = np.where(near, label[None], len(f)).min(axis=1)
    assert (forest.label[forest.label] == label).all()
    sets = simhash.fields(64, 4, 10**6)
    masks = simhash._masks(sets, 1)[:, 0]
    i, j = np.nonzero(near)
    assert (((f[i, 0] ^ f[j, 0])[:, None] & masks[None]) == 0).any(axis=1).all()


def test_hypergeometric_matrix_is_exact(spark):
    counts = spark.createDataFrame([(k, 37 + k % 3) for k in range(11)], "part long, n long")
    m = sharding.communication_matrix(counts, 4, 3).toPandas()
    m["k"] = m["last"] - m["first"] + 1
    total = sum(37 + k % 3 for k in range(11))
    assert (m.groupby("part").k.sum() == [37 + k % 3 for k in range(11)]).all()
    assert sorted(m.groupby("shard").k.sum()) == sorted(total // 4 + (s < total % 4) for s in range(4))


def test_records_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = records.op5_token_records(spark, SF).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for (i, text), r in zip(docs.itertuples(index=False), got.itertuples(index=False), strict=True):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (r.doc_id, r.start, r.n_tokens, r.ids_crc32)
        at += len(ids)


@pytest.mark.parametrize("words,radius", [(1, 4), (4, 50)])
def test_links_of_split_shards_join_what_all_pairs_join(spark, words, radius):
    """Shards above 40 rows are split into rings; a third of the fingerprints are near copies of one."""
    rng = np.random.default_rng(words)
    f = rng.integers(0, 1 << 64, (300, words), dtype=np.uint64)
    for i in range(200, 300):
        f[i] = f[0]
        for b in rng.choice(64 * words, radius // 2, replace=False).tolist():
            f[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    f = np.unique(f, axis=0)
    cols = [f"f{i}" for i in range(words)]
    df = spark.createDataFrame(pd.DataFrame(f.view(np.int64), columns=cols)).withColumn("id", simhash.number(cols))
    sets = simhash.fields(64, radius, len(f)) if words == 1 else simhash.samples(64 * words, radius, len(f), 0.9999, 0.1)
    numbers = {tuple(r[c] for c in cols): r["id"] for r in df.collect()}
    ids = [numbers[tuple(row)] for row in f.view(np.int64).tolist()]
    forest, theirs = simhash.Forest(len(f)), simhash.Forest(len(f))
    forest.join(*np.nonzero(np.triu(simhash.distance(f[:, None], f[None]) <= radius, 1)))
    links = simhash.near_links(df, radius, sets, words, shard_rows=40).toPandas()
    at = {v: i for i, v in enumerate(ids)}
    theirs.join(links["a"].map(at).to_numpy(), links["b"].map(at).to_numpy())
    assert (forest.label == theirs.label).all() and (forest.label != np.arange(len(f))).any()


@pytest.mark.parametrize("block", [1000, 7])
def test_near_dedup_equals_exact_similarity(spark, monkeypatch, block):
    """Planted pairs at 0.5 to 0.95, a group that shares half of its words, a chain, copies and odd rows, against all pairs' shingles."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setitem(simhash.STAGE, "recall", 0.99)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = [None, "", "", "One two", "one  TWO", "one two three"]
    for j in np.repeat([0.5, 0.6, 0.7, 0.75, 0.78, 0.88, 0.92, 0.96], 12):
        own = word(300)
        n = round(296 * (1 - j))  # changed at the end: a share j of each text's shingles is common
        texts += [" ".join(own), " ".join(own[: 300 - n] + word(n))]
    shared = word(100)
    texts += [" ".join(shared + word(50)) for _ in range(40)]
    chain = word(300)
    texts += [" ".join(chain[i * 15 : i * 15 + 200]) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (7, texts[7]), (7, "another text of that id"), (900, texts[8])]

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    every = [sets(t) for _, t in rows]
    forest = simhash.Forest(len(rows))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 25 * len(every[i] & every[j]) ** 2 >= 16 * len(every[i]) * len(every[j])]
    forest.join(*(np.array(x) for x in zip(*near, strict=True)))
    per = {}
    for (i, t), label in zip(rows, forest.label.tolist(), strict=True):
        per.setdefault(label, []).append((i is not None, -1 if i is None else i, t))
    got = simhash.stage_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert len(got) == len(per)
    assert sorted((r.doc_id is not None, r.doc_id or -1) for r in got) == sorted((a, i or -1) for a, i, _ in (min(v, key=lambda x: x[:2]) for v in per.values()))


@pytest.mark.parametrize("n", [10**4, 10**6, 14 * 10**6])
def test_candidates_at_the_similarity_reach_the_recall(n):
    bits, apart, radius, recall = 64 * simhash.STAGE["words"], simhash.STAGE["apart"], simhash.STAGE["radius"], simhash.STAGE["recall"]
    sets = simhash._masks(simhash.samples(bits, radius, n, recall, apart), 4)
    rng = np.random.default_rng(6)
    differ = rng.random((3000, bits)) < apart
    masks = simhash._masks([np.flatnonzero(d) for d in differ], 4)
    found = ((sets[None] & masks[:, None]) == 0).all(axis=2).any(axis=1) & (differ.sum(axis=1) <= radius)
    assert found.mean() >= recall - 0.012


def test_discounts_stay_good_turing_with_uneven_counts():
    law = [10**6 / r**2 for r in range(1, katz.K + 2)]
    common = (katz.K + 1) * law[katz.K] / law[0]
    exact = [((r + 1) * law[r] / law[r - 1] / r - common) / (1 - common) for r in range(1, katz.K + 1)]
    assert katz.discounts(law) == pytest.approx(exact)
    # more things seen five times than four, as groups of copies make them
    uneven = list(law)
    uneven[4] = 1.2 * uneven[3]
    d = katz.discounts(uneven)
    assert d == sorted(d) and 0 < d[0] and d[-1] < 1
    assert d == pytest.approx(exact, abs=0.06)  # absolute discounting is 0.067 to 0.078 off
    assert katz.discounts([3, 1, 0, 0, 0, 0]) == pytest.approx([1 - 0.6 / r for r in range(1, katz.K + 1)])
