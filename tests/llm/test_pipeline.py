"""The stages in their order, each against plain Python on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxlake.llm import decontaminate, quality, sharding, simhash


def documents(rng):
    word = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, n))
    item = word(30)
    clean = [(i, word(int(rng.integers(60, 300))), "en", f"s{i % 3}") for i in range(60)]
    planted = [(100, clean[5][1], "en", "s1"), (101, clean[6][1].upper(), "en", "s1"), (102, " ".join(clean[7][1].split()[:-3] + ["a", "b", "c"]), "en", "s2")]
    held = [(200, f"{word(50)} {item} {word(50)}", "en", "s0"), (201, f"{word(50)} {item.replace(' ', ', ', 3)} x {word(50)}", "en", None)]
    bad = [(300, "too short", "en", "s0"), (301, "again and again " * 40, "en", "s0"), (302, None, "en", "s0"), (303, "", None, None), (304, "line of words here\n" * 30, "en", "s0")]
    return clean, planted, held, bad, [(1, item)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    clean, planted, held, bad, items = documents(np.random.default_rng(3))
    rows = [(*r, len(r[1] or "")) for r in clean + planted + held + bad]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_do_their_work_in_order(spark, folder):
    clean, planted, held, bad, _ = documents(np.random.default_rng(3))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name.replace(" ", "-"))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns + ["shard", "slot"] * (name == "sharding")
    good = {r[0] for r in clean}
    assert ids["quality rules"] == good | {r[0] for r in planted + held}
    # 102 shares over four fifths of its shingles with the longer texts only
    shared = (len(clean[7][1].split()) - 3 - 4) / (len(clean[7][1].split()) - 4) >= 0.8
    assert ids["near-duplicates"] == good | {r[0] for r in held} | ({102} if not shared else set())
    assert ids["decontamination"] == ids["near-duplicates"] - {r[0] for r in held}
    assert ids["mixing"] <= ids["decontamination"] and len(ids["mixing"]) >= 0.9 * len(ids["decontamination"])
    rows = docs.collect()
    text = {r[0]: r[1] for r in clean + planted}
    assert all(r.text in text[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += len(r.text.split())
    assert all(n <= 2 * len(text[i].split()) for i, n in taken.items())
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes.values(), default=0) <= 1 and len(rows) >= 16
    assert all(sorted(r.slot for r in rows if r.shard == s) == [*range(n)] for s, n in sizes.items())
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.text) for r in rows)


ODD = [(None, None, "a"), (1, "", "a"), (1, "", "a"), (2, "x " * 20000, None), (3, " ".join(f"w{i}" for i in range(50)), "b"), (3, " ".join(f"w{i}" for i in range(50)), "b")]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_of_quality_and_sharding(spark, empty):
    names = ("repetition", "row", "own_text", "text_hash", "part", "rank", "u", "at", "h0")
    docs = spark.createDataFrame([] if empty else ODD, "doc_id long, text string, source string").select("*", *(F.lit("clash").alias(c) for c in names))
    kept = quality.stage_quality(spark, docs, "")
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == ([] if empty else [3, 3])
    placed = sharding.stage_shard(spark, docs, "")
    assert placed.columns == docs.columns + ["shard", "slot"]
    got = placed.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == ([] if empty else sorted(((i, t) for i, t, _ in ODD), key=str))
    assert all(r.slot == 0 for r in got) and len({r.shard for r in got}) == len(got)


def test_hypergeometric_draws_are_uniform(spark):
    """Shards that a row falls to, over seeds: each as often, within four standard deviations."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"))
    seen = np.zeros(4)
    for seed in range(12):
        for r in sharding.shard(docs, 4, seed).where("doc_id < 5").collect():
            seen[r.shard] += 1
    assert abs(seen - 15).max() <= 4 * (60 * 0.25 * 0.75) ** 0.5


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_of_near_dedup_and_decontamination(spark, tmp_path, empty):
    names = ("key", "maybe", "leaks", "row", "own_text", "h", "n", "c", "id", "component", "f0")
    docs = spark.createDataFrame([] if empty else [*ODD, (4, "w1 " * 3, None), (None, "no id", "b")], "doc_id long, text string, source string")
    docs = docs.select("*", *(F.concat(F.lit("own "), F.coalesce("source", F.lit("-"))).alias(c) for c in names))
    spark.createDataFrame([(1, "w1 w1 w1"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    once = simhash.stage_near_dedup(spark, docs, "")
    clean = decontaminate.stage_decontaminate(spark, docs, str(tmp_path))
    assert once.columns == docs.columns == clean.columns
    assert sorted((r.doc_id for r in once.collect()), key=str) == ([] if empty else [2, 3, 4, None, None])
    assert sorted((r.doc_id for r in clean.collect()), key=str) == ([] if empty else [1, 1, 2, 3, 3, None, None])
    for df in (once, clean):
        assert all(r[c] == f"own {r.source or '-'}" for r in df.collect() for c in names)


def test_run_on_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
