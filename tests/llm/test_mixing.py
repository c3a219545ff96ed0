"""The mix against a plain schedule, its prefixes, and odd rows."""

import re
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxlake.llm import mixing

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(3, 1, 2)):
    """Targets by filling up: a share of 1.5, none above 2 times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, rest, open_ = {}, Fraction(3, 2) * sum(sizes.values()), set(names)
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = Fraction(2 * sizes[s])
            rest -= target[s]
        open_ -= full
    return target


def plain_schedule(slots, blocks, total):
    """(slot, source, block) by walking the points one after the other."""
    edge, at = {}, 0
    for s, n in slots.items():
        edge[s] = (at * 2**32 // total, (at + n) * 2**32 // total)
        at += n
    rank, out = dict.fromkeys(slots, 0), []
    for t in range(total):
        point = t * mixing.GOLDEN % 2**32
        s = next(s for s, (a, b) in edge.items() if a <= point < b)
        if rank[s] < slots[s]:
            out.append((t, s, rank[s] % blocks[s]))
            rank[s] += 1
    t = total
    for s in slots:
        while rank[s] < slots[s]:
            out.append((t, s, rank[s] % blocks[s]))
            rank[s], t = rank[s] + 1, t + 1
    return out


@pytest.fixture(scope="module")
def sized(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    return mixing.with_size(docs).drop("text").cache()


def test_schedule_equals_the_plain_one_and_its_prefixes_hold_the_weights(spark, sized):
    per, slots, _ = mixing.mix(sized, ["doc_id"])
    p = {r.number: r for r in per.collect()}
    sizes = {r.source: r.source_size for r in p.values()}
    wanted = plain_targets(sizes)
    assert {r.source: r.target for r in p.values()} == pytest.approx({s: float(t) for s, t in wanted.items()})
    got = sorted((r.slot, r.number, r.block) for r in slots.collect())
    n, total = {k: r.slots for k, r in sorted(p.items())}, sum(r.slots for r in p.values())
    assert got == plain_schedule(n, {k: r.blocks for k, r in p.items()}, total)
    seen = dict.fromkeys(n, 0)
    for at, (_, s, _) in enumerate(got, 1):
        seen[s] += 1
        assert all(abs(seen[k] - at * n[k] / total) <= 4 for k in n)


def test_taken_words_come_from_the_slots(spark, sized):
    d = mixing.op8_source_mix(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").toPandas()
    assert d.set_index("doc_id")["size"].to_dict() == {i: len(re.findall(mixing.WORD, t or "")) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert (d.taken <= 2 * d["size"]).all()
    per = d.merge(docs[["doc_id", "source"]]).groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert per.target.sum() == pytest.approx(1.5 * per["size"].sum()) and (abs(per.taken - per.target) <= per["size"] / 100 + 1).all()
    # a brute-force walk over the documents' places in the blocks
    _, slots, parts = mixing.mix(sized, ["doc_id"])
    of = {}
    for r in slots.collect():
        of.setdefault((r.number, r.block), []).append(r.slot)
    taken, covered = {}, {}
    for r in parts.collect():
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.words
        mine = taken.setdefault(r.doc_id, [0, []])
        mine[0] += r.words * len(of.get((r.number, r.block), []))
        mine[1] += of.get((r.number, r.block), [])
    assert covered == {r.doc_id: r.size for r in sized.collect() if r.size}
    for r in d.itertuples():
        n, at = taken.get(r.doc_id, (0, []))
        assert r.taken == n and (not at or (r.first_slot, r.last_slot) == (min(at), max(at)))


ODD = [(1, "w " * 50, "a"), (1, "w " * 50, "a"), (None, "x " * 30, "a"), (None, "x " * 30, None), (2, None, "b"), (3, "", None), (4, "y " * 9000, "b"), (5, "z", None), *[(9, "same copy here", "a")] * 300]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_are_taken_each_for_itself(spark, tmp_path, empty):
    docs = spark.createDataFrame([] if empty else ODD, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    d = mixing.op8_source_mix(spark, str(tmp_path)).toPandas()
    again = mixing.op8_source_mix(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "size", "taken", "first_slot", "last_slot"]
    assert d[key].sort_values(key, ignore_index=True).equals(again[key].sort_values(key, ignore_index=True))
    assert len(d) == (0 if empty else len(ODD)) and (d.taken <= 2 * d["size"]).all()
    if not empty:
        per = d.groupby("target").agg(n=("size", "size"), size=("source_size", "first"), taken=("taken", "sum")).reset_index()
        assert (abs(per.taken - per.target) <= per["size"] / 100 + 1).all()
        assert sorted(zip(d.doc_id.fillna(-1), d["size"], strict=True)) == sorted((-1 if i is None else i, len((t or "").split())) for i, t, _ in ODD)


def test_stage_gives_the_pieces_in_the_schedules_order(spark):
    names = ("key", "kind", "size", "group", "slot", "k0", "p", "row", "number")
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string").select("*", F.length("text").cast("long").alias("n_chars"), *(F.lit("clash").alias(c) for c in names))
    got = mixing.stage_mix(spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    words = pd.DataFrame([(r.source, len(r.text.split()), len(r.text) == r.n_chars and r.key == "clash") for r in rows], columns=["source", "n", "ok"])
    sizes = {}
    for _, t, s in ODD:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = plain_targets(sizes)
    taken = words.groupby("source", dropna=False)["n"].sum()
    assert words.ok.all() and all(abs(taken[s if s is not None else float("nan")] - t) <= sizes[s] / 100 + 1 for s, t in targets.items())
    # in order: any first part of the corpus is near the shares
    share = {s: float(t / sum(targets.values())) for s, t in targets.items()}
    upto, seen = 0, dict.fromkeys(sizes, 0)
    for s, n in zip(words["source"], words["n"], strict=True):
        s = s if isinstance(s, str) else None
        seen[s], upto = seen[s] + n, upto + n
        if upto > sum(sizes.values()) / 2:
            assert all(abs(seen[k] / upto - share[k]) < 0.1 for k in share)
    # nothing but the documents' own words
    assert {r.doc_id for r in rows} <= {i for i, _, _ in ODD} and sum(len(r.text.split()) for r in rows if r.doc_id == 4) > 0
    assert all(set(r.text.split()) == {"y"} for r in rows if r.doc_id == 4)
