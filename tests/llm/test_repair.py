"""Cheapest repairs against a search over all edits, and the query against plain Python."""

import hashlib
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.001"


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by the least (cost, audit) first, over edit sequences of the whole conversation."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, made = heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, made
        if (i, state) in done:
            continue
        done.add((i, state))
        for new in steps[state]:
            if new != "s":
                name = {"u": "user", "a": "assistant"}[new]
                heappush(queue, (cost + 5, audit + "I", i, new, (*made, (name, ""))))
            if i < len(rows):
                role, text, fault = rows[i]
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    if role[:1] == new:
                        heappush(queue, (cost + more, audit + "K", i + 1, new, (*made, (role, text))))
                    if new != "s":
                        heappush(queue, (cost + 1 + more, audit + "R", i + 1, new, (*made, (name, text))))
        if i < len(rows):
            heappush(queue, (cost + 2, audit + "D", i + 1, state, made))


def plain(rows):
    """The query's rows from (conv_id, turn, role, text)."""
    kept, ids = defaultdict(list), {r[0] for r in rows}
    text_of = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        role = "user" if fate == 4 else role
        kept[conv] += [(turn is not None, turn or 0, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for conv in ids:
        mine = sorted(kept[conv])
        turns = {t for known, t, *_ in mine if known}
        found = faults([r[2:] for r in mine])
        cost, audit, made = cheapest(found)
        counts = [sum(f == k for *_, f in found) for k in ("blank", "duplicate", "truncated")]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((str(conv), max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha))
    return sorted(out)


def query(spark, path):
    return sorted((str(r[0]), *r[1:]) for r in repair.op12_structure_repair(spark, path).collect())


def test_query_equals_a_search_over_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert query(spark, SF) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    some = lambda *x: x[int(rng.integers(len(x)))]
    rows = [(some(None, *range(40)), some(None, None, *range(9)), some(None, "user", "assistant", "system", "tool", "", "ugly", "User"), some(None, "", " \t", "Yes.", "no", "é!", "a. ", "?")) for _ in range(400)]
    rows += [(99, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)] + [(98, 5, "user", "same.")] * 300 + [(97, 1, "user", "long " * 100000 + ".")]
    alone = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "gone."))
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).select("*", *(F.lit("own").alias(c) for c in ("m", "conv", "fate", "audit", "copies")))
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    got = query(spark, str(tmp_path))
    assert got == plain(rows)
    assert next(r for r in got if r[0] == str(alone))[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    docs.where("false").write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert query(spark, f"{tmp_path}/empty") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="uasoUASOx", max_size=9), min_size=1, max_size=12))
def test_plans_of_signatures(signatures):
    nodes = repair.Suffixes()
    for s in sorted(set(signatures), key=lambda s: s[::-1]):
        rows = [(c.lower(), "", "blank" if c == "x" else "truncated" if c.isupper() else None) for c in s]
        assert nodes.plan(s) == cheapest(rows)[:2]
    assert nodes.nodes == len({s[i:] for s in signatures for i in range(len(s) + 1)} | {""})


def test_repaired_rows_follow_the_grammar(spark):
    import re

    planned, rows = repair.repair(repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet")), copies=F.col("copies"))
    roles = defaultdict(list)
    for r in rows.orderBy("conv", "position").collect():
        roles[r.conv].append(r.role[:1])
    assert len(roles) and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in roles.values())
    assert all(len(roles[r.conv]) == len(r.audit) - r.audit.count("D") for r in planned.collect())


@pytest.mark.parametrize("rows,audit", [([("user", "a."), ("assistant", "b")], "DD"), ([("assistant", "a."), ("user", "b.")], "RR"), ([("system", "s."), ("user", "a."), ("assistant", "b.")], "KKK")])
def test_examples(rows, audit):
    assert cheapest(faults(rows))[1] == audit
