"""Conversation structure repair: the cheapest edits that give every conversation alternating roles, found on a suffix-shared automaton.

A conversation's rows give its signature, a letter for each row: its role's initial and its fault. Signatures are read from the end: conversations with the
same last rows share the nodes of a suffix, so that the least cost to go, and the first edit of the best audit, are computed once for each node (distinct suffix) and state of
the grammar, whatever the number of conversations that share it. Distinct signatures, sorted by their reverse, pass each node once.

The grammar is ``(s?(ua)+)?``, of the roles' initials. Kinds of edits differ in their letter wherever they start in the same node and state, so the
audit that is least in ASCII takes the least letter among the cheapest edits, and no strings are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.skew import join_unique
from voxlake.storage import cut

#: Costs of edits; ``truncated`` is for a row cut short that stays.
COSTS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
ROLES = {"u": "user", "a": "assistant"}
#: The grammar: states by what was read last (nothing, s, u, a), their steps, and those in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FINAL = (START, ASSISTANT)
#: Letters of a signature: initials of roles (o: any other role), in upper case where the text is cut short; GONE: a row that has to go.
GONE = "x"
BLANK = r"[^\x20\x09-\x0D]"
#: Letters of edits: delete, insert, keep, rerole.
DELETE, INSERT, KEEP, REROLE = "DIKR"

Node = tuple[tuple[int, str, int], ...]


def _inserted(best: list[tuple[int, str, int]]) -> Node:
    """Each state's best (cost, letter, next state), with insertions, which stay at the node."""
    while True:
        better = [min(best[q], min((COSTS["insert"] + best[t][0], INSERT, t) for i, t in STEPS[q].items() if i in ROLES)) for q in range(4)]
        if better == best:
            return tuple(best)
        best = better


def last_node() -> Node:
    """The node of the empty suffix. A state that can't end here costs more than any edits."""
    return _inserted([(0, "", q) if q in FINAL else (1 << 60, "Z", q) for q in range(4)])


def node_before(letter: str, after: Node) -> Node:
    """The node of a suffix that begins with ``letter`` and goes on with that of ``after``."""
    role, stays = letter.lower(), COSTS["truncated"] * letter.isupper()
    best = []
    for q in range(4):
        edits = [(COSTS["delete"] + after[q][0], DELETE, q)]
        if letter != GONE:
            edits += [(COSTS["keep"] + stays + after[t][0], KEEP, t) for i, t in STEPS[q].items() if i == role]
            edits += [(COSTS["rerole"] + stays + after[t][0], REROLE, t) for i, t in STEPS[q].items() if i in ROLES]
        best.append(min(edits))
    return _inserted(best)


class Suffixes:
    """Nodes of the suffixes of signatures that come in the order of their reverse: a path, of which what the next one shares is kept.

    A node's costs are kept less the least of them, and the least apart, so that few different nodes exist, and steps to them are looked up.
    """

    def __init__(self):
        first = last_node()
        self.base, self.path, self.read = [first[START][0]], [self._less(first)[1]], ""
        self.known: dict[tuple[str, Node], tuple[int, Node]] = {}
        self.nodes = 1

    @staticmethod
    def _less(node: Node) -> tuple[int, Node]:
        low = min(c for c, _, _ in node)
        return low, tuple((c - low, e, t) for c, e, t in node)

    def plan(self, signature: str) -> tuple[int, str]:
        """The least cost, and the least of its audits."""
        backwards = signature[::-1]
        same = 0
        limit = min(len(backwards), len(self.read))
        while same < limit and backwards[same : same + 4096] == self.read[same : same + 4096] and same + 4096 <= limit:
            same += 4096
        while same < limit and backwards[same] == self.read[same]:
            same += 1
        del self.path[same + 1 :], self.base[same + 1 :]
        for letter in backwards[same:]:
            step = letter, self.path[-1]
            if step not in self.known:
                self.known[step] = self._less(node_before(*step))
            low, node = self.known[step]
            self.base.append(self.base[-1] + low)
            self.path.append(node)
            self.nodes += 1
        self.read = backwards
        audit, at, q = [], len(backwards), START
        while True:
            _, letter, t = self.path[at][q]
            if not letter:
                break
            audit.append(letter)
            at -= letter != INSERT
            q = t
        return self.base[-1] + self.path[-1][START][0], "".join(audit)


def plans(signatures: DataFrame) -> DataFrame:
    """(signature, n, cost, audit) of distinct signatures (signature, n), dealt by ranges of their reverse, so that equal ends meet."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = Suffixes()
        for pdf in batches:
            found = [nodes.plan(s) for s in pdf["signature"]]
            yield pdf.assign(cost=[c for c, _ in found], audit=[a for _, a in found])

    order = F.reverse("signature")
    return signatures.repartitionByRange(order).sortWithinPartitions(order).mapInPandas(plan, "signature string, n long, cost long, audit string")


def turns_of(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None = None) -> DataFrame:
    """Distinct turns (conv, turn, role, text, m, fault): ``m`` equal rows, of which only the first can be without a fault, as the others repeat it.

    Null roles and texts are one space. Fault: blank, duplicate (its role and text stand at an earlier turn), truncated, or null.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("m"))
    each = own.groupBy("conv", "turn", "role", "text").agg(F.sum("m").alias("m"))
    each = each.withColumns({"t0": F.xxhash64(F.lit(1), "role", "text"), "t1": F.xxhash64(F.lit(2), "role", "text")})
    # where each role and text first stand: no group is brought together for it, and the join's keys are unique on both sides
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = each.groupBy("conv", "t0", "t1").agg(F.min(at).alias("at")).select(F.col("conv").alias("c"), F.col("t0").alias("f0"), F.col("t1").alias("f1"), F.col("at.turn").alias("f_turn"))
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("f_turn")) & (F.col("t0") == F.col("f0")) & (F.col("t1") == F.col("f1"))
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("f0").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return each.join(first, same, "left").select("conv", "turn", "role", "text", "m", fault.alias("fault"))


def _in_order(rows: DataFrame, first: list[str]) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions(F.col("conv"), *first, F.col("turn").asc_nulls_first(), "role", "text")


def signatures_of(turns: DataFrame, conv: str) -> DataFrame:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal) of each conversation of ``turns_of``. Its rows pass by in order; a letter for each is kept."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, letters = None, [], []
        count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        last, turns_seen, low, high, last_turn = None, 0, None, None, None

        def done() -> tuple:
            gaps = high - low + 1 - turns_seen if low is not None else 0
            return (now[0], "".join(letters), gaps, *count.values())

        for pdf in batches:
            for c, known, t, role, fault, m in zip(pdf["conv"], pdf["known"], pdf["t"], pdf["role"], pdf["fault"], pdf["m"], strict=True):
                conv_now = (None if pd.isna(c) else c,)
                if conv_now != now:
                    if now is not None:
                        out.append(done())
                    now, letters = conv_now, []
                    count = dict.fromkeys(count, 0)
                    last, turns_seen, low, high, last_turn = None, 0, None, None, None
                initial, m = role[:1], int(m)
                fault = fault if isinstance(fault, str) else None
                count["illegal"] += (last is not None and last + initial not in ("su", "ua", "au")) + (m - 1) * (initial + initial not in ("su", "ua", "au"))
                last = initial
                if fault:
                    count[fault] += 1
                count["blank" if fault == "blank" else "duplicate"] += m - 1
                letter = initial if initial in ("s", "u", "a") else "o"
                letters.append(GONE if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
                letters.append(GONE * (m - 1))
                if known:
                    turns_seen += t != last_turn
                    last_turn = high = t
                    low = t if low is None else low
            yield pd.DataFrame(out, columns=names)
            out = []
        if now is not None:
            yield pd.DataFrame([done()], columns=names)

    names = ["conv", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
    rows = _in_order(turns, []).select("conv", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("t"), "role", "fault", "m")
    schema = f"conv {conv}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
    return rows.mapInPandas(read, schema)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): (conv, signature, gaps, blank, duplicate, truncated, illegal, cost, audit), and its repaired rows (conv, position, role, text, edit).

    Rows stand by turn (null first), then role, then text. ``copies``: how many equal rows each is. A row's first fault counts: blank, duplicate (of an earlier row's role and
    text), truncated (it doesn't end in one of ``.!?``). Blank and duplicate rows go; the edits cost COSTS, and the cheapest are taken, of equal
    ones those whose letters in order (the audit) are the least in ASCII. A role of another initial than s, u, a can only be changed or deleted.

    Null roles and texts are one space, null conversations are one of their own, and an empty table gives none. ``gaps``: the turn numbers that are missing between the
    smallest and the largest; null ones don't count. Other columns do not matter. A conversation's rows are read in order, a batch at a time, by one task,
    which keeps a letter for each.
    """
    conv = turns.schema[conv_col].dataType.simpleString()
    each = cut(turns_of(turns, conv_col, turn_col, role_col, text_col, copies))
    found = cut(signatures_of(each, conv))
    distinct = found.groupBy("signature").agg(F.count("*").alias("n"))
    planned = join_unique(found, plans(distinct), ["signature"], "n", found.count())
    planned = cut(planned.select(*found.columns, "cost", "audit"))

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each conversation's audit comes before its rows."""
        conv_now, audit, at, position = None, "", 0, 0
        out: list[tuple] = []

        def row(role: str, text: str, how: str) -> None:
            nonlocal position
            position += 1
            out.append((conv_now, position, role, text, how))

        def role_here() -> str:
            """The grammar fixes it: roles alternate to an assistant's end."""
            return ROLES["ua"[(position + odd) % 2]]

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == INSERT:
                row(role_here(), "", INSERT)
                at += 1

        odd = 0
        for pdf in batches:
            for c, is_row, role, text, m, its in zip(pdf["conv"], pdf["is_row"], pdf["role"], pdf["text"], pdf["m"], pdf["audit"], strict=True):
                if not is_row:
                    conv_now, audit, at, position = (None if pd.isna(c) else c), its, 0, 0
                    odd = (len(audit) - audit.count(DELETE)) % 2
                    inserted()
                    continue
                for _ in range(int(m)):
                    how = audit[at]
                    at += 1
                    if how != DELETE:
                        row(role if how == KEEP else role_here(), text, how)
                    inserted()
                    if len(out) >= 4096:
                        yield pd.DataFrame(out, columns=columns)
                        out.clear()
            yield pd.DataFrame(out, columns=columns)
            out.clear()

    columns = ["conv", "position", "role", "text", "edit"]
    rows = each.select("conv", F.lit(True).alias("is_row"), "turn", "role", "text", "m", F.lit("").alias("audit"))
    heads = planned.select("conv", F.lit(False).alias("is_row"), F.lit(None).cast(each.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("m"), "audit")
    ordered = _in_order(rows.union(heads), ["is_row"]).drop("turn")
    return planned, ordered.mapInPandas(edit, f"conv {conv}, position long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired ``role:text`` of each conversation, newline-joined; rows pass by in order, so no conversation is held."""
    conv = repaired.schema["conv"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for pdf in batches:
            out = []
            for c, role, text in zip(pdf["conv"], pdf["role"], pdf["text"], strict=True):
                own = (None if pd.isna(c) else c,)
                if own != now:
                    if now is not None:
                        out.append((now[0], h.hexdigest()))
                    now, h = own, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield pd.DataFrame(out, columns=["conv", "sha256"])
        if now is not None:
            yield pd.DataFrame([(now[0], h.hexdigest())], columns=["conv", "sha256"])

    return repaired.repartition("conv").sortWithinPartitions("conv", "position").select("conv", "role", "text").mapInPandas(hashed, f"conv {conv}, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) damaged by a checksum of their conversation and turn: dropped, emptied, cut short, repeated, or given another role."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    d = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    planned, repaired = repair(damaged(turns), copies=F.col("copies"))
    convs = turns.select("conv_id").distinct()
    null_safe = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    out = convs.join(planned.withColumnRenamed("conv", "c"), null_safe("c"), "left").join(digests(repaired).withColumnRenamed("conv", "d"), null_safe("d"), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
