"""Conversation repair: Dijkstra on an implicit edit lattice, by segments of bounded size.

A node is (rows consumed, state of the role grammar ``(s?(ua)+)?``). Edges keep, rerole
or delete the next row, or insert a turn. The priority is (cost, audit), the audit being
the initials of the edits so far, and the search stops at the first end node popped
whose state accepts. The nodes are made as the search comes to them.

A conversation may hold a third of all rows, so it is not one group. Rows are range-sorted
and cut into segments of at most 256 rows. Of a conversation of one segment the search
gives the answer. Of others, each segment gives the best (cost, audit) from each grammar
state to each, and what follows reads a row a segment: a forward pass over four states,
which emits a prefix once all survivors share it. That is exact: an audit and a start
fix the path, and a path to the same node whose audit begins with the other's has further
inserts and costs more, so the least (cost, audit) of a whole is made of the least of its parts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship

COSTS = {"rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_MOVE = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that an insert or a rerole can give in each state.
_WANTED = ("user", "user", "assistant", "user")
_ACCEPT = (START, ASSISTANT)
_LEGAL = {"su", "ua", "au"}
_WHOLE = {"low": "Int64", "high": "Int64"}
_SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with a fault in a fifth of its rows, by crc32 of ``conv_id:turn``: dropped, emptied, without sentence ends, repeated, or given to the user. Null role and text are one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    d = turns.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), k.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1))
    d = d.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_c"))
    return d.withColumn("_c", F.explode("_c")).drop("_c")


def fault(text: str) -> int:
    """Blank or truncated; whether a row is a duplicate its text alone does not tell."""
    end = text.rstrip(_SPACE)[-1:]
    return BLANK if not end else 0 if end in ".!?" else TRUNCATED


def paths(initials: list[str], faults: list[int], start: int = START, whole: bool = False) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from (0, ``start``) to each state after the last row; with ``whole``, to the accepting state popped first, alone."""
    n, done, out = len(initials), set(), {}
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == n:
            if not whole:
                out[s] = cost, audit
            elif s in _ACCEPT:
                return {s: (cost, audit)}
        wanted = _MOVE[s, _WANTED[s][0]]
        heapq.heappush(heap, (cost + COSTS["insert"], audit + "I", i, wanted))
        if i < n:
            heapq.heappush(heap, (cost + COSTS["delete"], audit + "D", i + 1, s))
            if faults[i] not in (BLANK, DUPLICATE):
                more = COSTS["truncated"] if faults[i] == TRUNCATED else 0
                heapq.heappush(heap, (cost + COSTS["rerole"] + more, audit + "R", i + 1, wanted))
                if (s, initials[i]) in _MOVE:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, _MOVE[s, initials[i]]))
    return out


def apply_edits(audit: str, start: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str], int]:
    """Roles and texts that an audit leaves of rows, and the state after them."""
    out_roles, out_texts, s, i = [], [], start, 0
    for e in audit:
        if e != "D":
            role = roles[i] if e == "K" else _WANTED[s]
            out_roles.append(role)
            out_texts.append("" if e == "I" else texts[i])
            s = _MOVE[s, role[:1]]
        i += e != "I"
    return out_roles, out_texts, s


def _key(conv: Column) -> Column:
    return F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string")))


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = 256, room: int = 1 << 20) -> DataFrame:
    """A row per up to ``size`` rows, or ``room`` characters, of a conversation in order: _k, seg (rises with the order), low, high, distinct (of its turns), roles, texts, initials, faults, marks (a digest of role and text).

    The order is by turn (nulls first), then role and text; rows equal in all are alike.
    They may lie in several partitions, for the range sort splits even them.
    """
    ship(turns.sparkSession)
    rows = turns.select(_key(F.col(f"`{conv}`")).alias("_k"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_i"))
    order = ["_k", F.asc_nulls_first("turn"), "role", "text", "_i"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, key, held, length = TaskContext.get().partitionId() << 32, None, [], 0
        out: list[dict] = []

        def close() -> None:
            nonlocal at, held, length
            if held:
                marks = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for _, r, t in held]
                known = [int(x) for x, _, _ in held if x is not None]
                low, high = (known[0], known[-1]) if known else (None, None)
                out.append({"_k": key, "seg": at, "low": low, "high": high, "distinct": len(set(known)), "roles": [r for _, r, _ in held], "texts": [t for _, _, t in held], "initials": [r[:1] for _, r, _ in held], "faults": [fault(t) for _, _, t in held], "marks": marks})
                at, held, length = at + 1, [], 0

        for b in batches:
            for k, x, r, t in zip(b["_k"], b["turn"], b["role"], b["text"]):
                if k != key or len(held) >= size or length + len(t) > room:
                    close()
                    key = k
                held.append((x, r, t))
                length += len(t)
            if out:
                yield pd.DataFrame(out, dtype=object).astype(_WHOLE)
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, dtype=object).astype(_WHOLE)

    kinds = "_k string, seg long, low long, high long, distinct long, roles array<string>, texts array<string>, initials array<string>, faults array<int>, marks array<binary>"
    return materialize(rows.select("_k", F.col("turn").cast("string").alias("turn"), "role", "text").mapInPandas(run, kinds), "segments")


def _seen_before(segs: DataFrame) -> DataFrame:
    """_k, seg, before: marks of the segment that an earlier one of its conversation holds. A segment brings each mark once."""
    marks = segs.where("_n > 1").select("_k", "seg", F.explode(F.array_distinct("marks")).alias("mark"))
    first = marks.groupBy("_k", "mark").agg(F.min("seg").alias("first"), F.max("seg").alias("last")).where("first < last").drop("last")
    return marks.join(first, ["_k", "mark"]).where("seg > first").groupBy("_k", "seg").agg(F.collect_list("mark").alias("before"))


def _searched(segs: DataFrame) -> DataFrame:
    """Counts, ends and best paths of each segment; ``_n`` is the number of its conversation's segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, seg, n, low, high, distinct, initials, faults, marks, before in zip(*(b[c] for c in columns), b["before"]):
                seen = set() if before is None else {bytes(x) for x in before}
                faults = list(faults)
                for i, m in enumerate(map(bytes, marks)):
                    if m in seen and faults[i] != BLANK:
                        faults[i] = DUPLICATE
                    seen.add(m)
                initials = list(initials)
                found = {START: paths(initials, faults, START, True)} if n == 1 else {s: paths(initials, faults, s) for s in range(4)}
                flat = [(s, e, *v) for s, ends in found.items() for e, v in ends.items()]
                out.append({"_k": k, "seg": seg, "first": initials[0], "last": initials[-1], "low": None if low is None else int(low), "high": None if high is None else int(high), "distinct": distinct,
                            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:])),
                            "starts": [x[0] for x in flat], "ends": [x[1] for x in flat], "costs": [x[2] for x in flat], "audits": [x[3] for x in flat]})
            yield pd.DataFrame(out, dtype=object).astype(_WHOLE)

    kinds = "_k string, seg long, first string, last string, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, starts array<int>, ends array<int>, costs array<long>, audits array<string>"
    columns = ["_k", "seg", "_n", "low", "high", "distinct", "initials", "faults", "marks"]
    text = [F.col(c).cast("string").alias(c) if c in _WHOLE else F.col(c) for c in columns]  # pandas has no null in whole numbers
    return segs.select(*columns).join(_seen_before(segs), ["_k", "seg"], "left").select(*text, "before").mapInPandas(run, kinds)


class _Forward:
    """The best path to each state after the segments so far; what all of them share is given out."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, str, list]] = {START: (0, "", [])}  # state: cost, audit since the shared part, [(seg, start, audit)]

    def add(self, seg: int, table: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
        new: dict[int, tuple[int, str, list]] = {}
        for s, e, cost, audit in table:
            if s in self.best:
                c, a, way = self.best[s]
                if e not in new or (c + cost, a + audit) < new[e][:2]:
                    new[e] = c + cost, a + audit, [*way, (seg, s, audit)]
        self.best, given = new, []
        while len({x[2][0] if x[2] else None for x in self.best.values()}) == 1 and (head := next(iter(self.best.values()))[2]):
            given.append(head[0])
            self.best = {e: (c, a[len(w[0][2]) :], w[1:]) for e, (c, a, w) in self.best.items()}
        return given

    def close(self) -> tuple[int, list[tuple[int, int, str]]]:
        """Least cost of those that the grammar accepts, and what of its way is not given out yet."""
        cost, _, way = min((self.best[e] for e in _ACCEPT if e in self.best), key=lambda x: x[:2])
        return cost, way


def _joined(found: DataFrame) -> DataFrame:
    """A row a segment: _k, seg, start, audit; and a row a conversation (seg null) with its counts, cost and audit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, told, out = None, None, None, []

        def give(way: list) -> None:
            for seg, s, audit in way:
                told["audit"].append(audit)
                out.append({"_k": key, "seg": seg, "start": s, "audit": audit})

        def close() -> None:
            if now is not None:
                cost, way = now.close()
                give(way)
                gaps = told["high"] - told["low"] + 1 - told["distinct"] if told["low"] is not None else 0
                out.append({"_k": key, "seg": None, "start": None, "audit": "".join(told["audit"]), "gaps": gaps, "cost": cost} | {c: told[c] for c in ("blank", "duplicate", "truncated", "illegal")})

        for b in batches:
            for r in b.itertuples(index=False):
                k, seg, first, last, low, high, distinct = r[:7]
                counts = dict(zip(("blank", "duplicate", "truncated", "illegal"), map(int, r[7:11])))
                low, high = (None, None) if low is None else (int(low), int(high))
                if k != key or now is None:
                    close()
                    key, now = k, _Forward()
                    told = {"audit": [], "low": None, "high": None, "distinct": 0, "last": None} | dict.fromkeys(counts, 0)
                for c, v in counts.items():
                    told[c] += v
                told["illegal"] += told["last"] is not None and told["last"] + first not in _LEGAL
                told["distinct"] += distinct - (low is not None and low == told["high"])
                told["low"] = low if told["low"] is None else told["low"]
                told["high"], told["last"] = told["high"] if high is None else high, last
                give(now.add(int(seg), list(zip(map(int, r[11]), map(int, r[12]), map(int, r[13]), r[14]))))
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object).astype(whole)
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object).astype(whole)

    names = ["_k", "seg", "start", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = {c: "Int64" for c in names if c not in ("_k", "audit")}
    kinds = "_k string, seg long, start int, audit string, " + ", ".join(f"{c} long" for c in names[4:])
    rows = found.select("_k", "seg", "first", "last", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "distinct", "blank", "duplicate", "truncated", "illegal", "starts", "ends", "costs", "audits")
    return materialize(rows.repartition("_k").sortWithinPartitions("_k", "seg").mapInPandas(run, kinds), "edits")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = 256) -> tuple[DataFrame, DataFrame]:
    """(report, repaired). report: a row a conversation with ``_k`` (its key), gaps, blank, duplicate, truncated, illegal, cost, audit. repaired: _k, seg, roles, texts, the turns left of each segment; a conversation's rows lie in one partition, in order.

    Null role and text are one space; a null conversation is one of its own; rows of null
    turn come first and rows of one turn are ordered by role and text, so that reruns agree;
    repeated rows are duplicates. An empty table gives two empty ones. Other columns are
    not looked at. Texts of any length are hashed whole.
    """
    segs = segments(turns, conv, turn, role, text, size)
    n = segs.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    edits = _joined(_searched(segs.join(n, "_k")))
    report = edits.where("seg is null").drop("seg", "start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, audit = START, ""
        for b in batches:
            out = []
            for k, seg, s, a, roles, texts in zip(b["_k"], b["seg"], b["start"], b["audit"], b["roles"], b["texts"]):
                if roles is None:
                    start, audit = int(s), a
                    continue
                left_roles, left_texts, _ = apply_edits(audit, start, list(roles), list(texts))
                out.append((k, seg, left_roles, left_texts))
            if out:
                yield pd.DataFrame(out, columns=["_k", "seg", "roles", "texts"])

    none = F.lit(None).cast("array<string>")
    plan = edits.where("seg is not null").select("_k", "seg", "start", "audit", none.alias("roles"), none.alias("texts"))
    data = segs.select("_k", "seg", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("audit"), "roles", "texts")
    both = plan.unionByName(data).repartition("_k").sortWithinPartitions("_k", "seg", F.asc_nulls_last("start"))
    return report, both.mapInPandas(run, "_k string, seg long, roles array<string>, texts array<string>")


def digests(repaired: DataFrame) -> DataFrame:
    """_k, repaired_sha256 of the turns as ``role:text`` lines: one pass over the rows in order, which no other way gives; a row is a segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha, begun = None, None, False
        for b in batches:
            out = []
            for k, roles, texts in zip(b["_k"], b["roles"], b["texts"]):
                if k != key or sha is None:
                    if sha is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha, begun = k, hashlib.sha256(), False
                for r, t in zip(roles, texts):
                    sha.update((("\n" if begun else "") + f"{r}:{t}").encode("utf-8", "surrogatepass"))
                    begun = True
            if out:
                yield pd.DataFrame(out, columns=["_k", "repaired_sha256"])
        if sha is not None:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=["_k", "repaired_sha256"])

    return repaired.select("_k", "roles", "texts").mapInPandas(run, "_k string, repaired_sha256 string")


def repair_report(turns: DataFrame, hurt: DataFrame) -> DataFrame:
    """For every conversation of ``turns`` what ``repair`` says of its rows in ``hurt``; with none there, zeros, no edits, and the hash of nothing."""
    every = turns.select("conv_id").distinct().withColumn("_k", _key(F.col("conv_id")))
    report, repaired = repair(hurt)
    out = every.join(report, "_k", "left").join(digests(repaired), "_k", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
