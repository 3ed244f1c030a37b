"""Repair of conversations: the cheapest edits that bring the turns into order, found by branch and bound.

A conversation is in order if its roles' initials read `(s?(ua)+)?`. Every row is kept, given the role that
is due, or deleted, and empty turns may be inserted anywhere. Among the cheapest edits the audit, their
initials in order, decides: the ASCII-least is taken.

The search is depth first with an explicit stack. A node is a place between rows and what the turns so far
have come to (nothing, a system turn, a user turn, an assistant turn). It is dropped if its cost and the
suffix's lower bound exceed the incumbent, if they equal it and its audit is already greater, or if its
node was reached before at lower cost or equal cost and lesser audit. The bounds can only be too low, so when the
stack is empty the incumbent is proved optimal.

Two prefixes of one node differ before either ends, so the lesser stays the lesser with any suffix. That
makes pieces of a long conversation independent: a block gives, for each pair of first and last state, its
cheapest edits; blocks are then joined by their numbers alone. So no conversation has to fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import cut_lineage, marked, per_group, record

#: Costs of the edits; a truncated row that stays costs more by ``TRUNCATED``.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows, and bytes of text, up to which a conversation is searched in one go, and at which a longer one is cut.
WHOLE_ROWS, WHOLE_BYTES = 2048, 1 << 24
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 22
#: Leading characters of a text that say where a row of a long conversation is dealt to.
DEALT_BY = 64

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a kept row of each initial leads, by state; and the turn that is due after each state.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (NOTHING, ASSISTANT)
IN_ORDER = frozenset({"su", "ua", "au"})
#: The characters that count as white space.
WHITE = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, CUT_OFF = range(4)
FAR = 1 << 60


class Turn(NamedTuple):
    """A row as the search sees it: its role's initial and its first fault."""

    initial: str
    fault: int


def fault(text: str, seen: bool) -> int:
    """The first fault of a row; ``seen`` says that its role and text came before."""
    body = text.rstrip(WHITE)
    if not body:
        return BLANK
    return DUPLICATE if seen else OK if body[-1] in ".!?" else CUT_OFF


def bounds(turns: list[Turn], goal: int | None) -> list[tuple[int, ...]]:
    """Lower bounds, by state, of what the rows from each place on cost.

    Once there is a turn, no system turn may be kept any more; before, rows are deleted until one stays. A
    system turn alone counts as accepted here, so these bounds may be too low, and are never too high.
    ``goal`` is the state to end in, without insertions at the end; None stands for any accepted one.
    """
    user, assistant = (0, INSERT) if goal is None else (FAR, 0) if goal == USER else (0, FAR)
    nothing = user
    out = [(nothing, user, assistant, user)]
    for initial, fault_ in reversed(turns):
        due_user, due_assistant, nothing = DELETE + user, DELETE + assistant, DELETE + nothing
        if fault_ in (OK, CUT_OFF):
            extra = TRUNCATED if fault_ == CUT_OFF else 0
            stays = extra + (0 if initial == "u" else REROLE) + assistant
            nothing = min(nothing, stays, extra + user if initial == "s" else FAR)
            due_user = min(due_user, stays)
            due_assistant = min(due_assistant, extra + (0 if initial == "a" else REROLE) + user)
        user, assistant = min(due_user, INSERT + due_assistant), min(due_assistant, INSERT + due_user)
        nothing = min(nothing, INSERT + assistant)
        out.append((nothing, user, assistant, user))
    return out[::-1]


def search(turns: list[Turn], start: int = NOTHING, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state ``start`` to ``goal`` (None: any accepted state), None if there are none.

    With a goal nothing is inserted after the last row; a piece's insertions stand before its rows.
    """
    n, low = len(turns), bounds(turns, goal)
    best_cost, best_audit = FAR, ""
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        total = cost + low[i][state]
        if total > best_cost or total >= FAR or (total == best_cost and audit > best_audit[: len(audit)]):
            continue
        before = reached.get((i, state))
        if before is not None and before <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n and (state in ACCEPTED if goal is None else state == goal):
            if (cost, audit) < (best_cost, best_audit):
                best_cost, best_audit = cost, audit
            continue
        due = DUE[state]
        children = []
        if i < n:
            initial, fault_ = turns[i]
            children.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault_ in (OK, CUT_OFF):
                stays = cost + (TRUNCATED if fault_ == CUT_OFF else 0)
                kept = KEPT[initial].get(state) if initial in KEPT else None
                if kept is not None:
                    children.append((i + 1, kept, stays, audit + "K"))
                children.append((i + 1, due, stays + REROLE, audit + "R"))
        if i < n or goal is None:
            children.append((i, due, cost + INSERT, audit + "I"))
        # what promises least cost is looked at first, then the lesser audit
        children.sort(key=lambda c: (c[2] + low[c[0]][c[1]], c[3]), reverse=True)
        stack += children
    return (best_cost, best_audit) if best_cost < FAR else None


def messages(rows: list[tuple[str, str]], audit: str, state: int = NOTHING) -> list[tuple[str, str]]:
    """The turns (role, text) that an audit makes of rows, from ``state`` on."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        due = DUE[state]
        if edit == "K":
            role, text = rows[at]
            state = KEPT[role[0]][state]
        else:
            role, text, state = ROLE[due], rows[at][1] if edit == "R" else "", due
        out.append((role, text))
        at += edit != "I"
    return out


def written(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode("utf-8", "surrogatepass")


def count_illegal(initials: list[str]) -> int:
    return sum(a + b not in IN_ORDER for a, b in zip(initials, initials[1:]))


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "conv_id long, place long, role string, text string"


def _whole(conv: int | None, rows: list[tuple[int | None, str, str]]) -> tuple[dict, list[tuple[str, str]]]:
    """Report and repaired turns of a conversation given in order as (turn, role, text)."""
    seen: set[tuple[str, str]] = set()
    turns = []
    for _, role, text in rows:
        turns.append(Turn(role[:1], fault(text, (role, text) in seen)))
        seen.add((role, text))
    cost, audit = search(turns) or (0, "")
    repaired = messages([r[1:] for r in rows], audit)
    numbers = [t for t, _, _ in rows if t is not None]
    faults = [t.fault for t in turns]
    return {
        "conv_id": conv, "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF),
        "illegal": count_illegal([t.initial for t in turns]), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256(written(repaired)).hexdigest(),
    }, repaired


def _out(rows: list[dict], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return record({c: [r[c] for r in rows] for c in names}, schema)


def _emit(found: Iterator[tuple[dict, list[tuple[str, str]]]], turns_out: bool) -> Iterator[pa.RecordBatch]:
    """Reports, or the turns they stand for, in batches of bounded size."""
    rows: list[dict] = []
    size = 0
    for report, repaired in found:
        if turns_out:
            rows += [{"conv_id": report["conv_id"], "place": k, "role": r, "text": t} for k, (r, t) in enumerate(repaired)]
            size += sum(len(t) for _, t in repaired)
        else:
            rows.append(report)
        if len(rows) >= 4096 or size > BLOCK_BYTES:
            yield _out(rows, MESSAGES if turns_out else REPORT)
            rows, size = [], 0
    if rows:
        yield _out(rows, MESSAGES if turns_out else REPORT)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[int | None, str, str]]]]:
    """Conversations of rows that arrive in order, whatever batches they are cut into."""
    conv, rows = None, []
    for batch in batches:
        for c, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text"))):
            if rows and c != conv:
                yield conv, rows
                rows = []
            conv = c
            rows.append(tuple(row))
    if rows:
        yield conv, rows


ORDER = ("turn", "role", "text")


def _in_one_go(rows: DataFrame, turns_out: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit((_whole(conv, own) for conv, own in _conversations(batches)), turns_out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).mapInArrow(run, MESSAGES if turns_out else REPORT)


PLACED = "conv_id long, turn long, role string, text string, part long, block long, place long"
#: A block's numbers: its first and last row, counts, and for each pair of states cost and rank of its audit among those of the first state.
BLOCK = (
    "conv_id long, part long, block long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, costs array<long>, ranks array<long>, kept array<long>, audits array<string>"
)
CHOSEN = "part long, block long, order long, way int, tail string, first long, cost long"
PRINTED = "conv_id long, order long, audit string, turns long, body binary"
DIGEST = "conv_id long, audit string, repaired_sha256 string"
TOTALS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _in_blocks(rows: DataFrame, turns_out: bool) -> DataFrame:
    """Long conversations: dealt out by ranges of order, cut into blocks, searched, and joined by their numbers."""
    dealt = rows.withColumn("_wl_head", F.substring("text", 1, DEALT_BY))
    dealt = dealt.repartitionByRange("conv_id", "turn", "role", "_wl_head").sortWithinPartitions("conv_id", *ORDER)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, size, at, last = -1, 0, 0, 0, object()
        for batch in batches:
            convs, blocks = batch.column("conv_id").to_pylist(), []
            for conv, length in zip(convs, (len(t) for t in batch.column("text").to_pylist())):
                if conv != last or n >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    block, n, size, last = block + 1, 0, 0, conv
                n, size = n + 1, size + length
                blocks.append(block)
            kept = {c: batch.column(c) for c in ("conv_id", "turn", "role", "text", "part")}
            yield record(kept | {"block": blocks, "place": list(range(at, at + len(blocks)))}, PLACED)
            at += len(blocks)

    placed = dealt.withColumn("part", F.spark_partition_id().cast("long")).select("conv_id", "turn", "role", "text", "part")
    placed = cut_lineage(placed.mapInArrow(place, PLACED), "placed")
    same = placed.select("conv_id", "part", "place", F.xxhash64(F.lit(1), "role", "text").alias("h"), F.xxhash64(F.lit(2), "role", "text").alias("g"))
    first = same.groupBy("conv_id", "h", "g").agg(F.min(F.struct("part", "place")).alias("at")).select("at.part", "at.place", F.lit(True).alias("new"))
    faults = placed.join(first, ["part", "place"], "left").withColumn("new", F.coalesce("new", F.lit(False)))

    def solve(rows: pa.Table) -> dict:
        got = {c: rows[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "place", "new")}
        order = sorted(range(rows.num_rows), key=got["place"].__getitem__)
        turns = [Turn(got["role"][k][:1], fault(got["text"][k], not got["new"][k])) for k in order]
        numbers = [got["turn"][k] for k in order if got["turn"][k] is not None]
        kinds = [t.fault for t in turns]
        found = [[search(turns, a, b) for b in STATES] for a in STATES]
        rank = [{x[1]: k for k, x in enumerate(sorted((x for x in row if x), key=lambda x: x[1]))} for row in found]
        flat = [(a, x) for a, row in enumerate(found) for x in row]
        return {
            "conv_id": got["conv_id"][:1], "part": [rows["part"][0].as_py()], "block": [rows["block"][0].as_py()],
            "first_turn": [min(numbers, default=None)], "last_turn": [max(numbers, default=None)], "turns": [len(set(numbers))],
            "blank": [kinds.count(BLANK)], "duplicate": [kinds.count(DUPLICATE)], "truncated": [kinds.count(CUT_OFF)],
            "illegal": [count_illegal([t.initial for t in turns])], "first_initial": [turns[0].initial], "last_initial": [turns[-1].initial],
            "costs": [[x[0] if x else FAR for _, x in flat]], "ranks": [[rank[a][x[1]] if x else 0 for a, x in flat]],
            "kept": [[len(x[1]) - x[1].count("D") if x else 0 for _, x in flat]], "audits": [[x[1] if x else "" for _, x in flat]],
        }

    blocks = cut_lineage(per_group(faults, ["part", "block"], BLOCK, solve), "blocks")

    def choose(rows: pa.Table) -> dict:
        """The way through a conversation's blocks; a few numbers stand for each block."""
        got = rows.select(["part", "block", "costs", "ranks", "kept"]).to_pydict()
        order = sorted(range(rows.num_rows), key=lambda k: (got["part"][k], got["block"][k]))
        cost, rank, back = {NOTHING: 0}, {NOTHING: 0}, []
        for k in order:
            best: dict = {}
            for b in STATES:
                ways = [(cost[a] + got["costs"][k][4 * a + b], rank[a], got["ranks"][k][4 * a + b], a) for a in cost if got["costs"][k][4 * a + b] < FAR]
                if ways:
                    best[b] = min(ways)
            back.append({b: w[3] for b, w in best.items()})
            cost = {b: w[0] for b, w in best.items()}
            rank = {b: r for r, b in enumerate(sorted(best, key=lambda b: best[b][1:3]))}
        tails = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        state = min(cost, key=lambda b: (cost[b] + INSERT * len(tails[b]), rank[b]))
        tail, path = tails[state], []
        for k, way in zip(reversed(order), reversed(back)):
            path.append((k, way[state], state))
            state = way[state]
        path.reverse()
        out: dict = {c: [] for c in ("part", "block", "order", "way", "tail", "first", "cost")}
        first = 0
        for k, a, b in path:
            last = len(out["way"]) == len(path) - 1
            way, end = 4 * a + b, tail if last else ""
            spent = got["costs"][k][way] + INSERT * len(end)
            for c, v in zip(out, (got["part"][k], got["block"][k], len(out["way"]), way, end, first, spent)):
                out[c].append(v)
            first += got["kept"][k][way]
        return out

    numbers = blocks.select("conv_id", "part", "block", "costs", "ranks", "kept")
    ways = per_group(numbers, ["conv_id"], CHOSEN, choose).join(blocks, ["part", "block"])
    ways = ways.withColumn("audit", F.expr("audits[way]")).drop("costs", "ranks", "kept", "audits")
    ways = cut_lineage(ways, "ways")
    edits = ways.select("part", "block", "order", F.expr("way DIV 4").cast("int").alias("state"), "audit", "tail", "first")
    applied = placed.select("conv_id", "part", "block", "place", "role", "text").join(edits, ["part", "block"])

    def turn_rows(rows: pa.Table) -> tuple[list[tuple[str, str]], dict]:
        got = {c: rows[c].to_pylist() for c in ("role", "text", "place")}
        order = sorted(range(rows.num_rows), key=got["place"].__getitem__)
        one = {c: rows[c][0].as_py() for c in ("conv_id", "order", "state", "audit", "tail", "first")}
        return messages([(got["role"][k], got["text"][k]) for k in order], one["audit"] + one["tail"], one["state"]), one

    if turns_out:

        def expand(rows: pa.Table) -> dict:
            repaired, one = turn_rows(rows)
            return {"conv_id": [one["conv_id"]] * len(repaired), "place": [one["first"] + k for k in range(len(repaired))], "role": [r for r, _ in repaired], "text": [t for _, t in repaired]}

        return per_group(applied, ["part", "block"], MESSAGES, expand)

    def print_block(rows: pa.Table) -> dict:
        repaired, one = turn_rows(rows)
        return {"conv_id": [one["conv_id"]], "order": [one["order"]], "audit": [one["audit"] + one["tail"]], "turns": [len(repaired)], "body": [written(repaired)]}

    printed = per_group(applied, ["part", "block"], PRINTED, print_block)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, any_turn, open_ = None, [], hashlib.sha256(), False, False
        done = lambda: record({"conv_id": [conv], "audit": ["".join(audit)], "repaired_sha256": [sha.hexdigest()]}, DIGEST)
        for batch in batches:
            for row in batch.to_pylist():
                if open_ and row["conv_id"] != conv:
                    yield done()
                    audit, sha, any_turn = [], hashlib.sha256(), False
                conv, open_ = row["conv_id"], True
                audit.append(row["audit"])
                if row["turns"]:
                    sha.update((b"\n" if any_turn else b"") + row["body"])
                    any_turn = True
        if open_:
            yield done()

    digests = printed.repartition("conv_id").sortWithinPartitions("conv_id", "order").mapInArrow(digest, DIGEST)

    # adjacent blocks share the pair of rows between them, and may share a turn's number
    def total(rows: pa.Table) -> dict:
        names = ("order", "first_turn", "last_turn", "turns", "first_initial", "last_initial")
        got = sorted(zip(*(rows[c].to_pylist() for c in names)))
        numbered = [r for r in got if r[1] is not None]
        distinct = sum(r[3] for r in numbered) - sum(a[2] == b[1] for a, b in zip(numbered, numbered[1:]))
        gaps = numbered[-1][2] - numbered[0][1] + 1 - distinct if numbered else 0
        sums = {c: sum(rows[c].to_pylist()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
        sums["illegal"] += sum(a[5] + b[4] not in IN_ORDER for a, b in zip(got, got[1:]))
        return {"conv_id": [rows["conv_id"][0].as_py()], "gaps": [gaps]} | {c: [v] for c, v in sums.items()}

    totals = per_group(ways.drop("audit", "tail", "first", "way", "part", "block"), ["conv_id"], TOTALS, total)
    both = totals.join(digests.withColumnRenamed("conv_id", "_wl_conv"), F.col("conv_id").eqNullSafe(F.col("_wl_conv")))
    return both.select(*(f.split()[0] for f in REPORT.split(", ")))


def _repair(conversations: DataFrame, turns_out: bool) -> DataFrame:
    kept = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")] + [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select(*kept)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = cut_lineage(sizes.where((F.col("n") > WHOLE_ROWS) | (F.col("size") > WHOLE_BYTES)).select(key.alias("key")), "long")
    if not long.head(1):
        return _in_one_go(rows, turns_out)
    may = marked(rows.withColumn("_wl_conv", key), "_wl_conv", long)
    short = may.where("NOT _wl_may").select(*rows.columns)
    return _in_one_go(short, turns_out).unionByName(_in_blocks(may.where("_wl_may").select(*rows.columns), turns_out))


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations`` (conv_id, turn, role, text): REPORT.

    Rows are taken by turn, nulls first, then by role and text. ``gaps`` counts numbers missing between the
    first and the last turn. A row's first fault counts: blank, duplicate (role and text came before),
    truncated (the last character that is no white space ends no sentence). ``illegal`` counts neighbours
    whose initials are none of su, ua, au. ``cost`` and ``audit`` are the cheapest edits, K(eep) 0,
    R(erole) 3, D(elete) 4, I(nsert) 3, with 3 more for a truncated row that stays; blank and duplicate rows
    have to go. ``repaired_sha256`` is of the repaired `role:text`, joined by line breaks.

    A null role or text is one blank, which makes a row blank or its role unknown. Rows without conv_id are
    one conversation. Repeated rows are duplicates. An empty table has no conversations. Conversations of
    more than ``WHOLE_ROWS`` rows or ``WHOLE_BYTES`` bytes are searched in blocks side by side; only their
    numbers, the audit and the running hash pass one task per conversation.
    """
    return _repair(conversations, False)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that the edits of :func:`report` leave, in order from place 0."""
    return _repair(conversations, True)
