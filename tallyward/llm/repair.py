"""Conversation structure repair: the cheapest edits that turn a conversation into an optional system message and whole
exchanges of user and assistant, found by Hirschberg's divide and conquer over four states.

Rows are range-partitioned by conversation and turn and cut into blocks of bounded size, so one conversation may span many
partitions. Each block is reduced to one step of a four-state path (a 4 x 4 table of costs and ranks); the blocks of a
conversation, a few numbers each, are solved first, which fixes the states at their seams; then every block is solved on
its own. Only the digest of a repaired conversation, which cannot be split, passes through one task as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import hirschberg
from tallyward.llm.common import staged, table

BLOCK_ROWS = 2048
BLOCK_TEXT = 4_000_000  # a block also ends behind so many characters
SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# States: nothing yet, behind system, behind user, behind assistant. The last is the goal.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = ("su", "ua", "au")


@cache
def row_step(initial: str, must_go: bool, truncated: bool) -> hirschberg.Step:
    """The moves a row allows: up to two insertions and one letter that takes the row."""
    ways: dict[tuple[int, int], tuple[int, str]] = {}

    def add(before: int, after: int, cost: int, text: str) -> None:
        ways[before, after] = min(ways.get((before, after), (cost, text)), (cost, text))

    stays = TRUNCATED if truncated else 0
    for before in range(4):
        at = before
        for inserted in range(3):
            paid, text = inserted * INSERT, "I" * inserted
            add(before, at, paid + DELETE, text + "D")
            if not must_go:
                add(before, _NEXT[at], paid + REROLE + stays, text + "R")
                if initial == "s" and at == START:
                    add(before, SYSTEM, paid + KEEP + stays, text + "K")
                if initial in ("u", "a") and initial == _ROLE[_NEXT[at]][0]:
                    add(before, _NEXT[at], paid + KEEP + stays, text + "K")
            at = _NEXT[at]
    return tuple((b, a, *way) for (b, a), way in sorted(ways.items()))


# Behind the last row: nothing, or insertions up to a whole exchange.
END: hirschberg.Step = (
    (START, ASSISTANT, 0, ""),
    (SYSTEM, ASSISTANT, 2 * INSERT, "II"),
    (USER, ASSISTANT, INSERT, "I"),
    (ASSISTANT, ASSISTANT, 0, ""),
)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, cut short, repeated, given to the user.

    Adds ``copies``: how often a row is there (0: dropped). Nulls count as one space in the hash and in role and text.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    return conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text")).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def judged(conversations: DataFrame) -> DataFrame:
    """One row per message with its first fault (``blank``, ``duplicate``, ``truncated`` or null) and the initial of its role.

    A conversation without messages keeps one row with copy 0. Equal messages of one turn are counted before they are
    shuffled and numbered after; the first of them all, in the earliest turn, is no duplicate.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    messages = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        word("role").alias("role"),
        word("text").alias("text"),
        copies.cast("long").alias("copies"),
    )
    same = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    grouped = (
        messages.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("same", same)
    )
    # min of a struct takes a null turn as the least.
    first = (
        grouped.where("copies > 0")
        .groupBy(F.col("conv_id").alias("first_conv"), F.col("same").alias("first_same"))
        .agg(F.min(F.struct("turn")).alias("first_turn"))
    )
    numbered = grouped.join(
        first, grouped.conv_id.eqNullSafe(first.first_conv) & (F.col("same") == F.col("first_same")), "left"
    ).select(
        "conv_id",
        "turn",
        "role",
        "text",
        "same",
        F.struct("turn").eqNullSafe(F.col("first_turn")).alias("earliest"),
        F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0)).cast("array<long>"))).alias("copy"),
    )
    bare = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(bare == "", "blank")
        .when(~F.col("earliest") | (F.col("copy") > 1), "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return numbered.select(
        "conv_id", "turn", "role", "text", "same", "copy", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial")
    )


ROWS = "part int, block long, at int, conv_id long, turn long, role string, text string, initial string, fault string"
SUMMARY = (
    "rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
    "head string, tail string, first_turn long, last_turn long, moves string"
)
_NAMES = [c.split()[0] for c in f"{ROWS}, {SUMMARY}".split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_TYPES = [_KINDS[c.split()[1]] for c in f"{ROWS}, {SUMMARY}".split(", ")]


def _step(initial: str, fault: str | None) -> hirschberg.Step:
    return row_step(initial, fault in ("blank", "duplicate"), fault == "truncated")


def _packed(step: hirschberg.Step) -> str:
    return " ".join(",".join(map(str, move)) for move in step)


def _unpacked(moves: str) -> hirschberg.Step:
    return tuple(tuple(map(int, move.split(","))) for move in moves.split(" "))


def _summary(block: list[tuple]) -> tuple:
    """What the other blocks of a conversation need to know of this one; rows are (turn, initial, fault)."""
    turns = [t for t, _, _ in block if t is not None]
    faults = [f for _, _, f in block]
    initials = [i for _, i, _ in block]
    return (
        len(block),
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        len(set(turns)),
        *((turns[0], turns[-1]) if turns else (None, None)),
        initials[0] if block else None,
        initials[-1] if block else None,
        block[0][0] if block else None,
        block[-1][0] if block else None,
        _packed(hirschberg.joined([_step(i, f) for _, i, f in block])) if block else None,
    )


def in_blocks(messages: DataFrame) -> DataFrame:
    """Judged messages in order, in blocks (part, block) of one conversation, staged.

    The last row of a block carries its summary. Rows with copy 0 have no initial and do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        block: list[tuple] = []
        number, size, last = 0, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)
                out = []

        def close() -> None:
            nonlocal block, number, size
            out[-1] = out[-1][:9] + _summary(block)
            block, number, size = [], number + 1, 0

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                for conv, turn, role, text, copy, fault, initial in zip(
                    *(c.to_pylist() for c in batch.slice(low, BLOCK_ROWS).columns)
                ):
                    if last is not None and (last != (conv,) or len(block) >= BLOCK_ROWS or size >= BLOCK_TEXT):
                        close()
                        if len(out) >= BLOCK_ROWS:
                            yield from flush()
                    last = (conv,)
                    mark = initial if copy else None
                    out.append((part, number, len(block), conv, turn, role, text, mark, fault, *(None,) * 13))
                    if copy:
                        block.append((turn, initial, fault))
                        size += len(text)
        if out:
            close()
        yield from flush()

    order = ["conv_id", "turn", "role", "same", "copy"]
    ranged = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ranged.select("conv_id", "turn", "role", "text", "copy", "fault", "initial").mapInArrow(run, f"{ROWS}, {SUMMARY}")
    return staged(rows, "messages")


PLAN = "part int, block long, conv_id long, start int, goal int, tail string"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _solve(summaries: list[dict]) -> tuple[list[tuple], tuple]:
    """(states at both ends of each block and insertions behind it, report) of the blocks of a conversation, in order."""
    conv, blocks = summaries[0]["conv_id"], [s for s in summaries if s["rows"]]
    steps = [_unpacked(s["moves"]) for s in blocks] + [END]
    path = hirschberg.moves(steps, START, ASSISTANT)
    plan = [
        (s["part"], s["block"], conv, m[0], m[1], path[-1][3] if s is blocks[-1] else "") for s, m in zip(blocks, path)
    ]
    seams = list(zip(blocks, blocks[1:]))
    low = [s["low"] for s in blocks if s["low"] is not None]
    turns = sum(s["turns"] for s in blocks) - sum(
        a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in seams
    )
    gaps = max(s["high"] for s in blocks if s["high"] is not None) - min(low) + 1 - turns if low else 0
    faults = [sum(s[f] for s in blocks) for f in ("blank", "duplicate", "truncated", "illegal")]
    faults[3] += sum(a["tail"] + b["head"] not in _LEGAL for a, b in seams)
    return plan, (conv, gaps, *faults, sum(m[2] for m in path))


def solved(rows: DataFrame) -> DataFrame:
    """States at the seams of all blocks, and one report per conversation: the columns of PLAN (null for a report) and
    of REPORT (null for a block). Summaries are sorted and streamed by conversation, one small row for each block."""
    names = ["part", "block", "conv_id", *(c.split()[0] for c in SUMMARY.split(", "))]
    both = [c.split() for c in f"{PLAN}, {REPORT}".split(", ")]
    schema = [(f"r_{n}" if i >= 6 else n, k) for i, (n, k) in enumerate(both)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[dict] = []

        def solve() -> None:
            plan, report = _solve(held)
            out.extend((*p, *(None,) * 7) for p in plan)
            out.append((*(None,) * 6, *report))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*out), schema)], [n for n, _ in schema]
            )

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    solve()
                    held = []
                    if len(out) > 4096:
                        yield batch_of()
                        out = []
                held.append(row)
        if held:
            solve()
        if out:
            yield batch_of()

    summaries = rows.where("rows is not null").select(*names)
    ordered = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return ordered.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in schema))


EDITS = "conv_id long, part int, block long, at int, turn long, edit string, role string, text string"


def edited(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Every edit of every conversation in order (part, block, at): edit (K, R, D, I), and role and text of the result
    (null where deleted). Blocks are solved on their own, wherever they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_KINDS[c.split()[1]] for c in EDITS.split(", ")]
        names = [c.split()[0] for c in EDITS.split(", ")]
        held: list[dict] = []
        todo: dict | None = None

        def solve() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []

            def put(turn: int | None, letter: str, role: str | None, text: str | None) -> None:
                out.append((todo["conv_id"], todo["part"], todo["block"], len(out), turn, letter, role, text))

            def insert(state: int, times: int) -> int:
                for _ in range(times):
                    state = _NEXT[state]
                    put(None, "I", _ROLE[state], "")
                return state

            steps = [_step(r["initial"], r["fault"]) for r in held]
            for r, (before, after, _, letters) in zip(held, hirschberg.moves(steps, todo["start"], todo["goal"])):
                insert(before, len(letters) - 1)
                if letters[-1] == "D":
                    put(r["turn"], "D", None, None)
                else:
                    put(r["turn"], letters[-1], r["role"] if letters[-1] == "K" else _ROLE[after], r["text"])
            insert(todo["goal"], len(todo["tail"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                for row in batch.slice(low, BLOCK_ROWS).to_pylist():
                    if row["at"] == -1:
                        if todo:
                            yield from solve()
                        todo, held = row, []
                    else:
                        held.append(row)
        if todo:
            yield from solve()

    kinds = dict(c.split() for c in f"{ROWS}, start int, goal int, tail string".split(", "))
    heads = plan.where("start is not null").withColumn("at", F.lit(-1))
    full = lambda df: df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))
    mine = rows.select(*(c.split()[0] for c in ROWS.split(", "))).where("initial is not null")
    met = full(heads).unionByName(full(mine)).repartition("part", "block").sortWithinPartitions("part", "block", "at")
    return met.mapInArrow(run, EDITS)


def repaired(conversations: DataFrame) -> DataFrame:
    """The messages of every conversation after its repair: conv_id, part, block, at (their order), turn (null if
    inserted), edit, role, text. Deleted messages are left out; see ``report`` for what holds of odd input."""
    rows = in_blocks(judged(conversations).where("copy > 0"))
    return edited(rows, solved(rows)).where("edit != 'D'")


def report(conversations: DataFrame) -> DataFrame:
    """Faults, the cheapest repair and its digest, one row per conversation.

    conversations: conv_id, turn, role, text, and ``copies`` if rows stand for several or none; other columns are ignored.
    Messages follow by turn (nulls first), those of one turn by role and hash of the text, equal ones next to each other.
    A null id is a conversation of its own; null roles and texts are one space. An initial other than s, u, a is
    never kept. A conversation without messages has zeros, an empty audit and the hash of the empty string; an empty
    table gives no rows. Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    rows = in_blocks(judged(conversations))
    plan = staged(solved(rows), "seams")
    edits = edited(rows, plan.select(*(c.split()[0] for c in PLAN.split(", "))))
    found = plan.where("start is null").select(
        *(F.col(f"r_{n}").alias(n) for n in (c.split()[0] for c in REPORT.split(", ")))
    )
    names = [c.split()[0] for c in REPORT.split(", ")]
    schema = f"{REPORT}, audit string, repaired_sha256 string"
    kinds = [_KINDS[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        about, audit, digest, started = None, [], None, False

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*names, "audit", "repaired_sha256"])

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                for row in batch.slice(low, BLOCK_ROWS).to_pylist():
                    if row["part"] == -1:
                        if about:
                            out.append((*about, "".join(audit), digest.hexdigest()))
                            if len(out) >= 4096:
                                yield batch_of()
                                out = []
                        about, audit, digest, started = [row[n] for n in names], [], hashlib.sha256(), False
                        continue
                    audit.append(row["edit"])
                    if row["role"] is not None:
                        digest.update((("\n" if started else "") + f"{row['role']}:{row['text']}").encode())
                        started = True
        if about:
            out.append((*about, "".join(audit), digest.hexdigest()))
        if out:
            yield batch_of()

    nothing = lambda columns: [F.lit(None).cast(k).alias(n) for n, k in columns]
    edit_only = [tuple(c.split()) for c in EDITS.split(", ") if c.split()[0] not in ("conv_id", "part")]
    heads = found.select("*", F.lit(-1).alias("part"), *nothing(edit_only))
    body = edits.select("*", *nothing(tuple(c.split()) for c in REPORT.split(", ")[1:]))
    met = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "at")
    return met.mapInArrow(run, schema)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after damage."""
    return report(damage(table(spark, sf_dir, "conversations")))
