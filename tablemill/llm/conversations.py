"""Conversation structure repair: weighted edits along a graph-structured stack over the grammar of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tablemill.llm.base import prepared, slim
from tablemill.session import materialised

#: Rows and characters of a block, the part of a conversation that is worked on at once.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
BLANK = "[^\\x20\\x09-\\x0D]"
NOTHING = hashlib.sha256(b"").hexdigest()

# The LR(0) automaton of   C -> (nothing) | D | s D    D -> u a | D u a,   with s, u, a for system, user, assistant.
GOTO = {0: {"s": 1, "u": 2, "D": 3}, 1: {"u": 2, "D": 4}, 2: {"a": 5}, 3: {"u": 6}, 4: {"u": 6}, 6: {"a": 7}}
REDUCE = {5: ("D", 2), 7: ("D", 3)}
ACCEPT = (0, 3, 4)
#: A stack for every top that can stand between two rows; what follows depends on the top alone.
STACKS = {0: (0,), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 1, 4), 6: (0, 3, 6)}
#: Tops after which an assistant comes next; after the others it is a user.
AFTER_USER = (2, 6)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits (fixed by the contract); a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text: the rows with the contract's damage, NULLs replaced by one space; ``key`` is conv_id as text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = slim(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.select(blank("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
                       (F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind <> 0").select("key", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def faulted(rows: DataFrame) -> DataFrame:
    """key, turn, role, text, copies, fault, fresh: equal rows as one with their count.

    ``fault`` is what the first copy has apart from repeating an earlier row: b(lank), t(runcated) or nothing; ``fresh``
    says that no earlier row has its role and text. Where a text stands first is a minimum, partial before the
    exchange, and comes back by a join that adaptive execution may split.
    """
    text = F.col("text")
    fault = F.when(~text.rlike(BLANK), "b").when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("")
    same = F.md5(F.concat_ws("\0", "role", "text"))
    held = rows.groupBy("key", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("same", same)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.select(F.col("key").alias("_key"), same.alias("_same"), order.alias("order"))
    first = first.groupBy("_key", "_same").agg(F.min("order").alias("first"))
    joined = held.join(first, (F.col("key") == F.col("_key")) & (F.col("same") == F.col("_same")))
    return joined.select("key", "turn", "role", "text", "copies", fault.alias("fault"), (order == F.col("first")).alias("fresh"))


def advance(stack: tuple[int, ...], letter: str) -> tuple[int, ...] | None:
    """The stack after one role, with all reductions done; None if the role cannot come next."""
    state = GOTO.get(stack[-1], {}).get(letter)
    if state is None:
        return None
    stack += (state,)
    while stack[-1] in REDUCE:
        name, n = REDUCE[stack[-1]]
        stack = stack[:-n]
        stack += (GOTO[stack[-1]][name],)
    return stack


class Stacks:
    """The graph-structured stack: for each top the cheapest way to it, as (cost, audit, stack)."""

    def __init__(self, tops: dict[int, tuple[int, str]]):
        self.tops = {top: (cost, audit, STACKS[top]) for top, (cost, audit) in tops.items()}

    @staticmethod
    def _merge(tops: dict, stack: tuple[int, ...] | None, cost: int, audit: str) -> bool:
        if stack is None or (stack[-1] in tops and tops[stack[-1]][:2] <= (cost, audit)):
            return False
        tops[stack[-1]] = (cost, audit, stack)
        return True

    def insert(self) -> None:
        """Add the ways that insert rows here."""
        todo = list(self.tops)
        while todo:
            cost, audit, stack = self.tops[todo.pop()]
            for letter in ROLES:
                to = advance(stack, letter)
                if self._merge(self.tops, to, cost + INSERT, audit + "I"):
                    todo.append(to[-1])

    def row(self, letter: str, fault: str) -> None:
        """Take one row: b or d must go; t costs more if it stays."""
        self.insert()
        after: dict = {}
        for cost, audit, stack in self.tops.values():
            self._merge(after, stack, cost + DELETE, audit + "D")
            if fault in ("b", "d"):
                continue
            stay = cost + (TRUNCATED if fault == "t" else 0)
            self._merge(after, advance(stack, letter), stay, audit + "K")
            for other in ROLES:
                self._merge(after, advance(stack, other), stay + REROLE, audit + "R")
        self.tops = after

    def remove(self, n: int) -> None:
        """Take n rows that must go."""
        if n:
            self.row("", "d")
            self.tops = {top: (cost + DELETE * (n - 1), audit + "D" * (n - 1), stack) for top, (cost, audit, stack) in self.tops.items()}


def _ways(rows: list[tuple], start: int) -> list[tuple]:
    stacks = Stacks({start: (0, "")})
    for _, role, _, copies, fault, fresh in rows:
        if fresh:
            stacks.row(role[:1], fault)
        stacks.remove(copies - 1 if fresh else copies)
    return [(start, top, cost, audit) for top, (cost, audit, _) in stacks.tops.items()]


BLOCK = ("key string, part int, number int, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
         "ways array<struct<start: int, end: int, cost: long, audit: string>>, "
         "lines array<struct<role: string, text: string, copies: long, fresh: boolean>>")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _block(key: str, part: int, number: int, rows: list[tuple], starts: tuple[int, ...]) -> tuple:
    count = dict.fromkeys(("b", "d", "t"), 0)
    illegal, last = 0, None
    for _, role, _, copies, fault, fresh in rows:
        if fault == "b":
            count["b"] += copies
        else:
            count["d"] += copies - fresh
            count["t"] += fresh and fault == "t"
        letter = role[:1]
        illegal += (last is not None and not _legal(last, letter)) + (copies - 1) * (not _legal(letter, letter))
        last = letter
    return (key, part, number, sum(r[3] for r in rows), count["b"], count["d"], count["t"], illegal, rows[0][1][:1], last,
            [dict(zip(("start", "end", "cost", "audit"), w)) for s in starts for w in _ways(rows, s)],
            [{"role": r[1], "text": r[2], "copies": r[3], "fresh": r[5]} for r in rows])


def _blocks(limit: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in ("key", "part", "number", "rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways", "lines")]
        held, size, number, key = [], 0, 0, None
        first = False  # whether the held rows surely begin their conversation
        out, weight = [], 0
        for pdf in batches:
            for row in pdf[["key", "role", "text", "copies", "fault", "fresh"]].itertuples(index=False, name=None):
                if held and (row[0] != key or len(held) >= limit or size + len(row[2]) > BLOCK_CHARS):
                    out.append(_block(key, part, number, held, (0,) if first else tuple(STACKS)))
                    first, weight = row[0] != key, weight + size
                    held, size, number = [], 0, number + 1
                    if weight > BLOCK_CHARS:
                        yield pd.DataFrame(out, columns=names)
                        out, weight = [], 0
                key = row[0]
                held.append(row)
                size += len(row[2]) + 50
        if held:
            out.append(_block(key, part, number, held, (0,) if first else tuple(STACKS)))
        if out:
            yield pd.DataFrame(out, columns=names)

    return each


class Chain:
    """The cheapest ways through the blocks of one conversation so far; letters on which all ways agree are put aside."""

    def __init__(self):
        self.tops: dict[int, tuple[int, str]] = {0: (0, "")}
        self.settled: list[str] = []
        self.blocks: list[tuple[int, int, int]] = []
        self.came: list[dict[int, int]] = []
        self.count = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal"), 0)
        self.last: str | None = None

    def add(self, row) -> None:
        after, came = {}, {}
        for way in row.ways:
            if way["start"] in self.tops:
                cost, audit = self.tops[way["start"]]
                found = (cost + way["cost"], audit + way["audit"])
                if way["end"] not in after or found < after[way["end"]]:
                    after[way["end"]], came[way["end"]] = found, way["start"]
        same = 0
        audits = [a for _, a in after.values()]
        for letters in zip(*audits):
            if len(set(letters)) > 1:
                break
            same += 1
        self.settled.append(audits[0][:same])
        self.tops = {top: (cost, audit[same:]) for top, (cost, audit) in after.items()}
        self.came.append(came)
        self.blocks.append((row.part, row.number, row.rows))
        for c in self.count:
            self.count[c] += getattr(row, c)
        self.count["illegal"] += self.last is not None and not _legal(self.last, row.first)
        self.last = row.last

    def end(self) -> tuple[int, str, list[tuple]]:
        """(cost, audit, [(part, number, the block's letters, whether an assistant comes first)])."""
        # letters inserted after the last row
        stacks = Stacks(self.tops)
        base = {top: top for top in self.tops}
        best = None
        for top, (cost, audit) in self.tops.items():
            alone = Stacks({top: (cost, audit)})
            alone.insert()
            for to, (c, a, _) in alone.tops.items():
                if to in ACCEPT and (best is None or (c, a) < best[:2]):
                    best = (c, a, base[top])
        cost, rest, top = best
        audit = "".join(self.settled) + rest
        tops = [top]
        for came in reversed(self.came):
            tops.append(came[tops[-1]])
        tops.reverse()
        out, at = [], 0
        for (part, number, rows), before in zip(self.blocks, tops):
            start = at
            while rows:
                stop = at + rows  # at least so many letters follow
                rows = audit.count("I", at, stop)
                at = stop
            out.append([part, number, audit[start:at], before in AFTER_USER])
        if out:
            out[-1][2] = audit[start:]
        return cost, audit, out


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["key", "part", "number", "letters", "answer", "cost", "audit", "blank", "duplicate", "truncated", "illegal"]

    def ended(key: str, chain: Chain) -> list[tuple]:
        cost, audit, blocks = chain.end()
        c = chain.count
        return [(key, *b, None, None, None, None, None, None) for b in blocks] + [
            (key, None, None, None, None, cost, audit, c["blank"], c["duplicate"], c["truncated"], c["illegal"])]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("part", "number", "cost", "blank", "duplicate", "truncated", "illegal")})

    key, chain, out = None, None, []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if chain is None or row.key != key:
                if chain is not None:
                    out += ended(key, chain)
                    if len(out) > 5000:
                        yield frame(out)
                        out = []
                key, chain = row.key, Chain()
            chain.add(row)
    if chain is not None:
        out += ended(key, chain)
    if out:
        yield frame(out)


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of each block after its edits, joined; NULL if none is left."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            letters, lines, answer = iter(row.letters), [], row.answer

            def until_row() -> str:
                nonlocal answer
                for letter in letters:
                    if letter != "I":
                        return letter
                    lines.append(f"{ROLES['a' if answer else 'u']}:")
                    answer = not answer
                return ""

            for line in row.lines:
                for _ in range(line["copies"]):
                    letter = until_row()
                    if letter == "K":
                        lines.append(f"{line['role']}:{line['text']}")
                        answer = line["role"][:1] == "u"
                    elif letter == "R":
                        lines.append(f"{ROLES['a' if answer else 'u']}:{line['text']}")
                        answer = not answer
            until_row()
            out.append((row.key, row.part, row.number, "\n".join(lines) if lines else None))
        yield pd.DataFrame(out, columns=["key", "part", "number", "lines"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state, out = None, None, []
    for pdf in batches:
        for k, lines in zip(pdf["key"], pdf["lines"]):
            if state is None or k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state, empty = k, hashlib.sha256(), True
            if isinstance(lines, str):
                state.update(lines.encode("utf-8", "surrogatepass") if empty else b"\n" + lines.encode("utf-8", "surrogatepass"))
                empty = False
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
            out = []
    if state is not None:
        out.append((key, state.hexdigest()))
    yield pd.DataFrame(out, columns=["key", "repaired_sha256"])


def repair(rows: DataFrame, limit: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(summary, lines) of rows (key, turn, role, text): what was wrong and what was done, and the repaired blocks in order.

    ``summary`` has key, cost, audit, blank, duplicate, truncated, illegal; ``lines`` has key, part, number and the
    text of every block after the repair (NULL if no row is left). Rows are ordered by turn (NULL first, ties by role, then text) in
    ranges, so a long conversation is spread over tasks. Each block of rows is run through the graph-structured stack once
    for every top it may begin with; the blocks of a conversation are then chained by their costs and letters,
    which is exact, since letters of equal cost are never the beginning of one another. An empty role cannot be kept.
    """
    prepared(rows.sparkSession)
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = faulted(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = materialised(ordered.mapInPandas(_blocks(limit), BLOCK), "blocks")
    line = ["key", "part", "number"]
    small = blocks.drop("lines").repartition("key").sortWithinPartitions(*line)
    chained = materialised(small.mapInPandas(_chained, "key string, part int, number int, letters string, answer boolean, cost long, audit string, "
                                             "blank long, duplicate long, truncated long, illegal long"), "chained")
    summary = chained.where("part IS NULL").select("key", "cost", "audit", "blank", "duplicate", "truncated", "illegal")
    letters = chained.where("part IS NOT NULL").select("part", "number", "letters", "answer")
    edited = blocks.select("key", "part", "number", "lines").join(letters, ["part", "number"])
    return summary, edited.mapInPandas(_repaired, "key string, part int, number int, lines string")


def repaired_digests(lines: DataFrame) -> DataFrame:
    """key, repaired_sha256: the hash of the repaired lines of each conversation, read in order, block by block."""
    ordered = lines.repartition("key").sortWithinPartitions("key", "part", "number")
    return ordered.mapInPandas(_hashed, "key string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """One row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The rows are damaged (see ``damaged``) and repaired (see ``repair``). A conversation that has no row left has zeros, an empty
    audit and the hash of nothing; NULL conv_ids are one conversation; no rows, no result.
    """
    prepared(conversations.sparkSession)
    rows = materialised(damaged(conversations), "damaged")
    gaps = rows.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    summary, lines = repair(rows, limit)
    ids = slim(conversations, conv_id="conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    all_ = ids.join(gaps, "key", "left").join(summary, "key", "left").join(repaired_digests(lines), "key", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_.select("conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
