"""Repair of conversations by depth-first branch and bound.

The roles of a repaired conversation read ``(system? (user assistant)+)?`` by their initials. A message may be kept, given
another role, or deleted, and an empty message may be inserted; each edit has a cost. The search walks the messages from
the first to the last with an explicit stack. A node is a message and the role that came before. Its cost so far and a
lower bound of what the suffix still costs are held against the incumbent, and a table per node drops a prefix that is no
better than one seen there. Edits are tried in the order of their letters, so among repairs of equal cost the one whose
letters are least is met first.

The search needs one letter per message: the initial of its role and its fault. Faults, and whether role and text were
seen before, are found by expressions and a join over all messages; only these letters, as many as the result's own list
of edits, come together per conversation. The messages stream through their task in order and are never held.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import skew
from cuesheet.session import materialise

DELETE, INSERT, KEEP, REROLE = "DIKR"
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
#: The role that came before: none, system, user or assistant. A conversation may end after none or an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
LEGAL = {"su", "ua", "au"}
#: Letters of messages: the initial, a capital if the message is cut off, or this one if it must go.
GONE = "-"
VISIBLE, SENTENCE_END = r"[^\x20\x09-\x0D]", ".!?"
ORDER = ["turn", "role", "same"]


def moves(letter: str) -> list[tuple[str, int, dict[int, int]]]:
    """Edits of one message with their cost and the roles they lead to, in the order of their letters."""
    if letter == GONE:
        return [(DELETE, DELETE_COST, {s: s for s in AFTER})]
    cut = CUT_COST if letter.isupper() else 0
    kept = {s: to[letter.lower()] for s, to in AFTER.items() if letter.lower() in to}
    changed = {s: next(t for r, t in to.items() if r in NAMES) for s, to in AFTER.items()}
    return [(DELETE, DELETE_COST, {s: s for s in AFTER}), (KEEP, cut, kept), (REROLE, REROLE_COST + cut, changed)]


MOVES = {letter: moves(letter) for letter in "suaxSUAX" + GONE}
INSERTED = {s: next(t for r, t in to.items() if r in NAMES) for s, to in AFTER.items()}


def with_inserts(bounds: list[int]) -> list[int]:
    """Least cost from each role before the next message, where empty messages may come first: at most two are of use."""
    for _ in range(2):
        bounds = [min(b, INSERT_COST + bounds[INSERTED[s]]) for s, b in enumerate(bounds)]
    return bounds


def suffix_bounds(letters: str) -> array:
    """A lower bound of the cost of every suffix after every role, the suffix from message i after role s at 4 * i + s."""
    unreachable = 1 << 60
    rest = with_inserts([0, unreachable, unreachable, 0])
    bounds = array("q", rest[::-1])
    for letter in reversed(letters):
        here = [unreachable] * len(AFTER)
        for _, cost, to in MOVES[letter]:
            for s, t in to.items():
                here[s] = min(here[s], cost + rest[t])
        rest = with_inserts(here)
        bounds.extend(rest[::-1])
    bounds.reverse()
    return bounds


def cheapest_repair(letters: str) -> tuple[int, str]:
    """Least cost, and of all lists of edits of that cost the one whose letters come first."""
    n, bounds = len(letters), suffix_bounds(letters)
    incumbent: tuple[int, str] | None = None
    limit = bounds[START]  # nothing is cheaper, so dearer prefixes need not wait for an incumbent
    seen: list[int | None] = [None] * len(bounds)
    path: list[str] = []
    stack: list[tuple[int, int, int, int, str]] = [(0, START, 0, 0, "")]
    while stack:
        at, role, cost, depth, edit = stack.pop()
        del path[depth:]
        path.append(edit)
        node = len(AFTER) * at + role
        if incumbent and cost + bounds[node] >= incumbent[0]:
            continue  # as dear at best, and its letters come later
        if seen[node] is not None and seen[node] <= cost:
            continue  # an earlier prefix costs no more, and its letters come first
        seen[node] = cost
        if at == n and role in (START, ASSISTANT):
            incumbent = (cost, "".join(path))
            continue
        options = [(at, INSERTED[role], cost + INSERT_COST, depth + 1, INSERT)]
        if at < n:
            options += [(at + 1, to[role], cost + price, depth + 1, e) for e, price, to in MOVES[letters[at]] if role in to]
        open_ones = [o for o in options if o[2] + bounds[len(AFTER) * o[0] + o[1]] <= limit]
        stack += sorted(open_ones, key=lambda o: o[4], reverse=True)  # the least letter is taken up first
    assert incumbent is not None
    return incumbent


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: messages spoiled by a hash of conversation and turn, a missing value as one space.

    One in twenty each is dropped (no copies), emptied, loses its sentence ends, comes twice, or becomes the user's.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    kind = F.crc32(name) % 20
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def identity() -> Column:
    """Digest of conversation, role and text."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(conv), F.lit(":"), conv, F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256))


def letters(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, same, letter, blank, copies)``: the letter of a message, the one for those that must go where its role and text came before.

    Equal messages of one turn are one row with all their copies.
    """
    shown = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    plain = F.when(~F.col("text").rlike(VISIBLE), GONE).when(F.substring(shown, -1, 1).isin(*SENTENCE_END), known).otherwise(F.upper(known))
    slim = materialise(messages.select("conv_id", *ORDER, plain.alias("letter"), "copies")
                       .groupBy("conv_id", *ORDER, "letter").agg(F.sum("copies").cast("bigint").alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    groups = materialise(slim.groupBy("same").agg(F.min(F.when(F.col("copies") > 0, place)).alias("first"), F.count(F.lit(1)).alias("n")))
    met = skew.salted_lookup(slim, groups.select("same", "first"), ["same"], groups.select("same", "n"), "n", ["turn"])
    is_first = F.coalesce(place == F.col("first"), F.lit(False))
    return met.select("conv_id", *ORDER, F.when(is_first, F.col("letter")).otherwise(GONE).alias("letter"),
                      (F.col("letter") == GONE).alias("blank"), "copies")


def in_order(df: DataFrame, *before: str) -> DataFrame:
    """A conversation in one task, in order. Rows stream, so what a task holds at a time does not depend on the conversation."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *before, *ORDER)


PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class Conversation:
    """What is counted of one conversation while its messages pass by."""

    def __init__(self, conv_id: object):
        self.conv_id, self.letters, self.last = conv_id, [], None
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.illegal = 0

    def add(self, turn: int | None, role: str, letter: str, blank: bool, copies: int) -> None:
        if copies == 0:
            return
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        self.letters.append(letter + GONE * (copies - 1))
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - (letter != GONE)
        self.illegal += (self.last is not None and self.last + role[:1] not in LEGAL) + (copies - 1)
        self.last = role[:1]

    def row(self) -> tuple:
        joined = "".join(self.letters)
        cost, audit = cheapest_repair(joined)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, sum(map(str.isupper, joined)), self.illegal, cost, audit


def repair_plans(messages: DataFrame) -> DataFrame:
    """Per conversation its faults and the cheapest edits. A conversation without messages has none and costs nothing."""
    id_type = messages.schema["conv_id"].dataType.simpleString()

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Conversation | None = None
        for batch in batches:
            done = []
            for conv_id, turn, role, letter, blank, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = Conversation(conv_id)
                current.add(turn, role, letter, blank, copies)
            if done:
                yield rows(done, batch.schema.field("conv_id").type)
        if current is not None:
            yield rows([current.row()], batch.schema.field("conv_id").type)

    def rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string()]
        names = ["conv_id", *[p.split()[0] for p in PLAN.split(", ")]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    ordered = in_order(letters(messages)).select("conv_id", "turn", "role", "letter", "blank", "copies")
    return ordered.mapInArrow(plan, f"conv_id {id_type}, {PLAN}")


class Editor:
    """Applies the edits of one conversation to its messages as they pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.placed = audit, 0, 0
        self.has_system = (len(audit) - audit.count(DELETE)) % 2  # only a first system message makes the number odd

    def place(self) -> tuple[int, str]:
        """Number and expected initial of the next message of the result."""
        i, self.placed = self.placed, self.placed + 1
        return i, "s" if i < self.has_system else "ua"[(i - self.has_system) % 2]

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            i, initial = self.place()
            yield i, NAMES[initial], ""

    def message(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != DELETE:
            i, initial = self.place()
            yield i, role if edit == KEEP else NAMES[initial], text


def _edited(messages: DataFrame, plans: DataFrame) -> DataFrame:
    """Per conversation its plan, then its repaired messages in order, in one task."""
    id_type = messages.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, position bigint, role string, text string, {PLAN}"
    plan_names = [p.split()[0] for p in PLAN.split(", ")]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, owner, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv_id, role, text, copies, *plan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if plan[-1] is not None:  # the plan leads its conversation
                    if editor:
                        done += [(owner, *m, *[None] * len(plan)) for m in editor.inserted()]
                    editor, owner = Editor(plan[-1]), conv_id
                    done.append((conv_id, None, None, None, *plan))
                    continue
                for _ in range(copies):
                    done += [(owner, *m, *[None] * len(plan)) for m in editor.message(role, text)]
            yield batch_of(done, kind)
        if editor:
            yield batch_of([(owner, *m, *[None] * len(plan_names)) for m in editor.inserted()], kind)

    def batch_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
        columns = list(zip(*done, strict=True)) if done else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "position", "role", "text", *plan_names])

    body = messages.where(F.col("copies") > 0).select("conv_id", F.lit(1).alias("kind"), *ORDER, "text", "copies")
    both = plans.withColumn("kind", F.lit(0)).unionByName(body, allowMissingColumns=True)
    return in_order(both, "kind").select("conv_id", "role", "text", "copies", *plan_names).mapInArrow(edit, schema)


def prepared(messages: DataFrame) -> DataFrame:
    """The columns the operator reads, with a missing role or text as one space."""
    copies = F.col("copies").cast("int") if "copies" in messages.columns else F.lit(1)
    filled = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                             F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    return filled.withColumn("same", identity())


def repaired(messages: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)`` of the repaired conversations. Takes ``(conv_id, turn, role, text)`` and, if there, ``copies``."""
    rows = prepared(messages)
    return _edited(rows, repair_plans(rows)).where(F.col("position").isNotNull()).select("conv_id", "position", "role", "text")


def repair_digests(messages: DataFrame) -> DataFrame:
    """Per conversation its faults, cost, edits and the SHA-256 of its repaired messages as ``role:text`` lines.

    Messages of equal turn, a missing turn first, are taken by role and then by a digest of the text; repeated rows follow
    each other. A missing conv_id is a conversation of its own, a missing role or text is one space. A conversation all of
    whose messages have no copies keeps its row: zeros, no edits, the digest of nothing. No rows give no rows. Columns of
    other names are ignored. The digest of one conversation is a sequence by nature: its messages stream through one task.
    """
    id_type = messages.schema["conv_id"].dataType.simpleString()
    plan_names = [p.split()[0] for p in PLAN.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, line, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv_id, position, role, text, *plan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position is None:
                    if head:
                        done.append((*head, line.hexdigest()))
                    head, line = (conv_id, *plan), hashlib.sha256()
                else:
                    line.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if done:
                yield batch_of(done, kind)
        if head:
            yield batch_of([(*head, line.hexdigest())], kind)

    def batch_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)],
                                          ["conv_id", *plan_names, "repaired_sha256"])

    rows = prepared(messages)
    return _edited(rows, repair_plans(rows)).mapInArrow(digest, f"conv_id {id_type}, {PLAN}, repaired_sha256 string")
