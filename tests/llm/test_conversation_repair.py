import hashlib
import random
import re
import time
import zlib
from itertools import product

import pytest

from cuesheet.llm import conversation_repair as repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, position string, copies_of int, audit string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GOAL = re.compile(r"(s?(ua)+)?")


def every_repair(letters):
    """All edits up to the cost of deleting everything: (cost, letters of edits) of those that give a good conversation."""
    limit, best, open_ones = 4 * len(letters), None, [(0, 0, "", "")]
    while open_ones:
        at, cost, roles, edits = open_ones.pop()
        if cost > limit:
            continue
        if at == len(letters) and GOAL.fullmatch(roles):
            best = min(best or (cost, edits), (cost, edits))
        open_ones += [(at, cost + 3, roles + r, edits + "I") for r in "ua"]
        if at < len(letters):
            one = letters[at]
            open_ones.append((at + 1, cost + 4, roles, edits + "D"))
            if one != "-":
                cut = 3 if one.isupper() else 0
                open_ones.append((at + 1, cost + cut, roles + one.lower(), edits + "K"))
                open_ones += [(at + 1, cost + 3 + cut, roles + r, edits + "R") for r in "ua"]
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_search_equals_all_edits(n):
    for letters in map("".join, product("suaxSUAX-", repeat=n)):
        assert repair.cheapest_repair(letters) == every_repair(letters), letters


def test_search_equals_all_edits_on_longer_ones():
    rng = random.Random(3)
    for _ in range(150):
        letters = "".join(rng.choice("sssuuuaaaxSUA-") for _ in range(rng.choice([3, 3, 4])))
        assert repair.cheapest_repair(letters) == every_repair(letters), letters


def least(letters):
    """Cost by a table of all prefixes, and the least list of edits by keeping whole lists: slow, for middle lengths."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserts(table):
        for _ in range(3):
            for s, (c, e) in list(table.items()):
                for r in "ua":
                    if r in steps[s]:
                        t = steps[s][r]
                        table[t] = min(table.get(t, (c + 3, e + "I")), (c + 3, e + "I"))
        return table

    table = inserts({0: (0, "")})
    for one in letters:
        after = {}
        for s, (c, e) in table.items():
            cut = 3 if one.isupper() else 0
            ways = [(s, 4, "D")]
            if one != "-":
                ways += [(steps[s][one.lower()], cut, "K")] if one.lower() in steps[s] else []
                ways += [(steps[s][r], 3 + cut, "R") for r in "ua" if r in steps[s]]
            for t, price, edit in ways:
                after[t] = min(after.get(t, (c + price, e + edit)), (c + price, e + edit))
        table = inserts(after)
    return min(table[s] for s in (0, 3) if s in table)


def test_search_equals_tables_of_prefixes():
    rng = random.Random(8)
    for _ in range(400):
        letters = "".join(rng.choice("suaxSUAX-uaua") for _ in range(rng.randrange(60)))
        assert repair.cheapest_repair(letters) == least(letters), letters


def test_a_long_conversation_takes_time_in_proportion():
    rng = random.Random(1)
    started = time.time()
    cost, audit = repair.cheapest_repair("".join(rng.choice("suaxSUAX-uaua") for _ in range(200_000)))
    assert cost > 0 and len(audit) >= 200_000 and time.time() - started < 30


def plain(rows):
    """The contract of the query in plain Python."""
    blank = " "
    by_conv = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{blank if conv is None else conv}:{blank if turn is None else turn}".encode()) % 20
        role, text = blank if role is None else role, blank if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by_conv.setdefault(conv, []).extend([(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1))
    done = {}
    for conv, messages in by_conv.items():
        messages.sort(key=lambda m: (m[0] is not None, m[0] or 0))
        counts, letters, seen = {"-": 0, "=": 0, "~": 0}, "", set()
        for _, role, text in messages:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "-" if not shown else "=" if (role, text) in seen else "~" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] and role[:1] in "sua" else "x"
            letters += "-" if fault in ("-", "=") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:], strict=False))
        turns = {m[0] for m in messages if m[0] is not None}
        cost, edits = least(letters)
        n, at, lines = sum(e != "D" for e in edits), 0, []
        for e in edits:
            i = len(lines)
            expected = "system" if n % 2 and i == 0 else ("user", "assistant")[(i - n % 2) % 2]
            message = None if e == "I" else messages[at]
            at += e != "I"
            if e != "D":
                lines.append(f"{expected if e in 'IR' else message[1]}:{message[2] if message else ''}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        done[conv] = (gaps, counts["-"], counts["="], counts["~"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return done


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_every_conversation_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = repair.repair_digests(repair.damaged(table))
    assert got.columns == ["conv_id", *COLUMNS]
    assert result(got) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_missing_values_odd_roles_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "u"]
    texts = ["Yes.", "No", None, "", " \n", "Same.", "é!", "a\nb. ", "x" * 5_000 + "."]
    rows = [(rng.choice([None, *range(30)]), t, rng.choice(roles), rng.choice(texts)) for t in [*range(60), -5, 10**12] for _ in range(6)]
    seen, distinct = set(), []
    for r in rows:  # one message per turn, so that the order is defined without the digest
        if r[:2] not in seen:
            seen.add(r[:2])
            distinct.append(r)
    distinct += [(77, None, "user", "Hello."), (77, None, "user", "Hello."), (78, None, None, None)]
    table = spark.createDataFrame([(*r, "p", 7, "q") for r in distinct], SCHEMA)
    got = repair.repair_digests(repair.damaged(table))
    assert result(got) == plain(distinct)


def test_a_conversation_that_loses_everything_keeps_its_row(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(1, turn, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    assert result(repair.repair_digests(repair.damaged(table))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair_digests(repair.damaged(table.limit(0))).count() == 0


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two!", f"Turn {t}.", f"cut {t}"])) for t in range(6_000)]
    rows += [(i, t, "user", "x.") for i in range(2, 30) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert result(repair.repair_digests(repair.damaged(table))) == plain(rows)


def test_repaired_messages(spark):
    rows = [("c", 1, "assistant", "Hello."), ("c", 2, "assistant", "Again."), ("c", 3, "user", " "), ("d", 1, "system", "Be kind."), ("d", 2, "user", "Hi!")]
    table = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    got = [tuple(r) for r in repair.repaired(table).orderBy("conv_id", "position").collect()]
    assert got == [("c", 0, "user", "Hello."), ("c", 1, "assistant", "Again."), ("d", 0, "system", "Be kind."), ("d", 1, "user", "Hi!"), ("d", 2, "assistant", "")]
