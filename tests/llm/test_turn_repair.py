import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import types as T

from offerloom.llm import turn_repair

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("place", T.StringType()),
        T.StructField("conv", T.StringType()),
        T.StructField("fault", T.StringType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "c", "f") for r in rows], SCHEMA)


def faulty(rows):
    """(role, text, fault) of rows in order."""
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def by_paths(rows, insert=5):
    """(cost, audit, repaired rows) by Dijkstra's method over (row, role before), with whole audits as second key."""
    good = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, made = heapq.heappop(queue)
        if (at, last) in done:
            continue
        if at == len(rows) + 1:
            return cost, audit, made
        done.add((at, last))
        if at == len(rows):
            if last in ("", "a"):
                heapq.heappush(queue, (cost, audit, at + 1, last, made))
        else:
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, last, made))
            if fault not in ("blank", "duplicate"):
                more = cost + (5 if fault == "truncated" else 0)
                if (last, role[:1]) in good:
                    heapq.heappush(queue, (more, audit + "K", at + 1, role[:1], (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (last, new[0]) in good:
                        heapq.heappush(queue, (more + 1, audit + "R", at + 1, new[0], (*made, f"{new}:{text}")))
        for new in ("user", "assistant"):
            if (last, new[0]) in good:
                heapq.heappush(queue, (cost + insert, audit + "I", at, new[0], (*made, f"{new}:")))
    raise AssertionError


def expected(rows):
    """All columns from original rows (conv_id, turn, role, text)."""
    by_conv = {}
    for conv, turn, role, text in rows:
        own = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        judged = faulty([r[1:] for r in own])
        counts = [sum(r[2] == f for r in judged) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = by_paths(judged)
        want[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return want


def random_rows(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        turns = [rng.choice([None, *range(12)]) for _ in range(rng.randint(1, 9))] if rng.random() < 0.5 else range(rng.randint(1, 14))
        for turn in turns:
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "User", "", None, "s", "a"])
            text = rng.choice(["Yes.", "No!", "Why? \n", "cut off", "", " \t", None, f"Text {rng.randrange(10**6)}.", f"open {rng.random()}"])
            rows.append((conv, turn, role, text))
    return rows


def query(spark, rows, folder, name):
    table(spark, rows).repartition(3).write.parquet(f"{folder}/{name}/conversations.parquet")
    return turn_repair.op13_turn_repair(spark, f"{folder}/{name}")


def test_query_against_brute_force(spark, tmp_path):
    rows = random_rows(random.Random(5), 400)
    got = query(spark, rows, tmp_path, "many").collect()
    want = expected(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert {c for w in want.values() for c in w[6]} >= set("DKR")


def test_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = turn_repair.op13_turn_repair(spark, folder).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected(rows)


def walked(plans, rows):
    """(cost, audit) by the DP alone."""
    costs, total, trail = plans.end, 0, []
    for role, _, fault in reversed(rows):
        costs, off, packed = plans.step(costs, role[:1], fault)
        total += off
        trail.append(packed)
    state, audit = turn_repair.BEGIN, ""
    for role, _, _ in rows:
        packed = trail.pop()
        while (edit := turn_repair.EDITS[packed >> 2 * state & 3]) == "I":
            audit, state = audit + "I", turn_repair.FORCED[state][0]
        audit += edit
        state = state if edit == "D" else turn_repair.KEEPS[role[:1]][state] if edit == "K" else turn_repair.FORCED[state][0]
    return costs[0] + total, audit + {0: "", 1: "II", 2: "I", 3: ""}[state]


def test_plain_dp_against_paths():
    """Also with cheap inserts: at their true price a deletion always does."""
    rng = random.Random(9)
    letters = set()
    for insert in (1, 2, 3, 5):
        plans = turn_repair.Plans(insert)
        for _ in range(400):
            rows = faulty([(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c", " ", f"{rng.random()}!"])) for _ in range(rng.randint(0, 9))])
            want = by_paths(rows, insert)[:2]
            assert walked(plans, rows) == want
            letters |= set(want[1])
    assert letters == set("DIKR")


def test_empty_and_lost_conversations(spark, tmp_path):
    assert query(spark, [], tmp_path, "empty").count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    got = query(spark, [(lost, 1, "user", "Hello.")], tmp_path, "lost").collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_giant_conversation(spark, tmp_path):
    """Longer than a batch and than a block of backpointers, with a very long text."""
    rng = random.Random(2)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"Line {k}{rng.choice('.!?,')}") for k in range(70_000)]
    rows[500] = (7, 500, "user", "long " * 200_000 + ".")
    repaired = turn_repair.repair(table(spark, [*rows, (8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]).repartition(3))
    got = {r.conv: r for r in turn_repair.digests(repaired).collect()}
    judged = faulty([r[2:] for r in rows])
    cost, audit = walked(turn_repair.Plans(), judged)
    made, wanted = [], "u"
    for (role, text, _), edit in zip(judged, audit, strict=True):
        if edit != "D":
            role = role if edit == "K" else {"u": "user", "a": "assistant"}[wanted]
            made.append(f"{role}:{text}")
            wanted = "a" if role == "user" else "u"
    assert (got["7"].cost, got["7"].audit) == (cost, audit)
    assert got["7"].repaired_sha256 == hashlib.sha256("\n".join(made).encode()).hexdigest()
    assert got["8"].audit == "KK"


def test_trail_beyond_memory():
    trail = turn_repair.Trail(limit=1000)
    given = [k * 7 % 251 for k in range(3 * turn_repair.Trail.BLOCK + 17)]
    for packed in given:
        trail.push(packed)
    assert [trail.pop() for _ in given] == given[::-1]
    trail.close()
