import hashlib
import heapq
import random
import re
import zlib

import pytest

from millrace.llm import conversations

GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row] * (2 if kind == 3 else 1)
    return out


def cheapest(letters):
    """Dijkstra over (rows done, grammar state) by (cost, audit): nothing is computed from the end."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, path = heapq.heappop(heap)
        if i == len(letters) and q in (0, 3):
            return cost, audit, path
        if (i, q) in done:
            continue
        done.add((i, q))
        for r in "ua":
            if (q, r) in GRAMMAR:
                heapq.heappush(heap, (cost + 2, audit + "I", i, GRAMMAR[q, r], (*path, (None, r))))
        if i < len(letters):
            role, fault = letters[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, path))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if (q, role) in GRAMMAR:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, GRAMMAR[q, role], (*path, (i, None))))
                for r in "ua":
                    if (q, r) in GRAMMAR:
                        heapq.heappush(heap, (cost + cut + 2, audit + "R", i + 1, GRAMMAR[q, r], (*path, (i, r))))


def slow(rows):
    """conv_id -> (report, repaired rows) of rows as they are."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in damaged(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, path = cheapest([(r[2][:1], f) for r, f in zip(mine, faults, strict=True)])
        fixed = [(NAMES.get(r, mine[i][2] if i is not None else None), mine[i][3] if i is not None else "") for i, r in path]
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])),
            cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        ), fixed
    return out


def random_rows(rng, convs):
    rows = []
    for c in convs:
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Hi.", "Well", "So? ", " ", "", None, "É!\n", "a.b", f"t{rng.randint(0, 9)}."])
            rows.append((c, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [conversations.BLOCK, 1, 3])
def test_report_against_slow(spark, block):
    """Blocks of one and three letters carry costs and grammar states over the blocks' ends."""
    rng = random.Random(block)
    rows = random_rows(rng, [*range(60), None]) + [(1000, 0, "user", "One."), (1000, 0, "user", "One.")] * 9
    rows += [(c, t, "user", "gone.") for c, t in ((c, t) for c in range(2000, 2600) for t in (0,)) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, times int, audits string")
    want = slow(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_report(*conversations.damage(df), block=block).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    assert any(w[0] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for w in want.values())
    fixed = {}
    for r in conversations.repaired(*conversations.damage(df), block=block).orderBy("conv_id", "seq").collect():
        fixed.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert fixed == {c: w[1] for c, w in want.items() if w[1]}


def test_nodes_are_the_cheapest_edits_for_every_short_signature():
    import itertools

    faults = {"x": "blank"}
    for n in range(5):
        for sig in itertools.product("suaoSUAx", repeat=n):
            node = conversations.END
            for letter in reversed(sig):
                node = conversations.before(letter, node)
            cost, audit, _ = cheapest([(x.lower(), faults.get(x, "truncated" if x.isupper() else "")) for x in sig])
            assert node[0] == (cost, audit), sig


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair_report(df).collect() == [] == conversations.repaired(df).collect()


def test_one_long_conversation(spark):
    df = spark.range(5000).selectExpr("7 AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, CASE WHEN id % 10 = 0 THEN '' ELSE '.' END) AS text")
    r = conversations.repair_report(df).first()
    assert (r["gaps"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (0, 500, 0, 500, "K" * 5000)
