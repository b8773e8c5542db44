"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib

import brute
import pytest

from tablewright.llm import conversations
from tablewright.llm.queries import QUERIES

AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WRITTEN = {0: "user", 1: "user", 2: "assistant", 3: "user"}
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        yield from [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def plain_repair(rows):
    """The report of one conversation's rows, every reachable (state, cost, audit) kept per row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = {r[1] for r in rows if r[1] is not None}
    counts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    best = {0: (0, "", [])}

    def inserts(best):
        best = dict(best)
        for _ in range(3):
            for q, (cost, audit, lines) in list(best.items()):
                to = {"user": 2, "assistant": 3}[WRITTEN[q]]
                new = (cost + 5, audit + "I", [*lines, f"{WRITTEN[q]}:"])
                best[to] = min(best.get(to, new), new)
        return best

    for _, _, role, text in rows:
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        after = {}

        def put(q, new):
            after[q] = min(after.get(q, new), new)

        for q, (cost, audit, lines) in inserts(best).items():
            put(q, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if (q, role[:1]) in AFTER:
                    put(AFTER[q, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                put({"user": 2, "assistant": 3}[WRITTEN[q]], (cost + 1 + more, audit + "R", [*lines, f"{WRITTEN[q]}:{text}"]))
        best = after
    cost, audit, lines = min(v for q, v in inserts(best).items() if q in (0, 3))
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_report(rows):
    groups = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    return [(k, *plain_repair(v)) for k, v in groups.items()]


def random_rows(rng, conversations_, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", None]
    texts = ["Yes.", "No!", "why", "", " \t", None, "a b. ", "c.\n\x0b", "Ünd?", "x.y"]
    rows = []
    for c in range(conversations_):
        regular = rng.random() < 0.5
        for t in range(rng.randint(1, most)):
            role = ("user", "assistant")[t % 2] if regular and rng.random() < 0.9 else rng.choice(roles)
            text = f"text {rng.random()}." if rng.random() < 0.7 else rng.choice(texts)
            rows.append((c, t if rng.random() < 0.95 else rng.choice([None, t + 3]), role, text))
    return rows


@pytest.mark.parametrize("block", [2048, 5, 1])
def test_conversations(spark, monkeypatch, block):
    """Any cut into blocks gives the same edits."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    rows = random_rows(rng, 150, 14) + random_rows(rng, 1, 2)[:0] + [(None, None, None, None), (None, 2, "user", "Who."), (900, None, "user", "a."), (900, None, "user", "a.")]
    rows += [(901, t, ("user", "assistant")[t % 2], "again." if t % 5 == 0 else f"say {t}") for t in range(400)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, `position` string, block int").repartition(3)
    brute.alike(conversations.damage_and_repair(df).collect(), plain_report(rows))


def test_repaired_rows_follow_the_pattern(spark):
    rows = [r for r in random_rows(random.Random(3), 60, 9)]
    given = conversations.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    totals, edits = conversations.plan_repairs(given)
    out = conversations.repaired(given, edits).orderBy("conv_id", "position", "part").collect()
    assert totals.count() == 60 and len(out)
    for c in range(60):
        initials = [r["role"][0] for r in out if r["conv_id"] == c]
        rest = initials[1:] if initials[:1] == ["s"] else initials
        assert rest == ["u", "a"] * (len(rest) // 2) and (rest or not initials)
    assert all(r["text"] == "" for r in out if r["edit"] == "insert")


def test_paths_of_equal_cost_take_the_least_audit():
    """Every audit of the least cost, written out, against the ranked one."""
    import itertools

    for symbols in itertools.product([0, 1, 2, 3, 9, 10], repeat=3):
        rows = [(0, i, {0: "s", 1: "u", 2: "a", 3: "t"}[s & 3], f"{i}" + ("" if s & 8 else ".")) for i, s in enumerate(symbols)]
        found = bytes(symbols)
        paths = conversations._Paths([found], conversations._LAST[None], conversations.np.array([True]))
        (audit,), _ = paths.audits(0, [0])
        assert audit.translate(str.maketrans("uaUA", "IIRR")) == plain_repair(rows)[6]


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.damage_and_repair(df).count() == 0


def test_registered_query(spark, tmp_path):
    rows = random_rows(random.Random(8), 200, 8)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    brute.alike(QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect(), plain_report(rows))
