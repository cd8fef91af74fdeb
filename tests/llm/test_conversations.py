"""Conversation repair against a search of all edits, and the rows of odd inputs."""

import hashlib
import random
import re
import zlib

import pytest

from genomark.llm import conversations as C

DATA = "/root/testdata/sf0.01"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def best_edits(rows):
    """Every sequence of edits of rows (role, must go, truncated) is tried: cost, audit, roles and row numbers of the cheapest, ASCII-least one."""
    best = (3 * len(rows), "D" * len(rows), ())

    def go(i, cost, audit, out):
        nonlocal best
        if cost > best[0] or len(out) > 2 and not re.match(r"s?(ua)*u?\Z", "".join(r[:1] for r, _ in out)):
            return
        if i == len(rows):
            if GOOD.match("".join(r[:1] or "?" for r, _ in out)):
                best = min(best, (cost, audit, out))
        else:
            role, must_go, truncated = rows[i]
            go(i + 1, cost + 3, audit + "D", out)
            if not must_go:
                go(i + 1, cost + truncated, audit + "K", (*out, (role, i)))
                for to in ("user", "assistant"):
                    go(i + 1, cost + 2 + truncated, audit + "R", (*out, (to, i)))
        for to in ("user", "assistant"):
            go(i, cost + 2, audit + "I", (*out, (to, None)))

    go(0, 0, "", ())
    return best


def plain(rows, search=best_edits):
    """The contract's row of one conversation from its rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, out = search([(r[1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
    said = "\n".join(f"{role}:{'' if i is None else rows[i][2]}" for role, i in out)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(said.encode()).hexdigest(),
    }


def damage(rows):
    """conv_id -> rows after damage, of rows (conv_id, turn, role, text)."""
    out = {}
    for conv_id, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        k, kept = zlib.crc32(f"{say(conv_id)}:{say(turn)}".encode()) % 20, out.setdefault(conv_id, [])
        text = "" if k == 1 else re.sub("[.!?]", "", say(text)) if k == 2 else say(text)
        kept += [(turn, "user" if k == 4 else say(role), text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def got(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_a_conversation_is_repaired_at_least_cost():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randrange(6)
        rows = [(k, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "No", "", "Why?", f"t{k}.", f"x{k}"])) for k in range(n)]
        made = C.Conversation(True).fed([dict(zip(("turn", "role", "text"), r, strict=True)) for r in rows]).result()
        turns = made.pop("repaired")
        assert made == plain(rows), rows
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest() == made["repaired_sha256"]


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_over_the_table(spark, partitions, monkeypatch):
    """Whole conversations, and with small blocks: each is the plain one."""
    table = spark.read.parquet(f"{DATA}/conversations.parquet").limit(10**9)
    want = {k: plain(v, search=_by_state) for k, v in damage(map(tuple, table.collect())).items()}
    monkeypatch.setattr(C, "BLOCK_TURNS", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert got(C.digests(table)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _by_state(rows):
    """Of each state and turn the least (cost, audit, out), all texts in full; for conversations too long for all edits."""
    moves = {("", "s"): (), ("", "u"): (), ("", "a"): ("user",), ("s", "u"): (), ("s", "a"): ("user",), ("u", "a"): (), ("u", "u"): ("assistant",), ("a", "u"): (), ("a", "a"): ("user",)}
    ways = {"": (0, "", ())}
    for i, (role, must_go, truncated) in enumerate(rows):
        new = {}
        for state, (cost, audit, out) in ways.items():
            new.setdefault(state, []).append((cost + 3, audit + "D", out))
            for to, letter, price in () if must_go else ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                if (state, to[:1]) in moves:
                    gap = moves[state, to[:1]]
                    new.setdefault(to[:1], []).append((cost + 2 * len(gap) + price + truncated, audit + "I" * len(gap) + letter, (*out, *((g, None) for g in gap), (to, i))))
        ways = {s: min(w) for s, w in new.items()}
    end = {"": (), "a": (), "u": ("assistant",), "s": ("user", "assistant")}
    return min((c + 2 * len(end[s]), a + "I" * len(end[s]), (*o, *((g, None) for g in end[s]))) for s, (c, a, o) in ways.items())


def test_odd_rows(spark):
    """Nulls in every column, ties, repeated rows, long texts, a conversation of which nothing is left, and one that is far longer than a block."""
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (7, None, "user", "a."), (7, None, "user", "a."), (7, 5, "assistant", "b"), (7, 5, "assistant", "c"), (8, 1, None, "x."), (8, 2, "assistant", "y!  \n"), (9, 0, "user", "z" * 3_000_000), (9, 1, "assistant", "z.")]
    empty = next(k for k in range(1000, 9000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows += [(empty, 1, "user", "gone")]
    rows += [(11, k // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", f"No {k}", " ", f"Why {k}?"])) for k in range(15_000)]
    rows += [(12, 3, "user", "same.")] * 9000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "role AS part", "1 AS turns", "2 AS _row").repartition(6)
    out = C.digests(df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {k: plain(v, search=_by_state) for k, v in damage(rows).items()}
    assert got(out) == want
    assert want[empty] == dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_empty_table(spark):
    assert C.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repaired_turns(spark):
    out = C.repair(spark.createDataFrame([(1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello.")], "conv_id long, turn long, role string, text string"), with_turns=True).first()
    assert out["audit"] == "DIK" or out["audit"] == "IKD"
    assert [tuple(t) for t in out["repaired"]] == [("user", ""), ("assistant", "Hello.")]
