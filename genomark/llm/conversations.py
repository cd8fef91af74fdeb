"""Conversation structure repair: a retained-subsequence dynamic program over the turns of each conversation.

A repaired conversation's roles have the initials ``(s?(ua)+)?``. Turns are kept (0), given another role (2) or deleted
(3, required for blank turns and duplicates); empty turns are inserted (2 each); a truncated turn that isn't deleted
adds 1. The program chooses the retained turns: for each state (nothing yet, after system, user, assistant) it holds
the cheapest way to end in it. A turn that is passed over adds its deletion to every state's running minimum, and the
roles on both sides of a gap say what must be inserted between them. Of equally cheap edits the audit string (D, I, K, R
in order) decides, ASCII-least first. Ways that cost over ``SPREAD`` more than the cheapest can't win any more, so
what matters of the past is a short signature (states, their order and relative costs); a turn's effect on
a signature is worked out once and looked up from then on.

The work is dealt by ranges of (conv_id, turn, role, text), so a conversation of any length is spread over
tasks. Those that lie inside a range are repaired there. Of those at a range's ends, and of long ones, the turns are packed in
blocks, which meet in order in a second, streaming pass. It holds, for the conversation at hand, 4 bytes a turn for the
audit, a 16-byte digest for each distinct (role, text), and running SHA-256 states instead of texts.

Rows come in order of turn (nulls first), then role and text, so ties and repeated rows have one order. Null fields count as one
space; null conv_ids are one conversation, which stays null. Empty texts are blank; long ones make blocks of their own. Other columns are
ignored. A conversation of which no row is left has zeros, an empty audit and the hash of the empty string. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.llm.common import worker_cache, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: No state's future costs over this more than another's: a user, an assistant and a deleted system turn (7) turn any into any.
SPREAD = 7
ROLES = {"u": "user", "a": "assistant"}
#: Roles to insert before a retained turn of the second state, by the state before it, and at the end.
GAPS = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
ENDS = {"": "", "a": "", "u": "a", "s": "ua"}
#: Bytes of text in a block, and turns.
BLOCK_BYTES, BLOCK_TURNS = 1 << 20, 4096

SPACE = " \t\n\x0b\f\r"

RESULT = [("conv_id", "long"), *((x, "long") for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string")]
REPAIRED = [("repaired", "array<struct<role:string,text:string>>")]
BLOCK = [("part", "long"), ("nr", "long"), ("turns", "array<struct<turn:long,role:string,text:string>>")]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows, damaged by crc32(conv_id:turn) % 20: 0 drops a row (its conv_id stays, with a null role), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets the role user. Null fields are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).when(kind != 0, space("text"))
    role = F.when(kind == 4, "user").when(kind != 0, space("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies).drop("copy")


def repair(turns: DataFrame, with_turns: bool = False) -> DataFrame:
    """gaps, counts of faults, cost, audit and repaired_sha256 of every conversation. A turn with a null role only says that its conversation exists.

    with_turns: its repaired turns as well, as one array (so they must fit in a task).
    """
    order = ["conv_id", "turn", "role", "text"]
    result = RESULT + REPAIRED * with_turns
    # Rows that are all alike can be many: their numbers spread them over ranges.
    rows = turns.select(*order).withColumn("_row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").select(*order)
    both = written(ranged.mapInArrow(_inside_ranges(with_turns), _schema(result + BLOCK)), "conversations")
    done = both.where("turns IS NULL").select(*(c for c, _ in result))
    blocks = both.where("turns IS NOT NULL").select("conv_id", "part", "nr", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "part", "nr")
    return done.unionByName(blocks.mapInArrow(_over_blocks(with_turns), _schema(result)))


def digests(conversations: DataFrame) -> DataFrame:
    """The repairs of the damaged conversations."""
    return repair(damaged(conversations))


def _schema(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns)


_ARROW = {"long": pa.int64(), "string": pa.string(), REPAIRED[0][1]: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), BLOCK[2][1]: pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))}


def _batch(rows: list[dict], columns: list[tuple[str, str]]) -> pa.RecordBatch:
    """A row lacks what is null in it."""
    return pa.RecordBatch.from_arrays([pa.array([row.get(name) for row in rows], _ARROW[kind]) for name, kind in columns], names=[name for name, _ in columns])


def _inside_ranges(with_turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        columns, part = RESULT + REPAIRED * with_turns + BLOCK, TaskContext.get().partitionId()
        out, buffer, size, blocks = [], [], 0, 0  # blocks: of the conversation at hand
        key, at_start, nr = None, None, 0

        def block() -> None:
            nonlocal buffer, size, blocks, nr
            out.append({"conv_id": key, "part": part, "nr": nr, "turns": buffer})
            buffer, size, blocks, nr = [], 0, blocks + 1, nr + 1

        for batch in batches:
            for turn in batch.to_pylist():
                conv_id = turn.pop("conv_id")
                if at_start is None:
                    key, at_start = conv_id, True
                elif conv_id != key:
                    if at_start or blocks:
                        if buffer:
                            block()
                    else:
                        out.append({"conv_id": key} | Conversation(with_turns).fed(buffer).result())
                    key, at_start, buffer, size, blocks = conv_id, False, [], 0, 0
                buffer.append(turn)
                size += len(turn["text"] or "")
                if size > BLOCK_BYTES or len(buffer) >= BLOCK_TURNS:
                    block()
            if out:
                yield _batch(out, columns)
                out.clear()
        if buffer:
            block()
            yield _batch(out, columns)

    return run


def _over_blocks(with_turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conversation = None, None
        for batch in batches:
            out = []
            for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns"), strict=True):
                if conversation is None or conv_id != key:
                    if conversation:
                        out.append({"conv_id": key} | conversation.result())
                    key, conversation = conv_id, Conversation(with_turns)
                conversation.fed(turns.as_py())
            if out:
                yield _batch(out, RESULT + REPAIRED * with_turns)
        if conversation:
            yield _batch([{"conv_id": key} | conversation.result()], RESULT + REPAIRED * with_turns)

    return run


class Steps:
    """Steps of the program. A signature has (state, cost above the least) of each way, in the order of their audits: all have the same
    turns behind them and end in an edit of the last one, so none is a prefix of another, and what follows can't change the order."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.known: list[tuple] = []

    def number(self, signature: tuple, initial: str, must_go: bool, add: int) -> int:
        found = self.numbers.get((signature, initial, must_go, add))
        if found is None:
            found = self.numbers[signature, initial, must_go, add] = len(self.known)
            self.known.append(self._made(signature, initial, must_go, add))
        return found

    def _made(self, signature: tuple, initial: str, must_go: bool, add: int) -> tuple:
        """What the least cost rises by, the new signature, and for each of its ways: the way before, the edits, what to write before the turn's text (None: the turn goes), and whether its own role comes between."""
        ways: dict[str, tuple] = {}

        def offer(to: str, cost: int, k: int, edits: str, *write) -> None:
            if to not in ways or (cost, k, edits) < ways[to][:3]:
                ways[to] = (cost, k, edits, *write)

        for k, (state, cost) in enumerate(signature):
            offer(state, cost + DELETE, k, "D", None, False)
            for to in () if must_go else "sua":
                own = to == initial
                if (state, to) in GAPS and (own or to != "s"):
                    gap = GAPS[state, to]
                    write = ("\n" if state else "") + "".join(f"{ROLES[x]}:\n" for x in gap) + ("" if own else ROLES[to])
                    offer(to, cost + INSERT * len(gap) + add + (KEEP if own else REROLE), k, "I" * len(gap) + ("K" if own else "R"), write, own)
        least = min(way[0] for way in ways.values())
        live = sorted((k, edits, cost - least, to, write, own) for to, (cost, k, edits, write, own) in ways.items() if cost - least <= SPREAD)
        return least, tuple((to, cost) for _, _, cost, to, _, _ in live), tuple((k, edits, write, own) for k, edits, _, _, write, own in live)


class Conversation:
    """One conversation, fed its turns in order."""

    def __init__(self, with_turns: bool = False):
        self.turns: list | None = [] if with_turns else None
        self.low = self.last_turn = self.initial = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.seen: set[bytes] = set()
        self.signature: tuple = (("", 0),)
        self.hashes = [hashlib.sha256()]
        self.path = array("I")
        self.steps: Steps = worker_cache("conversation-steps", Steps)

    def fed(self, turns: list[dict]) -> Conversation:
        for row in turns:
            turn, role, text = row["turn"], row["role"], row["text"]
            if role is None:
                continue
            if turn is not None and turn != self.last_turn:
                self.low, self.last_turn, self.n_turns = turn if self.low is None else self.low, turn, self.n_turns + 1
            initial = role[:1]
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            said = text.rstrip(SPACE)
            blank = not said
            duplicate = not blank and digest in self.seen
            truncated = not blank and not duplicate and said[-1] not in ".!?"
            self.seen.add(digest)
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
            number = self.steps.number(self.signature, initial if initial in ("s", "u", "a") else "", blank or duplicate, TRUNCATED * truncated)
            rise, self.signature, ways = self.steps.known[number]
            self.cost += rise
            self.path.append(number)
            hashes = []
            for before, _, write, own in ways:
                h = self.hashes[before].copy()
                if write is not None:
                    h.update(f"{write}{role if own else ''}:{text}".encode())
                hashes.append(h)
            self.hashes = hashes
            if self.turns is not None:
                self.turns.append((role, text))
        return self

    def result(self) -> dict:
        cost, k = min((cost + INSERT * len(ENDS[state]), k) for k, (state, cost) in enumerate(self.signature))
        state = self.signature[k][0]
        h = self.hashes[k]
        h.update(("\n" if state and ENDS[state] else "").encode() + "\n".join(f"{ROLES[x]}:" for x in ENDS[state]).encode())
        edits = ["I" * len(ENDS[state])]
        for number in reversed(self.path):
            k, edit, _, _ = self.steps.known[number][2][k]
            edits.append(edit)
        audit = "".join(reversed(edits))
        gaps = self.last_turn - self.low + 1 - self.n_turns if self.n_turns else 0
        found = {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost + cost, "audit": audit, "repaired_sha256": h.hexdigest()}
        return found if self.turns is None else found | {"repaired": _applied(self.turns, audit)}


def _applied(turns: list[tuple[str, str]], audit: str) -> list[dict]:
    """The turns that an audit makes: after a user comes an assistant, else a user."""
    left, made = iter(turns), []
    for edit in audit:
        role, text = next(left) if edit != "I" else (None, "")
        if edit in "IR":
            role = ROLES["a" if made and made[-1]["role"][:1] == "u" else "u"]
        if edit != "D":
            made.append({"role": role, "text": text})
    return made
