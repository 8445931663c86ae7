"""Repair of conversations: the cheapest edits that give an optional system turn and then pairs of user and assistant.

A retained turn is kept as it is or gets the other role. Going from the last
turn to the first, the cheapest completion after each retained turn is its own
cost plus the least, over what may be retained next, of the deletions between
(a difference of two deletion sums), the inserts that the two roles demand and
the completion from there; one running minimum for each role holds that least
in constant time. Among equally cheap edits the audit, the string of the edits'
initials, is the least in ASCII: D before I before K before R.

Turns are dealt out by ranges of conversation and turn, so a conversation of
any size is cut into segments over many tasks. A conversation that lies within one
segment is finished where it was read. Of the others, segments exchange digests of their turns
(which are duplicates), then two letters per turn go to the program above,
and the edits come back to the segments. Only the digest of a repaired conversation is a
chain by its nature: its segments pass in order through one task, held one at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_arrow, released

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns and code points of text after which a segment is full.
SEGMENT_TURNS, SEGMENT_CHARS = 1000, 1 << 20
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Inserts between two retained roles, "" being the start and "." the end.
INSERTS = {"s": {"u": 0, "a": 1, ".": 2}, "u": {"a": 0, "u": 1, ".": 1}, "a": {"u": 0, "a": 1, ".": 0}, "": {"s": 0, "u": 0, "a": 1, ".": 0}}
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 40

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def cheapest(roles: str, faults: str) -> tuple[int, str, list[int]]:
    """Cost, audit and, for each turn, where its part of the audit begins.

    ``roles`` has s, u, a or x (any other) for each turn; ``faults`` has b
    (blank), d (duplicate), t (truncated) or -.
    """
    n = len(roles)
    end = DELETE * n
    # Completion costs from turn i on, deletions summed from the first turn: retained as s, u or a, and the least over all turns from i on.
    best = {q: array("q", [FAR]) * (n + 1) for q in "sua"}
    least = {q: array("q", [FAR]) * (n + 1) for q in "sua"}
    for i in range(n - 1, -1, -1):
        for q in "sua":
            least[q][i] = least[q][i + 1]
        if faults[i] in "bd":
            continue
        own = TRUNCATED if faults[i] == "t" else 0
        for q in "sua":
            if q == "s" and roles[i] != "s":
                continue
            nexts = INSERTS[q]
            after = end + INSERT * nexts["."]
            for r in "ua":
                if r in nexts:
                    after = min(after, least[r][i + 1] + INSERT * nexts[r])
            # Deletions before this turn are paid by whoever comes before: only those after it remain.
            cost = own + (0 if q == roles[i] else REROLE) + after - DELETE * (i + 1)
            best[q][i] = cost + DELETE * i
            if best[q][i] < least[q][i]:
                least[q][i] = best[q][i]

    def ahead(state: str, i: int) -> int:
        """Least cost when ``state`` was retained last and turns before i are done."""
        nexts = INSERTS[state]
        return min(end + INSERT * nexts["."], *(least[r][i] + INSERT * nexts[r] for r in "sua" if r in nexts)) - DELETE * i

    total, state, audit, at = ahead("", 0), "", [], []
    want = total
    for i in range(n):
        at.append(len(audit))
        if ahead(state, i + 1) + DELETE == want:
            audit.append("D")
            want -= DELETE
            continue
        # Retained: an insert before a keep before a new role.
        for many, q in sorted(((INSERTS[state][q], q) for q in "sua" if q in INSERTS[state]), key=lambda x: (-x[0], x[1] != roles[i])):
            if best[q][i] - DELETE * i + INSERT * many == want:
                audit += ["I"] * many + ["K" if q == roles[i] else "R"]
                want = ahead(q, i + 1)
                state = q
                break
    audit += ["I"] * INSERTS[state]["."]
    return total, "".join(audit), at


def applied(state: str, audit: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every edit of these turns; ``state`` is the role initial before them. A deleted turn keeps its own."""
    i = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else (roles[i], texts[i])
        i += edit != "I"
        if edit != "D":
            state = role[:1] if edit == "K" else "a" if state == "u" else "u"
            role = role if edit == "K" else NAMES[state]
        yield edit, role, text


def after(state: str, audit: str, roles: str) -> str:
    """The state that ``applied`` ends with."""
    i = 0
    for edit in audit:
        if edit != "D":
            state = roles[i] if edit == "K" else "a" if state == "u" else "u"
        i += edit != "I"
    return state


@dataclass
class _Segment:
    """Turns of one conversation in order, with what is known of them without the others."""

    conv: object
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    faults: list = field(default_factory=list)
    seen: set = field(default_factory=set)
    first: int | None = None
    last: int | None = None
    distinct: int = 0
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        said = text.rstrip(WHITE_SPACE)
        key = (role, text)
        self.faults.append("b" if not said else "d" if key in self.seen else "t" if said[-1] not in ".!?" else "-")
        self.seen.add(key)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def initials(self) -> str:
        return "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r in self.roles)

    def full(self, turns: int) -> bool:
        return len(self.roles) >= turns or self.chars >= SEGMENT_CHARS

    def digests(self) -> list[dict]:
        """One for each turn that is neither blank nor seen in this segment; 32 bytes over conversation, role and text."""
        out = []
        for i, (role, text, fault) in enumerate(zip(self.roles, self.texts, self.faults, strict=True)):
            if fault != "d":
                raw = f"{self.conv!r}\0{len(role)}\0{role}{text}".encode()
                out.append({"turn": i, "digest": hashlib.blake2b(raw, digest_size=32).digest()})
        return out


def _counted(initials: str, faults: str, gaps: int) -> tuple[dict, str, list[int]]:
    cost, audit, at = cheapest(initials, faults)
    illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
    found = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost)
    return dict(zip(COUNTS, found, strict=True)), audit, at


_RESULT = {c: pa.int64() for c in COUNTS} | {"audit": pa.string(), "repaired_sha256": pa.string()}
_SEGMENT = {
    "part": pa.int32(),
    "seq": pa.int32(),
    "initials": pa.string(),
    "faults": pa.string(),
    "first": pa.int64(),
    "last": pa.int64(),
    "distinct": pa.int64(),
    "digests": pa.list_(pa.struct([("turn", pa.int32()), ("digest", pa.binary())])),
    "roles": pa.list_(pa.string()),
    "texts": pa.list_(pa.string()),
}
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", _SEGMENT["digests"]: "array<struct<turn:int,digest:binary>>", _SEGMENT["roles"]: "array<string>"}


def _schema(conv: str, columns: dict) -> str:
    return ", ".join([f"conv {conv}", *(f"`{c}` {_SQL[k]}" for c, k in columns.items())])


def _batch(rows: list[dict], conv: pa.DataType, columns: dict) -> pa.RecordBatch:
    kinds = {"conv": conv} | columns
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], names=list(kinds))


def _digest(parts: Iterator[tuple[str, str, str]]) -> bytes:
    """Kept and inserted turns, each followed by a line feed."""
    return "".join(f"{role}:{text}\n" for edit, role, text in parts if edit != "D").encode("utf-8", "surrogatepass")


def _segments(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, absent: Column | None, whole_texts: bool, segment_turns: int) -> DataFrame:
    """Finished conversations (``initials`` null unless their turns are asked for) and the segments of the others (``audit`` null)."""
    conv = df.schema[conv_col].dataType.simpleString()
    columns = _RESULT | _SEGMENT

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, now, kind = TaskContext.get().partitionId(), 0, True, None, None
        out: list[dict] = []
        size = 0

        def closed(last: bool, cut: bool) -> dict:
            """The current conversation's row; one that may go on elsewhere stays a segment."""
            row: dict = {"conv": now.conv, "part": part, "seq": seq}
            open_ = first or last or cut or started
            initials, faults = now.initials(), "".join(now.faults)
            if open_ or whole_texts:
                row |= {"initials": initials, "faults": faults, "roles": now.roles, "texts": now.texts}
            if open_:
                return row | {"first": now.first, "last": now.last, "distinct": now.distinct, "digests": now.digests()}
            gaps = now.last - now.first + 1 - now.distinct if now.first is not None else 0
            counts, audit, _ = _counted(initials, faults, gaps)
            made = _digest(applied("", audit, now.roles, now.texts))
            return row | counts | {"audit": audit, "repaired_sha256": hashlib.sha256(made[:-1]).hexdigest()}

        started = False  # whether a segment of the current conversation went out already
        for b in batches:
            kind = b.schema.field(0).type
            for conv_id, turn, role, text, gone in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if now is None or conv_id != now.conv:
                    if now is not None:
                        out.append(closed(False, False))
                        size, seq, first, started = size + now.chars, seq + 1, False, False
                    now = _Segment(conv_id)
                elif now.full(segment_turns):
                    out.append(closed(False, True))
                    size, seq, started = size + now.chars, seq + 1, True
                    now = _Segment(conv_id)
                if not gone:
                    now.add(turn, role, text)
                if size >= SEGMENT_CHARS or len(out) >= SEGMENT_TURNS:
                    yield _batch(out, kind, columns)
                    out, size = [], 0
        if now is not None:
            out.append(closed(True, False))
            yield _batch(out, kind, columns)

    given = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("gone"),
        # Rows that are equal throughout may lie in several tasks.
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = given.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 16), "row").sortWithinPartitions("conv", "turn", "role", "text").drop("row")
    return ordered.mapInArrow(released(read), _schema(conv, columns))


def _edits(open_: DataFrame, conv: str) -> DataFrame:
    """(conv, part, seq, state and number of turns before, piece, and on a conversation's last segment its counts and audit) of the segments of long or cut conversations."""
    said = open_.select("part", "seq", F.inline("digests"))
    earliest = said.groupBy("digest").agg(F.min(F.struct("part", "seq")).alias("lead"))
    later = said.join(earliest, "digest").where(F.struct("part", "seq") != F.col("lead")).groupBy("part", "seq").agg(F.collect_list("turn").alias("repeats"))
    facts = open_.select("conv", "part", "seq", "initials", "faults", "first", "last", "distinct").join(later, ["part", "seq"], "left")
    columns = {"part": pa.int32(), "seq": pa.int32(), "state": pa.string(), "piece": pa.string(), "before": pa.int64()} | {c: k for c, k in _RESULT.items() if c != "repaired_sha256"}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        kind = None

        def done() -> pa.RecordBatch:
            initials, faults, distinct, known = [], [], 0, None
            lowest = next((x["first"] for x in held if x["first"] is not None), None)
            for x in held:
                mine = list(x["faults"])
                for i in x["repeats"] or []:
                    mine[i] = mine[i] if mine[i] == "b" else "d"
                initials.append(x["initials"])
                faults.append("".join(mine))
                if x["first"] is not None:
                    distinct += x["distinct"] - (x["first"] == known)
                    known = x["last"]
            gaps = known - lowest + 1 - distinct if known is not None else 0
            counts, audit, at = _counted("".join(initials), "".join(faults), gaps)
            rows, turn, state, before = [], 0, "", 0
            for x, mine in zip(held, initials, strict=True):
                stop = turn + len(mine)
                piece = audit[at[turn] if turn < len(at) else len(audit) : at[stop] if stop < len(at) else len(audit)] if mine or x is held[-1] else ""
                rows.append({k: x[k] for k in ("conv", "part", "seq")} | {"state": state, "piece": piece, "before": before})
                turn, state, before = stop, after(state, piece, mine), before + len(piece) - piece.count("D")
            rows[-1] |= counts | {"audit": audit}
            return _batch(rows, kind, columns)

        for b in batches:
            kind = b.schema.field("conv").type
            for x in b.to_pylist():
                if held and x["conv"] != held[0]["conv"]:
                    yield done()
                    held = []
                held.append(x)
        if held:
            yield done()

    ordered = facts.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "part", "seq", "initials", "faults", "first", "last", "distinct", "repeats")
    return ordered.mapInArrow(released(solve), _schema(conv, columns))


def _digested(edits: DataFrame, open_: DataFrame, conv: str) -> DataFrame:
    """Counts, audit and digest of every conversation of several segments."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, any_ = hashlib.sha256(), False
        for b in batches:
            out = []
            for i in range(b.num_rows):
                x = {c: b.column(c)[i].as_py() for c in b.schema.names}
                made = _digest(applied(x["state"], x["piece"], x["roles"], x["texts"]))
                # Turns are joined by line feeds, so the last one goes before the next piece.
                if made:
                    sha.update((b"\n" if any_ else b"") + made[:-1])
                    any_ = True
                if x["audit"] is not None:
                    out.append({c: x[c] for c in ("conv", "audit", *COUNTS)} | {"repaired_sha256": sha.hexdigest()})
                    sha, any_ = hashlib.sha256(), False
            yield _batch(out, b.schema.field("conv").type, _RESULT)

    ordered = edits.join(open_.select("part", "seq", "roles", "texts"), ["part", "seq"]).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return ordered.mapInArrow(released(chain), _schema(conv, _RESULT))


def audits(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation.

    A null role or text is one space, so such a text is blank; turns without a
    number come first, and rows of one turn are ordered by role and text. Rows
    where ``absent`` holds are no turns; they only make their conversation
    known, which without any turn gets zeros, an empty audit and the digest of
    nothing. Rows without a conversation are one conversation. A conversation
    that holds a third of all rows is repaired like any other. An empty table
    gives no rows; columns of ``df`` may have any name.
    """
    bounded_arrow(df.sparkSession)
    conv = df.schema[conv_col].dataType.simpleString()
    found = Scratch(df.sparkSession).keep(_segments(df, conv_col, turn_col, role_col, text_col, absent, False, segment_turns), "conversations")
    open_ = found.where(F.col("audit").isNull())
    columns = ["conv", *_RESULT]
    return found.where(F.col("audit").isNotNull()).select(*columns).unionByName(_digested(_edits(open_, conv), open_, conv))


def repair(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """(conv, place, edit, role, text): the repaired turns in order, place from 0 in each conversation; cases as in ``audits``.

    Deleted turns are left out. Inserted ones have an empty text.
    """
    bounded_arrow(df.sparkSession)
    conv = df.schema[conv_col].dataType.simpleString()
    found = Scratch(df.sparkSession).keep(_segments(df, conv_col, turn_col, role_col, text_col, None, True, segment_turns), "conversations")
    open_ = found.where(F.col("audit").isNull())
    columns = ["conv", "state", "piece", "before", "roles", "texts"]
    edits = _edits(open_, conv).select("part", "seq", *columns[:4]).join(open_.select("part", "seq", "roles", "texts"), ["part", "seq"]).select(*columns)
    whole = found.where(F.col("audit").isNotNull()).select("conv", F.lit("").alias("state"), F.col("audit").alias("piece"), F.lit(0).cast("long").alias("before"), "roles", "texts")
    out = {"place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(c)[i].as_py() for c in b.schema.names}
                made = [(e, r, t) for e, r, t in applied(x["state"], x["piece"], x["roles"], x["texts"]) if e != "D"]
                rows = [{"conv": x["conv"], "place": x["before"] + k, "edit": e, "role": r, "text": t} for k, (e, r, t) in enumerate(made)]
                yield _batch(rows, b.schema.field("conv").type, out)

    return whole.unionByName(edits).mapInArrow(released(turns), _schema(conv, out))


def damaged(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, Column]:
    """Faults by the CRC of ``conversation:turn`` modulo 20 (0 absent, 1 emptied, 2 without end marks, 3 repeated, 4 user), and the condition of absence; nulls are one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    fault = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    made = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("absent"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    )
    return made.drop("copy"), F.col("absent")
