"""Repair of the structure of conversations: cheapest edits that give every one a sound order of roles.

Turns are sorted by ranges of conversation and turn, so a conversation of any length is cut over many
tasks. A task parses its conversations one after another (`role_grammar.py`). Those that begin and end
in it are finished there; of the first and the last, and of very long ones, it writes pieces with a
table of the cheapest edits from every stack before to every stack behind the piece. The pieces of a
conversation are put together in their order from these tables.
"""

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import role_grammar as grammar
from ledgerloom.llm.scratch import Scratch, small_batches
from ledgerloom.operators.lookup import join_values

BLANKS = " \t\n\x0b\x0c\r"
PIECE_TURNS = 256  # that one table is made for
PIECE_BYTES = 1 << 20  # of text in a piece, or one turn
WHOLE_PIECES = 64  # that a task keeps of a conversation to finish it by itself
ROWS_OUT = 1000
BYTES_OUT = 4 << 20

FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"


@dataclass
class Piece:
    """Turns of a conversation that follow each other, and what is known of them."""

    turns: list = field(default_factory=list)  # (role, text)
    kinds: list = field(default_factory=list)  # (initial, fault)
    bytes: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    numbers: int = 0  # different turn numbers
    illegal: int = 0

    def add(self, turn, role, text, fault):
        initial = role[:1]
        if self.kinds:
            self.illegal += self.kinds[-1][0] + initial not in grammar.LEGAL
        if turn is not None and turn != self.last_turn:
            self.numbers += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        self.turns.append((role, text))
        self.kinds.append((initial, fault))
        self.bytes += len(text)

    def is_full(self):
        return len(self.turns) >= PIECE_TURNS or self.bytes >= PIECE_BYTES

    def summary(self, entries):
        faults = [sum(fault == f for _, fault in self.kinds) for f in (1, 2, 3)]
        ends = self.kinds[0][0], self.kinds[-1][0]
        numbers = self.first_turn, self.last_turn, self.numbers
        return faults, self.illegal, ends, numbers, grammar.table(self.kinds, entries)


def _put_together(summaries):
    """Figures of a conversation by name, and its audits: one for each piece, one for the end."""
    faults, illegal, last, first_turn, last_turn, numbers = [0, 0, 0], 0, None, None, None, 0
    for found, within, (begin, end), (low, high, n), _ in summaries:
        faults = [a + b for a, b in zip(faults, found)]
        illegal += within + (last is not None and last + begin not in grammar.LEGAL)
        last = end
        if low is not None:
            numbers += n - (low == last_turn)
            first_turn, last_turn = (low if first_turn is None else first_turn), high
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - numbers
    cost, audits = grammar.cheapest([s[4] for s in summaries])
    values = [gaps, *faults, illegal, cost]
    return dict(zip(FIGURES, values)), audits


class _Conversation:
    """Carries out the edits of one conversation piece by piece, in bounded memory."""

    def __init__(self, summaries, conv_id, out):
        self.figures, self.audits = _put_together(summaries)
        self.conv_id, self.out = conv_id, out
        self.stack, self.place, self.digest = grammar.EMPTY, 0, hashlib.sha256()
        self.next = 0

    def edit(self, turns):
        audit = self.audits[self.next]
        self.next += 1
        edits = grammar.edited(self.stack, audit, turns)
        while True:
            try:
                edit, role, text = next(edits)
            except StopIteration as end:
                self.stack = end.value
                return
            line = f"{role}:{text}".encode("utf-8", "surrogatepass")
            self.digest.update(b"\n" + line if self.place else line)
            if self.out.turns:
                row = {"conv_id": self.conv_id, "place": self.place, "edit": edit, "role": role, "text": text}
                self.out.add(row, len(line))
            self.place += 1

    def finish(self):
        self.edit([])
        if not self.out.turns:
            done = {"audit": "".join(self.audits), "repaired_sha256": self.digest.hexdigest()}
            self.out.add({"conv_id": self.conv_id, **self.figures, **done}, len(self.audits) + 200)


class _Rows:
    """Rows to hand to Spark, as batches of bounded size."""

    def __init__(self, schema, turns):
        self.schema, self.turns = schema, turns
        self.rows, self.bytes = [], 0

    def add(self, row, size):
        self.rows.append(row)
        self.bytes += size

    def batches(self, all_of_them=False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_of_them or len(self.rows) >= ROWS_OUT or self.bytes >= BYTES_OUT):
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.bytes = [], 0


_PIECE_FIELDS = [
    pa.field("task", pa.int32()), pa.field("piece", pa.int64()),
    pa.field("summary", pa.binary()), pa.field("body", pa.binary()),
]
_PIECE_SCHEMA = "task int, piece long, summary binary, body binary"


def _out_schema(id_type, turns, more=()):
    text, whole = pa.string(), pa.int64()
    if turns:
        named = [("place", whole), ("edit", text), ("role", text), ("text", text)]
    else:
        named = [*[(c, whole) for c in FIGURES], ("audit", text), ("repaired_sha256", text)]
    return pa.schema([("conv_id", id_type), *named, *more])


def _parse(batches, turns):
    """Sorted turns to repaired conversations, and pieces of those that may go on in other tasks."""
    task, number, out = TaskContext.get().partitionId(), 0, None
    current, pieces, piece, whole = None, [], Piece(), False

    def entries(first):
        # Only a conversation that begins in this task is known to begin with an empty stack.
        return [0] if first and whole else grammar.ENTRIES

    def send(some, first):
        nonlocal number
        for p in some:
            summary, body = pickle.dumps(p.summary(entries(first))), pickle.dumps(p.turns)
            first = False
            row = {"conv_id": current[0], "task": task, "piece": number, "summary": summary, "body": body}
            out.add(row, len(summary) + len(body))
            number += 1

    def finish(pieces):
        known = [p.summary(entries(n == 0)) for n, p in enumerate(pieces)]
        conversation = _Conversation(known, current[0], out)
        for p in pieces:
            conversation.edit(p.turns)
        conversation.finish()

    sent = False  # whether pieces of the current conversation have been sent
    for batch in batches:
        if out is None:
            out = _Rows(_out_schema(batch.schema.field(0).type, turns, _PIECE_FIELDS), turns)
        for conv_id, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns]):
            if current is None or conv_id != current[0]:
                if current is not None:
                    pieces.append(piece)
                    if whole and not sent:
                        finish(pieces)
                    else:
                        send(pieces, not sent)
                    pieces, piece = [], Piece()
                whole, sent, current = current is not None, False, (conv_id,)
            if piece.is_full():
                pieces.append(piece)
                piece = Piece()
                if len(pieces) >= WHOLE_PIECES:
                    send(pieces, not sent)
                    pieces, sent = [], True
            piece.add(turn, role, text, fault)
            yield from out.batches()
    if current is not None:
        send([*pieces, piece], not sent)
        yield from out.batches(all_of_them=True)


def _join_pieces(batches, turns):
    """The pieces of whole conversations, sorted: first all summaries of a conversation, then its turns,
    which go through one piece at a time."""
    current, summaries, conversation, out = None, [], None, None
    for batch in batches:
        if out is None:
            out = _Rows(_out_schema(batch.schema.field(0).type, turns), turns)
        for conv_id, is_body, data in zip(*[batch.column(n).to_pylist() for n in (0, 1, 4)]):
            if current is None or conv_id != current[0]:
                if conversation:
                    conversation.finish()
                current, summaries, conversation = (conv_id,), [], None
            if not is_body:
                summaries.append(pickle.loads(data))
            else:
                conversation = conversation or _Conversation(summaries, conv_id, out)
                conversation.edit(pickle.loads(data))
            yield from out.batches()
    if conversation:
        conversation.finish()
        yield from out.batches(all_of_them=True)


def _with_faults(rows, scratch):
    """Add `fault`: the first of blank, duplicate and truncated that holds, as `role_grammar` numbers
    them. A text is a duplicate if its role said it in an earlier turn, or before in the same one."""
    rows = rows.withColumns({"_digest": F.unhex(F.md5("text")), "_salt": F.monotonically_increasing_id()})
    rows = scratch.store(rows, "turns")
    said = F.struct("conv_id", "role", "_digest")
    repeated = (
        rows.groupBy("conv_id", "role", "_digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("turn", "_salt")).alias("_first"))
        .filter("_n > 1")
    )
    repeated = repeated.select(said.alias("_lookup_key"), F.col("_first._salt").alias("_first"))
    repeated = repeated.withColumn("_lookup_hash", F.xxhash64("_lookup_key"))
    rows = join_values(rows, said, scratch.store(repeated, "repeated"))
    left = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(left == "", grammar.BLANK)
        .when(F.col("_first") != F.col("_salt"), grammar.DUPLICATE)
        .when(~F.right(left, F.lit(1)).isin(".", "!", "?"), grammar.TRUNCATED)
        .otherwise(grammar.NO_FAULT)
    )
    return rows.withColumn("fault", fault)


def _repaired(turns, conv_col, turn_col, role_col, text_col, as_turns):
    spark = turns.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "conversations")
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "_digest", "_salt"]
    rows = _with_faults(rows, scratch).repartitionByRange(*order).sortWithinPartitions(*order)
    result = TURNS if as_turns else REPAIRED
    parsed = rows.select("conv_id", "turn", "role", "text", "fault").mapInArrow(
        partial(_parse, turns=as_turns), f"conv_id {kind}, {result}, {_PIECE_SCHEMA}"
    )
    parsed = scratch.store(parsed, "parsed")
    names = [c.split()[0] for c in result.split(", ")]
    done = parsed.filter("task is null").select("conv_id", *names)
    pieces = parsed.filter("task is not null")
    # Whole conversations meet here, each in one task: the digest of a text takes its bytes in order.
    halves = [
        pieces.select("conv_id", F.lit(body).alias("is_body"), "task", "piece", F.col(c).alias("data"))
        for body, c in ((False, "summary"), (True, "body"))
    ]
    order = ["conv_id", "is_body", "task", "piece"]
    joined = halves[0].unionByName(halves[1]).repartition("conv_id").sortWithinPartitions(*order)
    return done.unionByName(
        joined.mapInArrow(partial(_join_pieces, turns=as_turns), f"conv_id {kind}, {result}")
    )


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    A conversation's turns are taken by number, null first, turns of one number by role and the MD5 of
    their text. The first three counts are of turns with that fault, each counted under the first that
    it has; `gaps` is of numbers missing between the least and the largest, `illegal` of neighbours
    whose roles do not follow each other. `audit` has the initials of the cheapest edits (keep, rerole,
    delete, insert), ties the least in ASCII, that leave a system turn or none and pairs of user and
    assistant, or nothing; `repaired_sha256` is of the repaired turns `role:text`, joined by newlines.

    A null role or text is one space, so the role is none of the three and the text blank. Null ids are
    one conversation, null numbers leave no gaps. Repeated rows are duplicates, texts are taken whole,
    an empty table gives an empty one. Other columns play no part.

    Audit and digest of one conversation are one value each and made in one task, which reads a piece
    of it (`PIECE_TURNS`) at a time and holds its tables, some dozen bytes a turn.
    """
    return _repaired(turns, conv_col, turn_col, role_col, text_col, False)


def repaired_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (its initial), role, text.
    Everything as in `repair`; a conversation that is left with no turn has no rows."""
    return _repaired(turns, conv_col, turn_col, role_col, text_col, True)


def damaged(turns: DataFrame) -> DataFrame:
    """Faults for a test of the repair, by the CRC-32 of `conv_id:turn` (nulls: one space) modulo 20: 0
    drops the turn, 1 empties its text, 2 removes the marks that end sentences, 3 repeats it, 4 gives it
    to the user. Returns conv_id, turn, role, text, the last two with a space for null."""
    space = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate"))
    rows = rows.filter("fate != 0").withColumns(
        {
            "text": F.when(F.col("fate") == 1, "")
            .when(F.col("fate") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")),
            "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role")),
            "copy": F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
        }
    )
    return rows.select("conv_id", "turn", "role", "text")


def with_all_conversations(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """Add conversations of `ids` (column conv_id) that have no turn left: zeros, an empty audit and the
    digest of nothing."""
    every = ids.select(F.col("conv_id").alias("asked")).distinct()
    joined = every.join(repaired, F.col("asked").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("asked").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in FIGURES],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
