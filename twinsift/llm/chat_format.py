"""Chat formatting: a finite-state machine over roles writes a conversation by a declarative template.

The template names the machine's states and the turns allowed from each, and for every role the text before
and after a turn and whether the turn's own text counts in the loss. Conversations are streamed: rows are
partitioned by conversation and sorted by turn, and only the machine's state is held between rows, so a
conversation of any length is written in bounded memory. Each turn becomes segments (mark, text, mark), each
with its loss flag. Control strings inside texts are escaped, so the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import rows_of


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is written as `head` with the role's name in place of {role}, the escaped text, and `tail`.

    `next` gives the roles allowed after each role ("" is the start), `final` the roles that may end.
    """

    head: str = "### {role}: "
    tail: str = " </turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    next: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant", "user")
    loss: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def __post_init__(self) -> None:
        if len(set(self.names.values())) < len(self.names) or any(not re.fullmatch(r"\w+", n) for n in self.names.values()):
            raise ValueError("role names must differ and be words")
        if any(re.fullmatch(r"x([0-9a-f]{2})*", n) for n in self.names.values()):
            raise ValueError("a role's name reads like the hex of an unknown role")
        if not self.tail.strip() or self.tail == self.tail.strip():
            raise ValueError("the tail must be a mark with white space around it, so that an escaped one differs from it")

    def controls(self) -> list[str]:
        """The strings that are escaped inside texts: the escape itself and the marks around turns."""
        marks = {x.strip() for x in (self.head.partition("{role}")[0], self.tail) if x.strip()}
        return [self.escape, *sorted(marks, key=len, reverse=True)]

    def role_name(self, role: str) -> str:
        """The written name; a role that the template does not know is written in hex, so that it reads back."""
        return self.names.get(role) or "x" + role.encode("utf-8", "surrogatepass").hex()

    def role_of(self, name: str) -> str:
        for role, n in self.names.items():
            if n == name:
                return role
        return bytes.fromhex(name[1:]).decode("utf-8", "surrogatepass")


class Machine:
    """Validates turn order and writes segments."""

    def __init__(self, template: ChatTemplate) -> None:
        self.template = template
        self.controls = re.compile("|".join(map(re.escape, template.controls())))
        self.reset()

    def reset(self) -> None:
        self.state, self.fault = "", ""

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments (text, loss flag) of the next turn. A turn out of order is written too and leaves a fault."""
        t = self.template
        if role not in t.next.get(self.state, ()):
            self.fault = self.fault or f"{role or 'no role'} after {self.state or 'the start'}"
        self.state = role
        body = self.controls.sub(lambda m: t.escape + m[0], text)
        return [(t.head.replace("{role}", t.role_name(role)), False), (body, role in t.loss), (t.tail, False)]

    def end(self) -> str:
        """The first fault of the conversation, empty if there is none."""
        return self.fault or ("" if self.state in self.template.final else f"ends with {self.state or 'no turn'}")


class Reader:
    """Reads turns back from the formatted text of whole turns."""

    def __init__(self, template: ChatTemplate) -> None:
        first, _, rest = template.head.partition("{role}")
        self.template, self.tail = template, template.tail
        self.head = re.compile(re.escape(first) + r"(\w+)" + re.escape(rest))
        e, controls = re.escape(template.escape), [re.escape(c) for c in template.controls()]
        # what an escape protects is skipped whole; a tail that no escape stands before ends the turn
        self.stop = re.compile("|".join([*(e + c for c in controls), "(" + re.escape(self.tail) + ")"]))
        self.undo = re.compile(f"{e}({'|'.join(controls)})")

    def turns(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, start, end) of each turn, start and end being the place of its escaped text."""
        at = 0
        while at < len(text):
            head = self.head.match(text, at)
            if not head:
                raise ValueError(f"no turn starts at {at}")
            end = next(m.start() for m in self.stop.finditer(text, head.end()) if m[1] is not None)
            yield self.template.role_of(head[1]), self.undo.sub(lambda m: m[1], text[head.end() : end]), head.end(), end
            at = end + len(self.tail)


def _in_order(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation together and sorted; a task may hold parts of many. Null turns come last, ties by role and text."""
    kept = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


SEGMENTS = "conv_id long, turn long, seq long, role string, part int, segment string, loss boolean, fault string"
TURNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, fault string"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def format_chat(rows: DataFrame, template: ChatTemplate | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of all conversations: conv_id, turn, seq (of the turn in its conversation), role, part (0 to 2), segment, loss, fault.

    Joined by seq and part, a conversation's segments are its formatted text. `fault` is null but on the last
    segment, where it is empty for a valid conversation, else the first fault of its order. A null text counts
    as empty and a null role as one without a name; rows of a null conv_id are one conversation. Rows with
    equal turns go by role and text; null turns come last; repeated rows are repeated turns. Columns other
    than the four named are not read. Conversation and turn are whole numbers: ids of another type that do not
    read as such fail the job in ANSI mode and are one null conversation without it.
    """
    template = template or ChatTemplate()
    schema = _arrow(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, held, seq, current = Machine(template), None, 0, object()
        out: list[tuple] = []

        def close() -> None:
            if held:
                segments = machine.turn(held[2] or "", held[3])
                for part, (s, loss) in enumerate(segments):
                    out.append((held[0], held[1], seq, held[2], part, s, loss, None))

        for some in rows_of(batches):
            for row in some:
                close()
                if held and held[0] != row[0]:
                    out[-1] = (*out[-1][:7], machine.end())
                    machine.reset()
                    seq = 0
                elif held:
                    seq += 1
                held = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        close()
        if out:
            out[-1] = (*out[-1][:7], machine.end())
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _in_order(rows, conv_id, turn, role, text).mapInArrow(run, SEGMENTS)


def digest_chat(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation, from the segments as format_chat leaves them in each partition: read back and digested.

    Turns are found in the formatted text itself, by their marks. A null conv_id is a conversation; of no segments
    nothing comes; an empty text is a turn with an empty text. Only one turn is held at a time.
    """
    template = template or ChatTemplate()
    schema = _arrow(TURNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(template)
        n = chars = loss_chars = 0
        turns, loss, text, mask = hashlib.sha256(), hashlib.sha256(), [], []
        for some in rows_of(batches):
            out = []
            for conv, _, _, _, _, segment, flag, fault in some:
                text.append(segment)
                mask.append(flag)
                chars += len(segment)
                if segment.endswith(template.tail):  # escaped ones have the escape in them: only a turn's end does
                    flat = "".join(text)
                    for role, said, start, _ in reader.turns(flat):
                        n += 1
                        turns.update(f"{role}\n{said}\n".encode())
                        ends, at = [], 0
                        for s, f in zip(text, mask, strict=True):
                            if f and at == start:
                                ends.append(at + len(s))
                            at += len(s)
                        if ends or (not said and any(mask)):
                            loss.update(said.encode())
                            loss_chars += len(said)
                    text, mask = [], []
                if fault is not None:
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, not fault, fault))
                    n = chars = loss_chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return segments.mapInArrow(run, TURNS)


def planted(rows: DataFrame) -> DataFrame:
    """Conversation -7: two turns whose texts hold the template's control strings."""
    said = "\\### Assistant: </turn> ok"
    own = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)


#: The digests of the default template in DuckDB: what is read back is what went in, and lengths follow from the escapes.
SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
         length('### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'x' || lower(hex(encode(role))) END || ': ')
         + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '###', '\###')) + length(' </turn>' || chr(10)) AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), checked AS (
  SELECT *, CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END AS fits
  FROM turns
), ended AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
         coalesce(arg_min(role || ' after ' || coalesce(before, 'the start'), n) FILTER (NOT fits), CASE WHEN arg_max(role, n) IN ('assistant', 'user') THEN '' ELSE 'ends with ' || arg_max(role, n) END) AS fault
  FROM checked GROUP BY conv_id
)
SELECT *, fault = '' AS valid FROM ended
"""
