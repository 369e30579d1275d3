"""Operator 2: chat formatting with a compiled template, generation markers and reversible escapes."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import compile_template

#: Every turn is one element; only assistants' texts are learned from.
TEMPLATE = (
    "{% for message in messages %}"
    "<turn role=\"{{ message.role | escape }}\">\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "\n</turn>\n"
    "{% endfor %}"
)
#: The control characters of the format and what stands for them inside roles and texts.
CODES = {"\\": "\\\\", "<": "\\l", ">": "\\g", '"': "\\q", "#": "\\h"}
BACK = {v: k for k, v in CODES.items()}
TURN = re.compile(r'<turn role="([^"]*)">\n(.*?)\n</turn>\n', re.S)
#: The conversation that the query adds to the table's.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    """No control character is left, so nothing in a text can pass for a turn's mark."""
    return text.translate(str.maketrans(CODES))


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: BACK[m[0]], text)


@functools.cache
def renderer(source: str = TEMPLATE):
    return compile_template(source, {"escape": escape})


def format_turns(messages: Iterator[dict], source: str = TEMPLATE) -> Iterator[tuple[str, bool]]:
    """Pieces of the formatted conversation, each with whether it is under the loss mask."""
    return renderer(source)(messages=messages)


class Reader:
    """Reads a formatted conversation back from its pieces, holding one turn at a time."""

    def __init__(self) -> None:
        self.held, self.n_turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns, self.loss, self.learned = hashlib.sha256(), hashlib.sha256(), ""

    def feed(self, piece: str, learn: bool) -> None:
        self.chars += len(piece)
        self.held += piece
        if learn:
            self.learned += piece
        elif self.learned:
            self._learn()
        if piece.endswith("</turn>\n"):
            at = 0
            while m := TURN.match(self.held, at):
                self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                self.n_turns += 1
                at = m.end()
            self.held = self.held[at:]

    def _learn(self) -> None:
        text = unescape(self.learned)
        self.loss.update(text.encode())
        self.loss_chars += len(text)
        self.learned = ""

    def close(self) -> tuple[int, str, int, str, int]:
        self._learn()
        if self.held:
            raise ValueError("the output is not a sequence of turns")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _ordered(conversations: DataFrame) -> DataFrame:
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # each conversation in one task and in order, but never in memory as a whole
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict]]:
    for b in batches:
        for i, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            yield i, {"role": role, "text": text}


def _runs(rows: Iterator[tuple[int | None, dict]]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Groups of neighbouring rows with one id, each an iterator that must be used up before the next."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def group():
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1]
                row = next(rows, None)

        yield key, group()


def conversation_digests(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """Format every conversation and describe it as read back from the output.

    Turns go by ``turn``, equal ones by role and text; repeated rows are turns of
    their own.  Null roles and texts count as empty, rows with null ``conv_id`` form
    one conversation.  Returns ``conv_id``, ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256``, ``formatted_chars``.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, messages in _runs(_conversations(batches)):
            reader = Reader()
            for piece, learn in format_turns(messages, source):
                reader.feed(piece, learn)
            out.append((key, *reader.close()))
            if len(out) == 1000:
                yield pack(out)
                out = []
        yield pack(out)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _ordered(conversations).mapInArrow(run, schema)


def formatted_turns(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """The formatted output in pieces: ``conv_id``, ``piece`` (from 0), ``text``, ``learn``.

    Joined by ``piece``, the texts of a conversation are its formatted form;
    ``learn`` marks those under the loss mask.  A conversation of any length is
    written without being held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, messages in _runs(_conversations(batches)):
            held = []
            for k, (piece, learn) in enumerate(format_turns(messages, source)):
                held.append((key, k, piece, learn))
                if len(held) == 5000:
                    yield pack(held)
                    held = []
            if held:
                yield pack(held)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["conv_id", "piece", "text", "learn"]
        )

    return _ordered(conversations).mapInArrow(run, "conv_id long, piece long, text string, learn boolean")


def with_extra(conversations: DataFrame) -> DataFrame:
    """The table's rows and conversation -7, whose texts hold the format's own marks."""
    spark = conversations.sparkSession
    extra = spark.createDataFrame(
        [(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    ).unionByName(extra)


#: The read-back columns in SQL; ``formatted_chars`` follows from the template and the escapes.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(text)
           + length(regexp_replace(role || text, '[^\\<>"#]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
