r"""Chat formatting with a grammar round trip.

A conversation is its turns, one after the other:

    turn    = header body "\n</turn>\n"
    header  = "### " ( "System" | "User" | "Assistant" | "%" coded ) ": "
    body    = text in which every header or "</turn>" has a backslash before it

Roles other than the three are written percent-coded. A deterministic parser reads the rendered text back: between turns it wants a
header, within a body it takes one backslash from each run of backslashes before a header or end mark, and it refuses a bare
header there. Each turn is rendered as it is first and parsed; where what comes back differs from the source, its
conflicting content is escaped by one backslash more, and it is parsed again until it is identical.

The format needs no look beyond a turn: the end mark follows a line break of its own, which no text can escape. So turns are
rendered and checked row by row, in any number of tasks. Only reading back brings a conversation's turns together, in order and as
a stream of which one turn is held at a time, so a conversation of any length fits.

Defined cases: a null text is empty; a null role is the empty role, coded as "%"; turns sort by turn (null first), role, text, so
ties and repeated rows have a fixed order and all are kept; rows without a conv_id are one conversation without an id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
END = "</turn>"
_MARK = r"(?:### (?:System|User|Assistant|%[A-Za-z0-9_.~%-]*): |</turn>)"
#: A mark and the backslashes before it.
MARKS = re.compile(r"(\\*)" + f"({_MARK})")
HEADER = re.compile(r"### (System|User|Assistant|%[A-Za-z0-9_.~%-]*): ")
TAIL = "\n" + END + "\n"


class GrammarError(ValueError):
    """Rendered text that the grammar doesn't derive."""


def header(role: str) -> str:
    return f"### {NAMES.get(role) or '%' + quote(role, safe='', errors='surrogatepass')}: "


def escape(text: str) -> str:
    """One backslash more before each mark."""
    return MARKS.sub(r"\1\\\2", text)


def render(role: str, text: str) -> str:
    """A turn that parses back to exactly this role and text."""
    body = text
    for _ in range(2):
        turn = header(role) + body + TAIL
        try:
            if [(r, t) for r, t, _ in parse(turn)] == [(role, text)]:
                return turn
        except GrammarError:
            pass
        body = escape(text)
    raise GrammarError(f"a text of role {role!r} does not come back")


def parse(rendered: str, at: int = 0) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """Role, text and the place of the written text of each turn."""
    while at < len(rendered):
        head = HEADER.match(rendered, at)
        if not head:
            raise GrammarError(f"no header at {at}")
        name, start = head[1], head.end()
        role = ROLES.get(name) if name in ROLES else unquote_to_bytes(name[1:]).decode("utf-8", "surrogatepass")
        out, last = [], start
        for mark in MARKS.finditer(rendered, start):
            if mark[1]:
                out.append(rendered[last : mark.end(1) - 1])
                last = mark.end(1)
            elif mark[2] != END:
                raise GrammarError(f"a header within a turn at {mark.start()}")
            else:
                break
        else:
            raise GrammarError(f"a turn without an end at {at}")
        stop = mark.start() - 1
        if stop < start or rendered[stop] != "\n" or rendered[mark.end() : mark.end() + 1] != "\n" or last > stop:
            raise GrammarError(f"an end mark out of place at {mark.start()}")
        out.append(rendered[last:stop])
        yield role, "".join(out), (start, stop)
        at = mark.end() + 1


def formatted(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """conv_id, turn, role, text (the sort key of a turn), rendered, and loss_start and loss_end: the code points of rendered under
    the loss mask, null where there are none. A conversation's formatted text is its rendered turns joined by nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            whole = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            spans = [(len(header(r)), len(w) - len(TAIL)) if r == loss_role else (None, None) for r, w in zip(roles, whole, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(whole, pa.string()), pa.array([x for x, _ in spans], pa.int64()), pa.array([x for _, x in spans], pa.int64())],
                ["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end"],
            )

    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(work, "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long")


class _Reader:
    """The digests of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.n, self.chars, self.loss = 0, 0, 0
        self.turns, self.under = hashlib.sha256(), hashlib.sha256()

    def take(self, rendered: str, span: tuple[int | None, int | None]) -> None:
        self.chars += len(rendered)
        for role, text, place in parse(rendered):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if span[0] is not None:
                if place != span:
                    raise GrammarError(f"the loss mask covers {span}, the text lies at {place}")
                self.loss += len(text)
                self.under.update(text.encode("utf-8", "surrogatepass"))


def read_back(rows: DataFrame) -> DataFrame:
    """One row for each conversation from the output of ``formatted``: what the parser recovers from it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None

        def result(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        row = lambda: (now, reader.n, reader.turns.hexdigest(), reader.loss, reader.under.hexdigest(), reader.chars)
        for batch in batches:
            done = []
            for conv, rendered, start, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(row())
                    now, reader = conv, _Reader()
                reader.take(rendered, (start, end))
            if done:
                yield result(done)
        if reader is not None:
            yield result([row()])

    order = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "rendered", "loss_start", "loss_end"
    )
    return order.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The fixed conversation of the query: a text that holds marks, one of them behind a backslash.
PROBE = "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 END + length(text) + 9
             + len(regexp_extract_all(text, '### (?:System|User|Assistant|%[A-Za-z0-9_.~%-]*): |</turn>')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
