"""Chat formatting with an unknown template, by rendering turn prefixes.

The template is a black box ``render(turns) -> str``.  For each conversation
the operator renders the first 1, 2, 3 ... turns and compares consecutive
outputs: if the longer one starts with the shorter one, what it adds is the
new turn; the place of the text inside it is found by rendering the same
prefix with that text empty and comparing again.  If an output does not start
with the one before, the template rewrites history: the turn is marked, and
the places of all turns are found anew in the last output, each by rendering
the whole with that one text empty.

Every prefix is rendered whole, whatever its length: a template may look back
or rewrite as far as it likes.  The work grows with the square of a
conversation's length.  For a template that is known to be local, one that
neither looks back nor rewrites further than ``overlap`` turns, ``window`` can
be set: conversations are then rendered in blocks of that many turns behind
the ``overlap`` turns before, with the same pieces and with memory and work
bounded by the block.  The query does not set it: it renders every prefix.
Turns arrive sorted within partitions and are handled as a stream.

Edge cases: null role or text is empty; turns that tie are ordered by role
and text, null turns come first; repeated rows are turns of their own; the
rows of a null conv_id form one conversation; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import only, ship, table

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]
TURNS = ("conv_id long, seq long, role string, piece string, text_from long, text_to long, "
         "loss boolean, rewrites boolean")
_CODE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {**{v: k for k, v in _CODE.items()}, "\\n": "\n"}
_ESCAPE, _UNESCAPE = re.compile(r"[\\<\[]"), re.compile(r"\\[\\lbn]")
_PIECE = re.compile(r"<s>([^<\[]*?)\n([^<\[]*)</s>\n")


def escape(text: str) -> str:
    """No control string (they all hold ``<`` or ``[``) survives in a text."""
    return _ESCAPE.sub(lambda m: _CODE[m[0]], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[0]], text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: ``<s>role``, a line break, the text, ``</s>``, a
    line break for each turn; control strings inside are escaped."""
    return "".join(f"<s>{escape_role(role)}\n{escape(text)}</s>\n" for role, text in turns)


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by doubling and halving slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _span(full: str, emptied: str) -> tuple[int, int]:
    start = _common(full, emptied)
    return start, start + len(full) - len(emptied)


def locate(turns: list[Turn], render: Render, context: list[Turn] = ()) -> list[tuple[str, int, int, bool]]:
    """(piece, text start, text end, rewrites) of each turn; the pieces joined
    are the output behind ``context`` and starts and ends count in them."""
    context = list(context)
    before = base = render(context) if context else ""
    out, rewritten = [], False
    for k, (role, _) in enumerate(turns):
        now = render(context + turns[:k + 1])
        start, end = _span(now, render(context + turns[:k] + [(role, "")]))
        new = not now.startswith(before)
        rewritten |= new
        out.append((now[len(before):], start - len(base), end - len(base), new))
        before = now
    if rewritten and turns:
        whole, spans = before, []
        edges = [_common(base, before)]
        for k, (role, _) in enumerate(turns):
            emptied = render(context + turns[:k] + [(role, "")] + turns[k + 1:])
            # A text that the last output no longer holds has no place in it.
            start, end = (edges[-1], edges[-1]) if emptied == whole else _span(whole, emptied)
            spans.append((start, end))
            edges.append(max(edges[-1], end))
        edges[-1] = len(whole)
        out = [(whole[a:b], s - len(base), e - len(base), old[3])
               for a, b, (s, e), old in zip(edges, edges[1:], spans, out)]
    return out


def _conversations(batches: Iterator[pd.DataFrame], window: int | None) -> Iterator[tuple]:
    """(conv_id, first block?, turns) in the order of the rows."""
    current, turns, first = object(), [], True
    for b in batches:
        ids = [None if pd.isna(x) else int(x) for x in b["conv_id"]]
        for conv, role, text in zip(ids, b["role"], b["text"]):
            if conv != current:
                if turns:
                    yield current, first, turns
                current, turns, first = conv, [], True
            elif len(turns) == window:
                yield current, first, turns
                turns, first = [], False
            turns.append((role or "", text or ""))
    if turns:
        yield current, first, turns


def format_turns(conversations: DataFrame, render: Render = marked_turns, loss_role: str = "assistant",
                 window: int | None = None, overlap: int = 2) -> DataFrame:
    """One row per turn in conversation order within its partition: its piece
    of the formatted conversation, the place of the text in the conversation's
    output, whether it counts for the loss, whether history was rewritten.
    ``window`` is for local templates only (see above)."""
    ship(conversations.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, seq, at, tail = [], 0, 0, 0, []
        for conv, first, turns in _conversations(batches, window):
            if first:
                seq, at, tail = 0, 0, []
            found = locate(turns, render, tail)
            for (role, _), (piece, start, end, new) in zip(turns, found):
                rows.append((conv, seq, role, piece, at + start, at + end, role == loss_role, new))
                seq, size = seq + 1, size + len(piece)
            at += sum(len(p) for p, *_ in found)
            tail = (tail + turns)[-overlap:]
            if size > 4_000_000:
                yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    names = [c.split()[0] for c in TURNS.split(", ")]
    c = only(conversations, "conv_id", "turn", "role", "text")
    # One conversation is one sequence: its turns meet in a task, as a stream.
    return (c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInPandas(run, TURNS))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the pieces that ``format_turns`` made
    with the default template; a stream over its partitions."""
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None

        def row():
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

        for b in batches:
            done = []
            for conv, piece, start, end, loss, new in zip(
                    b["conv_id"], b["piece"], b["text_from"], b["text_to"], b["loss"], b["rewrites"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != current:
                    if state:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                m = _PIECE.fullmatch(piece)
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    text = unescape(piece[start - state[4]:end - state[4]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[0] += 1
                state[4] += len(piece)
                state[5] |= bool(new)
            yield pd.DataFrame(done, columns=cols).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([row()], columns=cols).astype({"conv_id": "Int64"})

    return turns.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long, rewrites_history boolean")


def op5_prefix_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)],
                                 "conv_id long, turn long, role string, text string")
    return digests(format_turns(c.unionByName(more)))
