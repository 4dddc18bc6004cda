"""Chat formatting with a grammar that can be read back.

A conversation is its turns one after another. A turn is an opening mark, a space, the text, a
space and a closing mark; the marks tell the role. A turn of any other role carries that role's
name in a field of its own:

    <<SYS>> text <</SYS>>      [INST] text [/INST]      <s> text </s>
    <|role|> name <|text|> text <|end|>

Inside a field a control string with n backslashes before it stands for one with n - 1, so a text
may hold any control string. Marks have no backslash before them and a space on either side, which
keeps a field's own characters from merging with them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Opening and closing mark of the named roles.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROL = [*(m for pair in MARKS.values() for m in pair), ROLE, TEXT, END]
TOKEN = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROL)) + ")")
OPENS = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}


def escape(text: str) -> str:
    return TOKEN.sub(r"\\\1\2", text)


def unescape(field: str) -> str:
    return TOKEN.sub(lambda m: m[0][1:] if m[1] else m[0], field)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text as role, text, start and end of its field. Raises ValueError off the grammar."""
    marks = [m for m in TOKEN.finditer(text) if not m[1]]
    turns, at, k = [], 0, 0

    def field(closing: str) -> tuple[int, int]:
        nonlocal at, k
        start = at + 1
        if k >= len(marks) or marks[k][2] != closing or text[at : at + 1] != " " or text[marks[k].start() - 1] != " " or marks[k].start() <= start:
            raise ValueError(f"no {closing} for the field at {at}")
        end, at = marks[k].start() - 1, marks[k].end()
        k += 1
        return start, end

    while at < len(text):
        if k >= len(marks) or marks[k].start() != at:
            raise ValueError(f"no opening mark at {at}")
        opening, at = marks[k][2], marks[k].end()
        k += 1
        if opening == ROLE:
            a, b = field(TEXT)
            role, closing = unescape(text[a:b]), END
        elif opening in OPENS:
            role, closing = OPENS[opening]
        else:
            raise ValueError(f"{opening} opens no turn")
        a, b = field(closing)
        turns.append((role, unescape(text[a:b]), a, b))
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn's formatted text: parsed again, it must give the turn back; what conflicts is escaped until it does."""

    def put(r: str, t: str) -> str:
        if r == role and role in MARKS:
            opening, closing = MARKS[role]
            return f"{opening} {t} {closing}"
        return f"{ROLE} {r} {TEXT} {t} {END}"

    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        piece = put(r, t)
        try:
            if [x[:2] for x in parse(piece)] == [(role, text)]:
                return piece
        except ValueError:
            continue
    raise AssertionError("an escaped turn reads back as written")


def format_chats(chats: DataFrame) -> DataFrame:
    """One row per turn, in order: conv_id, seq, role, piece, loss_start, loss_end.

    A conversation's formatted text is its pieces joined by seq; the loss mask is the span of code
    points, from the start of the piece, of an assistant's text, and null for other roles. Turns go by
    turn, then role, then text, nulls first; rows that agree in all are kept as turns of their own.
    A null role or text is an empty one; a null conv_id is a conversation of its own. Conversations and texts
    of any length stream through sorted partitions; none is gathered. An empty table gives an empty result; other columns of
    chats, whatever their names, are left out.
    """
    key = chats.schema["conv_id"].dataType.simpleString()
    rows = chats.select("conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, begun = None, 0, False
        for batch in batches:
            out = {k: [] for k in ("seq", "role", "piece", "loss_start", "loss_end")}
            for conv, role, text in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                seq = seq + 1 if begun and conv == last else 0
                last, begun = conv, True
                role, text = role or "", text or ""
                piece = render_turn(role, text)
                _, _, a, b = parse(piece)[0]
                loss = (a, b) if role == "assistant" else (None, None)
                for k, v in zip(out, (seq, role, piece, *loss), strict=True):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("conv_id")), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["conv_id", *out])

    return rows.mapInArrow(render, f"conv_id {key}, seq long, role string, piece string, loss_start long, loss_end long")


def assemble(pieces: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end in code points)."""
    turns = F.sort_array(F.collect_list(F.struct("seq", "piece", "loss_start", "loss_end")))
    step = (
        "aggregate(turns, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:long,end:long>>)), (s, t) -> named_struct("
        "'at', s.at + length(t.piece), 'spans', if(t.loss_start is null, s.spans, concat(s.spans, array(named_struct('start', s.at + t.loss_start, 'end', s.at + t.loss_end))))), s -> s.spans)"
    )
    grouped = pieces.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select("conv_id", F.expr("array_join(transform(turns, t -> t.piece), '')").alias("formatted"), F.expr(step).alias("loss_spans"))


def read_back(pieces: DataFrame, arranged: bool = False) -> DataFrame:
    """Per conversation, what a reader of the formatted text finds: counts and digests of turns and loss text.

    arranged: pieces come straight from format_chats, which leaves each conversation in one partition, in order.
    A conversation whose turns are all empty has digests of what its turns are; a null conv_id is one of its own; rows that repeat are
    turns of their own; no pieces give no rows; columns other than those of format_chats are left out.
    """
    key = pieces.schema["conv_id"].dataType.simpleString()
    if not arranged:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, kind = None, None

        def row() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done = []
            for conv, piece, start, end in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    lost = unescape(piece[start:end])
                    state[3] += len(lost)
                    state[4].update(lost.encode())
                state[5] += len(piece)
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([row()])

    return pieces.mapInArrow(read, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same in SQL, for tables whose roles are system, user and assistant.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(text) + 2 + (CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 ELSE 7 END)
    + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role\|>|<\|text\|>|<\|end\|>')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
