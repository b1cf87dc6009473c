"""Chat formatting by token-level assembly.

Every turn's segments are encoded separately and spliced with reserved ids
that no text can produce; the loss mask marks the text tokens of assistant
turns and is made from prefix sums of segment lengths.  The same sequence
can be rendered as text, where a turn reads

    ### Assistant:
    <text>
    </turn>

so control strings that occur inside a text get one more backslash before
they are encoded; reading back takes it away again.

A turn is ``[role id] text ids [end id]``; a role other than system, user
and assistant is ``[other id] role ids [head id] text ids [end id]``.

Turns of a conversation are ordered by turn, then role, then text (nulls
first); repeated rows stay repeated.  Null texts and roles are empty texts.
A null conv_id is a conversation of its own.  Turns are encoded where they
lie and then streamed per conversation in order; a conversation's output is
one row.  A very long text is encoded whole, runs of white space by
themselves.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskwave.llm.common import emit

# Fixed values of the template.
ROLES = ("system", "user", "assistant")
CONTROLS = ("### System:", "### User:", "### Assistant:", "### Role ", "</turn>")
_CONTROL = re.compile(r"(?<!\\)\\*+(?:" + "|".join(map(re.escape, CONTROLS)) + ")")
LONG_RUN = 50_000           # white space in a row that goes past the library's expression
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
OUT = "conv_id long, input_ids array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group()[1:], text)


class ChatTokens:
    """Byte-level BPE with reserved ids after the vocabulary."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.role = {r: first + i for i, r in enumerate(ROLES)}
        self.other, self.head, self.end = first + len(ROLES), first + len(ROLES) + 1, first + len(ROLES) + 2
        self.first = first

    def text_ids(self, text: str) -> np.ndarray:
        """Ids of an escaped text.  The library's expression keeps a frame per
        blank of a run, so a long run is cut out: all of it at the text's end,
        else all but its last blank, is one pre-token."""
        text, ids, at = escape(text), [], 0
        for run in _RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.bpe.encode_ordinary(text[at:run.start()])
            ids += self.bpe._core_bpe.encode_single_piece(text[run.start():end].encode())
            at = end
        return np.array(ids + self.bpe.encode_ordinary(text[at:]), np.int32)

    def open_ids(self, role: str) -> np.ndarray:
        if role in self.role:
            return np.array([self.role[role]], np.int32)
        return np.concatenate(([self.other], self.text_ids(role), [self.head])).astype(np.int32)

    def text(self, ids: np.ndarray) -> str:
        return self.bpe.decode_bytes(ids.tolist()).decode()

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str]]:
        """(role, text, text under the mask) of every turn, read from ids."""
        out, names = [], {i: r for r, i in self.role.items()}
        stops = np.flatnonzero(ids >= self.first)
        k = 0
        while k < len(stops):
            at = stops[k]
            if ids[at] == self.other:
                role, at = unescape(self.text(ids[at + 1:stops[k + 1]])), stops[k + 1]
                k += 1
            else:
                role = names[int(ids[at])]
            body, seen = ids[at + 1:stops[k + 1]], mask[at + 1:stops[k + 1]]
            out.append((role, unescape(self.text(body)), unescape(self.text(body[seen]))))
            k += 2
        return out

    def render(self, ids: np.ndarray) -> str:
        """The sequence as text, escapes included."""
        names = {i: f"### {r.capitalize()}:\n" for r, i in self.role.items()}
        names |= {self.other: "### Role ", self.head: ":\n", self.end: "\n</turn>\n"}
        parts, at = [], 0
        for stop in np.flatnonzero(ids >= self.first):
            parts += [self.text(ids[at:stop]), names[int(ids[stop])]]
            at = stop + 1
        return "".join(parts)


_LOADED: dict[str, ChatTokens] = {}


def chat_tokens(path: str, pattern: str) -> ChatTokens:
    if path not in _LOADED:
        _LOADED[path] = ChatTokens(path, pattern)
    return _LOADED[path]


def _encode(path: str, pattern: str):
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        ("open", pa.binary()), ("body", pa.binary())])

    def run(batches):
        tok = chat_tokens(path, pattern)
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            yield emit(schema, {
                "conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": batch.column("role"),
                "text": batch.column("text"), "open": [tok.open_ids(r).tobytes() for r in roles],
                "body": [tok.text_ids(t or "").tobytes() for t in batch.column("text").to_pylist()]})
    return run


def assemble(opens: list[np.ndarray], bodies: list[np.ndarray], learn: list[bool], end: int):
    """Splice the segments; the mask is +1 at the start and -1 at the end of
    every learnt text, summed up."""
    lengths = np.array([x for o, b in zip(opens, bodies) for x in (len(o), len(b), 1)])
    ends = np.cumsum(lengths)
    ids = np.concatenate([x for o, b in zip(opens, bodies) for x in (o, b, [end])]).astype(np.int32)
    edge = np.zeros(len(ids) + 1, np.int32)
    on = np.flatnonzero(learn)
    np.add.at(edge, ends[3 * on], 1)            # after the opening
    np.add.at(edge, ends[3 * on + 1], -1)       # after the text
    return ids, np.cumsum(edge[:-1]) > 0


def _assemble(path: str, pattern: str):
    schema = pa.schema([("conv_id", pa.int64()), ("input_ids", pa.list_(pa.int32())),
                        ("loss_mask", pa.list_(pa.bool_()))])
    nothing = object()

    def run(batches):
        end = chat_tokens(path, pattern).end
        conv, opens, bodies, learn = nothing, [], [], []

        def flush():
            ids, mask = assemble(opens, bodies, learn, end)
            return emit(schema, {"conv_id": [conv], "input_ids": [ids], "loss_mask": [mask]})
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "role", "open", "body")]
            for c, role, o, b in zip(*cols):
                if c != conv:
                    if conv is not nothing:
                        yield flush()
                    conv, opens, bodies, learn = c, [], [], []
                opens.append(np.frombuffer(o, np.int32))
                bodies.append(np.frombuffer(b, np.int32))
                learn.append(role == "assistant")
        if conv is not nothing:
            yield flush()
    return run


def format_conversations(rows: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, input_ids, loss_mask."""
    plain = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    turns = plain.mapInArrow(_encode(path, pattern),
                             "conv_id long, turn long, role string, text string, open binary, body binary")
    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "open", "body").mapInArrow(_assemble(path, pattern), OUT))


def _read_back(path: str, pattern: str):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        tok = chat_tokens(path, pattern)
        for batch in batches:
            rows = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("input_ids"),
                                       batch.column("loss_mask")):
                ids = ids.values.to_numpy()
                turns = tok.turns(ids, mask.values.to_numpy(zero_copy_only=False))
                all_turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, text, learnt in turns:
                    all_turns.update(f"{role}\n{text}\n".encode())
                    loss.update(learnt.encode())
                    chars += len(learnt)
                rows.append((conv, len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(tok.render(ids))))
            if rows:
                yield emit(schema, dict(zip(schema.names, zip(*rows))))
    return run


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the turns and of the text under the mask, decoded from the
    token sequences."""
    return formatted.mapInArrow(
        _read_back(path, pattern), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")
