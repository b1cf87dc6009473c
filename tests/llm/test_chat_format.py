import hashlib
from collections import defaultdict

import pytest
public_tokenizers = pytest.importorskip("public_tokenizers")
import numpy as np  # noqa: E402
from hypothesis import given, settings, strategies as st  # noqa: E402

from riskwave.llm import chat_format as m  # noqa: E402
from riskwave.llm.queries import CONTROL_TEXT, QUERIES  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOK = m.ChatTokens(*BPE)
PIECES = st.one_of(st.sampled_from([*m.CONTROLS, "\\", "\\\\", "\n", " ", "<|endoftext|>", "###", "</turn"]),
                   st.text(max_size=4))


def want(rows):
    """rows: (conv, turn, role, text) -> digests by conversation."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: tuple((x is not None, x or "" if i else x or 0) for i, x in enumerate(r[1:])))
        joined = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from([*m.ROLES, "tool", ""]), PIECES),
                          st.lists(PIECES, max_size=8).map("".join)), min_size=1, max_size=4))
def test_round_trip(turns):
    ids, mask = m.assemble([TOK.open_ids(r) for r, _ in turns], [TOK.text_ids(t) for _, t in turns],
                           [r == "assistant" for r, _ in turns], TOK.end)
    assert TOK.turns(ids, mask) == [(r, t, t if r == "assistant" else "") for r, t in turns]
    assert all(m.unescape(m.escape(t)) == t for _, t in turns)
    # rendered text holds a bare control string only where a mark was spliced
    text = TOK.render(ids)
    bare = sum(1 for x in m._CONTROL.finditer(text) if not x.group().startswith("\\"))
    assert bare == 2 * len(turns)
    assert not (mask & (ids >= TOK.first)).any()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    assert CONTROL_TEXT == r"\### Assistant: </turn> ok"
    out = QUERIES["op8_chat_format"](spark, sf)
    assert got(out) == want(rows)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, input_ids string"
    empty = spark.createDataFrame([], schema)
    assert m.read_back(m.format_conversations(empty, *BPE), *BPE).count() == 0
    rows = [(1, 2, "assistant", None), (1, 1, "user", ""), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "bot", "b"),
            (1, None, None, "no turn"), (None, 1, "user", "no id"), (None, 2, "assistant", "x " * 50_000),
            (2, 1, "Assistant", "</turn>"), (3, 1, "### User:", "\\</turn>"), (4, 1, "assistant", "\n\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    assert got(m.read_back(m.format_conversations(df, *BPE), *BPE)) == want(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" " * 7, "\n" * 5, "　" * 6, " \n\t" * 3, " ", "\x1c", "a", "漢", "'s", ".", "</turn>"]), max_size=12))
def test_long_runs_cut_out_give_the_library_ids(parts):
    import re
    text, kept = "".join(parts), m._RUN
    m._RUN = re.compile(kept.pattern.replace(str(m.LONG_RUN), "4"))
    try:
        ids = TOK.text_ids(text).tolist()
    finally:
        m._RUN = kept
    assert ids == TOK.bpe.encode_ordinary(m.escape(text))


def test_runs_of_two_million():
    for text in (" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "　" * 1_000_000 + "x" * 1_000_000, "\\" * 2_000_000,
                 " \t" * 1_000_000 + "\\</turn>"):
        assert m.unescape(TOK.text(TOK.text_ids(text))) == text
