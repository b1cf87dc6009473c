import pytest
public_tokenizers = pytest.importorskip("public_tokenizers")
from hypothesis import given, settings, strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from riskwave.llm.pretokens import Pretokens  # noqa: E402
from riskwave.llm.queries import QUERIES  # noqa: E402
from riskwave.llm.token_counts import count_tokens  # noqa: E402

from edge_rows import EDGE_TEXTS, edge_docs, empty_docs  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
PRE = Pretokens(PATH)


def library_count(text):
    return len(TOK.encode(text, add_special_tokens=False).ids) if text else 0


ALPHABET = "aZ9 é\n'ſİ\x1c\x1f\x85\xa0sStÀÿŸ²½<|>ΣσςÜ̈漢١​ ́\U0001f600-_.,!ẞ"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=12), st.text(max_size=6),
                          st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "it's we'll", "'RE"])), max_size=6))
def test_ids_equal_the_library(parts):
    import numpy as np
    text = "".join(parts)
    got = np.frombuffer(PRE.encode(text), PRE.dtype).tolist()
    assert got == TOK.encode(text, add_special_tokens=False).ids
    assert [i for p in PRE.pretokens(text) for i in PRE.ids_of(p)] == got
    assert not any(c in p for p in PRE.pretokens(text) for c in " \t\n")


def test_query_equals_library_on_every_document(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op9_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = library_count(d.text)
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == \
            (len(d.text.encode()), n, n > 2048)


@pytest.mark.parametrize("head", [0, 3, 150_000])
def test_edges(spark, head):
    if head == 0:
        assert count_tokens(empty_docs(spark), PATH).count() == 0
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in count_tokens(edge_docs(spark), PATH, head=head).collect())
    want = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(5, EDGE_TEXTS[5])] * 2 + \
        [(-1, "a row without an id"), (-1, None)]
    assert got == sorted((i, len((t or "").encode()), library_count(t), library_count(t) > 2048) for i, t in want)
