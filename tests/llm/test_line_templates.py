import random
import re

from riskwave.llm import line_templates as m
from riskwave.llm.queries import ORACLES, QUERIES
from riskwave.oracle_check import duck

from edge_rows import edge_docs, empty_docs


def brute(docs):
    """docs: list of (id, text), distinct -> texts after dropping."""
    lines = []
    for d, text in docs:
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            toks = [re.sub(r".*[0-9].*", "<*>", t) for t in re.split(r"[ \t-\r]+", line) if t]
            if toks:
                lines.append((d, p, tuple(toks), (len(toks), tuple(toks[:m.DEPTH]))))
    templates, home, name = {}, {}, {}
    for d, p, toks, leaf in sorted(lines, key=lambda x: x[:2]):
        known = templates.setdefault(leaf, [])
        near = [t for t in known if sum(a == b or b == "<*>" for a, b in zip(toks, t)) >= m.SIMILAR * len(toks)]
        if not near:
            known.append(toks)
        name[d, p] = (leaf, near[0] if near else toks)
        home.setdefault(name[d, p], d)
    return {d: None if text is None else "\n".join(
        x for p, x in enumerate(text.split("\n")) if (d, p) not in name or home[name[d, p]] == d)
        for d, text in docs}


def test_query_against_oracle_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op10_line_templates"](spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert {d: r.text for d, r in rows.items()} == want
    con = duck(sf)
    got = sorted(con.sql(ORACLES["op10_line_templates"]).fetchall())
    assert got == sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows.values())


def test_templates_generalise_variable_fields(spark):
    docs = [(1, "user 17 logged in from host7\nan ordinary sentence of its own"),
            (2, "user 23 logged in from host9\nanother line that is only here"),
            (3, "posted by anna on the forum today at noon by post\nshort line"),
            (4, "posted by anna on the forum today at night by post\nshort line"),
            (5, "posted by anna in a club last week or so by me\n"), (6, None), (7, "")]
    out = {r.doc_id: r.text for r in m.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute(docs)
    assert out[2] == "another line that is only here" and out[4] == "" and out[5] == docs[4][1]


def test_short_lines(spark):
    docs = [(1, "All rights reserved.\nLes.\n17"), (2, "Les.\nAll rights reserved.\nOwn."), (3, "  Les. \n-\n\n4"),
            (4, "漢字漢字漢字\nLes. mots"), (5, "漢字漢字漢字")]
    out = {r.doc_id: r.text for r in m.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute(docs) and out == {1: docs[0][1], 2: "Own.", 3: "-\n", 4: docs[3][1], 5: ""}


def test_a_leaf_with_many_families(spark):
    """Families of one leaf that only a list of templates keeps apart, in
    chunks smaller than the leaf, and a leaf that holds most lines."""
    rng = random.Random(2)
    names = [f"{a}{b}" for a in "bcdfgklmnp" for b in ("ana", "oto", "iri", "u")]
    family = [[rng.choice(names) for _ in range(7)] for _ in range(30)]
    docs = []
    for d in range(200):
        lines = []
        for _ in range(4):
            tail = list(rng.choice(family))
            if rng.random() < 0.7:
                tail[rng.randrange(7)] = rng.choice(names)
            lines.append("the old house " + " ".join(tail))
        docs.append((d, "\n".join(lines)))
    df, want = spark.createDataFrame(docs, "doc_id long, text string"), brute(docs)
    for chunk in (1, 7, 256):
        assert {r.doc_id: r.text for r in m.drop_recurring_lines(df, chunk=chunk).collect()} == want


def test_edges(spark):
    assert m.drop_recurring_lines(empty_docs(spark)).count() == 0
    docs = edge_docs(spark)
    out = m.drop_recurring_lines(docs, stats=True)
    assert out.count() == docs.count()
    assert set(docs.columns) <= set(out.columns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    ids = [r for r in out.collect() if r.doc_id == 5]
    assert len({r["text"] for r in ids if r["n_chars"] == 3}) == 1


def test_texts_are_split_once_and_masked_by_line(spark):
    """No split of the text for each of its lines, no pattern over a whole text with a digit."""
    df = spark.createDataFrame([(1, "a"), (2, "a\tb  c1\x0b \r\n 7 \x0c\n\t \nx1y  z")], "doc_id long, text string")
    plan = m.drop_recurring_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(" in plan and "lambdafunction(get(split(" not in plan and "lambdafunction(split(" not in plan
    lines = m._lines(df, "doc_id", "text", m.DEPTH)
    assert "rlike(text" not in lines._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r._id, r.pos, r.line) for r in lines.collect()) == [
        (1, 0, "a"), (2, 0, "a b <*>"), (2, 1, "<*>"), (2, 3, "<*> z")]
