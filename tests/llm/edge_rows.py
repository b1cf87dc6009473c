"""Rows that every operator on documents must survive."""

LONG = " ".join(f"word{i % 977} Ünïcode,{i % 13}" for i in range(30_000))

EDGE_TEXTS = [
    None, "", " \t\n ", "one", "a b c d", "the cat sat on the mat " * 8, "the cat sat on the mat " * 8,
    "x\x1cy\x85z\xa0w v", "İstanbul ΣΑΣ ſoft 漢字 \U0001f600 naïve", "it's WE'LL <|endoftext|>b <|ENDOFTEXT|>",
    "line one here now\nline one here now\n\nlast line 42 of many words", LONG,
]

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark, extra: bool = True):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None)
            for i, t in enumerate(EDGE_TEXTS)]
    rows += [(5, EDGE_TEXTS[5], "en", "src2", 3), (5, EDGE_TEXTS[5], "en", "src2", 3),   # repeated rows
             (None, "a row without an id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    if extra:   # extra columns whose names clash with the operators' own
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("x") for c in
                             ("_id", "_th", "word", "freq", "score", "kept", "slot", "key", "rank", "n_tokens")})
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
