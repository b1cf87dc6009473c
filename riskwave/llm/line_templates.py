"""Recurring-line removal by a fixed-depth log-template tree.

Lines are parsed as a log-template tree does: the first level is the
number of tokens, the next ``DEPTH`` levels are the leading tokens, and
tokens that hold a digit are variable fields (``<*>``).  A leaf keeps a list
of templates.  Its lines come in the order of (document, line number); a line
joins the leaf's first template that it agrees with in at least ``SIMILAR`` of
its positions (a variable field of the template agrees with everything), and
becomes a template itself if there is none.  A template that occurs in two or
more documents is recurring: it stays in the first of them (smallest doc_id)
and its lines are dropped from all others.  Every line with a token is parsed;
for lines of up to ``DEPTH`` tokens the leaf is the whole line.

Everything is DataFrame expressions.  Only hashes and positions of lines
are shuffled; tokens travel only for leaves that hold different lines of
several documents.  Groups are reduced by minima before the shuffle, so a
very common line costs one row a task.

A leaf's templates are found ``CHUNK_LINES`` different lines at a time: the
first ones form templates in one row, then all lines left in the leaf are
compared with these, wherever they lie, and what joined none goes into the
next round, until no leaf has lines left.  The result is that of the whole
list in order, and no task holds a leaf.

Documents stay, with empty text if all lines go; null text stays null and has
no lines, empty and blank lines stay.  Very long texts are split by the
expressions as a whole; the step that drops lines is linear in them.  Rows
equal in id and text count as one document and get equal results, so repeated
rows and ties need no order.  An empty table gives an empty result.  Other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskwave.llm.common import materialise
from riskwave.plans.broadcast import bounded_broadcast

DEPTH = 3
SIMILAR = 0.8
CHUNK_LINES = 256           # different lines of a leaf that are formed into templates at once

MAX_BROADCAST_LEAVES = 2_000_000    # leaf numbers (8 bytes each) sent to every task at most

_SPACE = " \\t-\\r"
_BLANK = " \\t\\x0B\\f\\r"      # white space other than the line feed
_BLANK_RUN = f"[\\t\\x0B\\f\\r][{_BLANK}]*| [{_BLANK}]+"     # other than one space
_DIGIT_TOKEN = f"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+"


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(_id, _th, pos, line, leaf, h) of every line that has a token; ``line``
    holds its tokens, variable fields masked, with single spaces between; the
    hashes ``leaf`` and ``h`` name it.  Patterns that write run only where
    there is something to write: a run of blanks other than one space, a digit."""
    text = F.col(text_col)
    blanks = F.lit(False)
    for blank in ("  ", "\t", "\x0B", "\f", "\r"):
        blanks = blanks | F.contains(text, F.lit(blank))
    spaced = F.when(blanks, F.regexp_replace(text, _BLANK_RUN, " ")).otherwise(text)
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"),
                        F.posexplode(F.split(spaced, "\n", -1)).alias("pos", "_raw")).where(F.trim("_raw") != "")
    masked = F.when(F.col("_raw").rlike("[0-9]"), F.regexp_replace("_raw", _DIGIT_TOKEN, "<*>")).otherwise(F.col("_raw"))
    lines = lines.select("_id", "_th", "pos", F.trim(masked).alias("line"))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    return (lines.withColumn("leaf", F.xxhash64(n, F.substring_index("line", " ", depth)))
            .withColumn("h", F.xxhash64("line")))


def _agrees(line: Column, template: Column, similar: float) -> Column:
    same = F.zip_with(line, template, lambda a, b: (a == b) | (b == "<*>"))
    return F.size(F.filter(same, lambda x: x)) >= similar * F.size(line)


def _families(lines: DataFrame, similar: float, chunk: int) -> DataFrame:
    """``lines`` (leaf, h, tokens, first), different ones only -> (leaf, h,
    template), the hash of the line that is each line's template."""
    named, left = None, lines
    while True:
        place = F.row_number().over(Window.partitionBy("leaf").orderBy("first"))
        heads = left.withColumn("place", place).where(F.col("place") <= chunk)
        formed = heads.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("first", "h", "tokens"))).alias("heads"))
        templates = formed.select("leaf", F.aggregate(
            "heads", F.filter("heads", lambda x: F.lit(False)),
            lambda found, x: F.when(F.exists(found, lambda t: _agrees(x["tokens"], t["tokens"], similar)), found)
            .otherwise(F.concat(found, F.array(x)))).alias("templates"))
        joins = F.get(F.filter("templates", lambda t: _agrees(F.col("tokens"), t["tokens"], similar)), F.lit(0))
        met = materialise(left.join(templates, "leaf").withColumn("template", joins["h"]).drop("templates"), "families")
        done = met.where("template is not null").select("leaf", "h", "template")
        named = done if named is None else named.unionByName(done)
        left = met.where("template is null").drop("template")
        if left.isEmpty():
            return named


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                    similar: float = SIMILAR, chunk: int = CHUNK_LINES) -> DataFrame:
    """(_id, _th, dropped): 0-based numbers of the lines to drop, one row
    per document that loses any."""
    parsed = _lines(docs, id_col, text_col, depth)
    lines = materialise(parsed.drop("line"), "lines")
    doc = F.struct("_id", "_th")
    distinct = materialise(
        lines.groupBy("leaf", "h").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")), "distinct-lines")
    # Leaves with different lines of several documents have templates to
    # form.  Texts are parsed a second time, as hashes alone are kept; only
    # these leaves' lines leave the scan, if the leaf numbers are few enough
    # to broadcast.
    mixed = distinct.groupBy("leaf").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")) \
        .where((F.col("n") > 1) & ~F.col("lo").eqNullSafe(F.col("hi"))).select("leaf")
    mixed = bounded_broadcast(materialise(mixed, "mixed-leaves"), MAX_BROADCAST_LEAVES)
    worded = materialise(
        parsed.join(mixed, "leaf", "left_semi").groupBy("leaf", "h")
        .agg(F.min("line").alias("line"), F.min(F.struct("_id", "_th", "pos")).alias("first"))
        .select("leaf", "h", F.split("line", " ").alias("tokens"), "first"), "leaf-lines")
    named = (distinct.join(_families(worded, similar, chunk), ["leaf", "h"], "left")
             .withColumn("template", F.coalesce("template", "h")))
    recurring = (named.groupBy("leaf", "template").agg(F.min("lo").alias("home"), F.max("hi").alias("far"))
                 .where(~F.col("home").eqNullSafe(F.col("far"))).select("leaf", "template", "home"))
    homes = named.join(recurring, ["leaf", "template"]).select("leaf", "h", "home")
    return (lines.join(homes, ["leaf", "h"])
            .where(~F.struct("_id", "_th").eqNullSafe(F.col("home")))
            .groupBy("_id", "_th").agg(F.sort_array(F.collect_set("pos")).alias("dropped")))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         stats: bool = False, **rules) -> DataFrame:
    """``docs`` with recurring lines dropped from the text; with ``stats``
    also ``n_lines`` and ``n_dropped`` (in place of columns so named)."""
    drops = recurring_lines(docs, id_col, text_col, **rules)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(id_col).alias("_k"), F.xxhash64(F.col(text_col)).alias("_h"))
    both = keyed.join(drops, F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")
    text = F.col("row").getField(text_col)

    def stay(parts: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
        return F.array_join(F.transform(numbers, lambda i: F.get(parts, i)), "\n")
    # The outer lambda binds the lines: the inner one would split the text for every line.
    kept = F.when(F.col("dropped").isNull(), text).otherwise(
        F.get(F.transform(F.array(F.split(text, "\n", -1)), stay), F.lit(0)))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1
    cols = [(kept if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns
            if not (stats and c in ("n_lines", "n_dropped"))]
    if stats:
        cols += [F.when(text.isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
                 F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped")]
    return both.select(*cols)


# DuckDB SQL for the query's rows (documents with distinct ids).
ORACLE = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS g(i)
), parsed AS (
  SELECT doc_id, pos, list_transform(
      list_filter(regexp_split_to_array(line, '[ \\t-\\r]+'), lambda t: t <> ''),
      lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM lines
), steps AS (
  SELECT doc_id, pos, tokens, {{'n': len(tokens), 'lead': tokens[1:{DEPTH}]}} AS leaf, CAST(NULL AS VARCHAR[]) AS template
  FROM parsed WHERE len(tokens) > 0
  UNION ALL
  SELECT doc_id, pos, tokens, leaf, CASE WHEN
      list_sum(list_transform(list_zip(tokens, first), lambda z: CASE WHEN z[1] = z[2] OR z[2] = '<*>' THEN 1 ELSE 0 END))
        >= {SIMILAR} * len(tokens) THEN first END
  FROM (SELECT *, first_value(tokens) OVER (PARTITION BY leaf ORDER BY doc_id, pos) AS first
        FROM steps WHERE template IS NULL)
), named AS (
  SELECT * FROM steps WHERE template IS NOT NULL
), home AS (
  SELECT leaf, template, min(doc_id) AS home FROM named GROUP BY leaf, template
), gone AS (
  SELECT doc_id, list(pos) AS dropped FROM named JOIN home USING (leaf, template)
  WHERE doc_id <> home GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  coalesce(len(dropped), 0) AS n_dropped,
  CASE WHEN dropped IS NULL THEN text ELSE
    array_to_string(list_transform(list_filter(generate_series(1, len(string_split(text, chr(10)))),
      lambda i: NOT list_contains(dropped, i - 1)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text
FROM documents d LEFT JOIN gone USING (doc_id)
"""
