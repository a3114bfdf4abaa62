"""Quality rules: base text statistics and cross-document line frequency (DataFrame functions only).

Line frequency works per host (the ``source`` column): each document's normalised lines are hashed, the distinct
documents of every (host, line) are counted, lines found in more documents than the host's limit are removed, and a
document that loses too much of its text that way is rejected.

Distinct documents are texts that differ: rows of a host whose normalised lines are all the same, in the same order, are
one document however often it is repeated. No other merging is done: documents that share some or most lines count each.

A host's frequent lines are one row, an array: each is in more than LINE_MAX_SHARE of the host's documents, so there are
fewer than 1 / LINE_MAX_SHARE times the lines of an average document of it. Documents meet that row by their host, so no
line table is joined back to documents; a hot host is a skewed join key that adaptive execution splits.

Defined cases: null text is the empty text; a null source is a host of its own, as is a table without sources; a row is judged by its text and source
alone, so repeated ids and repeated rows are safe and equal rows get equal verdicts; columns other than doc_id, text and
source are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.line_dedup import with_text
from loomery.llm.lines import HAS_WORD, SPACES, let, normal, text_lines, words
from loomery.llm.workdir import written

#: A document needs so many words, and at most this share of them in repeated 3-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate in a host if more than this many, and more than this share, of its documents have it.
LINE_MIN_DOCS = 50
LINE_MAX_SHARE = 0.05
#: A document is depleted if less than this share of its word characters is left.
MIN_LEFT_SHARE = 0.5


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the word array ``w``, the first occurrence included.

    Windows are compared by 64-bit hash. Sorting (hash, position) pairs puts equal windows side by side; the sorted
    positions of repeated windows then cover ``min(3, gap to the next)`` words each. ``w`` must be a bound variable.
    """
    pairs = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
    )

    def positions(s: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            return F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])

        return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(covered(let(pairs, positions)))


def base_struct(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    symbols = "#*$%&|<>"
    of_words = let(
        words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeated"))
    )
    dup_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD)),
        lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    )
    return let(
        of_words,
        lambda x: F.struct(
            x["n"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, symbols, ""))).cast("long").alias("n_symbols"),
            dup_lines.alias("n_dup_lines"),
            x["repeated"].alias("n_repeat_words"),
        ),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _source(docs: DataFrame) -> Column:
    return F.col("source") if "source" in docs.columns else F.lit(None).cast("string")


def _host() -> list[Column]:
    return [F.col("source"), F.col("source").isNull()]


def _lines(text: Column) -> Column:
    """(line, chars) of each line of a text in order: the hash of the normalised line (null if blank) and its word characters."""
    return F.transform(
        text_lines(text),
        lambda x: F.struct(
            F.when(x.rlike(HAS_WORD), F.xxhash64(normal(x))).alias("line"),
            F.length(F.translate(x, SPACES, "")).cast("long").alias("chars"),
        ),
    )


def _words_only(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: x["line"]), lambda x: x.isNotNull())


def _common(table: DataFrame) -> DataFrame:
    """(host, common): the lines above the limit of each host that has any, from a table of (host, lines).

    Two aggregations with map-side combine; the first one's key holds the document, so a line that a third of all rows
    have is spread over all tasks before it is counted.
    """
    documents = table.select("host", F.xxhash64(_words_only(F.col("lines"))).alias("doc"), _words_only(F.col("lines")).alias("lines"))
    hosts = documents.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    held = documents.select("host", "doc", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > LINE_MIN_DOCS)
    above = counts.join(hosts, "host").filter(F.col("n_docs") > LINE_MAX_SHARE * F.col("docs"))
    return written(above.groupBy("host").agg(F.collect_set("line").alias("common")), "common-lines")


def _gone(lines: Column) -> Column:
    """Which lines of a row are above its host's limit."""
    hit = F.coalesce(F.array_intersect(_words_only(lines), F.col("common")), F.array().cast("array<bigint>"))
    return let(hit, lambda h: F.transform(lines, lambda x: F.coalesce(F.array_contains(h, x["line"]), F.lit(False))))


def _chars_in(lines: Column, gone: Column) -> Column:
    per_line = F.zip_with(lines, gone, lambda x, g: F.when(g, x["chars"]).otherwise(F.lit(0).cast("long")))
    return F.aggregate(per_line, F.lit(0).cast("long"), lambda acc, n: acc + n)


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base columns, line_chars_removed, base_failed and kept."""
    base = docs.select("doc_id", _source(docs).alias("source"), F.col("text").cast("string").alias("text"))
    table = base.select("doc_id", F.xxhash64(*_host()).alias("host"), base_struct(F.col("text")).alias("b"), _lines(F.col("text")).alias("lines"))
    table = written(table.select("doc_id", "host", "b.*", "lines"), "lines")
    out = table.join(_common(table.select("host", "lines")), "host", "left")
    out = out.withColumn("line_chars_removed", let(_gone(F.col("lines")), lambda g: _chars_in(F.col("lines"), g)))
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    left = F.col("word_chars") - F.col("line_chars_removed")
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_LEFT_SHARE * F.col("word_chars")))
    return out.drop("host", "lines", "common")


def apply_rules(docs: DataFrame) -> DataFrame:
    """The documents that pass, boilerplate lines removed from ``text``, with the columns of ``docs``.

    ``n_chars``, where there is one, follows the new text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no name of a column can clash with ours
    base = docs.select(row, _source(docs).alias("source"), F.col("text").cast("string").alias("text"))
    base = base.select("row", "text", F.xxhash64(*_host()).alias("host"))
    table = written(base.select("host", _lines(F.col("text")).alias("lines")), "lines")
    text, nothing = F.col("text"), F.array().cast("array<string>")

    def without(gone: Column) -> Column:
        return F.array_join(F.filter(text_lines(text), lambda _, i: ~F.get(gone, i)), "\n")

    def judged(gone: Column, chars: Column, size: Column) -> Column:
        left = F.array(F.when(chars > 0, without(gone)).otherwise(text))
        return F.when(size - chars >= MIN_LEFT_SHARE * size, left).otherwise(nothing)

    def cut(size: Column) -> Column:
        return let(_lines(text), lambda x: let(_gone(x), lambda gone: let(_chars_in(x, gone), lambda chars: judged(gone, chars, size))))

    def passed(b: Column) -> Column:
        whole = F.when(F.col("common").isNull(), F.array(text)).otherwise(cut(b["word_chars"]))
        return F.when(base_failed(b["n_words"], b["n_repeat_words"]), nothing).otherwise(whole)

    # one generator, no filter: a filter would be pushed down and the text measured again for it
    j = base.join(_common(table), "host", "left")
    j = j.select("row", F.explode(let(base_struct(text), passed)).alias("text"))
    return j.select(*with_text(docs))
