"""Line dedup by overlapping three-line windows (DataFrame functions only).

The lines of a document that hold a word are normalised (lower case, single spaces, trimmed); every three consecutive
ones form a window, known by a 64-bit hash of the three. The first occurrence of a window is the one with the smallest
(doc_id, position); all lines covered by any later occurrence, overlapping windows merged, are removed.

Defined cases: a document of one or two such lines forms no window and is left whole; lines without a word are never
removed by themselves but go where all lines with words went; a null text has no lines; a null doc_id counts as larger
than every other; rows repeated in full are one row to the rule and both stay as the first does; equal documents keep
their lines only in the one with the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.lines import HAS_WORD, let, normal, text_lines
from loomery.llm.workdir import partitions, written
from loomery.operators.relational import skewed_lookup

WINDOW = 3
NULL_ID = 2**63 - 1


def _windows(text: Column) -> Column:
    """array<struct<h, at array<int>>>: hash and line numbers of each window."""
    with_word = F.filter(
        F.transform(
            text_lines(text),
            lambda x, i: F.struct(F.when(x.rlike(HAS_WORD), F.xxhash64(normal(x))).alias("h"), i.alias("i")),
        ),
        lambda s: s["h"].isNotNull(),
    )
    return let(
        with_word,
        lambda w: F.when(
            F.size(w) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW),
                lambda k: F.struct(
                    F.xxhash64(F.get(w, k)["h"], F.get(w, k + 1)["h"], F.get(w, k + 2)["h"]).alias("h"),
                    F.array(F.get(w, k)["i"], F.get(w, k + 1)["i"], F.get(w, k + 2)["i"]).alias("at"),
                ),
            ),
        ),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "id_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
            "text_key": F.xxhash64("text"),
        }
    )


def covered_lines(keyed: DataFrame) -> DataFrame:
    """(id_key, text_key, gone array<int>): line numbers to remove, by row."""
    spots = keyed.select("id_key", "text_key", F.explode(_windows(F.col("text"))).alias("w")).select(
        "id_key",
        "text_key",
        F.col("w.h").alias("h"),
        F.col("w.at").alias("at"),
        F.struct("id_key", "text_key", F.get(F.col("w.at"), F.lit(0)).alias("i")).alias("spot"),
    )
    repeated = (
        spots.groupBy("h")
        .agg(F.min("spot").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    # a window may occur in a third of all documents
    n = partitions(keyed.sparkSession)
    found = skewed_lookup(spots, written(repeated, "windows"), "h", "n", ["id_key", "text_key"], n)
    later = found.filter(F.col("spot") > F.col("first"))
    return (
        later.select("id_key", "text_key", F.explode("at").alias("i"))
        .groupBy("id_key", "text_key")
        .agg(F.collect_set("i").alias("gone"))
    )


def _deduped(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_removed, emptied): every row as it was and what becomes of its text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no name of a column can clash with ours
    keyed = _keyed(docs.select(row, "doc_id", "text"))
    j = keyed.join(covered_lines(keyed.select("id_key", "text_key", "text")), ["id_key", "text_key"], "left")
    result = let(
        text_lines(F.col("text")),
        lambda x: let(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.coalesce("gone", F.array().cast("array<int>"))),
                lambda i: F.get(x, i),
            ),
            lambda left: F.struct(F.size(x).cast("long").alias("n_lines"), F.array_join(left, "\n").alias("text")),
        ),
    )
    changed = F.col("gone").isNotNull()
    j = j.withColumn("res", result)
    return j.select(
        "row",
        F.when(changed, F.col("res.text")).otherwise(F.col("text")).alias("text"),
        "res.n_lines",
        F.when(changed, F.size("gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(changed, ~F.col("res.text").rlike(HAS_WORD)).otherwise(F.lit(False)).alias("emptied"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut from ``text``, plus n_lines, n_removed and emptied.

    ``emptied`` marks a document that had lines with words and has none left. Columns of ``docs`` with one of these
    names are replaced.
    """
    made = ["text", "n_lines", "n_removed", "emptied"]
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return _deduped(docs).select(*kept, *made)


def apply_dedup(docs: DataFrame) -> DataFrame:
    """Stage form: the columns of ``docs`` (``n_chars`` follows the text); documents of which nothing is left go."""
    return _deduped(docs).filter("not emptied").select(*with_text(docs))


def with_text(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` out of ``row``, ``text`` and ``n_chars`` from the new text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
