"""Line dedup: of a passage of three lines that occurs twice, the later lines go.

A null text stays null and has no lines. Lines without a word take no part and
stay. Texts of fewer than three lines with words are never changed. Rows are
told apart by doc_id, a number or a string (null comes first), and text: full
repeats of a row are one document given twice and come out alike. Other columns
are kept, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import NOT_BLANK, column, cut, drop, indexes, let

_KEY = ("_id", "_text_hash")


def _keys() -> list[Column]:
    """A null doc_id sorts before all others."""
    return [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash")]


def windows(docs: DataFrame) -> DataFrame:
    """``(_id, _text_hash, at, h1, h2)``: every three consecutive lines, as 128 bits.

    ``at`` holds the places of the three lines among all lines of the text.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    worded = F.filter(lines, lambda s: s["x"].rlike(NOT_BLANK))

    def three(ls: Column) -> Column:
        def one(i: Column) -> Column:
            a, b, c = (F.get(ls, i + k) for k in range(3))
            return F.struct(
                F.array(a["i"], b["i"], c["i"]).alias("at"),
                F.xxhash64(a["x"], b["x"], c["x"]).alias("h1"),
                F.xxhash64(F.lit("second"), c["x"], b["x"], a["x"]).alias("h2"),
            )

        return F.transform(indexes(F.size(ls) - 2), one)

    rows = docs.where(F.col("text").isNotNull()).select(
        *_keys(), F.explode(let(worded, three)).alias("w")
    )
    return rows.select(*_KEY, "w.*")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``(_id, _text_hash, lines)``: the places of the lines that repeat earlier ones.

    A window's first occurrence, by document and place, is found by a minimum
    that tasks combine before the shuffle. The occurrences are joined to it as rows,
    and both sides are read from files, so a very common passage can be split.
    """
    all_windows = cut(windows(docs), "line-windows")
    place = F.struct(*_KEY, "at")
    first = (
        all_windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    first = cut(first, "line-firsts")
    later = all_windows.join(first, ["h1", "h2"]).where(place > F.col("_first"))
    covered = later.select(*_KEY, F.explode("at").alias("line")).distinct()
    gone = cut(covered.groupBy(*_KEY).agg(F.collect_set("line").alias("lines")), "repeated-lines")
    drop(all_windows, first)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``(row, n_lines, n_removed)``: the columns of ``docs`` with ``text`` without repeated lines.

    Repeated lines are read from a file, so rows of one doc_id can be split.
    """
    row = F.struct(*[column(c) for c in docs.columns]).alias("_row")
    gone = repeated_lines(docs.select("doc_id", "text")).withColumnsRenamed({k: f"_g{k}" for k in _KEY})
    joined = docs.select(row, "text", *_keys()).join(
        gone.hint("shuffle_hash"),
        F.col("_id").eqNullSafe(F.col("_g_id")) & (F.col("_text_hash") == F.col("_g_text_hash")),
        "left",
    )
    left = let(
        F.split("text", "\n"),
        lambda ls: F.array_join(
            F.transform(
                F.array_except(indexes(F.size(ls)), F.col("lines")), lambda i: F.get(ls, i)
            ),
            "\n",
        ),
    )
    count = lambda xs: F.when(xs.isNull(), 0).otherwise(F.size(xs))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(left)
    fields = [(text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns]
    return joined.select(
        F.struct(*fields).alias("row"),
        count(F.split("text", "\n")).alias("n_lines"),
        count(F.col("lines")).alias("n_removed"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed)`` for every document."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "row.doc_id",
        "row.text",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; a text that repeats earlier ones as a whole goes with its row.

    ``n_chars``, where there is one, follows the new text.
    """
    changed, row = F.col("n_removed") > 0, F.col("row")
    emptied = changed & ~row["text"].rlike(NOT_BLANK)
    kept = dedup_lines(docs).where(~F.coalesce(emptied, F.lit(False)))
    fields = {c: row[c] for c in docs.columns}
    if "n_chars" in fields:
        length = F.length(row["text"]).cast(docs.schema["n_chars"].dataType)
        fields["n_chars"] = F.when(changed, length).otherwise(row["n_chars"])
    return kept.select(*[value.alias(c) for c, value in fields.items()])
