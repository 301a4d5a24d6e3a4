"""Quality rules with cutoffs that follow each language and source.

A null text has no words and fails the fixed rules. A null language or source
is a value of its own. Rows with an equal doc_id are judged one by one. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from duelframe.llm.common import NOT_BLANK, column, cut, indexes, let, whole, words

SYMBOLS = "#*$%&|<>"
GROUP = ("lang", "source")


@dataclass(frozen=True)
class Measure:
    """A whole number per document, and how far from its group's median it may lie.

    The upper fence lies ``reach`` times the distance from the median to the
    ``at``-th percentile beyond the median, the lower one as far from it as the
    opposite percentile says. ``guard`` covers the width of a bucket and single words.
    """

    name: str
    of: str
    at: int
    reach: int
    guard: int
    below: bool = False


# Symbols and word lengths spread around the middle, and what lies far beyond the middle
# half of a group is junk there. Few ordinary texts repeat or shout at all, and those that
# do differ much, so these are measured by their group's highest hundredth.
MEASURES = (
    Measure("symbols", "n_symbols * 1000 div nullif(n_words, 0)", at=75, reach=4, guard=20),
    Measure("dup_lines", "n_dup_lines * 1000 div nullif(n_lines, 0)", at=99, reach=3, guard=20),
    Measure("repeats", "n_repeat_words * 1000 div nullif(n_words, 0)", at=99, reach=3, guard=20),
    Measure("word_length", "word_chars * 100 div nullif(n_words, 0)", at=75, reach=10, guard=40, below=True),
    Measure("capitals", "n_capitals * 1000 div nullif(word_chars, 0)", at=99, reach=5, guard=5),
)
MIN_DOCS = 50


def repeated_words(ws: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    Windows are compared by 64-bit hashes. Only a text with an equal pair of them
    sorts its windows; equal neighbours give the places, and the covered words
    are counted from the gaps between places.
    """
    hashes = F.transform(
        indexes(F.size(ws) - 2),
        lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
    )

    def covered(hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(ps: Column) -> Column:
            found = F.filter(
                ps,
                lambda p, j: (F.get(ps, j - 1)["h"] == p["h"])
                | F.coalesce(F.get(ps, j + 1)["h"] == p["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(found, lambda p: p["i"]))

        def count(at: Column) -> Column:
            steps = F.transform(
                at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))
            )
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(let(placed, repeated), count)

    return let(
        hashes,
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long"))
        .otherwise(covered(hs)),
    )


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts per document, in one pass over its text and without moving rows."""
    text = whole("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK))
    per_line = let(lines, lambda x: F.struct(F.size(x), F.size(F.array_distinct(x))))
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    per_words = let(
        words(text), lambda ws: F.struct(F.size(ws).alias("n"), repeated_words(ws).alias("r"))
    )
    return docs.select(
        *[column(c) for c in keep],
        per_words.alias("_w"),
        per_line.alias("_l"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        less(SYMBOLS).cast("long").alias("n_symbols"),
        less(ascii_uppercase).cast("long").alias("n_capitals"),
    ).select(
        *[column(c) for c in keep],
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("_l.col1") - F.col("_l.col2")).cast("long").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        "n_capitals",
        F.col("_l.col1").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(stats: DataFrame) -> DataFrame:
    """Quantile sketches ``(lang, source, measure, bucket, n)``.

    A sketch counts its values by bucket, so that sketches merge by adding
    counts: tasks merge theirs on the map side, languages and the whole are
    merged from sources. A bucket is 1/128 of its value wide at most.
    """
    values = F.explode(
        F.array(
            *[
                F.struct(F.lit(m.name).alias("measure"), F.expr(m.of).cast("long").alias("v"))
                for m in MEASURES
            ]
        )
    )
    rows = stats.where(~base_failed()).select(*GROUP, values.alias("x")).select(*GROUP, "x.*")
    low = F.length(F.bin("v")) - 8
    width = F.expr("shiftleft(1L, greatest(_low, 0))")
    rows = rows.withColumn("_low", low).select(
        *GROUP, "measure", (F.col("v") - F.col("v") % width).alias("bucket")
    )
    return rows.groupBy(*GROUP, "measure", "bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, *group: str) -> DataFrame:
    """``(group, docs, measure, low, high)`` from merged sketches."""
    merged = sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole_group = Window.partitionBy(*group, "measure")
    upto = whole_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select(
        *group,
        "measure",
        "bucket",
        F.sum("n").over(upto).alias("_upto"),
        F.sum("n").over(whole_group).alias("docs"),
    )
    def of(field: str) -> Column:
        """The field of the row's measure."""
        value = F.lit(None)
        for m in MEASURES:
            value = F.when(F.col("measure") == m.name, getattr(m, field)).otherwise(value)
        return value

    at = lambda percent: F.min(F.when(F.col("_upto") * 100 >= F.col("docs") * percent, F.col("bucket")))
    quantiles = ranked.groupBy(*group, "measure", "docs").agg(
        at(100 - of("at")).alias("_low"), at(F.lit(50)).alias("_middle"), at(of("at")).alias("_high")
    )
    middle = F.col("_middle")
    return quantiles.select(
        *group,
        "docs",
        "measure",
        F.when(of("below"), middle - (middle - F.col("_low")) * of("reach") - of("guard")).alias("low"),
        (middle + (F.col("_high") - middle) * of("reach") + of("guard")).alias("high"),
    )


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Fences per language and source, one row each: ``low_<measure>, high_<measure>``.

    A source with fewer than ``min_docs`` documents takes its language's fences,
    and such a language those of all.
    """
    own = _fences(sketch, *GROUP)
    lang = _fences(sketch, "lang").select(
        F.col("lang").alias("_lang"),
        F.col("measure").alias("_measure"),
        F.struct("docs", "low", "high").alias("_by_lang"),
    )
    every = _fences(sketch).select(
        F.col("measure").alias("_any"), F.struct("docs", "low", "high").alias("_by_all")
    )
    mine = own.join(
        lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure"))
    ).join(every, F.col("measure") == F.col("_any"))
    chosen = (
        F.when(F.col("docs") >= min_docs, F.struct("docs", "low", "high"))
        .when(F.col("_by_lang.docs") >= min_docs, F.col("_by_lang"))
        .otherwise(F.col("_by_all"))
    )
    pick = lambda end, m: F.max(
        F.when(F.col("measure") == m.name, F.col(f"_chosen.{end}"))
    ).alias(f"{end}_{m.name}")
    return (
        mine.withColumn("_chosen", chosen)
        .groupBy(*GROUP)
        .agg(*[pick(end, m) for m in MEASURES for end in ("low", "high")])
    )


def judged(stats: DataFrame, fences: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``.

    Fences that are read from a file are known in size: few are broadcast, and
    many are joined in a way that lets a very large source be split.
    """
    fences = fences.withColumnsRenamed({g: f"_{g}" for g in GROUP})
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP]
    outside = F.lit(False)
    for m in MEASURES:
        value = F.expr(m.of)
        outside = outside | F.coalesce(value > F.col(f"high_{m.name}"), F.lit(False))
        if m.below:
            outside = outside | F.coalesce(value < F.col(f"low_{m.name}"), F.lit(False))
    kept = F.when(F.col("base_failed"), False).otherwise(~outside)
    joined = stats.withColumn("base_failed", base_failed()).join(fences, same, "left")
    return joined.withColumn("kept", kept)


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdicts: ``doc_id``, the counts, ``base_failed`` and ``kept``.

    ``docs`` has ``doc_id, text, lang, source``; other columns are not read.
    """
    stats = cut(measured(docs, ("doc_id", *GROUP)), "quality")
    return judged(stats, cut(thresholds(sketches(stats)), "fences")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``quality`` keeps, with all columns of ``docs`` as they are.

    The counts are written beside the rows, so the text is measured and moved once.
    """
    row = F.struct(*[column(c) for c in docs.columns]).alias("_row")
    packed = docs.select(row, "text", *GROUP)
    stats = cut(measured(packed, ("_row", *GROUP)), "quality")
    return judged(stats, cut(thresholds(sketches(stats)), "fences")).where("kept").select("_row.*")
