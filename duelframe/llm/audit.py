"""Filter interaction audit: what five filters remove, alone and in every order.

Documents come as a stream of files, some at a time. Four filters look at the
text alone; the fifth fails a text that a smaller doc_id has too. The least
doc_id of each text is kept as state: a later batch that brings a smaller one
takes the earlier documents' combination of failures back from the counts and
enters them with the fifth failure. A batch's state and counts are written below
its number, so a batch that runs again after a failure replaces its own.

A null text is empty. A null doc_id is larger than all others. Rows with an
equal doc_id count each and don't repeat one another. A null source is the empty
part. A document has a label if any of its label rows has it. Other columns are not
read. Empty tables give no rows.
"""

from __future__ import annotations

import posixpath
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duelframe.llm.common import cut, drop, let, remove, whole, words
from duelframe.session import fresh_path

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCHES = 3  # so many micro-batches at most, so that state is read as often at any size
REPEATED = 1 << FILTERS.index("E")

_KEY = "text_key"
_GROUP = ("part", "mask", "good", "toxic")


def failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits."""
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    counts = let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("d")))

    def bits(c: Column) -> Column:
        failed = (
            c["n"] < 50,
            100 * c["d"].cast("long") < 65 * c["n"].cast("long"),
            100 * less(CAPITALS).cast("long") > 5 * F.length(text).cast("long"),
            less(SYMBOLS) > 0,
        )
        return sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))

    return let(counts, bits)


def judged(docs: DataFrame) -> DataFrame:
    """``(text_key, doc_id, part, mask)``: a text is known by 128 bits of its SHA-256."""
    key = F.substring(F.unhex(F.sha2(whole("text"), 256)), 1, 16)
    part = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(key.alias(_KEY), "doc_id", part.alias("part"), failures(whole("text")).alias("mask"))


def label_flags(labels: DataFrame) -> DataFrame:
    """One row for each labelled document: ``(doc_id, good, toxic)``."""
    named = labels.where(F.col("doc_id").isNotNull())
    some = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return named.groupBy("doc_id").agg(some("quality").alias("good"), some("toxic").alias("toxic"))


class Counts:
    """The audit's state in a shared folder: least ids by text, and changes of counts by batch."""

    def __init__(self, spark: SparkSession, labels: DataFrame, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.flags = cut(label_flags(labels), "label-flags")
        self.batches: set[int] = set()

    def path(self, kind: str, number: int) -> str:
        return posixpath.join(self.folder, kind, f"batch={number}")

    def saved(self, df: DataFrame, kind: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(kind, number))
        return self.spark.read.schema(df.schema).parquet(self.path(kind, number))

    def earlier(self, schema: StructType, number: int) -> DataFrame:
        """State rows of the batches before: those with the least id of their text so far.

        What was the least and is no more has been taken back already.
        """
        paths = [self.path("state", n) for n in range(number)]
        if not paths:
            return self.spark.createDataFrame([], schema).where("not late")
        return self.spark.read.schema(schema).parquet(*paths).where("not late")

    def add(self, batch: DataFrame, number: int) -> None:
        """One micro-batch. The stream's plan only judges texts; what follows starts from files."""
        rows = self.saved(judged(batch), "judged", number)
        named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id").alias("id")
        flagged = rows.join(self.flags, "doc_id", "left").select(
            _KEY,
            named,
            "part",
            "mask",
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
        new = cut(flagged.groupBy(_KEY, "id", *_GROUP).agg(F.count("*").alias("n")), "audit-rows")
        state = StructType(new.schema.fields).add("late", "boolean")
        least = new.groupBy(_KEY).agg(F.min("id").alias("new"))
        least = cut(least, "audit-least")
        known = cut(self.earlier(state, number).join(least, _KEY), "audit-known")
        before = known.groupBy(_KEY).agg(F.min("id").alias("old"))
        now = least.join(before, _KEY, "left").withColumn("now", F.least("new", "old"))
        now = cut(now, "audit-now")
        marked = new.join(now.select(_KEY, "now"), _KEY).withColumn("late", F.col("id") > F.col("now"))
        marked = self.saved(marked.select(*state.names), "state", number)
        entered = marked.select("part", _mask(F.col("late")), "good", "toxic", "n")
        # the least so far that is no longer the least
        beaten = known.drop("new").join(now.where("old > now").select(_KEY, "old"), _KEY).where("id = old")
        taken = beaten.select(*_GROUP, (-F.col("n")).alias("n"))
        again = beaten.select("part", _mask(F.lit(True)), "good", "toxic", "n")
        changes = entered.unionByName(taken).unionByName(again).groupBy(*_GROUP).agg(F.sum("n").alias("n"))
        self.saved(changes, "changes", number)
        drop(new, least, known, now)
        remove(self.spark, self.path("judged", number))
        self.batches.add(number)

    def totals(self) -> DataFrame:
        """``(part, mask, good, toxic, n)`` after all batches."""
        if not self.batches:
            kinds = "part string, mask int, good boolean, toxic boolean, n long"
            return self.spark.createDataFrame([], kinds)
        # a restarted stream may have done the earlier ones
        changes = self.spark.read.parquet(*[self.path("changes", n) for n in range(max(self.batches) + 1)])
        return changes.groupBy(*_GROUP).agg(F.sum("n").alias("n")).where("n <> 0")

    def close(self) -> None:
        remove(self.spark, self.folder)
        drop(self.flags)


def _mask(late: Column) -> Column:
    return (F.col("mask") + F.when(late, REPEATED).otherwise(0)).alias("mask")


def audited(totals: DataFrame) -> DataFrame:
    """The rows of every part, order and step, from ``(part, mask, good, toxic, n)``."""
    each = range(1 << len(FILTERS))

    def by_mask(n: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, n)), F.lit(0)) for m in each])

    n = F.col("n")
    parts = totals.groupBy("part").agg(
        by_mask(n).alias("every"),
        by_mask(F.when(F.col("good"), n)).alias("good"),
        by_mask(F.when(F.col("toxic"), n)).alias("toxic"),
    )
    steps = parts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )

    def bits(letters: Column) -> Column:
        return sum((F.contains(letters, F.lit(x)).cast("int") * (1 << k) for k, x in enumerate(FILTERS)), F.lit(0))

    own = bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    before = bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1))
    rows = steps.withColumn("_own", own).withColumn("_before", before)

    def total(counts: str, where) -> Column:
        chosen = F.transform(counts, lambda n, m: F.when(where(m), n).otherwise(0))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, b: a + b)

    own, before = F.col("_own"), F.col("_before")
    fails = lambda m: m.bitwiseAND(own) > 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    # of the orders, the filter comes first among a document's k failures in one in k
    shares = F.transform(
        "every", lambda n, m: F.when(fails(m), n * F.expr(f"{len(ORDERS)}L") / F.bit_count(m)).otherwise(0).cast("long")
    )
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("every", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("every", here).alias("removed"),
        total("every", lambda m: fails(m) & (m.bitwiseAND(before) > 0)).alias("redundant"),
        total("every", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def file_or_folder(path: str) -> str:
    """The path as a pattern with itself as only match: a stream takes a single file by a pattern only."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per part, order of the filters and step, for the Parquet files at ``path``.

    All files there are processed, in at most ``batches`` micro-batches, and the
    stream ends. ``labels`` has ``doc_id, quality, toxic``.
    """
    now = spark.read.parquet(path)
    found, files = now.schema, -(-len(now.inputFiles()) // batches)
    schema = StructType([found[c] for c in ("doc_id", "text", "source")])
    folder = fresh_path(spark, "audit")
    counts = Counts(spark, labels.select("doc_id", "quality", "toxic"), posixpath.join(folder, "tables"))
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max(1, files))
        .parquet(file_or_folder(path))
        .writeStream.foreachBatch(counts.add)
        .option("checkpointLocation", posixpath.join(folder, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    totals = cut(counts.totals(), "audit-totals")
    counts.close()
    return audited(totals)
