"""WARC archives: written by Spark, and read back by chains of record boundaries.

A null ``html`` is an empty payload. A null ``page_id`` is kept as such; where
all rows of a payload have none, each is a response. Rows with an equal page_id
have a record each; of equal payloads all rows with the largest page_id are
responses. Line breaks in urls are percent-encoded. Other columns are not read.
An empty table gives an archive without records.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from duelframe.llm.common import cut, whole
from duelframe.session import fresh_path

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LEAST_BYTES = 1000  # of a payload that is stored once


def records(pages: DataFrame) -> DataFrame:
    """One record per page, as text without the gap that ends it.

    Of equal payloads of ``LEAST_BYTES`` or more, the row with the largest page_id
    holds the payload. The rows of a payload are combined before the shuffle, and
    joined to their response as rows, so a very common payload can be split.
    """
    html = whole("html")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    sized = rows.withColumn("bytes", F.octet_length("html"))
    shared = (
        pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
        .where(F.col("bytes") >= LEAST_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = sized.join(cut(shared, "warc-holders").hint("shuffle_hash"), "digest", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    held = F.when(revisit, "").otherwise(F.col("html"))
    size = F.when(revisit, 0).otherwise(F.col("bytes")) + len(HTTP)
    url = F.regexp_replace(F.regexp_replace(whole("url"), "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    fields = [
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("holder")))),
        F.when(
            revisit,
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    head = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *fields), F.lit(GAP))
    return joined.select(F.concat(head, F.lit(HTTP), held).alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """A folder of archives, one file per task.

    A compressed archive is read by one task, piece by piece; files written with
    ``none`` are split, however large.
    """
    records(pages).write.option("lineSep", GAP).option("compression", compression).text(path)


def _parsed(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a record, and where its content begins; None if it isn't one."""
    head, gap, _ = data.partition(GAP.encode())
    if not gap:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon:
            return None
        fields[key.strip().lower()] = value.strip()
    return (fields, len(head) + len(gap)) if fields.get("content-length", "").isdigit() else None


_KIND = pa.struct(
    [(n, pa.string()) for n in ("page", "kind", "refers", "said")]
    + [("bytes", pa.int64()), ("digest", pa.string()), ("complete", pa.bool_()), ("step", pa.int64())]
)
PIECE = (
    "page string, kind string, refers string, said string, bytes long, digest string, "
    "complete boolean, step long"
)


def _described(data: bytes) -> dict:
    """What a task says of the bytes that follow one magic."""
    parsed = _parsed(data)
    if parsed is None:
        return dict.fromkeys(("page", "kind", "refers", "said", "bytes", "digest", "step"), None) | {"complete": False}
    fields, start = parsed
    end = start + int(fields["content-length"])
    block = data[start:end]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    complete = end <= len(data)
    return {
        "page": fields.get("warc-record-id"),
        "kind": fields.get("warc-type"),
        "refers": fields.get("warc-refers-to"),
        "said": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "bytes": len(payload) if complete else None,
        "digest": sha1(payload).hexdigest() if complete else None,
        "complete": complete,
        # from this magic to the next record's
        "step": len(MAGIC) + end + len(GAP),
    }


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic, and what precedes the first; Spark splits large files."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("data"),
    )


def _inside(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, list[int]]]:
    """The data of each batch, and how many bytes of its split come before each piece.

    A split's rows follow one another, each with the magic that ended the last.
    """
    now, at = None, 0
    for files, splits, data in batches:
        places = []
        for split, size in zip(
            zip(files.to_pylist(), splits.to_pylist(), strict=True),
            pc.binary_length(data).to_pylist(),
            strict=True,
        ):
            if split != now:
                now, at = split, 0
            places.append(at)
            at += size + len(MAGIC)
        yield data, places


def _describe() -> Column:
    kind = pa.struct([*_KIND, pa.field("inside", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for data, places in _inside(batches):
            rows = zip(data, places, strict=True)
            yield pa.array([_described(x.as_py()) | {"inside": at} for x, at in rows], kind)

    return F.arrow_udf(run, PIECE + ", inside long")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, size`` and what its task says of every magic in the archives.

    ``at`` counts the bytes before the magic: the splits' sizes are added up per
    file, as a task knows only how far into its split it is.
    """
    raw = _raw(spark, path)
    said = raw.select(
        "file",
        "split",
        F.octet_length("data").alias("size"),
        _describe()("file", "split", "data").alias("d"),
    )
    found = cut(said.select("file", "split", "size", "d.*"), "warc-pieces")
    return found.join(_starts(found), ["file", "split"]).withColumn(
        "at", F.col("start") + F.col("inside") - len(MAGIC)
    ).drop("start")


def _starts(found: DataFrame) -> DataFrame:
    """``(file, split, start)``: the bytes of a file before a split's first piece."""
    sizes = found.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("all"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "split", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))


def reachable(candidates: DataFrame) -> DataFrame:
    """``(file, at)`` of the records that a chain from the start of their file reaches.

    ``candidates`` has ``file, at, next``. Pointer jumping: each round doubles how
    far every pointer goes and the reached records' targets join them. The joins
    are by merging: the tables are small as files and many times larger in memory.
    """
    jump = candidates.select("file", "at", "next")
    reached = cut(candidates.where("at = 0").select("file", "at"), "warc-reached")
    longest = candidates.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):
        hop = jump.select("file", F.col("at").alias("from"), F.col("next").alias("at"))
        further = reached.withColumnRenamed("at", "from").join(hop.hint("merge"), ["file", "from"])
        valid = candidates.select("file", "at").hint("merge")
        further = further.select("file", "at").join(valid, ["file", "at"], "left_semi")
        reached = cut(reached.unionByName(further).distinct(), "warc-reached")
        second = jump.select("file", F.col("at").alias("next"), F.col("next").alias("_to"))
        jump = cut(jump.join(second.hint("merge"), ["file", "next"]).select("file", "at", F.col("_to").alias("next")), "warc-jump")
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record.

    A record whose payload holds the magic itself comes in several pieces; they
    are put together from the texts of these pieces alone.
    """
    found = cut(pieces(spark, path), "warc-offsets")
    candidates = found.where("step is not null").select(
        "file", "at", (F.col("at") + F.col("step")).alias("next")
    )
    true = cut(reachable(candidates), "warc-true")
    whole_records = found.where("complete").join(true.hint("merge"), ["file", "at"], "left_semi")
    every = whole_records.select("page", "kind", "refers", "said", "bytes", "digest")
    owned = cut(_owned(found, true), "warc-owned")
    if not owned.isEmpty():
        every = every.unionByName(_broken(spark, path, owned))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    rows = cut(
        every.select(
            F.when(number("page") != "", number("page").cast("long")).alias("page_id"),
            F.when(number("refers") != "", number("refers").cast("long")).alias("refers_to"),
            F.col("kind").alias("record_type"),
            "said",
            "bytes",
            "digest",
        ),
        "warc-records",
    )
    held = rows.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("_holder"), F.col("digest").alias("_digest")
    ).agg(F.max("bytes").alias("_bytes"))
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    # records without a reference stay out of the join, where they would be one group
    joined = rows.where(revisit).join(
        cut(held, "warc-held"),
        (F.col("refers_to") == F.col("_holder")) & (F.col("said") == F.col("_digest")),
        "left",
    )
    return joined.unionByName(rows.where(~revisit), allowMissingColumns=True).select(
        "page_id",
        F.when(revisit, F.col("_bytes")).otherwise(F.col("bytes")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def _owned(found: DataFrame, true: DataFrame) -> DataFrame:
    """The pieces of records that the magic splits, with the place of their ``record``.

    A piece belongs to the last record that starts at or before it: in its own
    split, or else in the last one before with a record. So a window spans the
    pieces of a split, and another one row for each split of a file.
    """
    starts = true.select("file", "at", F.lit(True).alias("starts"))
    marked = found.select("file", "split", "inside", "at", "complete").join(starts.hint("merge"), ["file", "at"], "left")
    marked = cut(marked.withColumn("start", F.when(F.col("starts"), F.struct("at", "complete"))), "warc-marked")
    lasts = marked.groupBy("file", "split").agg(F.max("start").alias("last"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select("file", "split", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    upto = Window.partitionBy("file", "split").orderBy("at")
    inside = marked.withColumn("own", F.last("start", ignorenulls=True).over(upto))
    owned = inside.join(cut(before, "warc-before"), ["file", "split"]).withColumn("owner", F.coalesce("own", "before"))
    return owned.where("not owner.complete").select("file", "split", "inside", "at", F.col("owner.at").alias("record"))


def _broken(spark: SparkSession, path: str, owned: DataFrame) -> DataFrame:
    """Records that the magic splits: put together, and described as a whole."""

    def place(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for _, places in _inside(batches):
            yield pa.array(places, pa.int64())

    # numbered before any join, which may change the order of a split's rows
    again = _raw(spark, path).withColumn("inside", F.arrow_udf(place, "long")("file", "split", "data"))
    texts = again.join(owned, ["file", "split", "inside"]).groupBy("file", "record")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "data"))), lambda x: x["data"])

    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([MAGIC.encode().join(x) for x in batch.to_pylist()], pa.binary())

    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_described(x.as_py()) for x in batch], _KIND)

    joined = texts.agg(listed.alias("parts")).select(F.arrow_udf(join, "binary")("parts").alias("data"))
    said = joined.select(F.arrow_udf(describe, PIECE)("data").alias("d")).select("d.*")
    return said.where("complete").select("page", "kind", "refers", "said", "bytes", "digest")


def round_trip(pages: DataFrame, compression: str = "gzip") -> DataFrame:
    """Writes a record per page and reads the archives back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, compression)
    return read_archives(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
