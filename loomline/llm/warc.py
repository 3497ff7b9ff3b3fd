"""WARC archives: records written by Spark's text writer, read back in splits by boundary-chain verification.

A record's bytes are its header, an empty line, the payload and an empty line; the text writer ends each record with the
last of these, so the files are plain uncompressed WARC. The reader lets Spark split files at any place: each task emits
a candidate for every record magic that it meets, with the offset at which the record would end if it were one. From the
file's start, pointer jumping along these offsets keeps only candidates that the chain reaches; magic inside a payload
is never the successor of a record and falls out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.shared import written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Most records of one file; bounds the candidate offsets (16 bytes each) that one task follows.
RECORDS_PER_FILE = 20_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, as the 160 bits' 32 groups of five."""
    digits = F.sha1(payload)
    letters = []
    for i in range(32):
        five = F.conv(F.substring(digits, 5 * (i // 4) + 1, 5), 16, 10).cast("int")
        letters.append(F.substring(F.lit(BASE32), F.shiftright(five, 15 - 5 * (i % 4)).bitwiseAND(31) + 1, 1))
    return F.concat(*letters)


def with_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to: which page's record each page revisits.

    Of pages with equal payloads of at least min_revisit_bytes, the one with the largest page_id has the response, the
    others refer to it; a null html is the empty payload. A page without an id never has others refer to it, unless all
    its copies lack one; then each of them is a response, as is each row that repeats the largest id.
    """
    html = F.coalesce(F.col("html"), F.lit("")).alias("html")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html)
    own = own.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html").cast("binary"))})
    chosen = own.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # As a table its size is known: while it is small, the pages themselves need no shuffle.
    repeated = written(chosen.where("n > 1").select("payload_digest", "payload_bytes", "first"), "warc-repeated")
    return own.join(repeated, ["payload_digest", "payload_bytes"], "left").withColumn(
        "refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    ).drop("first")


def clean(value: Column) -> Column:
    """A header's value in one line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1f\x7f]+", " ")


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> str:
    """Writes one record for each row of pages (page_id, url, html) under path and returns path.

    A response holds the html in UTF-8. A revisit has no payload: it names the page that has, and the full payload's
    digest and length. Files are compressed whole, or plain with compression "none", and then Spark reads large ones in
    splits. Other columns are ignored; an empty table gives a folder without records.
    """
    rows = with_records(pages, min_revisit_bytes)
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", clean(F.col("url")))).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path, compression=compression)
    return path


def header(chunk: Column, name: str) -> Column:
    """The value of a header field of the record that begins with the chunk, null where it has none."""
    head = F.substring_index(chunk, END, 1)
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head, F.lit("\r\n")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def payload(text: Column) -> Column:
    """What stands between a record's header and its end."""
    start = F.instr(text, END) + len(END)
    return F.when(F.instr(text, END) > 0, F.substring(text, start, F.greatest(F.length(text) - start - len(END) + 1, F.lit(0)))).otherwise("")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every record magic in the files under path: its file and offset (at), what follows it up to the next (chunk), the
    header's fields, next (where the record would end), and the size and digest of its payload if that ends in the chunk.

    Spark's reader splits files anywhere and cuts at the magic, so chunks lie back to back, and a chunk's offset is the
    sum of the sizes before it: within its split, and by splits within its file. Fields are taken in the scan, so that
    chunks move only where a query needs payloads.
    """
    chunk = F.col("value")
    page = lambda field: F.expr("try_cast(nullif(" + field + ", '') AS bigint)")
    read = spark.read.option("lineSep", MAGIC).text(path)
    scan = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("nth"),
        (F.octet_length(chunk) + len(MAGIC)).cast("long").alias("size"),
        F.when(F.instr(chunk, END) > 0, F.octet_length(F.substring_index(chunk, END, 1)) + len(END)).alias("start"),
        header(chunk, "Content-Length").alias("length"),
        F.regexp_extract(header(chunk, "WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).alias("own"),
        F.regexp_extract(header(chunk, "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).alias("other"),
        header(chunk, "WARC-Target-URI").alias("url"),
        header(chunk, "WARC-Type").alias("record_type"),
        F.substring_index(header(chunk, "WARC-Payload-Digest"), ":", -1).alias("full_digest"),
        header(chunk, "X-Payload-Length").alias("full_bytes"),
        F.octet_length(payload(chunk)).cast("long").alias("own_bytes"),
        base32_sha1(payload(chunk).cast("binary")).alias("own_digest"),
        chunk.alias("chunk"),
    )
    within = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    splits = scan.groupBy("file", "split").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("split_start"))
    placed = scan.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["file", "split"])
    # The first chunk of a file stands before its first magic; the others begin right after one.
    found = placed.withColumn("at", F.col("split_start") + F.col("inside") - len(MAGIC)).where("at >= 0")
    end = F.col("at") + len(MAGIC) + F.col("start") + F.expr("try_cast(length AS bigint)") + len(END)
    return found.select(
        "file", "at", end.alias("next"), page("own").alias("page_id"), page("other").alias("refers_to"), "url", "record_type",
        "full_digest", F.expr("try_cast(full_bytes AS bigint)").alias("full_bytes"), "own_bytes", "own_digest", "chunk",
    )


def reachable(edges: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, at, next) that the chain from offset 0 of their file reaches.

    Pointer jumping: the reached set starts with offset 0 and in each round gains the targets of its pointers, while
    every pointer is replaced by its target's, so that rounds are the logarithm of a file's records. A group is one
    file's offsets, which the writer bounds; payloads aren't in it.
    """

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", kind="stable")
        at = group["at"].to_numpy()
        n = len(at)
        place = np.minimum(np.searchsorted(at, group["next"].to_numpy()), n - 1)
        jump = np.append(np.where(at[place] == group["next"].to_numpy(), place, n), n)  # n: beyond the last record
        reached = np.zeros(n + 1, bool)
        reached[:n] = at == 0
        while True:
            more = reached.copy()
            more[jump[reached]] = True
            if (more == reached).all():
                break
            reached, jump = more, jump[jump]
        return group.loc[reached[:n], ["file", "at"]]

    return edges.groupBy("file").applyInPandas(follow, "file string, at long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to: a row for each record under path.

    payload is the record's own bytes as text: the whole html of a response, nothing of a revisit. Bytes and digest of a
    response are those of the payload as read; a revisit's are those that its header gives for the full payload.
    """
    found = candidates(spark, path)
    kept = written(reachable(found.select("file", "at", "next").where("next IS NOT NULL")).withColumn("record", F.lit(True)), "warc-records")
    # A chunk that the chain doesn't reach belongs to the payload of the last record before it.
    upto = Window.partitionBy("file").orderBy("at")
    owned = found.select("file", "at").join(kept, ["file", "at"], "left")
    owned = owned.select("file", "at", F.last(F.when(F.col("record"), F.col("at")), ignorenulls=True).over(upto).alias("owner"))
    strays = written(owned.where("owner != at"), "warc-strays")
    records = found.join(kept, ["file", "at"])
    if strays.isEmpty():
        records = records.withColumn("rest", F.lit(None).cast("string"))
    else:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk"))), lambda x: F.concat(F.lit(MAGIC), x["chunk"])), "")
        rest = strays.join(found.select("file", "at", "chunk"), ["file", "at"]).groupBy("file", "owner").agg(joined.alias("rest"))
        records = records.join(rest.withColumnRenamed("owner", "at"), ["file", "at"], "left")
    whole = payload(F.when(F.col("rest").isNull(), F.col("chunk")).otherwise(F.concat("chunk", "rest")))
    joint, revisit = F.col("rest").isNotNull(), F.col("record_type") == "revisit"
    return records.select(
        "page_id",
        "url",
        whole.alias("payload"),
        F.when(revisit, F.col("full_bytes")).when(joint, F.octet_length(payload(F.concat("chunk", "rest"))).cast("long")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).when(joint, base32_sha1(payload(F.concat("chunk", "rest")).cast("binary"))).otherwise(F.col("own_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
