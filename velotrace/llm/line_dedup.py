"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of `span` consecutive lines ends a chunk where it is divisible by `divisor`, so that
boundaries depend on nearby lines alone and stand again soon after an insertion. Chunks of two lines or more that
occur again anywhere, byte by byte, are removed except where they occur first (smallest id, then place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Lines under the rolling hash; a chunk has about `DIVISOR` lines.
SPAN, DIVISOR = 2, 3
#: Lines that a chunk has at least if it is to be removed.
LEAST = 2
#: Parts into which a frequent chunk's occurrences are dealt before they are pre-aggregated.
SALTS = 8


def _chunks(text: Column, span: int, divisor: int) -> Column:
    """array<struct<k, n, text>>: the chunks of a text, each with its number, its lines and its bytes."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))

    def cut(lines_hashes: Column) -> Column:
        x, h = lines_hashes["x"], lines_hashes["h"]
        rolled = lambda i: sum((F.coalesce(F.get(h, i - j), F.lit(0)) * 31**j for j in range(span)), F.lit(0))
        last = F.size(x) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.pmod(rolled(i), F.lit(divisor)) == 0) | (i == last))
        starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda i: i + 1))
        return F.transform(
            F.arrays_zip(F.sequence(F.lit(0), F.size(ends) - 1).alias("k"), ends.alias("stop"), F.slice(starts, 1, F.size(ends)).alias("start")),
            lambda c: F.struct(c["k"].alias("k"), (c["stop"] - c["start"] + 1).alias("n"), F.array_join(F.slice(x, c["start"] + 1, c["stop"] - c["start"] + 1), "\n").alias("text")),
        )

    return F.transform(F.array(F.struct(lines.alias("x"), hashes.alias("h"))), cut)[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """(row, chunks, cut): each row of docs as a struct with its chunks and the numbers of those to remove.

    Only hashes of chunks are counted at first; bytes travel for chunks whose hash recurs, and are then compared
    whole. Each exchange is pre-aggregated or can be split where a chunk is very frequent. Rows equal in id and text
    are one document and come out alike; very long texts are chunked whole; a null text has no lines to remove and stays null; blank chunks (no
    character but white space) are never removed; a null id comes first; ties are broken by the text's hash and the
    chunk's number; an empty table gives no rows; all columns of docs stay inside `row`, whatever their names.
    """
    text = C.col(docs, text_col).cast("string")
    each = docs.select(C.col(docs, id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    each = each.select("id", "t", F.explode(_chunks(F.col("text"), span, divisor)).alias("c")).where((F.col("c.n") >= least) & (F.trim(F.regexp_replace("c.text", r"\s+", "")) != ""))
    each = each.select("id", "t", F.col("c.k").alias("k"), F.xxhash64("c.text").alias("h"), F.col("c.text").alias("bytes"))
    again = each.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h")
    # Dealt by hash and salt, so that the exchange by bytes below has a partial aggregation in front of it.
    each = each.withColumn("salt", F.pmod(F.xxhash64("id", "t", "k"), F.lit(SALTS)))
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = C.materialize(each.join(again, ["h", "salt"], "left_semi").drop("salt"), "chunks")
    first = found.groupBy("h", "bytes").agg(F.min(F.struct("id", "t", "k")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    # Written out, so that the join below has plain exchanges on both sides and a frequent chunk's can be split.
    first = C.materialize(first, "chunks")
    cut = found.join(first, ["h", "bytes"]).where(~F.struct("id", "t", "k").eqNullSafe(F.col("first"))).groupBy("id", "t").agg(F.collect_set("k").alias("cut"))
    cut = cut.select(F.col("id").alias("cut_id"), F.col("t").alias("cut_t"), "cut")
    source = docs.select(F.struct(*[C.col(docs, c) for c in docs.columns]).alias("row"), C.col(docs, id_col).alias("id"), F.xxhash64(text).alias("t"))
    joined = source.join(cut, source.id.eqNullSafe(cut.cut_id) & (source.t == cut.cut_t), "left")
    return joined.select("row", _chunks(F.col("row")[text_col].cast("string"), span, divisor).alias("chunks"), F.coalesce("cut", F.array().cast("array<int>")).alias("cut"))


def picked(chunks: Column, places: Column, of: str) -> Column:
    """A field of the chunks at the given places. Both arrays are bound first, so that names in the lambda mean no other columns."""
    both = F.array(F.struct(chunks.alias("c"), places.alias("p")))
    return F.transform(both, lambda b: F.transform(b["p"], lambda k: F.get(b["c"], k)[of]))[0]


def kept_text(text: Column, chunks: Column, cut: Column) -> Column:
    """The text without the chunks to remove; null stays null."""
    kept = F.array_except(F.transform(chunks, lambda c: c["k"]), cut)  # by hashing, in order; a chunk's number is its place
    return F.when(F.size(cut) == 0, text).otherwise(F.array_join(picked(chunks, kept, "text"), "\n"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lines = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda n, c: n + c)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.when(F.col("row.text").isNull(), F.lit(0).cast("long")).otherwise(lines(F.col("chunks.n"))).alias("n_lines"),
        F.size("cut").cast("long").alias("n_chunks_removed"),
        lines(picked(F.col("chunks"), F.col("cut"), "n")).alias("n_lines_removed"),
        F.sha2(F.coalesce(kept_text(F.col("row.text"), F.col("chunks"), F.col("cut")), F.lit("")), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH doc AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
line AS (SELECT doc_id, i, x[i] AS line, CAST('0x' || substr(md5(x[i]), 1, 8) AS BIGINT) AS h, len(x) AS n FROM doc, unnest(generate_series(1, len(x))) AS u(i)),
mark AS (SELECT doc_id, i, line, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 3 = 0 OR i = n AS closes FROM line),
part AS (SELECT doc_id, i, line, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM mark),
chunk AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes FROM part GROUP BY doc_id, k),
ranked AS (SELECT *, n >= 2 AND regexp_matches(bytes, '\S') AND row_number() OVER (PARTITION BY bytes ORDER BY doc_id, k) > 1 AS gone FROM chunk)
SELECT doc_id, CAST(CASE WHEN any_value(doc.text) IS NULL THEN 0 ELSE sum(n) END AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_chunks_removed,
  CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_lines_removed, sha256(coalesce(string_agg(bytes, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM ranked JOIN doc USING (doc_id) GROUP BY doc_id
"""
