"""Exact deduplication by content-defined chunk recipes, in DataFrame functions alone.

A text is cut where its own content says so, hence equal texts have equal chunks. A recipe is the ordered list of a
text's chunks as 64-bit digests with the SHA-256 that verifies each. Recipes that occur once are done. For the rest,
chunks are deduplicated to verified identifiers (the 64-bit digest, and a rank where different chunks share one) and
documents are equal exactly if their ordered identifier lists are. No text passes through a shuffle: a long document
moves as 40 bytes a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, light, numbered, text_of

#: A chunk ends after one of these word ends, LEAST characters at the earliest and MOST at the latest.
LEAST, MOST = 512, 4096
_CUT = rf"[\s\S]{{{LEAST},{MOST - 3}}}?(?:[aeiou][nrt] (?=[a-mA-M])|\z)|[\s\S]{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    """Every run of ``[\\x20\\x09-\\x0D]`` as one space; a single space needs no replacing."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def chunks(text: Column) -> Column:
    """The text's content-defined chunks in order, which joined give the text again; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(_CUT), F.lit(0))


def exact_rows(docs: DataFrame, row: Column, text: str = "text", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """As :func:`exact_groups`, and ``row``: a number that is each row's own."""
    body = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised(text_of(text)).alias("body"))
    rows = durable(
        body.select(
            "row",
            "doc_id",
            F.transform(
                chunks(F.col("body")), lambda c: F.struct(digest(c).alias("digest"), F.unhex(F.sha2(c, 256)).alias("sha"))
            ).alias("recipe"),
            F.sha2("body", 256).alias("text_sha256"),
        ).withColumn("key", F.xxhash64("recipe.digest"))
    )
    again = rows.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("again"))
    marked = durable(rows.join(again, "key", "left").drop("key"))
    candidates = marked.where("again").select("row", "doc_id", "recipe", "text_sha256")
    occurrences = candidates.select("row", F.posexplode("recipe").alias("pos", "chunk")).select("row", "pos", "chunk.*")
    # Verified identifiers: rank 1 unless different chunks share a digest, which the registry then tells apart.
    registry = occurrences.select("digest", "sha").distinct()
    shared = registry.groupBy("digest").count().where("count > 1").select("digest")
    ranked = registry.join(shared, "digest", "left_semi").select(
        "digest", "sha", F.row_number().over(W.partitionBy("digest").orderBy("sha")).alias("rank")
    )
    lists = (
        occurrences.join(ranked, ["digest", "sha"], "left")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", F.coalesce("rank", F.lit(1)).alias("rank")))).alias("ids"))
        .select("row", F.transform("ids", lambda x: F.struct(x["digest"], x["rank"])).alias("ids"))
    )
    listed = durable(
        candidates.select("row", "doc_id", "text_sha256")
        .join(lists, "row", "left")
        .withColumn("ids", F.coalesce("ids", F.array().cast("array<struct<digest:bigint,rank:int>>")))
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    groups = listed.groupBy("ids").agg(first, F.count("*").alias("group_size"))
    columns = ["row", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    together = listed.join(groups, "ids").select(
        "row", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )
    alone = marked.where(F.col("again").isNull()).select(
        "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return alone.unionByName(together).select(columns)


def exact_groups(docs: DataFrame, text: str = "text", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are equal. The smallest doc_id stays, a null one only where there is no
    other; of rows repeated under that doc_id one is kept. ``digest`` may be weak (chunks sharing a value are told
    apart). Other columns are ignored; an empty table gives no rows.
    """
    return exact_rows(docs, F.monotonically_increasing_id(), text, digest).drop("row")


def drop_exact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; of nulls, empty texts and repeats the same holds.

    ``docs`` is written once with its rows numbered. Every column stays, whatever its name; an empty table stays empty.
    """
    rows, row = numbered(docs)
    dropped = exact_rows(rows, F.col(row), text).where(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(light(dropped), row, "left_anti").drop(row)
