"""Exact dedup by skew-safe combining: local, salted and global groups of equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import SPACE, whole

SALTS = 8

SQL = """
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents
), g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, g.keep_id is null) as kept,
       sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS, bits: int = 256) -> DataFrame:
    """One row per input row: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after each run of white space became one
    space; null counts as empty. Of equal texts the smallest key stays.

    Three stages, each grouped on digest *and* whole text, so that a digest
    never decides alone: map-side combining in the scan's tasks, one group per
    (digest, salt), one group per digest over the salts' winners. A group of
    any size reaches the last stage as at most ``salts`` rows; members find
    their class again by (digest, salt), so a hot class is read by ``salts``
    tasks. Two different texts under one digest stop the job.

    A null key never wins against another; a class of null keys only has
    ``keep_id`` null and all its rows ``kept``. Rows repeated with the same
    key are all ``kept`` (``first_of_each`` leaves one). Other columns are ignored.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.regexp_replace(whole(text), SPACE, " ").alias("norm")
    ).select(
        "key", "norm", F.sha2("norm", bits).alias("digest"),
        F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("digest", "norm", "salt").agg(F.min("key").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )
    classes = merged.select("digest", "keep_id", "group_size", F.explode("salts").alias("salt"))
    single = classes.groupBy("digest", "salt").agg(
        F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    return (
        rows.select("key", "digest", "salt")
        .join(single, ["digest", "salt"])
        .select(
            F.col("key").alias(key), "keep_id",
            F.when(F.col("texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two texts share a digest"))).alias("group_size"),
            F.coalesce(F.col("key") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The input rows that stay, with all their columns: one per class of equal texts, that of the smallest key.

    The same three stages; the winner's other columns travel with its text, so
    nothing is joined back. A null key only wins where all keys are null; of
    rows that share the key the hash of the raw text decides, and of rows that
    share key and text one stays.
    """
    norm = F.regexp_replace(whole(text), SPACE, " ")
    same = F.col(text).eqNullSafe(F.col("__norm"))
    rows = (
        docs.withColumn("__norm", norm)
        .select(
            "__norm", F.sha2("__norm", 256).alias("__digest"),
            F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("__salt"),
            F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(text)).alias("__order"),
            # The text itself only where normalising changed it.
            F.struct(
                *[F.col(f"`{c}`") for c in docs.columns if c != text], same.alias("__same"), F.when(~same, F.col(text)).alias("__raw")
            ).alias("__row"),
        )
    )
    best = F.min_by("__row", "__order").alias("__row")
    salted = rows.groupBy("__digest", "__norm", "__salt").agg(best, F.min("__order").alias("__order"))
    merged = salted.groupBy("__digest", "__norm").agg(best)
    own = F.when(F.col("__row.__same"), F.col("__norm")).otherwise(F.col("__row.__raw"))
    return merged.select(*[own.alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
