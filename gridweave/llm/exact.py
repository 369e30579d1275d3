"""Operator 7: exact dedup by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, ascii_lower, id_text, learn, rows_of, text_digest, written

DIGESTS = ["text_sha256", "h2"]


def exact_groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """Groups of documents with equal text (A-Z lower-cased; null counts as empty).

    Three stages, each comparing full contents: every map task combines the rows it
    holds (partial aggregation keyed by digest, content and salt), the salted groups
    are merged, then the salts' winners globally.  Digests are counted first, and
    only those of more than one in ``HOT_KEYS`` rows (so fewer than ``HOT_KEYS``
    digests) are salted: other contents cross the network once, those a second
    time, as at most ``salts`` rows each.  Members then learn the winner by their
    digests (``learn``), which is exact since the last stage fails if one pair of
    digests (SHA-256 and XXH64) ever stood for two contents.

    Returns one row per input row: ``doc_id``, ``keep_id`` (largest ``doc_id``
    of the group), ``group_size``, ``kept``, ``text_sha256``.  Null ids come before all
    others: ``keep_id`` is null only where a group has no other, and all its rows are
    ``kept``.  Repeated rows with one ``doc_id`` count separately in ``group_size`` and
    are all ``kept`` when that id wins.  An empty table gives no rows; other columns
    are ignored.
    """
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = id_text(docs).select("doc_id", norm.alias("norm"))
    rows = rows.select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").alias("h2"))
    members = written(rows.select("doc_id", *DIGESTS))
    total = members.count()
    # fewer than HOT_KEYS rows, whatever the input
    hot = members.groupBy(*DIGESTS).count().where(F.col("count") > max(1, total) / HOT_KEYS).select(*DIGESTS, F.lit(True).alias("hot"))

    salted = (
        rows.join(F.broadcast(hot), DIGESTS, "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(-1).cast("long")))
        .groupBy(*DIGESTS, "norm", "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    )
    # of a digest without salt this is the only content; of a salted one, the salts' contents are compared
    content = F.when(F.col("salt") >= 0, F.col("norm"))
    winners = salted.select(*DIGESTS, content.alias("norm"), "keep_id", F.col("n").alias("part"))
    clash = (F.min("norm") != F.max("norm")) | (F.count("norm") == 0) & (F.count("*") > 1)
    groups = winners.groupBy(*DIGESTS).agg(
        F.max("keep_id").alias("keep_id"),
        F.sum("part").alias("n"),
        F.when(F.coalesce(clash, F.lit(False)), F.raise_error(F.lit("two contents share both digests"))).cast("string").alias("clash"),
    )
    groups = written(groups.where("clash IS NULL").select(*DIGESTS, "keep_id", "n", F.col("n").alias("group_size")))
    out = learn(members, groups, DIGESTS, total)
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; one row per group.

    Rows are told by ``doc_id`` (null where a group has no other) and digest, so
    different texts under one ``doc_id`` each stay.
    """
    keep = exact_groups(docs, salts).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return rows_of(docs, keep, text_digest(ascii_lower(docs["text"].cast("string"))), once=True)


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
