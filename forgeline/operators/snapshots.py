"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.session import sap_key, sequence_uploads, stripped, text


def canonical_text(c) -> Column:
    """Letter case and the amount of blanks do not count."""
    return F.btrim(F.regexp_replace(F.upper(text(c)), r"[\s ]+", " "))


def snapshot_changes(rows: DataFrame, stream: str, seq: str, keys: list[str], compare: list[Column]) -> DataFrame:
    """Full outer join of every snapshot with the one before it on the primary key.

    ``rows`` holds all snapshots: ``stream`` names the delivering system, ``seq`` numbers its snapshots from 1.
    A record that stands several times in a snapshot counts once; its canonical row hash is then the pair of
    the least and the greatest hash of its rows, so any differing row shows. Missing sides give additions and
    removals, unequal hashes changes. Nulls in keys equal empty text. The first snapshot of a stream has no
    rows in the result, and the last is not compared with anything after it. Empty input gives an empty result.

    The pre-aggregation combines on the map side, so repeated rows of a hot key never meet in one task; the
    join key holds the snapshot number and the whole primary key and is thus unique on both sides.
    """
    row_hash = F.xxhash64(*compare)
    recs = (
        rows.select(F.col(stream).alias("__stream"), F.col(seq).cast("int").alias("__seq"), *[text(k).alias(f"__k{i}") for i, k in enumerate(keys)], row_hash.alias("__h"))
        .groupBy("__stream", "__seq", *[f"__k{i}" for i in range(len(keys))])
        .agg(F.min("__h").alias("__lo"), F.max("__h").alias("__hi"))
    )
    on = ["__stream", "__seq", *[f"__k{i}" for i in range(len(keys))]]
    old = recs.withColumn("__seq", F.col("__seq") + 1).withColumnsRenamed({"__lo": "__plo", "__hi": "__phi"})
    kind = F.when(F.col("__plo").isNull(), "added").when(F.col("__lo").isNull(), "removed").when((F.col("__lo") != F.col("__plo")) | (F.col("__hi") != F.col("__phi")), "changed")
    return (
        old.join(recs, on, "full_outer")
        .where("__seq > 1")
        .select(F.col("__stream").alias(stream), F.col("__seq").alias(seq), *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], kind.alias("change_kind"))
        .where("change_kind is not null")
    )


def material_changes(materials: DataFrame, uploads: DataFrame) -> DataFrame:
    """upload_id, sap_no, plant, change_kind over all uploads of all source systems.

    Rows without a sap_no or of an unknown upload take no part. A snapshot that exists as an upload but holds
    no rows removes everything.
    """
    ups = sequence_uploads(uploads)
    rows = (
        materials.select("upload_id", sap_key().alias("sap_no"), stripped("plant").alias("plant"), canonical_text("short_description").alias("canon"))
        .where("sap_no <> ''")
        .join(ups.select("upload_id", "source_system", "seq"), "upload_id")
    )
    changes = snapshot_changes(rows, "source_system", "seq", ["sap_no", "plant"], [F.col("canon")])
    # the join drops what the last snapshot would lose to a snapshot that does not exist
    return changes.join(ups.select("source_system", "seq", "upload_id"), ["source_system", "seq"]).select("upload_id", "sap_no", "plant", "change_kind")
