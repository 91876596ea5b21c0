"""Best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeline.session import sap_key, sequence_uploads, stripped


def best_records(df: DataFrame, keys: list[str], order: list[tuple[str, str]], keep: list[str], fill: list[str], min_rows: int = 1) -> DataFrame:
    """One surviving row per ``keys``: window ordering picks it, and each ``fill`` field that is empty in it
    comes from the next row in the same order that has one (empty text if none has).

    ``order``: (column, "asc" or "desc") pairs, nulls last in both directions; the last pair should be unique,
    else ties between rows that are equal in all pairs are broken by the kept and filled values. Groups of fewer
    than ``min_rows`` rows give nothing. Null keys form a group of their own; an empty table gives none.

    A group may hold a third of all rows. The first window is partitioned by the group and by which fill fields
    are filled, and only its first ``min_rows`` rows stay, so Spark limits each group before the shuffle
    (WindowGroupLimit) and a map task sends at most 2^len(fill) * min_rows rows of any group.
    """
    filled = [F.col(f).isNotNull() & (F.col(f) != "") for f in fill]
    mask = F.concat(*[F.when(x, "1").otherwise("0") for x in filled]) if fill else F.lit("")

    def by(extra: list[str]) -> list[Column]:
        return [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, d in order] + [F.col(c).asc_nulls_last() for c in extra]

    rest = [c for c in dict.fromkeys([*keep, *fill]) if c not in {c for c, _ in order}]
    cols = list(dict.fromkeys([*keys, *[c for c, _ in order], *rest]))
    few = (
        df.select(*cols)
        .withColumn("__mask", mask)
        .withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "__mask").orderBy(*by(rest))))
        .where(F.col("__rn") <= max(1, min_rows))
    )
    ranked = W.partitionBy(*keys).orderBy(*by(rest))
    whole = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        few.withColumn("__pos", F.row_number().over(ranked))
        .withColumn("__n", F.count(F.lit(1)).over(whole))
        .withColumns({f"__fill_{f}": F.first(F.when(x, F.col(f)), ignorenulls=True).over(whole) for f, x in zip(fill, filled)})
        .where((F.col("__pos") == 1) & (F.col("__n") >= min_rows))
        .select(*keys, *[c for c in keep if c not in keys], *[F.coalesce(F.col(f"__fill_{f}"), F.lit("")).alias(f) for f in fill])
    )


def status_rank(c="status") -> Column:
    """0 accepted, 1 change requests, 2 anything else, 3 blocked, 4 inactive."""
    s = F.upper(stripped(c))
    return (
        F.when(s.contains("DELETED") | s.contains("RFD STAGED") | s.contains("RFUD STAGED"), 4)
        .when(s.contains("BLOCKED"), 3)
        .when(s == "B2-ERP ACCEPTED", 0)
        .when(s.startswith("C2-RFC"), 1)
        .otherwise(2)
    )


def surviving_materials(materials: DataFrame, uploads: DataFrame, min_rows: int = 2) -> DataFrame:
    """sap_no, id, plant: the survivor of each material with ``min_rows`` or more rows in the current uploads.

    Rows without a sap_no take no part; a null updated_at is the oldest; blank plants are filled from the group.
    """
    current = sequence_uploads(uploads).where("is_current").select("upload_id")
    rows = (
        materials.select("upload_id", sap_key().alias("sap_no"), "id", stripped("plant").alias("plant"), status_rank().alias("__rank"), F.col("updated_at").alias("__at"))
        .where("sap_no <> ''")
        .join(current, "upload_id")
    )
    return best_records(rows, ["sap_no"], [("__rank", "asc"), ("__at", "desc"), ("id", "asc")], ["id"], ["plant"], min_rows)
