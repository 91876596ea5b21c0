"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that count as outer blanks of a key or a status.
BLANKS = " \t\r\n "


def get_session(app: str = "forgeline", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; settings that exist are kept."""
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per context; Spark serves the archive from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_forgeline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="forgeline-"), "forgeline_package")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
    sc._forgeline_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only where neither that setting nor a folder set
    through the context exists (tests in local mode) a local folder is used.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not shared:
            shared = tempfile.mkdtemp(prefix="forgeline-checkpoints-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def small(spark: SparkSession, rows: list[tuple], schema, most: int = 8 << 20) -> DataFrame:
    """Rows of the driver as a DataFrame, with a broadcast hint if their size, counted here, is at most ``most`` bytes.

    Spark knows no size of rows that come from Python, and would shuffle the other side of a join with them.
    """
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if sum(len(repr(tuple(r))) for r in rows) <= most else df


def text(c) -> F.Column:
    """Null equals empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def stripped(c) -> F.Column:
    return F.btrim(text(c), F.lit(BLANKS))


def sap_key(c="sap_no") -> F.Column:
    """Upper case, no outer blanks, no leading zeros; empty where there is no number."""
    return F.ltrim(F.upper(stripped(c)), F.lit("0"))


def sequence_uploads(uploads: DataFrame) -> DataFrame:
    """upload_id, source_system, seq (1 = oldest), is_current; the table has one row per delivered file.

    Uploads of one source system are ordered by created_at, then id. Uploads without an id or a source system
    take no part.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("source_system").orderBy(F.col("created_at").asc_nulls_first(), "upload_id")
    back = W.partitionBy("source_system").orderBy(F.col("created_at").desc_nulls_last(), F.col("upload_id").desc())
    return (
        uploads.select(F.col("id").alias("upload_id"), F.upper(stripped("source_system")).alias("source_system"), "created_at")
        .where("upload_id is not null and source_system <> ''")
        .dropDuplicates(["upload_id"])
        .select("upload_id", "source_system", F.row_number().over(w).alias("seq"), (F.row_number().over(back) == 1).alias("is_current"))
    )
