"""The module API: ingest, search, dashboard, stats, export and evaluation over one versioned catalog."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions.parse import ATTRIBUTES
from forgeline.functions.vocab import subtype_vocabulary
from forgeline.operators import analytics, evaluate, match, retrieve, store
from forgeline.session import ship
from forgeline.sources import export, files

MAX_UPLOAD_BYTES, MAX_LIST_BYTES = 60 << 20, 5 << 20
MAX_BATCH, MAX_EXPORT = 50, 200
VOCABULARY_SECONDS = 300


def clamp_limit(limit: int | None) -> int:
    """3 to 10, 5 without a wish."""
    return 5 if limit is None else max(3, min(10, int(limit)))


def bands(score: F.Column, strong: float, fair: float) -> F.Column:
    """strong, fair or weak: 75 and 40 for metrics, 70 and 35 for heat maps, 85 and 65 for confidence."""
    return F.when(score >= strong, "strong").when(score >= fair, "fair").otherwise("weak")


class Engine:
    """One catalog folder. ``max_bytes`` bounds an upload; larger files belong into ``sources.files`` directly."""

    def __init__(self, spark: SparkSession, root: str, max_bytes: int = MAX_UPLOAD_BYTES):
        ship(spark)
        self.spark, self.catalog, self.max_bytes = spark, store.Catalog(spark, root), max_bytes
        self._vocabulary: tuple[float, str | None, list[str]] = (0.0, None, [])

    def ingest(self, path: str) -> dict:
        """A file becomes the current version; the summary counts both the parsed and the stored rows."""
        if os.path.getsize(path) > self.max_bytes:
            raise ValueError(f"the file is larger than {self.max_bytes} bytes")
        records, columns, warnings, sheet = files.read_material_file(self.spark, path)
        rows = store.typed(records, columns).persist()
        try:
            parsed = rows.agg(F.count(F.lit(1)).alias("imported"), F.count_if("status_active").alias("active"), F.count_distinct(F.struct("corporate_no", "sap_no")).alias("unique")).first()
            stored = self.catalog.publish(rows, os.path.basename(path), sheet)
        finally:
            rows.unpersist()
        return {**stored, "imported": parsed.imported, "imported_active": parsed.active, "imported_inactive": parsed.imported - parsed.active, "imported_unique": parsed.unique, "warnings": warnings}

    def rows(self) -> DataFrame:
        """The current version in the form that retrieval reads."""
        if self.catalog.pointer() is None:
            raise LookupError("nothing was imported yet")
        r = self.catalog.with_vectors()
        late = F.lit(None).cast("timestamp").alias("updated_at")
        return r.select("id", "corporate_no", "sap_no", "plant", "class_name", "short_description", "long_description", "status", "material_type", "item_type", "status_active", "procurement_rank", late, F.col("attributes").alias("attrs"), "raw_data", "embedding")

    def vocabulary(self) -> list[str]:
        """Subtype terms of the active rows, kept for five minutes and for the version they came from."""
        made, version, terms = self._vocabulary
        now = self.catalog.pointer()["upload_id"]
        if version != now or time.time() - made > VOCABULARY_SECONDS:
            terms = subtype_vocabulary(F.concat_ws(" ", "short_description", "class_name"), self.rows().where("status_active"))
            self._vocabulary = (time.time(), now, terms)
        return terms

    def _asked(self, queries: list[str] | DataFrame) -> DataFrame:
        """A list has 1 to 50 items of 3 to 2000 characters, a DataFrame (query_id, query_text) any number."""
        if not isinstance(queries, list):
            return queries
        items = list(dict.fromkeys(q.strip() for q in queries))
        if not 1 <= len(items) <= MAX_BATCH or any(not 3 <= len(q) <= 2000 for q in items):
            raise ValueError(f"1 to {MAX_BATCH} queries of 3 to 2000 characters")
        return self.spark.createDataFrame(list(enumerate(items, 1)), "query_id long, query_text string")

    def search(self, queries: list[str] | DataFrame, limit: int | None = None, query_vectors: DataFrame | None = None, offered: DataFrame | None = None) -> DataFrame:
        """Ranked matches with their band of confidence; see ``match.search`` for vectors and offered attributes."""
        found = match.search(self._asked(queries), self.rows(), clamp_limit(limit), self.vocabulary(), query_vectors, offered)
        return found.withColumn("band", bands(F.col("confidence"), 85, 65))

    def respond(self, queries: list[str], limit: int | None = None, extract=None, embed=None) -> dict:
        """matches, semantic_mode, warnings and elapsed_ms of one request.

        ``extract`` (text -> attribute record or None) and ``embed`` (text -> vector) are outside services. Where
        one fails or is missing for a query, the rules and the words alone decide, and a warning says so.
        """
        began, warnings = time.time(), []
        asked = self._asked(queries)
        rows = [(r.query_id, r.query_text) for r in asked.collect()]  # at most MAX_BATCH

        def each(service, what: str, schema: str) -> DataFrame | None:
            got = []
            for k, t in rows:
                try:
                    if (v := service(t)) is not None:
                        got.append((k, {**dict.fromkeys(ATTRIBUTES.fieldNames()), **v} if isinstance(v, dict) else v))
                except Exception as e:
                    warnings.append(f"{what} failed for {t!r}: {e}")
            return self.spark.createDataFrame(got, schema) if got else None

        offered = each(extract, "attribute extraction", f"query_id long, attributes {ATTRIBUTES.simpleString()}") if extract else None
        vectors = each(embed, "embedding", "query_id long, query_embedding array<float>") if embed else None
        if embed and vectors is None:
            warnings.append("no query has a vector; similarity of texts stands in")
        return {"matches": self.search(asked, limit, vectors, offered), "semantic_mode": "embeddings" if vectors is not None else "lexical", "warnings": warnings, "elapsed_ms": round((time.time() - began) * 1000)}

    def backfill_attributes(self) -> int:
        """Recompute the attributes of the active rows with the vocabulary of today; how many records changed."""
        return self.catalog.backfill_attributes(self.vocabulary())

    def backfill_vectors(self, embed) -> None:
        """Vectors for the active rows without one; ``embed`` maps a list of texts to a list of vectors."""
        self.catalog.save_vectors(self.catalog.backfill_vectors(embed))

    def search_file(self, path: str, limit: int | None = None) -> DataFrame:
        if os.path.getsize(path) > MAX_LIST_BYTES:
            raise ValueError("the list is larger than 5 MB")
        return self.search(files.read_search_items(self.spark, path), limit)

    def export(self, matches: DataFrame, path: str) -> None:
        """A workbook with matches and attribute comparisons, for at most 200 queries; ``export.write_parts`` has no bound.

        Of a single query the text stands above the matches.
        """
        asked = [r.query_text for r in matches.groupBy("query_id").agg(F.first("query_text").alias("query_text")).limit(MAX_EXPORT + 1).collect()]
        if len(asked) > MAX_EXPORT:
            raise ValueError(f"more than {MAX_EXPORT} queries")
        sheets = {}
        for name, df in (("Matches", export.summary(matches)), ("Attribute comparison", export.details(matches))):
            sheets[name] = (df.columns, [tuple(r) for r in df.orderBy("Query", "Rank").collect()])
        export.workbook(sheets, path, {"Matches": ("Search query", asked[0])} if len(asked) == 1 else None)

    def profile(self) -> DataFrame:
        """The narrow profile of the current version for ``analytics``."""
        r, a = self.rows(), F.col("attrs")
        has = lambda c: F.coalesce(c != "", F.lit(False))
        flags = {
            "description": has(F.col("long_description")), "item_type": has(a["itemType"]), "subtype": has(a["subtype"]), "size": a["sizeMm"].isNotNull(),
            "pressure": has(a["pressureClass"]) | a["pressureBar"].isNotNull(), "connection": has(a["connection"]), "materials": F.coalesce(F.size(a["materials"]) > 0, F.lit(False)),
            "standards": F.coalesce(F.size(a["standards"]) > 0, F.lit(False)), "face_to_face": a["faceToFaceMm"].isNotNull(), "actuation": has(a["actuation"]),
        }
        score = sum((F.when(flags[k], v).otherwise(0) for k, v in analytics.READINESS.items()), F.lit(0))
        created = F.coalesce(*[F.col("raw_data")[h] for h in analytics.DATE_HEADERS])
        return r.select("corporate_no", "sap_no", "plant", "class_name", "material_type", "status", F.col("status_active").alias("active"), F.col("embedding").isNotNull().alias("embedded"), "long_description", created.alias("created"), *[v.alias(k) for k, v in flags.items()], score.alias("readiness"))

    def dashboard(self) -> dict:
        p = self.catalog.pointer()
        record = {k: p[k] for k in ("file_name", "sheet_name", "row_count", "active_count", "created_at")}
        return {**analytics.parts(self.profile()), "upload": record}

    def stats(self) -> dict:
        p = self.catalog.pointer()
        return {"total": p["row_count"], "active": p["active_count"], "last_upload": p["created_at"], "uploads": 1, "file_name": p["file_name"], "sheet_name": p["sheet_name"]} if p else {"total": 0, "active": 0, "uploads": 0, "last_upload": None}

    def evaluate(self, n: int = 60, report: str | None = None) -> dict:
        """Recall and mean reciprocal rank; ``report`` names a text file to write them to."""
        base = self.rows()
        found = evaluate.recall(evaluate.paraphrased(base, n), base).first().asDict()
        if report:
            with open(report, "w") as f:
                f.writelines(f"{k}: {v}\n" for k, v in found.items())
        return found
