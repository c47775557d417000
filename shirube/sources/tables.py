"""SRC-1..5: page, line, file, bundle and store tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..catalog import WORKSPACE_TYPES
from ..functions.nested import first_fault
from ..functions.text import page_mode


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-1: one row per page; a missing mode is decided from the text."""
    pages = _read(spark, path, schemas.PAGES, fmt)
    return pages.withColumn("mode", F.coalesce("mode", page_mode(F.col("text"))))


def read_lines(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-2: lines with strike flags; lines without flags are not struck."""
    lines = _read(spark, path, schemas.LINES, fmt)
    return lines.withColumn("flags", F.coalesce("flags", F.array_repeat(F.lit(False), F.length("text"))))


def land_files(spark: SparkSession, path: str, max_bytes: int = 50 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """SRC-3: raw files with content hash; refused ones come back with a reason."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name")
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = (F.col("length") > 0) & (F.col("length") <= max_bytes)
    # the reader checks the length before it opens a file, so the content of one that is too large is never read
    hashed = files().filter(fits).select(name, F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"), F.substring("content", 1, 5).alias("_head"))
    reason = (F.when(F.length("name") > 200, "name too long").when(~F.lower("name").endswith(".pdf"), "not a pdf name").when(F.col("_head") != F.lit(b"%PDF-"), "not a pdf"))
    tagged = hashed.withColumn("reason", reason).drop("_head")
    outside = files().filter(~fits).select(name, F.lit(None).cast("string").alias("file_hash"), F.col("length").alias("size"))
    named = F.when(F.length("name") > 200, "name too long").when(~F.lower("name").endswith(".pdf"), "not a pdf name").otherwise("size")
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null").unionByName(outside.withColumn("reason", named))


def read_bundles(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """SRC-4: JSON bundles against a closed schema: no key missing or extra at any depth, no wrong type, only finite numbers.

    Rejects: value, reason, path (the first place that does not fit; null where the text is no JSON).
    """
    corrupt = "_corrupt"
    lines = spark.read.schema("value string").text(path)
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = lines.withColumn("doc", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    keys, expected = F.json_object_keys("value"), F.array(*[F.lit(f.name) for f in schema.fields])
    wrong_keys = keys.isNull() | (F.size(F.array_except(keys, expected)) > 0) | (F.size(F.array_except(expected, keys)) > 0)
    numbers = [F.col(f"doc.{f.name}") for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    infinite = F.lit(False)
    for n in numbers:
        infinite = infinite | F.coalesce(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(False))
    reason = F.when(F.col(f"doc.{corrupt}").isNotNull() | F.col("doc").isNull(), "type").when(wrong_keys, "keys").when(infinite, "not finite")
    # the parse above is what is returned; the tree below tells where a bundle is wrong, and finds what the parse lets pass
    parsed = parsed.withColumn("_tree", F.try_parse_json("value"))
    parsed = parsed.withColumn("_fault", F.when(F.col("_tree").isNotNull(), first_fault(F.col("_tree"), schema)))
    tagged = parsed.withColumn("reason", F.coalesce("_fault.reason", reason)).withColumn("path", F.col("_fault.path"))
    return tagged.filter("reason is null").select(*[F.col(f"doc.{f.name}").alias(f.name) for f in schema.fields]), tagged.filter("reason is not null").select("value", "reason", "path")


def read_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: _read(spark, f"{root}/{name}", schema, "parquet") for name, schema in schemas.STORE.items()}


def snapshot(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """SRC-5: the workspace: masters in full, documents and what hangs on them for four document types."""
    docs = store["documents"].filter(F.col("document_type").isin(*WORKSPACE_TYPES))
    versions = store["versions"].join(docs.select("document_id"), "document_id", "left_semi").drop("storage_path")
    return {
        "cases": store["cases"], "units": store["units"], "buildings": store["buildings"], "imports": store["imports"],
        "documents": docs, "versions": versions,
        "values": store["values"].join(versions.select("document_version_id"), "document_version_id", "left_semi"),
        "diffs": store["diffs"].join(docs.select("document_id"), "document_id", "left_semi"),
    }


def explode_fields(versions: DataFrame, item_schema: str) -> DataFrame:
    """PRJ-7: a version's JSON object of fields to one row per field."""
    parsed = F.from_json("raw_json", f"struct<fields:map<string,struct<{item_schema}>>>")
    return versions.select("document_version_id", F.explode(parsed["fields"]).alias("field_code", "_item")).select("document_version_id", "field_code", "_item.*")


def validate_imports(imports: DataFrame, source_types: tuple[str, ...] = ("seller_provided", "company_obtained"),
                     statuses: tuple[str, ...] = ("provisional", "confirmed")) -> tuple[DataFrame, DataFrame]:
    """FLT-3: hashes, domains and document counts of incoming imports; refused ones carry the reason."""
    hexa = lambda c: F.coalesce(F.col(c).rlike("^[a-f0-9]{64}$"), F.lit(False))
    reason = (F.when(~hexa("file_hash") | ~hexa("import_key"), "Invalid import identity").when(F.col("raw_json").isNull(), "Invalid import identity")
              .when(~F.coalesce(F.col("source_type").isin(*source_types) & F.col("status").isin(*statuses), F.lit(False)), "Invalid status")
              .when(~F.coalesce(F.col("documents").between(1, 12), F.lit(False)), "Invalid registration"))
    tagged = imports.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def tag_sources(fields: DataFrame, files: DataFrame) -> DataFrame:
    """PRJ-10: file name and hash on every source of a document. ``files``: file_hash, original_filename."""
    joined = fields.join(files.select("file_hash", F.col("original_filename").alias("_name")), "file_hash", "left")
    return joined.withColumn("sources", F.transform("sources", lambda s: F.struct(
        s["page"].alias("page"), s["text"].alias("text"), F.col("_name").alias("source_pdf"), F.col("file_hash").alias("file_hash")))).drop("_name")
