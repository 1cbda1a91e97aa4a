"""Reading files and classifying uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from .folders import read_folder

MB = 1024 * 1024


def classify_uploads(df: DataFrame, max_image_mb: int = fv.MAX_IMAGE_MB, max_doc_mb: int = fv.MAX_DOC_MB) -> DataFrame:
    """Adds media_type ('image' | 'document' | null), mime as stored, and reject (null when accepted).

    Browsers send documents under any MIME type, so documents are recognised by extension.
    Input columns: name, mime, size.
    """
    doc_types = F.create_map(*[F.lit(x) for pair in fv.DOCUMENT_MIME.items() for x in pair])
    doc_mime = F.try_element_at(doc_types, tx.extension(F.col("name")))
    is_image = F.coalesce(F.col("mime").rlike(fv.IMAGE_MIME), F.lit(False))
    media_type = F.when(is_image, "image").when(doc_mime.isNotNull(), "document")
    largest = max(max_image_mb, max_doc_mb)
    reject = (
        F.when(media_type.isNull(), "unsupported type")
        .when(F.col("size") > largest * MB, f"files are limited to {largest} MB")
        .when((media_type == "image") & (F.col("size") > max_image_mb * MB), f"images are limited to {max_image_mb} MB")
    )
    return df.withColumns(
        {
            "media_type": media_type,
            "mime": F.when(media_type == "document", doc_mime).otherwise(F.col("mime")),
            "reject": reject,
        }
    )


def read_text_docs(spark: SparkSession, path: str, names: str = r"(?i)\.(txt|md|markdown)$") -> DataFrame:
    """TXT and Markdown files, one row each: path, filename, text. Bad UTF-8 becomes U+FFFD."""
    files = read_folder(spark, path, ["path", "name", "content"], names)
    return files.select("path", F.col("name").alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_tree(spark: SparkSession, root: str, hash_content: bool = True) -> DataFrame:
    """Every supported, visible file under a folder: folder (relative), name, size, file_hash."""
    supported = r"(?i)\.(pdf|docx|txt|md|jpe?g|png|gif|webp|bmp|heic|heif|avif|tiff?)$"
    return read_folder(spark, root, ["folder", "name", "size", *(["file_hash"] if hash_content else [])], supported)


def load_gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Cities with region and country names from the three tab-separated gazetteer files.

    city_id is the line order, which breaks distance ties the same way on every run.
    """

    def table(name: str, columns: dict[int, str]) -> DataFrame:
        lines = spark.read.text(f"{folder}/{name}")
        part = F.split(F.col("value"), "\t")
        return lines.filter(~F.col("value").startswith("#")).select(
            *[F.get(part, F.lit(i)).alias(alias) for i, alias in columns.items()],
        )

    cities = table("cities15000.txt", {0: "geonameid", 1: "name", 4: "lat", 5: "lon", 8: "cc", 10: "a1", 14: "pop"})
    regions = table("admin1CodesASCII.txt", {0: "code", 1: "region"}).filter("region is not null")
    countries = table("countryInfo.txt", {0: "cc", 4: "country"}).filter("country is not null")
    return (
        cities.withColumn("code", F.concat_ws(".", "cc", "a1"))
        .join(regions, "code", "left")
        .join(countries, "cc", "left")
        .select(
            F.col("geonameid").cast("long").alias("city_id"),
            "name",
            F.col("lat").cast("double").alias("lat"),
            F.col("lon").cast("double").alias("lon"),
            F.coalesce(F.nullif(F.col("pop"), F.lit("")).cast("long"), F.lit(0)).alias("population"),
            "region",
            "country",
        )
    )
