"""Inputs and outputs: texts, image files, OCR words, custom rules; findings and redacted images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import CustomRule
from . import files

IMAGE_FILES = r"(?i)\.(png|jpe?g|gif|webp|bmp|tiff?)$"
WORDS = "image_id long, quarter_turns int, block int, para int, line int, word int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, scale double"
OCR_TREE = "image_id long, quarter_turns int, scale double, blocks array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>>>>"


def texts(spark: SparkSession, path: str, format: str = "parquet", text_col: str = "text", **options) -> DataFrame:
    """Documents whose text isn't blank."""
    df = spark.read.format(format).options(**options).load(path)
    return df.where(not_blank(F.col(text_col)))


def not_blank(text: Column) -> Column:
    """Whether a text has anything but white space of any kind; null for null."""
    return text.rlike(r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose name says image; reading one again is a new row of the same path.

    Spark deals some thirty small files to a task; up to sixteen such tasks become one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    dealt, least = files.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism
    if dealt > least:
        files = files.coalesce(max(least, dealt // 16))
    return files.where(F.col("path").rlike(IMAGE_FILES))


def ocr_words(tree: DataFrame) -> DataFrame:
    """The OCR result tree as one row for each word, with its place in the tree."""
    b = tree.select("image_id", "quarter_turns", "scale", F.posexplode("blocks").alias("block", "b"))
    p = b.select("image_id", "quarter_turns", "scale", "block", F.posexplode("b.paragraphs").alias("para", "p"))
    n = p.select("image_id", "quarter_turns", "scale", "block", "para", F.posexplode("p.lines").alias("line", "l"))
    w = n.select("image_id", "quarter_turns", "scale", "block", "para", "line", F.posexplode("l.words").alias("word", "w"))
    return w.select("image_id", "quarter_turns", "block", "para", "line", "word", "w.text", "w.confidence", "w.bbox.*", "scale")


def custom_rules(rules: DataFrame) -> tuple[CustomRule, ...]:
    """A user's rules, collected: patterns enter the plan as literals."""
    rows = rules.select("id", "label", "pattern", F.coalesce("flags", F.lit("")).alias("flags"), "severity").collect()
    return tuple(CustomRule(r.id, r.label, r.pattern, r.flags, r.severity) for r in rows)


def write_findings(spans: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Findings as Parquet by category, masked: secrets don't leave the scan."""
    from ..operators.report import findings

    findings(spans).write.mode(mode).partitionBy("category").parquet(path)


def write_png(images: DataFrame, path: str) -> DataFrame:
    """Redacted rasters as PNG files named by image_id; returns their names and sizes."""
    from ..operators.images import as_png

    return files.write_each(as_png(images).select(F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "png"), path, "name", "png")


def write_images(images: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Redacted rasters (id, size, pixels) as Parquet."""
    images.write.mode(mode).parquet(path)
