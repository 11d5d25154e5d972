"""Readers: text logs, CSV truth and result files, JSON examples, in-memory frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.relational import dense_line_id_in_files
from millrace.sources.formats import FORMATS, compile_format, parse_lines

TRUTH_SCHEMA = "LineId long, Content string, EventId string, EventTemplate string"
TEMPLATES_SCHEMA = "EventId string, EventTemplate string, Occurrences long"
ANNOTATION_SCHEMA = "Content string, EventTemplate string"
EXAMPLES_SCHEMA = "content string, template string, Postive_Example string, Negative_Example string"


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """file, block, offset (rising within a file) and value, the stripped line.

    ``block`` is where the split that holds the line begins in its file.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("offset"),
        strip(F.col("value")).alias("value"),
    )


def load_log(spark: SparkSession, path: str, form: str) -> DataFrame:
    """A log file as LineId (dense over matching lines) and one string column per field.

    ``form`` is the name of a known family or a format itself. Files count in the order of
    their paths. The lines are stored once and not shuffled.
    """
    parsed = parse_lines(scan_text(spark, path), compile_format(FORMATS.get(form, form)))
    return dense_line_id_in_files(parsed.drop("offset"), "file", "block").drop("file", "block")


def load_sample(spark: SparkSession, path: str, form: str, n: int = 2000) -> DataFrame:
    """The first ``n`` lines of ``load_log``, found without numbering the others."""
    parsed = parse_lines(scan_text(spark, path), compile_format(FORMATS.get(form, form)))
    place = ["file", "block", "offset"]
    first = parsed.orderBy(*place).limit(n).withColumn("LineId", F.row_number().over(Window.orderBy(*place)).cast("long"))  # n rows
    return first.select("LineId", *(c for c in parsed.columns if c not in place))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header, quoted as pandas quotes."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def load_groundtruth(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TRUTH_SCHEMA)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TEMPLATES_SCHEMA)


def _placed() -> Column:
    """A value that rises in the order of the files' paths and, in a file, of its rows; such files are not split."""
    return F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Content, EventTemplate and ``pos``, the order of the rows."""
    rows = read_csv(spark, path, ANNOTATION_SCHEMA)
    return rows.select("Content", "EventTemplate", _placed().alias("pos"))


def load_example_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_examples`` wrote: one JSON object a line; ``id`` rises with the lines."""
    return spark.read.schema(EXAMPLES_SCHEMA).json(path).select(F.monotonically_increasing_id().alias("id"), *(c.split()[0] for c in EXAMPLES_SCHEMA.split(", ")))


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of examples; step-one files leave the last two columns null. ``id`` is the place in the array."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_struct(EXAMPLES_SCHEMA)}>>").alias("a"))
    return whole.select(F.posexplode("a").alias("id", "e")).select(F.col("id").cast("long").alias("id"), "e.*")


def _struct(ddl: str) -> str:
    return ",".join(":".join(part.split()) for part in ddl.split(","))
