"""Readers of logs, source trees, corpora and indexes; everything goes through Spark's own sources."""

from __future__ import annotations

import fnmatch
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import template_regex_udf

#: Suffixes of source files by language, directories that hold no sources of the project (fixed values).
SUFFIXES = {
    "py": "python", "kt": "kotlin", "java": "java", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c", "hxx": "c",
}
SKIPPED = [
    ".git", "__pycache__", ".venv", "venv", "node_modules", ".gradle", "build", "dist", ".idea", ".vscode", "third_party", "third-party", "vendor", "external", "generated", "cmake-build-debug", "cmake-build-release",
]
INDEX_TABLES = ("functions", "call_edges", "log_sites", "file_signatures")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of each text file; numbers start at 1 and keep empty lines. Lines are numbered within each
    block of a file, and the blocks' counts, one row a block, put in order: no file is read by one task."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    return rows.join(offsets, ["file", "block"]).select("file", (F.col("before") + F.row_number().over(inside)).cast("int").alias("line_no"), "line")


def log_lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(file, line_no, line) of a table of texts."""
    return texts.select(F.col(key).cast("string").alias("file"), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def glob_regex(glob: str) -> str:
    return re.sub(r"\\[Zz]$", "$", fnmatch.translate(glob)).replace("(?s:", "(?s:")


def source_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(file, module, language, content, mtime, length, signature) of a source tree; paths are relative to the root."""
    # only files with a suffix of a language are opened
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}").load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(re.sub("^/*", "/", base)) + "/", "")
    suffix = F.regexp_extract(relative, r"\.([A-Za-z]+)$", 1)
    kinds = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    out = files.withColumn("file", relative).withColumn("language", F.try_element_at(kinds, suffix)).filter("language is not null")
    folders = F.slice(F.split(F.lower("file"), "/"), 1, F.size(F.split("file", "/")) - 1)
    out = out.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))) | (F.size(folders) == 0))
    for glob in exclude or []:
        literal = glob.replace("*", "").strip("/")
        name = F.element_at(F.split("file", "/"), -1)
        hit = F.col("file").rlike("^" + glob_regex(glob)) | F.col("file").rlike("^" + glob_regex("*" + glob)) | name.rlike("^" + glob_regex(glob))
        out = out.filter(~(hit | (F.contains(F.col("file"), F.lit(literal)) if literal else F.lit(False))))
    signature = F.concat_ws(":", (F.unix_micros("modificationTime") * 1000).cast("string"), F.col("length").cast("string"))
    module = F.replace(F.regexp_replace("file", r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    return out.select("file", module.alias("module"), "language", "content", F.col("modificationTime").alias("mtime"), "length", signature.alias("signature"))


def app_identifiers(spark: SparkSession, root: str) -> list[str]:
    """Package names in the build files one folder below a project's root and in its manifest, each once, in the files' order."""
    build = r"(?:namespace|applicationId)\s*[= ]\s*[\"']([^\"']+)[\"']"
    places = [("*/build.gradle", build), ("*/build.gradle.kts", build), ("app/src/main/AndroidManifest.xml", r"package=[\"']([^\"']+)[\"']")]
    found: list[str] = []
    for i, (glob, pattern) in enumerate(places):
        try:
            rows = spark.read.text(f"{root.rstrip('/')}/{glob}", wholetext=True)
        except AnalysisException:  # no such file
            continue
        names = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("pos", "name"))
        found += [r["name"] for r in names.orderBy("file", "pos").collect()]  # as many as a project has modules
    return list(dict.fromkeys(found))


def import_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An index kept as one JSON document: functions and log sites by id, calls as a list, file signatures in its metadata."""
    function = "name string, qualname string, module string, file string, start_line int, end_line int, kind string"
    site = "function_id string, level string, template string, regex string, file string, line int, logger string"
    schema = (
        f"functions map<string, struct<{_fields(function)}>>, log_sites map<string, struct<{_fields(site)}>>, calls array<struct<{_fields('caller string, callee string, file string, line int, confidence double')}>>, "
        "metadata struct<file_signatures: map<string, string>>"
    )
    whole = spark.read.schema(schema).json(path, multiLine=True)
    calls = whole.select(F.inline("calls"))
    return {
        "functions": whole.select(F.explode("functions").alias("id", "x")).select("id", "x.*"), "call_edges": calls.withColumn("raw", F.col("callee")),
        "log_sites": whole.select(F.explode("log_sites").alias("id", "x")).select("id", "x.*").withColumn("regex", template_regex_udf("template")),
        "file_signatures": whole.select(F.explode("metadata.file_signatures").alias("file", "signature")).withColumn("mtime", F.lit(None).cast("timestamp")),
    }


def _fields(columns: str) -> str:
    return ", ".join(": ".join(c.split()) for c in columns.split(","))


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, log, expected) of a JSON-lines corpus."""
    return spark.read.schema("id string, log string, expected struct<file: string, function: string, line: int>").json(path)


def save_index(index: dict[str, DataFrame], path: str) -> None:
    for name in INDEX_TABLES:
        if name in index:
            index[name].write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An index of this engine's tables, or one JSON document."""
    return import_index(spark, path) if path.endswith(".json") else {name: spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES}


def newest(files: DataFrame) -> DataFrame:
    """The latest modification time of source files."""
    return files.agg(F.max("mtime").alias("newest"))
