"""Sources: folders, texts, JSON lines, tables of reports, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text
from .scratch import exists

ALLOWED = ("pdf", "docx", "doc", "txt", "md", "html")
DOCUMENTS = "path string, filename string, extension string, sha256 string, source_type string, length long, modificationTime timestamp"


def any_case(suffixes: tuple[str, ...]) -> str:
    """A glob of names with one of the suffixes in either case."""
    either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" for c in s)
    return "*.{" + ",".join(map(either, suffixes)) + "}"


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", any_case(suffixes)).load(folder)


def collect_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the allowed kinds below a folder, with name, fingerprint and source type; a folder that isn't there gives none."""
    if not exists(spark, folder):
        return spark.createDataFrame([], DOCUMENTS)
    name = text.basename(F.col("path"))
    return files(spark, folder, ALLOWED).select("path", name.alias("filename"), text.extension(F.col("path")).alias("extension"), F.sha2("content", 256).alias("sha256"), classify.source_type(name).alias("source_type"), "length", "modificationTime")


def web_documents(docs: DataFrame) -> DataFrame:
    """docs that have both a digest and a path."""
    return docs.where((F.coalesce("sha256", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""))


def read_texts(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("txt", "md", "html"), leave_out: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of whole files, trimmed; bytes that are no UTF-8 are dropped, as are files of the names left out."""
    body = F.replace(F.call_function("make_valid_utf8", F.col("content").cast("string")), F.lit("�"), F.lit(""))
    rows = files(spark, folder, suffixes).where(~text.basename(F.col("path")).isin(*leave_out)) if leave_out else files(spark, folder, suffixes)
    return rows.select("path", text.strip(body).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped, or fail the query if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def latest_records(spark: SparkSession, path: str, schema: str, n: int = 50, order: str = "timestamp") -> DataFrame:
    """The last n records of a log of JSON lines, newest first; malformed lines are skipped, a log that isn't there gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema).orderBy(F.desc(order)).limit(n)


def read_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV files with a header (quoted fields may span lines), with `report`, the file's name; an error names required columns that lack."""
    rows = spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return rows.select("*", text.basename(F.col("_metadata.file_path")).alias("report"))


def gold_records(table: DataFrame, question: str, truth: str) -> DataFrame:
    """(question, ground_truth, metadata): other columns as a map of texts without nulls, as gold questions are written."""
    other = [c for c in table.columns if c not in (question, truth)]
    made = F.create_map(*[x for c in other for x in (F.lit(c), F.col(c).cast("string"))]) if other else F.create_map().cast("map<string,string>")
    return table.select(F.trim(question).alias("question"), F.trim(truth).alias("ground_truth"), F.map_filter(made, lambda _, v: v.isNotNull()).alias("metadata"))


def version_number(tag: Column) -> Column:
    return F.nullif(F.regexp_extract(tag, "^v([0-9]+)", 1), F.lit("")).cast("int")


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder) of the snapshots v<number>_... below root that hold passages, oldest first."""
    if not exists(spark, f"{root}/v*/chunks*"):
        return []
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/v*/chunks*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    folders = {x.getPath().getParent().toString() for x in found}
    tagged = [(f.rsplit("/", 1)[1], f) for f in folders]
    return sorted((int(digits), f) for tag, f in tagged if (digits := tag[1:].split("_")[0]).isdigit())


def latest_snapshot(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame | None:
    """The passages of the newest snapshot, by number; None where there is none."""
    found = versions(spark, root)
    if not found:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("mode", "DROPMALFORMED").json(f"{found[-1][1]}/chunks.jsonl")


def web_chunks(chunks: DataFrame, words: int = 30) -> DataFrame:
    """Passages of so many words."""
    return chunks.where(text.word_count(F.col("text_content")) >= words)


def unseen(docs: DataFrame, index: DataFrame, key: str = "sha256") -> DataFrame:
    return docs.join(index.select(key).distinct(), key, "left_anti")
