"""Word documents: paragraphs, Markdown, FAQ pairs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the XML namespace of WordprocessingML.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPHS = "path string, pos int, style string, text string"


def parse(content: bytes) -> Iterator[tuple[str, str]]:
    """(style, text) of the paragraphs in the body of a document, those in tables left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        body = ElementTree.fromstring(box.read("word/document.xml")).find(f"{W}body")
    for p in body.findall(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        marks = {f"{W}tab": "\t", f"{W}br": "\n"}
        # tab stops among the properties of the paragraph are no text
        text = "".join(x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for r in p.iter(f"{W}r") for x in r)
        yield ("" if style is None else style.get(f"{W}val", "")), text


def tables(content: bytes) -> int:
    """How many tables the body of a document holds."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        return len(ElementTree.fromstring(box.read("word/document.xml")).find(f"{W}body").findall(f"{W}tbl"))


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text_len, tables) of the .docx files below a folder; unreadable files have zeros."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, sum(len(t) for _, t in parse(content)), tables(content)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
                    rows.append((path, 0, 0))
            yield pd.DataFrame(rows, columns=["path", "text_len", "tables"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(folder)
    return files.select("path", "content").mapInPandas(count, "path string, text_len long, tables long")


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, pos, style, text) of each paragraph of the .docx files below a folder; unreadable files give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, i, *x) for i, x in enumerate(parse(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
                    continue
                yield pd.DataFrame(rows, columns=["path", "pos", "style", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder)
    return files.select("path", "content").mapInPandas(read, PARAGRAPHS)


def markdown(parts: DataFrame, by: str = "path") -> DataFrame:
    """(by, markdown): paragraphs with an empty line between, headings as second-rank ones."""
    line = F.when(F.col("style").startswith("Heading"), F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    lines = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return parts.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("markdown"))


def faq_sections(parts: DataFrame, by: str = "path") -> DataFrame:
    """(by, block, section, question, answer, role) out of paragraphs (by, pos, text).

    A paragraph with a question mark asks; those up to the next question or section answer. An upper-case one of at
    most five words opens a section, `GENERALE` before the first. Questions without an answer are left out, as are
    empty and null paragraphs. The paragraphs of one document are one partition of the window.
    """
    t = F.col("_t")
    lines = parts.select(by, "pos", F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("_t")).where("_t <> ''")
    asks = t.contains("?")
    opens = ~asks & (F.upper(t) == t) & (F.lower(t) != t) & t.rlike(r"^[^ \t\r\n]+([ \t\r\n]+[^ \t\r\n]+){0,4}$")
    so_far = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(by, "pos", "_t", asks.alias("_asks"), opens.alias("_opens"))
    marked = marked.withColumn("block", F.count_if(F.col("_asks") | F.col("_opens")).over(so_far))
    marked = marked.withColumn("section", F.coalesce(F.last(F.when(F.col("_opens"), t), True).over(so_far), F.lit("GENERALE")))
    told = F.sort_array(F.collect_list(F.when(~F.col("_asks") & ~F.col("_opens"), F.struct("pos", "_t"))))
    out = marked.groupBy(by, "block").agg(F.max("section").alias("section"), F.max(F.when(F.col("_asks"), t)).alias("question"), told.alias("_told"))
    out = out.where(F.col("question").isNotNull() & (F.size("_told") > 0))
    role = F.when(F.col("question").rlike("(?i)come|dove|quando|quanto"), "procedural").otherwise("definitional")
    return out.select(by, "block", "section", "question", F.array_join(F.transform("_told", lambda x: x["_t"]), " ").alias("answer"), role.alias("role"))
