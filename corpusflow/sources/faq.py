"""Questions and answers out of plain and Markdown FAQ texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The three notations of a question and its answer; the first that occurs is used.
GRAMMARS = [
    r"(?msi)^\s*Q[:.]\s*(.+?)\n\s*A[:.]\s*(.+?)(?=\n\s*Q[:.]\s*|\Z)",
    r"(?msi)^\s*DOMANDA[:.]\s*(.+?)\n\s*RISPOSTA[:.]\s*(.+?)(?=\n\s*DOMANDA[:.]\s*|\Z)",
    r"(?ms)^###+\s*(.+?)\n+(.+?)(?=\n###+\s*|\Z)",
]


def pairs(text: Column) -> Column:
    """Structs of question and answer, trimmed, by the first grammar that occurs; null texts give none."""
    out = F.array().cast("array<struct<question: string, answer: string>>")
    for grammar in reversed(GRAMMARS):
        asked, told = (F.regexp_extract_all(text, F.lit(grammar), F.lit(i)) for i in (1, 2))
        made = F.zip_with(asked, told, lambda q, a: F.struct(F.trim(q).alias("question"), F.trim(a).alias("answer")))
        out = F.when(F.size(asked) > 0, made).otherwise(out)
    return out


def markdown_faq(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, macro, section, question, answer) of Markdown with `##` macro areas, `###` sections and `#### Domanda` headings.

    A heading holds until the next one of its rank; a macro area ends the section. An answer runs to the next
    heading or rule (`---`). One file is one partition of the windows.
    """
    line = F.col("_line")
    lines = texts.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("_pos", "_line"))
    so_far = Window.partitionBy(id_col).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    head = lambda marks: F.when(line.rlike(f"^{marks} "), F.trim(F.regexp_replace(line, "^#+ ", "")))
    asks = line.rlike(r"(?i)^#### *Domanda")
    marked = (
        lines.withColumn("macro", F.last(head("##"), True).over(so_far))
        .withColumn("_area", F.count(head("##")).over(so_far))
        .withColumn("_block", F.count(F.when(line.rlike("^(#{2,} |---)"), 1)).over(so_far))
        .withColumn("_asks", asks)
    )
    in_area = Window.partitionBy(id_col, "_area").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("section", F.last(head("###"), True).over(in_area))
    question = F.max(F.when(F.col("_asks"), F.trim(F.regexp_replace("_line", r"(?i)^#### *Domanda *[0-9]*[:.]? *", ""))))
    told = F.sort_array(F.collect_list(F.when(~F.col("_asks"), F.struct("_pos", "_line"))))
    blocks = marked.groupBy(id_col, "_block").agg(F.first("macro", True).alias("macro"), F.first("section", True).alias("section"), question.alias("question"), told.alias("_told"))
    answer = F.regexp_replace(F.array_join(F.transform("_told", lambda x: x["_line"]), "\n"), r"^\s+|\s+$", "")
    return blocks.where(F.col("question").isNotNull()).select(id_col, "macro", "section", "question", answer.alias("answer"))
