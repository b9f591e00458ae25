"""Splitting texts into passages, and building passages with what is known of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, lexicon, text

#: Separators by coarseness. A run without any of them stays whole.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ")


def fixed_stride(content: Column, size: int, overlap: int) -> Column:
    """Structs of index and passage: `size` characters, each `size - overlap` after the one before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(content) - overlap) / step) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(i.alias("idx"), F.substring(content, (i * step + 1).cast("int"), F.lit(size)).alias("passage")))


def recursive_split(content: str, size: int = 2000, overlap: int = 300, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Cuts before the coarsest separator present, refines what is too long by finer ones, and packs pieces to at most `size` with up
    to `overlap` characters carried over; passages are stripped, empty ones left out. Linear in the text's length."""
    at = next((i for i, s in enumerate(separators) if s in content), None)
    if at is None:
        if content.strip():
            yield content.strip()
        return
    sep, finer = separators[at], separators[at + 1 :]
    window: list[str] = []
    first = held = 0  # where the window begins in its list, and its length
    begin = 0
    while begin < len(content):
        stop = content.find(sep, begin + (len(sep) if begin and content.startswith(sep, begin) else 0) or begin)
        stop = len(content) if stop < 0 else stop
        if stop == begin:  # the text begins with the separator
            stop = content.find(sep, begin + len(sep))
            stop = len(content) if stop < 0 else stop
        piece = content[begin:stop]
        begin = stop
        if len(piece) >= size:
            if held:
                yield from _stripped(window[first:])
            window, first, held = [], 0, 0
            yield from recursive_split(piece, size, overlap, finer) if finer else _stripped([piece])
            continue
        if held and held + len(piece) > size:
            yield from _stripped(window[first:])
            while held > overlap or (held and held + len(piece) > size):
                held -= len(window[first])
                first += 1
            if first > 1000:
                window, first = window[first:], 0
        window.append(piece)
        held += len(piece)
    if held:
        yield from _stripped(window[first:])


def _stripped(pieces: list[str]) -> Iterator[str]:
    whole = "".join(pieces).strip()
    if whole:
        yield whole


def split_rows(rows: DataFrame, text_col: str, size: int = 2000, overlap: int = 300) -> DataFrame:
    """rows with `idx` and `passage` in place of the text, a row for each passage; an Arrow batch of bounded size at a time.
    Null and blank texts give none."""
    kept = [f for f in rows.schema.fields if f.name != text_col]
    names = [f.name for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, idx, passages, letters = [], [], [], 0

            def out() -> pa.RecordBatch:
                taken = [batch.column(c).take(pa.array(source, pa.int64())) for c in names]
                return pa.RecordBatch.from_arrays([*taken, pa.array(idx, pa.int64()), pa.array(passages, pa.string())], names=[*names, "idx", "passage"])

            for i, content in enumerate(batch.column(text_col)):
                for k, passage in enumerate(recursive_split(content.as_py() or "", size, overlap)):
                    source.append(i)
                    idx.append(k)
                    passages.append(passage)
                    letters += len(passage)
                    if letters > 4 << 20:
                        yield out()
                        source, idx, passages, letters = [], [], [], 0
            if source:
                yield out()

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "idx long, passage string"])
    return rows.mapInArrow(work, kind)


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = 2000, overlap: int = 300) -> DataFrame:
    """(id, idx, passage) by recursive_split."""
    return split_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", size, overlap)


def built(pages: DataFrame, size: int = 2000, overlap: int = 300, words: int = 30, names: list = lexicon.CONCEPTS_BUILT) -> DataFrame:
    """Passages of pages (filename, page_number, source_type, text), with what is known of them, as a knowledge base is built.

    Texts are cleaned and, if of so many words, split; passages are cut at their last sentence, and short ones and junk
    left out. chunk_index counts before that. The id is a digest of the file, page and index.
    """
    rows = pages.select("filename", "page_number", "source_type", text.once(text.clean(F.col("text"))).alias("text")).where(text.word_count(F.col("text")) >= words)
    made = split_rows(rows, "text", size, overlap).select("filename", "page_number", "source_type", "idx", text.once(text.trim_to_sentence(F.col("passage"))).alias("text_content"))
    body = F.col("text_content")
    made = made.select("*", text.once(F.struct(text.word_count(body).alias("words"), text.strip(F.lower(body)).alias("low"))).alias("_t"))
    made = made.where((F.col("_t.words") >= words) & ~classify.junk(F.col("_t.low"), F.col("_t.words")))
    return made.select(
        text.stable_id(F.col("filename"), F.col("page_number"), F.col("idx"), body).alias("chunk_id"),
        text.hash16(F.col("filename")).alias("parent_doc_id"),
        "text_content",
        text.concepts(body, names, False).alias("canonical_concepts"),
        "filename",
        "page_number",
        "source_type",
        classify.role(body).alias("semantic_role"),
        classify.built_category(body, F.col("source_type"), F.col("filename")).alias("chunk_category"),
        F.col("_t.words").alias("word_count"),
        F.col("idx").alias("chunk_index"),
        F.replace(F.substring(body, 1, 150), F.lit("\n"), F.lit(" ")).alias("summary"),
        text.domain_words(body).alias("keywords"),
        F.lower(F.trim(body)).alias("normalized_text"),
    )


def processed(docs: DataFrame, rewrite=None, describe=None, size: int = 2000, overlap: int = 300) -> DataFrame:
    """Passages of transformed documents (sha256, filename, source_url, source_type, doc_type, pages: array of page_number and text).

    rewrite(passage, doc_type) is a Column for a model's rewriting (none by default, short passages are left out all the
    same); describe(passage) one for a struct of summary, keywords and topic. Links of a passage come with that of its page.
    """
    pages = docs.select("sha256", "filename", "source_url", "source_type", "doc_type", F.explode("pages").alias("p"))
    pages = pages.select("sha256", "filename", "source_url", "source_type", "doc_type", F.col("p.page_number").alias("page_number"), F.col("p.text").alias("text"))
    cut = split_rows(pages.where(F.trim(F.coalesce("text", F.lit(""))) != ""), "text", size, overlap)
    told = F.when(F.length(F.trim("passage")) >= 50, F.col("passage")) if rewrite is None else rewrite(F.col("passage"), F.col("doc_type"))
    rows = cut.withColumn("text_content", told).where(F.coalesce("text_content", F.lit("")) != "").drop("passage")
    body = F.col("text_content")
    nothing = F.struct(F.lit("N/A").alias("summary"), F.array().cast("array<string>").alias("keywords"), F.lit("Generico").alias("topic"))
    meta = nothing if describe is None else F.coalesce(describe(body), nothing)
    rows = rows.withColumn("_m", meta)
    return rows.select(
        text.stable_id(F.col("sha256"), F.col("page_number"), F.col("idx"), body).alias("chunk_id"),
        F.col("sha256").alias("parent_doc_id"),
        "text_content",
        text.concepts(body).alias("canonical_concepts"),
        "filename",
        "source_url",
        "source_type",
        "page_number",
        F.col("idx").alias("chunk_index"),
        F.lit("descriptive").alias("semantic_role"),
        F.lit(False).alias("explicit"),
        text.casefolded(body).alias("normalized_text"),
        text.with_source(text.links(body), F.col("source_url"), F.col("filename")).alias("extracted_links"),
        "_m.summary",
        "_m.keywords",
        "_m.topic",
    )


def lifted(chunks: DataFrame) -> DataFrame:
    """Passages (chunk_id, text_content, ...) for the rules that passages imply: none to three of each, with derived_from, explicit and confidence."""
    other = [c for c in chunks.columns if c not in ("chunk_id", "text_content", "semantic_role", "explicit", "derived_from", "confidence")]
    rows = chunks.select(*other, "chunk_id", F.explode(classify.implied_rules(F.col("text_content"))).alias("r"))
    return rows.select(*other, text.stable_id(F.col("chunk_id"), F.col("r.semantic_role")).alias("chunk_id"), "r.text_content", "r.semantic_role", F.lit(True).alias("explicit"), F.col("chunk_id").alias("derived_from"), "r.confidence")
