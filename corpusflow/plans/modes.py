"""Whole runs: from a folder to passages, snapshots and indices; from questions to answers and their evaluation; reports."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, lexicon, text
from ..operators import answer, chunking, evaluate, graph, oplog, plugins, retrieval
from ..sources import chain, docx, faq, html, pdf, readers, sinks
from ..sources.scratch import exists, saved

MESSAGES = "session_id string, place long, role string, content string, batch long"
PAGES = "array<struct<page_number: int, text: string>>"
#: Passages as snapshots of these runs hold them.
CHUNKS = (
    "chunk_id string, parent_doc_id string, text_content string, canonical_concepts array<string>, filename string, source_url string, source_type string, page_number int, chunk_index long, "
    "semantic_role string, chunk_category string, word_count long, summary string, topic string, keywords array<string>, normalized_text string, explicit boolean, "
    "extracted_links array<struct<url: string, type: string, description: string>>, pii_warning boolean, validated_at boolean"
)


def conformed(chunks: DataFrame) -> DataFrame:
    """chunks with the columns of CHUNKS, null where they lack."""
    kinds = [x.strip().split(" ", 1) for x in re.split(r",(?![^<]*>)", CHUNKS)]
    return chunks.select(*[(F.col(n) if n in chunks.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def newest(spark: SparkSession, root: str) -> DataFrame | None:
    return readers.latest_snapshot(spark, root, CHUNKS)


# --- Passages
def transformed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents below a folder with their profile and pages: PDFs by page, Word documents as Markdown, texts whole, web pages read.

    Documents without content are left out, as are those that need a model to be seen."""
    files = readers.collect_documents(spark, folder)
    texts = readers.read_texts(spark, folder, ("txt", "md")).select("path", F.array(F.struct(F.lit(None).cast("int").alias("page_number"), "text")).cast(PAGES).alias("pages"))
    web = readers.read_texts(spark, folder, ("html",)).select("path", F.array(F.struct(F.lit(None).cast("int").alias("page_number"), html.page_text(F.col("text")).alias("text"))).cast(PAGES).alias("pages"))
    word = docx.markdown(docx.paragraphs(spark, folder)).select("path", F.array(F.struct(F.lit(None).cast("int").alias("page_number"), F.col("markdown").alias("text"))).cast(PAGES).alias("pages"))
    paged = pdf.read_pages(spark, folder).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).cast(PAGES).alias("pages"))
    content = texts.unionByName(web).unionByName(word).unionByName(paged)
    rows = files.join(content, "path")
    body = F.array_join(F.transform("pages", lambda p: p["text"]), "\n")
    kind = F.when(F.col("extension") == ".html", "web_page").otherwise(F.col("source_type"))
    profile = classify.profile(F.length(body), F.when(F.col("extension") == ".pdf", 0).otherwise(1), classify.table_lines(body), F.col("filename"), kind, F.lit(True))
    out = rows.withColumn("p", profile).select("sha256", "filename", "path", "extension", kind.alias("source_type"), F.lit("").alias("source_url"), F.lit("").alias("web_section"), "p.doc_type", "p.quality_score", "p.strategy", "pages")
    return out.where(F.exists("pages", lambda p: text.strip(F.coalesce(p["text"], F.lit(""))) != ""))


def build_chunks(docs: DataFrame, rewrite: Callable | None = None, describe: Callable | None = None) -> DataFrame:
    """Passages of transformed documents, those that are valid, with their category."""
    made = chunking.processed(docs, rewrite, describe)
    rows = made.withColumn("web_section", F.lit(None).cast("string"))
    return conformed(classify.validated(rows).where("validated_at"))


def full(spark: SparkSession, folder: str, root: str, created_at: str, rewrite: Callable | None = None) -> str | None:
    """All documents of a folder as a new snapshot; returns its folder."""
    return sinks.write_version(saved(build_chunks(transformed(spark, folder), rewrite)), root, created_at, "full")


def incremental(spark: SparkSession, folder: str, root: str, created_at: str, only: str | None = None) -> str | None:
    """A snapshot of the newest one's passages and those of documents it lacks, by digest; `only` takes one file, by name, and
    processes it again."""
    docs = transformed(spark, folder)
    old = newest(spark, root)
    if only is not None:
        docs = docs.where(F.col("filename") == only)
        old = None if old is None else old.where(F.col("filename") != only)
    else:
        known = [] if old is None else [old.select(F.col("parent_doc_id").alias("sha256"))]
        if exists(spark, f"{root}/seen"):  # documents that gave no passage are known too
            known.append(spark.read.parquet(f"{root}/seen"))
        for rows in known:
            docs = docs.join(rows.distinct(), "sha256", "left_anti")
        docs = saved(docs)
    new = build_chunks(docs)
    if only is None:
        docs.select("sha256").write.mode("append").parquet(f"{root}/seen")
    if old is None:
        return sinks.write_version(saved(new), root, created_at, "incremental")
    if new.isEmpty() and only is None:
        return None
    return sinks.write_version(saved(old.unionByName(new)), root, created_at, "incremental")


def web(pages: DataFrame, start: DataFrame, root: str, created_at: str, depth: int = 2, new_only: bool = False) -> str | None:
    """Crawled pages as a snapshot; only those whose digest the newest lacks, if asked."""
    spark = pages.sparkSession
    reached = graph.crawl(start, pages, depth).where("kind = 'page'")
    kept = pages.join(reached.select("url"), "url", "left_semi")
    meta = graph.crawled_documents(kept, F.lit(created_at).cast("timestamp"))
    content = F.array(F.struct(F.lit(None).cast("int").alias("page_number"), html.page_text(F.col("html")).alias("text"))).cast(PAGES)
    docs = meta.join(kept.select(F.col("url").alias("source_url"), content.alias("pages")), "source_url").withColumn("doc_type", F.lit("web_content"))
    old = newest(spark, root) if new_only else None
    if old is not None:
        docs = docs.join(old.select(F.col("parent_doc_id").alias("sha256")).distinct(), "sha256", "left_anti")
    made = build_chunks(docs)
    return sinks.write_version(saved(made if old is None else old.unionByName(made)), root, created_at, "web")


def faq_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Question and answer pairs of the FAQ texts below a folder, as passages."""
    texts = readers.read_texts(spark, folder, ("txt", "md"))
    rows = texts.select("path", F.posexplode(faq.pairs(F.col("text"))).alias("idx", "p"))
    body = F.concat(F.lit("D: "), "p.question", F.lit("\nR: "), "p.answer")
    name = text.basename(F.col("path"))
    return rows.select(text.stable_id(name, F.col("idx"), body).alias("chunk_id"), text.hash16(name).alias("parent_doc_id"), body.alias("text_content"), text.concepts(body, lexicon.CONCEPTS_BUILT, False).alias("canonical_concepts"), name.alias("filename"), F.lit(None).cast("int").alias("page_number"), F.lit("faq").alias("source_type"), F.lit("faq").alias("chunk_category"), F.col("idx").cast("long").alias("chunk_index"))


def rebuild(spark: SparkSession, pdf_folder: str, faq_folder: str, root: str, created_at: str) -> str | None:
    """The knowledge base anew: FAQ pairs, then PDFs, then the web passages of the newest snapshot, each beginning once, in that order."""
    parts = []
    if exists(spark, faq_folder):
        parts.append(faq_chunks(spark, faq_folder))
    if exists(spark, pdf_folder):
        pages = pdf.read_pages(spark, pdf_folder).select(text.basename(F.col("path")).alias("filename"), "page_number", F.lit("pdf").alias("source_type"), "text")
        parts.append(chunking.built(pages))
    old = newest(spark, root)
    if old is not None:
        parts.append(readers.web_chunks(old.where(F.col("source_type").isin("web", "web_page"))))
    rows = None
    for priority, part in enumerate(parts):
        part = conformed(part).withColumn("_priority", F.lit(priority))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return None
    key = F.md5(F.substring(text.normalize(F.col("text_content")), 1, 500))
    return sinks.write_version(saved(retrieval.dedup_prefix(rows, key, [F.col("_priority"), F.col("chunk_id")]).drop("_priority")), root, created_at, "rebuild")


# --- Indices
def admitted(chunks: DataFrame) -> DataFrame:
    """Passages that are indexed, with the text that is."""
    kind = F.col("chunk_category") if "chunk_category" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.where(classify.admitted(F.col("text_content"), kind) & (F.coalesce("text_content", F.lit("")) != ""))
    return rows.withColumn("index_text", text.index_text(F.col("text_content"), F.col("canonical_concepts")))


def rebuild_index(spark: SparkSession, root: str, target: str) -> bool:
    """The lexical and the vector index of the newest snapshot; False without one."""
    chunks = newest(spark, root)
    if chunks is None:
        return False
    rows = admitted(chunks)
    sinks.write_lexical_index(rows, f"{target}/lexical", "chunk_id", "index_text", sinks.dataset_fingerprint(spark, root))
    sinks.write_vectors(rows, f"{target}/vectors", "chunk_id", "index_text")
    return True


def add_to_index(chunks: DataFrame, target: str) -> None:
    """Appends passages that the vector index lacks; empty texts are left out."""
    known = chunks.sparkSession.read.parquet(f"{target}/vectors").select(F.col("id").alias("chunk_id"))
    sinks.write_vectors(saved(admitted(chunks).join(known, "chunk_id", "left_anti")), f"{target}/vectors", "chunk_id", "index_text", mode="append")


def migrate(spark: SparkSession, root: str, target: str) -> bool:
    """The newest snapshot's passages into the tables below target."""
    chunks = newest(spark, root)
    if chunks is None:
        return False
    sinks.upsert_chunks(target, chunks)
    return True


def admission_audit(chunks: DataFrame) -> DataFrame:
    """(reason, n): how many passages are indexed (null) and left out, by why."""
    return chunks.groupBy(classify.admission_reason(F.col("text_content"), F.col("chunk_category")).alias("reason")).agg(F.count("*").alias("n"))


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """(version, created_at, note, total_chunks, fingerprint) of the snapshots below root."""
    rows = [(m["version"], m["created_at"], m["note"], m["total_chunks"], f"{m['version']}:{m['chunks_file_sha256']}") for m in sinks.manifests(spark, root)]
    return spark.createDataFrame(rows, "version string, created_at string, note string, total_chunks long, fingerprint string")


# --- Answers and their evaluation
def chat(asked: DataFrame, passages: DataFrame, log: str | None = None, at: Column | None = None, **options) -> DataFrame:
    """Answers to asked (id, question, messages), failed ones asked again with their concepts' tags, audited at the path log."""
    first = saved(answer.requests(asked, passages, as_of=at, **options))
    lost = plugins.is_failed(F.col("answer"), F.col("sources"))
    again = asked.join(first.where(lost).select("id"), "id", "left_semi")
    retried = saved(answer.requests(again.withColumn("question", text.tagged(F.col("question"), text.concepts(F.col("question")))), passages, as_of=at, **options))
    better = retried.where(~lost).withColumn("path", F.array(F.lit("initial"), F.lit("retry_same_query")))
    kept = first.join(better.select("id"), "id", "left_anti").withColumn("path", F.when(lost, F.array(*map(F.lit, ("initial", "retry_same_query", "not_found")))).otherwise(F.array(F.lit("initial"))))
    out = kept.unionByName(better)
    if log is not None:
        sinks.append(audited(out, asked, at), log)
    return out


def audited(answers: DataFrame, asked: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows of the audit log for answers to asked (id, question)."""
    flags = F.col("safety_flags")
    status = F.when(flags["prompt_injection"] | flags["toxic_content"], "blocked").when(F.col("answer_mode").isNull(), "error").otherwise("success")
    when = F.current_timestamp() if at is None else at
    return sinks.audit_rows(answers.join(asked.select("id", "question"), "id").select(when.alias("timestamp"), F.lit("chat").alias("endpoint"), status.alias("status"), F.lit(0.0).alias("latency"), "question", "answer_mode", F.size("sources").alias("docs_found"), F.lit(True).alias("lexical")))


def recent_messages(said: DataFrame, sessions: DataFrame, most: int = 5) -> DataFrame:
    """(session_id, messages): the last messages, oldest first, of sessions (session_id) out of said (session_id, batch, place, role, content)."""
    last = Window.partitionBy("session_id").orderBy(F.desc("batch"), F.desc("place"))
    rows = said.join(sessions.select("session_id").distinct(), "session_id", "left_semi").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most)
    listed = F.sort_array(F.collect_list(F.struct(-F.col("_n"), "role", "content")))
    return rows.groupBy("session_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def chat_stream(questions: DataFrame, passages: DataFrame, root: str, checkpoint: str, at: Column | None = None, **options):
    """A stream of questions (id, session_id, question) answered batch by batch, each with the last five messages of its session.

    Below root each batch has its folder, by its number, of answers, messages (the question and the answer) and audit rows; a batch that is tried again
    puts them in the same place, so everything is there once. Questions of one batch see the messages of earlier batches. The answers are those of
    chat() on the same questions and messages.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        asked = saved(batch.select("id", F.col("session_id").cast("string").alias("session_id"), "question"))
        if asked.isEmpty():
            return
        none = F.lit(None).cast("array<struct<role: string, content: string>>")
        rows = asked.withColumn("messages", none)
        if exists(spark, f"{root}/messages"):
            before = spark.read.schema(MESSAGES).parquet(f"{root}/messages").where(F.col("batch") < number)
            rows = asked.join(recent_messages(before, asked), "session_id", "left")
        out = saved(chat(rows.select("id", "question", "messages"), passages, at=at, **options).join(asked.select("id", "session_id", "question"), "id"))
        out.drop("question").write.mode("overwrite").parquet(f"{root}/answers/batch={number}")
        order = F.row_number().over(Window.partitionBy("session_id").orderBy("id"))
        turns = F.inline(F.array(F.struct(F.lit(0).alias("t"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("t"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
        said = out.withColumn("_o", order).select("session_id", "_o", turns).select("session_id", (F.col("_o") * 2 + F.col("t")).cast("long").alias("place"), "role", "content")
        said.write.mode("overwrite").parquet(f"{root}/messages/batch={number}")
        audited(out.drop("question"), asked, at).write.mode("overwrite").parquet(f"{root}/audit/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stats(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row over the last days of an audit log."""
    rows = log.where(F.col("timestamp") >= as_of - F.make_dt_interval(F.lit(days)))
    one = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count("*").alias("total"), one("success").alias("success"), one("blocked").alias("blocked"), one("error").alias("errors"), F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 3).alias("avg_latency"), F.round(F.coalesce(F.max("latency"), F.lit(0.0)), 3).alias("max_latency"))


def zero_knowledge(asked: DataFrame, passages: DataFrame, judge: Callable, runs: int = 3, **options) -> DataFrame:
    """asked (id, question) answered `runs` times and judged: groundedness, self_contained, relevance, consistency, context_precision,
    citation_accuracy, failed_metrics, critical_flags and status of each.

    judge(kind, question, answer, context) is a Column of a judge's words, of one kind of `claims`, `claim`, `self_contained`, `chunk` and
    `citations`."""
    many = asked.crossJoin(asked.sparkSession.range(runs).withColumnRenamed("id", "run")).select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("q"), "run", "question", F.lit(None).cast("array<struct<role: string, content: string>>").alias("messages"))
    many = saved(many)
    answers = saved(answer.requests(many.select("id", "question", "messages"), passages, **options).join(many.select("id", "q", "run", "question"), "id"))
    vec = answers.select("q", "run", retrieval.embedding(F.col("answer")).alias("vec"))
    same = evaluate.run_consistency(vec, "q", "run", "vec").select("q", F.col("mean").alias("consistency"))
    main = answers.where("run = 0")
    context = F.array_join("contexts", "\n\n---\n\n")
    said = main.select("q", "question", "answer", "contexts", "sources", F.explode_outer(text.claims(judge("claims", F.col("question"), F.col("answer"), context))).alias("claim"), context.alias("c"))
    grounded = evaluate.groundedness(said.withColumn("v", judge("claim", F.col("question"), F.col("claim"), F.col("c"))), "q", "v").select("q", F.col("score").alias("groundedness"))
    chunks = main.select("q", "question", "answer", F.explode_outer("contexts").alias("c"))
    verdicts = chunks.withColumn("v", F.when(F.col("c").isNotNull(), evaluate.chunk_verdict(judge("chunk", F.col("question"), F.col("answer"), F.col("c"))))).groupBy("q").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("context_precision"))
    told = judge("citations", F.col("question"), F.col("answer"), context)
    named = F.filter(F.split(told, "\n"), lambda x: F.trim(x) != "")
    cited = F.when(told.contains("NESSUNA_CITAZIONE"), 1.0).otherwise(evaluate.citation_accuracy(named, F.transform("sources", lambda s: s["page_number"]), F.transform("sources", lambda s: s["filename"])))
    close = text.cosine(retrieval.embedding(F.col("question")), retrieval.embedding(F.col("answer")))
    rest = main.select("q", text.judged_score(judge("self_contained", F.col("question"), F.col("answer"), context)).alias("self_contained"), F.coalesce(F.try_divide(close, F.lit(1.0)), F.lit(0.0)).alias("relevance"), cited.alias("citation_accuracy"))
    scores = rest.join(same, "q").join(grounded, "q").join(verdicts, "q").withColumnRenamed("q", "id")
    return evaluate.flagged(scores, lexicon.THRESHOLDS)


def gold_evaluation(gold: DataFrame, passages: DataFrame, **options) -> DataFrame:
    """(id, question, answer, contexts, ground_truth, factual_mismatch, answerable) of gold (id, question, ground_truth), for judged metrics."""
    asked = gold.select("id", "question", F.lit(None).cast("array<struct<role: string, content: string>>").alias("messages"))
    out = answer.requests(asked, passages, **options).join(gold.select("id", "question", "ground_truth"), "id")
    return out.select("id", "question", "answer", "contexts", "ground_truth", classify.factual(F.col("answer"), F.col("ground_truth")).alias("factual_mismatch"), classify.was_answerable(F.col("contexts"), F.col("answer")).alias("answerable"))


def heuristic_evaluation(answers: DataFrame, k: int = 5) -> DataFrame:
    """answers (question, answer, retrieved, expected) with recall and precision at k and the scores of safety, and (id null) their means."""
    none = F.array().cast("array<string>")
    got, want = F.coalesce("retrieved", none), F.coalesce("expected", none)
    rows = answers.select("id", evaluate.recall_at_k(got, want, k).alias("recall"), evaluate.precision_at_k(got, want, k).alias("precision"), classify.safety_scores(F.col("answer")).alias("s")).select("id", "recall", "precision", "s.ood", "s.injection", "s.legal")
    means = rows.agg(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), *[F.avg(c).alias(c) for c in ("recall", "precision", "ood", "injection", "legal")])
    return rows.unionByName(means)


def report_analysis(report: DataFrame, gold: DataFrame, metrics: list[str]) -> dict[str, DataFrame]:
    """What is told of a report (user_input and a column for each metric) with gold (question, question_id): records, statistics, outliers,
    critical questions, correlations, health."""
    ids = gold.select(F.lower(F.trim("question")).alias("_q"), "question_id").dropDuplicates(["_q"])
    known = report.withColumn("_q", F.lower(F.trim("user_input"))).join(ids, "_q", "left").withColumn("question_id", F.coalesce("question_id", F.lit("unknown"))).drop("_q")
    keyed = known.withColumn("_key", F.concat_ws("|", "question_id", "user_input"))
    long = saved(evaluate.long_form(keyed, "_key", metrics))
    described = saved(evaluate.statistics(long))
    low = saved(evaluate.critical(long, described, metrics).withColumn("question_id", F.substring_index("id", "|", 1)))
    return {
        "records": known.select("question_id", F.col("user_input").alias("question"), *metrics),
        "statistics": described,
        "outliers": evaluate.outliers(long, described),
        "critical": evaluate.by_severity(low),
        "correlations": evaluate.correlations(known, metrics),
        "health": evaluate.health_report(described, low.agg(F.count("*").alias("n"))),
    }


def link_report(texts: DataFrame, id_col: str, text_col: str, path: str, site: str = "portale") -> DataFrame:
    """The link map of texts, written as JSON lines and as a text by frequency."""
    found = saved(graph.link_map(graph.line_links(texts, id_col, text_col), site))
    found.write.mode("overwrite").json(f"{path}/links.json")
    sinks.link_text(found).orderBy("n").select("value").write.mode("overwrite").text(f"{path}/links.txt")
    return found


def trace(asked: DataFrame, passages: DataFrame, k: int = 8) -> DataFrame:
    """What a request makes of each question: its concepts, intent, depth, and what the search by words finds, with previews."""
    q = F.col("question")
    found = retrieval.bm25_top(passages, asked.select(F.col("id").alias("query"), q.alias("text")), k, "id", "content").join(passages.select("id", "filename", "page_number", "category", "content"), "id")
    listed = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "filename", "page_number", "category", F.substring("content", 1, 200).alias("preview")))).alias("found"))
    seen = asked.select("id", "question", text.casefolded(q).alias("normalized_text"), text.concepts(q).alias("canonical_concepts"), classify.intent(q).alias("intent"), classify.depth(q).alias("depth"))
    return seen.join(listed.withColumnRenamed("query", "id"), "id", "left").withColumn("retrieved", F.coalesce(F.size("found"), F.lit(0)))


def kpi(events: DataFrame, key: str, order: str, path: str, batch: int | None = None) -> bool:
    """Events as masked, chained entries, appended to the log at path: each key's chain goes on. A batch (its number, if given) counts once."""
    return chain.append(events, key, order, sinks.event_fields(events), path, batch)


def health(spark: SparkSession, root: str) -> str:
    """A line of JSON: whether there is a snapshot, and which."""
    return json.dumps({"status": "ok" if readers.versions(spark, root) else "empty", "dataset": sinks.dataset_fingerprint(spark, root)})


def rated(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Requests as a proxy and then the limiter let them pass."""
    through = oplog.leaky(events, key, ts).where("accepted").select("event_id")
    return oplog.limited(events.join(through, "event_id", "left_semi"), key, ts)
