"""Retrieval-augmented answers as a composition of tables: store, retrieve, assemble, generate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import hash_embedding
from millrace.operators import retrieval
from millrace.operators.cache import upsert
from millrace.operators.chunk import chunk
from millrace.operators.infer import Infer, echo_stub, infer_udf

Embed = Callable[[Column], Column]
#: Items of a question unless it says otherwise, and tables whose context may join them.
DEFAULT_K, TABLES = 5, 3
#: What is asked of the model; its fields are `context` and `question`.
PROMPT = "Use the passages below to answer.\n\n{context}\n\nQuestion: {question}"


def embedded(chunks: DataFrame, embed: Embed = hash_embedding) -> DataFrame:
    """Chunks (content, embedding if known) with an embedding each: the given one, or that of the content where it is null."""
    known = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<double>")
    return chunks.withColumn("embedding", F.coalesce(known, embed(F.col("content"))))


def add(store: DataFrame, new: DataFrame, embed: Embed = hash_embedding, newest: list[Column] | None = None) -> DataFrame:
    """The store with new chunks; the last write of an id wins: new before old, among new ones by `newest`. Rows without an id are left out."""
    return upsert(store, embedded(new.filter("id IS NOT NULL"), embed), ["id"], newest or [])


def document_chunks(docs: DataFrame, id_col: str, text_col: str, embed: Embed = hash_embedding, **chunking) -> DataFrame:
    """(id, content, document_id, chunk_index, embedding, ...) of documents; a document without an id is named by the MD5 of its text."""
    named = docs.withColumn(id_col, F.coalesce(F.col(id_col), F.md5(F.col(text_col).cast("binary"))))
    return embedded(chunk(named, id_col, text_col, **chunking), embed)


def add_documents(store: DataFrame, docs: DataFrame, id_col: str, text_col: str, embed: Embed = hash_embedding, **chunking) -> tuple[DataFrame, DataFrame]:
    """(the store with the chunks of the documents, one row with the number of documents and chunks)."""
    made = document_chunks(docs, id_col, text_col, embed, **chunking)
    counts = docs.agg(F.count(F.lit(1)).alias("documents")).join(made.agg(F.count(F.lit(1)).alias("chunks")))
    return add(store, made.select(*[c for c in made.columns if c in store.columns]), embed), counts


def table_contexts(questions: DataFrame, catalog: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """(id, tables): for each question (id, question) the context lines of `tables`, in that order, or else of up to TABLES tables whose name or comment holds the whole question.

    `catalog` has (table_name, comment, context), a row per table, which the planner broadcasts by its size.
    """
    if tables is not None:
        order = F.array_position(F.array(*map(F.lit, tables)), F.col("table_name"))
        chosen = catalog.filter(F.col("table_name").isin(tables)).agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "context"))).alias("c"))
        return questions.select("id").join(chosen.select(F.array_join(F.transform("c", lambda x: x["context"]), "\n\n").alias("tables")))
    held = F.contains("table_name", F.col("question")) | F.coalesce(F.contains("comment", F.col("question")), F.lit(False))
    found = questions.filter("question <> ''").join(catalog, held).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("table_name", "context"))), 1, TABLES).alias("c"))
    return found.select("id", F.array_join(F.transform("c", lambda x: x["context"]), "\n\n").alias("tables"))


def retrieve(store: DataFrame, questions: DataFrame, k: int | None = None, embed: Embed = hash_embedding, dim: int = 128, wanted: dict[str, str] | None = None) -> DataFrame:
    """(query_id, item_id, score, place): the k best chunks (DEFAULT_K for None and 0) of each question (id, question), of those with the wanted metadata."""
    items = retrieval.metadata_filter(store, wanted) if wanted else store
    asked = questions.select("id", embed(F.col("question")).alias("embedding"))
    return retrieval.top_k(asked, items, k or DEFAULT_K, dim)


def answers(store: DataFrame, questions: DataFrame, k: int | None = None, embed: Embed = hash_embedding, infer: Infer = echo_stub, dim: int = 128, wanted: dict[str, str] | None = None, tables: DataFrame | None = None, template: str = PROMPT) -> DataFrame:
    """(id, question, total_results, prompt, answer): retrieve, assemble, generate.

    `tables` (id, tables) adds the context of tables under a heading. A question without
    results is asked with an empty context.
    """
    found = retrieval.context(retrieve(store, questions, k, embed, dim, wanted), store)
    rows = questions.select("id", "question").join(found.withColumnRenamed("query_id", "id"), "id", "left")
    context = F.coalesce("context", F.lit(""))
    if tables is not None:
        rows = rows.join(tables, "id", "left")
        context = F.when(F.coalesce("tables", F.lit("")) != "", F.concat(context, F.lit("\n\n## Database Context:\n\n"), F.col("tables"))).otherwise(context)
    before, middle = template.split("{context}", 1)
    middle, after = middle.split("{question}", 1)
    prompt = F.concat(F.lit(before), context, F.lit(middle), F.coalesce("question", F.lit("")), F.lit(after))
    rows = rows.select("id", "question", F.coalesce("total_results", F.lit(0)).alias("total_results"), prompt.alias("prompt"))
    return rows.withColumn("answer", infer_udf(infer)(F.col("prompt")))
