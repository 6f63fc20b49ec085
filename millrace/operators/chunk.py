"""Chunkers: one row per document in, one row per chunk out, as ordered folds inside the JVM.

Output: (id, content, document_id, chunk_index, metadata) and, for fixed size, start_char
and end_char. A null document gives no chunk, an empty one none either, but for sentences,
where it gives one empty chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip

LOOK_BACK = 50


def _rows(df: DataFrame, pieces: Column, id_col: str, metadata_col: str | None) -> DataFrame:
    extra = [F.col(f"`{metadata_col}`").alias("metadata")] if metadata_col else []
    wide = df.select(F.col(f"`{id_col}`").alias("document_id"), *extra, F.posexplode(pieces).alias("chunk_index", "piece"))
    return wide.withColumn("id", F.concat(F.col("document_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))


def fixed_size(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100, metadata_col: str | None = None) -> DataFrame:
    """Slices of `size` characters, cut back to a blank or newline within LOOK_BACK, each beginning `overlap` before the last one's end.

    The end offset of the last slice is not clipped to the text. Every step must advance:
    size - overlap below LOOK_BACK is refused.
    """
    if size - overlap < LOOK_BACK:
        raise ValueError(f"size - overlap must be at least {LOOK_BACK}")
    text = F.col(f"`{text_col}`")
    length = F.length(text)
    back = min(LOOK_BACK, size)

    def step(state: Column, _: Column) -> Column:
        start, cuts = state["start"], state["cuts"]
        end = start + size
        tail = F.substring(text, end + 2 - back, F.lit(back))  # the characters at indexes end - back + 1 to end
        at = F.length(F.regexp_extract(tail, r"(?s)^(.*[ \n])", 1))
        stop = F.when((end < length) & (at > 0), end - back + at).otherwise(end)
        moved = F.struct((stop - overlap).cast("int").alias("start"), F.concat(cuts, F.array(F.struct(start.alias("start"), stop.cast("int").alias("end")))).alias("cuts"))
        return F.when(start < length, moved).otherwise(state)

    first = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("cuts"))
    steps = F.sequence(F.lit(0), F.ceil(length / (size - overlap - back + 1)).cast("int"))
    cuts = F.aggregate(steps, first, step)["cuts"]
    sliced = F.transform(cuts, lambda c: F.struct(strip(F.substring(text, c["start"] + 1, c["end"] - c["start"])).alias("content"), c["start"].alias("start"), c["end"].alias("end")))
    pieces = F.filter(sliced, lambda c: F.length(c["content"]) > 0)
    out = _rows(df.filter(text.isNotNull()), pieces, id_col, metadata_col)
    keep = ["metadata"] if metadata_col else []
    return out.select("id", F.col("piece.content").alias("content"), "document_id", "chunk_index", F.col("piece.start").alias("start_char"), F.col("piece.end").alias("end_char"), *keep)


def _packed(parts: Column, size: int, overlap: int, joint: str) -> Column:
    """Greedy packing of parts into chunks of at most `size` characters, joints not counted; trailing parts of up to `overlap` are carried on."""
    empty = F.array().cast("array<string>")

    def carried(current: Column) -> Column:
        if not overlap:
            return F.struct(empty.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("go"))
        start = F.struct(empty.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("go"))

        def back(s: Column, x: Column) -> Column:
            fits = s["go"] & (s["n"] + F.length(x) <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"), F.when(fits, s["n"] + F.length(x)).otherwise(s["n"]).alias("n"), fits.alias("go"))

        return F.aggregate(F.reverse(current), start, back)

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] + F.length(x) > size) & (F.size(s["current"]) > 0)
        carry = carried(s["current"])
        return F.when(
            full,
            F.struct(F.concat(s["done"], F.array(F.array_join(s["current"], joint))).alias("done"), F.concat(carry["kept"], F.array(x)).alias("current"), (carry["n"] + F.length(x)).alias("n")),
        ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["current"], F.array(x)).alias("current"), (s["n"] + F.length(x)).alias("n")))

    first = F.struct(empty.alias("done"), empty.alias("current"), F.lit(0).alias("n"))
    return F.aggregate(parts, first, step, lambda s: F.when(F.size(s["current"]) > 0, F.concat(s["done"], F.array(F.array_join(s["current"], joint)))).otherwise(s["done"]))


def sentences(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100, metadata_col: str | None = None) -> DataFrame:
    """Whole sentences packed up to `size`; a longer sentence stays whole; trailing sentences of up to `overlap` open the next chunk."""
    text = F.col(f"`{text_col}`")
    pieces = _packed(F.split(text, r"(?U)(?<=[.!?])\s+"), size, overlap, " ")
    return _plain(_rows(df.filter(text.isNotNull()), pieces, id_col, metadata_col), metadata_col)


def paragraphs(df: DataFrame, id_col: str, text_col: str, size: int = 1000, metadata_col: str | None = None, separator: str = "\n\n") -> DataFrame:
    """Paragraphs packed up to `size`, blank ones dropped; no overlap."""
    text = F.col(f"`{text_col}`")
    parts = F.filter(F.transform(F.split(text, separator), strip), lambda p: F.length(p) > 0)
    return _plain(_rows(df.filter(text.isNotNull()), _packed(parts, size, 0, separator), id_col, metadata_col), metadata_col)


def _plain(out: DataFrame, metadata_col: str | None) -> DataFrame:
    return out.select("id", F.col("piece").alias("content"), "document_id", "chunk_index", *(["metadata"] if metadata_col else []))


def chunk(df: DataFrame, id_col: str, text_col: str, strategy: str = "fixed_size", size: int = 1000, overlap: int = 100, metadata_col: str | None = None) -> DataFrame:
    """Dispatch by strategy: fixed_size, sentence, paragraph, semantic (an alias of paragraph)."""
    if strategy == "fixed_size":
        return fixed_size(df, id_col, text_col, size, overlap, metadata_col)
    if strategy == "sentence":
        return sentences(df, id_col, text_col, size, overlap, metadata_col)
    if strategy in ("paragraph", "semantic"):
        return paragraphs(df, id_col, text_col, size, metadata_col)
    raise ValueError(f"unknown strategy {strategy}")


def register_table_function(spark, name: str = "paragraph_chunks") -> None:
    """A table function for SQL: LATERAL paragraph_chunks(text, size) gives (chunk_index, content).

    It runs in Python, a row at a time; whole tables are better off with `paragraphs`.
    """

    @F.udtf(returnType="chunk_index int, content string")
    class Paragraphs:
        def eval(self, text: str, size: int):
            held, n, at = [], 0, 0
            for part in (p.strip() for p in (text or "").split("\n\n")):
                if part and held and n + len(part) > size:
                    yield at, "\n\n".join(held)
                    held, n, at = [], 0, at + 1
                if part:
                    held.append(part)
                    n += len(part)
            if held:
                yield at, "\n\n".join(held)

    spark.udtf.register(name, Paragraphs)
