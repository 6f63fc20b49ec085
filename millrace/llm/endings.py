"""Texts cut by field limits or in transfer (problem 2).

Lengths are counted under several encodings per source; a length at which far more texts
end than near it is a hidden storage limit of that encoding. A text is cut if its ending
breaks off: an open code fence, an open JSON value, an unfinished table row or list item,
or prose that stops inside a word or sentence. Being exactly as long as a limit settles
endings that could be either.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import write_once
from millrace.session import load

WITHHELD = "[not logged]"
#: A limit is a length of at least SHORTEST at which at least LEAST texts end, and TIMES as many as at its neighbours on average.
SHORTEST, LEAST, TIMES, REACH = 48, 8, 6, 12

#: Marks that stand for a cut, and phrases after which an ellipsis is none.
CUT_MARK = re.compile(r"(?:\.\.\.|…)?\s*[\[(<]\s*(?:truncated|cut off|cut|snip|snipped|output truncated|gekürzt|abgeschnitten|tronqué|truncado|recortado)\s*[\])>]\s*$", re.IGNORECASE)
AND_SO_ON = re.compile(r"(?:and so on|and so forth|etc\.?|und so weiter|usw\.?|et ainsi de suite|y así sucesivamente)\s*(?:…|\.\.\.)$", re.IGNORECASE)
SENTENCE_END = re.compile(r"""[.!?。！？؟][\s"'”’»›)\]*_`]*$""")
INNER_END = re.compile(r"""[.!?。！？][”"»')\]]*\s+\S""")
NUMBER_CUT = re.compile(r"\b(?:version|v\.?|versión|Version)\s+\d+\.$")
BULLET = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])(?:\s+|$)")
PIECE = re.compile(r"[^\W\d_]+")
ALNUM = re.compile(r"[\W_]+")
LETTER = re.compile(r"[^\W_]")
ENCODINGS = ("chars", "utf8", "utf16", "crlf", "json", "json_utf8", "json_ascii", "html", "html_quotes", "html_utf8")


def encoded_length(text: str, encoding: str) -> int:
    """Length of `text` as stored under an encoding or escaping."""
    if encoding == "chars":
        return len(text)
    if encoding == "utf8":
        return len(text.encode("utf-8", "surrogatepass"))
    if encoding == "utf16":
        return len(text.encode("utf-16-le", "surrogatepass")) // 2
    if encoding == "crlf":
        return len(text) + text.count("\n")
    escapes = text.count('"') + text.count("\\") + text.count("\n") + text.count("\t") + text.count("\r")
    if encoding == "json":
        return len(text) + escapes
    if encoding == "json_utf8":
        return encoded_length(text, "utf8") + escapes
    if encoding == "json_ascii":
        plain = len(text.encode("ascii", "ignore"))
        return plain + escapes + 6 * (encoded_length(text, "utf16") - plain)
    angles = 4 * text.count("&") + 3 * (text.count("<") + text.count(">"))
    if encoding == "html":
        return len(text) + angles
    if encoding == "html_quotes":
        return len(text) + angles + 5 * text.count('"')
    return encoded_length(text, "utf8") + angles


def encoded_lengths(text: str) -> tuple[int, ...]:
    """`encoded_length` under all ENCODINGS, in their order."""
    chars = len(text)
    count = text.count
    newlines, quotes = count("\n"), count('"')
    escapes = quotes + newlines + count("\\") + count("\t") + count("\r")
    angles = 4 * count("&") + 3 * (count("<") + count(">"))
    utf8 = utf16 = plain = chars
    if not text.isascii():
        utf8, utf16 = len(text.encode("utf-8", "surrogatepass")), len(text.encode("utf-16-le", "surrogatepass")) // 2
        plain = len(text.encode("ascii", "ignore"))
    return chars, utf8, utf16, chars + newlines, chars + escapes, utf8 + escapes, plain + escapes + 6 * (utf16 - plain), chars + angles, chars + angles + 5 * quotes, utf8 + angles


def text_statistics(calls: DataFrame) -> DataFrame:
    """(source, field, encoding, length, word, texts): texts per source, field, encoding and length, and words that end whole list items.

    One pass over the texts, summed per task and then over all, written once. Withheld texts
    do not count; a null source is ''. Rows of words have a null encoding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths: dict[tuple[str, str], list[Counter]] = {}
        words: Counter = Counter()
        for batch in batches:
            sources = batch.column(0).to_pylist()
            for k, field in ((1, "prompt"), (2, "response")):
                for source, text in zip(sources, batch.column(k).to_pylist()):
                    if text is None or text == WITHHELD:
                        continue
                    own = lengths.get((source, field)) or lengths.setdefault((source, field), [Counter() for _ in ENCODINGS])
                    for counter, n in zip(own, encoded_lengths(text)):
                        counter[n] += 1
                    at = text.rfind("\n")
                    if at >= 0 and BULLET.match(text[at + 1 : at + 12]):
                        for line in text[:at].split("\n"):
                            if BULLET.match(line) and (pieces := PIECE.findall(line)):
                                words[pieces[-1].lower()] += 1
        out = [(source or "", field, e, n, None, c) for (source, field), own in lengths.items() for e, counter in zip(ENCODINGS, own) for n, c in counter.items()]
        out += [(None, None, None, None, w, c) for w, c in words.items()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["source", "field", "encoding", "length", "word", "texts"])

    rows = calls.select("source", "prompt", "response").mapInArrow(run, "source string, field string, encoding string, length int, word string, texts bigint")
    return write_once(rows.groupBy("source", "field", "encoding", "length", "word").agg(F.sum("texts").alias("texts")))


def hidden_limits(statistics: DataFrame) -> DataFrame:
    """(source, field, encoding, length, texts, near): lengths at which a source's texts pile up.

    A range frame over the counts of `text_statistics`. Encodings that agree (most texts are
    plain ASCII) show the same pile; `limits_by_source` merges them.
    """
    counts = statistics.filter("encoding is not null").drop("word")
    around = W.partitionBy("source", "field", "encoding").orderBy("length").rangeBetween(-REACH, REACH)
    counts = counts.withColumn("near", (F.sum("texts").over(around) - F.col("texts")) / (2 * REACH))
    piles = counts.filter((F.col("length") >= SHORTEST) & (F.col("texts") >= LEAST) & (F.col("texts") >= TIMES * F.col("near")))
    rank = W.partitionBy("source", "field").orderBy(F.desc("texts"), F.array_position(F.array(*map(F.lit, ENCODINGS)), F.col("encoding")), "length")
    return piles.withColumn("strength", F.row_number().over(rank))


def pile_members(calls: DataFrame, piles: dict[tuple[str, str], list[tuple[str, int]]]) -> DataFrame:
    """(source, field, hit, texts): texts by the piles (numbers in the list of their source and field) that they belong to."""
    at: dict = {}
    for key, own in piles.items():
        for number, (encoding, n) in enumerate(own):
            at.setdefault(key, [{} for _ in ENCODINGS])[ENCODINGS.index(encoding)][n] = number
    shared = calls.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            sources = batch.column(0).to_pylist()
            for k, field in ((1, "prompt"), (2, "response")):
                for source, text in zip(sources, batch.column(k).to_pylist()):
                    own = shared.value.get((source or "", field))
                    if own is None or text is None or text == WITHHELD:
                        continue
                    hit, split = [], not text.isascii()
                    for encoding, numbers, n in zip(ENCODINGS, own, encoded_lengths(text)):
                        if numbers:
                            hit += [numbers[m] for m in range(n, n + (4 if split and "utf8" in encoding else 1)) if m in numbers]
                    if hit:
                        found[source or "", field, tuple(sorted(hit))] += 1
        rows = list(found.items())
        columns = [pa.array([key[0] for key, _ in rows], pa.string()), pa.array([key[1] for key, _ in rows], pa.string()), pa.array([key[2] for key, _ in rows], pa.list_(pa.int32())), pa.array([n for _, n in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["source", "field", "hit", "texts"])

    rows = calls.select("source", "prompt", "response").mapInArrow(run, "source string, field string, hit array<int>, texts bigint")
    return rows.groupBy("source", "field", "hit").agg(F.sum("texts").alias("texts"))


def limits_by_source(calls: DataFrame, limits: DataFrame) -> dict[tuple[str, str], list[tuple[str, int]]]:
    """The limits of each source and field, strongest first, however many.

    A pile is a limit if it still is a pile without the texts that stronger limits explain:
    so one limit under several encodings counts once, and neighbouring limits all stay.
    """
    piles: dict = {}
    for r in limits.orderBy("source", "field", "strength").collect():
        piles.setdefault((r.source, r.field), []).append((r.encoding, r.length, r.near))
    if not piles:
        return {}
    hits: dict = {}
    for r in pile_members(calls, {key: [(e, n) for e, n, _ in own] for key, own in piles.items()}).collect():
        hits.setdefault((r.source, r.field), []).append((r.hit, r.texts))
    chosen: dict = {}
    for key, own in piles.items():
        left = Counter()
        of_pile: dict = {}
        for row, (hit, texts) in enumerate(hits.get(key, [])):
            for number in hit:
                left[number] += texts
                of_pile.setdefault(number, []).append(row)
        open_rows = set(range(len(hits.get(key, []))))
        while left:
            best = min(left, key=lambda number: (-left[number], number))
            n = left.pop(best)
            if n < max(LEAST, TIMES * own[best][2]):
                continue
            chosen.setdefault(key, []).append(own[best][:2])
            for row in of_pile[best]:
                if row in open_rows:
                    open_rows.discard(row)
                    for number in hits[key][row][0]:
                        if number in left:
                            left[number] -= hits[key][row][1]
    return chosen


def evidence(calls: DataFrame) -> tuple[dict[tuple[str, str], list[tuple[str, int]]], DataFrame]:
    """The limits by source and field, and the table (word) of the words that end a list item that another line follows (such items are whole)."""
    statistics = text_statistics(calls)
    return limits_by_source(calls, hidden_limits(statistics)), statistics.filter("word is not null").select("word")


class Asked:
    """Stands for the words that end whole list items: notes the word that a verdict hangs on, and takes it for one of them."""

    word: str | None = None

    def __contains__(self, word: str) -> bool:
        self.word = word
        return True


def unknown_items(asked: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of `asked` (call_id, field, word) whose word ends no whole list item: their texts are cut."""
    return asked.filter("word is not null").join(words, "word", "left_anti").select("call_id", "field")


def open_delimiters(text: str) -> bool:
    """Whether a JSON text ends with a bracket or string still open."""
    depth, inside, at, n = 0, False, 0, len(text)
    while at < n:
        c = text[at]
        if inside:
            if c == "\\":
                at += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        at += 1
    return inside or depth > 0


def is_cut(text: str | None, at_limit: bool, item_ends: frozenset[str] | Asked | None = None, copied_from: str | None = None) -> bool:
    """Whether a text breaks off.

    `at_limit`: it is as long as a hidden limit. `item_ends`: words that end whole list
    items; None if unknown. `copied_from`: a text (the prompt) whose end, given back without
    its last mark, is no cut.
    """
    if text is None or text == WITHHELD:
        return False
    body = text.rstrip()
    if not LETTER.search(body):
        return False
    if CUT_MARK.search(body[-48:]):
        return True
    if body.count("```") % 2:
        return True
    if body.endswith("```"):
        return False
    if body.endswith(("…", "...")):
        return not AND_SO_ON.search(body[-48:])
    head = body.lstrip()
    if head[0] in "{[" and not re.match(r"\[/?[A-Za-z_ ]+\]", head):
        return open_delimiters(head)
    lines = body.split("\n")
    last = lines[-1]
    if last.lstrip().startswith("|"):
        header = next((x for x in lines if x.lstrip().startswith("|")), last)
        return not last.endswith("|") or last.count("|") < header.count("|")
    block = next((k for k in range(len(lines) - 1, -1, -1) if lines[k][:1] in ("{", "[")), None)
    if block is not None and block > 0 and '"' in "".join(lines[block:]) and re.match(r'[{\[]\s*(["{\[]|$)', lines[block]):
        return open_delimiters("\n".join(lines[block:]))
    if BULLET.match(last) and not re.search(r"\w", BULLET.sub("", last)):
        return True
    if SENTENCE_END.search(body[-16:]):
        return at_limit and bool(NUMBER_CUT.search(body[-24:]))
    if BULLET.match(last):
        pieces = PIECE.findall(BULLET.sub("", last))
        return at_limit or bool(pieces) and item_ends is not None and pieces[-1].lower() not in item_ends
    if at_limit:
        return True
    if not re.search(r"\w\W*$", body[-3:]) or body[-1] in "”»\"'✅)":
        return False
    if copied_from is not None:
        tail = ALNUM.sub("", body.casefold())[-60:]
        if len(tail) >= 12 and ALNUM.sub("", copied_from.casefold()).endswith(tail):
            return False
    if INNER_END.search(body):
        return True
    words = last.split()
    first = words[0].lstrip("¿¡\"'([{*_`>#")
    least = 3 if copied_from is not None else 2
    prose = first[:1].isupper() and len(words) >= least and not re.match(r"(?i)(yes|no|ja|nein|oui|non|sí|true|false|done)\b", first)
    return prose and not re.match(r"[A-Z_]+\b.*=", last)


def with_cuts(calls: DataFrame) -> DataFrame:
    """(call_id, source, cut_prompt, cut_response) of each call once.

    Three passes over the two text columns; texts are never shuffled, only their verdicts.
    Where the last word of a list item decides, it is joined to the words of all whole items.
    Rows without a call_id take no part in pairs but do in the statistics of lengths.
    """
    calls = calls.select("call_id", "source", "prompt", "response")
    spark = calls.sparkSession
    limits, words = evidence(calls)
    shared = spark.sparkContext.broadcast(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = shared.value
        for batch in batches:
            out = []
            for source, prompt, response in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                p, r = Asked(), Asked()
                cut = is_cut(prompt, at_limit(prompt, limits.get((source or "", "prompt"))), p)
                out.append((cut, is_cut(response, at_limit(response, limits.get((source or "", "response"))), r, prompt), p.word, r.word))
            columns = [pa.array([row[k] for row in out], pa.bool_() if k < 2 else pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["call_id", "source", "cut_prompt", "cut_response", "prompt", "response"])

    verdicts = calls.mapInArrow(run, "call_id bigint, source string, cut_prompt boolean, cut_response boolean, prompt string, response string")
    verdicts = write_once(verdicts.filter("call_id is not null").dropDuplicates(["call_id"]))
    asked = verdicts.select("call_id", F.lit("prompt").alias("field"), F.col("prompt").alias("word")).union(verdicts.select("call_id", F.lit("response"), "response"))
    late = unknown_items(asked, words).groupBy("call_id").agg(*(F.max(F.col("field") == field).alias(f"late_{field}") for field in ("prompt", "response")))
    cuts = [(F.col(f"cut_{field}") | F.coalesce(f"late_{field}", F.lit(False))).alias(f"cut_{field}") for field in ("prompt", "response")]
    return verdicts.join(late, "call_id", "left").select("call_id", "source", *cuts)


def at_limit(text: str | None, limits: list[tuple[str, int]] | None) -> bool:
    """Whether a text is as long as a limit, or too short for one more character of two to four bytes."""
    if not limits or text is None:
        return False
    for encoding, n in limits:
        if not len(text) <= n <= 12 * len(text):  # no encoding shortens a text or makes more of a character
            continue
        length = encoded_length(text, encoding)
        if length == n or (n - 3 <= length < n and "utf8" in encoding and not text.isascii()):
            return True
    return False


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "llm_calls")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, field) of each cut text."""
    cuts = with_cuts(llm_calls(spark, sf_dir))
    fields = F.array_compact(F.array(F.when(F.col("cut_prompt"), F.lit("prompt")), F.when(F.col("cut_response"), F.lit("response"))))
    return cuts.filter("cut_prompt or cut_response").select("call_id", F.explode(fields).alias("field"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the calls and the shares of them whose prompt, and whose response, was cut."""
    cuts = with_cuts(llm_calls(spark, sf_dir))
    return cuts.groupBy("source").agg(F.count(F.lit(1)).alias("calls"), F.avg(F.col("cut_prompt").cast("int")).alias("prompt_share"), F.avg(F.col("cut_response").cast("int")).alias("response_share"))


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which texts of a source pile up, per encoding: the evidence for hidden limits."""
    return hidden_limits(text_statistics(llm_calls(spark, sf_dir))).select("source", "field", "encoding", "length", "texts", "near")


QUERIES = {"p2_found": p2_found, "p2_shares": p2_shares, "p2_limits": p2_limits}
