"""Copies that differ only in white space, case, punctuation or field order (problem 5).

Each record gets canonical bytes. The buckets of a radix partition on these bytes are split
by further bytes until each fits, those only that don't, and every bucket is counted in a
trie whose terminal nodes hold the number of copies and the smallest id.

Canonical bytes travel once per task and form, and only to their bucket; ids travel with a
128-bit digest of the bytes. That a digest stands for one form is checked in the trie.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import write_once
from millrace.session import load

#: Forms (each counted once a task) and bytes that one bucket may hold before it is split by further bytes.
BUCKET_ROWS, BUCKET_BYTES = 20_000, 64 << 20
#: Leading bytes of the first buckets; each split doubles them.
FIRST_BYTES = 8
#: Copies of one group that one task may attach to their first member; larger groups are salted.
GROUP_ROWS = 50_000
#: Forms a task remembers before it starts afresh.
MEMO_FORMS = 1_000_000

NOT_ALNUM = re.compile(r"[\W_]+")
QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "﻿": " ", "​": " "})
FIELD_NAME = re.compile(r"[^\w{}\[\]]*([^\W\d_][\w .\-–]*)")


def letters_and_digits(text: str) -> str:
    """Letters and digits only, without case; composed, so that é is one letter however it is written."""
    return NOT_ALNUM.sub("", unicodedata.normalize("NFC", text).casefold())


def _json_form(value: object) -> str:
    if isinstance(value, Pairs):
        return "{" + "\x1e".join(sorted(letters_and_digits(k) + "\x1f" + _json_form(v) for k, v in value)) + "}"
    if isinstance(value, list):
        return "".join(map(_json_form, value))
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return letters_and_digits(str(value))


class Pairs(list):
    """The members of a JSON object, repeats included."""


def _as_json(text: str) -> Pairs | None:
    a, b = text.find("{"), text.rfind("}")
    if a < 0 or b < a or letters_and_digits(text[:a]) or letters_and_digits(text[b + 1 :]):
        return None
    body = text[a : b + 1].translate(QUOTES)
    for tried in (body, re.sub(r",(\s*[}\]])", r"\1", body), body.casefold()):
        try:
            found = json.loads(tried, strict=False, object_pairs_hook=Pairs, parse_int=str, parse_float=str)
        except ValueError:
            continue
        return found if isinstance(found, Pairs) and found else None
    return None


def _as_fields(text: str) -> Pairs | None:
    """`name: value` fields, one per line or split by ; or |; at least two, or it is prose with a colon."""
    for split in (r"[\r\n]+", r"[;|]", r"[\r\n;|]+"):
        parts = [p for p in re.split(split, text) if letters_and_digits(p)]
        if len(parts) < 2:
            continue
        fields = [(FIELD_NAME.fullmatch(name.rstrip()), mark, value) for name, mark, value in (p.partition(":") for p in parts)]
        if all(name and mark and not value.startswith("//") for name, mark, value in fields):
            return Pairs((name.group(1), value) for name, _, value in fields)
    return None


def canonical(prompt: str | None, key: str | None = None, model: str | None = None) -> bytes:
    """Equal exactly for copies. Model null is a model of its own; a withheld prompt is replaced by the key."""
    kind, text = "p", prompt
    if text is not None and text.strip() == "[not logged]":
        kind, text = "k", key
    if text is None:
        form = "\x00"
    else:
        pairs = _as_json(text) or _as_fields(text)
        form = _json_form(pairs) if pairs else letters_and_digits(text)
    return "\x00".join((form, kind, "\x01" if model is None else model)).encode("utf-8", "surrogatepass")


class Trie:
    """A path-compressed byte trie; `add` returns the terminal, [copies, smallest id]."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: bytes) -> list:
        node, at = self.root, 0
        while True:
            if at == len(word):
                return node.setdefault(-1, [0, None])
            edge = node.get(word[at])
            if edge is None:
                node[word[at]] = (word[at:], made := {-1: [0, None]})
                return made[-1]
            label, below = edge
            if word.startswith(label, at):
                node, at = below, at + len(label)
                continue
            n = 1
            while at + n < len(word) and n < len(label) and word[at + n] == label[n]:
                n += 1
            node[word[at]] = (label[:n], split := {label[n]: (label[n:], below)})
            node, at = split, at + n


def counted(forms: list[tuple[bytes, bytes]], parts: list[tuple[bytes, str, int]]) -> list[tuple[bytes, str, int]]:
    """(digest, smallest id, copies) of the forms (digest, form) of a bucket, from partial counts (digest, smallest id, copies)."""
    trie, ends = Trie(), {}
    for digest, form in forms:
        end = trie.add(form)
        if ends.setdefault(digest, end) is not end:
            raise ValueError("two canonical forms have one digest")
    for digest, name, n in parts:
        end = ends[digest]
        end[0] += n
        if end[1] is None or name < end[1]:
            end[1] = name
    return [(digest, end[1], end[0]) for digest, end in ends.items() if end[0]]


def canonical_rows(entries: DataFrame, id_col: str, prompt_col: str, key_col: str, model_col: str) -> DataFrame:
    """(id, digest, form) of the rows with an id; the form, canonical bytes, only with its first row in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, forms = [], []
            for prompt, key, model in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                form = canonical(prompt, key, model)
                digests.append(xxhash.xxh3_128_digest(form))
                new = digests[-1] not in seen
                if new:
                    if len(seen) >= MEMO_FORMS:
                        seen.clear()
                    seen.add(digests[-1])
                forms.append(form if new else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(forms, pa.binary())], names=["id", "digest", "form"])

    rows = entries.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), F.col(key_col).alias("key"), F.col(model_col).alias("model"))
    return rows.filter("id is not null").mapInArrow(run, "id string, digest binary, form binary")


def radix_prefixes(canon: DataFrame, rows: int | None = None, size: int | None = None) -> set[bytes]:
    """Prefixes whose forms are over BUCKET_ROWS or BUCKET_BYTES and go on behind them: these are split by as many bytes more.

    A round counts the forms of the prefixes that the round before found too large, so only
    they are read; after log2(longest form / FIRST_BYTES) rounds at most nothing is left to
    split. At most forms / BUCKET_ROWS prefixes of a round come to the driver.
    """
    rows, size = rows or BUCKET_ROWS, size or BUCKET_BYTES
    spark = canon.sparkSession
    left, depth, found = canon.filter("form is not null").select("form"), FIRST_BYTES, set()
    while True:
        prefix = F.expr(f"substring(form, 1, {depth})").alias("prefix")
        sizes = left.groupBy(prefix).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("form").cast("long")).alias("bytes"), F.max(F.length("form")).alias("longest"))
        heavy = [bytes(r.prefix) for r in sizes.filter((F.col("longest") > depth) & (F.col("n") > 1) & ((F.col("n") > rows) | (F.col("bytes") > size))).select("prefix").collect()]
        if not heavy:
            return found
        found.update(heavy)
        chosen = spark.createDataFrame([(bytearray(p),) for p in heavy], "prefix binary")
        left = left.join(chosen, F.expr(f"substring(form, 1, {depth})") == F.col("prefix"), "left_semi")
        depth *= 2


def bucket(form: bytes, heavy: set[bytes]) -> int:
    """The bucket of a form: the hash of as many leading bytes as its radix path has."""
    depth = FIRST_BYTES
    while form[:depth] in heavy and len(form) > depth:
        depth *= 2
    return xxhash.xxh3_64_intdigest(form[:depth], depth) - (1 << 63)


def count_copies(canon: DataFrame, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, counts) of written `canonical_rows`: members has (id, digest) of each id once, counts (digest, first_id, copies) of each form."""
    shared = canon.sparkSession.sparkContext.broadcast(radix_prefixes(canon, rows))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[bytes, int] = {}  # a form stands before the rows of its task that lack it
        for batch in batches:
            names = []
            for digest, form in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if form is not None:
                    if len(at) >= MEMO_FORMS:
                        at.clear()
                    at[digest] = bucket(form, shared.value)
                names.append(at[digest])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=["id", "digest", "form", "bucket"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch one row a form: a hot form is counted before it is shuffled."""
        for batch in batches:
            parts: dict[bytes, list] = {}
            for name, digest, number in zip(*(c.to_pylist() for c in batch.columns)):
                own = parts.setdefault(digest, [number, name, 0])
                own[2] += 1
                if name < own[1]:
                    own[1] = name
            columns = [pa.array([p[0] for p in parts.values()], pa.int64()), pa.array(parts, pa.binary()), pa.nulls(len(parts), pa.binary()), pa.array([p[1] for p in parts.values()], pa.string()), pa.array([p[2] for p in parts.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "digest", "form", "first_id", "copies"])

    def tried(table: pa.Table) -> pa.Table:
        forms, parts = [], []
        for digest, form, name, n in zip(*(table.column(c).to_pylist() for c in ("digest", "form", "first_id", "copies"))):
            if form is None:
                parts.append((digest, name, n))
            else:
                forms.append((digest, form))
        out = counted(forms, parts)
        return pa.table({"digest": pa.array([r[0] for r in out], pa.binary()), "first_id": pa.array([r[1] for r in out], pa.string()), "copies": pa.array([r[2] for r in out], pa.int64())})

    placed = canon.mapInArrow(bucketed, "id string, digest binary, form binary, bucket bigint")
    members = write_once(placed.select("id", "digest", "bucket").distinct())
    forms = placed.filter("form is not null").select("bucket", "digest", "form", F.lit(None).cast("string").alias("first_id"), F.lit(0).cast("long").alias("copies"))
    parts = members.mapInArrow(combined, "bucket bigint, digest binary, form binary, first_id string, copies bigint")
    counts = forms.unionByName(parts).groupBy("bucket").applyInArrow(tried, "digest binary, first_id string, copies bigint")
    return members.select("id", "digest"), write_once(counts)


def attach(members: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, first_id, copies) of the members of groups of two and more; groups over GROUP_ROWS are salted on both sides."""
    groups = counts.filter("copies > 1").withColumn("salts", F.ceil(F.col("copies") / GROUP_ROWS).cast("int"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # At most rows / GROUP_ROWS hot groups; the planner decides by their size whether to broadcast.
    hot = counts.filter(F.col("copies") > GROUP_ROWS).select("digest", F.ceil(F.col("copies") / GROUP_ROWS).cast("int").alias("hot_salts"))
    if not hot.isEmpty():
        members = members.join(hot, "digest", "left").select("id", "digest", F.pmod(F.xxhash64("id"), F.coalesce("hot_salts", F.lit(1))).cast("int").alias("salt"))
    else:
        members = members.withColumn("salt", F.lit(0))
    return members.join(groups, ["digest", "salt"]).select("id", "first_id", "copies")


def cache_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = load(spark, sf_dir, "cache_entries", ["entry_id", "prompt", "key", "model"])
    return count_copies(write_once(canonical_rows(entries, "entry_id", "prompt", "key", "model")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): id_b is a copy of id_a, the smallest entry_id of its group."""
    return attach(*cache_copies(spark, sf_dir)).filter("id <> first_id").select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))


def p5_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per request and the number of its copies, itself included."""
    return cache_copies(spark, sf_dir)[1].select(F.col("first_id").alias("entry_id"), "copies")


QUERIES = {"p5_found": p5_found, "p5_requests": p5_requests}

_BARE = "regexp_replace(lower(nfc_normalize({})), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_FIELD = "'^[^\\p{L}\\p{N}_{}\\[\\]]*\\p{L}[\\p{L}\\p{N}_ .–-]*\\s*:([^/]|/[^/]|/$|$)'"


def _fields(split: str) -> str:
    """The sorted name and value of all parts, or null if a part is no field or there are fewer than two."""
    parts = f"list_filter(string_split_regex(t, '{split}'), lambda p: {_BARE.format('p')} <> '')"
    name, value = _BARE.format("split_part(p, ':', 1)"), _BARE.format("substr(p, instr(p, ':') + 1)")
    return f"CASE WHEN len({parts}) >= 2 AND len(list_filter({parts}, lambda p: NOT regexp_matches(p, {_FIELD}))) = 0 THEN array_to_string(list_sort(list_transform({parts}, lambda p: {name} || chr(31) || {value})), chr(30)) END"


#: The forms of flat JSON objects, fields and other texts in SQL, and the groups of equal ones.
_GROUPS = (
    "WITH e AS (SELECT DISTINCT ON (entry_id) entry_id, model, coalesce(trim(prompt) = '[not logged]', false) AS held, CASE WHEN trim(prompt) = '[not logged]' THEN key ELSE prompt END AS t FROM cache_entries), "
    "q AS (SELECT *, regexp_extract(translate(t, '“”„', '\"\"\"'), '(?s)\\{.*\\}') AS body FROM e), "
    f"j AS (SELECT *, CASE WHEN body <> '' AND json_valid(body) AND {_BARE.format("replace(translate(t, '“”„', '\"\"\"'), body, '')")} = '' THEN array_to_string(list_sort(list_transform(json_keys(body), lambda k: {_BARE.format('k')} || chr(31) || {_BARE.format("json_extract_string(body, '$.\"' || k || '\"')")})), chr(30)) END AS object FROM q), "
    f"f AS (SELECT entry_id, model, held, coalesce('{{' || coalesce(object, {_fields('[\\r\\n]+')}, {_fields('[;|]')}, {_fields('[\\r\\n;|]+')}) || '}}', {_BARE.format('t')}) AS form, t IS NULL AS gone FROM j), "
    "g AS (SELECT entry_id, min(entry_id) OVER w AS first_id, count(*) OVER w AS copies FROM f WINDOW w AS (PARTITION BY model, held, gone, form)) "
)
ORACLES = {
    "p5_found": _GROUPS + "SELECT first_id AS id_a, entry_id AS id_b FROM g WHERE first_id <> entry_id",
    "p5_requests": _GROUPS + "SELECT entry_id, copies FROM g WHERE entry_id = first_id",
}
