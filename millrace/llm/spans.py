"""Long exact spans that several documents share (problem 9).

Suffix automata of shards of reference documents tell, for every position of a streamed
document, the longest stretch ending there that a reference holds too, and which references
hold its last `least` characters. Stretches of `least` characters and more that another
document holds are shared spans; they can be measured or removed.

Streaming every document through the automata of all shards would grow with the square of the
corpus, so documents are first routed: of every document the winnowed hashes of its pieces of
`gram(least)` characters are kept, in such a way that any run of `least` characters keeps at
least one, the same in every document that holds the run. A shard is made of documents with a
common hash, an automaton is sent to the tasks of the documents that have the hash, and only
what is near it comes along: windows of `least` characters around the kept pieces. Routing
loses nothing, since every window has a kept piece.

Hashes that the same documents share are one class, so a passage of many pieces is one. A class
is cut into shards of SHARD characters, and the documents that stream through a shard into
parts of STREAMS, so no task grows with the class. A piece that over MEET documents share
(boilerplate shorter than `least`) would route them all to each other; there documents are
routed by the whole windows around the piece instead, however many share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import COUNTERS, count_table, write_once
from millrace.session import load

#: Shortest shared run, in code points.
LEAST = 200
#: Documents with a common hash up to which they are routed by it; more are routed by the windows around it.
MEET = 1000
#: Characters of the references of one shard, and documents that stream through it in one task.
SHARD, STREAMS = 32_000, 10_000
#: Characters of a document whose pieces may belong to one class.
SEGMENT = 4096
#: Characters hashed at once, and characters of a reference that enter an automaton in one piece.
CHUNK, PIECE = 200_000, 8000
#: Bytes of ids up to which they are broadcast to the second reading of the texts.
BROADCAST_BYTES = 8 << 20
FACTOR, MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def gram(least: int) -> int:
    """Characters of a hashed piece: the largest power of two in two thirds of a run."""
    return 1 << (max(1, 2 * least // 3).bit_length() - 1)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the piece of `gram` codes (a power of two) that starts at each position, by doubling."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
    h ^= h >> np.uint64(29)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(pow(FACTOR, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(31)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each `width` values in a row, by doubling."""
    pick = np.minimum if least else np.maximum
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def winnowed(texts: list[str], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the kept pieces of texts that are at least `least` long.

    Of every least - gram(least) + 1 pieces in a row the smallest hash is kept, with all its ties.
    """
    size = gram(least)
    window = least - size + 1
    owners = [k for k, t in enumerate(texts) if len(t) >= least]
    if not owners:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    codes = np.frombuffer("".join(texts[k] for k in owners).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(texts[k]) for k in owners])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = gram_hashes(codes, size)
    low = _sliding(h, window, True)
    inside = np.zeros(len(low) + 1, dtype=np.int32)  # windows that lie in one text
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes - least + 1, -1)
    low[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.zeros(len(low) + 2 * (window - 1), dtype=np.uint64)
    padded[window - 1 : window - 1 + len(low)] = low
    kept = np.flatnonzero((_sliding(padded, window, False)[: len(h)] == h) & (h > 0))
    owner = np.searchsorted(starts, kept, side="right") - 1
    return np.array(owners)[owner], kept - starts[owner], h[kept]


def fingerprints(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, hashes, lows, highs) per document, packed: its kept pieces, once each, with their first and last position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, out = 0, []
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size += len(texts[to])
                    to += 1
                owner, place, hashes = winnowed(texts[at:to], least)
                order = np.lexsort((place, hashes, owner))
                owner, place, hashes = owner[order], place[order], hashes[order]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(owner)]]) - 1 if len(first) else first
                own = owner[first] if len(first) else np.empty(0, dtype=np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
                for a, b in zip(cuts, [*cuts[1:], len(own)]):
                    out.append((names[at + own[a]], hashes[first[a:b]].tobytes(), place[first[a:b]].astype(np.int32).tobytes(), place[last[a:b]].astype(np.int32).tobytes()))
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k else pa.int64()) for k in range(4)], names=["doc", "hashes", "lows", "highs"])

    return docs.filter(F.col("text").isNotNull() & (F.length("text") >= least)).select("doc", "text").mapInArrow(run, "doc bigint, hashes binary, lows binary, highs binary")


def routed(prints: DataFrame, table: np.ndarray) -> DataFrame:
    """(hash, doc, low, high, hot): a row per kept piece; hot where over MEET documents may have it."""
    shared = prints.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            hashes = np.frombuffer(b"".join(packed), dtype=np.uint64)
            low, high = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.int32) for k in (2, 3))
            docs = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in packed])
            counts = shared.value[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
            several = counts > 1  # no other document has the rest
            columns = [pa.array(hashes.view(np.int64)[several]), pa.array(docs[several]), pa.array(low[several]), pa.array(high[several]), pa.array(counts[several] > MEET)]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "doc", "low", "high", "hot"])

    return prints.mapInArrow(run, "hash bigint, doc bigint, low int, high int, hot boolean")


def classes(routes: DataFrame, least: int) -> DataFrame:
    """(class, doc, start, end): documents with a common hash, hashes of the same documents together, and the stretch of each document that their windows cover.

    A task streams through the hashes; each has at most MEET documents.
    """
    size = gram(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def classed(key: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.concatenate([start, [len(key)]]))
            several = count > 1
            names, keep = np.zeros(len(start), dtype=np.uint64), np.repeat(several, count)
            packed = np.ascontiguousarray(doc).tobytes()
            for k in np.flatnonzero(several):
                a = start[k]
                names[k] = xxhash.xxh3_64_intdigest(packed[8 * a : 8 * (a + count[k])], int(low[a]) // SEGMENT)
            columns = [pa.array(np.repeat(names, count).view(np.int64)[keep]), pa.array(doc[keep]), pa.array(low[keep]), pa.array(high[keep])]
            return pa.RecordBatch.from_arrays(columns, names=["class", "doc", "low", "high"])

        held = [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32)]
        for batch in batches:
            held = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last hash may go on
            if cut:
                yield classed(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield classed(*held)

    ordered = routes.select("hash", "doc", "low", "high")
    ordered = ordered.repartition("hash").sortWithinPartitions("hash", "doc")
    found = ordered.mapInArrow(run, "class bigint, doc bigint, low int, high int").groupBy("class", "doc").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return found.select("class", "doc", F.greatest(F.lit(0), F.col("low") - (least - size)).alias("start"), (F.col("high") + least).alias("end"))


def window_hashes(text: str, least: int = LEAST) -> np.ndarray:
    """Hash of the `least` characters that start at each position: of the two overlapping pieces that cover them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = 1 << (least.bit_length() - 1)
    h = gram_hashes(codes, size)
    n = len(codes) - least + 1
    both = (h[:n] * np.uint64(FACTOR)) ^ (h[least - size : least - size + n] >> np.uint64(7)) * MIX
    return both ^ (both >> np.uint64(31))


def window_classes(docs: DataFrame, hot: DataFrame, least: int) -> DataFrame:
    """(class, doc, start, end): documents that share a whole window around a hot (hash, doc), windows of the same documents together.

    Counts and signatures of windows are combined before they are shuffled, and the planner
    may split the join of a hot window.
    """
    size = gram(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                _, place, hashes = winnowed([text], least)
                place = place[np.isin(hashes.view(np.int64), np.array(wanted, dtype=np.int64))]
                whole = window_hashes(text, least)
                start = np.arange(len(whole))
                start = np.flatnonzero(np.searchsorted(place, start) < np.searchsorted(place, start + (least - size), side="right"))
                h = whole[start]
                order = np.lexsort((start, h))
                h, start = h[order], start[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
                last = np.concatenate([first[1:], [len(h)]]) - 1 if len(first) else first
                columns = [pa.array(h[first].view(np.int64)), pa.array(np.full(len(first), doc, dtype=np.int64)), pa.array(start[first].astype(np.int32)), pa.array((start[last] + least).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "doc", "start", "end"])

    texts = docs.filter(F.length("text") >= least).select("doc", "text").dropDuplicates(["doc"])
    wanted = hot.groupBy("doc").agg(F.collect_set("hash").alias("wanted"))
    found = write_once(texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(run, "hash bigint, doc bigint, start int, end int"))
    sets = found.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.bit_xor(F.xxhash64("doc")).alias("one"), F.bit_xor(F.xxhash64("doc", F.lit("two"))).alias("two")).filter("docs > 1")
    return found.join(sets, "hash").groupBy(F.xxhash64("docs", "one", "two").alias("class"), "doc").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def meetings(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Two tables (class, doc, start, end): by pieces, and by whole windows where pieces are hot (None if none is)."""
    prints = write_once(fingerprints(docs, least))
    routes = routed(prints, count_table(prints, "hashes"))
    hot = write_once(routes.filter("hot").groupBy("hash").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > MEET).select("hash"))
    if hot.isEmpty():
        return classes(routes, least), None
    wanted = write_once(routes.filter("hot").select("hash", "doc").join(hot, "hash"))
    return classes(routes.join(hot, "hash", "left_anti"), least), window_classes(docs, wanted, least)


class ShardAutomaton:
    """Suffix automaton of several reference texts that knows which of them hold the last `least` characters of a match."""

    def __init__(self, texts: dict[str, int], least: int):
        """`texts`: the references, each with the bits that stand for it."""
        follow, link, length, bits = [{}], [-1], [0], [0]
        for number, (text, own) in enumerate(texts.items()):
            last = self._append(follow, link, length, bits, 0 if number == 0 else last, [number] if number else [], 0)  # texts are split by numbers, which no text holds
            last = self._append(follow, link, length, bits, last, text, own)
        home = list(range(len(length)))
        order = sorted(range(1, len(length)), key=length.__getitem__)
        for state in order:
            if length[link[state]] >= least:
                home[state] = home[link[state]]
        for state in reversed(order):
            bits[link[state]] |= bits[state]
        self.follow, self.link, self.length, self.bits, self.home, self.least = follow, link, length, bits, home, least

    @staticmethod
    def _append(follow: list, link: list, length: list, bits: list, last: int, text, own: int) -> int:
        for c in text:
            now = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            bits.append(own)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = now
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(follow)
                    follow.append(follow[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    bits.append(0)
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        return last

    def statistics(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(position after it, length, bits) at each position where `least` characters and more of a reference end: the longest match and the references that hold its last `least`."""
        follow, link, length, least = self.follow, self.link, self.length, self.least
        state = size = 0
        for at, c in enumerate(text, 1):
            to = follow[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = follow[state].get(c)
            if to is None:
                continue
            state = to
            size += 1
            if size >= least:
                yield at, size, self.bits[self.home[state]]


def shards(members: DataFrame, star: bool) -> DataFrame:
    """(shard, role, doc, start, end): role 1 a reference of the shard, 2 a document to stream through it, 3 both.

    All documents of a class meet, those of one shard in its automaton and others as streams;
    with `star`, for classes of whole windows, the smallest and the largest document are the
    references, which is enough to know what of a document is shared.
    """
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("docs"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("chars"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    own = F.lit(0) if star else F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    rows = members.join(sizes, "class").withColumn("blocks", F.lit(1) if star else F.ceil(F.col("chars") / SHARD).cast("int"))
    rows = rows.withColumn("own", own).withColumn("parts", F.ceil(F.col("docs") / STREAMS).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc", F.lit("part")), F.col("parts")).cast("int"))
    rows = rows.filter("docs > 1").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") * F.col("parts") - 1)))
    block, part = F.floor(F.col("at") / F.col("parts")), F.col("at") % F.col("parts")
    refers = (F.col("doc") == F.col("least")) | (F.col("doc") == F.col("most")) if star else block == F.col("own")
    role = F.when(refers, 1).otherwise(0) + F.when(part == F.col("part"), 2).otherwise(0)
    return rows.select(F.xxhash64("class", "at").alias("shard"), role.cast("tinyint").alias("role"), "doc", "start", "end").filter("role > 0")


def streamed(rows: DataFrame, docs: DataFrame, least: int, pairs: bool) -> DataFrame:
    """What the documents of `shards` share: (a, b), a < b, with `pairs`, else (doc, start, end) of the stretches that another document holds."""
    rows = write_once(rows)
    ids = write_once(rows.select("doc").distinct())
    near = F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids
    texts = write_once(docs.join(near, "doc", "left_semi").select("doc", "text").dropDuplicates(["doc"]))
    parts = rows.join(texts, "doc").select("shard", "role", "doc", "start", F.expr("substring(text, start + 1, end - start)").alias("part"))
    parts = parts.repartition("shard").sortWithinPartitions("shard", F.desc(F.col("role").bitwiseAND(F.lit(1).cast("tinyint"))), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(refs: list[tuple[int, str]]) -> tuple[ShardAutomaton, list[int]]:
            names = sorted({doc for doc, _ in refs})
            bit, texts = {doc: 1 << k for k, doc in enumerate(names)}, {}
            for doc, text in refs:
                for at in range(0, max(1, len(text) - least + 1), PIECE):  # pieces hold each window of `least` characters whole
                    piece = text[at : at + PIECE + least - 1]
                    texts[piece] = texts.get(piece, 0) | bit[doc]
            return ShardAutomaton(texts, least), names

        def found(automaton: ShardAutomaton, names: list[int], doc: int, start: int, text: str) -> None:
            own = 1 << names.index(doc) if doc in names else 0
            if pairs:
                bits = seen = 0
                for _, _, seen in automaton.statistics(text):
                    bits |= seen
                bits &= ~own
                k = 0
                while bits:
                    if bits & 1:
                        out.append((min(doc, names[k]), max(doc, names[k])))
                    bits >>= 1
                    k += 1
                return
            begin = upto = -1
            for at, _, bits in automaton.statistics(text):
                if bits & ~own:
                    if at - least > upto:
                        if upto >= 0:
                            out.append((doc, start + begin, start + upto))
                        begin = at - least
                    upto = at
            if upto >= 0:
                out.append((doc, start + begin, start + upto))

        shard, refs, waiting, automaton, names, out = None, [], [], None, [], []
        for batch in batches:
            for now, role, doc, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != shard:
                    if refs:
                        automaton, names = made(refs)
                    for row in waiting:
                        found(automaton, names, *row)
                    shard, refs, waiting, automaton = now, [], [], None
                if role & 1:
                    refs.append((doc, text))
                    if role & 2:
                        waiting.append((doc, start, text))
                    continue
                if automaton is None:
                    automaton, names = made(refs)
                    for row in waiting:
                        found(automaton, names, *row)
                    refs, waiting = [], []
                found(automaton, names, doc, start, text)
            yield batch_of(out)
            out.clear()
        if refs:
            automaton, names = made(refs)
        for row in waiting:
            found(automaton, names, *row)
        yield batch_of(out)

    names = ["a", "b"] if pairs else ["doc", "start", "end"]

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if pairs or k == 0 else pa.int32()) for k in range(len(names))], names=names)

    return parts.mapInArrow(run, "a bigint, b bigint" if pairs else "doc bigint, start int, end int")


def sharing_pairs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(a, b), a < b: the pairs of documents (doc, text) that share a run of `least` characters.

    Null texts and texts shorter than `least` take no part; a repeated doc counts once.
    """
    by_piece, by_window = meetings(docs, least)
    rows = shards(by_piece, star=False)
    if by_window is not None:
        rows = rows.unionByName(shards(by_window, star=False))
    return streamed(rows, docs, least, True).distinct()


def shared_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, start, end): the maximal stretches of each document (doc, text) all of whose runs of `least` characters occur in other documents too."""
    by_piece, by_window = meetings(docs, least)
    rows = shards(by_piece, star=False)
    if by_window is not None:
        rows = rows.unionByName(shards(by_window, star=True))
    found = streamed(rows, docs, least, False).groupBy("doc", "start").agg(F.max("end").alias("end"))
    # Stretches that overlap or touch are one span.
    before = W.partitionBy("doc").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("upto", F.max("end").over(before)).withColumn("new", F.when(F.col("start") <= F.col("upto"), 0).otherwise(1))
    found = found.withColumn("span", F.sum("new").over(W.partitionBy("doc").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    return found.groupBy("doc", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc", "start", "end")


def shared_shares(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, n_chars, shared_chars, share) of the documents that share a span: its (disjoint) spans over its length."""
    shared = spans.groupBy("doc").agg(F.sum((F.col("end") - F.col("start")).cast("long")).alias("shared_chars"))
    lengths = docs.select("doc", F.length("text").alias("n_chars")).dropDuplicates(["doc"])
    return shared.join(lengths, "doc").select("doc", "n_chars", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("share"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, text) of the documents that share a span, without their (disjoint) spans."""
    own = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rest = "aggregate(spans, struct('' AS kept, 0 AS at), (s, x) -> struct(concat(s.kept, substring(text, s.at + 1, x.start - s.at)) AS kept, x.end AS at), s -> concat(s.kept, substring(text, s.at + 1)))"
    return docs.select("doc", "text").dropDuplicates(["doc"]).join(own, "doc").select("doc", F.expr(rest).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "doc").filter("doc is not null")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id_a, doc_id_b) that share a verbatim run of at least 200 code points."""
    return sharing_pairs(corpus(spark, sf_dir)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a shared passage, and the share of its text that occurs elsewhere too."""
    docs = corpus(spark, sf_dir)
    return shared_shares(docs, shared_spans(docs)).withColumnRenamed("doc", "doc_id")


def p9_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of each document with a shared passage, the passages removed."""
    docs = corpus(spark, sf_dir)
    return without_spans(docs, shared_spans(docs)).withColumnRenamed("doc", "doc_id")


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_removed": p9_removed}

_WINDOWS = """w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
      u AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
      c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE h IN (SELECT h FROM u)),
      g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM c),
      s AS (SELECT doc_id, span, min(i) - 1 AS start, max(i) + 199 AS stop FROM g GROUP BY 1, 2)"""
#: The same pairs by joining all windows of 200 characters.
ORACLES = {
    "p9_found": """WITH w AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 198), lambda i: md5(substr(text, i, 200)))) AS h FROM documents WHERE length(text) >= 200)
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_shares": f"WITH {_WINDOWS} SELECT d.doc_id, length(text) AS n_chars, n AS shared_chars, n / length(text) AS share FROM documents d JOIN (SELECT doc_id, sum(stop - start)::BIGINT AS n FROM s GROUP BY 1) s ON d.doc_id = s.doc_id",
    "p9_removed": f"WITH {_WINDOWS}, k AS (SELECT s.doc_id, start, substr(text, coalesce(lag(stop) OVER (PARTITION BY s.doc_id ORDER BY start), 0) + 1, start - coalesce(lag(stop) OVER (PARTITION BY s.doc_id ORDER BY start), 0)) AS kept FROM s JOIN documents d ON s.doc_id = d.doc_id),"
    " j AS (SELECT doc_id, string_agg(kept, '' ORDER BY start) AS kept FROM k GROUP BY 1), m AS (SELECT doc_id, max(stop) AS stop FROM s GROUP BY 1)"
    " SELECT d.doc_id, kept || substr(text, m.stop + 1) AS text FROM documents d JOIN j ON d.doc_id = j.doc_id JOIN m ON d.doc_id = m.doc_id",
}
