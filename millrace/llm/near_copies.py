"""Near-duplicate texts by bottom-k sketches from one hash function (problem 6).

Every text is the set of its distinct word shingles under one 64-bit hash. Its RETAINED
smallest hashes, in their order, are its bottom-k sketch. Inverted lists of retained values
generate overlaps, the k smallest values of the union of two sketches estimate the similarity
and drop clear misses, and the exact Jaccard of the full 64-bit sets decides.

Lists. A value that few texts retain has a list of its own. A list of a frequent value would
grow with the square of the corpus, so there the list is one of a run: the value and the ones
retained next to it, as many as make the list short by the frequencies of the values (counted
over all texts, in a table of fixed size). As the length of a run follows from the values
alone, two texts that retain the same run meet in the same list.

Why nothing is missed. Of the values of the union of two sets, in the order of the hash, each
is in both with probability t, the similarity, independent of the others. A run of r values in
a row in both is a run of r in either, and the chance that n values hold none falls as
exp(-rate(r) * n). A text takes runs until their rates sum to SURE; the other text of a pair
takes all of its own up to there too, or else the roles are changed. With SURE = 10, fewer
than LEAST_MET common lists are rarer than 1 in 1000 at the threshold itself, for texts of any
length and a corpus of any size. A text too short for that takes shorter runs as well.

Hot lists. A list that could hold over LIST_ROWS texts (it can't if one of its values is rarer)
is counted, and if it does, its texts are treated as a corpus of their own: frequencies are
counted within the list and the texts go on to lists of it. Lists that don't get shorter by
that hold texts that are similar to each other; their pairs are formed in blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import COUNTERS, components, count_table, write_once
from millrace.session import load

WORD = re.compile(r"[^\W_]+")
#: Values a sketch retains, their bytes, and those that estimate the similarity of a union.
RETAINED, BYTES, SKETCH = 96, 5, 32
#: Texts a list is meant to hold, the longest run, and the sum of rates at which a text has runs enough.
TARGET, LONGEST, SURE = 8, 6, 10.0
#: Common lists that a pair must have (one, if the threshold is 0.5 or less).
LEAST_MET = 2
#: A list longer than this becomes a corpus of its own, DEPTH times at most.
LIST_ROWS, DEPTH = 1000, 3
#: Texts of one set (or list) that travel in one array, on average, and parts into which the arrays of a larger one are split for their join.
COPIES, SALTS = 1000, 16
#: Bytes of ids up to which they are broadcast to the second reading of the texts.
BROADCAST_BYTES = 8 << 20
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


class Shingler:
    """Sorted distinct hashes of the runs of `width` words of a text."""

    def __init__(self, width: int, least_words: int):
        self.width, self.least = width, least_words

        class Memo(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > 1_000_000:
                    self.clear()
                h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
                return h

        self.memo = Memo()

    def __call__(self, text: str | None) -> np.ndarray | None:
        words = WORD.findall(text.lower()) if text else []
        if len(words) < max(self.least, self.width):
            return None
        h = np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(h) - self.width + 1
        acc = h[:n] * M1
        for k in range(1, self.width):
            acc = (acc ^ (acc >> np.uint64(29))) * M2 + h[k : n + k]
        acc ^= acc >> np.uint64(32)
        acc *= M3
        acc ^= acc >> np.uint64(29)
        return np.unique(acc)


def rates(t: float) -> np.ndarray:
    """Per length r of a run (from 0 to LONGEST): -log of the factor by which every further value of the union lowers the chance of no common run of r."""
    t = min(t, 0.999)
    found = [0.0]
    for r in range(1, LONGEST + 1):
        found.append(-math.log(max(abs(np.roots([1.0] + [-(1 - t) * t**k for k in range(r)])))))
    return np.array(found)


def pack(values: np.ndarray) -> bytes:
    """A sketch: the upper 40 bits of the smallest hashes, in their order."""
    upper = values[:RETAINED] >> np.uint64(64 - 8 * BYTES)
    return np.ascontiguousarray(upper.view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // BYTES, 8), dtype=np.uint8)
    wide[:, :BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, BYTES)
    return wide.reshape(-1).view(np.uint64)


def counter_of(values: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The counter in the table of frequencies of each value of a (sub)corpus."""
    mixed = (values ^ salts) * M1
    return ((mixed ^ (mixed >> np.uint64(31))) * M2 >> np.uint64(44)).astype(np.int64) & (COUNTERS - 1)


def runs(sketches: list[bytes], salts: np.ndarray, texts: np.ndarray, table: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the sketch, list key, whether the list may hold over LIST_ROWS texts) of the runs of sketches; `texts` is the size of each one's corpus."""
    values, sizes = unpack(b"".join(sketches)), np.array([len(s) // BYTES for s in sketches])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[owner] - np.arange(len(values))
    counts = table[counter_of(values, salts[owner])].astype(np.int64)
    share = np.log(np.minimum(np.maximum(counts, 1) / texts[owner], 1.0))
    need = np.log(TARGET / np.maximum(texts, TARGET))[owner]
    length = np.full(len(values), LONGEST)
    expected, fewest, key = np.zeros(len(values)), np.full(len(values), np.iinfo(np.int64).max), salts[owner].copy()
    keys, rarest, open_ = [key], [fewest], np.ones(len(values), dtype=bool)
    for r in range(1, LONGEST + 1):
        n = len(values) - r + 1
        expected, fewest, key = expected.copy(), fewest.copy(), key.copy()
        expected[: max(n, 0)] += share[r - 1 :]
        np.minimum(fewest[: max(n, 0)], counts[r - 1 :], out=fewest[: max(n, 0)])
        key[: max(n, 0)] = (key[: max(n, 0)] ^ (key[: max(n, 0)] >> np.uint64(29))) * M2 + values[r - 1 :]
        key = (key ^ (key >> np.uint64(32))) * M3
        keys.append(key)
        rarest.append(fewest)
        short = open_ & (expected <= need)
        length[short] = r
        open_ &= ~short
    found, done, before = [], np.zeros(len(sizes), dtype=bool), None
    for less in range(LONGEST):  # texts without runs enough take shorter ones as well
        own = np.maximum(length - less, 1)
        whole = own <= left
        total = np.concatenate([[0.0], np.cumsum(np.where(whole, rate[own], 0.0))])
        start = total[ends - sizes]
        pick = whole & ~done[owner] & (total[:-1] - start[owner] < SURE)
        if before is not None:
            pick &= own != before
        at = np.flatnonzero(pick)
        found.append((owner[at], np.stack(keys)[own[at], at], np.stack(rarest)[own[at], at] > LIST_ROWS))
        done |= total[ends] - start >= SURE
        if done.all() or (own == 1).all():
            break
        before = own
    return tuple(np.concatenate(x) for x in zip(*found))


def profile(texts: DataFrame, width: int, least_words: int) -> DataFrame:
    """(tbl, id, digest, size, sketch) of each text that takes part; the sketch only with the first text of a set in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(width, least_words), set()
        for batch in batches:
            out = []
            for tbl, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                values = shingle(text)
                if values is None:
                    continue
                digest = xxhash.xxh3_128_digest(tbl.encode() + b"\x00" + values.tobytes())
                sketch = None
                if digest not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(digest)
                    sketch = pack(values)
                out.append((tbl, name, digest, len(values), sketch))
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["tbl", "id", "digest", "size", "sketch"])

    return texts.select("tbl", "id", "text").mapInArrow(run, "tbl string, id string, digest binary, size int, sketch binary")


def frequencies(corpora: DataFrame) -> np.ndarray:
    """How many texts of (salt, sketch) retain the values of each counter; values that share one have longer runs than they need, and lose none."""

    def counters(batch: pa.RecordBatch) -> np.ndarray:
        sketches = batch.column(1).to_pylist()
        return counter_of(unpack(b"".join(sketches)), np.repeat(batch.column(0).to_numpy().view(np.uint64), [len(s) // BYTES for s in sketches]))

    return count_table(corpora, "salt", "sketch", counters=counters)


def listed(corpora: DataFrame, t: float) -> DataFrame:
    """(key, doc, of) of the lists of (salt, texts, doc, sketch); `of` is the size of the corpus where the list may be hot, else null."""
    spark = corpora.sparkSession
    shared, rate = spark.sparkContext.broadcast(frequencies(corpora)), rates(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_numpy()
                owner, key, hot = runs(part.column(3).to_pylist(), part.column(0).to_numpy().view(np.uint64), texts, shared.value, rate)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part.column(2).to_numpy()[owner]), pa.array(texts[owner], mask=~hot)], names=["key", "doc", "of"])

    return corpora.select("salt", "texts", "doc", "sketch").mapInArrow(run, "key bigint, doc bigint, of bigint")


def met_in(lists: DataFrame) -> DataFrame:
    """(a, b, met): pairs a < b of documents on common lists (key, doc) of bounded length, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paired(keys: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, docs = keys[new], docs[new]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.concatenate([start, [len(keys)]]))
            a, b, held = [], [], 0
            for n in np.unique(size[size > 1]):
                x, y = np.triu_indices(n, 1)
                own = start[size == n]
                step = max(1, 500_000 // len(x))
                for k in range(0, len(own), step):
                    rows = own[k : k + step, None]
                    a.append(docs[rows + x].ravel())
                    b.append(docs[rows + y].ravel())
                    held += len(a[-1])
                    if held > 1_000_000:
                        yield summed(a, b)
                        a, b, held = [], [], 0
            if a:
                yield summed(a, b)

        def summed(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            met = np.diff(np.concatenate([start, [len(a)]]))
            return pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(met.astype(np.int32))], names=["a", "b", "met"])

        keys = docs = np.empty(0, dtype=np.int64)
        for batch in batches:
            keys, docs = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([docs, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last list may go on
            if cut:
                yield from paired(keys[:cut], docs[:cut])
                keys, docs = keys[cut:], docs[cut:]
        if len(keys):
            yield from paired(keys, docs)

    ordered = lists.select("key", "doc").repartition("key").sortWithinPartitions("key", "doc")
    return ordered.mapInArrow(run, "a bigint, b bigint, met int")


def all_pairs(members: DataFrame, group: list[str], item: str, rows: str) -> DataFrame:
    """(group..., x, y), x < y: all pairs of items within each group of `rows` items.

    The items travel in arrays of about COPIES, and every array of a group meets every other.
    """
    parts = F.ceil(F.col(rows) / COPIES).cast("bigint")
    several = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(item), F.col("parts")))
    lists = write_once(several.groupBy(*group, "parts", "part").agg(F.collect_set(item).alias("items")))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("parts"), F.lit(SALTS)) - 1))
    p = lists.select(*group, F.pmod("part", F.lit(SALTS)).alias("salt"), F.col("part").alias("p"), F.col("items").alias("xs"))
    q = lists.select(*group, salts.alias("salt"), F.col("part").alias("q"), F.col("items").alias("ys"))
    met = p.join(q, [*group, "salt"]).filter("p <= q").select(*group, "p", "q", F.explode("xs").alias("x"), "ys").select(*group, "p", "q", "x", F.explode("ys").alias("y"))
    return met.filter("p < q or x < y").select(*group, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x < y")


def candidates(sketches: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: documents of (tbl, doc, sketch) that meet in at least LEAST_MET lists of their table."""
    sizes = sketches.groupBy("tbl").agg(F.count(F.lit(1)).alias("texts"))  # a row per table; by its few keys the sketches must not be shuffled
    corpora = sketches.join(F.broadcast(sizes), "tbl").select(F.xxhash64("tbl").alias("salt"), "texts", "doc", "sketch")
    met = None
    for depth in range(DEPTH + 1):
        lists = listed(corpora, t)
        hot = write_once(lists.filter("of is not null").groupBy("key").agg(F.count_distinct("doc").alias("rows"), F.max("of").alias("of")).filter(F.col("rows") > LIST_ROWS))
        if hot.isEmpty():
            found = met_in(lists)
            met = found if met is None else met.unionByName(found)
            break
        found = met_in(lists.join(hot, "key", "left_anti"))
        met = found if met is None else met.unionByName(found)
        # Lists that hold most of the list they come from hold similar texts: their pairs are the result.
        last = F.lit(depth == DEPTH) | (F.lit(depth > 0) & (F.col("rows") > 0.5 * F.col("of")))
        onward = lists.filter("of is not null").select("key", "doc").distinct().join(hot.withColumn("last", last), "key")
        onward = write_once(onward.select("key", "doc", "rows", "last"))
        same = onward.filter("last")
        if not same.isEmpty():
            pairs = all_pairs(same.select("key", "doc", "rows"), ["key"], "doc", "rows")
            met = met.unionByName(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(LEAST_MET).alias("met")))
        corpora = onward.filter("not last").select(F.col("key").alias("salt"), F.col("rows").alias("texts"), "doc")
        if corpora.isEmpty():
            break
        corpora = write_once(corpora.join(sketches.select("doc", "sketch"), "doc").select("salt", "texts", "doc", "sketch"))
    least = LEAST_MET if t > 0.5 else 1
    return met.groupBy("a", "b").agg(F.sum("met").alias("met")).filter(F.col("met") >= least).select("a", "b")


def estimate(p: np.ndarray, q: np.ndarray, k: int = SKETCH) -> float:
    """Jaccard estimate from the k smallest hashes of the union, read off the two bottom-k sketches."""
    both = np.concatenate([p[:k], q[:k]])
    both.sort()
    repeat = both[1:] == both[:-1]
    keep = np.concatenate([[True], ~repeat])
    k = min(k, int(keep.sum()))
    rank = np.cumsum(keep)
    return int((repeat & (rank[1:] <= k)).sum()) / k


def estimated(pairs: DataFrame, sketches: DataFrame, t: float) -> DataFrame:
    """The pairs whose sizes allow the similarity t and whose union sketch does not speak against it (3.7 standard deviations)."""
    low = t - 3.7 * math.sqrt(t * (1 - t) / SKETCH)
    heads = sketches.select("doc", "size", F.expr(f"substring(sketch, 1, {SKETCH * BYTES})").alias("head"))
    side = lambda x: heads.select(F.col("doc").alias(x), F.col("size").alias(f"size_{x}"), F.col("head").alias(f"head_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("size_a", "size_b") >= (t - 1e-9) * F.greatest("size_a", "size_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [estimate(unpack(p), unpack(q)) >= low for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "head_a", "head_b").mapInArrow(run, "a bigint, b bigint")


def similar_pairs(texts: DataFrame, t: float, width: int = 5, least_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Groups and links of texts (tbl, id, text) within each tbl.

    Returns (members, links): members has (tbl, id, rep, copies) of every text that takes
    part, rep being the smallest id with the same shingle set; links has (tbl, a, b,
    similarity) of pairs of different sets with Jaccard >= t. Null texts and texts of
    fewer than `least_words` words take no part; a repeated id counts once. Ids must be
    strings without nulls.
    """
    profiled = write_once(profile(texts, width, least_words).withColumn("doc", _doc(F.col("digest"))))
    members = profiled.select("tbl", "id", "digest", "doc").distinct()
    groups = members.groupBy("tbl", "digest", "doc").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = write_once(groups)
    members = members.join(groups, ["tbl", "digest", "doc"]).select("tbl", "id", "rep", "copies")
    sketches = profiled.filter("sketch is not null").select("tbl", "doc", "size", "sketch")
    pairs = write_once(candidates(sketches, t))
    pairs = write_once(estimated(pairs, sketches, t).distinct())
    return members, _verified(texts, groups, pairs, t, width, least_words)


def _doc(digest):
    """The first 8 bytes of a digest as an integer."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("bigint")


def _verified(texts: DataFrame, groups: DataFrame, pairs: DataFrame, t: float, width: int, least_words: int) -> DataFrame:
    """(tbl, a, b, similarity) of the pairs that the exact Jaccard of their 64-bit sets confirms.

    The texts themselves travel: with the compression of a shuffle they take a third of the
    room of their sets. A task keeps the sets of recent texts.
    """

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(width, least_words), {}

        def values(doc: tuple, text: str) -> np.ndarray:
            found = known.get(doc)
            if found is None:
                if len(known) >= 2000:
                    known.clear()
                found = known[doc] = shingle(text)
            return found

        for batch in batches:
            out = []
            for tbl, x, y, text_x, text_y in zip(*(c.to_pylist() for c in batch.columns)):
                p, q = values((tbl, x), text_x), values((tbl, y), text_y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                similarity = common / (len(p) + len(q) - common)
                if similarity >= t:
                    out.append((tbl, min(x, y), max(x, y), similarity))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.float64() if k == 3 else pa.string()) for k in range(4)], names=["tbl", "a", "b", "similarity"])

    docs = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = write_once(groups.join(docs, "doc").select("tbl", F.col("rep").alias("id"), "doc"))
    size = wanted.agg(F.sum(F.octet_length("tbl") + F.octet_length("id") + 24)).first()[0] or 0
    chosen = texts.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, ["tbl", "id"]).select("tbl", "id", "doc", "text")
    chosen = write_once(chosen.dropDuplicates(["doc", "id"]))
    side = lambda x: chosen.select(F.col("doc").alias(x), F.col("tbl").alias(f"tbl_{x}"), F.col("id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("tbl_a = tbl_b")
    return both.select(F.col("tbl_a").alias("tbl"), "id_a", "id_b", "text_a", "text_b").mapInArrow(decided, "tbl string, a string, b string, similarity double")


def rag_and_cache_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "rag_documents", ["id", "content"]).select(F.lit("rag_documents").alias("tbl"), "id", F.col("content").alias("text"))
    cache = load(spark, sf_dir, "cache_entries", ["entry_id", "response"]).select(F.lit("cache_entries").alias("tbl"), F.col("entry_id").alias("id"), F.col("response").alias("text"))
    return docs.unionByName(cache).filter("id is not null")


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b): all pairs of ids from groups and links.

    The ids of a group travel in arrays of about COPIES; every array of a group meets every
    other, and a link pairs all arrays of its two groups.
    """
    several = members.filter("copies > 1").select("tbl", "rep", "id", "copies")
    within = all_pairs(several, ["tbl", "rep"], "id", "copies").select("tbl", "x", "y")
    parts = F.ceil(F.col("copies") / COPIES).cast("bigint")
    lists = write_once(several.groupBy("tbl", "rep", F.pmod(F.xxhash64("id"), parts).alias("part")).agg(F.collect_set("id").alias("ids")))
    wide = links.join(lists.select("tbl", F.col("rep").alias("a"), F.col("ids").alias("xs")), ["tbl", "a"], "left")
    wide = wide.join(lists.select("tbl", F.col("rep").alias("b"), F.col("ids").alias("ys")), ["tbl", "b"], "left")
    one = lambda ids, rep: F.coalesce(F.col(ids), F.array(rep))
    across = wide.select("tbl", F.explode(one("xs", "a")).alias("x"), one("ys", "b").alias("ys")).select("tbl", "x", F.explode("ys").alias("y"))
    return within.unionByName(across).select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of similarity >= 0.6 on three-word runs, texts of 30 words and more."""
    members, links = similar_pairs(rag_and_cache_texts(spark, sf_dir), 0.6, width=3, least_words=30)
    return expand(members, links).select("id_a", "id_b").distinct()


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, rep, copies, links) of each text that takes part: the smallest id with the same set, the ids that have it, and the other sets that are similar."""
    members, links = similar_pairs(rag_and_cache_texts(spark, sf_dir), 0.6, width=3, least_words=30)
    ends = links.select("tbl", F.col("a").alias("rep")).union(links.select("tbl", "b")).groupBy("tbl", "rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, ["tbl", "rep"], "left").select("tbl", "id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, group_id) of each text with a changed version: chains of similar texts make one group."""
    members, links = similar_pairs(rag_and_cache_texts(spark, sf_dir), 0.6, width=3, least_words=30)
    members = write_once(members)
    name = lambda c: F.concat_ws("\x1f", "tbl", c)
    edges = links.select(name("a").alias("a"), name("b").alias("b")).union(members.filter("id <> rep").select(name("rep").alias("a"), name("id").alias("b")))
    found = components(edges)
    return found.select(F.split("node", "\x1f")[0].alias("tbl"), F.split("node", "\x1f")[1].alias("id"), F.split("component", "\x1f")[1].alias("group_id"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups, "p6_members": p6_members}

_PAIRS = """t AS (SELECT DISTINCT 'd' AS k, id, content AS x FROM rag_documents UNION SELECT DISTINCT 'c', entry_id, response FROM cache_entries),
      w AS (SELECT k, id, regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+') AS w FROM t WHERE x IS NOT NULL),
      s AS (SELECT DISTINCT k, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 30),
      n AS (SELECT k, id, count(*) AS n FROM s GROUP BY 1, 2),
      p AS (SELECT a.k, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3),
      f AS (SELECT p.k, id_a, id_b, c = x.n AND c = y.n AS same FROM p JOIN n x ON p.k = x.k AND p.id_a = x.id JOIN n y ON p.k = y.k AND p.id_b = y.id WHERE c >= 0.6 * (x.n + y.n - c))"""
#: The same pairs, classes and groups by joining all shingles.
ORACLES = {
    "p6_found": f"WITH {_PAIRS} SELECT id_a, id_b FROM f",
    "p6_members": f"""WITH {_PAIRS},
      r AS (SELECT n.k, n.id, least(n.id, coalesce(min(f.id_a), n.id)) AS rep FROM n LEFT JOIN f ON f.k = n.k AND f.id_b = n.id AND f.same GROUP BY 1, 2),
      c AS (SELECT k, rep, count(*) AS copies FROM r GROUP BY 1, 2),
      l AS (SELECT DISTINCT x.k, x.rep AS a, y.rep AS b FROM f JOIN r x ON f.k = x.k AND f.id_a = x.id JOIN r y ON f.k = y.k AND f.id_b = y.id WHERE NOT f.same),
      e AS (SELECT k, rep, count(DISTINCT other) AS links FROM (SELECT k, a AS rep, b AS other FROM l UNION ALL SELECT k, b, a FROM l) GROUP BY 1, 2)
      SELECT CASE r.k WHEN 'd' THEN 'rag_documents' ELSE 'cache_entries' END AS tbl, r.id, r.rep, copies, coalesce(links, 0) AS links FROM r JOIN c ON r.k = c.k AND r.rep = c.rep LEFT JOIN e ON r.k = e.k AND r.rep = e.rep""",
    "p6_groups": f"""WITH RECURSIVE {_PAIRS},
      e AS (SELECT k, id_a AS u, id_b AS v FROM f UNION SELECT k, id_b, id_a FROM f),
      g AS (SELECT DISTINCT k, u AS id, u AS other FROM e UNION SELECT g.k, g.id, e.v FROM g JOIN e ON g.k = e.k AND g.other = e.u)
      SELECT CASE k WHEN 'd' THEN 'rag_documents' ELSE 'cache_entries' END AS tbl, id, min(other) AS group_id FROM g GROUP BY 1, 2""",
}
