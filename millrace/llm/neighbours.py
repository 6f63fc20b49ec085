"""Most similar vectors for every vector by balanced posting lists (problem 4).

A bounded sample is bisected until its cells are small, so dense regions get more lists
and all lists are of like length; cell means are the centroids. Every vector searches the
centroids through a neighbour graph held in memory, joins the list of its nearest centroid
and, near a boundary, the next one's too (replicas), and is compared with the lists whose
centroid is within a distance ratio of the nearest. Every vector is indexed and every vector
is a query; the sample only places the centroids.

Lists stay short however many rows there are: cells are as many as the rows need, and where
the sample is too small for that, the rows of each cell are bisected again in the same way.

Equal vectors are compared once: a group of copies sends one representative to the lists
and its members are put back by id, so a vector that a third of all rows carry costs no
more than one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import write_once
from millrace.operators.retrieval import top_k
from millrace.session import load

#: Vectors that place the centroids, at most, per table, and within a cell that is split again.
SAMPLE, SUB_SAMPLE = 32_768, 8192
#: Wanted vectors of a list, and sample vectors that a cell must have.
LIST, CELL = 1024, 8
#: Lists that a vector joins and searches, at most, and the distance ratios that prune them.
REPLICAS, REPLICA_RATIO = 2, 1.15
PROBES, PROBE_RATIO = 3, 1.35
#: Neighbours of a centroid in the graph, beam width, nodes expanded at once.
DEGREE, BEAM, EXPAND = 24, 24, 4


def pack(batch_column: pa.Array, dim: int) -> tuple[np.ndarray, list[bytes]]:
    """Row numbers of the usable vectors and their packed unit vectors: a float32 scale and `dim` int16 steps."""
    column = batch_column.combine_chunks() if isinstance(batch_column, pa.ChunkedArray) else batch_column
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, []
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    largest = np.abs(flat).max(axis=1)
    good = np.isfinite(largest) & (largest > 0)
    rows, flat = rows[good], flat[good]
    flat = flat / largest[good][:, None]
    norm = np.sqrt((flat * flat).sum(axis=1))
    steps = np.round(flat * 32767).astype(np.int16)
    scale = (1 / (norm * 32767)).astype(np.float32)
    return rows, [s.tobytes() + x.tobytes() for s, x in zip(scale, steps)]


def unpack(codes: list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), 4 + 2 * dim)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int16).astype(np.float32) * scale


def packed(df: DataFrame, dim: int) -> DataFrame:
    """(tbl, id, code) of the vectors (tbl, id, vec) that are `dim` long, finite and not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes = pack(batch.column(2), dim)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(codes, pa.binary())], names=["tbl", "id", "code"])

    return df.filter("id is not null and vec is not null").select("tbl", "id", "vec").mapInArrow(run, "tbl string, id string, code binary")


class Index:
    """Centroids of balanced cells, their neighbour graph and its entry points."""

    def __init__(self, sample: np.ndarray, cells: int):
        rng = np.random.default_rng(0)
        leaf = max(CELL, math.ceil(len(sample) / max(1, cells)))
        found: list[np.ndarray] = []
        stack = [np.arange(len(sample))]
        while stack:
            own = stack.pop()
            if len(own) <= leaf:
                found.append(sample[own].mean(axis=0))
                continue
            x = sample[own]
            centres = x[rng.choice(len(own), 2, replace=False)]
            for _ in range(6):
                side = (x @ (centres[1] - centres[0])) > (centres[1] @ centres[1] - centres[0] @ centres[0]) / 2
                if side.all() or not side.any():
                    break
                centres = np.stack([x[~side].mean(axis=0), x[side].mean(axis=0)])
            along = x @ (centres[1] - centres[0])
            cut = int(np.clip((along <= (centres[1] @ centres[1] - centres[0] @ centres[0]) / 2).sum(), len(own) // 4, len(own) - len(own) // 4))
            order = np.argsort(along, kind="stable")
            stack += [own[order[cut:]], own[order[:cut]]]
        self.centroids = np.stack(found).astype(np.float32) if found else np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1), dtype=np.float32)
        n = len(self.centroids)
        self.half = (self.centroids**2).sum(axis=1) / 2
        degree = min(DEGREE, n - 1)
        self.graph = np.zeros((n, max(1, degree)), dtype=np.int32)
        for a in range(0, n, 1024):
            near = self.centroids[a : a + 1024] @ self.centroids.T - self.half
            near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
            if degree:
                self.graph[a : a + 1024] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
        self.entries = np.arange(0, n, max(1, int(math.sqrt(n) / 2)))

    def search(self, x: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the `width` nearest centroids of each row of x, nearest first; id -1 pads.

        Best-first search on the graph from the nearest entry points, a batch at a time.
        """
        b, n = len(x), len(self.centroids)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n), dtype=bool)
        start = min(EXPAND, len(self.entries))
        near = x @ self.centroids[self.entries].T - self.half[self.entries]
        first = self.entries[np.argpartition(-near, start - 1, axis=1)[:, :start]]
        ids = np.full((b, width), -1)
        score = np.full((b, width), -np.inf, dtype=np.float32)
        done = np.ones((b, width), dtype=bool)
        ids[:, :start], score[:, :start], done[:, :start] = first, np.take_along_axis(near, np.searchsorted(self.entries, first), 1), False
        seen[rows, first] = True
        while True:
            open_score = np.where(done, -np.inf, score)
            at = np.argpartition(-open_score, EXPAND - 1, axis=1)[:, :EXPAND]
            live = np.take_along_axis(open_score, at, 1) > -np.inf
            if not live.any():
                break
            active = np.flatnonzero(live.any(axis=1))
            r = active[:, None]
            at, live = at[active], live[active]
            done[r, at] = True
            around = self.graph[ids[r, at]]
            around = np.where(live[:, :, None], around, ids[r, at][:, :, None]).reshape(len(active), -1)
            around.sort(axis=1)
            fresh = ~seen[r, around]
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            seen[r, around] = True
            got = np.einsum("bd,bkd->bk", x[active], self.centroids[around]) - self.half[around]
            got[~fresh] = -np.inf
            all_ids = np.concatenate([ids[active], around], axis=1)
            all_score = np.concatenate([score[active], got], axis=1)
            all_done = np.concatenate([done[active], ~fresh], axis=1)
            keep = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
            ids[active], score[active], done[active] = (np.take_along_axis(v, keep, 1) for v in (all_ids, all_score, all_done))
        order = np.argsort(-score, axis=1)
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        ids[~np.isfinite(score)] = -1
        distance = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * np.where(ids >= 0, score, -np.inf), 0))
        return ids, distance

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, role) per row: role 1 a list the row joins, 2 a list to search, 3 both, 0 none."""
        ids, distance = self.search(x)
        role = np.zeros(ids.shape, dtype=np.int8)
        for bit, most, ratio in ((1, REPLICAS, REPLICA_RATIO), (2, PROBES, PROBE_RATIO)):
            near = (ids >= 0) & (distance <= distance[:, :1] * ratio)
            near[:, most:] = False
            near[:, 0] = True
            role[near] |= bit
        return ids, role


def fit(reps: DataFrame, dim: int) -> dict[str, tuple[Index, int]]:
    """Per table an index from at most SAMPLE of its vectors, picked by the hash of their id, and the parts each of its cells needs."""
    sizes = {r.tbl: r.n for r in reps.groupBy("tbl").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for tbl, n in sizes.items():
        share = F.when(F.col("tbl") == tbl, F.lit(min(1.0, 0.95 * SAMPLE / n))).otherwise(share)
    picked = reps.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("tbl", "code").collect()
    indexes = {}
    for tbl, n in sizes.items():
        codes = sorted(bytes(r.code) for r in picked if r.tbl == tbl)
        if codes:
            index = Index(unpack(codes, dim), math.ceil(n / LIST))
            parts = n / len(index.centroids) / LIST
            indexes[tbl] = index, math.ceil(parts) if parts > 2 else 1
    return indexes


def placed_lists(reps: DataFrame, indexes: dict[str, tuple[Index, int]], dim: int) -> DataFrame:
    """(tbl, list, role, id, code): every vector in the lists it joins and searches."""
    shared = reps.sparkSession.sparkContext.broadcast(indexes)
    names, fields = ["tbl", "list", "role", "id", "code"], "tbl string, list int, role tinyint, id string, code binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = np.array(batch.column(0).to_pylist())
            for tbl in np.unique(tables):
                if tbl not in shared.value:
                    continue
                index, _ = shared.value[tbl]
                rows = np.flatnonzero(tables == tbl)
                for a in range(0, len(rows), 512):
                    at = rows[a : a + 512]
                    part = batch.take(pa.array(at))
                    ids, role = index.place(unpack(part.column(2).to_pylist(), dim))
                    r, c = np.nonzero(role)
                    out = part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([out.column(0), pa.array(ids[r, c].astype(np.int32)), pa.array(role[r, c]), out.column(1), out.column(2)], names=names)

    lists = reps.select("tbl", "id", "code").mapInArrow(placed, fields)
    if all(parts == 1 for _, parts in indexes.values()):
        return lists

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a cell come in the order of a hash, those that join it first: the first of them place its own centroids."""

        def parted(rows: pa.Table, index: Index | None, parts: int) -> pa.Table:
            old = rows.column("list").to_numpy()
            if index is None:
                return rows.set_column(1, "list", pa.array((old * parts).astype(np.int32)))
            ids, role = index.place(unpack(rows.column("code").to_pylist(), dim))
            role &= rows.column("role").to_numpy()[:, None]
            r, c = np.nonzero(role)
            out = rows.take(pa.array(r))
            return out.set_column(1, "list", pa.array((old[r] * parts + ids[r, c]).astype(np.int32))).set_column(2, "role", pa.array(role[r, c]))

        def fitted(held: list[pa.Table], tbl: str) -> tuple[pa.Table, Index | None, int]:
            rows, parts = pa.concat_tables(held), min(shared.value[tbl][1], SUB_SAMPLE // CELL)
            joins = rows.filter(pa.array((rows.column("role").to_numpy() & 1) == 1)).column("code").to_pylist()
            parts = min(parts, max(1, len(joins) // CELL))
            index = Index(unpack(joins[:SUB_SAMPLE], dim), parts) if parts > 1 else None
            return rows, index, 4 * SUB_SAMPLE // CELL

        def chunks(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for a in range(0, table.num_rows, 512):
                yield table.slice(a, 512)

        cell, held, index, parts, ready = None, [], None, 1, False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("tbl").to_pylist(), table.column("list").to_pylist()))
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                part = table.slice(a, b - a)
                if keys[a] != cell:
                    if held:
                        rows, index, parts = fitted(held, cell[0])
                        for piece in chunks(rows):
                            yield from parted(piece, index, parts).combine_chunks().to_batches()
                    cell, held, ready = keys[a], [], False
                if ready:
                    for piece in chunks(part):
                        yield from parted(piece, index, parts).combine_chunks().to_batches()
                    continue
                held.append(part)
                if sum(x.num_rows for x in held) >= SUB_SAMPLE:
                    rows, index, parts = fitted(held, cell[0])
                    held, ready = [], True
                    for piece in chunks(rows):
                        yield from parted(piece, index, parts).combine_chunks().to_batches()
        if held:
            rows, index, parts = fitted(held, cell[0])
            for piece in chunks(rows):
                yield from parted(piece, index, parts).combine_chunks().to_batches()

    # Cells are balanced, so a task per cell is even; a cell streams through and is never held whole.
    ordered = lists.withColumn("joins", F.col("role").bitwiseAND(F.lit(1).cast("tinyint"))).withColumn("h", F.xxhash64("id"))
    ordered = ordered.repartition("tbl", "list").sortWithinPartitions("tbl", "list", F.desc("joins"), "h")
    return ordered.select(*names).mapInArrow(split, fields)


def neighbours(vectors: DataFrame, k: int = 5, min_cosine: float = -1.0, dim: int = 128) -> DataFrame:
    """(tbl, id, other, cosine): up to k vectors of the same table most similar to each, of at least `min_cosine`.

    `vectors` has (tbl, id, vec). Vectors that are null, of another length, all zero or hold
    NaN or infinities take no part; a repeated id counts once; ties go to the smaller id.
    """
    codes = packed(vectors, dim)
    reps = write_once(codes.groupBy("tbl", "code").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")))
    lists = placed_lists(reps, fit(reps, dim), dim)

    def compared(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        names = np.array(table.column("id").to_pylist(), dtype=object)
        x = unpack(table.column("code").to_pylist(), dim)
        order = np.argsort(names)
        role, names, x = role[order], names[order], x[order]
        data, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        ids, others, cosines = [], [], []
        for a in range(0, len(asks), 1024):
            own = asks[a : a + 1024]
            score = x[own] @ x[data].T
            score[own[:, None] == data[None, :]] = -np.inf
            fine = (score >= min_cosine) & np.isfinite(score)
            many = np.flatnonzero(fine.sum(axis=1) > k)
            # Ties at the k-th place are all kept here; the last step orders them by id.
            if len(many):
                edge = np.partition(score[many], len(data) - k, axis=1)[:, len(data) - k][:, None]
                fine[many] &= score[many] >= edge
            q, d = np.nonzero(fine)
            if len(q) > (k + 16) * len(own):  # many ties: the first k in id order are enough
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                q, d = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel()
                fine = (score[q, d] >= min_cosine) & np.isfinite(score[q, d])
                q, d = q[fine], d[fine]
            ids.append(names[own[q]])
            others.append(names[data[d]])
            cosines.append(score[q, d].astype(np.float64))
        ids, others = (np.concatenate(v) if v else np.empty(0, dtype=object) for v in (ids, others))
        tbl = table.column("tbl")[0].as_py()
        cosine = pa.array(np.concatenate(cosines) if cosines else np.empty(0), pa.float64())
        return pa.table({"tbl": pa.array([tbl] * len(ids), pa.string()), "id": pa.array(ids.tolist(), pa.string()), "other": pa.array(others.tolist(), pa.string()), "cosine": cosine})

    hits = lists.groupBy("tbl", "list").applyInArrow(compared, "tbl string, id string, other string, cosine double")
    hits = hits.groupBy("tbl", "id", "other").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(W.partitionBy("tbl", "id").orderBy(F.desc("cosine"), "other"))
    hits = hits.withColumn("place", place).filter(F.col("place") <= k).drop("place")
    return _with_copies(codes, reps, hits, k, min_cosine)


def _with_copies(codes: DataFrame, reps: DataFrame, hits: DataFrame, k: int, min_cosine: float) -> DataFrame:
    """Puts the copies of equal vectors back: members ask like their representative, and the k + 1 smallest ids answer."""
    several = reps.filter("rows > 1").select("tbl", "code", F.col("id").alias("rep"))
    members = write_once(codes.join(several, ["tbl", "code"]).select("tbl", "id", "rep").distinct())
    place = F.row_number().over(W.partitionBy("tbl", "rep").orderBy("id"))
    answering = members.withColumn("place", place).filter(F.col("place") <= k + 1).select("tbl", "rep", F.col("id").alias("member"))
    askers = hits.join(members.select("tbl", F.col("rep").alias("id"), F.col("id").alias("asker")), ["tbl", "id"], "left")
    askers = askers.select("tbl", F.coalesce("asker", "id").alias("id"), "other", "cosine")
    answers = askers.join(answering.select("tbl", F.col("rep").alias("other"), "member"), ["tbl", "other"], "left")
    answers = answers.select("tbl", "id", F.coalesce("member", "other").alias("other"), "cosine")
    own = members.join(answering, ["tbl", "rep"]).filter("id <> member").select("tbl", "id", F.col("member").alias("other"), F.lit(1.0).alias("cosine"))
    found = answers.unionByName(own).filter(F.col("cosine") >= min_cosine)
    place = F.row_number().over(W.partitionBy("tbl", "id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def chunk_and_cache_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "chunks", ["id", "embedding"]).select(F.lit("chunks").alias("tbl"), "id", F.col("embedding").alias("vec"))
    cache = load(spark, sf_dir, "cache_entries", ["entry_id", "embedding"]).select(F.lit("cache_entries").alias("tbl"), F.col("entry_id").alias("id"), F.col("embedding").alias("vec"))
    return chunks.unionByName(cache)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of which one is among the five nearest of the other, with cosine >= 0.8."""
    found = neighbours(chunk_and_cache_vectors(spark, sf_dir), 5, 0.8)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, place, other, cosine): the five most similar vectors of each vector."""
    found = neighbours(chunk_and_cache_vectors(spark, sf_dir), 5)
    return found.withColumn("place", F.row_number().over(W.partitionBy("tbl", "id").orderBy(F.desc("cosine"), "other")))


def p4_recall(spark: SparkSession, sf_dir: str, least: float = 0.9) -> DataFrame:
    """(tbl, asked, enough): the vectors whose id is divisible by 50, and whether at least `least` of their five nearest by brute force against all rows are among those of the index.

    Vectors as near as the fifth nearest (ties) count as nearest; if none is asked for, enough is true.
    """
    rows = write_once(chunk_and_cache_vectors(spark, sf_dir).filter("id is not null").dropDuplicates(["tbl", "id"]).filter(F.exists("vec", lambda x: x != 0)))
    found = write_once(neighbours(rows, 5).select("tbl", "id", "other", "cosine"))
    out = None
    for tbl in ("chunks", "cache_entries"):
        own = rows.filter(F.col("tbl") == tbl).select("id", F.col("vec").alias("embedding"))
        asked = own.filter(F.regexp_extract("id", r"([0-9]+)", 1).cast("bigint") % 50 == 0)
        # One more than five: the vector itself is among its nearest.
        exact = top_k(asked, own, 6).filter("query_id <> item_id").withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).filter("place <= 5")
        fifth = exact.groupBy("query_id").agg(F.min("score").alias("edge"), F.count(F.lit(1)).alias("wanted"))
        ours = found.filter(F.col("tbl") == tbl).join(fifth, F.col("id") == F.col("query_id"), "right").groupBy("query_id", "wanted").agg(F.count_if(F.col("cosine") >= F.col("edge") - 1e-3).alias("hits"))
        one = ours.agg(F.lit(tbl).alias("tbl"), F.count(F.lit(1)).alias("asked"), F.coalesce(F.sum(F.least("hits", "wanted")) >= least * F.sum("wanted"), F.lit(True)).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall}

#: The same pairs by comparing every vector with every other.
_EXACT = """SELECT least(id, other) AS id_a, greatest(id, other) AS id_b FROM (
  SELECT q.id, i.id AS other, list_cosine_similarity(q.v, i.v) AS c, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, i.v) DESC, i.id) AS place
  FROM {t} q JOIN {t} i ON q.id <> i.id) WHERE place <= 5 AND c >= 0.8"""
_USABLE = "len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
ORACLES = {
    "p4_found": f"WITH a AS (SELECT DISTINCT ON (id) id, embedding AS v FROM chunks WHERE {_USABLE}), b AS (SELECT DISTINCT ON (entry_id) entry_id AS id, embedding AS v FROM cache_entries WHERE {_USABLE}) "
    f"SELECT DISTINCT * FROM ({_EXACT.format(t='a')}) UNION SELECT DISTINCT * FROM ({_EXACT.format(t='b')})",
    "p4_recall": f"SELECT 'chunks' AS tbl, count(DISTINCT id) AS asked, true AS enough FROM chunks WHERE {_USABLE} AND CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT) % 50 = 0 UNION ALL "
    f"SELECT 'cache_entries', count(DISTINCT entry_id), true FROM cache_entries WHERE {_USABLE} AND CAST(regexp_extract(entry_id, '([0-9]+)', 1) AS BIGINT) % 50 = 0",
}
