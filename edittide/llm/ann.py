"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more coordinate, which makes all of them equally long, so the largest inner product is the
smallest distance. Centroids are fitted on a bounded sample and split until the sample's lists are balanced; a
graph of near centroids is held in memory and searched from a few entries. Each distinct vector goes to the list of its
nearest centroid and, near a boundary, to those whose distance is within a ratio of it. A query reads the lists
within a wider ratio. What it finds there is a floor for its results: a sweep over all lists scores every vector of each list whose
bounding cap can hold a score of the floor or more, so results are exact, whatever the lists that were read first. A query that found too few has
no floor and skips no list until the sweep gives it one. Equal vectors are searched once, and give their smallest ids. Without `exact` the
lists that are read first give the results, and nothing is swept: cheaper, but how many of the nearest are found depends on how clustered the vectors are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edittide.llm.common import cut

#: Vectors to fit centroids on; vectors of a list; lists at most; rows of a list that one task holds.
SAMPLE, LIST, LISTS, BLOCK = 20_000, 64, 2_048, 4_096
#: Ratio of distances up to which a vector is replicated, and its lists at most; the same for a query's lists.
NEAR, COPIES, WIDE, PROBES = 1.06, 4, 1.35, 48
#: Near centroids of each in the graph; entries; centroids kept in a search for a query's lists, and for a vector's.
DEGREE, ENTRIES, KEPT, KEPT_OWN = 24, 32, 64, 16
#: Of the sweep: components of the queries that are sent at once (more take more sweeps), vectors scored at once, pairs held by a task.
SENT, PIECE, HELD = 4_000_000, 512, 1_000_000


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def centroids(x: np.ndarray, lists: int, seed: int = 7, steps: int = 8) -> np.ndarray:
    """k-means centres of x; lists of over twice the mean size are split in two."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(steps):
        own = np.concatenate([_squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        at = np.concatenate([[0], np.cumsum(n)])
        c = np.stack([x[order[at[i] : at[i + 1]]].mean(0) if n[i] else c[i] for i in range(len(c))])
        big = np.flatnonzero(n > 2 * len(x) / len(c))
        empty = np.flatnonzero(n == 0)
        for i, e in zip(big, empty):
            c[e] = x[order[at[i]]]
        if len(big) > len(empty) and len(c) < 2 * lists:
            c = np.concatenate([c, np.stack([x[order[at[i + 1] - 1]] for i in big[len(empty) :]])])
    return c


class Graph:
    """Centroids with their nearest centroids, searched best first for many vectors at once."""

    def __init__(self, c: np.ndarray, seed: int = 11):
        self.c = c.astype(np.float32)
        self.norm = (self.c * self.c).sum(1)
        self.near = np.stack([np.argsort(r, kind="stable")[1 : DEGREE + 1] for r in _squares(c, c)]).astype(np.int32) if len(c) > 1 else np.zeros((1, 0), np.int32)
        self.entries = np.sort(np.random.default_rng(seed).choice(len(c), min(ENTRIES, len(c)), replace=False)).astype(np.int32)

    def search(self, x: np.ndarray, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (rows x kept) of near centroids, nearest first; beyond what is found the distance is infinite."""
        x = x.astype(np.float32)
        square = (x * x).sum(1)
        kept, rows = min(kept, len(self.c)), np.arange(len(x))[:, None]
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        d = self.norm[ids] + square[:, None] - 2 * x @ self.c[self.entries].T
        seen, done = np.zeros((2, len(x), len(self.c)), bool)
        slot = np.zeros((len(x), len(self.c)), np.int16)
        seen[rows, ids] = True
        while True:
            if d.shape[1] > kept:
                best = np.argpartition(d, kept - 1, axis=1)[:, :kept]
                ids, d = ids[rows, best], d[rows, best]
            open_ = np.where(done[rows, ids], np.inf, d)
            if not np.isfinite(open_).any():
                break
            pick = np.argpartition(open_, min(4, kept) - 1, axis=1)[:, :4]
            ok, now = np.isfinite(open_[rows, pick]), ids[rows, pick]
            done[np.broadcast_to(rows, now.shape)[ok], now[ok]] = True
            more = self.near[now].reshape(len(x), -1)
            slot[rows, more] = np.arange(more.shape[1], dtype=np.int16)
            new = np.repeat(ok, self.near.shape[1], axis=1) & ~seen[rows, more] & (slot[rows, more] == np.arange(more.shape[1]))
            seen[rows, more] |= new
            r, col = np.nonzero(new)
            far = np.full(more.shape, np.inf, np.float32)
            node = more[r, col]
            far[r, col] = self.norm[node] + square[r] - 2 * np.einsum("ij,ij->i", self.c[node], x[r])
            ids, d = np.concatenate([ids, more], 1), np.concatenate([d, far], 1)
        order = np.argsort(d, axis=1, kind="stable")
        return ids[rows, order], np.sqrt(np.maximum(d[rows, order], 0)).astype(np.float64)


def _lists(graph, longest: float, query: bool, number: pa.DataType):
    """Rows (key, v): a row (key, list, v, own, lists) for each of the vector's lists; own: the first; lists: how many there are."""
    schema = pa.schema([("key", pa.int64()), ("list", pa.int64()), ("v", pa.list_(number)), ("own", pa.bool_()), ("lists", pa.int64())])
    ratio, most, kept = (WIDE, PROBES, KEPT) if query else (NEAR, COPIES, KEPT_OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
                ids, d = g.search(np.column_stack([x, lift]), kept)
                keep = (d <= ratio * d[:, :1] + 1e-12) & np.isfinite(d)
                keep[:, most:] = False
                row, col = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(ids[row, col]), part.column(1).take(pa.array(row)).cast(pa.list_(number)), pa.array(col == 0), pa.array(keep.sum(1)[row])], schema=schema)

    return run


def _swept(sent, k: int, longest: float):
    """Rows (list, key, v), sorted by list: pairs (query, key, score) that can be among a query's k best."""
    schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q, floor = sent.value
        q, floor = q.astype(np.float64), floor.copy()
        size = np.sqrt((q * q).sum(1))
        slack = 1e-9 * longest * size
        held: list[tuple[np.ndarray, ...]] = []
        pairs = 0

        def settled() -> tuple[np.ndarray, ...]:
            who, key, score = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((key, -score, who))
            who = who[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = order[rank == k - 1]
            last_of = who[rank == k - 1]
            floor[last_of] = np.maximum(floor[last_of], score[last])
            order, who = order[rank < k], who[rank < k]
            return who, key[order], score[order]

        for b in batches:
            if not b.num_rows:
                continue
            lists, keys = (b.column(i).to_numpy() for i in range(2))
            x = np.stack(b.column(2).to_numpy(zero_copy_only=False)).astype(np.float64)
            ends = np.append(np.flatnonzero(lists[1:] != lists[:-1]) + 1, len(lists))
            start = 0
            for end in ends:
                for i in range(start, end, PIECE):
                    v = x[i : min(i + PIECE, end)]
                    # Lifted vectors are all `longest` long, so a piece lies in a cap around its mean, and a query's best is on its near edge.
                    lifted = np.column_stack([v, np.sqrt(np.maximum(longest**2 - (v * v).sum(1), 0))])
                    mid = lifted.mean(0)
                    norm = np.sqrt(mid @ mid)
                    best = size * longest
                    if norm > 1e-9 * longest:
                        mid /= norm
                        wide = np.arccos(np.clip((lifted @ mid).min() / longest, -1, 1))
                        best = best * np.cos(np.maximum(np.arccos(np.clip(q @ mid[:-1] / size, -1, 1)) - wide - 1e-6, 0))
                    ask = np.flatnonzero(best >= floor - slack)
                    for j in range(0, len(ask), 1024):
                        part = ask[j : j + 1024]
                        row, col = np.nonzero(q[part] @ v.T >= (floor - slack)[part, None])
                        if len(row):
                            held.append((part[row], keys[i + col], (v[col] * q[part[row]]).sum(1)))
                            pairs += len(row)
                        if pairs > HELD:
                            held = [settled()]
                            pairs = len(held[0][0])
                            # What has to be held for so many queries can be more than HELD.
                            if pairs > HELD // 2:
                                yield pa.RecordBatch.from_arrays([pa.array(queries[held[0][0]]), *(pa.array(c) for c in held[0][1:])], schema=schema)
                                held, pairs = [], 0
                start = end
        if held:
            who, *rest = settled()
            yield pa.RecordBatch.from_arrays([pa.array(queries[who]), *(pa.array(c) for c in rest)], schema=schema)

    return run


def _scored(k: int):
    """Rows sorted by (list, salt, kind): a block of a list (kind 0), then queries (kind 1). Pairs (query, key, score): the `take` best of a query
    in a block, with all that are as good as the last one, and no more than k of what the task holds."""
    schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

    def settled(out: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        who, key, score = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((key, -score, who))
        who, key, score = who[order], key[order], score[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])
        who, key, score = who[new], key[new], score[new]
        first = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[first], key[first], score[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, vectors, block = None, [], [], None
        out: list[tuple[np.ndarray, ...]] = []
        pairs = 0
        for b in batches:
            if not b.num_rows:
                continue
            lists, salts, kinds, ids, takes = (b.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
            x = np.stack(b.column(4).to_numpy(zero_copy_only=False)).astype(np.float64)
            turns = (lists[1:] != lists[:-1]) | (salts[1:] != salts[:-1]) | (kinds[1:] != kinds[:-1])
            ends = [0, *(np.flatnonzero(turns) + 1).tolist(), len(lists)]
            for start, end in zip(ends, ends[1:]):
                for i in range(start, end, 256):
                    j = min(i + 256, end)
                    where = (lists[i], salts[i])
                    if where != at:
                        at, keys, vectors, block = where, [], [], None
                    if kinds[i] == 0:
                        keys.append(ids[i:j])
                        vectors.append(x[i:j])
                        block = None
                    elif keys:
                        if block is None:
                            block = np.concatenate(vectors), np.concatenate(keys)
                        v, own = block
                        rough = x[i:j] @ v.T
                        some = min(int(takes[i:j].max()), len(own))
                        top = -np.sort(np.partition(-rough, some - 1, axis=1)[:, :some], axis=1)
                        # what is as good as the last one, but for rounding, is scored too, so that ties go by id
                        least = np.take_along_axis(top, np.minimum(takes[i:j], some)[:, None] - 1, 1) - 1e-9 * (np.abs(top[:, :1]) + 1)
                        row, col = np.nonzero(rough >= least)
                        out.append((ids[i:j][row], own[col], (v[col] * x[i:j][row]).sum(1)))
                        pairs += len(row)
                    if pairs > HELD:
                        out = [settled(out)]
                        pairs = len(out[0][0])
                        # What has to be held for so many queries can be more than HELD.
                        if pairs > HELD // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out[0]], schema=schema)
                            out, pairs = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in settled(out)], schema=schema)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, exact: bool = True) -> DataFrame:
    """Per row of `queries` (vec_id, embedding) its k nearest rows of `vectors` but itself: query_id, rank, vec_id, score.

    score: inner product in double precision, of the vectors as they are (array of float or double); ties to the smaller vec_id. A vector that is
    null, zero, or holds null or non-finite components takes no part, nor does one whose dimension is not that of most rows, nor one without
    vec_id. Rows that share a vec_id are one vector, the first in the order of arrays. No vectors: no rows. Not `exact`: of the lists that
    are read first only.
    """
    spark = vectors.sparkSession
    double = any(f.name == "embedding" and f.dataType.simpleString() == "array<double>" for df in (vectors, queries) for f in df.schema.fields)
    kind, number = ("double", pa.float64()) if double else ("float", pa.float32())

    def usable(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast(f"array<{kind}>")
        bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        ok = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: x + F.lit(0.0).cast(kind)).alias("v"), bad.alias("bad"))
        return ok.filter("vec_id is not null and v is not null and not bad").filter(F.exists("v", lambda x: x != 0))

    all_, asked = usable(vectors), usable(queries)
    sizes = all_.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_, asked = (df.filter(F.size("v") == sizes["d"]).groupBy("vec_id").agg(F.min("v").alias("v")) for df in (all_, asked))
    # A vector's key is the smallest of its ids. Of each, the k + 1 smallest ids are kept; the limit works before the shuffle.
    w = Window.partitionBy("v").orderBy("vec_id")
    few = cut(all_.withColumns({"r": F.row_number().over(w), "key": F.first("vec_id").over(w)}).filter(F.col("r") <= k + 1))
    distinct = few.filter("r = 1").select("key", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, longest = distinct.agg(F.count("*"), F.max(norm)).first()
    picked = distinct.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()
    x = np.array(picked["v"].to_pylist(), np.float64)
    x = np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))])
    graph = spark.sparkContext.broadcast(Graph(centroids(x, max(1, min(LISTS, n // LIST, len(x) // 8 or 1)))))

    rows_of = f"key long, list long, v array<{kind}>, own boolean, lists long"
    posted = cut(distinct.mapInArrow(_lists(graph, longest, False, number), rows_of))
    each_asked = asked.groupBy("v").agg(F.min("vec_id").alias("key")).select("key", "v")
    probes = each_asked.mapInArrow(_lists(graph, longest, True, number), rows_of)
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    # To find a floor, the more lists a query reads, the fewer of the best of each it takes.
    cells = ("list", "salt", "kind", "key", "v", "take")
    take = F.least(F.lit(k + 1), F.ceil(F.lit(3 * (k + 1)) / F.col("lists"))) if exact else F.lit(k + 1)
    dealt = posted.join(blocks, "list").withColumn("salt", F.pmod(F.xxhash64("key"), "blocks"))
    members = dealt.withColumns({"kind": F.lit(0), "take": F.lit(0).cast("long")}).select(*cells)
    ask = probes.join(blocks, "list").withColumns({"salt": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "kind": F.lit(1), "take": take.cast("long")}).select(*cells)
    rows = members.unionByName(ask).repartition("list", "salt").sortWithinPartitions("list", "salt", "kind")
    found = rows.mapInArrow(_scored(k + 1), "query long, key long, score double").distinct()
    pairs = found
    if exact:
        # The floor of a query that found k + 1 vectors is the last one's score; the others have none.
        top = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("r") <= k + 1)
        floors = top.groupBy(F.col("query").alias("key")).agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
        waiting = cut(each_asked.join(floors, "key", "left").select("key", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
        sweeps = max(1, -(-waiting.count() * sizes["d"] // SENT))
        whole = dealt.filter("own").repartition("list", "salt").sortWithinPartitions("list").select("list", "key", "v")
        whole = cut(whole) if sweeps > 1 else whole
        swept = []
        for i in range(sweeps):
            some = waiting.filter(F.pmod(F.xxhash64("key"), F.lit(sweeps)) == i).toArrow()
            q = np.array(some["v"].to_pylist(), np.float64).reshape(some.num_rows, sizes["d"])
            sent = spark.sparkContext.broadcast((some["key"].to_numpy(), q, some["floor"].to_numpy()))
            swept.append(cut(whole.mapInArrow(_swept(sent, k + 1, longest), "query long, key long, score double")))
            sent.destroy()
        pairs = reduce(DataFrame.unionByName, swept)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    first = pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("query", "key", "score")
    each = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = first.join(few.select("key", "vec_id"), "key").withColumn("r", F.row_number().over(each)).filter(F.col("r") <= k + 1).select("query", "vec_id", "score")
    names = asked.join(each_asked.select(F.col("key").alias("query"), "v"), "v").select(F.col("vec_id").alias("query_id"), "query")
    out = names.join(ids, "query").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
