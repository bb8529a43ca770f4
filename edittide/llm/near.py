"""Near duplicates by fast similarity sketching, banding and exact verification.

1. Texts become sets of word-shingle hashes. Rows with the same set are one class, whose smallest
   doc_id stands for it from here on.
2. Each set gets a sketch of t coordinates in rounds of hashed bin placement: a round throws every
   element into one bin, a bin keeps the smallest value of the first round that reaches it, and from
   round t on, bin i gets all elements. So every coordinate is filled after 2t rounds at most, after
   about t ln t throws in all, and agreement of coordinates concentrates around the similarity.
3. Bands of coordinates are hashed into buckets. In a bucket every member is verified against the
   bucket's smallest id on the full sets: linear in the bucket, whatever its size.
4. Classes that a bucket holds but that these links do not join may still be linked to each other.
   Such a class meets the others of its hub in tiles of bounded size that hold sketches, at four bits a coordinate, and no
   texts. Sizes, the triangle inequality on the distances to the hub and the agreement of the sketches choose pairs; rows
   without a pair end here. For the rest the texts are fetched and the tile compares the same pairs on the full sets,
   emitting only links that join components. Nothing is capped.
5. Links become components by alternating large-star and small-star steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edittide.llm import words as W
from edittide.llm.common import cut

#: Coordinates of a band, and the chance that a pair at the threshold shares no band.
ROWS, MISS = 5, 1e-6
#: Sketch coordinates for each one that the bands use; the rest sharpen the comparison of sketches.
WIDER = 6
#: Members of a hub that one task verifies against it.
BLOCK_MEMBERS = 512
#: Members, and their shingles, that one tile of a hub holds on average, and the texts that ask it.
TILE_MEMBERS, TILE_SHINGLES, TILE_ASKERS = 2048, 4_000_000, 2048
#: Rows of four numbers at most that may be broadcast, by their count.
SMALL_TABLE = 500_000
#: Standard deviations of sketch agreement below the threshold that are still verified.
SLACK = 4.75


def bands_for(threshold: float) -> int:
    """Bands of ROWS coordinates that miss a pair at the threshold with a chance of MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))


def sketches(h: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """Sketch (rows x t) of each run h[at[i]:at[i + 1]] of distinct hashes; an empty run has all ones."""
    rows = len(at) - 1
    out = np.full(rows * t, np.iinfo(np.uint64).max, np.uint64)
    own = np.repeat(np.arange(rows), np.diff(at))
    full = np.diff(at) == 0
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for i in range(2 * t):
        x = W.mix(h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        to = ((x >> half) * np.uint64(t) >> half).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out, own * t + to, np.uint64(i << 32) | (x & low))
        now = (out.reshape(rows, t) != np.iinfo(np.uint64).max).all(axis=1)
        if (now != full).any():
            full = now | full
            left = ~full[own]
            h, own = h[left], own[left]
        if not len(h):
            break
    return out.reshape(rows, t)


_SKETCH = "doc_id long, h long, n long, f1 long, f2 long, bands array<long>, bits binary"


def _sketched(k: int, bands: int):
    inside = W.table("space")
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, h, at in W.shingles(b.column(2), k, inside):
                n = np.diff(at)
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(W.mix(h), out=sums[0, 1:])
                np.cumsum(W.mix(h ^ np.uint64(0x2545F4914F6CDD1D)), out=sums[1, 1:])
                f = (sums[:, at[1:]] - sums[:, at[:-1]]).astype(np.int64)
                s = sketches(h, at, WIDER * bands * ROWS)
                band = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], rows, axis=0)
                for j in range(ROWS):
                    band = W.mix(band * np.uint64(0x9E3779B97F4A7C15) + s[:, j : bands * ROWS : ROWS])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * bands), pa.array(band.astype(np.int64).ravel()))
                bits = (W.mix(s) & np.uint64(15)).astype(np.uint8)
                bits = bits[:, ::2] << 4 | bits[:, 1::2]
                ids = [b.column(i).slice(first, rows) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n), pa.array(f[0]), pa.array(f[1]), lists, pa.array([r.tobytes() for r in bits], pa.binary())], schema=schema)

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    if not len(few):
        return 0
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())


def _compared(k: int):
    """Rows sorted by (hub, salt, kind): the hub's text first (kind 0), then texts to compare with it."""
    inside = W.table("space")
    schema = pa.schema([("hub", pa.int64()), ("doc", pa.int64()), ("common", pa.int64()), ("of_hub", pa.int64()), ("of_doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(0, np.uint64)
        for b in batches:
            hubs, salts, kinds, docs = (b.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for first, rows, h, at in W.shingles(b.column(4), k, inside):
                for i in range(rows):
                    r, mine = first + i, h[at[i] : at[i + 1]]
                    if kinds[r] == 0:
                        key, held = (hubs[r], salts[r]), mine.copy()
                    elif key == (hubs[r], salts[r]) and len(held):
                        out.append((hubs[r], docs[r], _shared(held, mine), len(held), len(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, schema=schema)

    return run


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is among `ids` (one column, doc_id), or more: ids that are too many to broadcast choose nothing,
    and the join that follows leaves out the rest."""
    ids = cut(ids.distinct())
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= SMALL_TABLE else docs


def verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(hub, doc, common, of_hub, of_doc) of each distinct pair (hub, doc), from the full sets.

    Pairs of a hub of over BLOCK_MEMBERS are dealt in blocks, each of which streams past the hub's set.
    """
    docs = _texts_of(pairs.select(F.explode(F.array("hub", "doc")).alias("doc_id")), docs)
    large = cut(pairs.groupBy("hub").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK_MEMBERS))
    if large.count() <= SMALL_TABLE:  # then the pairs need not meet by hub, which may be hot
        large = F.broadcast(large)
    salted = pairs.join(large, "hub", "left").select("hub", "doc", F.coalesce(F.pmod(F.xxhash64("doc"), F.ceil(F.col("c") / BLOCK_MEMBERS)), F.lit(0)).cast("long").alias("salt"))
    members = salted.join(docs, salted.doc == docs.doc_id).select("hub", "salt", F.lit(1).alias("kind"), "doc", "text")
    heads = salted.select("hub", "salt").distinct()
    hubs = heads.join(docs, heads.hub == docs.doc_id).select("hub", "salt", F.lit(0).alias("kind"), F.col("hub").alias("doc"), "text")
    rows = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    return rows.mapInArrow(_compared(k), "hub long, doc long, common long, of_hub long, of_doc long").distinct()


_TILE = "hub long, tile long, kind int, doc long, comp long, n long, far double, bits binary"
#: Coordinates, of two, in which two bytes of sketch agree, by their exclusive or.
_EQUAL = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def _packed(block: list[tuple]) -> tuple[np.ndarray, ...]:
    """Arrays of the members of a tile, from rows that start with (doc, comp, n, far, kind, bits)."""
    return tuple(np.array(c) for c in list(zip(*block))[:5]) + (np.frombuffer(b"".join(x[5] for x in block), np.uint8).reshape(len(block), -1),)


def _chosen(members: tuple[np.ndarray, ...], asker: tuple, low: float, percent: int) -> np.ndarray:
    """Places of the members that are compared with the asker (doc, comp, n, far, bits): of other components, close enough by their
    sizes and distances to the hub, with sketches that agree in `low` of the coordinates at least."""
    docs, comps, ns, fars, kinds, sketch = members
    doc, comp, n, far, bits = asker
    apart, least = 1 - percent / 100 + 1e-9, percent / 100 - 1e-9
    # two texts that ask meet twice; the larger id compares them
    fit = (comps != comp) & ((kinds == 0) | (docs < doc)) & (np.abs(fars - far) <= apart) & (np.minimum(ns, n) >= least * np.maximum(ns, n))
    near = np.flatnonzero(fit)
    same = _EQUAL[sketch[near] ^ np.frombuffer(bits, np.uint8)].mean(axis=1) / 2
    return near[same >= low]


def _with_pairs(low: float, percent: int):
    """Rows sorted by (hub, tile, kind, doc), as in `_near_blocks` but without texts: those that the tile compares with any other."""
    names = [f.split()[0] for f in _TILE.split(", ")]
    schema = pa.schema([pa.field(n, t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, members, used = None, [], None, np.zeros(0, bool)

        def kept() -> list[tuple]:
            return [(*key, kind, doc, comp, n, far, bits) for (doc, comp, n, far, kind, bits), u in zip(block, used) if u]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(names), schema)], schema=schema)

        for batch in batches:
            out: list[tuple] = []
            for hub, tile, kind, doc, comp, n, far, bits in zip(*(batch.column(c).to_pylist() for c in names)):
                if (hub, tile) != key:
                    out += kept()
                    key, block, members, used = (hub, tile), [], None, np.zeros(0, bool)
                if kind < 2:
                    block.append((doc, comp, n, far, kind, bits))
                elif block:
                    if members is None:
                        members, used = _packed(block), np.zeros(len(block), bool)
                    near = _chosen(members, (doc, comp, n, far, bits), low, percent)
                    if len(near):
                        used[near] = True
                        out.append((hub, tile, kind, doc, comp, n, far, bits))
            yield batch_of(out)
        yield batch_of(kept())

    return run


def _near_blocks(k: int, low: float, percent: int):
    """Rows sorted by (hub, tile, kind, doc): a block of members (kind 0: in the hub's component, 1: not), then texts that ask
    it (kind 2).

    The `_chosen` pairs are compared on their full sets, here in the block. Emits the linked pairs that join
    components which the block has not joined so far: fewer than it has texts, whatever the number of pairs.
    """
    inside = W.table("space")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, packed, parent = None, [], None, {}

        def root(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for batch in batches:
            names = ("hub", "tile", "kind", "doc", "comp", "n", "far", "bits")
            rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
            found: list[tuple[int, int]] = []
            for first, count, h, at in W.shingles(batch.column("text"), k, inside):
                for i in range(count):
                    hub, tile, kind, doc, comp, n, far, bits = rows[first + i]
                    mine = h[at[i] : at[i + 1]]
                    if (hub, tile) != key:
                        key, block, packed, parent = (hub, tile), [], None, {}
                    if kind < 2:
                        block.append((doc, comp, n, far, kind, bits, mine.copy()))
                        packed = None
                        continue
                    if not block:
                        continue
                    if packed is None:
                        packed = _packed(block)
                    docs, comps = packed[:2]
                    for x in _chosen(packed, (doc, comp, n, far, bits), low, percent).tolist():
                        one, other = root(int(comps[x])), root(comp)
                        if one == other:
                            continue
                        common = _shared(block[x][6], mine)
                        if 100 * common >= percent * (len(block[x][6]) + len(mine) - common):
                            parent[max(one, other)] = min(one, other)
                            found.append((min(doc, int(docs[x])), max(doc, int(docs[x]))))
            yield pa.RecordBatch.from_arrays([pa.array([q[z] for q in found], pa.int64()) for z in (0, 1)], schema=schema)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges: the smallest node that it reaches.

    Large-star and small-star steps alternate until the edges are stars around their smallest node. Each
    step is a shuffle by node; nothing but a count of changes reaches the driver.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = cut(nxt)
        moved = nxt.join(e, ["u", "v"], "left_anti").limit(1).count() + e.join(nxt, ["u", "v"], "left_anti").limit(1).count()
        e = nxt
        if not moved:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def content_order(text: str) -> Column:
    """Of rows that share a doc_id, the first in this order is the one that is judged."""
    return F.desc(F.xxhash64(F.col(text).cast("string")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept, class_id.

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles (words:
    runs of other than ASCII white space, A-Z lower-cased). A text of fewer words is one shingle; a null
    or wordless text has an empty set and links with nothing. class_id: the smallest doc_id with the same
    set. Rows without a doc_id come back with a null component and kept = false. Rows that share a doc_id are one document: the text that
    is first by `content_order` is judged, and all of them have its results.
    """
    bands = bands_for(percent / 100)
    t = WIDER * bands * ROWS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    own = cut(docs.select("doc_id", "h", "text").mapInArrow(_sketched(k, bands), _SKETCH))
    judged, each = own, own.select("doc_id", "n", "f1", "f2")
    several = own.filter("doc_id is not null").groupBy("doc_id").agg(F.max("h").alias("top"), F.min("h").alias("low")).filter("top <> low").select("doc_id", "top")
    several = cut(several)
    if not several.isEmpty():
        of_first = lambda df: df.join(several, "doc_id", "left").filter("top is null or h = top").drop("top")
        judged, docs = of_first(own), of_first(docs)
        first = judged.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", *[F.col(c).alias(f"{c}_") for c in ("n", "f1", "f2")]).distinct()
        each = each.join(first, "doc_id", "left").select("doc_id", *[F.coalesce(f"{c}_", c).alias(c) for c in ("n", "f1", "f2")])
    some = judged.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    reps = cut(some.join(classes.select("n", "f1", "f2", F.col("rep").alias("doc_id")), ["n", "f1", "f2", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "bands", "bits"))

    spread = reps.select("doc_id", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
    pairs = cut(spread.join(hubs, "bucket").filter("doc_id <> hub").select("hub", F.col("doc_id").alias("doc")).distinct())
    joined = "100 * common >= {0} * (of_hub + of_doc - common)".format(percent)
    first = cut(verified(pairs, docs, k))
    links = first.filter(joined).select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    label = cut(components(links))

    at = first.select("hub", "doc", (1 - F.col("common") / (F.col("of_hub") + F.col("of_doc") - F.col("common"))).alias("far"), F.col("of_doc").alias("n"))
    seen = at.unionByName(at.select("hub", F.col("hub").alias("doc"), F.lit(0.0).alias("far"), F.lit(0).cast("long").alias("n")).distinct())
    seen = seen.join(label.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    of_hub = seen.groupBy("hub").agg(F.max(F.when(F.col("doc") == F.col("hub"), F.col("comp"))).alias("home"), F.count("*").alias("c"), F.sum("n").alias("total"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    blocks = F.greatest(F.ceil(F.col("c") / TILE_MEMBERS), F.ceil(F.col("total") / TILE_SHINGLES)).cast("long")
    mixed = cut(of_hub.filter("lo <> hi").select("hub", "home", blocks.alias("blocks"), F.ceil(F.col("c") / TILE_ASKERS).cast("long").alias("turns")))
    if mixed.count() <= SMALL_TABLE:  # as above; beyond that, the join is on its own, so that Spark can split a hot hub
        mixed = F.broadcast(mixed)
    loose = seen.join(mixed, "hub").filter("doc <> hub").withColumn("kind", F.when(F.col("comp") == F.col("home"), 0).otherwise(1))
    asked = loose.join(reps.select(F.col("doc_id").alias("doc"), "bits"), "doc")
    # a tile compares one block of members with one turn of texts that ask
    block, turn = F.pmod(F.xxhash64("doc"), F.col("blocks")), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("turns"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    member = F.transform(F.sequence(zero, F.col("turns") - one), lambda x: F.struct((x * F.col("blocks") + block).alias("tile"), F.col("kind").alias("kind")))
    asks = F.transform(F.sequence(zero, F.col("blocks") - one), lambda x: F.struct((turn * F.col("blocks") + x).alias("tile"), F.lit(2).alias("kind")))
    dealt = asked.withColumn("at", F.explode(F.when(F.col("kind") == 0, member).otherwise(F.concat(member, asks))))
    rows = dealt.select("hub", F.col("at.tile").alias("tile"), F.col("at.kind").alias("kind"), "doc", "comp", "n", "far", "bits")
    j = percent / 100 + (1 - percent / 100) / 16  # coordinates are held as four bits
    low = j - SLACK * math.sqrt(j * (1 - j) / t)
    tiled = lambda df: df.repartition("hub", "tile").sortWithinPartitions("hub", "tile", "kind", "doc")
    rows = cut(tiled(rows).mapInArrow(_with_pairs(low, percent), _TILE))
    rows = rows.join(_texts_of(rows.select(F.col("doc").alias("doc_id")), docs).select(F.col("doc_id").alias("doc"), "text"), "doc")
    second = tiled(rows).mapInArrow(_near_blocks(k, low, percent), "a long, b long")
    links = cut(links.unionByName(second).distinct())
    label = components(links)

    of_class = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    out = each.join(of_class, ["n", "f1", "f2"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    component = F.when(F.col("n") > 0, component).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id"))).alias("class_id"),
    )
