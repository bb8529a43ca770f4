"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words form one automaton. A document's words run through it, and the state always stands
for the longest run of words that ends here and occurs in an item. Where that run is a window long,
the window's words are hit, and the state's set of items is noted.

Only stretches of a document whose neighbouring words all occur side by side in some item can hold a
window of two words or more; numpy finds these stretches, and the automaton reads nothing else.

The automaton is built on the driver and sent to the workers, so its size is bounded: items beyond
SHARD_WORDS words go to further automata, each with a pass of its own over the documents. An item that is longer than that
is cut into parts that overlap by a window less a word, so each of its windows lies in one part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edittide.llm import words as W
from edittide.llm.common import cut, free

#: Words of the items of one automaton (some 150 MB on the driver, and in each Python worker).
SHARD_WORDS = 200_000


class Automaton:
    """Generalised suffix automaton over word numbers; windows of `size` words, or a whole shorter item."""

    def __init__(self, items: Iterable[tuple[int | None, np.ndarray]], size: int):
        items = [(i, h) for i, h in items if len(h)]
        self.size = size
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        coded = [(i, np.searchsorted(self.vocabulary, h).tolist()) for i, h in items]
        self.shortest = min((min(size, len(w)) for _, w in coded), default=0)
        pairs = [np.array(w[:-1], np.int64) * len(self.vocabulary) + np.array(w[1:], np.int64) for _, w in coded if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        for _, w in coded:
            last = 0
            for x in w:
                last = self._extend(last, x)
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, int | None]]] = {}
        for i, w in coded:
            if len(w) < size:
                state = 0
                for x in w:
                    state = self.next[state][x]
                self.short.setdefault(state, []).append((len(w), i))
                continue
            for state, n in self._walk(w):
                if n >= size:
                    self.items.setdefault(self._window(state), set()).add(i)
        self.marked = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.long.__getitem__):
            self.marked[s] = s if s in self.short else self.marked[self.link[s]]

    def _extend(self, last: int, x: int) -> int:
        nxt, link, long = self.next, self.link, self.long
        if x in nxt[last]:
            q = nxt[last][x]
            return q if long[q] == long[last] + 1 else self._split(last, q, x)
        new = len(link)
        nxt.append({})
        long.append(long[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            link[new] = q if long[q] == long[p] + 1 else self._split(p, q, x)
        return new

    def _split(self, p: int, q: int, x: int) -> int:
        nxt, link, long = self.next, self.link, self.long
        twin = len(link)
        nxt.append(dict(nxt[q]))
        long.append(long[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = twin
            p = link[p]
        return twin

    def _walk(self, w: Iterable[int]) -> Iterator[tuple[int, int]]:
        nxt, link, long = self.next, self.link, self.long
        state = n = 0
        for x in w:
            while state and x not in nxt[state]:
                state = link[state]
                n = long[state]
            to = nxt[state].get(x)
            if to is not None:
                state, n = to, n + 1
            yield state, n

    def _window(self, state: int) -> int:
        while self.long[self.link[state]] >= self.size:
            state = self.link[state]
        return state

    def match(self, h: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit ranges of words [start, end), joined where they touch, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not len(h) or not len(self.vocabulary):
            return spans, found
        code = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[code] == h
        if self.shortest > 1:
            if not len(self.pairs):
                return spans, found
            pair = code[:-1] * len(self.vocabulary) + code[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            good, least = known[:-1] & known[1:] & (self.pairs[at] == pair), self.shortest - 1
        else:
            good, least = known, 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2)[np.diff(edge)[::2] >= least].tolist():
            end = b + (self.shortest > 1)
            for i, (state, n) in enumerate(self._walk(code[a:end].tolist()), a + 1):
                start = i
                if n >= self.size:
                    start = i - self.size
                    found |= self.items[self._window(state)]
                s = self.marked[state]
                while s > 0:
                    for m, item in self.short.get(s, ()):
                        if m <= n:
                            start = min(start, i - m)
                            found.add(item)
                    s = self.marked[self.link[s]]
                if start < i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.int64()))])
_LONG = T.LongType()
#: What is found in a text: its words, hit ranges as words [s, e) and bytes [b0, b1), ids of the items, sorted.
FOUND = T.StructType([T.StructField("n_words", _LONG), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, _LONG) for n in ("s", "e", "b0", "b1")]))), T.StructField("items", T.ArrayType(_LONG))])


def _matched(automaton, text: int, at: str):
    inside = W.table("alnum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for b in batches:
            raw_at = W.buffers(b.column(text))[1]
            out = []
            for first, rows, h, begin, ends in W.placed(b.column(text), inside):
                for i in range(rows):
                    s, e = int(begin[i]), int(begin[i + 1])
                    hit, found = a.match(h[s:e])
                    base = int(raw_at[first + i])
                    spans = [{"s": x, "e": y, "b0": int(ends[0, s + x]) - base, "b1": int(ends[1, s + y - 1]) - base} for x, y in hit]
                    out.append({"n_words": e - s, "spans": spans, "items": sorted(x for x in found if x is not None)})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _FOUND)], names=[*b.schema.names, at])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, all: what several automata found in a text) as (row, found)."""
    for b in batches:
        out = []
        for parts in b.column(1).to_pylist():
            spans: list[dict] = []
            for x in sorted((x for p in parts for x in p["spans"]), key=lambda x: (x["s"], x["e"])):
                if spans and spans[-1]["e"] >= x["s"]:
                    if x["e"] > spans[-1]["e"]:
                        spans[-1]["e"], spans[-1]["b1"] = x["e"], x["b1"]
                else:
                    spans.append(x)
            out.append({"n_words": parts[0]["n_words"], "spans": spans, "items": sorted({x for p in parts for x in p["items"]})})
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _FOUND)], names=["row", "found"])


def _shards(items: DataFrame, size: int, limit: int) -> Iterator[Automaton]:
    """Automata over runs of items; the rows stream to the driver one shard at a time."""
    inside, held, n = W.table("alnum"), [], 0
    for r in items.toLocalIterator():
        h = np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in W.words(pa.array([r["text"]], pa.large_string()), inside))])
        step = limit - size + 1
        for part in [h[i : i + limit] for i in range(0, len(h) - size + 1, step)] if len(h) > limit else [h]:
            if held and n + len(part) > limit:
                yield Automaton(held, size)
                held, n = [], 0
            held.append((r["item_id"], part))
            n += len(part)
    yield Automaton(held, size)


def find(docs: DataFrame, items: DataFrame, size: int = 10, shard_words: int = SHARD_WORDS, at: str = "found") -> DataFrame:
    """`docs` with a column `at` of FOUND, which no column of docs may be named.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is `size`
    consecutive words of an item, or a shorter item as a whole; a word inside any occurrence of a
    window is hit. spans: hit ranges, as words [s, e) and bytes [b0, b1) of the text. items: ids, sorted, of items
    with an occurring window; an item without id takes part but is not listed. A null or empty text has no words; without items
    nothing is hit.
    """
    if free(at, docs.columns) != at:
        raise ValueError(f"docs has a column {at}")
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    shards = _shards(items, size, max(shard_words, 2 * size))
    first, second = next(shards), next(shards, None)
    schema = T.StructType([*docs.schema.fields, T.StructField(at, FOUND)])
    if second is None:
        return docs.mapInArrow(_matched(spark.sparkContext.broadcast(first), docs.columns.index("text"), at), schema)
    row = free("row", [*docs.columns, at])
    keyed = cut(docs.withColumn(row, F.expr("uuid()")))
    texts, parts = keyed.select(F.col(row).alias("row"), "text"), []
    for a in chain([first, second], shards):
        sent = spark.sparkContext.broadcast(a)
        got = texts.mapInArrow(_matched(sent, 1, "found"), T.StructType([*texts.schema.fields, T.StructField("found", FOUND)]))
        parts.append(cut((got.filter(F.size("found.spans") > 0) if parts else got).select("row", "found")))
        sent.destroy()
    each = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.collect_list("found").alias("all"))
    united = each.mapInArrow(_united, T.StructType([T.StructField("row", T.StringType()), T.StructField("found", FOUND)]))
    return keyed.join(united.select(F.col("row").alias(row), F.col("found").alias(at)), row).drop(row)


def hit_words(at: str = "found") -> Column:
    return F.aggregate(F.col(at)["spans"], F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids sorted as text, comma-joined) and contaminated."""
    found = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, size)
    ids = F.array_join(F.array_sort(F.transform("found.items", lambda x: x.cast("string"))), ",")
    hit = F.size("found.spans") > 0
    return found.select("doc_id", "found.n_words", hit_words().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), hit.alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 10, longest: int = 0, coverage: float = 0.5) -> DataFrame:
    """`docs` without test items: hit spans of more than `longest` words are cut from the text (a line break is left
    in their place), and a document of which more than `coverage` is hit goes as a whole. A column n_chars follows the text.
    Other rows come back as they were, and so do all other columns, whatever their names."""
    at = free("found", docs.columns)
    found = find(docs, items, size, at=at).filter(F.col(at)["n_words"] * F.lit(coverage) >= hit_words(at))
    raw = F.col("text").cast("binary")
    spans = F.filter(F.col(at)["spans"], lambda x: x["e"] - x["s"] > longest)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["b1"]))
    ends = F.concat(F.transform(spans, lambda x: x["b0"]), F.array(F.octet_length("text").cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.decode(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "utf-8"))
    cleaned = F.when(F.size(spans) > 0, F.array_join(pieces, "\n")).otherwise(F.col("text"))
    text = free("text_", [*docs.columns, at])
    out = found.withColumn(text, cleaned)
    change = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.size(spans) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(change).select(*docs.columns)
