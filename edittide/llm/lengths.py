"""Exact histogram of encoded lengths.

Documents are counted by their number of tokens; suffix sums over the lengths then answer, for every
context limit, how many documents are longer, how many tokens there are and how many are left after cutting at the limit.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edittide.llm.common import cut

#: Parameter defaults: the ranks of a byte-level BPE, and its split pattern (a fixed value of that vocabulary).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths of a block of the suffix sums; white space in a row that the pattern is still let loose on.
BLOCK, RUN = 1024, 4096


def encoding(ranks: str | bytes = RANKS):
    """The encoding of a file of ranks, or of its bytes."""
    import tiktoken

    if isinstance(ranks, str):
        with open(ranks, "rb") as f:
            ranks = f.read()
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def counter(own) -> Callable[[str], int]:
    """Number of tokens of a text in the encoding `own`.

    The pattern's engine recurses along white space, so a run of more than RUN is cut out of the text first. The pattern takes such a
    run as one piece, all of it at the end of the text, else all but its last character, which begins what follows; so the counts are
    the same.
    """
    import regex

    long = regex.compile(r"\p{White_Space}{%d,}+" % (RUN + 1))

    def count(text: str) -> int:
        n = at = 0
        for m in long.finditer(text) if len(text) > RUN else ():
            end = m.end() if m.end() == len(text) else m.end() - 1
            n += len(own.encode_ordinary(text[at : m.start()])) + len(own._encode_single_piece(text[m.start() : end]))
            at = end
        return n + len(own.encode_ordinary(text[at:]))

    return count


def _counted(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(encoding(ranks.value)), Counter()
        for b in batches:
            for text in b.column(0):
                seen[count(text.as_py() or "")] += 1
            if len(seen) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "c"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "c"])

    return run


def histogram(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(n_tokens, n_docs) over all rows of `docs` (text); a null or empty text has 0 tokens.

    The file of ranks is read by the driver and sent to the workers; a vocabulary is a few MB.
    """
    with open(ranks, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(sent), "n_tokens long, c long").groupBy("n_tokens").agg(F.sum("c").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: n_tokens, n_docs, docs_above, tokens_above (of longer documents), tokens_cut (all tokens if each document is cut at
    n_tokens) and share_within (documents of at most n_tokens).

    Sums run over blocks of lengths first and inside a block then, so no task sees all lengths. The histogram is written first, since it is
    read twice and texts should be encoded once.
    """
    rows = cut(hist).withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "t": F.col("n_tokens") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("t").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_over") for c in ("d", "t")], F.sum("d").over(whole).alias("docs"), F.sum("t").over(whole).alias("tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").withColumns({"docs_above": F.col("d_over") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "tokens_above": F.col("t_over") + F.coalesce(F.sum("t").over(inside), F.lit(0))})
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_above",
        "tokens_above",
        (F.col("tokens") - F.col("tokens_above") + F.col("docs_above") * F.col("n_tokens")).alias("tokens_cut"),
        ((F.col("docs") - F.col("docs_above")) / F.col("docs")).alias("share_within"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length within which a share q of the documents lies."""
    return sums.filter(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))
