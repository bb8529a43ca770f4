"""Time-varying curriculum: sources mixed to target weights and laid out over training time.

Each source has a weight over training time t in [0, 1], linear between knots. Its integral sets the
source's share of the words; a share beyond `most` passes of the source is cut there and the excess
goes to the others by weight, until none is above. Documents of a source queue in a fixed random
order; the cumulative words that the queue has delivered, put through the inverse of the source's
cumulative demand, give each document its position in training, and the rows are range-sorted by it.

Cumulative words need no pass in one task: a source's rows lie on a line by hash, which is cut into blocks; block sums
give each block its offset, and a window runs inside a block only. Rows that are equal are one row with a number until the end. Sources are
as many as there are: they are numbered and reshared by range sorts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edittide.llm.common import cut, in_order

#: Different documents of a block, and copies of one that a task deals at once; length of the line that hashes lie on.
BLOCK, LINE = 10_000, 1 << 60

Schedule = Sequence[tuple[float, float]]


def area(s: Schedule) -> float:
    """Integral of a schedule of (t, weight) knots over [0, 1]."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(s, s[1:]))


def checked(s: Schedule) -> Schedule:
    ts = [t for t, _ in s]
    if len(s) < 2 or ts[0] != 0 or ts[-1] != 1 or any(b <= a for a, b in zip(ts, ts[1:])) or any(w < 0 for _, w in s) or area(s) <= 0:
        raise ValueError("a schedule goes from t = 0 to t = 1 in rising steps, with weights of 0 or more and some above")
    return s


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """`sources` (source, source_size, weight) with target: parts of `share` times all sizes by weight, none above `most` times its size; what
    is cut off is shared again.

    Sources that reach their limit are the first by size over weight. What each unit of weight gets is at its highest when just these
    are out, so one running sum in that order finds it.
    """
    limit = F.col("source_size") * F.lit(float(most))
    known = sources.withColumn("limit", limit)
    ordered = in_order(known, [(F.col("limit") / F.col("weight")).asc(), F.asc_nulls_first("source")], {"out": "limit", "gone": "weight"})
    whole = known.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    left = (F.lit(float(share)) * F.col("words") - F.col("out")) / F.greatest(F.col("weights") - F.col("gone"), F.col("weight"))
    each = ordered.crossJoin(F.broadcast(whole)).agg(F.max(left).alias("unit"))  # both have one row
    return known.crossJoin(F.broadcast(each)).withColumn("target", F.least("limit", F.col("unit") * F.col("weight"))).drop("limit", "unit")


def mixed(docs: DataFrame, schedules: Sequence[Schedule], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, taken, position, sorted by position.

    size: runs of other than ASCII white space in the text (null: 0). Sources in code point order, null last, take
    the schedules in turn. target: words that the mix takes from the row's source; taken: from the row, at most
    ceil(most * size); position: when in [0, 1] its first word is due, null for rows that give none. Rows
    that repeat are rows of their own; without documents there are no rows.
    """
    schedules = [checked(s) for s in schedules]
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = cut(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")))
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("c"))
    plan = F.element_at(F.array(*[F.lit(area(s)) for s in schedules]), (F.col("plan") + 1).cast("int"))
    numbered = in_order(per, [F.col("source").isNull().asc(), F.asc("source")], {"n": F.lit(1)}).withColumn("plan", F.col("n") % len(schedules))
    sources = cut(targets(numbered.withColumn("weight", plan), share, most))
    sources = sources.select("source", "source_size", "target", "plan", F.col("weight").alias("z"), F.ceil(F.lit(LINE) / F.ceil(F.col("c") / BLOCK)).cast("long").alias("width"))

    h = F.conv(F.substring(F.md5(F.concat_ws("|", "doc_id", "size")), 1, 15), 16, 10).cast("long")
    dealt = rows.withColumn("h", h).join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source).withColumn("block", F.expr("h div width"))
    words = F.col("size") * F.col("copies")
    sums = dealt.groupBy("source", "block").agg(F.sum(words).alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    left, right = dealt.alias("l"), before.alias("r")
    placed = left.join(right, F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.block") == F.col("r.block"))).select("l.*", "r.before")
    w = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum(words).over(w), F.lit(0)))
    zero = F.lit(0).cast("long")
    each = lambda df, first, n: df.withColumn("copy", F.explode(F.sequence(first, first + n - 1)))
    few = each(placed.filter(F.col("copies") <= BLOCK), zero, F.col("copies"))
    # many copies of one document are dealt in parts
    parts = placed.filter(F.col("copies") > BLOCK).withColumn("at", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(BLOCK).cast("long")))).repartition("source", "doc_id", "size", "at")
    many = each(parts, F.col("at"), F.least(F.lit(BLOCK).cast("long"), F.col("copies") - F.col("at"))).drop("at")
    copies = few.unionByName(many).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))

    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    run = copies.withColumns({"a": F.floor(F.col("start") * rate), "b": F.floor((F.col("start") + F.col("size")) * rate)})
    taken = F.coalesce(F.col("b") - F.col("a"), F.lit(0)).cast("long")
    # The last knot reached, and from there the root of a quadratic: demand is linear in weight.
    knots = F.element_at(F.array(*[_knots(s) for s in schedules]), (F.col("plan") + 1).cast("int"))
    q = F.col("a") / F.nullif(F.col("target"), F.lit(0.0))
    k = F.element_at(knots, F.greatest(F.lit(1), F.size(F.filter(knots, lambda x: x["f"] <= q))))
    c = (q - k["f"]) * F.col("z")
    root = F.sqrt(F.greatest(k["w"] * k["w"] + F.lit(2.0) * k["m"] * c, F.lit(0.0)))
    position = k["t"] + F.coalesce(F.lit(2.0) * c / F.nullif(k["w"] + root, F.lit(0.0)), F.lit(0.0))
    out = run.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), position.alias("position"))
    return out.withColumn("position", F.when(F.col("taken") > 0, F.col("position"))).orderBy(F.asc_nulls_last("position"), "doc_id", "size")


def _knots(s: Schedule) -> Column:
    """Array of a schedule's knots but the last: t, weight w and its slope m from there, share f of the demand before."""
    z, reached, out = area(s), 0.0, []
    for (t0, w0), (t1, w1) in zip(s, s[1:]):
        cells = {"t": t0, "w": w0, "m": (w1 - w0) / (t1 - t0), "f": reached}
        out.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in cells.items()]))
        reached += (t1 - t0) * (w0 + w1) / 2 / z
    return F.array(*out)


def constant(weight: float) -> Schedule:
    return ((0.0, weight), (1.0, weight))


def ramp(start: float, end: float) -> Schedule:
    return ((0.0, start), (1.0, end))
