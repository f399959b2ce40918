"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target (a share of all words by weight, at most `most` times its own words). A source is taken
whole as often as it fits; the rest of its target is filled from a histogram of exact document lengths: a
proportional part of every length first, then single documents in seeded order of lengths until less than `window`
words are open, then a bounded-knapsack dynamic programme over the lengths left, which finds the subset that comes
nearest. Where this leaves over 0.1% of the target open, whatever its size, a programme over all documents of the source
and any number of copies up to `most` plans it anew; it is exact for targets of up to about 2**20 words, and on a grid
of that many cells of sums (each sum itself exact) for larger ones. The nearer plan is taken.
The plan says how many documents of each length are taken once more; a seeded choice then picks them. Only ids,
sources and lengths are shuffled, and lengths are counted before the shuffle, so a hot source is one row for each
length. Groups of equal source and length are cut into buckets of about `bucket` rows by a seeded hash: whole buckets
are taken, and only the bucket at the edge is ranked.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last in order; doc_id
may be null or repeated (rows are taken one by one, and which of two rows without an id is taken hangs on their place in
the input); extra columns are ignored by mix() and kept by take(); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattis.llm.work import stash

WEIGHTS = (5.0, 2.0, 1.0)
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 if it is null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Targets that add up to the sum of sizes: by weight, each at most `most` times its size, the excess shared
    again by weight among the others until none is above."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest, share = total - sum(out[i] for i in range(len(sizes)) if i not in open_), sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / share > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / share
            break
        for i in over:
            out[i] = most * sizes[i]
            open_.discard(i)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to budget as the dynamic programme
    can tell; from below if both sides are as near."""
    take = np.zeros(len(lengths), np.int64)
    words = int((lengths * counts).sum())
    if budget <= 0 or not words:
        return take
    if budget >= words:
        return counts.copy()
    if words > window:  # else the dynamic programme has them all, and what it finds is the best there is
        take = np.floor(counts * (budget / words)).astype(np.int64)
    left, rest = counts - take, budget - int((lengths * take).sum())
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        if rest <= window:
            break
        more = min(int(left[i]), max(0, (rest - window)) // int(lengths[i]) + 1, rest // int(lengths[i]), 1)
        take[i], left[i], rest = take[i] + more, left[i] - more, rest - more * int(lengths[i])
    for i in np.argsort(-lengths):  # only where few lengths hold nearly all words
        if rest <= window:
            break
        more = min(int(left[i]), rest // int(lengths[i]))
        take[i], left[i], rest = take[i] + more, left[i] - more, rest - more * int(lengths[i])
    # bounded knapsack: bit s of reach is set if a sum s can be made; by[s] is the item that first made it. Sums over
    # the rest count too, as the nearest one may lie there.
    limit, reach, items = rest + min(int(lengths.max()), window), 1, []
    by = np.full(limit + 1, -1, np.int64)
    full = (1 << (limit + 1)) - 1
    for i in np.argsort(-lengths):
        n, k = min(int(left[i]), limit // int(lengths[i])), 1
        while n and not reach >> rest & 1:
            k = min(k, n)
            new = (reach << (k * int(lengths[i]))) & full & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits[: limit + 1])] = len(items)
                reach |= new
            items.append((int(i), k))
            n, k = n - k, 2 * k
        if reach >> rest & 1:
            break
    at, above = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1, reach >> (rest + 1)
    if above and (over := rest + (above & -above).bit_length()) - rest < rest - at:
        at = over
    while at:
        i, k = items[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def nearest(lengths: np.ndarray, counts: np.ndarray, budget: int, slack: int, cells: int = 1 << 20) -> np.ndarray:
    """As fit(), planned from nothing, for sums of up to budget + slack. Each of at most cells ranges of sums keeps the
    first sum that falls in it, so every sum has its own cell, and the plan is the best there is, where they are enough."""
    limit, items = budget + slack, []
    for i in np.argsort(-lengths):
        n, k = min(int(counts[i]), limit // int(lengths[i])), 1
        while n:
            k = min(k, n)
            items.append((int(i), k))
            n, k = n - k, 2 * k
    cells = max(1 << 16, min(cells, (1 << 28) // max(1, len(items))))
    width = -(-(limit + 1) // cells)
    sums = np.full(limit // width + 1, -1, np.int64)
    by, back = np.zeros(len(sums), np.int32), np.zeros(len(sums), np.int32)
    sums[0], live = 0, np.zeros(1, np.int64)
    best = (2 * budget, -1, 0)  # twice the distance (and one more from above), last item, cell before it
    for j, (i, k) in enumerate(items):
        new = sums[live] + k * int(lengths[i])
        own = new <= limit
        new, old = new[own], live[own]
        if not len(new):
            continue
        off = 2 * np.abs(new - budget) + (new > budget)
        if off.min() < best[0]:
            best = (int(off.min()), j, int(old[off.argmin()]))
            if not best[0]:
                break
        open_ = sums[new // width] < 0
        cell, first = np.unique(new[open_] // width, return_index=True)
        sums[cell], by[cell], back[cell] = new[open_][first], j, old[open_][first]
        live = np.concatenate([live, cell])
    take, (_, j, at) = np.zeros(len(lengths), np.int64), best
    while j >= 0:
        i, k = items[j]
        take[i] += k
        j, at = (int(by[at]), int(back[at])) if sums[at] else (-1, 0)
    return take


def by_rank(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sizes (source, source_size: a row a source) with each source's weight: the weights repeat along the sources in the order of
    their code points, null last. Sources are ranked by a sort over ranges; what comes to the driver is a count of each range."""
    text = F.col("source").cast("string")
    ranged = stash(sizes.sort(text.isNull(), text).withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for r in sorted(ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["p"], before))
        before += r["n"]
    table = sizes.sparkSession.createDataFrame(starts, "_p long, _before long")  # a row a range
    place = F.pmod(F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    return ranged.join(F.broadcast(table), part == F.col("_p")).select("source", "source_size", weight.alias("weight"))


def with_targets(weighted: DataFrame, most: float) -> DataFrame:
    """weighted (source, source_size, weight) with each source's target, as targets() has it: each round is one sum over all
    sources of those that are above their most and of the others' weights, until no more are above."""
    size, w = F.col("source_size").cast("double"), F.col("weight")
    total = float(weighted.agg(F.sum("source_size")).first()[0] or 0)
    rest, share, above = total, None, -1
    while True:
        over = F.lit(False) if share is None else F.lit(rest) * w / F.lit(share) > F.lit(most) * size
        got = weighted.agg(F.sum(F.when(over, F.lit(most) * size)).alias("fixed"), F.sum(F.when(~over, w)).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if got["n"] == above or not got["open"]:
            return weighted.withColumn("target", F.when(over, F.lit(most) * size).otherwise(F.lit(rest) * w / F.lit(share or 1.0)))
        rest, share, above = total - float(got["fixed"] or 0), float(got["open"]), got["n"]


def _plan(sized: DataFrame, weights: tuple[float, ...], most: float, seed: int, bucket: int) -> DataFrame:
    """sized (row, doc_id, source, size; written) with source_size, target and copies."""
    goals = stash(with_targets(by_rank(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), most).select(F.col("source").alias("_g"), "source_size", "target"), "mix-targets")

    def per_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        rest = round(target - (target // source_size) * source_size) if source_size else 0
        sizes, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        took, whole = fit(sizes, n, rest, seed), np.full(len(n), int(target // source_size))
        gap = int(abs(rest - (took * sizes).sum()))
        if gap > 0.001 * target:
            # few documents, or long ones: any number of copies of each, up to the most
            copies = nearest(sizes, n * int(most), round(target), gap)
            if abs(round(target) - (copies * sizes).sum()) < gap:
                whole, took = copies // n, copies % n
        return pdf.assign(whole=whole, more=took)[["source", "size", "n", "whole", "more"]]

    lengths = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).join(goals, F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    more = stash(lengths.groupBy("source").applyInPandas(per_source, "source string, size long, n long, whole long, more long"), "mix-plan").withColumnRenamed("source", "_s").withColumnRenamed("size", "_n")
    # the size of a bucket hangs on its group, so all rows of a group agree on it; a hot group has many buckets. Rows
    # without an id are told apart by their place in the input
    dealt = sized.join(more, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")), "left").withColumns({
        "n": F.coalesce("n", F.lit(0)), "whole": F.coalesce("whole", F.lit(0)), "more": F.coalesce("more", F.lit(0)),
    }).drop("_s", "_n").withColumn("_h", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")), F.lit(seed))).withColumn("_b", F.pmod(F.col("_h"), F.ceil(F.greatest("n", F.lit(1)) / bucket)))
    edge = Window.partitionBy("source", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = dealt.filter("more > 0 AND more < n").groupBy("source", "size", "_b").agg(F.count(F.lit(1)).alias("_in"), F.first("more").alias("_more")).withColumn("_before", F.coalesce(F.sum("_in").over(edge), F.lit(0)))
    # buckets fully before the edge go whole; none after it; the one at the edge is ranked
    cut = buckets.filter("_before < _more").select(F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("_b").alias("_eb"), "_before", "_in")
    joined = dealt.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")) & (F.col("_b") == F.col("_eb")), "left")
    at_edge = F.col("_before").isNotNull() & (F.col("_before") + F.col("_in") > F.col("more"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_b", F.when(at_edge, F.lit(0)).otherwise(F.col("row"))).orderBy("_h", "doc_id", "row"))
    ranked = joined.withColumn("_r", rank)
    picked = F.when(F.col("more") >= F.col("n"), F.col("n") > 0).when(F.col("_before").isNull(), False).when(at_edge, F.col("_before") + F.col("_r") <= F.col("more")).otherwise(True)
    out = ranked.withColumn("_x", picked.cast("long")).select("row", "doc_id", "source", "size", "whole", "_x")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("_x")).otherwise(0).cast("long")
    return out.join(goals, F.col("source").eqNullSafe(F.col("_g"))).withColumn("copies", copies).drop("_g", "whole", "_x")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7, bucket: int = 512, size: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the document is taken) and taken (words), a row for
    each row of docs."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"))
    planned = _plan(stash(own, "mix"), weights, most, seed, bucket)
    return planned.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7, bucket: int = 512) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it does, with all columns."""
    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "mix-rows")
    sized = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), "size")
    taken = _plan(sized, weights, most, seed, bucket).filter("copies > 0").select(F.col("row").alias("_row"), "copies")
    return rows.join(taken, F.col("row") == F.col("_row")).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
