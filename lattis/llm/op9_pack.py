"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

A bin holds no two documents of one duplicate cluster, and at most `per_source` documents of one source. Bins are kept
in order of their open room; each bin carries a bitmap of its duplicate clusters and one of its sources' slots. A
piece, longest first, goes to the tightest bin with room for it (a successor search) and, while that bin conflicts,
the search goes on to the next one, so the tightest compatible bin is always found; else a bin is opened. Texts longer
than a bin are cut into full bins and a rest. Rows are dealt by a seeded hash to shards of about `shard_rows` pieces
that are packed on their own: all a task holds is one shard, a hot source or cluster is spread over all shards, and
only ids, sources and lengths are shuffled.

Defined results: a null text has no words and takes one token (its end); null sources are one source; doc_id is an integer, carried
as it is, or null; repeated rows are packed one by one (they conflict, being copies), and are dealt to shards by their place
in the input, so that no number of them meets in one task; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.llm.op8_mix import word_count
from lattis.llm.work import stash

PACKED = "doc_id long, source string, piece long, start long, length long, shard long, bin long, at long, bin_used long, bin_items long"


def best_fit(lengths: list[int], clusters: list, sources: list, capacity: int, per_source: int) -> list[int]:
    """The bin of each piece; pieces are placed in the order given. No length is above capacity."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1)}  # others can't conflict
    slot = {s: i * per_source for i, s in enumerate(dict.fromkeys(sources))}
    full = (1 << per_source) - 1
    at_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    has_cluster, has_source, out = [], [], []
    last, cursor = None, (0, 0)
    for n, c, s in zip(lengths, clusters, sources, strict=True):
        bit = 1 << cluster_bit[c] if c in cluster_bit else 0
        shift = slot[s]
        # Bins passed over by an equal piece still conflict with this one: go on from there.
        r, i = cursor if last == (n, c, s) else (n, 0)
        found = -1
        while True:
            above = rooms >> r
            if not above:
                break
            skip = (above & -above).bit_length() - 1
            if skip:
                r, i = r + skip, 0
            row = at_room[r]
            while i < len(row):
                b = row[i]
                if not has_cluster[b] & bit and (has_source[b] >> shift) & full != full:
                    found = b
                    break
                i += 1
            if found >= 0:
                break
            r, i = r + 1, 0
            if r > capacity:
                break
        if found >= 0:
            row = at_room[r]
            row.pop(i)
            if not row:
                rooms &= ~(1 << r)
            left = r - n
        else:
            found, left = len(has_cluster), capacity - n
            has_cluster.append(0)
            has_source.append(0)
        used = has_source[found] >> shift & full
        has_cluster[found] |= bit
        has_source[found] |= (used + 1) << shift  # the lowest free slot
        last, cursor = (n, c, s), (r, i)
        if left:
            at_room[left].append(found)
            rooms |= 1 << left
        out.append(found)
    return out


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 4, shard_rows: int = 20_000, seed: int = 11, size: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """A row for each piece: its place in its document (start, length), its bin (shard, bin) and its place there (at).

    size: tokens of a document, its words and one end unless given. cluster: duplicate cluster, equal texts unless given.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (word_count(F.col("text")) + 1 if size is None else size).cast("long").alias("n"),
        (F.xxhash64(text, F.octet_length(text)) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
    )
    cap = F.lit(capacity).cast("long")
    pieces = sized.filter("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))).alias("piece")).select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * cap).alias("start"), F.least(cap, F.col("n") - F.col("piece") * cap).alias("length"))
    pieces = stash(pieces.withColumn("row", F.monotonically_increasing_id()), "pack")
    shards = max(1, -(-pieces.count() // shard_rows))

    def pack_shard(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("cluster", "ascending"), ("source", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=order))
        lengths = table.column("length").to_numpy()
        bins = np.array(best_fit(lengths.tolist(), table.column("cluster").to_pylist(), table.column("source").to_pylist(), capacity, per_source), np.int64)
        by = np.argsort(bins, kind="stable")  # pieces of a bin next to each other, in the order in which they were placed
        upto = np.cumsum(lengths[by]) - lengths[by]
        first = np.searchsorted(bins[by], bins[by])
        at = np.empty(len(bins), np.int64)
        at[by] = upto - upto[first]
        made = {"bin": bins, "at": at, "bin_used": np.bincount(bins, lengths)[bins].astype(np.int64), "bin_items": np.bincount(bins)[bins]}
        return pa.table({c: made[c] if c in made else table.column(c) for c in (c.split()[0] for c in PACKED.split(", "))})

    shard = F.pmod(F.xxhash64("doc_id", "piece", "cluster", "row", F.lit(seed)), F.lit(shards)).cast("long")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(pack_shard, PACKED)
