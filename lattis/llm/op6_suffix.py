"""Removal of repeated passages with suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another one.

1. Each window of LENGTH bytes has an anchor, the first of the smallest K-byte hashes in it; equal windows have equal
   anchors at equal places. Anchors are counted over all documents, and only windows whose anchor occurs at two places
   or more are looked at further. This loses no repeat.
2. What is left of a document is cut to contexts, runs of windows with one anchor hash; a context goes to the shard of
   that hash, so equal windows meet. Equal contexts are merged before and after the shuffle. In a shard, the distinct
   contexts are sorted to a suffix array by Larsson-Sadakane refinement (numpy: only groups not yet apart are sorted
   again, by the ranks twice as far on), Kasai's scan gives the common prefixes of neighbours, for all contexts side by
   side, and runs of neighbours that share LENGTH bytes are the repeats.
3. A hash that occurs more than HOT times is dealt over several shards by the contexts' content. Such shards put out
   their distinct windows in sorted order, as 128-bit hashes; these runs are merged, and each shard's windows are found
   in the others' by binary search.
4. Blocks of documents get the starts of their repeated windows back and cut them out.

Texts are handled in blocks of about BLOCK bytes that are written out once, so all replies refer to fixed blocks.
Two different windows are taken for equal only in step 3, with a chance of less than 1e-18 for 1e10 windows.

Defined results: a null text counts as empty; doc_id is carried as it is, null or repeated (repeated rows are copies of
one another: texts of LENGTH bytes or more go whole); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.work import by_group, groups_of, mix64, shuffle_partitions, slices, stash, texts

LENGTH, K = 200, 32
BLOCK, SHARD, HOT = 4_000_000, 1_500_000, 4096
SPAN = LENGTH - K + 1  # K-byte strings in a window

TEXTS = "block long, doc_ids array<long>, lengths binary, data binary"
ASKED = "bucket int, block long, keys binary, counts binary"
ANSWERED = "block long, bucket int, counts binary"
CONTEXTS = "shard long, block long, lengths binary, data binary, hashes binary, anchors binary, owners binary, starts binary, hot binary"
REPEATS = "block long, firsts binary, runs binary"


def _z(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def _uz(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def text_blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: ids, lengths, and the texts' bytes one after another."""

    def run(batches):
        from pyspark import TaskContext

        block, ids, parts, n = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array([len(p) for p in parts], np.int64).tobytes()], pa.binary()), pa.array([zstandard.compress(b"".join(parts), 3)], pa.binary())], names=["block", "doc_ids", "lengths", "data"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids.append(doc_id)
                parts.append(text)
                n += len(text)
                if n >= BLOCK:
                    yield flush()
                    block, ids, parts, n = block + 1, [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TEXTS)


_BYTES = mix64(np.arange(1, 257))


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on, by doubling: of 1, 2, 4, .. K bytes."""
    h = _BYTES[data]
    size = 1
    while size < K:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ (h[size:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        size *= 2
    return h ^ (h >> np.uint64(32))


def first_minima(h: np.ndarray, span: int) -> np.ndarray:
    """The place of the first smallest value among span values, from each place on: block-wise minima from both sides
    (van Herk) of 32 bits of the hash over the place, so that ties go to the first."""
    n = len(h)
    m = n - span + 1
    low32 = np.uint64(32)
    packed = np.full(n + -n % span, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = (h >> low32 << low32) | np.arange(n, dtype=np.uint64)
    packed = packed.reshape(-1, span)
    left = np.minimum.accumulate(packed, axis=1).ravel()
    right = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:m], left[span - 1 : span - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def window_runs(data: np.ndarray, lengths: np.ndarray, chunk: int = 1 << 20):
    """Runs of windows with one anchor: first window, number of windows, anchor's place, anchor's hash. Windows lie
    within documents; the bytes are worked through in chunks, each window in one of them."""
    n, ends = len(data), np.cumsum(lengths)
    out = []
    edge = np.zeros(n + 1, np.int8)  # +1, -1 where the windows of a document begin and end
    ok = lengths >= LENGTH
    edge[(ends - lengths)[ok]] += 1
    edge[(ends - LENGTH + 1)[ok]] -= 1
    open_ = 0
    for a in range(0, max(0, n - LENGTH + 1), chunk):
        b = min(a + chunk, n - LENGTH + 1)
        inside = open_ + np.cumsum(edge[a:b], dtype=np.int32)
        open_ = int(inside[-1])
        h = rolling(data[a : b + LENGTH - 1])
        place = first_minima(h, SPAN)
        starts = np.flatnonzero(inside > 0)
        if not len(starts):
            continue
        at = place[starts]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)]))
        out.append((starts[new] + a, np.diff(np.append(new, len(starts))), at[new] + a, h[at[new]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_bucket(keys: np.ndarray, buckets: int):
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(buckets + 1))


def _block(row: dict):
    data, lengths = _uz(row["data"], np.uint8), np.frombuffer(row["lengths"], np.int64)
    return data, lengths, *window_runs(data, lengths)


def _anchor_keys(place: np.ndarray, keys: np.ndarray):
    """Distinct anchor hashes of a block, and at how many places each stands."""
    _, first = np.unique(place, return_index=True)
    return np.unique(keys[first], return_counts=True)


def ask(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, _, place, hashes = _block(row)
                keys, counts = _anchor_keys(place, hashes)
                order, cuts = _by_bucket(keys, buckets)
                for b in range(buckets):
                    own = order[cuts[b] : cuts[b + 1]]
                    if len(own):
                        yield pa.RecordBatch.from_pydict({"bucket": [b], "block": [row["block"]], "keys": [keys[own].tobytes()], "counts": [_z(counts[own].astype(np.int64).tobytes())]}, schema=schema)

    return blocks.select("block", "lengths", "data").mapInArrow(run, ASKED)


def answer(asked: DataFrame, buckets: int) -> DataFrame:
    """How many places of all blocks have each anchor hash."""

    def run(batches):
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())])
        for bucket, table in groups_of(batches, "bucket"):
            keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
            counts = np.concatenate([_uz(k, np.int64) for k in table.column("counts").to_pylist()])
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(place, counts, len(distinct)).astype(np.int64)[place]
            at = 0
            for block, k in zip(table.column("block").to_pylist(), keys, strict=True):
                yield pa.RecordBatch.from_pydict({"block": [block], "bucket": [bucket], "counts": [_z(sums[at : at + len(k)].tobytes())]}, schema=schema)
                at += len(k)

    return by_group(asked, "bucket", "block", parts=buckets).mapInArrow(run, ANSWERED)


def contexts(blocks: DataFrame, answered: DataFrame, buckets: int, shards: int, longest: int = 512) -> DataFrame:
    """The contexts of each block, each distinct one once with the places it stands at, dealt to shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        data, lengths, first, size, place, hashes = _block(row)
        keys, _ = _anchor_keys(place, hashes)
        order, cuts = _by_bucket(keys, buckets)
        totals = np.zeros(len(keys), np.int64)
        for b, counts in zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True):
            totals[order[cuts[b] : cuts[b + 1]]] = _uz(counts, np.int64)
        total = totals[np.searchsorted(keys, hashes)] if len(keys) else np.zeros(0, np.int64)
        on = np.flatnonzero(total > 1)  # a window whose anchor hash stands at one place only has no equal
        of = np.repeat(on.astype(np.int32), size[on])
        window = np.arange(len(of), dtype=np.int32) + np.repeat((first[on] - (np.cumsum(size[on]) - size[on])).astype(np.int32), size[on])
        if not len(of):
            return pa.table({f.name: pa.array([], f.type) for f in CONTEXT_SCHEMA}, schema=CONTEXT_SCHEMA)
        cut = np.concatenate([[True], (np.diff(window) != 1) | (hashes[of[1:]] != hashes[of[:-1]])])
        begin = np.flatnonzero(cut)
        stop = np.append(begin[1:], len(cut))
        long = np.flatnonzero(stop - begin > longest)
        if len(long):  # runs over the limit are cut on
            more = np.concatenate([np.arange(begin[k] + longest, stop[k], longest) for k in long.tolist()])
            begin = np.sort(np.concatenate([begin, more]))
            stop = np.append(begin[1:], len(cut))
        found: dict[tuple, int] = {}
        unique, owners, starts = [], [], []
        raw = data.tobytes()
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            at = int(window[a])
            piece = raw[at : at + (b - a) + LENGTH - 1]
            k = (int(hashes[of[a]]), piece)
            i = found.get(k)
            if i is None:
                i = found[k] = len(unique)
                unique.append((k[0], piece, place[of[a]] != place[of[b - 1]], int(total[of[a]])))
            owners.append(i)
            starts.append(at)
        fp, many = np.array([u[0] for u in unique], np.uint64), np.array([u[2] for u in unique])
        hot = np.array([u[3] > HOT for u in unique])
        salt = np.array([xxhash.xxh3_64_intdigest(u[1]) % -(-u[3] // HOT) if u[3] > HOT else 0 for u in unique], np.uint64)
        shard = (mix64(fp ^ mix64(salt)) % np.uint64(shards)).astype(np.int64)
        owners, starts = np.array(owners), np.array(starts, np.int32)
        out = {f.name: [] for f in CONTEXT_SCHEMA}
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order])) + 1
        local = np.empty(len(unique), np.int64)
        shard_of_owner = shard[owners]
        by = np.argsort(shard_of_owner, kind="stable")
        for own in np.split(order, edges):
            s = int(shard[own[0]])
            local[own] = np.arange(len(own))
            a, b = np.searchsorted(shard_of_owner[by], [s, s + 1])
            mine = by[a:b]
            pieces = [unique[i][1] for i in own.tolist()]
            for name, value in zip(out, (s, row["block"], np.array([len(p) for p in pieces], np.int32).tobytes(), _z(b"".join(pieces)), fp[own].tobytes(), many[own].tobytes(), local[owners[mine]].astype(np.int32).tobytes(), starts[mine].tobytes(), hot[own].tobytes()), strict=True):
                out[name].append(value)
        return pa.table(out, schema=CONTEXT_SCHEMA)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, CONTEXTS)


CONTEXT_SCHEMA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("lengths", "data", "hashes", "anchors", "owners", "starts", "hot"))])


def suffix_array(data: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The suffix array of several strings, a string's end coming before all bytes and equal suffixes by place
    (Larsson-Sadakane refinement: ranks by h bytes become ranks by 2 h, and only groups that are not apart yet are
    sorted). rest: bytes from each place to its string's end."""
    n = len(data)
    key = np.minimum(rest, 7).astype(np.uint64)
    for k in range(7):
        part = np.zeros(n, np.uint64)
        part[: n - k] = data[k:]
        part[rest <= k] = 0
        key |= part << np.uint64(8 * (7 - k))
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del key, ordered, part
    sa = sa.astype(np.int32)
    group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n, np.int32)
    rank[sa] = group
    h = 7
    while True:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone).astype(np.int32)
        if not len(at):
            break
        sub = sa[at]
        done = rest[sub] <= h  # whole suffixes of a group are equal then: by place, for Kasai's bound to hold
        second = np.where(done, sub - n, rank[np.minimum(sub + h, n - 1)])
        key = (group[at].astype(np.int64) << 32) + second
        order = np.argsort(key)
        key = key[order]
        sa[at] = sub[order]
        changed = np.concatenate([[True], key[1:] != key[:-1]])
        new[at] |= changed
        group[at] = np.maximum.accumulate(np.where(changed, at, 0))
        rank[sa[at]] = group[at]
        h *= 2
    return sa


def kasai(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, sa: np.ndarray, rest: np.ndarray, cap: int) -> np.ndarray:
    """For each place, the bytes (up to cap) that its suffix has in common with the one before it in the suffix array.
    Kasai's bound (one less than at the place before) carries along each string; all strings go side by side."""
    n = len(data)
    prev = np.empty(n, np.int32)
    prev[sa[1:]] = sa[:-1]
    prev[sa[0]] = -1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded.view(), (n + 1, 8), (1, 1))
    lcp = np.zeros(n, np.int16)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    have = np.zeros(len(begins), np.int64)
    for o in range(int(lengths[0])):
        k = int(np.searchsorted(-lengths, -o, "left"))  # strings longer than o
        at = begins[:k] + o
        l = np.maximum(have[:k] - 1, 0)  # noqa: E741
        p = prev[at]
        most = np.where(p >= 0, np.minimum(np.minimum(rest[at], rest[np.maximum(p, 0)]), cap), 0)
        l = np.minimum(l, most)  # noqa: E741
        go = np.flatnonzero(l < most)
        while len(go):
            x, y = word[at[go] + l[go]], word[p[go] + l[go]]
            differ = x != y
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            l[go] = np.minimum(l[go] + same, most[go])
            go = go[(same == 8) & (l[go] < most[go])]
        have[:k] = l
        lcp[at] = l
    return lcp


def repeated_windows(pieces: list[bytes], depth: int = LENGTH):
    """Classes of equal windows of some strings: for each window (string by string) the class, and the classes' sizes."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    rest = (np.repeat(ends, lengths) - np.arange(len(data))).astype(np.int32)
    sa = suffix_array(data, rest)
    lcp = kasai(data, begins, lengths, sa, rest, depth)
    klass = np.empty(len(data), np.int32)
    klass[sa] = np.cumsum(lcp[sa] < depth, dtype=np.int32)
    windows = rest >= depth
    klass = klass[windows]
    used = np.zeros(len(data) + 1, bool)
    used[klass] = True
    klass = (np.cumsum(used) - 1)[klass]
    return klass, np.bincount(klass), windows


def _runs(flags: np.ndarray):
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a = np.flatnonzero(edge == 1)
    return a, np.flatnonzero(edge == -1) - a


def find_repeats(ctx: DataFrame, buckets: int, parts: int) -> DataFrame:
    """kind 0: for each block, runs of windows that repeat; kind 1: a split shard's distinct windows, for merge_edges()."""

    def batches_of(fps: np.ndarray, sizes: np.ndarray):
        """Slices of contexts sorted by hash, of about SHARD bytes, no hash in two of them."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(fps)) + 1, [len(fps)]])
        total, a = np.concatenate([[0], np.cumsum(sizes)]), 0
        for k in range(1, len(cuts)):
            if k == len(cuts) - 1 or total[cuts[k + 1]] - total[a] > SHARD:
                yield a, int(cuts[k])
                a = int(cuts[k])

    def run(batches):
        schema = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
        for _, table in groups_of(batches, "shard"):
            found: dict[tuple, int] = {}
            unique, where = [], []
            for k in range(table.num_rows):
                row = {c: table.column(c)[k].as_py() for c in table.column_names}
                raw, sizes = zstandard.decompress(row["data"]), np.frombuffer(row["lengths"], np.int32)
                ends = np.cumsum(sizes).tolist()
                fps, many, hot = np.frombuffer(row["hashes"], np.uint64).tolist(), np.frombuffer(row["anchors"], bool).tolist(), np.frombuffer(row["hot"], bool).tolist()
                local = []
                for e, size, fp, m, warm in zip(ends, sizes.tolist(), fps, many, hot, strict=True):
                    k = (fp, raw[e - size : e])
                    i = found.get(k)
                    if i is None:
                        i = found[k] = len(unique)
                        unique.append((fp, k[1], m, warm))
                    local.append(i)
                where.append((row["block"], np.array(local)[np.frombuffer(row["owners"], np.int32)], np.frombuffer(row["starts"], np.int32)))
            del found
            places = np.bincount(np.concatenate([w for _, w, _ in where]), minlength=len(unique))
            order = sorted(range(len(unique)), key=lambda i: unique[i][0])
            fps, sizes = np.array([unique[i][0] for i in order], np.uint64), np.array([len(unique[i][1]) for i in order])
            hits: list = [None] * len(unique)  # runs of repeated windows in each context
            lows, highs, single = [], [], []
            for a, b in batches_of(fps, sizes):
                own = order[a:b]
                same = np.concatenate([[True], fps[a + 1 : b] != fps[a : b - 1]])
                lone = same & np.append(same[1:], True)
                sort, plain = [], []
                for i, alone in zip(own, lone.tolist(), strict=True):
                    (plain if alone and not unique[i][2] and not unique[i][3] else sort).append(i)
                for i in plain:  # one context of this hash: it repeats if it stands at two places
                    if places[i] > 1:
                        hits[i] = (np.array([0]), np.array([len(unique[i][1]) - LENGTH + 1]))
                if not sort:
                    continue
                klass, size, _ = repeated_windows([unique[i][1] for i in sort])
                at, put = 0, np.zeros(len(size), bool)
                for i in sort:
                    n = len(unique[i][1]) - LENGTH + 1
                    c = klass[at : at + n]
                    at += n
                    again = (size[c] > 1) | (places[i] > 1)
                    hits[i] = _runs(again)
                    if unique[i][3]:
                        for o in range(n):
                            if not put[c[o]]:
                                put[c[o]] = True
                                digest = xxhash.xxh3_128_digest(unique[i][1][o : o + LENGTH])
                                lows.append(digest[:8])
                                highs.append(digest[8:])
                                single.append((-1, 0) if again[o] else (i, o))
            one = {}
            for block, owners, starts in where:
                firsts, runs = [], []
                for i, s in zip(owners.tolist(), starts.tolist(), strict=True):
                    if unique[i][3]:
                        one[i] = (block, s)
                    if hits[i] is not None and len(hits[i][0]):
                        firsts.append(hits[i][0] + s)
                        runs.append(hits[i][1])
                if firsts:
                    yield pa.RecordBatch.from_pydict({"kind": [0], "at": [block], "a": [np.concatenate(firsts).astype(np.int64).tobytes()], "b": [np.concatenate(runs).astype(np.int64).tobytes()], "c": [None], "d": [None]}, schema=schema)
            if lows:
                low, high = np.frombuffer(b"".join(lows), np.uint64), np.frombuffer(b"".join(highs), np.uint64)
                blocks = np.array([one[i][0] if i >= 0 else -1 for i, _ in single], np.int64)
                starts = np.array([one[i][1] + o if i >= 0 else 0 for i, o in single], np.int64)
                by = np.lexsort((high, low))
                bucket = (low[by] % np.uint64(buckets)).astype(np.int64)
                for k in np.unique(bucket).tolist():
                    own = by[bucket == k]
                    yield pa.RecordBatch.from_pydict({"kind": [1], "at": [k], "a": [low[own].tobytes()], "b": [high[own].tobytes()], "c": [_z(blocks[own].tobytes())], "d": [_z(starts[own].tobytes())]}, schema=schema)

    return by_group(ctx, "shard", "block", parts=parts).mapInArrow(run, "kind int, at long, a binary, b binary, c binary, d binary")


def merge_edges(edges: DataFrame) -> DataFrame:
    """Windows of split shards that another shard has too: the sorted runs are merged to the list of windows that two
    runs hold, in which each run's windows are then looked up by binary search."""

    def run(batches):
        schema = pa.schema([("block", pa.int64()), ("firsts", pa.binary()), ("runs", pa.binary())])
        for _, table in groups_of(batches, "at"):
            parts = [(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint64), _uz(r["c"], np.int64), _uz(r["d"], np.int64)) for r in table.to_pylist()]
            pair = lambda low, high: np.rec.fromarrays([low, high])
            merged = np.sort(pair(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
            twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
            found: dict[int, list] = {}
            for low, high, blocks, starts in parts:
                if not len(twice):
                    break
                own = pair(low, high)
                at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
                hit = np.flatnonzero((twice[at] == own) & (blocks >= 0))
                for k in hit.tolist():
                    found.setdefault(int(blocks[k]), []).append(int(starts[k]))
            for block, starts in found.items():
                yield pa.RecordBatch.from_pydict({"block": [block], "firsts": [np.array(starts, np.int64).tobytes()], "runs": [np.ones(len(starts), np.int64).tobytes()]}, schema=schema)

    return by_group(edges, "at").mapInArrow(run, REPEATS)


def cut(blocks: DataFrame, repeats: DataFrame) -> DataFrame:
    """Each document without its repeated bytes: the bytes kept, their sha256, what went and in how many spans."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        data, lengths = _uz(row["data"], np.uint8), np.frombuffer(row["lengths"], np.int64)
        n = len(data)
        edge = np.zeros(n + 1, np.int32)
        for firsts, runs in zip(right.column("firsts").to_pylist(), right.column("runs").to_pylist(), strict=True):
            a, k = np.frombuffer(firsts, np.int64), np.frombuffer(runs, np.int64)
            np.add.at(edge, a, 1)
            np.add.at(edge, a + k + LENGTH - 1, -1)
        gone = np.cumsum(edge[:n]) > 0
        raw, ends = data.tobytes(), np.cumsum(lengths)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[ends] - total[ends - lengths]
        kept, spans = [], []
        for e, size, k in zip(ends.tolist(), lengths.tolist(), removed.tolist(), strict=True):
            if not k:
                kept.append(raw[e - size : e])
                spans.append(0)
                continue
            g = gone[e - size : e]
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()))
            kept.append(data[e - size : e][~g].tobytes())
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(lengths), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept, pa.binary())})

    return blocks.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay), a row for each row of docs."""
    blocks = stash(text_blocks(docs), "texts")
    n, parts = blocks.count(), shuffle_partitions(docs.sparkSession)
    # what a task holds hangs on the data: a bucket has the anchors of 64 blocks, a shard the contexts of 4
    buckets, shards = max(parts, n // 64), max(2 * parts, n // 4)
    answered = stash(answer(ask(blocks, buckets), buckets), "anchors")
    found = stash(find_repeats(contexts(blocks, answered, buckets, shards), buckets, shards), "repeats")
    repeats = found.filter("kind = 0").selectExpr("at AS block", "a AS firsts", "b AS runs").union(merge_edges(found.filter("kind = 1")))
    return cut(blocks, repeats)
