"""N-gram Jaccard join by chosen paths: near copies at a similarity of 0.8 or more of their five-word shingles.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. Equal word sequences are one text from the
start, so copies are never expanded. A text is embedded as PERMS minhash values of its shingle set. In each run, sets
are split recursively: a node picks places of the embedding by its own hash, and sets that agree there go on together;
the root picks one or two of them (1 / 0.8 on average), other nodes more, so that a pair at the bound goes on at any
depth. Buckets of at most HOT sets are finished in one task (`connect`): sets of a bucket that no link has joined yet are
compared with all others in it by brute force, and what is still open after PAIRS comparisons is split again. In a
larger bucket, all sets are compared with one of them, the hub: those with an estimate of TIGHT or more leave, and those
that any partner of one that left must be among (the estimate is a metric) are linked to the hub, so no pair is lost;
the rest is split. The number of runs follows from the target recall and the depth reached. What is linked so
are candidates with an estimate of at least 0.8 - MARGIN; within each component of candidates, all pairs are then judged
exactly, on whole texts, which gives the links, their number for each text, and the classes (components of links). Pairs are
compared in blocks of BLOCK texts or BLOCK_WORDS words. In a component of more than a block, texts within half the bound's distance
of its centre are linked without a comparison, as the distance is a metric: so a hot group of near copies of one text takes time
in proportion to its size, and only its outliers are compared with all.

Defined results: doc_id (an integer), class_id (smallest doc_id of its class), n_links (different texts that this one is linked
with), n_copies (rows with the same words, itself included), a row for each row of docs. Texts with fewer than five words
are one shingle; texts without words (null texts too) are classes of their own, with no links and n_copies 1. Rows with a
null doc_id are compared like all others; class_id is null where all rows of a class have null ids. Repeated rows are copies;
different texts under one doc_id are texts of their own. Extra columns are ignored by join() and kept by dedupe(); an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattis.llm.links import components
from lattis.llm.work import ALNUM, by_group, groups_of, mix64, slices, stash, texts

WORDS, LEAST = 5, 0.8
PERMS, MARGIN = 64, 0.2
#: In how many of the places a pair at the bound agrees, for the number of runs: one standard deviation below LEAST.
AGREE = 0.75
#: Sets of a bucket that one task finishes; comparisons in it before it is split; when a set leaves with a hub.
HOT, PAIRS, TIGHT = 8192, 1 << 22, 0.8
#: Places that a node below the root picks: in buckets over HOT, and within a task.
WIDE, DEEP = 2, 3
BLOCK, BLOCK_WORDS = 1024, 400_000
A = mix64(np.arange(1, PERMS + 1)) | np.uint64(1)
B = mix64(np.arange(1001, PERMS + 1001))
_MUL = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: dict) -> np.ndarray:
    """A hash of each five-word shingle; of all words if they are fewer; none if there are no words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        return mix64(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64))
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        out += h[k : k + n] * _MUL[k]
    return mix64(out)


def minhash(parts: list[np.ndarray]) -> np.ndarray:
    """PERMS minima (of 32 bits) for each non-empty array of shingles."""
    flat = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    out = np.empty((len(parts), PERMS), np.uint32)
    for j in range(PERMS):
        out[:, j] = np.minimum.reduceat((flat * A[j] + B[j]) >> np.uint64(32), starts)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """rid (a number of the row, fixed once this is written), doc_id, text, rest (the other columns), s1 and s2 (a 128-bit hash of the words;
    null without words), n_words, vec (the embedding)."""

    def run(batches):
        hashes = _Hashes()
        for batch in slices(batches):
            words = [t.translate(ALNUM).split() for t in texts(batch.column("text"))]
            on = [i for i, w in enumerate(words) if w]
            s1, s2, vec = [None] * len(words), [None] * len(words), [None] * len(words)
            for lo in range(0, len(on), 256):
                part = on[lo : lo + 256]
                rows = minhash([shingles(words[i], hashes) for i in part])
                for i, row in zip(part, rows, strict=True):
                    digest = xxhash.xxh3_128_digest(b" ".join(words[i]))
                    s1[i], s2[i] = (int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))
                    vec[i] = row.tobytes()
            added = [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "s1", "s2", "n_words", "vec"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")], F.lit(0).alias("_")).alias("rest"))
    schema = StructType(list(rows.schema.fields)).add("s1", "long").add("s2", "long").add("n_words", "long").add("vec", "binary")
    return rows.mapInArrow(run, schema)


def survival(hot_levels: int) -> float:
    """The chance that a pair at the bound meets in one run, hot_levels of buckets over HOT below the root included."""
    goes_on = 1.0
    for _ in range(50):  # within a task, to any depth
        goes_on = 1 - (1 - AGREE * goes_on) ** DEEP
    for _ in range(hot_levels):
        goes_on = 1 - (1 - AGREE * goes_on) ** WIDE
    second = 1 / LEAST - 1
    return (1 - second) * AGREE * goes_on + second * (1 - (1 - AGREE * goes_on) ** 2)


def runs_for(recall: float, hot_levels: int = 0) -> int:
    """Runs after which a pair at the similarity bound is missed with a chance of 1 - recall at most."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(hot_levels))))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, PERMS)


def _places(nodes: np.ndarray, wide: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which of the nodes have a place of that turn, and the place: `wide` different ones, or one or two at a root."""
    rows, h = np.arange(len(nodes)), mix64(nodes ^ np.uint64(0xD6E8FEB86659FD93))
    first = (h % np.uint64(PERMS)).astype(np.int64)
    step = 1 + 2 * ((h >> np.uint64(8)) % np.uint64(PERMS // 2)).astype(np.int64)  # odd, so the places differ
    if wide is None:
        more = np.flatnonzero((h >> np.uint64(32)) % np.uint64(1000) < np.uint64(round(1000 * (1 / LEAST - 1))))
        return [(rows, first), (more, (first[more] + step[more]) % PERMS)]
    return [(rows, (first + k * step) % PERMS) for k in range(wide)]


def _child(nodes: np.ndarray, place: np.ndarray, values: np.ndarray) -> np.ndarray:
    return mix64(mix64(nodes + place.astype(np.uint64)) ^ values.astype(np.uint64))


def _split(sets: DataFrame, runs: range | None) -> DataFrame:
    """(key, id) of the children of the root in each run, or of rows (key, id, vec)."""
    roots = None if runs is None else [int(mix64(np.array([r + 1]))[0]) for r in runs]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = np.asarray(batch.column("id")), _matrix(batch.column("vec"))
            starts = [np.asarray(batch.column("key")).view(np.uint64)] if roots is None else [np.full(len(ids), r, np.uint64) for r in roots]
            for nodes in starts:
                for at, place in _places(nodes, WIDE if roots is None else None):
                    keys = _child(nodes[at], place, vecs[at, place])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[at])], names=["key", "id"])

    return sets.mapInArrow(run, "key long, id long")


def connect(vecs: np.ndarray, node: int, cut: float, pairs: int | None = None) -> np.ndarray:
    """A label for each set of a bucket, the smallest index of its component under links of at least `cut`, as far
    as the chosen path joins them; without a loss where `pairs` comparisons finish the bucket."""
    pairs, label, least = pairs or PAIRS, np.arange(len(vecs)), math.ceil(cut * PERMS - 1e-9)
    todo = [(np.arange(len(vecs)), np.array([node], np.uint64))]
    while todo:
        at, here = todo.pop()
        tried, budget, step = np.zeros(len(at), bool), pairs, max(1, (1 << 18) // len(at))
        while True:
            names, count = np.unique(label[at], return_counts=True)
            odd = np.flatnonzero((label[at] != names[count.argmax()]) & ~tried)[:step]
            if not len(odd) or budget <= 0:
                break
            budget -= len(odd) * len(at)
            tried[odd] = True
            like = (vecs[at[odd], None, :] == vecs[at][None, :, :]).sum(axis=2) >= least
            for row in np.flatnonzero(like.sum(axis=1) > 1):
                own = np.unique(label[at[like[row]]])
                if len(own) > 1:
                    label[np.isin(label, own)] = own[0]
        if len(odd):
            rest = at[~tried]
            for _, place in _places(here, DEEP):
                values = vecs[rest, place[0]]
                order = np.argsort(values, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
                    if len(part) > 1:
                        todo.append((rest[part], _child(here, place, values[part[:1]])))
    return label


def _buckets(batches):
    """(key, ids, vecs) of each bucket, from batches sorted by key."""
    for key, table in groups_of(batches, "key"):
        yield key, table.column("id").to_numpy(), _matrix(table.column("vec"))


def _finish(rows: DataFrame, cut: float) -> DataFrame:
    """Links (a, b) of each set of a bucket to the first one of its component, in buckets of at most HOT sets."""

    def run(batches):
        a, b = [], []
        for key, ids, vecs in _buckets(batches):
            if len(ids) == 2:
                if (vecs[0] == vecs[1]).mean() >= cut:
                    a.append(int(ids[1]))
                    b.append(int(ids[0]))
            else:
                label = connect(vecs, key % (1 << 64), cut)
                on = np.flatnonzero(label != np.arange(len(ids)))
                a += ids[on].tolist()
                b += ids[label[on]].tolist()
            if len(a) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return by_group(rows, "key", "id").mapInArrow(run, "a long, b long")


def _near_hub(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                est = (_matrix(batch.column("vec")) == _matrix(batch.column("hub_vec"))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("hub"), batch.column("vec"), pa.array(est)], names=["key", "id", "hub", "vec", "est"])

    return rows.select("key", "id", "hub", "vec", "hub_vec").mapInArrow(run, "key long, id long, hub long, vec binary, est double")


def _run(reps: DataFrame, runs: range, cut: float) -> tuple[list[DataFrame], int]:
    """Links found by these runs, and the levels of buckets over HOT that they went through."""
    found, levels, members = [], 0, _split(reps, runs)
    while True:
        # the hub is the smallest id XOR key: another one for each node, and its minimum is taken before the shuffle
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("m")).filter("n > 1").select(F.col("key").alias("k"), "n", F.col("m").bitwiseXOR(F.col("key")).alias("hub"))
        sizes = stash(sizes, "sizes")  # written, so that the join is one of two plain tables and a hot key's rows are split
        shared = stash(members.join(sizes, F.col("key") == F.col("k")).drop("k"), "buckets")
        found.append(_finish(shared.filter(F.col("n") <= HOT).select("key", "id").join(reps, "id"), cut))
        hot = shared.filter(F.col("n") > HOT).select("key", "id", "hub")
        if hot.isEmpty():
            return found, levels
        levels += 1
        hubs = sizes.filter(F.col("n") > HOT).select(F.col("k"), "hub").join(reps.withColumnRenamed("id", "_id").withColumnRenamed("vec", "hub_vec"), F.col("hub") == F.col("_id")).select("k", "hub_vec")
        near = stash(_near_hub(hot.join(reps, "id").join(stash(hubs, "hubs"), F.col("key") == F.col("k")).drop("k")), "near")
        found.append(near.filter((F.col("est") >= cut - (1 - TIGHT)) & (F.col("id") != F.col("hub"))).select(F.col("id").alias("a"), F.col("hub").alias("b")))
        members = stash(_split(near.filter((F.col("est") < TIGHT) & (F.col("id") != F.col("hub"))).select("key", "id", "vec"), None), "paths")


def candidates(reps: DataFrame, recall: float, cut: float) -> DataFrame:
    """Links (a, b) whose components hold all candidate pairs found; reps has id and vec. Runs go on until they are as
    many as the recall needs at the depth that they have reached."""
    found, done, levels = [], 0, 0
    while done < runs_for(recall, levels):
        runs = range(done, runs_for(recall, levels))
        links, deep = _run(reps, runs, cut)
        found, done, levels = found + links, runs.stop, max(levels, deep)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def exact_links(rows: DataFrame, least: float) -> DataFrame:
    """For groups of texts (key, root, side, id, text): id, other (an id that it is linked with; a spanning forest of the group's
    links, enough for components) or null, links (number of its links in the group). Of sides 0 and 1, only pairs across are
    compared (none where a side is empty); of side 2, all pairs."""

    def parts(batches):
        for _, table in groups_of(batches, "key"):  # keys are hashes: two components may share one
            cuts = np.flatnonzero(np.diff(table.column("root").to_numpy())) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows], strict=True):
                yield table.slice(lo, hi - lo)

    def run(batches):
        hashes, bound = _Hashes(), Fraction(str(least))  # 0.8 is 4/5, so that a similarity of just that counts
        num, den = bound.numerator, bound.denominator
        schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
        for table in parts(batches):
            ids, sides = table.column("id").to_numpy(), table.column("side").to_numpy()
            if len(ids) < 2 or sides[0] == sides[-1] < 2:
                continue
            sets = [np.unique(shingles((t or b"").translate(ALNUM).split(), hashes)) for t in table.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            on = counts[place] > 1
            owner, column = owner[on], np.unique(place[on], return_inverse=True)[1]
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            across = int(np.searchsorted(sides, 1)) if sides[0] < 2 else 0  # rows are sorted by side
            left, right = (slice(0, across), slice(across, None)) if across else (slice(None), slice(None))
            common = np.zeros((len(sets[left]), len(sets[right])), np.float32)
            width = int(column.max()) + 1 if len(column) else 0
            for lo in range(0, width, 4096):
                a, b = np.searchsorted(column, [lo, lo + 4096])
                m = np.zeros((len(sets), min(4096, width - lo)), np.float32)
                m[owner[a:b], column[a:b] - lo] = 1
                common += m[left] @ m[right].T
            common = np.rint(common).astype(np.int64)
            ok = common * den >= num * (sizes[left][:, None] + sizes[right][None, :] - common)
            if not across:
                np.fill_diagonal(ok, False)
            links = ok.sum(axis=1)
            links = np.concatenate([links, ok.sum(axis=0)]) if across else links
            if not links.any():
                continue
            label = np.arange(len(ids))
            for row in np.flatnonzero(ok.any(axis=1)):
                own = np.unique(np.append(label[np.flatnonzero(ok[row]) + across], label[row]))
                if len(own) > 1:
                    label[np.isin(label, own)] = own[0]
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array([int(ids[label[k]]) if label[k] != k else None for k in hit], pa.int64()), pa.array(links[hit])], schema=schema)

    return by_group(rows, "key", "root", "side", "id").mapInArrow(run, "id long, other long, links long")


def cores(members: DataFrame, radius: float) -> DataFrame:
    """Of members (id, root, m, text), m texts to a component: id, and core, whether its distance from the component's centre (the set
    of the shingles that more than half of the texts have) is at most radius. The distance is a metric, so two texts of
    the core are no farther apart than twice that. Centres are counted over all members, pre-aggregated in each task."""

    def spread(batches):
        hashes = _Hashes()
        for batch in slices(batches):
            sets = [np.unique(shingles(t.translate(ALNUM).split(), hashes)) for t in texts(batch.column("text"))]
            sizes = [len(x) for x in sets]
            root, m, s = (np.repeat(np.asarray(batch.column(c)), sizes) for c in ("root", "m", "m"))
            s = np.concatenate(sets).view(np.int64)
            order = np.lexsort((s, root))
            root, m, s = root[order], m[order], s[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(root) != 0) | (np.diff(s) != 0)]))
            yield pa.RecordBatch.from_arrays([pa.array(root[first]), pa.array(m[first]), pa.array(s[first]), pa.array(np.diff(np.append(first, len(s))))], names=["root", "m", "shingle", "n"])

    def measure(batches):
        hashes = _Hashes()
        for batch in slices(batches, 200):
            core = []
            for text, centre in zip(texts(batch.column("text")), batch.column("centre"), strict=True):
                own = np.unique(shingles(text.translate(ALNUM).split(), hashes))
                centre = np.asarray(centre.values).view(np.uint64)
                common = int(np.isin(own, centre).sum())
                core.append(1 - common / (len(own) + len(centre) - common) <= radius - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(core, pa.bool_())], names=["id", "core"])

    counted = members.select("root", "m", "text").mapInArrow(spread, "root long, m long, shingle long, n long").groupBy("root", "m", "shingle").agg(F.sum("n").alias("n"))
    centres = stash(counted.filter(2 * F.col("n") > F.col("m")).groupBy("root").agg(F.collect_list("shingle").alias("centre")).withColumnRenamed("root", "_root"), "centres")
    return members.select("id", "root", "text").join(centres, F.col("root") == F.col("_root")).select("id", "text", "centre").mapInArrow(measure, "id long, core boolean")


def _blocks(signed: DataFrame, reps: DataFrame, comps: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """What there is to compare in components (id, root) of candidates: rows (key, root, side, id) of groups of texts of which all
    pairs, or all across sides, are to be compared; and the links that need no comparison, as exact_links() has them. In a component of more
    than a block, the texts of the core are all linked with one another, so no two blocks of it are compared."""
    own = stash(comps.join(reps.select(F.col("id").alias("_id"), "n_words"), F.col("id") == F.col("_id")).select("id", "root", "n_words"), "members")
    count = lambda n, words: F.greatest(F.ceil(n / BLOCK), F.ceil(words / BLOCK_WORDS)).cast("int")
    sizes = stash(own.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n_words").alias("w")).select(F.col("root").alias("_root"), "m", count(F.col("m"), F.col("w")).alias("nb")), "sizes")
    # written, so that Spark knows how small it is before it shuffles the texts for a join with it
    big = stash(own.join(sizes.filter("nb > 1"), F.col("root") == F.col("_root")).select(F.col("id").alias("_id"), "root", "m"), "big")
    core = stash(cores(signed.select(F.col("rid").alias("id"), "text").join(big, F.col("id") == F.col("_id")).select("id", "root", "m", "text"), (1 - least) / 2).filter("core"), "cores")
    own = stash(own.join(core.select(F.col("id").alias("_id"), "core"), F.col("id") == F.col("_id"), "left").select("id", "root", "n_words", F.coalesce("core", F.lit(False)).alias("core")), "members")
    part = lambda c: (F.sum(F.when(c, 1).otherwise(0)), F.sum(F.when(c, F.col("n_words")).otherwise(0)))
    blocks = own.groupBy("root").agg(count(*part(F.col("core"))).alias("nc"), count(*part(~F.col("core"))).alias("ns"), F.count(F.when(F.col("core"), 1)).alias("mc"), F.min(F.when(F.col("core"), F.col("id"))).alias("first"))
    members = own.join(stash(blocks.withColumnRenamed("root", "_root"), "blocks"), F.col("root") == F.col("_root"))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    members = members.withColumn("own", F.when(F.col("core"), place(F.greatest("nc", F.lit(1)))).otherwise(F.col("nc") + place(F.greatest("ns", F.lit(1)))))
    # a text of block x goes to the block pairs (x, y) and (y, x) that are to be compared
    others = F.when(F.col("core") & (F.col("ns") == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.when(F.col("core"), F.col("nc")).otherwise(0), F.col("nc") + F.col("ns") - 1))
    pairs = members.select("id", "root", "own", F.explode(others).alias("y")).select("id", "root", F.xxhash64("root", F.least("own", "y"), F.greatest("own", "y")).alias("key"), F.when(F.col("own") == F.col("y"), 2).otherwise((F.col("own") > F.col("y")).cast("int")).alias("side"))
    sure = members.filter("core AND mc > 1").select("id", F.when(F.col("id") != F.col("first"), F.col("first")).alias("other"), (F.col("mc") - 1).alias("links"))
    return pairs, sure


def _join(signed: DataFrame, least: float, recall: float) -> DataFrame:
    """t1 and t2 (s1 and s2 of a text), class_id, keeper (the row of the class that stays), n_links, n_copies; signed is signatures(), written."""
    reps = signed.filter("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid", "n_words", "vec")).alias("r"), F.count(F.lit(1)).alias("n_copies"))
    # a text goes by the number of its first row, so ids may be null or repeated
    reps = stash(reps.select("s1", "s2", "n_copies", F.col("r.doc_id").alias("doc_id"), F.col("r.rid").alias("id"), F.col("r.n_words").alias("n_words"), F.col("r.vec").alias("vec")), "reps")
    comps = stash(components(candidates(reps.select("id", "vec"), recall, least - MARGIN)), "candidates")
    pairs, sure = _blocks(signed, reps, comps, least)
    whole = signed.select(F.col("rid").alias("id"), "text").join(pairs.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id")
    exact = stash(exact_links(whole, least).union(sure), "exact")
    classes = stash(components(exact.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))), "classes").withColumnRenamed("id", "_c")
    degrees = exact.groupBy("id").agg(F.sum("links").alias("n_links")).withColumnRenamed("id", "_d")
    # the class is named by its smallest doc_id, and the row with it stays; nulls come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "id")).alias("f")
    names = stash(classes.join(reps.select("id", "doc_id"), F.col("_c") == F.col("id")).groupBy("root").agg(first).select(F.col("root").alias("_r"), F.col("f.doc_id").alias("name"), F.col("f.id").alias("first")), "names")
    info = reps.drop("vec").join(classes.join(names, F.col("root") == F.col("_r")).select("_c", "name", "first"), F.col("id") == F.col("_c"), "left").join(degrees, F.col("id") == F.col("_d"), "left")
    single = F.col("first").isNull()
    return info.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.when(single, F.col("doc_id")).otherwise(F.col("name")).alias("class_id"), F.coalesce("first", "id").alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")


def join(docs: DataFrame, least: float = LEAST, recall: float = 0.9999) -> DataFrame:
    signed = stash(signatures(docs.select("doc_id", "text")), "signatures")
    rows = signed.filter("s1 IS NOT NULL").select("doc_id", "s1", "s2")
    linked = rows.join(_join(signed, least, recall), (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2"))).select("doc_id", "class_id", "n_links", "n_copies")
    return linked.union(signed.filter("s1 IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.lit(1).cast("long")))


def dedupe(docs: DataFrame, least: float = LEAST, recall: float = 0.9999) -> DataFrame:
    """One row of each class, one with its smallest doc_id (rows without an id come last), with all columns of docs. Rows
    without words all stay."""
    signed = stash(signatures(docs), "signatures")
    info = _join(signed, least, recall)
    rows = signed.filter("s1 IS NOT NULL").select(F.col("rid").alias("_rid"), "s1", "s2")
    gone = rows.join(info, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2"))).filter("_rid <> keeper").select("_rid")
    kept = signed.select("rid", "doc_id", "text", "rest").join(gone, F.col("rid") == F.col("_rid"), "left_anti")
    return kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in ("doc_id", "text") else F.col("rest")[f"c{i}"].alias(f.name) for i, f in enumerate(docs.schema)])
