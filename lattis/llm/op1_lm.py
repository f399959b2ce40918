"""Language-model scores from a weighted backoff automaton.

The model is a smoothed n-gram model (n is `order`) whose lowest order is the add-`alpha` unigram model, and
p(w | h) = (c(h w) + mu * p(w | h')) / (c(h) + mu) with h' the context h without its first word. As an automaton, each
seen context is a state; a seen n-gram is an arc with that weight, to the state of the longest seen context that it
ends with; every other word goes by the state's failure arc, weight mu / (c(h) + mu), to the state h', and last to the
root state, whose arcs are the unigrams and one arc for all unknown words. Probabilities of a state sum to one. A
document is read once from left to right: the state is carried from word to word, and the log10 weights of the
arcs and failure arcs taken are added up.

The counts cover every token of every training document, and no table of them is ever whole in one place: texts are
coded in blocks (each input task cuts its rows to blocks of about BLOCK tokens and writes them out, so a block is
fixed from then on); each block asks for the counts of its own distinct n-grams, as packed 64-bit keys dealt to
buckets by key; a bucket adds up and answers each block; the block builds the part of the automaton that its documents
can reach. A frequent word is one key for each block, so no key is hot. There are never more rows in this exchange than
keys, so it stays in proportion to the input however many blocks and buckets there are; buckets are as many as it takes for
about KEYS questions to one, and a task holds one of them. Two different n-grams of a
corpus of n distinct ones share a key with a chance of about n * n / 3.7e19.

Defined results: a null text counts as empty (one token, its end); documents with a null doc_id are training documents;
repeated rows count as often as they occur; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.work import LOWER, by_group, groups_of, mix64, shuffle_partitions, slices, stash, texts

BLOCK, KEYS = 1_200_000, 4_000_000
ALPHA, MU, ORDER = 0.1, 4.0, 2
START, END = b" <s>", b" </s>"  # no word holds a blank

CODED = "block long, doc_ids array<long>, held_out array<boolean>, lengths binary, words binary, codes binary, train_tokens long, train_docs long"
ASKED = "bucket int, block long, n_words int, keys binary, counts binary"
ANSWERED = "block long, bucket int, n_types long, counts binary"


class Codes(dict):
    """Word -> code, in order of first use."""

    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def code_blocks(docs: DataFrame) -> DataFrame:
    """Texts as word codes, in blocks."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        new = lambda: (Codes({START: 0, END: 1}), [], [], [], [], 0)
        codes, ids, held, lengths, parts, n = new()

        def flush():
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes), np.uint64, len(codes))
            size = np.array(lengths, np.int32)
            train = ~np.array(held, bool)
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([size.tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary()),
                 pa.array([_pack(np.concatenate(parts))], pa.binary()), pa.array([int(size[train].sum())], pa.int64()), pa.array([int(train.sum())], pa.int64())],
                names=["block", "doc_ids", "held_out", "lengths", "words", "codes", "train_tokens", "train_docs"],
            )

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = tokens(text)
                words.append(END)
                parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(is_held_out(doc_id))
                lengths.append(len(words))
                n += len(words)
                if n >= BLOCK:
                    yield flush()
                    block += 1
                    codes, ids, held, lengths, parts, n = new()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED)


class Grams:
    """The n-grams that a block's traversals meet. For each length: which one ends at each token (-1: the text has begun
    too lately for one), their number, and of each its context (one of the length below), its last word and the n-gram
    without its first word. The context of a text's first word is the start."""

    def __init__(self, lengths: np.ndarray, codes: np.ndarray, n_words: int, order: int):
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.place, self.sizes, self.context, self.word, self.lower = [codes], [n_words], [None], [np.arange(n_words)], [None]
        for n in range(2, order + 1):
            before = self.place[-1]
            context = np.empty(len(codes), np.int64)
            context[1:] = before[:-1]
            context[begins] = 0 if n == 2 else -1
            on = np.flatnonzero(context >= 0)
            distinct, first, inverse = np.unique(context[on] * n_words + codes[on], return_index=True, return_inverse=True)
            place = np.full(len(codes), -1, np.int32)
            place[on] = inverse
            h, w = np.divmod(distinct, n_words)
            self.place.append(place)
            self.sizes.append(len(distinct))
            self.context.append(h)
            self.word.append(w)
            self.lower.append(before[on[first]])

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Keys of all of them, the words' first."""
        out, hashed = [mix64(words ^ np.uint64(0x5851F42D4C957F2D))], words
        for n in range(1, len(self.sizes)):
            hashed = mix64(hashed[self.context[n]] * np.uint64(0x9E3779B97F4A7C15) + mix64(words[self.word[n]]) + np.uint64(n - 1))
            out.append(hashed)
        return np.concatenate(out)

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each of them ends at a token for which train holds."""
        return np.concatenate([np.bincount(p[train & (p >= 0)], minlength=k) for p, k in zip(self.place, self.sizes, strict=True)])


def _row(row: dict, order: int):
    lengths, words, codes = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["words"], np.uint64), _unpack(row["codes"], np.int32)
    return lengths, words, codes, Grams(lengths, codes, len(words), order)


def ask(coded: DataFrame, buckets: int, order: int) -> DataFrame:
    """For each block and bucket: keys of the block's n-grams, and how often its training documents hold them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lengths, words, codes, grams = _row(row, order)
                counts = grams.counts(np.repeat(~np.array(row["held_out"], bool), lengths))
                keys = grams.keys(words)
                at = (keys % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[by], np.arange(buckets + 1))
                for b in range(buckets):
                    own = by[cuts[b] : cuts[b + 1]]
                    if len(own):
                        yield pa.RecordBatch.from_pydict(
                            {"bucket": [b], "block": [row["block"]], "n_words": [int((own < len(words)).sum())], "keys": [keys[own].tobytes()], "counts": [_pack(counts[own])]},
                            schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n_words", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]),
                        )

    return coded.select("block", "held_out", "lengths", "words", "codes").mapInArrow(run, ASKED)


def answer(asked: DataFrame, parts: int) -> DataFrame:
    """For each question, the sums of the counts of its keys over all blocks, and the words known in the bucket."""

    def run(batches):
        for bucket, table in groups_of(batches, "bucket"):
            keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")]
            counts = [_unpack(k.as_py(), np.int64) for k in table.column("counts")]
            n_words = table.column("n_words").to_pylist()
            sizes = np.array([len(k) for k in keys])
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
            ends = np.cumsum(sizes)
            is_word = np.zeros(len(distinct), bool)
            for end, size, n in zip(ends, sizes, n_words, strict=True):
                is_word[place[end - size : end - size + n]] = True
            types = int((is_word & (sums > 0)).sum())
            for block, end, size in zip(table.column("block").to_pylist(), ends, sizes, strict=True):
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "bucket": [bucket], "n_types": [types], "counts": [_pack(sums[place[end - size : end]])]},
                    schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n_types", pa.int64()), ("counts", pa.binary())]),
                )

    return by_group(asked, "bucket", "block", parts=parts).mapInArrow(run, ANSWERED)


class Automaton:
    """The part of the model that a block can reach. State 0 is the root, with an arc for each word. Every context of 1 to
    order - 1 words has a state, numbered by length. An arc (state, word) stands in the sorted array `keys`, with its weight
    and the state it leads to, the longest context that is seen there. Any other word goes by the failure arc: the
    state's `back` weight, and on from `fail`, the state of the context without its first word."""

    def __init__(self, grams: Grams, counts: np.ndarray, total: int, types: int, starts: int, alpha: float, mu: float):
        by_length, order = np.split(counts, np.cumsum(grams.sizes)[:-1]), len(grams.sizes)
        self.n_words, self.order, self.start = grams.sizes[0], order, 1 if starts and order > 1 else 0
        self.root = np.log10((by_length[0] + alpha) / (total + alpha * (types + 1)))
        first = 1 + np.concatenate([[0], np.cumsum(grams.sizes[: order - 1])]).astype(np.int64)
        self.root_to, self.fail, self.back = np.zeros(self.n_words, np.int64), np.zeros(first[-1], np.int64), np.zeros(first[-1])
        keys, weights, to, path = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], self.root
        for n in range(1, order):  # contexts of n words, and the arcs that leave them
            times = by_length[n - 1].astype(np.float64)
            if n == 1:
                times[0], times[1] = starts, 0  # as contexts: the start once a document, the end never
                self.root_to = np.where(times > 0, first[0] + np.arange(self.n_words), 0)
            else:
                self.fail[first[n - 1] : first[n]] = first[n - 2] + grams.lower[n - 1]
            back = np.log10(mu / (times + mu))
            self.back[first[n - 1] : first[n]] = back
            state, word, count, lower = grams.context[n], grams.word[n], by_length[n], path[grams.lower[n]]
            on = np.flatnonzero(count)
            weight = np.log10((count[on] + mu * 10 ** lower[on]) / (times[state[on]] + mu))
            keys.append((first[n - 1] + state[on]) * self.n_words + word[on])
            weights.append(weight)
            to.append(first[n] + on if n + 1 < order else first[n - 1] + grams.lower[n][on])
            path = back[state] + lower  # the weight on which a word is read from here, by failure arcs or by its arc
            path[on] = weight
        keys, weights, to = np.concatenate(keys), np.concatenate(weights), np.concatenate(to)
        by = np.argsort(keys)
        self.keys, self.weights, self.to = keys[by], weights[by], to[by]

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read a word from each state: the log10 weights of the arcs taken, failure arcs too, and the states reached."""
        weight, state, open_ = np.zeros(len(states)), states.copy(), np.arange(len(states))
        while len(open_):
            at, word = state[open_], words[open_]
            place = np.searchsorted(self.keys, at * self.n_words + word)
            hit = (at > 0) & (place < len(self.keys))
            hit[hit] = self.keys[place[hit]] == at[hit] * self.n_words + word[hit]
            read, root = open_[hit], open_[at == 0]
            weight[read] += self.weights[place[hit]]
            state[read] = self.to[place[hit]]
            weight[root] += self.root[words[root]]
            state[root] = self.root_to[words[root]]
            open_, at = open_[~hit & (at > 0)], at[~hit & (at > 0)]
            weight[open_] += self.back[at]
            state[open_] = self.fail[at]
        return weight, state

    def traverse(self, lengths: np.ndarray, codes: np.ndarray, piece: int = 512) -> np.ndarray:
        """Each document's log10 probability, by one traversal from left to right that carries the state. All documents of the
        block are read side by side. A long one is read in pieces side by side as well: a state hangs on the last
        order - 1 words alone, so a piece begins at the root with the words before it, which it doesn't count."""
        begins, n = np.concatenate([[0], np.cumsum(lengths)[:-1]]), -(-lengths // piece)
        doc = np.repeat(np.arange(len(lengths)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        counted = begins[doc] + k * piece
        at, stop = np.where(k > 0, counted - (self.order - 1), counted), np.minimum(counted + piece, begins[doc] + lengths[doc])
        by = np.argsort(at - stop, kind="stable")  # the longest first, so that those still being read come first
        doc, at, stop, counted = doc[by], at[by], stop[by], counted[by]
        sizes, state, sums = stop - at, np.where(k[by] > 0, 0, self.start), np.zeros(len(doc))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            on = np.searchsorted(-sizes, -t)  # sizes above t
            here = at[:on] + t
            weight, state[:on] = self.step(state[:on], codes[here])
            sums[:on] += np.where(here >= counted[:on], weight, 0)
        return np.bincount(doc, sums, len(lengths))


def score(docs: DataFrame, alpha: float = ALPHA, mu: float = MU, order: int = ORDER) -> DataFrame:
    """Scores of all documents by the model of those that aren't held out."""
    spark = docs.sparkSession
    coded = stash(code_blocks(docs), "lm-blocks")
    totals = coded.agg(F.sum("train_tokens").alias("n"), F.sum("train_docs").alias("d")).first()
    total, starts = int(totals["n"] or 0), int(totals["d"] or 0)
    # several to a task, as they are dealt by hash: the fullest task is then nearer to the mean
    buckets = max(3 * shuffle_partitions(spark), -(-total * order // KEYS))
    parts = -(-buckets // 3)
    answered = stash(answer(ask(coded, buckets, order), parts), "lm-counts")
    per_bucket = answered.groupBy("bucket").agg(F.max("n_types").alias("n"))
    types = int(per_bucket.agg(F.sum("n")).first()[0] or 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        lengths, words, codes, grams = _row(row, order)
        counts = np.zeros(sum(grams.sizes), np.int64)
        at = (grams.keys(words) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[by], np.arange(buckets + 1))
        for b, data in zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True):
            counts[by[cuts[b] : cuts[b + 1]]] = _unpack(data, np.int64)
        auto = Automaton(grams, counts, total, types, starts, alpha, mu)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        n = len(lengths)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(np.add.reduceat((counts[: len(words)][codes] > 0).astype(np.int64), first)), "train_tokens": pa.array(np.full(n, total, np.int64)),
            "base_score": pa.array(np.add.reduceat(auto.root[codes], first)), "score": pa.array(auto.traverse(lengths.astype(np.int64), codes)),
        })

    return coded.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
