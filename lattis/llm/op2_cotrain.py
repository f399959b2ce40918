"""Quality scores by co-training two views of a page.

One classifier sees the text's content (hashed words and shape statistics), the other the page's metadata (language,
source, length). Both start from the labelled documents; in each round, each scores all unlabelled documents and gives
its most confident labels, GIVE of each class, to the other. A held-out part of the labelled rows calibrates both views
and weighs their log-odds into one score, by which all documents are scored in one pass. At most LABELLED labelled
documents (those with the smallest hash of doc_id) are used. Features are worked out once and kept in the shared
folder; each round reads them for a top-k of ids and for the features of those taken. The models are a few kB.

Defined results: a null text counts as empty, a null language or source is a value of its own; doc_id is carried as it
is and repeated rows get equal scores; an id is labelled once, whatever its rows, and rows without an id aren't; extra columns are ignored; labels without a document, or null, are ignored; with
no labels of both kinds every score is 0.5 (kept); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattis.llm.work import LOWER, slices, stash, texts

LABELLED = 3000
DIMS, STATS, META = 2048, 9, 160
ROUNDS, GIVE, SURE = 5, 100, 0.9


class Buckets(dict):
    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        b = self[word] = zlib.crc32(word) % DIMS
        return b


def content(text: bytes, buckets: Buckets) -> tuple[np.ndarray, list[float]]:
    """Hash buckets of a text's words, and its shape statistics."""
    words = text.translate(LOWER).split()
    n, size = len(words), max(1, len(text))
    at = np.fromiter(map(buckets.__getitem__, words), np.int64, n)
    lines = text.split(b"\n")
    marks = sum(text.count(m) for m in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    stats = [
        math.log1p(n) / 10, min(2.0, size / max(1, n) / 10), min(2.0, marks / max(1, n)), min(2.0, text.count(b"!") / max(1, n)), len(set(words)) / max(1, n),
        len(set(lines)) / len(lines), sum(1 for a, b in zip(words, words[1:]) if a == b) / max(1, n),  # noqa: B905
        (size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size, (size - len(text.translate(None, b"0123456789"))) / size * 5,
    ]
    return at, stats


def metadata(lang, source, n: int) -> list[int]:
    """Buckets of a page's metadata that are on."""
    of = lambda kind, v, k: zlib.crc32(f"{kind}:{'' if v is None else v}:{v is None}".encode()) % k
    return [of("lang", lang, 64), 64 + of("source", source, 64), 128 + min(31, int(2 * math.log2(1 + n)))]


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Logistic regression by Adam on whole batches; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    beta, m, v = np.zeros(x.shape[1], np.float32), 0, 0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - y)) / w.sum() + l2 * beta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        beta = beta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return beta.astype(np.float64)


def _logit(x, beta):
    return x @ beta[:-1] + beta[-1]


FEATURES = "doc_id long, at binary, stats array<double>, meta array<int>"


def _features(docs: DataFrame) -> DataFrame:
    """FEATURES of the rows that have an id; at holds the hash buckets of a text's words as 16-bit integers."""

    def run(batches):
        buckets = Buckets()
        for batch in slices(batches):
            raw = texts(batch.column("text"))
            rows = [content(t, buckets) for t in raw]
            meta = [metadata(a, b, len(t)) for a, b, t in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([at.astype(np.int16).tobytes() for at, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.int32()))], names=["doc_id", "at", "stats", "meta"])

    own = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return stash(own.mapInArrow(run, FEATURES), "features")


def _fetch(rows: DataFrame, chosen: DataFrame) -> pa.Table:
    """chosen (a bounded table by doc_id) with the features of one row of each id, on the driver, by id."""
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("at", "stats", "meta")).alias("f"), *[F.max(c).alias(c) for c in chosen.columns if c != "doc_id"]).select("doc_id", "f.*", *[c for c in chosen.columns if c != "doc_id"]).toArrow().sort_by("doc_id")


def _matrices(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of a table of features."""
    text, meta = np.zeros((table.num_rows, DIMS + STATS), np.float32), np.zeros((table.num_rows, META), np.float32)
    for i, (at, stats, on) in enumerate(zip(*(table.column(c).to_pylist() for c in ("at", "stats", "meta")), strict=True)):
        at = np.frombuffer(at, np.int16)
        text[i, :DIMS] = np.bincount(at, minlength=DIMS) * (10 / max(1, len(at)))
        text[i, DIMS:] = stats
        meta[i, on] = 1
    return text, meta


def _surest(rows: DataFrame, betas: list[np.ndarray], taken: list[set[int]]) -> list[tuple[int, int, int, float]]:
    """(view that gets it, label, doc_id, confidence): of all rows whose id isn't among those taken by that view, the GIVE ids of
    each label that the other view is surest of. Each task gives out GIVE of each at most."""
    known = [np.array(sorted(t), np.int64) for t in taken]

    def run(batches):
        best: dict[tuple[int, int], dict[int, float]] = {(k, y): {} for k in (0, 1) for y in (1, 0)}
        for batch in batches:
            n, ids = batch.num_rows, batch.column("doc_id").to_numpy()
            if not n:
                continue
            raw = batch.column("at").cast(pa.binary()).to_pylist()
            sizes = np.array([len(a) // 2 for a in raw])
            words = np.bincount(np.repeat(np.arange(n), sizes), betas[0][np.frombuffer(b"".join(raw), np.int16)], minlength=n)
            stats = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(n, STATS)
            on = batch.column("meta").flatten().to_numpy(zero_copy_only=False).reshape(n, 3)
            z = (words * 10 / np.maximum(1, sizes) + stats @ betas[0][DIMS:-1] + betas[0][-1], betas[1][on].sum(1) + betas[1][-1])
            for (k, y), held in best.items():
                p = 1 / (1 + np.exp(-np.clip(z[1 - k], -700, 700)))
                conf = p if y else 1 - p
                at = np.flatnonzero((conf >= SURE) & ~np.isin(ids, known[k]))
                for i, c in zip(ids[at].tolist(), conf[at].tolist(), strict=True):
                    held[i] = max(c, held.get(i, 0.0))
                if len(held) > GIVE:
                    best[k, y] = dict(sorted(held.items(), key=lambda r: (-r[1], r[0]))[:GIVE])
        out = [(k, y, i, c) for (k, y), held in best.items() for i, c in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64()))], names=["k", "y", "doc_id", "c"])

    sure = rows.mapInArrow(run, "k int, y int, doc_id long, c double").groupBy("k", "y", "doc_id").agg(F.max("c").alias("c"))
    rank = F.row_number().over(Window.partitionBy("k", "y").orderBy(F.desc("c"), "doc_id"))
    return sorted((r["k"], r["y"], r["doc_id"], r["c"]) for r in sure.withColumn("r", rank).filter(F.col("r") <= GIVE).collect())


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict | None:
    """Both views' weights, their calibration and their weights in the score; None if there is nothing to learn from."""
    given = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    rows = _features(docs)
    given = given.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    table = _fetch(rows, given)
    y = np.array([int(v > 0) for v in table.column("y").to_pylist()], int)
    if (y == 0).sum() < 4 or (y == 1).sum() < 4:
        return None
    text, meta = _matrices(table)
    fold = np.array([zlib.crc32(str(d).encode()) % 4 for d in table.column("doc_id").to_pylist()])
    held, views, ids = fold == 0, [text, meta], table.column("doc_id").to_pylist()
    place, marks = {d: i for i, d in enumerate(ids)}, [np.where(~held, y, -1) for _ in views]
    taken, betas = [set(ids), set(ids)], [None, None]
    for turn in range(rounds + 1):
        for k, x in enumerate(views):
            own = marks[k] >= 0
            weight = np.where(np.arange(len(x))[own] < len(y), 1.0, 0.5).astype(np.float32)
            betas[k] = _fit(x[own], marks[k][own].astype(np.float32), weight)
        if turn == rounds:
            break
        sure: dict[tuple[int, int], tuple[float, int]] = {}
        for k, label, d, c in _surest(rows, betas, taken):  # the most confident go to the other view
            sure[k, d] = max(sure.get((k, d), (0.0, 0)), (c, label))  # an id with different texts gets one label
        new = sorted({d for _, d in sure} - place.keys())
        if new:
            more = _fetch(rows, docs.sparkSession.createDataFrame([(d,) for d in new], "doc_id long"))
            place |= {d: len(place) + i for i, d in enumerate(more.column("doc_id").to_pylist())}
            views = [np.vstack(v) for v in zip(views, _matrices(more), strict=True)]
            marks = [np.concatenate([m, np.full(len(new), -1)]) for m in marks]
        for (k, d), (_, label) in sure.items():
            marks[k][place[d]] = label
            taken[k].add(d)
    held = np.concatenate([held, np.zeros(len(place) - len(y), bool)])
    y = np.concatenate([y, np.full(len(place) - len(y), -1)])
    z = np.stack([_logit(x[held], b) for x, b in zip(views, betas, strict=True)], 1) if held.any() else np.zeros((0, 2))
    combine = np.array([1.0, 0.0, 0.0])
    platt = [np.array([1.0, 0.0])] * 2
    if len(np.unique(y[held])) == 2:
        ones = np.ones(held.sum(), np.float32)
        platt = [_fit(z[:, [k]].astype(np.float32), y[held], ones, 1e-4, 400) for k in range(2)]
        platt = [p if p[0] > 0 else np.array([0.0, math.log(y[held].mean() / (1 - y[held].mean()))]) for p in platt]  # a view that ranks the wrong way round tells nothing
        c = np.stack([z[:, k] * platt[k][0] + platt[k][1] for k in range(2)], 1)
        combine = _fit(c.astype(np.float32), y[held], ones, 1e-3, 400)
    return {"text": betas[0], "meta": betas[1], "platt": platt, "combine": combine}


def score(docs: DataFrame, model: dict | None, least: float = 0.5) -> DataFrame:
    """doc_id, calibrated text_score and meta_score, score, kept (score is at least `least`), a row for each row."""

    def run(batches):
        buckets = Buckets()
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for batch in slices(batches):
            n = batch.num_rows
            if model is None or not n:
                a = b = s = np.full(n, 0.5)
            else:
                wt, wm = model["text"], model["meta"]
                za, zb = np.empty(n), np.empty(n)
                for i, (t, lang, source) in enumerate(zip(texts(batch.column("text")), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                    at, stats = content(t, buckets)
                    za[i] = wt[at].sum() * 10 / max(1, len(at)) + np.dot(wt[DIMS:-1], stats) + wt[-1]
                    zb[i] = wm[metadata(lang, source, len(t))].sum() + wm[-1]
                za, zb = (z * p[0] + p[1] for z, p in zip((za, zb), model["platt"], strict=True))
                a, b, s = sigmoid(za), sigmoid(zb), sigmoid(za * model["combine"][0] + zb * model["combine"][1] + model["combine"][2])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(s), pa.array(s >= least)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")
