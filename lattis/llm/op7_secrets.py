"""Secret scans: candidate tokens, and a random forest that drops false positives.

Candidates are runs of 16 or more token characters, of letters alone too, and runs of any length right after a hint word
with = or : (`passwd: "x7Kq2mP9"`; to the closing quote or the next blank, bracket, comma or parameter). The forest (grown here with numpy, on the driver, from a bounded
set of labelled findings) judges a candidate by its length, the transitions of its characters (their kinds, and how
likely they are under a chain fitted to the findings that are no secrets), how far dictionary words cover it (the DICTIONARY most
frequent words of the whole corpus, counted over all texts, with a few of other sources), whether it is shaped like a path, an address or a number, the path of its file (a column `path`, where docs has one) and the
words next to it. The findings are a parameter; by default a seeded generator writes FINDINGS of them, half secrets in several formats, half look-alikes
(paths, addresses, versions, checksums, identifiers, long words, and literals, calls, counts or prose after a hint word). The forest and the words are some 100 kB and go to the tasks with the
function; texts are read whole, once for the words and once for the candidates, and only counts of words are shuffled.

Defined results: a null text has no findings and stays null when redacted; doc_id is carried as it is; repeated rows give
repeated findings; extra columns are ignored by scan() and kept by redact(); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.work import slices, stash, texts

FINDINGS, DICTIONARY = 4000, 5000
SHORTEST, LONGEST = 4, 24  # of the dictionary's words
CANDIDATE = re.compile(rb"[A-Za-z0-9_+/=.@:\-]{16,}")
HINTS = (b"token", b"secret", b"password", b"passwd", b"pwd", b"key", b"auth", b"bearer", b"credential", b"private", b"access")
HARMLESS = (b"commit", b"checksum", b"sha256", b"md5", b"version", b"revision", b"file", b"path", b"url", b"mail", b"id", b"uuid", b"digest")
SAMPLES, CONFIG = (b"test", b"example", b"sample", b"fixture", b"doc"), (b".env", b".pem", b".yml", b".yaml", b".ini", b".cfg", b".properties", b".json")
COMMON = (b"the", b"and", b"tion", b"ing", b"ent", b"for", b"her", b"ter", b"user", b"data", b"name", b"file", b"test", b"main", b"index", b"com", b"http", b"www", b"org", b"lib", b"src", b"heit", b"keit", b"lich", b"ung", b"sch", b"mente", b"que", b"eau", b"aire", b"ado", b"ble", b"ers", b"that", b"with", b"config", b"report", b"image", b"example", b"mail")
#: An assignment; a hint word in the name before it; the value after it, quoted or not.
ASSIGN = re.compile(rb"[=:]+>?")
NAME = re.compile(rb"([A-Za-z0-9_.\-]+)[\"'`\])]*\s*$")
VALUE = re.compile(rb"\s{0,8}(?:(?:bearer|basic|token)\s+)?(?:[brfu]{0,2}([\"'`])([^\s\"'`]+)(?=\1)|[\"'`]?((?:(?!&\w+=)[^\s\"'`<>,;(){}\[\]])+))", re.I)
STRONG = (b"password", b"passwd", b"passphrase", b"pwd", b"secret")
NAMES = (*HINTS, b"passphrase")
LITERALS = {b"true", b"false", b"none", b"null", b"nil", b"yes", b"no", b"on", b"off", b"string", b"str", b"bytes", b"int", b"required", b"optional", b"undefined", b"todo", b"empty", b"hidden", b"invalid", b"missing", b"expired", b"xxx", b"self", b"this", b"the", b"a", b"is", b"not", b"it", b"to", b"see", b"bearer", b"basic"}
WORDS = (b"answer", b"bridge", b"castle", b"dragon", b"summer", b"winter", b"monkey", b"horse", b"battery", b"staple", b"correct", b"garden", b"window", b"silver", b"coffee", b"orange", b"river", b"planet", b"shadow", b"welcome", b"geschwindigkeit", b"verantwortung", b"wissenschaft", b"entwicklung", b"gesellschaft", b"lebensmittel", b"versicherung", b"straight", b"understanding", b"international", b"responsibility", b"administration", b"communication", b"characteristic", b"developpement", b"gouvernement", b"particulierement", b"conocimiento", b"desarrollo", b"responsabilidad", b"universidad", b"internacional")
#: A-Z to a-z; all that is no letter of these becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))
COLUMNS = "doc_id long, start long, length long, sha256 string, score double, is_secret boolean"


def _symbols(candidate: bytes) -> np.ndarray:
    """Letters as 0 to 25 in any case, digits as 26, all else as 27."""
    return _SYMBOL[np.frombuffer(candidate, np.uint8)]


_SYMBOL = np.full(256, 27)
_SYMBOL[97:123], _SYMBOL[65:91], _SYMBOL[48:58] = np.arange(26), np.arange(26), 26


def fit_transitions(candidates: list[bytes]) -> np.ndarray:
    """Log-probabilities of a symbol after another, smoothed by one."""
    counts = np.ones((28, 28))
    for c in candidates:
        s = _symbols(c)
        np.add.at(counts, (s[:-1], s[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> frozenset[bytes]:
    """The most frequent words of SHORTEST to LONGEST letters in all texts; a word that occurs once is none."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            own = {w: n for w, n in seen.items() if SHORTEST <= len(w) <= LONGEST}
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in own], pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for text in texts(batch.column(0)):
                seen.update(text.translate(LETTERS).split())
            if len(seen) > 200_000:
                yield rows()
                seen.clear()
        yield rows()

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    return frozenset(r["word"].encode() for r in stash(counted.orderBy(F.desc("n"), "word").limit(size).select("word"), "dictionary").collect())


def covered_share(low: bytes, words: frozenset[bytes]) -> float:
    """The share of a candidate's bytes that dictionary words cover, taken from the left, the longest first."""
    at = covered = 0
    while at < len(low):
        n = next((k for k in range(min(LONGEST, len(low) - at), SHORTEST - 1, -1) if low[at : at + k] in words), 0)
        covered += n
        at += n or 1
    return covered / max(1, len(low))


def features(candidate: bytes, before: bytes, after: bytes, path: bytes, chain: np.ndarray, words: frozenset[bytes] = frozenset(WORDS)) -> list[float]:
    """What the forest sees of a candidate, the bytes next to it and its file's path."""
    n, symbols = len(candidate), _symbols(candidate)
    kind = bytes(1 if 48 <= b <= 57 else 2 if 65 <= b <= 90 else 3 if 97 <= b <= 122 else 4 for b in candidate)
    share = lambda k: kind.count(k) / n
    turns = sum(a != b for a, b in zip(kind, kind[1:])) / n  # noqa: B905
    vowels = sum(candidate.lower().count(v) for v in (b"a", b"e", b"i", b"o", b"u")) / n
    hexes = sum(b in b"0123456789abcdef" for b in candidate) / n
    low, covered = candidate.lower(), 0
    for w in COMMON:
        covered += low.count(w) * len(w)
    counts = np.unique(np.frombuffer(candidate, np.uint8), return_counts=True)[1] / n
    near = b" ".join(re.findall(rb"[a-z0-9_]+", before.lower())[-3:])
    follows = re.findall(rb"[a-z]+", after.lower())[:1]
    name = NAME.search(before.rstrip(b" \t\"'`=:>")) if before.rstrip(b" \t\"'`>")[-1:] in (b"=", b":") else None
    name = name[1].lower() if name else b""
    return [
        n, share(1), share(2), share(3), share(4), turns, vowels, hexes, min(1.0, covered / n), float(-(counts * np.log2(counts)).sum()),
        candidate.count(b"/") / n, candidate.count(b".") / n, float(b"@" in candidate), float(b"://" in candidate), candidate.count(b"-") / n,
        float(any(h in near or h in low[:12] for h in HINTS)), float(any(h in near for h in HARMLESS)),
        float(before.rstrip(b" \"'`")[-1:] in (b"=", b":")), float(before[-1:] in (b'"', b"'", b"`")), float(bool(follows) and follows[0] in HARMLESS),
        float(chain[symbols[:-1], symbols[1:]].mean()) if n > 1 else 0.0, float(any(w in path.lower() for w in SAMPLES)), float(path.lower().endswith(CONFIG)),
        float(any(h in name for h in STRONG)), float(any(h in name for h in NAMES)), float(low in LITERALS), float(after[:1] == b"("), covered_share(low, words),
        float(before[-1:] == b" " and bool(re.match(rb"\W? ?[a-z]", after))), float(any(w in low for w in (b"your", b"change", b"env", b"get", b"config", b"${"))),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 3, words: frozenset[bytes] = frozenset()) -> list[tuple[bytes, bytes, bytes, bytes, int]]:
    """(candidate, text before, text after, path or empty, 1 if it is a secret), half of them secrets. Words in them are
    those given and WORDS, half of each."""
    r = random.Random(seed)
    known = sorted(words)
    hexa, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice(COMMON).decode() for _ in range(r.randint(1, 3)))
    out = []
    real = lambda: r.choice(known if known and r.random() < 0.5 else WORDS).decode()
    letters = alnum[:52]
    for i in range(n):
        short = i % 8 >= 6  # a quarter are values that only their name gives away
        if i % 2 and short:
            strong = r.random() < 0.6
            value = r.choice([
                lambda: draw(alnum, r.randint(6, 15)), lambda: draw(alnum + "!#$%*-_@", r.randint(8, 15)), lambda: draw(letters, r.randint(8, 32)), lambda: draw(alnum[:26], r.randint(10, 24)),
                *([lambda: real() + str(r.randint(1, 9999)), lambda: real().title() + str(r.randint(10, 2030)) + r.choice("!#$*"), lambda: "".join(real() for _ in range(r.randint(2, 4))), lambda: "".join(word() for _ in range(r.randint(2, 4))), lambda: "-".join(real() for _ in range(r.randint(2, 4))), real] if strong else []),
            ])()
            name = r.choice(["password", "passwd", "pwd", "DB_PASSWORD", "secret", "client_secret", "passphrase"] if strong else ["token", "api_key", "auth_token", "access_key", "private_key", "apikey", "credential"])
            before, after = r.choice([(f'{word()} {name} = "', f'" {word()}'), (f'"{name}": "', '", '), (f"{name}='", f"' {word()}"), (f"{name}=", f" {word()}"), (f"{name}=", "\n"), (f"{word()} {name}: ", "\n"), (f'{name}: "', '"\n')])
            if not (value.isalpha() and value.islower()) and r.random() < 0.3:
                before, after = f"{word()} {name}: ", r.choice([f" {word()}", f" and {word()}", "."])
        elif short:
            value, name, after = r.choice([
                lambda: (r.choice(sorted(LITERALS)).decode().title(), r.choice(["password", "token", "secret", "key"]), "\n"), lambda: (r.choice(sorted(LITERALS)).decode(), r.choice(["password", "token", "secret", "key"]), r.choice(["\n", f" {word()}", ", "])),
                lambda: (str(r.randint(0, 99999)), r.choice(["max_tokens", "n_tokens", "key_size", "key", "access_count"]), "\n"),
                lambda: (real(), r.choice(["key", "author", "keyword", "keyboard", "monkey", "access", "primary_key", "private"]), r.choice(["\n", f" {real()}", ", "])),
                lambda: (real().title(), r.choice(["author", "Authors", "keywords", "Key", "Access"]), f" {real()}"),
                lambda: (real(), r.choice(["secret", "password", "the key", "token"]), f" {real()} {real()}"),
                lambda: (r.choice(["user_id", "doc_id", "order_id", "name", "row.id", f"{real()}_id", f"{word()}_{word()}"]), r.choice(["primary_key", "foreign_key", "key", "sort_key", "token"]), r.choice(["\n", ", "])),
                lambda: (r.choice(["get_", "read_", "load_", "os.", "getpass.", "self."]) + word(), r.choice(["password", "token", "secret", "key"]), "("),
                lambda: (r.choice(["os.environ", "process.env.PASSWORD", "your_password", "your-token-here", "change_me", "config.password", "${PASSWORD}", "$ENV_TOKEN"]), r.choice(["password", "token", "secret", "api_key"]), r.choice(["\n", '"', "["])),
            ])()
            prose = after[:1] == " " and after[1:2].isalpha()
            before = f"{word()} {name}" + (": " if prose or r.random() < 0.5 else r.choice(["=", " = ", ' = "' if after == '"' else ": "]))
        elif i % 2:
            value = r.choice([lambda: draw(hexa, r.choice([32, 40, 64])), lambda: draw(alnum, r.randint(20, 48)), lambda: draw(letters, r.randint(16, 40)), lambda: "AKIA" + draw(alnum[26:], 16), lambda: "ghp_" + draw(alnum, 36), lambda: "sk-" + draw(alnum, 40), lambda: draw(alnum + "+/", r.randint(24, 60)) + "=" * r.randint(0, 2)])()
            name = r.choice(["token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "private_key"])
            before, after = r.choice([(f'{word()} {name} = "', f'" {word()}'), (f"{word()} {name}: ", f" {word()}"), (f"{name}='", f"' {word()}"), (f"Authorization: Bearer ", "\n"), (f"{word()} {name} ", f" {word()}")])  # noqa: F541
        else:
            kind = r.randrange(10)
            value = [
                lambda: "/".join(word() for _ in range(r.randint(3, 6))) + r.choice([".txt", ".py", ".html"]),
                lambda: f"{word()}.{r.randint(0, 99):02d}@mail{r.randint(1, 9)}.example.com",
                lambda: f"https://www.{word()}.com/{word()}/{word()}",
                lambda: "".join(word() for _ in range(r.randint(2, 5))),
                lambda: "_".join(word() for _ in range(4)),
                lambda: draw("0123456789", r.randint(16, 20)),
                lambda: draw(hexa, r.choice([32, 40, 64])),
                lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)),
                lambda: r.choice([str, str.title, str.upper])("".join(real() for _ in range(r.randint(1, 3)))),
                lambda: "".join(r.choice([real, word])().title() for _ in range(r.randint(2, 5))),
            ][kind]()
            before = f"{word()} {r.choice(['commit', 'checksum', 'sha256', 'digest', 'revision'])} " if kind == 6 else f"{word()} {r.choice(['id', 'uuid'])} " if kind == 7 else f"{word()} {r.choice(['', '', 'file ', 'url ', 'path = ', 'the ', 'token '])}"
            after = f" {word()}"
            value = value if len(value) >= 16 else (value + real() + "entwicklung") if kind >= 8 else value + "".join(word() for _ in range(6))
        folder, end = (r.choice(["src", "app", "conf", "deploy"]), r.choice([".env", ".yml", ".py", ".json"])) if i % 2 else (r.choice(["src", "tests", "docs", "examples"]), r.choice([".md", ".py", ".txt", ".json"]))
        path = r.choice(["", f"{folder}/{word()}{end}"])
        out.append((value.encode(), before.encode(), after.encode(), path.encode(), i % 2))
    return out


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 9, seed: int = 5) -> list[np.ndarray]:
    """Each tree as rows (feature or -1, threshold, left, right, share of secrets), grown on a bootstrap sample with
    sqrt(features) tried at each split and the best Gini gain over 16 quantiles taken."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        sample, nodes, stack = rng.integers(0, len(x), len(x)), [[-1, 0.0, 0, 0, 0.0]], []
        stack.append((0, sample, 0))
        while stack:
            at, rows, d = stack.pop()
            p = y[rows].mean()
            nodes[at][4] = p
            if d >= depth or len(rows) < 4 or p in (0.0, 1.0):
                continue
            best = (p * (1 - p) * len(rows) - 1e-9, None, None)
            for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
                v = x[rows, f]
                for t in np.unique(np.quantile(v, np.linspace(0.03, 0.97, 16))):
                    left = v <= t
                    k = left.sum()
                    if 0 < k < len(rows):
                        a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                        cost = k * a * (1 - a) + (len(rows) - k) * b * (1 - b)
                        if cost < best[0]:
                            best = (cost, f, t)
            if best[1] is None:
                continue
            left = x[rows, best[1]] <= best[2]
            nodes[at][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
            stack += [(nodes[at][2], rows[left], d + 1), (nodes[at][3], rows[~left], d + 1)]
        out.append(np.array(nodes))
    return out


def vote(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean share of secrets over the trees."""
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = t[at, 0].astype(np.int64)
            inner = f >= 0
            if not inner.any():
                break
            left = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
            at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(np.int64), at)
        total += t[at, 4]
    return total / len(forest)


class Model:
    """A forest, and the chain and the words that its features need."""

    def __init__(self, findings, words: frozenset[bytes] = frozenset(), **how):
        self.words = frozenset(WORDS) | words
        self.chain = fit_transitions([c for c, *_, y in findings if not y])
        self.forest = grow_forest(np.array([features(*f[:4], self.chain, self.words) for f in findings]), np.array([f[4] for f in findings], float), **how)

    def scores(self, found: list[tuple[bytes, bytes, bytes, bytes]]) -> np.ndarray:
        return vote(self.forest, np.array([features(*f, self.chain, self.words) for f in found])) if found else np.zeros(0)


@functools.lru_cache(maxsize=4)
def _trained(words: frozenset[bytes]) -> Model:
    return Model(labelled_findings(words=words), words)


def train(findings=None, words: frozenset[bytes] = frozenset(), **how) -> Model:
    """A model of labelled findings (generated ones unless some are given) and a corpus's words."""
    return _trained(words) if findings is None and not how else Model(labelled_findings(words=words) if findings is None else findings, words, **how)


def _hinted(text: bytes) -> list[tuple[int, int]]:
    """Spans of the values that stand after a hint word with = or :, in order and apart."""
    spans, end = [], 0
    for m in ASSIGN.finditer(text):
        if m.start() < end:
            continue
        near = text[max(0, m.start() - 200) : m.start()].lower()
        name = NAME.search(near) if any(h in near for h in NAMES) else None
        if name is None or not any(h in name[1] for h in NAMES):
            continue
        v = VALUE.match(text, m.end())
        if v:
            a, b = v.span(2) if v[2] else v.span(3)
            b -= 0 if v[2] or text[a:b].endswith(b"==") else len(text[a:b]) - len(text[a:b].rstrip(b".:,="))
            if a < b:
                spans.append((a, b))
                end = b
    return spans


def _runs(text: bytes, hinted: list[tuple[int, int]]):
    """Spans of the runs of 16 or more token characters outside of the hinted values."""
    k = 0
    for m in CANDIDATE.finditer(text):
        at, parts = m.start(), []
        while k < len(hinted) and hinted[k][1] <= at:
            k += 1
        j = k
        while j < len(hinted) and hinted[j][0] < m.end():
            parts.append((at, hinted[j][0]))
            at, j = hinted[j][1], j + 1
        for a, b in [*parts, (at, m.end())]:
            if b - a < 16:
                continue
            c = text[a:b] if text[a:b].endswith(b"==") else text[a:b].rstrip(b".:,=")
            eq = re.match(rb"[A-Za-z_]{2,20}[=:](?=.{12})", c)  # name=value without blanks
            b, a = a + len(c), a + (eq.end() if eq and b"://" not in c else 0)
            if b - a >= 16:
                yield a, b


def _find(raw: list[bytes], paths: list[bytes], model: Model) -> list[tuple[int, int, int, float]]:
    """(row, start, end, score) of the candidates in texts."""
    at, rows = [], []
    for i, (text, path) in enumerate(zip(raw, paths, strict=True)):
        hinted = _hinted(text)
        for a, b in sorted([*hinted, *_runs(text, hinted)]):
            at.append((i, a, b))
            rows.append((text[a:b], text[max(0, a - 80) : a], text[b : b + 24], path))
    return [(*p, s) for p, s in zip(at, model.scores(rows).tolist(), strict=True)]


def _paths(batch: pa.RecordBatch) -> list[bytes]:
    return texts(batch.column("path").cast(pa.string())) if "path" in batch.schema.names else [b""] * batch.num_rows


def scan(docs: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: doc_id, its place in the text's UTF-8 bytes, the sha256 of its bytes, the forest's
    score, and is_secret (score at or over the threshold)."""
    model = train(words=dictionary(docs)) if model is None else model

    def run(batches):
        for batch in slices(batches):
            raw, ids = texts(batch.column("text")), batch.column("doc_id").to_pylist()
            found = _find(raw, _paths(batch), model)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, *_ in found], pa.int64()), pa.array([a for _, a, _, _ in found], pa.int64()), pa.array([b - a for _, a, b, _ in found], pa.int64()),
                 pa.array([hashlib.sha256(raw[i][a:b]).hexdigest() for i, a, b, _ in found], pa.string()), pa.array([s for *_, s in found], pa.float64()), pa.array([s >= threshold for *_, s in found], pa.bool_())],
                names=["doc_id", "start", "length", "sha256", "score", "is_secret"],
            )

    return docs.select("doc_id", "text", *(["path"] if "path" in docs.columns else [])).mapInArrow(run, COLUMNS)


def redact(docs: DataFrame, model: Model | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark; n_chars, where there is one, follows."""
    model, mark_b = train(words=dictionary(docs)) if model is None else model, mark.encode()

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            raw = texts(batch.column(at))
            hits: dict[int, list] = {}
            for i, a, b, s in _find(raw, _paths(batch), model):
                if s >= threshold:
                    hits.setdefault(i, []).append((a, b))
            if hits:
                new = batch.column(at).to_pylist()
                for i, spans in hits.items():
                    text = raw[i]
                    for a, b in reversed(spans):
                        text = text[:a] + mark_b + text[b:]
                    new[i] = text.decode("utf-8", "replace")
                columns = list(batch.columns)
                columns[at] = pa.array(new, batch.schema.field(at).type)
                k = batch.schema.get_field_index("n_chars")
                if k >= 0:
                    sizes = columns[k].to_pylist()
                    for i in hits:
                        sizes[i] = len(new[i])
                    columns[k] = pa.array(sizes, batch.schema.field(k).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
