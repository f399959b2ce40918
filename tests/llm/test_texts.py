"""Quality rules, licence scans, audio features and removal of repeats."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

DATA = "/root/testdata"
from lattis.llm import op3_rules, op4_license, op5_audio, op6_suffix
from lattis.llm.queries import OP3_SQL


def brute_rules(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, odd, empty):
    for df in (docs, odd):
        packed = df.select("doc_id", "text", df["text"].alias("t"))
        for r in op3_rules.ledger(packed, keep=("doc_id", "t")).collect():
            m = brute_rules(r["t"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
            assert bool(r["failed"] & 3) == (m[0] < 50 or 100 * m[4] > 50 * m[0])
    assert op3_rules.ledger(empty).collect() == []


def test_repeats_in_a_long_text_are_not_by_a_cut_hash(spark):
    """xxhash64 of these two windows differs in the high 18 bits only, which the positions of 140,000 words take."""
    text = " ".join([f"w{i}" for i in range(140_000)] + ["1853038 b c x 10933721 b c"])
    df = spark.createDataFrame([(1, text), (2, text + " 1853038 b c")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in op3_rules.ledger(df).collect()}
    assert got == {1: 0, 2: 6} == {1: brute_rules(text)[4], 2: brute_rules(text + " 1853038 b c")[4]}


@pytest.mark.parametrize("n", [2045, 2046, 2047, 2048, 5000])
def test_repeats_on_both_sides_of_the_packed_length(spark, n):
    text = " ".join(f"w{i * i % 1999}" for i in range(n))
    assert op3_rules.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_repeat_words"] == brute_rules(text)[4]


def test_rules_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/sf0.001/documents.parquet'")
    from lattis.llm.queries import op3_quality_rules

    got = op3_quality_rules(spark, f"{DATA}/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(OP3_SQL).df()[got.columns.tolist()].sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))


def test_rules_run_on_the_jvm_without_a_shuffle(docs):
    plan = op3_rules.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan) and plan.count("split") <= 4


def test_policies_and_ablation(docs, odd):
    kept = op3_rules.filter_documents(odd)
    assert kept.columns == odd.columns
    led = op3_rules.ledger(docs).cache()
    bits = [r["failed"] for r in led.collect()]
    for r in op3_rules.ablation(led, "v1").collect():
        b = 1 << op3_rules.RULES[r["rule"]][0]
        assert (r["fails"], r["fails_alone"], r["kept_without"]) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))
    assert led.filter(op3_rules.passes("base")).count() >= led.filter(op3_rules.passes("v1")).count() == op3_rules.filter_documents(docs).count()


def test_license_places(docs, odd, empty):
    for df in (docs, odd):
        got = {}
        for r in op4_license.scan(df).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for d in df.select("doc_id", "text").collect():
            low = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "")
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            places = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, _ in op4_license.BASE}
            every = [i for v in places.values() for i in v]
            want = (len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(label for p, label in op4_license.BASE if places[p])))
            for r in got[d["doc_id"]]:
                assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want or d["doc_id"] in (None,)
                assert set(want[4].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1
    assert op4_license.scan(empty).collect() == []


def brute_license(text):
    """(labels, score) by trying every template at every word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = set(), 0.0
    for phrase, label in op4_license.BASE:
        p = phrase.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            labels.add(label)
            best = max(best, 0.5)
    for label, notice, key in op4_license.TEMPLATES:
        n, p = notice.split(), key.split()
        at = next(i for i in range(len(n)) if n[i : i + len(p)] == p)
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                score = sum(0 <= i - at + k < len(words) and words[i - at + k] == x for k, x in enumerate(n)) / len(n)
                if score >= 0.6:
                    labels.add(label)
                    best = max(best, score)
    return ",".join(sorted(labels)), best


MIT = """MIT text. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice shall be included."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def test_license_texts_against_brute_force(spark, docs, odd):
    rng, pieces = np.random.default_rng(5), [MIT, ISC, GPL, "SPDX-License-Identifier: Apache-2.0", "GNU General Public License Version 3"]
    pieces += [n for _, n, _ in op4_license.TEMPLATES] + [p for p, _ in op4_license.BASE]
    made = []
    for i in range(300):  # texts that hold some of them, words of which are lost or changed
        words = " ".join([*(pieces[k] for k in rng.integers(0, len(pieces), 3)), "some other words"]).split()
        made.append((i, " ".join(w if rng.random() > 0.04 else "x" for w in words if rng.random() > 0.02)))
    frames = [spark.createDataFrame(made, "doc_id long, text string"), docs, odd]
    for df in frames:
        want = Counter((r["doc_id"], *brute_license(r["text"])) for r in df.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], r["labels"], r["score"]) for r in op4_license.scan(df).collect()) == want


def test_license_texts(spark):
    df = spark.createDataFrame([(1, MIT), (2, ISC), (3, GPL), (4, "permission to use a copy of this software free of charge is hereby granted to any person")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in op4_license.scan(df).collect()} == {1: "mit", 2: "isc", 3: "gpl,gpl-3.0", 4: ""}


def test_license_templates(spark):
    df = spark.createDataFrame([(1, "x. Licensed under the Apache License, Version 2.0."), (2, "Now licensed by an Apache License, Version 2.0!"), (3, "apache version 2 0 license the"), (4, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op4_license.scan(df).collect()}
    assert got[1]["labels"] == "apache,apache-2.0" and got[1]["score"] == 1 and [(s["start"], s["len"]) for s in got[1]["spans"]] == [(1, 8)]
    assert got[2]["labels"] == "apache,apache-2.0" and 0.6 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[3]["score"] == 0
    assert got[4]["labels"] == "cc-by,cc-by-nc-4.0"


def test_audio_round_trip(docs, odd, empty):
    for df in (docs, odd):
        want = Counter()
        for d in df.select("doc_id", "text").collect():
            raw = (d["text"] or "").encode()
            p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            media = op5_audio.wav(p)
            want[(d["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest())] += 1
        got = op5_audio.digest(op5_audio.features(op5_audio.store(df))).collect()
        assert Counter(map(tuple, op5_audio.analyse(df).collect())) == Counter(map(tuple, got))
        assert Counter(tuple(r)[:7] for r in got) == want
        by_payload = {}
        for r in got:
            by_payload.setdefault(r["payload_sha256"], set()).add(r["feature"])
        assert all(len(v) == 1 for v in by_payload.values())
    assert op5_audio.digest(op5_audio.features(op5_audio.store(empty))).collect() == op5_audio.analyse(empty).collect() == []


def test_audio_wav_is_standard():
    import io
    import wave

    with wave.open(io.BytesIO(op5_audio.wav(bytes(range(256))))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(256)) == (1, 1, op5_audio.RATE, bytes(range(256)))


def test_audio_features_against_a_plain_version():
    rng = np.random.default_rng(1)
    pcm = rng.integers(0, 256, 6400).astype(np.uint8).tobytes()
    x = (np.frombuffer(pcm, np.uint8).astype(float) - 128) / 128
    x = np.concatenate([np.zeros(op5_audio.TAPS - op5_audio.DOWN), x])
    low = np.array([x[i : i + op5_audio.TAPS] @ op5_audio.SINC for i in range(0, len(x) - op5_audio.TAPS + 1, op5_audio.DOWN)])
    n = -(-(len(low) - op5_audio.FRAME) // op5_audio.HOP) + 1
    low = np.pad(low, (0, (n - 1) * op5_audio.HOP + op5_audio.FRAME - len(low)))
    want = np.array([np.log(np.maximum((np.abs(np.fft.rfft(low[k * op5_audio.HOP :][: op5_audio.FRAME] * op5_audio.HANN)) ** 2) @ op5_audio.MEL, op5_audio.FLOOR)) for k in range(n)])
    np.testing.assert_allclose(op5_audio.log_mel(pcm), want, atol=1e-3)


def test_audio_blocks_do_not_show(monkeypatch):
    pcm = (np.arange(50_000) * 37 % 251).astype(np.uint8).tobytes()
    whole = op5_audio.log_mel(pcm)
    monkeypatch.setattr(op5_audio, "BLOCK", 4096)
    np.testing.assert_allclose(op5_audio.log_mel(pcm), whole, atol=1e-4)


def test_audio_segments_and_tensors():
    mel = np.full((100, op5_audio.MELS), -10.0, np.float32)
    mel[20:40] += 0.2  # over LOW
    mel[25:30] += 0.5  # over HIGH
    mel[60:70] += 0.2  # never over HIGH
    step = op5_audio.HOP * op5_audio.DOWN / op5_audio.RATE
    spans = op5_audio.segments(mel)
    assert spans == [(20 * step, 40 * step)]
    table = op5_audio.read_tensor(op5_audio.tensor_bytes(mel, spans))
    clips = table.column("clip").to_numpy_ndarray()
    assert clips.shape == (4, op5_audio.CLIP, op5_audio.MELS) and np.array_equal(clips.reshape(-1, op5_audio.MELS)[:100], mel)
    assert [len(s) for s in table.column("segments").to_pylist()] == [1, 0, 0, 0]


def brute_repeats(pairs, size=200):
    seen = Counter(x[i : i + size] for _, x in pairs for i in range(len(x) - size + 1))
    out = []
    for d, x in pairs:
        edge = np.zeros(len(x) + 1, int)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                edge[i] += 1
                edge[i + size] -= 1
        gone = np.cumsum(edge)[: len(x)] > 0
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def sort(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("settings", [{}, {"HOT": 3, "SHARD": 2000, "BLOCK": 20_000}])
def test_repeats(docs, odd, empty, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(op6_suffix, k, v)
    for df in (docs, odd):
        pairs = [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]
        got = op6_suffix.remove_repeats(df).drop("kept").collect()
        assert sort(map(tuple, got)) == sort(brute_repeats(pairs))
    assert op6_suffix.remove_repeats(empty).collect() == []


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in (1, 40, 300, 7, 300)]
    strings.append(strings[2][50:] + strings[3])
    data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
    lengths = np.array([len(s) for s in strings])
    rest = (np.repeat(ends, lengths) - np.arange(len(data))).astype(np.int32)
    raw = data.tobytes()
    sa = op6_suffix.suffix_array(data, rest)
    suffix = lambda i: raw[i : i + rest[i]]
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: (suffix(i), i))
    lcp = op6_suffix.kasai(data, ends - lengths, lengths, sa, rest, 200)
    for a, b in zip(sa, sa[1:]):  # noqa: B905
        x, y = suffix(a), suffix(b)
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905
        assert lcp[b] == min(n, 200)
