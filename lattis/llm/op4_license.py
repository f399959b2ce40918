"""License scans with a positional rare-token index.

The templates are short notices, titles, SPDX lines and the telling paragraphs of licence texts, each with a mandatory key
phrase; four names (BASE) are templates that are all key phrase. The index holds every word of the key phrases
with its positions, and the words' weights (inverse document frequencies, counted over all documents; a table bounded by the templates' words).
A file's licence words are looked up from the highest weight down: where a template's rarest word is in the file,
its places, less the word's position in the template, are the template's possible starts; the places of its other words, rarest
first, are intersected with them by relative position until none is left or all words agree. What is left holds the key
phrase in full, which is verified word by word, and its score is the share of the template's words in place. Every place of a key phrase is
found, as it holds all of the phrase's words.

Defined results: null text counts as empty (no words, no labels, score 0.0, null places); doc_id (an integer) is carried as it is;
extra columns are ignored; repeated rows give repeated results; an empty table gives an empty result. A licence text that
has been cut down to none of its telling paragraphs, notices or names gets no label.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.llm.work import ALNUM, slices, texts

#: Phrases and labels that the scan must count.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: label, notice text, mandatory key phrase within it. An alignment's score is the share of the notice's words in place.
NOTICES = (
    ("mit-notice", "released under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("public-domain", "released into the public domain", "into the public domain"),
)
#: Titles, SPDX lines and paragraphs as the licences' publishers have them, as lower-case words.
PARAGRAPHS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsd", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license version 2 1 february 1999", "gnu lesser general public license version"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software released into the public domain"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("gpl-3.0", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    ("gpl-2.0", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 3 clause"),
)
TEMPLATES = NOTICES + PARAGRAPHS
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,len:int,score:double>>"


@dataclass(frozen=True)
class Template:
    """A notice with its key phrase at a position; words: the phrase's words and positions in it, the rarest first."""

    label: str
    is_base: bool
    notice: list[bytes]
    phrase: list[bytes]
    at: int
    words: list[tuple[bytes, int]]


def vocabulary(templates=TEMPLATES, base=BASE) -> set[bytes]:
    """The words that are indexed: those of all key phrases."""
    return {w for _, _, key in templates for w in key.encode().split()} | {w for p, _ in base for w in p.encode().split()}


class Index:
    """Postings: for each word of a key phrase, the templates in which it stands, and at which position of the phrase;
    and of each word the templates that are looked up by it, as it is their rarest."""

    def __init__(self, weight: dict[bytes, float], templates=TEMPLATES, base=BASE):
        self.templates: list[Template] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.by_rarest: dict[bytes, list[int]] = {}
        self.weight = weight
        for label, notice, key, is_base in [(label, p, p, True) for p, label in base] + [(*t, False) for t in templates]:
            words, phrase = notice.encode().split(), key.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            rarest = sorted(((w, k) for k, w in enumerate(phrase)), key=lambda x: (-weight[x[0]], x[1]))
            for w, k in rarest:
                self.postings.setdefault(w, []).append((len(self.templates), k))
            self.by_rarest.setdefault(rarest[0][0], []).append(len(self.templates))
            self.templates.append(Template(label, is_base, words, phrase, at, rarest))

    def places(self, words: list[bytes]):
        """(template, start) of each place in words at which a template's key phrase stands."""
        held = [w for w in self.by_rarest.keys() & set(words)]
        if not held:
            return
        where: dict[bytes, set[int]] = {}
        for i, w in enumerate(words):
            if w in self.postings:
                where.setdefault(w, set()).add(i)
        for w in sorted(held, key=lambda w: (-self.weight[w], w)):  # the file's words of the highest weight first
            for number in self.by_rarest[w]:
                t = self.templates[number]
                starts = {i - t.words[0][1] for i in where[w]}
                for other, k in t.words[1:]:
                    own = where.get(other, ())
                    starts = {i for i in starts if i + k in own}
                    if not starts:
                        break
                for start in sorted(starts):
                    if words[start : start + len(t.phrase)] == t.phrase:
                        yield t, start


def document_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the words; counted over all rows, and no larger than the words."""

    def count(batches):
        seen, n = Counter(), 0
        for batch in slices(batches):
            for text in texts(batch.column(0)):
                n += 1
                seen.update(words.intersection(text.translate(ALNUM).split()))
        yield pa.RecordBatch.from_pydict({"w": ["", *(w.decode() for w in seen)], "n": [n, *seen.values()]}, schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {r["w"].encode(): r["n"] for r in rows}


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, least: float = 0.6) -> DataFrame:
    """Licence labels, their places and the score of the best alignment, a row for each row of docs."""
    df = document_frequencies(docs, vocabulary(templates, base))
    total = max(1, df.get(b"", 1))
    idf = {w: math.log(total / (1 + df.get(w, 0))) for w in vocabulary(templates, base)}
    index = Index(idf, templates, base)

    def look_up(words: list[bytes]):
        places, spans, best, names = [], [], 0.0, set()
        for t, start in index.places(words):
            if t.is_base:
                places.append(start)
                names.add(t.label)
                continue
            first = start - t.at
            score = sum(0 <= first + k < len(words) and words[first + k] == x for k, x in enumerate(t.notice)) / len(t.notice)
            if score >= least:
                best = max(best, score)
                spans.append({"label": t.label, "start": max(first, 0), "len": min(first + len(t.notice), len(words)) - max(first, 0), "score": score})
        return places, names, sorted(spans, key=lambda x: (x["start"], x["label"], -x["len"])), best

    def run(batches):
        for batch in slices(batches):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in texts(batch.column("text")):
                words = text.translate(ALNUM).split()
                places, names, spans, best = look_up(words)
                more = names | {s["label"] for s in spans}
                values = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(more)), max(best, 0.5 if names else 0.0), spans)
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(out[k], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")), pa.array(out["base_labels"], pa.string()), pa.array(out["labels"], pa.string()), pa.array(out["score"], pa.float64()),
                 pa.array(out["spans"], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("len", pa.int32()), ("score", pa.float64())])))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
