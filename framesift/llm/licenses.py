"""Operator 9: license scans over a positional rare-token index.

Each template is a word sequence; the index posts every template word with
its relative position. For a file, each template's word that is rarest in
the corpus (highest inverse document frequency over all documents) is looked
up; its places propose starts, the postings of the template's other words are
intersected by relative position, and a label needs its key phrase whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, cut_batches, map_texts

#: Key phrases that make a base place, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Texts of public licenses and of the notices that files carry.
#: Further notices: (label, template, mandatory key phrase inside it). The template may be worn, the key phrase not.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "licensed under the apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty", "gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mozilla public license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "in no event will the authors be held liable"),
    # notices that stop after their first sentence
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed under the apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("mit", "licensed under the mit license", "licensed under the mit license"),
    ("mit", "released under the mit license", "released under the mit license"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "governed by a bsd style license"),
)
#: Share of a notice's inverse document frequency that must stand in place.
WORN = 0.6


def templates() -> list[tuple[str, tuple[bytes, ...], int, int]]:
    """(label, words, start and end of the key phrase); base phrases first, each its own key."""
    out = [(label, tuple(alnum_words(p)), 0, len(p.split())) for p, label in BASE.items()]
    for label, text, key in NOTICES:
        words, need = tuple(alnum_words(text)), tuple(alnum_words(key))
        at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        out.append((label, words, at, at + len(need)))
    return out


def template_words() -> list[bytes]:
    return sorted({w for _, words, *_ in templates() for w in words})


def document_frequency(df: DataFrame, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows, and for each template word the rows that have it; every row and whole texts. A fixed number of words comes to the driver."""
    words = template_words()
    known = frozenset(words)

    def count(batches):
        at, total = {w: i for i, w in enumerate(words)}, np.zeros(len(words) + 1, np.int64)
        for batch in cut_batches(batches):
            for text in batch.column(0).to_pylist():
                total[-1] += 1
                total[[at[w] for w in known.intersection(alnum_words(text))]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["word", "n"])

    texts = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = {r.word: r.n for r in texts.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return n.get(len(words), 0), {w: n.get(i, 0) for i, w in enumerate(words)}


class LicenseIndex:
    """Postings of template words with inverse document frequencies; looks files up."""

    def __init__(self, rows: int, frequency: dict[bytes, int]):
        self.idf = {w: math.log((1 + rows) / (1 + n)) + 1 for w, n in frequency.items()}
        self.templates = templates()
        self.rarest = [max(range(a, b), key=lambda i: (self.idf[words[i]], -i)) for _, words, a, b in self.templates]
        self.known = frozenset(self.idf)

    def lookup(self, text: str) -> dict:
        """n_words, places of base phrases, base labels, all labels and the score of a file."""
        words = alnum_words(text)
        found = self.known.intersection(words)
        out = {"n_words": len(words), "starts": [], "base": set(), "labels": set(), "score": 0.0}
        live = [t for t, (_, ws, a, b) in enumerate(self.templates) if found.issuperset(ws[a:b])]
        if not live:
            return out
        posts = {w: [] for t in live for w in self.templates[t][1]}
        for i, w in enumerate(words):
            if w in posts:
                posts[w].append(i)
        for t in live:
            label, ws, a, b = self.templates[t]
            starts = {i - self.rarest[t] for i in posts[ws[self.rarest[t]]]}
            for k in sorted(range(a, b), key=lambda k: len(posts[ws[k]])):
                starts.intersection_update({i - k for i in posts[ws[k]]})
            if t < len(BASE):
                if starts:
                    out["starts"] += starts
                    out["base"].add(label)
                    out["score"] = 1.0
            elif starts:
                whole = sum(self.idf[w] for w in ws)
                share = max(sum(self.idf[w] for k, w in enumerate(ws) if 0 <= s + k < len(words) and words[s + k] == w) for s in starts) / whole
                if share >= WORN:
                    out["labels"].add(label)
                out["score"] = max(out["score"], min(1.0, share))
        out["labels"] |= out["base"]
        return out


def license_scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with n_words, starts (word offsets of base places), base_labels, labels (arrays) and score.

    Two passes over whole texts, no shuffle of texts: document frequencies of
    the template words, then the lookup. Null and empty texts have no words,
    no places, no labels and score 0. Repeated rows are scanned each; an empty
    table gives an empty one; columns with the new names are replaced.
    """
    index = df.sparkSession.sparkContext.broadcast(LicenseIndex(*document_frequency(df, text_col)))

    def make():
        def run(texts):
            found = [index.value.lookup(x) for x in texts]
            return {
                "n_words": [x["n_words"] for x in found],
                "starts": [sorted(x["starts"]) for x in found],
                "base_labels": [sorted(x["base"]) for x in found],
                "labels": [sorted(x["labels"]) for x in found],
                "score": [x["score"] for x in found],
            }

        return run

    names = T.ArrayType(T.StringType())
    out = [T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("base_labels", names), T.StructField("labels", names), T.StructField("score", T.DoubleType())]
    return map_texts(df, text_col, make, out, keep)
