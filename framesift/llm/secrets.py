"""Operator 7: secret scans with a password guess-cost model.

Patterns find assignments, access keys and long hexadecimal runs. Values in
further credential contexts are judged by how many guesses they cost: the
cheapest segmentation into words, dates, repeats, keyboard walks and
brute-force spans, found by dynamic programming; costly values are added. Every
value is judged, also one of letters alone: what tells prose from secrets is
that its words are those of the corpus, ranked by how many documents have them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut_lineage, map_texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, then its value within a few characters; wider than the assignment pattern.
IN_CONTEXT, VALUE = r"\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|login|pin|(?:api|access|private|client|secret)[_ -]?(?:key|id|secret|token))\b[\"']?\x20*(?:is|was|[:=]+>?|->|\x20)\x20*[\"']?", r"[^\s\"'<>,;]{6,}"
CONTEXT = re.compile(f"{IN_CONTEXT}({VALUE})", re.I | re.A)
CONTEXT_HINT = re.compile(r"pass|pwd|secret|token|credential|auth|bearer|login|pin|key|client", re.I | re.A)

#: Words that guessers try first, commonest first.
COMMON = (
    "password", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "shadow", "qwerty", "sunshine", "princess", "football", "baseball",
    "iloveyou", "trustno", "superman", "batman", "hello", "freedom", "whatever", "secret", "test", "guest", "root", "user", "pass", "default", "changeme",
    "love", "summer", "winter", "spring", "autumn", "monday", "friday", "orange", "apple", "coffee", "cookie", "flower", "soccer", "hockey", "killer",
    "pepper", "ginger", "tigger", "jordan", "michael", "daniel", "charlie", "thomas", "robert", "george", "jessica", "ashley", "nicole", "server", "system",
    "database", "access", "token", "private", "public", "internet", "computer", "network", "example", "sample", "demo", "temp", "dev", "prod", "stage",
)
#: Words that several documents have are words too, at most so many, those of most documents first.
CORPUS_WORDS = 50_000
#: In a text of small letters: a value in its context or a hexadecimal run, which are passed over (a secret that is copied is no word), or a word of the corpus as the only group.
CORPUS_WORD = f"{IN_CONTEXT}{VALUE}|[0-9a-f]{{12,}}|(?<![a-z])([a-z]{{3,20}})(?![a-z])"


class Words:
    """What a word costs, by its place among the guessers' words and those of the corpus."""

    def __init__(self, corpus: Sequence[str] = ()):
        self.cost = {w: math.log10(i + 2) for i, w in enumerate(COMMON)}
        for i, w in enumerate(corpus):
            self.cost.setdefault(w, math.log10(i + len(COMMON) + 2))
        self.lengths = sorted({len(w) for w in self.cost})


LEET = str.maketrans("013457@$!", "oleastasi")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
DATE_SIZES = range(4, 11)
NEXT = {frozenset(p) for row in KEYBOARD for p in zip(row, row[1:])} | {frozenset((a, b)) for up, low in zip(KEYBOARD, KEYBOARD[1:]) for i, b in enumerate(low) for a in up[i : i + 2]}
#: Longest piece of the structured kinds; longer ones are chains of pieces.
PIECE = 24
COSTLY = 10.0


def pieces(value: str, i: int, pool: float, words: Words):
    """(end, cost) of every structured piece that begins at place i: words, dates, runs of a character, blocks that come again, walks over neighbouring keys or along the alphabet; each at every length it may have, up to PIECE."""
    n, low = len(value), value.lower()
    plain, stop = low.translate(LEET), min(n, i + PIECE)
    for k in words.lengths:
        if i + k <= n and (cost := words.cost.get(plain[i : i + k])) is not None:
            part = value[i : i + k]
            yield i + k, cost + 0.5 * (plain[i : i + k] != low[i : i + k]) + 0.3 * (part != part.lower())
    if value[i].isdigit():
        for k in DATE_SIZES:
            if i + k <= n and DATE.fullmatch(value, i, i + k):
                yield i + k, 4.6
    j = i + 1
    while j < stop and low[j] == low[i]:
        j += 1
        if j - i >= 3:
            yield j, pool + math.log10(j - i)
    for width in (2, 3, 4):
        block, j = low[i : i + width], i + width
        while j + width <= stop and low[j : j + width] == block:
            j += width
            yield j, pool * width + math.log10(j - i)
    j, turns, step = i + 1, 0, None
    while j < stop and (frozenset((low[j - 1], low[j])) in NEXT or ord(low[j]) - ord(low[j - 1]) in (1, -1)):
        now = ord(low[j]) - ord(low[j - 1])
        turns, step, j = turns + (step not in (None, now)), now, j + 1
        if j - i >= 4:
            yield j, 1.7 + math.log10(j - i) + 0.4 * turns


def guess_cost(value: str, words: Words | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation, a true minimum over all; linear in the value's length. A structured piece after another costs 0.3 more, a brute-force character what its alphabet does."""
    words, n, low = words or PLAIN, len(value), value.lower()
    pool = math.log10(10 if value.isdigit() else 16 if re.fullmatch("[0-9a-f]+", value) else 26 if value.isalpha() and value in (low, value.upper()) else 62 if value.isalnum() else 94)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        at = best[i] + (0.3 if i else 0.0)
        best[i + 1] = min(best[i + 1], best[i] + pool)
        for end, cost in pieces(value, i, pool, words):
            best[end] = min(best[end], at + cost)
    return best[n]


PLAIN = Words()


def context_values(text: str) -> list[tuple[int, str]]:
    """(start, value) of the values in credential contexts, six characters and more without the marks that end them."""
    if not CONTEXT_HINT.search(text):
        return []
    found = ((m.start(1), m[1].rstrip(".,;:!?)")) for m in CONTEXT.finditer(text))
    return [(start, value) for start, value in found if len(value) >= 6]


def corpus_words(df: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """Runs of 3 to 20 letters, outside of hexadecimal runs and of values in credential contexts, that two documents or more have: those of most documents first, ties in order of letters; counted over all rows and whole texts.

    At most ``most`` come to the driver: those above the least number of
    documents at which all that have as many or more still fit. It is found
    from how many words have each number, so no task sends its own best.
    """
    low = F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(CORPUS_WORD), F.lit(1)))).alias("word")).where("word <> ''")
    counts = cut_lineage(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    order = Window.orderBy(F.desc("n"))  # a row for each number that occurs
    fit = counts.groupBy("n").agg(F.count("*").alias("words")).select("n", F.sum("words").over(order).alias("up_to")).where(F.col("up_to") <= most).agg(F.min("n")).first()[0]
    if fit is None:
        return []
    return [r.word for r in sorted(counts.where(F.col("n") >= fit).collect(), key=lambda r: (-r.n, r.word))]


def find_secrets(text: str, words: Words = PLAIN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Base spans (start, kind, end) in order, and added spans with their guess cost."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    added = []
    for start, value in context_values(text):
        if (cost := guess_cost(value, words)) >= COSTLY:
            added.append((start, 3, start + len(value), cost))
    return sorted(base), added


def secret_spans(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``secrets``: an array of (start, end, kind, guess_cost) by start, then kind.

    Offsets are code points, ends exclusive; guess_cost (log10 of guesses) is
    given for added spans only. Two passes over whole texts, the first for
    the words of the corpus; no shuffle of texts, but of words counted in
    tasks. Null and empty texts
    give an empty array; repeated rows are scanned each; a column named
    secrets is replaced; an empty table gives an empty one.
    """
    words = df.sparkSession.sparkContext.broadcast(Words(corpus_words(df, text_col)))

    def make():
        def run(texts):
            rows = []
            for text in texts:
                base, added = find_secrets(text, words.value)
                spans = sorted([(*x, None) for x in base] + added, key=lambda x: x[:3])
                rows.append([{"start": s, "end": e, "kind": KINDS[k], "guess_cost": c} for s, k, e, c in spans])
            return {"secrets": rows}

        return run

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("guess_cost", T.DoubleType())])
    return map_texts(df, text_col, make, [T.StructField("secrets", T.ArrayType(span))], keep)
