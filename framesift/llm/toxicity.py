"""Operator 4: toxicity scores of text restored through a noisy channel.

Disguised tokens (leetspeak, spaced-out or repeated letters) become character
lattices: each sign may stand for letters, be a separator or a repetition, at
a channel cost. Viterbi decoding under a character trigram model, counted over
the whole corpus, restores the likeliest spelling. Words then carry weights
learnt from labelled documents; a document's score combines its words.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut_batches, cut_lineage, lean, map_texts

#: Labelled training rows that are fetched for each label; a bound of the fit, not of the corpus.
TRAIN_ROWS = 4000
#: Alphabet of the character model: other characters share its last sign, word ends the first.
LETTERS = " abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß\x00"
SIZE = len(LETTERS)
CODE = {c: i for i, c in enumerate(LETTERS)}
#: What a sign may stand for in disguised spelling.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "¡": "i", "£": "l", "*": "aeiou", "#": "h"}
#: Rows of label 1 that a feature must mark first to stay.
LEAST_NEW = 2
#: A whole word stays in any case if its weight is this share of the largest.
STRONG = 0.8
SEPARATORS = " .-_*~'`,"
LEET_COST, DROP_COST, REPEAT_COST, KEEP_COST = 1.0, 0.7, 0.3, 0.0
#: Letters with space or a separator between them, four or more.
SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_*~][^\W_]){3,}(?!\w)|(?<!\w)[^\W\d_](?:[.\-_*~]+[^\W_]){2,}(?!\w)")
#: A token with a letter and a sign for letters on both its sides or between, or a letter three times in a row.
ODD = re.compile(r"[^\W\d_][0-9@$!+|€¡£*#]+[^\W\d_]|^[0-9@$€£][^\W\d_]{2,}|(\w)\1\1")
WORD = re.compile(r"\S+")
EDGE = ".,;:!?\"'()[]{}<>%&#*$|"


def character_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): trigrams of characters over all rows and whole texts, each with a space before and after it; each task sends the sums of its rows. No trigram lies in two texts, so the counts are the same however rows are dealt out."""

    def count(batches):
        table = np.full(0x110000, SIZE - 1, np.int64)
        for c, i in CODE.items():
            table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = i
        table[[ord(c) for c in "\t\n\r\x0b\x0c\xa0"]] = 0
        total = np.zeros(SIZE**3, np.int64)
        for batch in cut_batches(batches, size=1 << 20):
            texts = [f" {x} " for x in batch.column(0).to_pylist()]
            codes = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            trigrams = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
            inside = np.ones(len(trigrams), bool)
            inside[ends[:-1, None] - [1, 2]] = False
            total += np.bincount(trigrams[inside], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    texts = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInArrow(lean(count), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of a character after two others; the table's size is the alphabet's cube, whatever the corpus."""
    n = np.zeros(SIZE**3)
    for r in counts.collect():
        n[r.code] = r.n
    tri = n.reshape(SIZE, SIZE, SIZE)
    bi = tri.sum(0)
    back = (bi + 0.5) / (bi + 0.5).sum(1, keepdims=True)
    return -np.log((tri + 8 * back[None]) / (tri.sum(2, keepdims=True) + 8))


def readings(token: str, i: int) -> list[tuple[str, float]]:
    """What the sign at a place may stand for, with costs; the empty string drops it."""
    c = token[i]
    out = [(c, KEEP_COST)] if c in CODE and c != " " else []
    out += [(x, LEET_COST) for x in LEET.get(c, "")]
    if c in SEPARATORS or not out:
        out.append(("", DROP_COST))
    if i and c == token[i - 1]:
        out.append(("", REPEAT_COST))
    return out


def decode(token: str, costs: np.ndarray) -> str:
    """The likeliest spelling of a token: Viterbi over its lattice, states being the last two characters; linear in the token's length.

    A state keeps its cost and a chain of (chain before, character), so no
    string is copied; of equal costs the reading met first stays.
    """
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i in range(len(token)):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for c, cost in readings(token, i):
            k = CODE[c] if c else None
            for (a, b), (old, made) in beam.items():
                state, now = ((b, k), old + cost + costs[a, b, k]) if c else ((a, b), old + cost)
                if state not in new or now < new[state][0]:
                    new[state] = now, (made, c) if c else made
        beam = new
    made = min(((cost + costs[a, b, 0], (a, b)) for (a, b), (cost, _) in beam.items()))[1]
    out, chain_ = [], beam[made][1]
    while chain_:
        chain_, c = chain_
        out.append(c)
    return "".join(reversed(out))


class Restorer:
    """Words of a text, disguised ones restored; remembers spellings up to a bound."""

    def __init__(self, costs: np.ndarray, kept: int = 40_000):
        self.costs, self.known, self.kept = costs, {}, kept

    def restore(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) >= self.kept:
                self.known.clear()
            self.known[token] = decode(token, self.costs)
        return self.known[token]

    def words(self, text: str) -> set[str]:
        """Distinct words without signs at their edges, lower-cased; disguised ones in both spellings."""
        low = text.lower()
        raw = set(low.split())
        out = {w.strip(EDGE) for w in raw}
        out.update(self.restore(w.strip(".,;:?\"'()[]{}<>%&")) for w in raw if not w.isalpha() and ODD.search(w))
        out.update(self.restore(w) for w in raw if len(w) > 4 and w.isalpha() and ODD.search(w))
        if SPACED.search(low):
            out.update(self.restore(m[0]) for m in SPACED.finditer(low))
        return out


def features(word: str) -> list[str]:
    """The word, and its beginnings of three to six characters."""
    return [f"={word}", *(f"^{word[:k]}" for k in range(3, min(6, len(word)) + 1))] if word else []


def longest(words: set[str]) -> list[int]:
    """Hashes of the four longest words, by which copies are told."""
    return [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 for w in sorted(words, key=lambda w: (-len(w), w))[:4]]


def uncopied(rows: list[tuple[int, int, list[int]]]) -> dict[int, int]:
    """Ids and labels of the training rows (id, label, longest words) that count: one that shares two of its longest words with an earlier row of its label does not."""
    met: dict[int, set] = {0: set(), 1: set()}
    out = {}
    for i, y, words in sorted(rows):
        if sum(w in met[y] for w in words) < 2:
            met[y].update(words)
            out[i] = y
    return out


def telling(counts: DataFrame, n0: int, n1: int) -> dict[str, float]:
    """Weights of features (f, n0, n1: rows of each label that have it): the lower bound, two standard errors, of the logarithm of the odds; 0.7 and more are kept."""
    k, c = F.col("n1"), F.col("n0")
    low = F.log((k + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1)) - 2 * F.sqrt(1 / (k + 0.5) + 1 / (c + 0.5))
    kept = counts.where((k >= LEAST_NEW) | F.col("f").startswith("=") & (k > 0)).select("f", low.alias("low")).where("low >= 0.7")
    return {r.f: r.low for r in kept.collect()}


def thinned(weights: dict[str, float], marked: list[list[str]]) -> dict[str, float]:
    """The weights that stay: strongest first, the longer among equals, those that mark ``LEAST_NEW`` rows (lists of telling features) that no stronger one marks, and words of nearly the largest weight."""
    cover: dict[str, set[int]] = {f: set() for f in weights}
    for i, found in enumerate(marked):
        for f in found:
            cover[f].add(i)
    done: set[int] = set()
    out = dict(weights)
    for f in sorted(weights, key=lambda f: (-round(weights[f], 1), -len(f), f)):
        if len(cover[f] - done) < LEAST_NEW and not (f[0] == "=" and weights[f] >= STRONG * max(out.values())):
            del out[f]
        done |= cover[f]
    return out


class Scorer:
    """Scores texts: the bias plus the two strongest weights among the words, through the logistic function."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], bias: float, kept: int = 80_000):
        self.restorer, self.weights, self.bias, self.kept = Restorer(costs), weights, bias, kept
        self.words: dict[str, float] = {}

    def weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def score(self, text: str) -> float:
        words = self.restorer.words(text)
        new = words.difference(self.words)
        if new:
            if len(self.words) + len(new) > self.kept:
                self.words.clear()
                new = words
            self.words.update((w, self.weight(w)) for w in new)
        return 1 / (1 + math.exp(-(self.bias + sum(heapq.nlargest(2, map(self.words.__getitem__, words))))))


def held_out(id_col: Column) -> Column:
    """The fold that learning never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict, float]:
    """Character costs from all documents; weights from at most ``train_rows`` labelled rows of each label outside the held-out fold, chosen by a hash of the id; and the bias, from the share of label 1 among all such rows.

    Texts stay in the tasks: what comes to the driver is four hashes of each
    training row, the telling features, and which rows of label 1 have them.
    Of documents of one id the least text counts.
    """
    costs = character_model(character_counts(docs, text_col))
    marked = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__i"), F.col(label_col).cast("int").alias("__y"))
    n = {r["__y"]: r["count"] for r in marked.groupBy("__y").count().collect()}
    bias = math.log(max(rate := n.get(1, 0) / max(1, sum(n.values())), 1e-6) / max(1 - rate, 1e-6))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("__y") == y).orderBy(F.xxhash64("__i"), "__i").limit(train_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("__d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__x"))
    met = texts.join(F.broadcast(chosen.distinct()), F.col("__d") == F.col("__i"))
    train = cut_lineage(met.groupBy("__i").agg(F.max("__y").alias("y"), F.min("__x").alias("x")).select(F.col("__i").alias("i"), "y", "x"))

    def over(read, schema):
        """Rows of ``read(batches of (i, y, words))`` over the training rows."""
        fields = T._parse_datatype_string(schema).fields
        names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

        def run(batches):
            restorer = Restorer(costs)
            for batch in cut_batches(batches):
                ids, ys, xs = (batch.column(k).to_pylist() for k in range(3))
                rows = list(read(zip(ids, ys, map(restorer.words, xs))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        return train.mapInArrow(lean(run), schema)

    told = over(lambda rows: ((i, y, longest(w)) for i, y, w in rows), "i long, y int, w array<long>").collect()
    counted = uncopied([(r.i, r.y, r.w) for r in told])

    def count(rows):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for i, y, words in rows:
            if i in counted:
                seen[y].update(set(chain.from_iterable(map(features, words))))
        return ((f, seen[0][f], seen[1][f]) for f in {*seen[0], *seen[1]})

    counts = over(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n1 = sum(counted.values())
    weights = telling(counts, len(counted) - n1, n1)
    have = over(lambda rows: ((i, list(weights.keys() & chain.from_iterable(map(features, w)))) for i, y, w in rows if y and i in counted), "i long, f array<string>")
    return costs, thinned(weights, [r.f for r in have.orderBy("i").collect()]), bias


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with score (0 to 1) and predicted (1 if score >= 0.5).

    Whole texts, no shuffle of texts. Null and empty texts have the score of
    the bias. Without labels of either kind every score is near that label's
    share. Repeated rows are scored each; columns named score or predicted
    are replaced; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def make():
        scorer = Scorer(*model.value)

        def run(texts):
            scores = [scorer.score(x) for x in texts]
            return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return run

    return map_texts(docs, text_col, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)
