"""Operator 11: exact token counts at every prefix of a text, by dynamic programming.

Of a byte-level BPE text the last token of each prefix is unique: it is the
one token that ends there and stands apart from the last token of the prefix
before it, that is, whose border no merge crosses. So counts and last tokens of
all prefixes follow from those of shorter ones, a piece of the splitting
pattern at a time. Once stored, the counts answer every question of budgets
and truncation without encoding again. Spark deals the documents; a worker
remembers pieces up to a number of bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import map_texts

#: Bytes of pieces and counts, and borders, that a worker remembers; cells of the arrays of words counted together.
KEPT_BYTES, KEPT_BORDERS, CELLS = 96 << 20, 1 << 20, 1 << 21
NEVER = 1 << 30
RARE = "\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE = f"\\n {RARE}"
# Fixed value: the splitting pattern of byte-level vocabularies; what its white space means is spelt out.
PIECE = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WHITE}\\p{{L}}\\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Contractions whose prefix of two characters is two pieces.
CUT_SHORT = ("'re", "'ve", "'ll")


class Lookup:
    """Whole numbers by non-negative keys, in one table of numpy arrays: a key stands at its hash or the next free place after it. Emptied when it holds more than ``most`` keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, most: int = 1 << 22):
        self.most, self.bits, self.n = most, 0, 0
        self.key = self.value = None
        self.add(keys, values)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table does not hold yet."""
        if self.n + len(keys) > self.most:
            self.key, self.n, self.bits = None, 0, 0
        if self.key is None or (self.n + len(keys)) * 3 > 1 << self.bits:
            if self.key is not None:
                held = self.key >= 0
                keys, values = np.concatenate([self.key[held], keys]), np.concatenate([self.value[held], values])
            self.bits = max(10, (len(keys) * 6).bit_length())
            self.key, self.value, self.n = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0
        self.n += len(keys)
        at, last = self._at(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.key[at] < 0
            self.key[at[free]] = keys[free]
            done = self.key[at] == keys
            self.value[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], at[~done] + 1 & last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values; -1 for keys that the table does not hold."""
        at = self._at(keys)
        found = self.key[at]
        out = np.where(found == keys, self.value[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        last = (1 << self.bits) - 1
        while len(left):
            place = at[left] + 1 & last
            at[left] = place
            found = self.key[place]
            hit = found == keys[left]
            out[left[hit]] = self.value[place[hit]]
            left = left[~hit & (found >= 0)]
        return out


def suffix_automaton(ids: dict[bytes, int], size: int) -> tuple[np.ndarray, ...]:
    """Steps (node and byte, node) of the tokens' trie, the node of each node's longest proper suffix, the longest token that ends at a node, and of each token its size and the longest token that it ends with."""
    step: dict[int, int] = {}
    own, length, deeper = [-1], np.zeros(size, np.int32), {}
    for t, i in ids.items():
        node, length[i] = 0, len(t)
        for b in t:
            if (after := step.get(node << 8 | b)) is None:
                after = step[node << 8 | b] = len(own)
                own.append(-1)
                deeper.setdefault(node, []).append((b, after))
            node = after
        own[node] = i
    back, top, shorter = [0] * len(own), own[:], np.full(size, -1, np.int32)
    level = [0]
    while level:
        for node in level:
            for b, after in deeper.get(node, ()):
                if node:
                    at = back[node]
                    while at and at << 8 | b not in step:
                        at = back[at]
                    back[after] = step.get(at << 8 | b, 0)
                if own[after] < 0:
                    top[after] = top[back[after]]
                elif node:
                    shorter[own[after]] = top[back[after]]
        level = [after for node in level for _, after in deeper.get(node, ())]
    return np.array([*step], np.int64), np.array([*step.values()], np.int32), np.array(back, np.int32), np.array(top, np.int32), length, shorter


@dataclass
class ByteTables:
    """A byte-level BPE file as arrays: ranks and halves of merged tokens, pairs' ranks, and an automaton that tells which tokens end at a byte; some 10 MB for 50,000 ids, whatever the corpus."""

    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: Lookup
    steps: tuple[np.ndarray, np.ndarray]
    back: np.ndarray
    top: np.ndarray
    length: np.ndarray
    shorter: np.ndarray
    whole: np.ndarray
    specials: list[str]

    @classmethod
    def load(cls, path: str) -> ByteTables:
        """Read a tokenizers JSON file of plain byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [x for x in spec["added_tokens"] if x["single_word"] or x["lstrip"] or x["rstrip"]]
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or odd or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"not a byte-level BPE file that this operator reads: {path}")
        byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = 1 + max(vocab.values())
        rank, left, right = (np.full(size, -1, np.int32) for _ in range(3))
        keys = []
        for r, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if rank[made] >= 0 or max(rank[x], rank[y]) >= r or any(rank[t] < 0 < len(s) - 1 for t, s in ((x, a), (y, b))):
                raise ValueError("merges out of order, or two of one token: prefixes would have no unique last token")
            rank[made], left[made], right[made] = r, x, y
            keys.append(x << 20 | y)
        ids = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if len(t) == 1 or rank[i] >= 0}  # others are never the outcome of merges
        step, after, *ends = suffix_automaton(ids, size)
        specials = [x["content"] for x in spec["added_tokens"]]
        out = cls(rank, left, right, Lookup(np.array(keys, np.int64), np.arange(len(keys))), (step, after), *ends, left < 0, specials)
        made = np.flatnonzero(left >= 0)
        good = np.zeros(size, bool)
        good[made] = out.apart(left[made], right[made], rank[made])
        for i in made[np.argsort(rank[made])]:  # tokens that their own bytes encode to
            out.whole[i] = good[i] and out.whole[left[i]] and out.whole[right[i]]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge crosses the border of two tokens before the rank ``until``, for many pairs at once.

        The merges that built them are undone from the last on. The tokens at
        the border at each moment would merge if their pair ranks before the
        merge that next took either away; of equal ranks the left one is first.
        """
        out = np.ones(len(a), bool)
        until = np.broadcast_to(np.int32(until), a.shape)
        left, a, b, end_a, end_b = np.arange(len(a)), a, b, until, until
        while len(left):
            r = self.pairs.get(a.astype(np.int64) << 20 | b)
            crossed = (r >= 0) & (r < end_a) & ((r < end_b) | (r == end_b) & (end_b < until[left]))
            out[left[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb
            end_a, a, end_b, b = np.where(first, ra, end_a), np.where(first, self.right[a], a), np.where(first, end_b, rb), np.where(first, b, self.left[b])
            on = ~crossed & (np.maximum(ra, rb) >= 0)
            left, a, b, end_a, end_b = left[on], a[on], b[on], end_a[on], end_b[on]
        return out


class PrefixCounter:
    """Counts of texts; remembers pieces and stretches of text with the counts of their prefixes, up to a bound."""

    def __init__(self, tables: ByteTables):
        self.t, self.known, self.size = tables, {}, 0
        self.edges, self.steps, self.borders = Lookup(*tables.steps), Lookup(*tables.steps), Lookup(np.zeros(0, np.int64), np.zeros(0, np.int32), KEPT_BORDERS)
        self.piece, self.word = regex.compile(PIECE), re.compile(" ?[A-Za-z]+")
        self.white = re.compile(f"[{WHITE}]{{2}}")
        self.run = regex.compile(f"[{WHITE}]{{2,}}(?=[^{WHITE}])")
        self.rare = re.compile(f"[{RARE}]")
        self.around = regex.compile(f"(?:[{WHITE}]{{2,}}|^[{WHITE}]|[{WHITE}]$)(?:[^{WHITE}]+|$)")
        self.special = regex.compile("|".join(map(regex.escape, sorted(tables.specials, key=len, reverse=True)))) if tables.specials else None

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where bytes lead from nodes; steps that the trie lacks are remembered."""
        keys = node.astype(np.int64) << 8 | byte
        out = self.steps.get(keys)
        if len(miss := np.flatnonzero(out < 0)):
            new, each = np.unique(keys[miss], return_inverse=True)
            at, b, after = new >> 8, new & 255, np.full(len(new), -1)
            while len(left := np.flatnonzero((after < 0) & (at > 0))):
                at[left] = self.t.back[at[left]]
                after[left] = self.edges.get(at[left] << 8 | b[left])
            after[after < 0] = 0
            self.steps.add(new, after)
            out[miss] = after[each]
        return out

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether a token stands apart from the one before it (-1: none)."""
        keys = before.astype(np.int64) << 20 | token
        out = np.where(before < 0, self.t.whole[token], -1)
        inner = np.flatnonzero(before >= 0)
        out[inner] = self.borders.get(keys[inner])
        if len(miss := np.flatnonzero(out < 0)):
            new, each = np.unique(keys[miss], return_inverse=True)
            good = self.t.apart(new >> 20, new & 0xFFFFF).astype(np.int32)
            self.borders.add(new, good)
            out[miss] = good[each]
        return out > 0

    def of_bytes(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each prefix of words, from the first byte on, word after word; all move on by a byte at a time, the longest first in the arrays."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lens, kind="stable")
        lens, longest = lens[order], int(lens.max())
        flat = np.frombuffer(b"".join([words[k] for k in order]), np.uint8)
        start = np.cumsum(lens) - lens
        base = np.arange(len(words))
        node, last, count = np.zeros(len(words), np.int32), np.full((longest + 1) * len(words), -1, np.int32), np.zeros((longest + 1) * len(words), np.int32)
        for i in range(1, longest + 1):
            n = int(np.searchsorted(-lens, -i, "right"))
            node = self.step(node[:n], flat[start[:n] + i - 1])
            token, left = self.t.top[node], np.arange(n)
            while len(left):
                at = (i - self.t.length[token]) * len(words) + base[left]
                good = self.fits(last[at], token)
                done = i * len(words) + left[good]
                last[done], count[done] = token[good], count[at[good]] + 1
                left, token = left[~good], self.t.shorter[token[~good]]
        out = np.empty(len(flat), np.int32)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        held = np.concatenate([[0], np.cumsum(lens[place])])
        for i in range(1, longest + 1):
            n = int(np.searchsorted(-lens, -i, "right"))
            out[held[order[:n]] + i - 1] = count[i * len(words) : i * len(words) + n]
        return out

    def of_pieces(self, pieces: list[str]) -> None:
        """Learn the tokens of each prefix of pieces, by characters from the first on."""
        raw = sorted(zip(map(str.encode, pieces), pieces), key=lambda x: len(x[0]))
        at = 0
        while at < len(raw):  # words of like lengths together, in arrays of a bounded size
            end, most = at + 1, 2 * len(raw[at][0]) + 16
            while end < len(raw) and (n := len(raw[end][0])) <= most and (n + 1) * (end + 1 - at) <= CELLS:
                end += 1
            words, names = zip(*raw[at:end])
            counts, flat = self.of_bytes(words), np.frombuffer(b"".join(words), np.uint8)
            if len(flat) > sum(map(len, names)):  # a character ends where the next byte begins one
                counts = counts[np.append((flat & 0xC0 != 0x80)[1:], True)]
            self.keep(names, counts)
            at = end
        for p in CUT_SHORT:
            if p in self.known:
                self.known[p] = np.array([1, 2, *np.frombuffer(self.known[p], np.int32)[2:]], np.int32).tobytes()

    def keep(self, parts: Sequence[str], counts: np.ndarray) -> None:
        """Remember parts by their counts, which stand in a row."""
        raw, at = counts.tobytes(), 0
        for p in parts:
            end = at + 4 * len(p)
            self.known[p] = raw[at:end]
            at = end
        self.size += 160 * len(parts) + 5 * len(counts)

    def learn(self, texts: list[str]) -> None:
        """Learn the tokens of each prefix of stretches without special tokens."""
        findall = self.piece.findall
        single, several = [], []
        for x, m in zip(texts, map(self.word.fullmatch, texts)):
            (single if m else several).append(x)
        cuts = [findall(x) for x in several]
        runs = [(k, m.start(), m.end(), m[0]) for k, x in enumerate(several) if self.white.search(x) for m in self.run.finditer(x)]
        if new := {*single, *chain.from_iterable(cuts), *(r[3] for r in runs)}.difference(self.known):
            self.of_pieces(list(new))
        at = 0
        while at < len(several):  # a bounded number of characters at once
            end = size = 0
            for end in range(at + 1, len(several) + 1):
                size += len(several[end - 1])
                if size > CELLS:
                    break
            parts = list(chain.from_iterable(cuts[at:end]))
            counts = self.joined(list(map(self.known.__getitem__, parts)), parts)
            ends = np.cumsum(np.fromiter(map(len, several[at:end]), np.int64, end - at))
            start = np.append(0, ends[:-1])
            counts -= np.repeat(np.append(0, counts[ends[:-1] - 1]).astype(np.int32), ends - start)
            for k, a, b, run in runs:  # white space up to a prefix's end is one piece, whatever it ends with
                if at <= k < end:
                    first = start[k - at]
                    counts[first + b - 1] = (counts[first + a - 1] if a else 0) + np.frombuffer(self.known[run], np.int32)[-1]
            self.keep(several[at:end], counts)
            at = end

    @staticmethod
    def joined(counts: list[bytes], parts: Sequence[str]) -> np.ndarray:
        """Counts that begin anew with each part, carried on over all."""
        if not parts:
            return np.zeros(0, np.int32)
        counts, lens = np.frombuffer(b"".join(counts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts))
        ends = counts[np.cumsum(lens) - 1]
        return counts + np.repeat(np.cumsum(ends, dtype=np.int32) - ends, lens)

    def stretches(self, text: str) -> list[str]:
        """Stretches that the pattern always parts: at spaces between other characters. A text with white space in a row is cut around it."""
        out, at = [], 0
        if "  " not in text and " \n" not in text and "\n " not in text and "\n\n" not in text and not text[:1].isspace() and not text[-1:].isspace() and self.rare.search(text) is None:
            return self.between(text)
        for m in self.around.finditer(text):  # a run with the word after it
            if m.start() > at:
                out += self.between(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.between(text[at:])

    def between(self, text: str) -> list[str]:
        """Stretches of a part of a text without white space in a row."""
        first, *rest = text.split(" ")
        return [*([first] if first else ()), *map(" ".__add__, rest)] if text else []

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of each prefix of texts without special tokens, of remembered stretches."""
        parts = [self.stretches(x) for x in texts]
        if new := set(chain.from_iterable(parts)).difference(self.known):
            if self.size > KEPT_BYTES:
                self.known, self.size = {}, 0
                new = set(chain.from_iterable(parts))
            self.learn(list(new))
        return [self.joined(list(map(self.known.__getitem__, p)), p) for p in parts]

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of text[:1], text[:2] and so on of each text, special tokens counting one each."""
        found = [list(self.special.finditer(x)) if self.special else [] for x in texts]
        asked, plan = [], []
        for x, marks in zip(texts, found):
            at, own = 0, []
            for m in marks:  # a prefix that ends inside a special token ends in ordinary text
                own.append(len(asked))
                asked += [x[at : m.end() - 1], x[at : m.start()]]
                at = m.end()
            plan.append((own, len(asked)))
            asked.append(x[at:])
        made = self.plain(asked)
        out = []
        for own, rest in plan:
            total, parts = 0, []
            for k in own:
                ends = total + 1 + (int(made[k + 1][-1]) if len(made[k + 1]) else 0)
                parts += [total + made[k], np.array([ends], np.int32)]
                total = ends
            out.append(np.concatenate([*parts, total + made[rest]], dtype=np.int32) if parts else made[rest])
        return out


def prefix_tokens(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with prefix_tokens (array of int): its k-th entry is the exact number of tokens that the first k characters (code points) of the text encode to, special strings as one token each, none added at the ends.

    Whole texts, in any partitioning and without a shuffle; the vocabulary
    goes out once as a broadcast of a fixed size. Null and empty texts give an
    empty array. Repeated rows are counted each. An input column named
    prefix_tokens is replaced; other columns, whatever their names, are kept.
    An empty table gives an empty one. Counts may fall as a prefix grows, as
    more characters may merge into fewer tokens.
    """
    tables = df.sparkSession.sparkContext.broadcast(ByteTables.load(vocabulary))

    def make():
        counter = PrefixCounter(tables.value)
        return lambda texts: {"prefix_tokens": counter.prefixes(texts)}

    return map_texts(df, text_col, make, [T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))], keep)


def token_count(prefixes: Column, chars: Column | None = None) -> Column:
    """Tokens of the first ``chars`` characters (all, if None or beyond the text), as a long."""
    n = F.size(prefixes) if chars is None else F.least(F.size(prefixes), chars)
    return F.coalesce(F.get(prefixes, (n - 1).cast("int")), F.lit(0)).cast("long")


def fitting_prefix(prefixes: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, as a long; 0 if only the empty one is."""
    last = F.transform(prefixes, lambda n, k: F.when(n <= budget, k + 1).otherwise(0))
    return F.coalesce(F.array_max(last), F.lit(0)).cast("long")
