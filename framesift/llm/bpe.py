"""Operator 1: byte-pair encoding and decoding in batched numpy merge rounds.

A batch's distinct new words lie in one flat array of symbols. Each round
finds every adjacent pair's rank by binary search over the sorted pair keys,
takes the lowest rank of each word and merges its places from left to right;
words without a known pair leave. Spark deals the documents; a worker keeps
the words it has met in a bounded table.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: What the tokenizer files call white space; Python's own split also takes \x1c-\x1f.
SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
ODD_SPACE = regex.compile("[\\x1c-\\x1f]")
NO_RANK = np.iinfo(np.int32).max
#: Bytes of words and ids that an encoder remembers.
KEPT_BYTES = 16 << 20
#: Bytes of texts that are cut into stretches at once: a stretch takes some ten times its bytes.
TEXT_BYTES = 1 << 19


def byte_symbols() -> list[str]:
    """The visible character of each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class BpeTables:
    """A vocabulary file of word-end BPE as arrays; about 2 MB for 50,000 ids, whatever the corpus."""

    pattern: str
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    inner: np.ndarray
    last: np.ndarray
    specials: dict[str, int]
    tokens: list[bytes]

    @classmethod
    def load(cls, path: str) -> BpeTables:
        """Read a tokenizers JSON file: NFC, white space dropped, lower case, a splitting pattern and byte-level symbols with a word-end mark."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not suffix or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"not a word-end BPE file that this operator reads: {path}")
        ids, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [ids[a + b] for a, b in merges]
        born = {t: r for r, t in enumerate(made)}
        if len(born) != len(made) or any(born.get(ids[x], -1) >= r for r, m in enumerate(merges) for x in m):
            raise ValueError("merges out of order: a round could not merge all places of a pair at once")
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [b""] * (1 + max(*ids.values(), *specials.values()))
        for t, i in chain(ids.items(), specials.items()):
            tokens[i] = t.encode()
        sym = byte_symbols()
        return cls(
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
            keys[order], order.astype(np.int32), np.array(made, np.int64)[order],
            np.array([ids[c] for c in sym], np.int64), np.array([ids[c + suffix] for c in sym], np.int64),
            specials, tokens,
        )


def merge_rounds(t: BpeTables, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each non-empty word."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    sym, word = t.inner[flat], np.repeat(np.arange(len(words)), lens)
    ends = np.cumsum(lens) - 1
    sym[ends] = t.last[flat[ends]]
    done_sym, done_word = [], []
    while len(sym):
        first = np.empty(len(word), bool)
        first[0], first[1:] = True, word[1:] != word[:-1]
        starts = np.flatnonzero(first)
        rank, at = np.full(len(sym), NO_RANK, np.int32), np.zeros(len(sym), np.int64)
        left = np.flatnonzero(~first[1:])
        keys = sym[left] << 32 | sym[left + 1]
        j = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
        known = t.pair_keys[j] == keys
        rank[left[known]], at[left[known]] = t.pair_ranks[j[known]], j[known]
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(sym)))
        over = least == NO_RANK
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
        take = np.flatnonzero((rank == least) & ~over)
        if len(take):  # of places that overlap, as in aaa, every second one from the left
            run = np.flatnonzero(np.diff(take, prepend=-2) != 1)
            nth = np.arange(len(take)) - np.repeat(run, np.diff(run, append=len(take)))
            take = take[nth % 2 == 0]
        sym[take] = t.pair_ids[at[take]]
        stay = ~over
        stay[take + 1] = False
        sym, word = sym[stay], word[stay]
    if not words:
        return []
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return np.split(sym[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])


class BpeEncoder:
    """Encodes batches of texts and decodes ids; keeps the ids of words it has met, up to a bound."""

    def __init__(self, tables: BpeTables, kept_bytes: int = KEPT_BYTES):
        self.t, self.kept, self.size, self.kept_bytes = tables, {}, 0, kept_bytes
        self.pattern = regex.compile(tables.pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(tables.specials, key=len, reverse=True)))) if tables.specials else None

    def _chunks(self, text: str) -> list[str]:
        """Stretches between white space; special tokens stand alone, as tuples."""
        if self.special and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [*self._chunks(text[at : m.start()]), ("special", m[0])]
                at = m.end()
            return out + self._chunks(text[at:])
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return [c for c in SPACE.split(text) if c] if ODD_SPACE.search(text) else text.split()

    def _learn(self, chunks: list[str]) -> None:
        lower = ["".join(map(str.lower, c)) if "Σ" in c else c.lower() for c in chunks]
        pieces = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(c)] for c in lower]
        distinct = list({p: None for ps in pieces for p in ps})
        ids = dict(zip(distinct, (x.astype("<u4").tobytes() for x in merge_rounds(self.t, distinct))))
        self.kept.update((c, b"".join([ids[p] for p in ps])) for c, ps in zip(chunks, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = [self._chunks(x) for x in texts]
        new = set(chain.from_iterable(texts)).difference(self.kept)
        if new:
            if self.size > self.kept_bytes:
                self.kept, self.size = {}, 0
                new = set(chain.from_iterable(texts))
            self.size += sum(map(len, new)) + 160 * len(new)
            for c in [c for c in new if isinstance(c, tuple)]:
                self.kept[c] = self.t.specials[c[1]].to_bytes(4, "little")
            self._learn([c for c in new if isinstance(c, str)])
        return [b"".join(map(self.kept.__getitem__, x)) for x in texts]

    def decode(self, ids: bytes) -> str:
        """The tokens' text joined by spaces, as the file names no decoder."""
        return b" ".join(map(self.t.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def bpe_round_trip(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ids (binary, little-endian unsigned 32-bit), n_tokens (long) and decoded (string).

    Whole texts, in any partitioning and without a shuffle; the vocabulary
    goes out once as a broadcast of a fixed size. Null and empty texts give no
    ids and an empty decoded text. Repeated rows are encoded each. Input
    columns named ids, n_tokens or decoded are replaced. An empty table gives
    an empty one.
    """
    tables = df.sparkSession.sparkContext.broadcast(BpeTables.load(vocabulary))

    def make():
        coder = BpeEncoder(tables.value)

        def run(texts):
            ids = coder.encode(texts)
            return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [coder.decode(x) for x in ids]}

        return run

    out = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    return map_texts(df, text_col, make, out, keep, TEXT_BYTES)
