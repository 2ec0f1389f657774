"""Operator 2: token ids in compressed binary blocks.

A block is reset, coded and checksummed on its own. Its range coder is driven
by a mix of adaptive models. Order 2 and order 1 name the id that came after
the last two ids, or the last one, before. Order 0 ranks all ids of the block
so far: an id that comes again moves to half its rank, so ranks follow
frequencies, and ranks are coded by classes of doubling width. Two tables, by
the confidence of order 2 and that of order 1, learn how likely each order and
rank class is; their distributions are mixed by how well each has done. Blocks
are coded side by side: numpy steps over all blocks of a group at once, a lane
each, so the state of a lane never depends on another. Spark sorts the
documents, writes the blocks as a Parquet table and reads them back.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ..sources.shared import shared_folder
from .common import cut_batches

#: Ids of a block: it is closed by the first document that reaches so many; longer documents are cut.
BLOCK_IDS = 4096
#: Blocks coded side by side.
LANES = 512
ORDER2, ORDER1, RANKS = 4096, 2048, 4096
#: Cases: order 2 is right, order 1 is, one of the rank classes of order 0, a new id in ID_BITS.
CLASSES, ID_BITS = 12, 16
NEW = 2 + CLASSES
BOUNDS = NEW + 2
#: Bits of frequencies in the coder and, finer, in the tables; what a case keeps of the finer total; rates of learning.
TOTAL_BITS, FINE_BITS, FLOOR, RATE, MIX_RATE = 15, 22, 1 << 12, 5, 5
U = np.uint64
WORD, LOW = U(32), U(0xFFFFFFFF)
BITS = np.array([0, 0, *range(CLASSES), ID_BITS], np.int64)
FIRST = np.array([0, 0, *((1 << b) - 1 for b in range(CLASSES)), 0], np.int64)
RANK_CASE = np.array([2 + (r + 1).bit_length() - 1 for r in range(RANKS)], np.int64)
#: Bounds of a distribution that has all but the floors on one case.
SURE = np.array([[FLOOR * j + (j > case) * ((1 << FINE_BITS) - FLOOR * (BOUNDS - 1)) for j in range(BOUNDS)] for case in range(BOUNDS - 1)], np.int32)
ONES, TOP = U(0x0101010101010101), U(56)
#: Bytes of encoded stretches that an encoder remembers; characters of the texts split together; stretches given to the library at once.
KEPT_BYTES, TEXT_AT_ONCE, AT_ONCE = 24 << 20, 1 << 18, 4096


class Lanes:
    """Models of a group of blocks, a lane each."""

    def __init__(self, lanes: int):
        self.two, self.one = np.zeros(lanes * ORDER2, np.int32), np.zeros(lanes * ORDER1, np.int32)  # id + 1 and, above 16 bits, confidence
        self.zero, self.size = np.zeros(lanes * RANKS, np.uint16), np.zeros(lanes, np.int64)
        even = ((np.arange(BOUNDS, dtype=np.int64) << FINE_BITS) // (BOUNDS - 1)).astype(np.int32)
        self.rows2, self.rows1 = np.tile(even, (lanes * 4, 1)), np.tile(even, (lanes * 4, 1))
        self.trust2, self.trust1 = (np.full(lanes, 1 << FINE_BITS - 2, np.int32) for _ in range(2))
        self.base2, self.base1, self.base0, self.base4, self.base16 = (np.arange(lanes) * k for k in (ORDER2, ORDER1, RANKS, 4, BOUNDS))
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self) -> np.ndarray:
        """Bounds (lanes, BOUNDS) of the cases' mixed frequencies."""
        self.at2 = ((self.p2 + self.p1 * 60493 >> 3) & (ORDER2 - 1)) + self.base2
        self.at1 = (self.p1 & (ORDER1 - 1)) + self.base1
        self.e2, self.e1 = self.two.take(self.at2), self.one.take(self.at1)
        self.c2, self.c1 = (self.e2 & 0xFFFF) - 1, (self.e1 & 0xFFFF) - 1
        self.k2, self.k1 = (self.e2 >> 16) + self.base4, (self.e1 >> 16) + self.base4
        self.r2, self.r1 = self.rows2.take(self.k2, 0), self.rows1.take(self.k1, 0)
        weight = (self.trust2 << 8) // (self.trust2 + self.trust1)
        mixed = self.r2 - self.r1
        mixed *= weight[:, None]
        mixed >>= 8
        mixed += self.r1
        mixed >>= FINE_BITS - TOTAL_BITS
        return mixed

    def learn(self, ids: np.ndarray, case: np.ndarray) -> None:
        """Orders 2 and 1, their tables of cases and their trust from what came; ``rank`` sees to order 0."""
        sure, at = SURE.take(case, 0), self.base16 + case
        for rows, r, k, trust in ((self.rows2, self.r2, self.k2, self.trust2), (self.rows1, self.r1, self.k1, self.trust1)):
            flat = r.reshape(-1)
            trust += (flat.take(at + 1) - flat.take(at) - trust) >> MIX_RATE
            r += (sure - r) >> RATE
            rows[k] = r
        new = (ids + 1).astype(np.int32)
        for table, at, e, guess in ((self.two, self.at2, self.e2, self.c2), (self.one, self.at1, self.e1, self.c1)):
            missed = np.where(e >= 2 << 16, e - (1 << 16), new)  # a proven prediction outlasts one miss
            table[at] = np.where(guess == ids, np.minimum(e + (1 << 16), e | 3 << 16), missed)
        self.p2, self.p1 = self.p1 * 40503, ids

    def rank(self, lane: np.ndarray, rank: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Move names found at these ranks of these lanes to half the rank; gives the names they change places with."""
        at, to = self.base0[lane] + rank, self.base0[lane] + (rank >> 1)
        other = self.zero[to]
        self.zero[to], self.zero[at] = name, other
        return other

    def append(self, lane: np.ndarray, name: np.ndarray) -> None:
        """New names, ranked last."""
        self.zero[self.base0[lane] + self.size[lane]] = name
        self.size[lane] += 1


def compress(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of each block of at most BLOCK_IDS ids (below 65,535)."""
    out: list[bytes] = []
    for at in range(0, len(blocks), LANES):
        out += _compress(blocks[at : at + LANES])
    return out


def _compress(group: list[np.ndarray]) -> list[bytes]:
    lens = np.array([len(b) for b in group])
    lanes, longest = len(group), int(lens.max())
    ids, names = np.zeros((longest, lanes), np.uint16), np.zeros((longest, lanes), np.uint16)
    for k, block in enumerate(group):
        ids[: lens[k], k] = block
        names[: lens[k], k] = np.unique(block, return_inverse=True)[1]
    ends = np.argsort(lens, kind="stable")
    model, place = Lanes(lanes), np.full(lanes * RANKS, -1, np.int16)
    words, used = np.zeros((lanes, longest + 8), np.uint32), np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, U), np.full(lanes, U(0xFFFFFFFFFFFFFFFF))
    out, done = [b""] * lanes, 0
    for t in range(longest + 1):
        while done < lanes and lens[ends[done]] == t:  # lanes that are through go on with ids that nobody reads
            k = ends[done]
            if t:
                out[k] = words[k, : used[k]].astype("<u4").tobytes() + np.array([low[k] >> WORD, low[k] & LOW]).astype("<u4").tobytes()
            done += 1
        if t == longest:
            break
        cum, now, at = model.predict().reshape(-1), ids[t].astype(np.int64), model.base0 + names[t]
        rank = place.take(at).astype(np.int64)
        case = np.where(rank >= 0, RANK_CASE.take(rank, mode="clip"), NEW)
        case[now == model.c1] = 1
        case[now == model.c2] = 0
        value = np.where(case == NEW, now, rank - FIRST.take(case))
        value[case < 2] = 0
        where = model.base16 + case
        bottom, top = cum.take(where), cum.take(where + 1)
        unit = span >> U(TOTAL_BITS)
        new = low + unit * bottom.astype(U)
        span = (unit * (top - bottom).astype(U)) >> BITS.take(case).astype(U)
        new += span * value.astype(U)
        over = np.flatnonzero(new < low)
        place_of = used[over] - 1
        while len(over):  # a carry goes on through words that are full
            words[over, place_of] += np.uint32(1)
            on = words[over, place_of] == 0
            over, place_of = over[on], place_of[on] - 1
        low = new
        due = np.flatnonzero(span < U(1) << WORD)
        words[due, used[due]] = low[due] >> WORD
        used[due] += 1
        low[due] <<= WORD
        span[due] <<= WORD
        model.learn(now, case)
        lane = np.flatnonzero(case >= 2)
        known = case[lane] < NEW
        hit, fresh = lane[known], lane[~known]
        other = model.rank(hit, rank[hit], names[t, hit])
        place[model.base0[hit] + other] = rank[hit]
        place[at[hit]] = rank[hit] >> 1
        place[at[fresh]] = model.size[fresh]
        model.append(fresh, names[t, fresh])
    return out


def decompress(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    out: list[np.ndarray] = []
    for at in range(0, len(coded), LANES):
        out += _decompress(coded[at : at + LANES], lengths[at : at + LANES])
    return out


def _decompress(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    lanes, longest, wide = len(coded), max(lengths), max(map(len, coded)) // 4 + 4
    words = np.zeros((lanes, wide), np.uint32)
    for k, c in enumerate(coded):
        words[k, : len(c) // 4] = np.frombuffer(c, "<u4")
    flat, base = words.reshape(-1), np.arange(lanes) * wide
    model, used = Lanes(lanes), np.full(lanes, 2)
    span, code = np.full(lanes, U(0xFFFFFFFFFFFFFFFF)), words[:, 0].astype(U) << WORD | words[:, 1]
    ids = np.zeros((longest, lanes), np.uint16)
    for t in range(longest):
        cum = model.predict()
        unit = span >> U(TOTAL_BITS)
        got = np.minimum(code // unit, U((1 << TOTAL_BITS) - 1)).astype(np.int32)
        below = ((cum <= got[:, None]).view(U) * ONES) >> TOP  # bytes of 0 and 1, summed by eights
        case = (below[:, 0] + below[:, 1]).astype(np.int64) - 1
        cum, where = cum.reshape(-1), model.base16 + case
        bottom, top = cum.take(where), cum.take(where + 1)
        code = code - unit * bottom.astype(U)
        span = (unit * (top - bottom).astype(U)) >> BITS.take(case).astype(U)
        value = code // span
        code -= span * value
        due = np.flatnonzero(span < U(1) << WORD)
        code[due] = code[due] << WORD | flat.take(base[due] + np.minimum(used[due], wide - 1))
        used[due] += 1
        span[due] <<= WORD
        value = value.astype(np.int64)
        rank = FIRST.take(case) + value
        lane = np.flatnonzero(case >= 2)
        known = case[lane] < NEW
        hit, fresh = lane[known], lane[~known]
        now = np.where(case == 0, model.c2, model.c1).astype(np.int64)
        at = rank[hit] & (RANKS - 1)  # lanes that are through read anything
        now[hit] = model.zero[model.base0[hit] + at]
        now[fresh] = value[fresh] & 0xFFFF
        ids[t] = now
        model.learn(now, case)
        model.rank(hit, at, now[hit])
        fresh = fresh[model.size[fresh] < RANKS]
        model.append(fresh, now[fresh])
    return [ids[: lengths[k], k] for k in range(lanes)]


class LibraryEncoder:
    """Ids by the tokenizers library. Text is cut at lone spaces, where the splitting pattern always cuts too, so each distinct stretch is encoded once; stretches are remembered up to a number of bytes."""

    RARE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
    #: A word of letters, with or without one mark after it, is one or two pieces of the pattern.
    WORD = re.compile(" ([A-Za-z]+)([.,;:!?]?)")

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library, self.known, self.size = Tokenizer.from_str(spec), {}, 0
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model

    def plain(self, text: str) -> bool:
        """Whether no space stands beside white space or at an end."""
        return not ("  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or self.RARE.search(text))

    def look_up(self, new: list[str]):
        """(stretch, its ids as bytes) of each."""
        whole = []
        for c in new:
            if m := self.WORD.fullmatch(c):
                ids = [x.id for x in self.model.tokenize(f"\u0120{m[1]}")]
                if m[2]:
                    ids += [x.id for x in self.model.tokenize(m[2])]
                yield c, array("H", ids).tobytes()
            else:
                whole.append(c)
        for at in range(0, len(whole), AT_ONCE):
            some = whole[at : at + AT_ONCE]
            for c, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                yield c, array("H", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; at most as many stretches as these texts hold beyond the bound."""
        parts = []
        for text in texts:
            first, *rest = text.split(" ") if self.plain(text) else [text]
            parts.append([first, *map(" ".__add__, rest)])
        new = set(chain.from_iterable(parts)).difference(self.known)
        if new:
            size = sum(map(len, new)) + 160 * len(new)
            if self.size + size > KEPT_BYTES:
                self.known, self.size = {}, 0
                new = set(chain.from_iterable(parts))
                size = sum(map(len, new)) + 160 * len(new)
            self.known.update(self.look_up(list(new)))
            self.size += size
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), "<u2") for p in parts]

    def encode_each(self, texts: pa.Array):
        """The ids of each text in turn, some texts at a time so that few stretches are held at once."""
        some, size = [], 0
        for text in texts:
            some.append(text.as_py())
            size += len(some[-1])
            if size > TEXT_AT_ONCE:
                yield from self.encode(some)
                some, size = [], 0
        yield from self.encode(some)


STORE = "part int, block int, n int, crc long, ids array<long>, ords array<int>, pieces array<int>, sizes array<int>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents in ascending order of their ids as a table of blocks.

    A row is a block: its place, ids, checksum, and for each document piece in
    it the document's id, its ordinal in the part, the piece's number (negative
    if more follow) and its ids. Null ids come first, null texts are empty (one
    id, the end); equal ids stand in any order, each with its own row.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def encode(batches):
        from pyspark import TaskContext

        part, block, ordinal = TaskContext.get().partitionId(), 0, 0
        coder = LibraryEncoder(spec.value)
        waiting: list[tuple] = []  # of whole blocks
        ids, meta, size = [], [], 0

        def close():
            nonlocal ids, meta, size
            if meta:
                waiting.append((np.concatenate(ids), meta))
            ids, meta, size = [], [], 0

        def flush():
            nonlocal block
            coded = compress([b[0] for b in waiting])
            cols = list(zip(*((part, block + k, len(b[0]), zlib.crc32(c), *map(list, zip(*b[1])), c) for k, (b, c) in enumerate(zip(waiting, coded)))))
            block += len(waiting)
            waiting.clear()
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "block", "n", "crc", "ids", "ords", "pieces", "sizes", "payload"])

        for batch in cut_batches(batches):
            for doc, got in zip(batch.column(0).to_pylist(), coder.encode_each(batch.column(1))):
                got = np.append(got, np.uint16(end_id))
                cuts = range(0, len(got), BLOCK_IDS)
                for k, c in enumerate(cuts):
                    piece = got[c : c + BLOCK_IDS]
                    if size and size + len(piece) > BLOCK_IDS:
                        close()
                    ids.append(piece)
                    meta.append((doc, ordinal, k if k == len(cuts) - 1 else -k - 1, len(piece)))
                    size += len(piece)
                    if len(waiting) == LANES:
                        yield flush()
                ordinal += 1
        close()
        if waiting:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first()).mapInArrow(encode, STORE).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the blocks, whose checksums are verified; start counts the ids of all documents before."""
    store = spark.read.parquet(path)

    def decode(batches):
        for batch in cut_batches(batches, LANES, 1 << 30):  # a lane's state is larger than its block
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for c, crc in zip(cols["payload"], cols["crc"]):
                if zlib.crc32(c) != crc:
                    raise ValueError("a block's checksum is wrong")
            rows = []
            for k, ids in enumerate(decompress(cols["payload"], cols["n"])):
                at = 0
                for doc, o, piece, size in zip(cols["ids"][k], cols["ords"][k], cols["pieces"][k], cols["sizes"][k]):
                    data = ids[at : at + size].astype("<u4").tobytes()
                    whole = piece == 0
                    rows.append((cols["part"][k], o, doc, piece if piece >= 0 else -piece - 1, size, zlib.crc32(data) if whole else None, None if whole else data))
                    at += size
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "ord", "doc_id", "piece", "n", "crc", "data"])

    pieces = store.mapInArrow(decode, "part int, ord int, doc_id long, piece int, n int, crc long, data binary")
    parts = F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("piece", "data"))))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    docs = pieces.groupBy("part", "ord").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.max("crc").alias("crc"), parts.alias("parts"))
    docs = docs.select("part", "ord", "doc_id", "n_tokens", F.coalesce("crc", F.crc32(joined)).alias("ids_crc32"))
    # starts: ids of earlier documents in the part from the narrow columns, and of earlier parts (a row for each part)
    totals = store.groupBy("part").agg(F.sum("n").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("ord")) - F.col("n_tokens")
    return docs.withColumn("inside", inside).join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def store_path(spark: SparkSession) -> str:
    """A new folder under the shared one that the session names."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
