"""Operator 3: exact top-k inner products over a bit-sliced index.

Blocks of rows hold each quantised attribute as bit slices: bitmaps with a
bit for each row. A query's scores of a whole block come from adding shifted
slices with full-adder bitmap arithmetic; the top rows are chosen from the
most significant sum slice down, and rows that tie at the boundary are
resolved exactly by id. Spark sends blocks of queries to the blocks of rows.
Vectors with components too large for 64-bit sums stand in blocks of their
own, whose rows are bounded by rounded sums and resolved with whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_batches, cut_lineage

BLOCK_ROWS = 8192
BLOCK_QUERIES = 512
#: Quantised components from this magnitude on go the way of large ones, as do vectors of more components than LONGEST: their sums could pass 64 bits.
LARGEST, LONGEST = 1 << 24, 1 << 14
LONG = (1 << 63) - 1
#: Bytes of a score's full value, for order among scores that a long cannot hold.
WIDE = 288


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, large): components floor(scale * x), x as double, as doubles, which hold these whole numbers exactly; without null ids and vectors that are null, empty or hold null or non-finite components."""
    x = F.col(f"`{vector_col}`")
    whole = F.transform(x, lambda c: F.rint(c.cast("double") * scale))  # floor() makes longs
    v = F.zip_with(whole, x, lambda r, c: F.when(r > c.cast("double") * scale, r - 1).otherwise(r))
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) * scale < float("inf"), F.lit(False)) & ~F.isnan(c))
    rows = df.where(x.isNotNull() & F.col(f"`{id_col}`").isNotNull() & (F.size(x) > 0)).where(fine)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    return rows.withColumn("large", F.exists("v", lambda c: F.abs(c) >= LARGEST) | (F.size("v") > LONGEST))


def pack_values(values: np.ndarray) -> bytes:
    """Whole components in the fewest of 1, 2 or 4 bytes each; as doubles if one is large."""
    most = np.abs(values).max()
    if most >= LARGEST:
        return values.astype("<f8").tobytes()
    return values.astype(np.min_scalar_type(-1 - int(most))).tobytes()


def unpack(data: bytes, rows: int, dim: int) -> np.ndarray:
    """The components of so many rows, as 64-bit integers, or as doubles where they were packed so."""
    width = len(data) // (rows * dim)
    kind, to = ("<f8", np.float64) if width == 8 else (f"i{width}", np.int64)
    return np.frombuffer(data, kind).astype(to).reshape(rows, dim)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(part, dim, ids, values): rows of one length, large ones apart, packed as binary; at most ``size`` rows in a block. part is the partition."""

    def pack(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}

        def flush(dim, part):
            ids, vs = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            for i in range(0, len(ids), size):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids[i : i + size].tobytes()]), pa.array([pack_values(vs[i : i + size])])], names=["part", "dim", "ids", "values"])

        for batch in batches:
            ids, lists, large = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            lens, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lens)
            for dim, big in {*zip(lens.tolist(), large.tolist())}:
                rows_ = np.flatnonzero((lens == dim) & (large == big))
                take = (ends[rows_, None] - dim + np.arange(dim)).reshape(-1)
                part = held.setdefault((dim, big), [])
                part.append((ids[rows_].astype(np.int64), flat[take].reshape(-1, dim)))
                if sum(len(p[0]) for p in part) >= size:
                    yield from flush(dim, held.pop((dim, big)))
        for (dim, _), part in held.items():
            yield from flush(dim, part)

    return rows.mapInArrow(pack, "part int, dim int, ids binary, values binary")


def to_bitmap(flags: np.ndarray) -> np.ndarray:
    """A boolean for each row as 64-bit words, padded with zeros."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)]).view(np.uint64)


class BitSlicedBlock:
    """Rows of a block as bit slices, less each attribute's least value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.low = ids, values, values.min(0)
        above = values - self.low
        self.bits = max(1, int(above.max()).bit_length())
        planes = (above[:, :, None] >> np.arange(self.bits)) & 1  # rows, attributes, bits
        self.slices = to_bitmap(planes.transpose(1, 2, 0).astype(bool))
        self.every = to_bitmap(np.ones(len(ids), bool))

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of each row's score, less a constant of the query: magnitudes times slices, complemented where the weight is negative."""
        slices = np.where((query < 0)[:, None, None], ~self.slices, self.slices)
        size, piles = np.abs(query), {}
        for p in range(int(size.max()).bit_length()):
            chosen = slices[(size >> p & 1) == 1]
            for b in range(self.bits if len(chosen) else 0):
                piles.setdefault(p + b, []).append(chosen[:, b])
        out, at = [], 0
        while at <= max(piles, default=-1):
            pile = np.concatenate(piles.pop(at, [np.zeros((0, len(self.every)), np.uint64)]))
            carry = []
            while len(pile) > 2:
                n = len(pile) // 3
                a, b, c = pile[:n], pile[n : 2 * n], pile[2 * n : 3 * n]
                ab = a ^ b
                carry.append((a & b) | (ab & c))
                pile = np.concatenate([ab ^ c, pile[3 * n :]])
            if len(pile) == 2:
                carry.append((pile[:1] & pile[1:]))
                pile = pile[:1] ^ pile[1:]
            out.append(pile[0] if len(pile) else np.zeros_like(self.every))
            if carry:
                piles.setdefault(at + 1, []).extend(carry)
            at += 1
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of the id ``own``, ties to smaller ids."""
        sure, maybe = np.zeros_like(self.every), self.every & ~to_bitmap(self.ids == own)
        for plane in reversed(self.sums(query)):
            both = maybe & plane
            n = int(np.bitwise_count(sure | both).sum())
            if n > k:
                maybe = both
            else:
                sure, maybe = sure | both, maybe & ~plane
                if n == k:
                    maybe = np.zeros_like(maybe)
                    break
        rows = np.flatnonzero(np.unpackbits((sure | maybe).view(np.uint8), bitorder="little")[: len(self.ids)])
        score = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def large_top(ids: np.ndarray, values: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """Ids and whole scores of the k best rows, for components beyond 64-bit sums: rows that rounded sums leave possible are scored with whole numbers."""
    values, query = values.astype(np.float64), query.astype(np.float64)
    rounded, slack = values @ query, (2 * len(query) + 4) * 2.0**-53 * (np.abs(values) @ np.abs(query))
    live = np.flatnonzero(ids != own)
    if len(live) > k and np.isfinite(slack).all():
        least = np.partition(rounded[live] - slack[live], -k)[-k]
        live = live[rounded[live] + slack[live] >= least]
    q = [int(x) for x in query.tolist()]
    scored = [(-sum(int(a) * b for a, b in zip(values[i].tolist(), q)), int(ids[i])) for i in live]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k highest integer inner products, ties to the smaller id.

    A query's own id is no candidate. Vectors that are null, empty or hold
    null or non-finite components take no part, nor do rows with a null id;
    only vectors of the query's length are its candidates. Ranks are exact
    for components of any magnitude that are finite after scaling; a score that a long cannot hold
    is given as the nearest long. Repeated candidate rows rank each; of
    queries of one id the one with the least vector is asked. A query without
    candidates has no row; empty tables give an empty one; other columns,
    whatever their names, play no part.
    """
    cand = cut_lineage(quantised(candidates, id_col, vector_col, scale))
    asked = quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min(F.struct("v", "large")).alias("q")).select("id", "q.v", "q.large")
    quer = cut_lineage(asked)
    parts, q_parts = max(1, math.ceil(cand.count() / BLOCK_ROWS)), max(1, math.ceil(quer.count() / BLOCK_QUERIES))
    # a part of the index is a block of each length; the queries, smaller, are sent to every part
    index = cut_lineage(blocks(cand.repartition(parts), 2 * BLOCK_ROWS))
    told = blocks(quer.repartition(q_parts), BLOCK_QUERIES).select("dim", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    sent = cut_lineage(told).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = index.hint("shuffle_merge").join(sent, ["part", "dim"]).select("dim", "ids", "values", "q_ids", "q_values")

    def search(batches):
        last, block, values = None, None, None
        for batch in cut_batches(batches, 1):
            r = batch.to_pylist()[0]
            if (r["ids"], r["values"]) != last:
                last, ids, values, block = (r["ids"], r["values"]), np.frombuffer(r["ids"], np.int64), unpack(r["values"], len(r["ids"]) // 8, r["dim"]), None
            q_ids, qs = np.frombuffer(r["q_ids"], np.int64), unpack(r["q_values"], len(r["q_ids"]) // 8, r["dim"])
            out_q, out_id, out_score, out_wide = [], [], [], []
            if values.dtype == np.int64 and qs.dtype == np.int64 and r["dim"] <= LONGEST:
                block = block or BitSlicedBlock(ids, values)
                tops = [block.top(q, own, k) for own, q in zip(q_ids, qs)]
                out_q, out_id = np.repeat(q_ids, [len(t[0]) for t in tops]), np.concatenate([t[0] for t in tops])
                out_score = np.concatenate([t[1] for t in tops])
                out_wide = [None] * len(out_q)
            else:
                for own, q in zip(q_ids.tolist(), qs):
                    for i, s in large_top(ids, values, q, own, k):
                        fits = -LONG < s < LONG
                        out_q.append(own)
                        out_id.append(i)
                        out_score.append(max(-LONG, min(LONG, s)))
                        out_wide.append(None if fits else (s + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big"))
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_score, pa.int64()), pa.array(out_wide, pa.binary())], names=["query_id", "id", "score", "wide"])

    found = cut_lineage(pairs.mapInArrow(search, "query_id long, id long, score long, wide binary"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("wide").desc_nulls_last(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
