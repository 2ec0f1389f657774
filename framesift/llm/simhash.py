"""Operator 5: near-duplicates by SimHash with pivot distance tables.

Fingerprints that differ in at most ``radius`` of 64 bits agree wholly in
some ``blocks - radius`` of ``blocks`` bit blocks (pigeonhole), so they have
the same Hamming distances to all references inside those blocks. That part
of the distance table is the join key; the references are the rows of a
Hadamard matrix, whose distances fix a block. Inside a bucket, pairs whose
distances to further references differ by more than the radius are discarded
(triangle inequality) and the others verified by their differing bits. A
bucket gives a spanning forest, not all its pairs, and components spread over
all buckets by label rounds with pointer jumping.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut_batches, cut_lineage, lean, map_texts, space_words, with_ids

SEED = 42
WIDE_PIVOTS = 12
#: Differing bits at which fingerprints link, and the blocks by which they are looked up.
RADIUS, BLOCKS = 2, 5


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n <= size:
        shingles = [b" ".join(words)] if n else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


#: Bits of each byte value, little end first: counts of bits add up by byte histograms.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    by = hashes.view(np.uint8).reshape(-1, 8)
    if len(by) < 256:
        return np.unpackbits(by, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(by[:, k], minlength=256) @ BITS for k in range(8)])


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint: bits that over half of n hashes have."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and ``fp``, the 64-bit SimHash as a signed long.

    Whole texts, no shuffle. Null, empty and wordless texts have fingerprint
    zero. A column named fp is replaced; repeated rows are kept.
    """

    def make():
        def run(texts):
            out = np.zeros(len(texts), np.uint64)
            for i, text in enumerate(texts):
                h = shingle_hashes(space_words(text), shingle)
                if len(h):
                    out[i] = majority(bit_counts(h), len(h))
            return {"fp": out.view(np.int64)}

        return run

    return map_texts(df, text_col, make, [T.StructField("fp", T.LongType())], keep)


def block_masks(blocks: int) -> list[int]:
    """64 bits cut into consecutive blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def references(mask: int) -> np.ndarray:
    """Fingerprints whose distances inside the block fix its bits: rows of a Hadamard matrix laid over the block."""
    bits = [i for i in range(64) if mask >> i & 1]
    order = 1 << (len(bits) - 1).bit_length()
    return np.array([sum(1 << b for j, b in enumerate(bits) if (r & j).bit_count() & 1) for r in range(order)], np.uint64)


def wide_references() -> np.ndarray:
    """References over all 64 bits, for the maximum coordinate difference."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(WIDE_PIVOTS)], np.uint64)


def bucket_keys(fp: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """A row for each set of blocks that may agree: a hash of the distances to all references of these blocks."""
    tables = []
    for mask in block_masks(blocks):
        inside = fp & np.uint64(mask)
        mixed = np.zeros(len(fp), np.uint64)
        for ref in references(mask):
            mixed = (mixed ^ np.bitwise_count(inside ^ ref).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        tables.append(mixed)
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mixed = np.full(len(fp), k + 1, np.uint64)
        for b in chosen:
            mixed = (mixed ^ tables[b]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
        keys.append(mixed)
    return np.stack(keys)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_masks(radius: int) -> list[int]:
    """All patterns of one to ``radius`` of 64 bits."""
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(64), r)]


def large_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket's rising distinct fingerprints, by looking up every fingerprint within the radius of each: linear in the bucket."""
    root = np.arange(len(fp))
    for mask in near_masks(radius):
        other = fp ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        found = np.flatnonzero((fp[at] == other) & (other > fp))
        if len(found):
            root = forest(np.concatenate([np.arange(len(fp)), found]), np.concatenate([root, at[found]]), len(fp))
    at = np.flatnonzero(root != np.arange(len(fp)))
    return fp[at], fp[root[at]]


def run_links(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, smallest linked fingerprint index's fingerprint) that connect what is linked inside each run of equal ``run`` values.

    Runs of more fingerprints than there are patterns of ``radius`` bits are
    searched by these patterns, others lag by lag; links are folded into the
    forest as they come.
    """
    out_a, out_b = [], []
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(starts, len(run)))
    large = sizes > 2 * len(near_masks(radius)) if len(run) else sizes > 0
    for at, size in zip(starts[large], sizes[large]):
        a, b = large_links(np.unique(fp[at : at + size]), radius)
        out_a.append(a)
        out_b.append(b)
    small = np.repeat(~large, sizes)
    fp, run = fp[small], run[small]
    n, wide = len(fp), wide_references()
    table = np.stack([np.bitwise_count(fp ^ r).astype(np.int8) for r in wide])
    left, right, held = [np.arange(n)], [np.arange(n)], 0
    live, lag = np.arange(n), 1
    while True:
        live = live[live + lag < n]
        live = live[run[live] == run[live + lag]]
        if not len(live):
            break
        near = live
        for row in table:
            near = near[np.abs(row[near] - row[near + lag]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= radius]
        left.append(near)
        right.append(near + lag)
        held += len(near)
        if held > 4 * n + 100_000:
            root = forest(np.concatenate(left), np.concatenate(right), n)
            left, right, held = [np.arange(n)], [root], 0
        lag += 1
    root = forest(np.concatenate(left), np.concatenate(right), n)
    at = np.flatnonzero(root != np.arange(n))
    return np.concatenate([*out_a, fp[at]]), np.concatenate([*out_b, fp[root[at]]])


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b), both fingerprints, that connect all distinct fingerprints ``fp`` within ``radius`` differing bits, directly or by way of others."""

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = bucket_keys(fp, radius, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(fp, len(keys)).view(np.int64))], names=["key", "fp"])

    def search(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is None:
                part, rest = rest, None
            else:
                part = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
                part = part if rest is None else np.concatenate([rest, part], axis=1)
                cut = np.searchsorted(part[0], part[0, -1]) if part.shape[1] else 0  # the last run may go on
                part, rest = part[:, :cut], part[:, cut:]
            if part is not None and part.shape[1]:
                a, b = run_links(np.ascontiguousarray(part[1]).view(np.uint64), part[0], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keyed = distinct.select("fp").mapInArrow(lean(spread), "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lean(search), "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def task_forest(edges: DataFrame) -> DataFrame:
    """Links (a, b) with the same components and no more links than nodes in each task: paths inside a task become stars."""

    def run(batches):
        parts = [np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for batch in batches]
        if parts and (pairs := np.concatenate(parts, axis=1)).shape[1]:
            names, at = np.unique(pairs, return_inverse=True)
            at = at.reshape(pairs.shape)
            root = forest(at[0], at[1], len(names))
            low = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[root[low]]), pa.array(names[low])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(lean(run), "a long, b long")


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches.

    Links inside a task are made stars first. Each round takes the least label
    around a node and then the label of that label, so paths halve. Labels are
    written to the shared checkpoint folder each round; only the count of
    changes comes to the driver.
    """
    stars = cut_lineage(task_forest(edges))
    both = stars.union(stars.select("b", "a")).toDF("node", "other")
    labels = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    for _ in range(max_rounds):
        told = both.join(labels.toDF("other", "label"), "other").select("node", "label", F.lit(None).cast("long").alias("old"))
        low = told.union(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        up = low.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = cut_lineage(low.join(up, "label").select("node", "old", F.least("label", "above").alias("label")))
        labels, changed = new.select("node", "label"), new.where("label <> old").limit(1).count()
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row: 16 hex digits and the smallest id that links of at most ``radius`` bits reach.

    Exact copies share a fingerprint and stand in for each other, so a group
    of copies of any size costs one entry. Null, empty and wordless texts have
    fingerprint zero and link like any other. A null id never names a
    component unless all its members' ids are null. Repeated rows are kept.
    """
    rows = cut_lineage(fingerprints(df, text_col, shingle, [id_col]).select(F.col(f"`{id_col}`").alias("id"), "fp"))
    firsts = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")))
    labels = component_labels(links(firsts, radius))
    named = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.join(roots, "root").select("fp", "component_id")
    return rows.join(member, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows of a run whose distances to all its rows are tabled.
PIVOTS = 4
#: Bins of a large set's keys (the two least hashes of each), and bits of a set's map.
BINS, MAP_BITS = 16, 256
#: Sets of fewer hashes have a parity map and their least hashes as keys, others a SimHash of MAP_BITS; pairs at J = similarity lie this many deviations within the SimHash bound.
SMALL_SET, SLACK = 64, 4.5
#: Runs of one key up to this size are compared whole, larger ones by neighbours in turning orders; runs beyond the second size are cut by the leading bits of the order.
WHOLE_RUN, SORTED_RUN = 64, 1024
#: Orders whose leading bits cut keys of large runs, by the key.
CUTS = 8
#: Orders of a turn; share of the first turn's links that is few.
ORDERS, FEW_NEW = 8, 0.01


def shingle_set(text: str, size: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, rising."""
    return np.unique(shingle_hashes(space_words(text), size))


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of a set of hashes; equal sets share it."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)


def prefix_length(n: int, similarity: float) -> int:
    """Least hashes of a set of n that hold one in common with any set this similar: only so many can be missing there."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def parity_map(hashes: np.ndarray) -> bytes:
    """Bits that an odd number of hashes fall on: two maps differ in no more bits than the sets in members."""
    odd = np.bincount((hashes >> np.uint64(8)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of MAP_BITS bits: majorities over the hashes and over three mixings of them."""
    out = []
    for k in range(MAP_BITS // 64):
        mixed = hashes
        if k:
            mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(32)
        out.append(majority(bit_counts(mixed), len(hashes)).to_bytes(8, "little"))
    return b"".join(out)


def set_map(hashes: np.ndarray) -> bytes:
    return parity_map(hashes) if len(hashes) < SMALL_SET else wide_fingerprint(hashes)


def set_simhash(hashes: np.ndarray, made: bytes) -> np.uint64:
    """The 64-bit SimHash of a set, with which the wide fingerprint of a large one begins."""
    return np.frombuffer(made[:8], np.uint64)[0] if len(hashes) >= SMALL_SET else np.uint64(majority(bit_counts(hashes), len(hashes)))


def far(similarity: float) -> float:
    """SimHash bits beyond which sets are not this similar: the expected number of differing bits at that similarity (the angle of equally large sets, the widest) and SLACK deviations."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return MAP_BITS * share + SLACK * (MAP_BITS * share * (1 - share)) ** 0.5


def set_keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set by its least hashes. Small sets, and those that may be similar to one, have their least hashes: similar sets share one. Large sets have a mixing of the two least hashes of each of BINS: sets at similarity 0.8 share each with a chance of 0.64."""
    n = len(hashes)
    least = hashes[: prefix_length(n, similarity)] if n * similarity < SMALL_SET else hashes[:0]
    if n < SMALL_SET:
        return least
    bins = (hashes & np.uint64(BINS - 1)).astype(np.int64)
    order = np.argsort(bins, kind="stable")  # hashes rise inside each bin
    at = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1]))
    at = at[at + 1 < n]
    at = at[bins[order[at]] == bins[order[at + 1]]]
    return np.concatenate([least, (hashes[order[at]] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[order[at + 1]]])


def pivot_table(key: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Distances of each row's map to those of PIVOTS rows of its key, evenly spaced; rows come by key."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(starts, len(key)))
    at = [np.repeat(starts + size * k // PIVOTS, size) for k in range(PIVOTS)]
    return np.stack([np.bitwise_count(maps ^ maps[x]).sum(1, dtype=np.int16) for x in at])


def widest(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in which maps of sets of a and b members, a <= b, may differ at this similarity: what small sets do not share bounds it; large sets differ by a SimHash; a small and a large one by any number."""
    return np.where(b < SMALL_SET, (1 - similarity) / (1 + similarity) * (a + b) + 1e-6, np.where(a < SMALL_SET, MAP_BITS, far(similarity)))


def alike(i: np.ndarray, j: np.ndarray, n: np.ndarray, maps: np.ndarray, pivots: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows may be this similar, by their sizes and maps. Pairs whose distances to a pivot differ by more than their maps may are discarded (triangle inequality), the others' differing bits counted."""
    a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    most = widest(a, b, similarity)
    near = a >= similarity * b - 1e-9
    for row in pivots:
        near &= np.abs(row[i] - row[j]) <= most
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count(maps[i[at]] ^ maps[j[at]]).sum(1, dtype=np.int64) <= most[at]
    return near


def turned(maps: np.ndarray, turn: int) -> np.ndarray:
    """The maps' words in another order, bits rotated: each turn sorts by other bits first."""
    words = np.roll(maps, turn, axis=1)
    by = np.uint64(turn * 23 % 64)
    return (words << by | words >> (np.uint64(64) - by)) if by else words


def run_pairs(key: np.ndarray, part: np.ndarray, n: np.ndarray, maps: np.ndarray, similarity: float, turn: int):
    """Row pairs (i, j) of one key and different parts that may be this similar; rows come by key. Runs of up to WHOLE_RUN are compared whole in turn 0; of larger ones each row has at most one pair, the nearest of those that stand close to it in the turn's orders."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(starts, len(key)))
    of = np.repeat(size, size)
    pivots = pivot_table(key, maps)
    if turn == 0:
        live, lag = np.flatnonzero((of > 1) & (of <= WHOLE_RUN)), 1
        while True:
            live = live[live + lag < len(key)]
            live = live[key[live] == key[live + lag]]
            if not len(live):
                break
            i = live[part[live] != part[live + lag]]
            i = i[alike(i, i + lag, n, maps, pivots, similarity)]
            yield i, i + lag
            lag += 1
    large = np.flatnonzero(of > WHOLE_RUN)
    nearest, bits = np.full(len(key), -1, np.int64), np.full(len(key), 1 << 20, np.int64)
    for step in range(ORDERS if len(large) else 0):
        words = turned(maps[large], ORDERS * turn + step)
        order = large[np.lexsort((words[:, 1], words[:, 0], key[large]))]
        for lag in (1, 2):
            i, j = order[:-lag], order[lag:]
            ok = (key[i] == key[j]) & (part[i] != part[j])
            i, j = i[ok], j[ok]
            ok = alike(i, j, n, maps, pivots, similarity)
            i, j = i[ok], j[ok]
            differ = np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64)
            for x, y in ((i, j), (j, i)):
                less = differ < bits[x]
                nearest[x[less]], bits[x[less]] = y[less], differ[less]
    i = np.flatnonzero(nearest >= 0)
    yield i, nearest[i]


def whole_runs(batches):
    """Tables of whole runs of equal first columns, from sorted batches."""
    rest = None
    for batch in _with_end(batches):
        if batch is None:
            part, rest = rest, None
        else:
            part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = part.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on
            part, rest = part.slice(0, cut), part.slice(cut)
        if part is not None and part.num_rows:
            yield part


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, pa, pb) whose sets (node, hashes) have this Jaccard similarity at least, counted on the whole sets."""

    def count(batches):
        for batch in cut_batches(batches, 256):
            keep = []
            for left, right in zip(batch.column(4), batch.column(5)):
                left, right = left.values.to_numpy(), right.values.to_numpy()
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both >= similarity * (len(left) + len(right) - both) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(4)], names=["a", "b", "pa", "pb"])

    dealt = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "pa", "pb", "x", "y")
    return dealt.mapInArrow(lean(count), "a long, b long, pa long, pb long")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, class_id): the smallest id of each row's near-duplicate class, by sets of shingles of ``shingle`` words.

    Texts link when the Jaccard similarity of their whole sets, counted, is
    ``similarity`` or more; classes are what links connect. Candidates share a
    key: the distances of their SimHash to all references inside some blocks
    (``bucket_keys``, all within RADIUS bits do), or least hashes, as similar
    sets' SimHashes may lie further apart (``set_keys``: all similar small sets
    do, similar large sets but one pair in ten million). Inside a key, pairs are
    discarded by their distances to the run's pivots, then by the bound of their
    maps (SimHash fingerprints of large sets, SLACK deviations beyond what the
    similarity lets expect); the others' sets are compared.
    Runs of a key of more than WHOLE_RUN sets are not compared pair by pair but
    by neighbours in orders of the maps' bits, which turn until few links are
    new (FEW_NEW of the first turn's), so a large group costs links, not pairs; two similar sets in such a run
    stay apart only if neither they nor a chain of similar sets between them
    ever stand close. Texts of equal sets, wordless ones too, cost one entry.
    Rows without an id have no class and are left out; repeated rows are kept;
    an empty table gives an empty one; other columns play no part.
    """
    longs = T.ArrayType(T.LongType())

    def make():
        def run(texts):
            out = {k: [] for k in ("node", "n", "map", "keys")}
            least, fp = [], []
            for h in (shingle_set(t, shingle) for t in texts):
                out["node"].append(np.uint64(set_id(h)).astype(np.int64))
                out["n"].append(len(h))
                out["map"].append(set_map(h))
                least.append(set_keys(h, similarity))
                fp.append(set_simhash(h, out["map"][-1]))
            near = bucket_keys(np.array(fp, np.uint64), RADIUS, BLOCKS).T
            out["keys"] = [np.concatenate([x, y[: len(y) * bool(n)]]).view(np.int64) for x, y, n in zip(least, near, out["n"])]
            return out

        return run

    def hashes_of():
        def run(texts):
            sets = [shingle_set(t, shingle) for t in texts]
            return {"node": [np.uint64(set_id(h)).astype(np.int64) for h in sets], "hashes": [h.view(np.int64) for h in sets]}

        return run

    def cut(turn):
        """Keys of runs beyond SORTED_RUN with the leading bits of the turn's order."""

        def run(batches):
            for batch in batches:
                key, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                maps = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(len(key), -1)
                bits = np.ceil(np.log2(np.maximum(1, m / SORTED_RUN))).astype(np.uint64)
                lead = np.zeros(len(key), np.uint64)
                for k in range(CUTS):  # keys are cut by different bits, so sets that one cut parts meet in another
                    at = np.flatnonzero((bits > 0) & (key % CUTS == k))
                    lead[at] = turned(maps[at], CUTS * turn + k)[:, 0] >> (np.uint64(64) - bits[at]) | np.uint64(1) << bits[at]
                key = (key.view(np.uint64) ^ lead * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns[2:]], names=["key", "node", "part", "n", "map"])

        return run

    def search(turn):
        def run(batches):
            for table in whole_runs(batches):
                key, node, part, n = (table.column(k).to_numpy() for k in range(4))
                maps = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64).reshape(len(key), -1)
                found = [np.stack([node[i], node[j], part[i], part[j]]) for i, j in run_pairs(key, part, n.astype(np.int64), maps, similarity, turn)]
                pairs = np.concatenate(found, axis=1)
                turn_round = pairs[0] > pairs[1]
                pairs[:, turn_round] = pairs[[1, 0, 3, 2]][:, turn_round]
                pairs = np.unique(pairs, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b", "pa", "pb"])

        return run

    fields = [T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("map", T.BinaryType()), T.StructField("keys", longs)]
    docs = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = cut_lineage(map_texts(docs, "text", make, fields, ["id"]))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("map").alias("map"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    live = cut_lineage(keyed.join(shared, "key").select("key", "m", "node"))
    # the sets of all texts that share a key with another
    met = live.select("node").distinct()
    ids = nodes.join(met, "node").select(F.col("first").alias("id"))
    sets = cut_lineage(map_texts(with_ids(docs, "id", ids), "text", hashes_of, [T.StructField("node", T.LongType()), T.StructField("hashes", longs)], []).join(met, "node", "left_semi").dropDuplicates(["node"]))
    parts, turn, large = live.select("node").distinct().withColumn("part", F.col("node")), 0, F.col("m") > WHOLE_RUN
    again = live.where(large).limit(1).count() > 0
    known = nodes.select("node", "n", "map")
    while True:
        entries = (live.where(large) if turn else live).join(known.join(parts, "node"), "node").select("key", "m", "node", "part", "n", "map")
        dealt = entries.mapInArrow(lean(cut(turn)), "key long, node long, part long, n int, map binary").repartition("key").sortWithinPartitions("key")
        pairs = cut_lineage(dealt.mapInArrow(lean(search(turn)), "a long, b long, pa long, pb long").distinct())
        near = cut_lineage(similar(pairs, sets, similarity).select("pa", "pb").distinct())
        n = near.count()
        first = n if turn == 0 else first
        if not n:
            break
        joined = component_labels(near.toDF("a", "b")).toDF("part", "label")
        parts = cut_lineage(parts.join(joined, "part", "left").select("node", F.coalesce("label", "part").alias("part")))
        if not again or turn and n <= FEW_NEW * first:
            break
        turn += 1
    named = nodes.select("node", "first").join(parts, "node", "left").withColumn("root", F.coalesce("part", "node"))
    classes = named.groupBy("root").agg(F.min("first").alias("class_id"))
    return rows.select("id", "node").join(named.join(classes, "root").select("node", "class_id"), "node").select(F.col("id").alias(id_col), "class_id")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows whose id names their near-duplicate class, all columns; rows without an id stay.

    Repeated rows of such an id all stay; an empty table gives an empty one;
    columns of any names (class_id, too) are kept as they are.
    """
    classes = near_duplicate_classes(df, id_col, text_col, shingle, similarity)
    gone = classes.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("id"))
    return with_ids(df, id_col, gone, among=False)
