"""Operator 12: the trie of conversations' prefixes, by preorder intervals.

A node is a distinct sequence of first turns. Its name is the exclusive or of
hashes of (place, role, text), so names of all prefixes are running folds. The
smallest conversation through a node owns it; the nodes it owns are one chain,
from the depth where it leaves its parent's chain to its end. Chains are ranked
by the list of (depth left, owner) on the way to them, deeper first, which puts
every subtree at consecutive places: preorder. With a node's place and the last
place of its subtree stored, leaves and savings below it are differences of
prefix sums over all places. Every running fold is distributed: rows are dealt
out by ranges, folded in each partition, and carried on by one row a partition,
so neither a long conversation nor a common one is one task's group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut_lineage

#: Bytes of joined ids in a row; first turns that conversations take over, and the ids whose turns they are.
PIECE, SHARED, EVERY = 1 << 16, 4, 20
WORDS = r"[^\x20\x09-\x0D]+"
LONG = "long"


def running(rows: DataFrame, by: list[str], key: str | None, keep: list[str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None) -> DataFrame:
    """Columns ``key``, ``keep`` and, for each name in ``sums`` and ``xors``, the sum or exclusive or of a long column over the rows of an equal key up to this one in the order ``by``, which begins with the key (None: all rows are one).

    Rows are dealt out by ranges of ``by``; a key may spread over any number
    of partitions. What a partition needs from those before it is one row.
    """
    folds = [(name, col, False) for name, col in (sums or {}).items()] + [(name, col, True) for name, col in (xors or {}).items()]
    inputs = list(dict.fromkeys(col for _, col, _ in folds))
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    source = dealt.select(F.col(key) if key else F.lit(0).cast(LONG).alias("all"), *keep, *inputs)
    key = key or "all"
    out = T.StructType([*(source.schema[c] for c in [key, *keep]), *(T.StructField(n, T.LongType()) for n, _, _ in folds), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    names, at = [f.name for f in out], {c: k for k, c in enumerate(source.columns)}

    def run(batches):
        part, nth, last, held = TaskContext.get().partitionId(), 0, None, [0] * len(folds)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes, made = np.diff(np.append(first, n)), []
            for k, (_, col, xor) in enumerate(folds):
                fold, undo = (np.bitwise_xor, np.bitwise_xor) if xor else (np.add, np.subtract)
                total = fold.accumulate(batch.column(at[col]).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.append(0, total[first[1:] - 1])
                if keys[0] == last:
                    before[0] = undo(0, held[k]) if not xor else held[k]
                made.append(undo(total, np.repeat(before, sizes)))
                held[k] = int(made[-1][-1])
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(keep)], *map(pa.array, made), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(nth, nth + n))], names=names)
            nth += n

    local = cut_lineage(source.mapInArrow(run, out))
    # of each partition its first key, its last one and the fold so far of that
    values = [n for n, _, _ in folds]
    ends = local.groupBy("part").agg(F.min(F.struct("nth", key))[key].alias("first"), F.max(F.struct("nth", key, *values)).alias("end"))
    own, order = Window.partitionBy("end." + key).orderBy("part"), Window.orderBy("part")
    carried = [(F.bit_xor if xor else F.sum)(f"end.{n}").over(own).alias(f"carry_{n}") for n, _, xor in folds]
    ends = ends.select("part", "first", F.col(f"end.{key}").alias("last"), *carried)
    ends = ends.select("part", "first", F.lag("last").over(order).alias("before"), *(F.lag(f"carry_{n}").over(order).alias(f"carry_{n}") for n in values))
    ends = ends.where("first = before").select(F.col("part").alias("in_part"), F.col("first").alias("of_key"), *(f"carry_{n}" for n in values))
    joined = local.join(F.broadcast(ends), (F.col("part") == F.col("in_part")) & (F.col(key) == F.col("of_key")), "left")  # at most a row a partition
    total = lambda n, xor: (F.col(n).bitwiseXOR(F.coalesce(f"carry_{n}", F.lit(0))) if xor else F.col(n) + F.coalesce(f"carry_{n}", F.lit(0))).alias(n)
    return joined.select(*([key] if key != "all" else []), *keep, *(total(n, xor) for n, _, xor in folds))


def numbered_turns(df: DataFrame) -> DataFrame:
    """(conv, depth, a, b, words) of conversations (conv_id, turn, role, text): turns from 1 in order of turn, nulls first, then role and text; hashes of role and text, null as empty, and the text's words. Rows without a conv_id are left out; other columns play no part."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast(LONG).alias("conv"), "turn", role.alias("role"), text.alias("text"), F.lit(1).cast(LONG).alias("one"))
    rows = rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64("text", "role", F.lit(12)), "words": F.regexp_count("text", F.lit(WORDS)).cast(LONG), "role_start": F.substring("role", 1, 16), "text_start": F.substring("text", 1, 32)})
    return running(rows, ["conv", "turn", "role_start", "text_start", "role", "text"], "conv", ["a", "b", "words"], {"depth": "one"})


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (conv, n) of conversations that take their first h turns from the one whose id is the next lower multiple of EVERY, h = crc32 of the decimal id modulo SHARED, and their own from the turn after their first h on."""
    convs = turns.groupBy("conv").agg(F.max("depth").alias("own"))
    convs = convs.withColumns({"h": (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).cast(LONG), "base": F.col("conv") - F.col("conv") % EVERY})
    bases = convs.where(F.col("conv") % EVERY == 0).select(F.col("conv").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n"))
    own = turns.join(convs, "conv").where("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "words", "n")
    first = turns.where((F.col("conv") % EVERY == 0) & (F.col("depth") < SHARED)).withColumnRenamed("conv", "base")
    first = first.join(convs, "base").where("depth <= taken").select("conv", "depth", "a", "b", "words", "n")
    return own.union(first), convs.select("conv", "n")


def joined_digests(ends: DataFrame) -> DataFrame:
    """(n, x, y, ends_sha256) of ends (n, x, y, conv): the digest of each end's decimal ids, ascending, joined by commas. Ids are sorted by ranges and joined to pieces; a digest reads its pieces one after another and holds one at a time."""
    keys = ["n", "x", "y"]
    arrow = pa.schema([(c, pa.int64()) for c in (*keys, "first")] + [("piece", pa.binary())])

    def pieces(batches):
        key, ids, first, size = None, [], 0, 0
        made = lambda: pa.RecordBatch.from_pylist([dict(zip(keys, key), first=first, piece=",".join(ids).encode())], schema=arrow)
        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key or size > PIECE:
                    if ids:
                        yield made()
                    key, ids, first, size = now, [], conv, 0
                ids.append(str(conv))
                size += 1 + len(ids[-1])
        if ids:
            yield made()

    def digests(batches):
        key, sha, done = None, None, []
        for batch in batches:
            for n, x, y, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (n, x, y) == key:
                    sha.update(b",")
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (n, x, y), hashlib.sha256()
                sha.update(piece)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*keys, "ends_sha256"])
                done = []
        if key:
            done.append((*key, sha.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*keys, "ends_sha256"])

    order = [*keys, "conv"]
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "n long, x long, y long, first long, piece binary")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "n long, x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves and saved_tokens of its subtree, ends_sha256, position and subtree_end (places in preorder, from 0).

    ``turns`` (conv, depth from 1 without gaps, a, b, words) are hashed turns,
    ``lengths`` (conv, n) has each conversation once, those without turns too:
    they end at the root. No conversations give no nodes. Equal conversations
    are one path with its number of members before any node is grouped.
    """
    x, y = F.xxhash64("depth", "a", "b"), F.xxhash64("b", "depth", "a", F.lit(7))
    named = turns.select("conv", "depth", "words", "n", x.alias("hx"), y.alias("hy"))
    named = running(named, ["conv", "depth"], "conv", ["depth", "words", "n"], xors={"x": "hx", "y": "hy"})
    none = F.lit(0).cast(LONG)
    ends = named.where("depth = n").select("conv", "n", "x", "y").union(lengths.where("n = 0").select("conv", none, none, none))
    paths = ends.groupBy("n", "x", "y").agg(F.min("conv").alias("s"), F.count("*").alias("m"))
    steps = named.select("conv", "depth", "words", "x", "y").join(paths.select(F.col("s").alias("conv"), F.col("m")), "conv")
    steps = cut_lineage(steps.select(F.col("conv").alias("s"), "depth", "words", "x", "y", "m").union(paths.select("s", none, none, none, none, "m")))
    # written, so that adaptive execution can split the join with a very common node
    nodes = cut_lineage(steps.groupBy("depth", "x", "y").agg(F.min("s").alias("owner"), F.sum("m").alias("n_convs"), F.max("words").alias("words")))
    owned = cut_lineage(steps.select("s", "depth", "x", "y").join(nodes.select("depth", "x", "y", "owner"), ["depth", "x", "y"]).select("s", "depth", "owner"))
    # chains: what a path leaves and where; as many entries as it has branches
    turns_off = owned.groupBy("s", "owner").agg(F.min("depth").alias("top"))
    way = turns_off.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("top", "owner"))).alias("way"))
    way = cut_lineage(way.join(paths.select("s", "n"), "s"))
    mine = F.element_at("way", -1)
    chains = way.where(mine["owner"] == F.col("s")).select(F.col("s").alias("owner"), mine["top"].alias("top"), F.col("n").alias("bottom"), F.when(F.size("way") > 1, F.element_at("way", -2)["owner"]).alias("above"), F.transform("way", lambda w: F.struct((-w["top"]).alias("d"), w["owner"].alias("o"))).alias("rank"))
    chains = running(chains.withColumn("size", F.col("bottom") - F.col("top") + 1), ["rank"], None, ["owner", "top", "bottom", "above", "size"], {"over": "size"})
    chains = chains.select("owner", "top", "bottom", "above", (F.col("over") - F.col("size")).alias("start"))
    branches = chains.where("above IS NOT NULL").groupBy(F.col("above").alias("owner"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("branches"))
    placed = nodes.join(chains, "owner").join(branches, ["owner", "depth"], "left")
    children = F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("bottom")).cast(LONG)
    parent = F.when(F.col("depth") > F.col("top"), F.col("owner")).otherwise(F.col("above"))
    placed = placed.select("owner", "depth", parent.alias("parent"), "n_convs", children.alias("n_children"), (F.col("start") + F.col("depth") - F.col("top")).alias("position"), (children == 0).cast(LONG).alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    placed = running(placed, ["position"], None, ["owner", "depth", "parent", "n_convs", "n_children", "position", "leaf", "saving"], {"leaves": "leaf", "savings": "saving"})
    # the last place below a node is where some member ends
    last = way.select("s", mine["owner"].alias("owner"), F.col("n").alias("depth")).join(placed.select("owner", "depth", "position", "leaves", "savings"), ["owner", "depth"]).select("s", "position", "leaves", "savings")
    below = owned.join(last, "s").groupBy("owner", "depth").agg(F.max("position").alias("subtree_end"), F.max("leaves").alias("leaves_end"), F.max("savings").alias("savings_end"))
    ended = joined_digests(ends).join(paths.select("n", "x", "y", "s"), ["n", "x", "y"]).join(way.select("s", mine["owner"].alias("owner")), "s").select("owner", F.col("n").alias("depth"), "ends_sha256")
    out = placed.join(below, ["owner", "depth"]).join(ended, ["owner", "depth"], "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("savings_end") - F.col("savings") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "position", "subtree_end",
    )


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie (see ``prefix_trie``) of conversations (conv_id, turn, role, text) as they stand, without rebuilding. Null roles and texts are empty, rows without a conv_id are left out, rows of equal turns stand in order of role and text, repeated rows are turns each, other columns play no part, an empty table gives no nodes."""
    turns = numbered_turns(df)
    lengths = cut_lineage(turns.groupBy("conv").agg(F.max("depth").alias("n")))
    return prefix_trie(turns.join(lengths, "conv"), lengths)


def rebuilt_trie(df: DataFrame) -> DataFrame:
    """The trie of conversations after ``rebuilt``; rows as in ``conversation_trie``."""
    return prefix_trie(*rebuilt(numbered_turns(df)))
