"""Operator 13: fill-in-the-middle by a parallel scan of an automaton.

Units are runs of ASCII letters and single other characters. An automaton of
four states tells where units begin and whether the text holds one of the
three marks. Nothing need be known of what stands before a piece of text: each
piece gives its state-transition function, and the units and marks it would
count from each state it may be entered in. Composition of functions is
associative, so lanes of 256 characters are scanned side by side and composed
to chunks, and chunks of a giant document, scanned in any tasks, to nodes of a
tree in Spark. The n-th unit is then found from the root down: at each level
the child in which the count passes it, its entry state and what is left to
count; in the last chunk the lane, and in the lane the character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_batches, cut_lineage

#: Characters of a lane, lanes of a chunk, children of a node of the tree.
LANE, CHUNK_LANES, FAN = 256, 256, 64
CHUNK = LANE * CHUNK_LANES
MARKS = ("<P>", "<S>", "<M>")
OTHER, LETTER, OPEN, NAME, CLOSE, PAD = range(6)
#: States: outside letters, in a run of them, after <, after < and a mark's letter.
APART, INSIDE, OPENED, NAMED = range(4)
CLASS = np.array([LETTER if chr(c).isalpha() else OTHER for c in range(128)] + [OTHER], np.uint8)
CLASS[ord("<")], CLASS[ord(">")] = OPEN, CLOSE
for _mark in MARKS:
    CLASS[ord(_mark[1])] = NAME
#: The state after each class of character, by the state before; whether a unit begins; whether a mark ends.
AFTER = np.array([[APART] * 4, [INSIDE] * 4, [OPENED] * 4, [INSIDE, INSIDE, NAMED, INSIDE], [APART] * 4, [APART, INSIDE, OPENED, NAMED]], np.int64)
BEGINS = np.array([[1] * 4, [1, 0, 1, 0], [1] * 4, [1, 0, 1, 0], [1] * 4, [0] * 4], np.int64)
ENDS = np.array([[0] * 4] * 4 + [[0, 0, 0, 1], [0] * 4], np.int64)
START = np.arange(4)
IDENTITY = 0b11100100


def images() -> np.ndarray:
    """The four images of each packed function: two bits a state."""
    return np.arange(256)[:, None] >> 2 * START & 3


def packed_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each class and packed function of what stands before: the function after it, and units and marks for each state at the start, in fields of 16 bits."""
    state = images()
    fields = np.uint64(1) << (16 * START).astype(np.uint64)
    after = (AFTER[:, state] << 2 * START).sum(-1).astype(np.uint8)
    return after.ravel(), (BEGINS[:, state].astype(np.uint64) * fields).sum(-1).ravel(), (ENDS[:, state].astype(np.uint64) * fields).sum(-1).ravel()


NEXT, UNITS, SEEN = packed_tables()


class Scan:
    """Lanes of texts: for each its text, function (images of the four states), and units and marks from each state."""

    def __init__(self, texts: list[str]):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.lanes = -(-lens // LANE)
        self.first = np.cumsum(self.lanes) - self.lanes
        n = int(self.lanes.sum())
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.cls = np.full(n * LANE, PAD, np.uint8)
        at = np.repeat(self.first * LANE - (np.cumsum(lens) - lens), lens) + np.arange(len(codes))
        self.cls[at] = CLASS.take(codes, mode="clip")
        steps = np.ascontiguousarray(self.cls.reshape(n, LANE).T).astype(np.int32) << 8
        f, units, marks = np.full(n, IDENTITY, np.uint8), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for step in steps:
            at = step | f
            units += UNITS[at]
            marks += SEEN[at]
            f = NEXT[at]
        fields = lambda x: (x[:, None] >> (16 * START).astype(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
        self.to, self.units, self.marks = images()[f], fields(units), fields(marks)

    def composed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text and state at its start: the state at its end, units and marks."""
        rows = np.arange(len(self.lanes))
        state, units, marks = np.tile(START, (len(rows), 1)), np.zeros((len(rows), 4), np.int64), np.zeros((len(rows), 4), np.int64)
        for j in range(int(self.lanes.max(initial=0))):
            on = rows[self.lanes > j]
            lane, s = (self.first[on] + j)[:, None], state[on]
            units[on] += self.units[lane, s]
            marks[on] += self.marks[lane, s]
            state[on] = self.to[lane, s]
        return state, units, marks

    def find(self, text: np.ndarray, state: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
        """Characters before the unit of this ordinal (from 0), which the text holds, of texts that are entered in these states."""
        lane, left, s = self.first[text].copy(), ordinal.copy(), state.copy()
        passed = np.ones(len(text), bool)
        while passed.any():  # lanes up to the one that holds it
            passed = left >= self.units[lane, s]
            left -= np.where(passed, self.units[lane, s], 0)
            s = np.where(passed, self.to[lane, s], s)
            lane += passed
        out, cls = np.full(len(text), -1), self.cls.reshape(-1, LANE)
        for t in range(LANE):
            c = cls[lane, t]
            begins = BEGINS[c, s]
            out[(left == 0) & (begins == 1) & (out < 0)] = t
            left -= begins
            s = AFTER[c, s]
        return (lane - self.first[text]) * LANE + out


NODE = "digest string, k long, to array<int>, units array<long>, marks array<long>"


def chunk_nodes(giants: DataFrame, chunk: int) -> DataFrame:
    """The functions and counts of all chunks of texts (digest, text)."""

    def run(batches):
        for batch in cut_batches(batches, 1):
            digest, text = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            for at in range(0, len(text), chunk * 16):
                parts = [text[k : k + chunk] for k in range(at, min(len(text), at + chunk * 16), chunk)]
                to, units, marks = Scan(parts).composed()
                rows = [pa.array([digest] * len(parts)), pa.array(range(at // chunk, at // chunk + len(parts)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(to.tolist(), pa.list_(pa.int32())), pa.array(units.tolist(), pa.list_(pa.int64())), pa.array(marks.tolist(), pa.list_(pa.int64()))], names=["digest", "k", "to", "units", "marks"])

    return giants.mapInArrow(run, NODE)


def composed(kids: Column) -> Column:
    """The node (to, units, marks) of its children in order: one after another, from each state."""
    start = F.struct(F.array(*map(F.lit, range(4))).alias("to"), *(F.array(*[F.lit(0).cast("long")] * 4).alias(c) for c in ("units", "marks")))
    each = lambda make: F.array(*map(make, range(4)))

    def then(acc: Column, x: Column) -> Column:
        at = lambda s: acc["to"][s]
        return F.struct(each(lambda s: x["to"][at(s)]).alias("to"), *(each(lambda s, c=c: acc[c][s] + x[c][at(s)]).alias(c) for c in ("units", "marks")))

    return F.aggregate(kids, start, then)


def descended(kids: Column, state: Column, ordinal: Column) -> Column:
    """(k, state, ordinal): the child that holds the unit of this ordinal, its entry state and the ordinal in it."""
    start = F.struct(F.lit(-1).cast("long").alias("k"), state.alias("state"), ordinal.alias("ordinal"))

    def then(acc: Column, x: Column) -> Column:
        inside = acc["ordinal"] < x["units"][acc["state"]]
        passed = F.struct(acc["k"].alias("k"), x["to"][acc["state"]].alias("state"), (acc["ordinal"] - x["units"][acc["state"]]).alias("ordinal"))
        return F.when(acc["k"] >= 0, acc).when(inside, F.struct(x["k"].alias("k"), acc["state"].alias("state"), acc["ordinal"].alias("ordinal"))).otherwise(passed)

    return F.aggregate(kids, start, then)


def giant_cuts(giants: DataFrame, chunk: int) -> DataFrame | None:
    """(key, digest, found): the units n, whether marks occur, and chunk, entry state and ordinal of both cuts of giant documents (key, h, digest, text); a null chunk is the text's end. None if there are none.

    Each document's rows are a tree of FAN children a node, so no task holds
    more than FAN of them, and copies of a text share one tree.
    """
    nodes = cut_lineage(chunk_nodes(giants.select("digest", "text"), chunk).dropDuplicates(["digest", "k"]))
    top = nodes.agg(F.max("k")).first()[0]
    if top is None:
        return None
    levels = []
    while True:
        kids = nodes.groupBy("digest", F.floor(F.col("k") / FAN).alias("node")).agg(F.array_sort(F.collect_list(F.struct("k", "to", "units", "marks"))).alias("kids"))
        levels.append(kids := cut_lineage(kids))
        nodes = kids.select("digest", F.col("node").alias("k"), composed(F.col("kids")).alias("x")).select("digest", "k", "x.*")
        top //= FAN
        if top == 0:
            break
    roots = nodes.select("digest", F.col("units")[0].alias("n"), (F.col("marks")[0] > 0).alias("marked"))
    asked = giants.select("key", "h", "digest").dropDuplicates(["key", "digest"]).join(roots, "digest")
    ends = F.array_sort(F.array(*(F.col("h")[k] % (F.col("n") + 1) for k in (0, 1))))
    at = asked.select("key", "digest", "n", "marked", F.posexplode(ends).alias("cut", "ordinal")).withColumns({"k": F.lit(0).cast("long"), "state": F.lit(0)})
    over = F.col("ordinal") >= F.col("n")
    for kids in levels[::-1]:
        down = F.when(over, F.struct("k", "state", "ordinal")).otherwise(descended(F.col("kids"), F.col("state"), F.col("ordinal")))
        at = at.join(kids.withColumnRenamed("node", "k"), ["digest", "k"], "left").withColumn("x", down)
        at = at.select("key", "digest", "n", "marked", "cut", F.col("x.ordinal").alias("ordinal"), F.when(over, 0).otherwise(F.col("x.k")).cast("long").alias("k"), F.col("x.state").alias("state"))
    one = F.struct("cut", F.when(~over, F.col("k")).alias("k"), "state", "ordinal")
    return at.groupBy("key", "digest").agg(F.struct(F.first("n").alias("n"), F.first("marked").alias("marked"), F.array_sort(F.collect_list(one)).alias("cuts")).alias("found"))


FOUND = "struct<n:bigint,marked:boolean,cuts:array<struct<cut:int,k:bigint,state:int,ordinal:bigint>>>"
NEW_COLUMNS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def cuts_of(texts: list[str], hashes: list[list[int]], found: list[dict | None], chunk: int) -> list[tuple[int, bool, int, int]]:
    """(units, whether marks occur, characters of the prefix, of prefix and middle) of each text; of giant ones only the chunks of their cuts are read."""
    small = [k for k, x in enumerate(found) if x is None]
    scan = Scan([texts[k] for k in small])
    _, units, marks = scan.composed()
    out: list = [None] * len(texts)
    n = units[:, 0]
    h = np.array([hashes[k][:2] for k in small], np.int64).reshape(-1, 2) % (n + 1)[:, None]
    ends = np.sort(h, axis=1)
    at = np.repeat([len(texts[k]) for k in small], 2).reshape(-1, 2)
    inner, side = np.nonzero(ends < n[:, None])
    at[inner, side] = scan.find(inner, np.zeros(len(inner), np.int64), ends[inner, side])
    for j, k in enumerate(small):
        out[k] = int(n[j]), bool(marks[j, 0]), int(at[j, 0]), int(at[j, 1])
    for k, x in enumerate(found):
        if x is not None:
            ends = [len(texts[k]) if c["k"] is None else c["k"] * chunk + int(Scan([texts[k][c["k"] * chunk : (c["k"] + 1) * chunk]]).find(np.array([0]), np.array([c["state"]]), np.array([c["ordinal"]]))[0]) for c in x["cuts"]]
            out[k] = x["n"], x["marked"], *ends
    return out


def fim_transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, seed: int = 1, rate: int = 90, spm_rate: int = 20, chunk: int = CHUNK) -> DataFrame:
    """The columns ``keep`` (default: all) with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Two cuts and the form follow from the hash of ``seed`` and the decimal id:
    of 100 texts ``rate`` are transformed, ``spm_rate`` of 100 of those with
    the suffix first. Empty texts and texts with a mark in them stay plain.
    Null texts are empty; a null id hashes as an empty one; repeated rows have
    equal results; input columns named as new ones are replaced, others kept,
    whatever their names; an empty table gives an empty one. Texts of up to
    ``chunk`` characters are cut where they are read; longer ones by the tree
    of their chunks (``giant_cuts``), to the same results. No text is
    shuffled but giant ones, once.
    """
    new = {f.name for f in NEW_COLUMNS}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = F.array(*(F.conv(F.substring("key", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(None).alias("none"))
    docs = df.select(kept.alias("kept"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), key.alias("key")).withColumn("h", h)
    is_giant = F.char_length("text") > chunk
    giants = docs.where(is_giant).withColumn("digest", F.sha2("text", 256))
    rows = docs.where(~is_giant).select("kept", "text", "h", F.lit(None).cast(FOUND).alias("found"))
    if (cuts := giant_cuts(giants, chunk)) is not None:
        rows = rows.union(giants.join(cuts, ["key", "digest"]).select("kept", "text", "h", F.col("found").cast(FOUND)))
    schema = T.StructType([rows.schema["kept"], *NEW_COLUMNS])
    types = to_arrow_schema(schema)

    def run(batches):
        for batch in cut_batches(batches):
            texts, hashes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made = []
            for text, h, (n, marked, a, b) in zip(texts, hashes, cuts_of(texts, hashes, batch.column(3).to_pylist(), chunk)):
                if not text or marked or h[2] % 100 >= rate:
                    made.append((n, "plain", None, None, text))
                elif h[3] % 100 < spm_rate:
                    made.append((n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"))
                else:
                    made.append((n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"))
            cols = list(zip(*made)) if made else [()] * len(NEW_COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(cols, list(types)[1:]))], names=types.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*([F.col("kept")[c].alias(c) for c in keep]), *(f.name for f in NEW_COLUMNS))


def fim_restore(output: Column, form: Column) -> Column:
    """The text that an output of ``fim_transform`` was made of; no text with a mark in it is ever transformed, so the marks part it without doubt."""
    parts = F.split(output, "<[PSM]>", -1)
    join = lambda *k: F.concat(*(parts[i] for i in k))
    return F.when(form == "psm", join(1, 3, 2)).when(form == "spm", join(2, 3, 1)).otherwise(output)
