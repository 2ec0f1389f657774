"""Operator 10: benchmark decontamination, in DataFrame functions only.

Windows of ``size`` consecutive item words (a shorter item: the item) and
short grams of theirs are hash tables, broadcast after their sizes have been
checked. A document is screened at every ``stride``-th word by such grams, so
placed that any window in it holds one of them whole: its grams are rows that
meet the table in a join. Around the places that meet it the document's own
windows are made and looked up by their words. The same steps serve any
benchmark; where a table is too large to broadcast, its join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

SIZE = 13
#: Windows of more characters than this are not broadcast but met in a shuffled join; so are more screen grams, or places, than this (some 16 bytes each).
BROADCAST_CHARS, BROADCAST_GRAMS = 16 << 20, 1 << 20
#: Rejected documents up to this number (a few MB of ids and hashes) go out as a broadcast, so that no text is shuffled.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def once(x: Column) -> Column:
    """The value by way of a generator: filters are not pushed through it, so it is computed once a row and not inside the expressions that use it."""
    return F.explode_outer(F.array(x))


def gram(words: Column, at: Column, size: int) -> Column:
    """The gram of ``size`` words from the 0-based place ``at``, joined by spaces."""
    return F.concat_ws(" ", *(words[at + k] for k in range(size)))  # slice() would copy the whole array for each gram


def places(words: Column, size: int, step: int = 1) -> Column:
    """0-based starts of the grams of ``size`` words, every ``step``-th."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size, F.lit(step))).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, n, item_id as string) for each distinct window; items without words have none."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), once(words_of(F.col(f"`{text_col}`"))).alias("words")).where(F.size("words") > 0)
    whole = items.where(F.size("words") < size).select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("window"))
    cut = items.where(F.size("words") >= size).select("item_id", F.lit(size).alias("n"), F.explode(F.transform(places(F.col("words"), size), lambda i: gram(F.col("words"), i, size))).alias("window"))
    return whole.unionByName(cut).distinct()


def screen_plan(n: int) -> tuple[int, int]:
    """(gram, stride): any window of n words holds whole one of the grams that start at multiples of the stride."""
    g = (n + 1) // 2
    return g, n - g + 1


def gram_hash(words: Column, at: Column, size: int) -> Column:
    """A hash of the gram of ``size`` words from a 0-based place."""
    return F.xxhash64(*(words[at + k] for k in range(size)), F.lit(size))


def item_grams(windows: DataFrame, n: int) -> DataFrame:
    """(n, h): hashes of all screen grams of the windows of n words."""
    g, _ = screen_plan(n)
    words = F.split("window", " ")
    return windows.where(F.col("n") == n).select(F.col("n"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - g)), lambda i: gram_hash(words, i, g))).alias("h")).distinct()


def doc_grams(words: Column, n: int) -> Column:
    """Array of (n, place, h) of a document's screen grams for windows of n words."""
    g, stride = screen_plan(n)
    return F.transform(places(words, g, stride), lambda i: F.struct(F.lit(n).alias("n"), i.alias("place"), gram_hash(words, i, g).alias("h")))


def windows_at(words: Column, met: Column, n: int) -> Column:
    """Array of (start, n, window): the document's windows of n words that hold a gram met at one of the places."""
    g, _ = screen_plan(n)

    def near(p: Column) -> Column:
        low, high = F.greatest(F.lit(0), p["place"] - (n - g)), F.least(p["place"], F.size(words) - n)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.filter(met, lambda p: p["n"] == n), near)))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), gram(words, i, n).alias("window")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, items, spans) for each row of docs.

    items: ids (strings, sorted) of the benchmark items with a window in the
    document; spans: the windows found, as (start, n) in words. Null and empty
    texts have no words; benchmark items without words are never found.
    Repeated rows give a row each; an empty benchmark finds nothing, an empty
    table gives an empty one; other columns, whatever their names, play no
    part. Texts are read twice, the second time only for documents with a gram
    in common; of others nothing but narrow columns is shuffled.
    """
    windows = cut_lineage(item_windows(benchmark, size))
    sizes = [r.n for r in windows.select("n").distinct().orderBy("n").collect()]  # at most ``size`` numbers
    small = (windows.agg(F.sum(F.length("window"))).first()[0] or 0) <= BROADCAST_CHARS
    doc_id, text, key = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.xxhash64(f"`{text_col}`")
    base = docs.select(doc_id.alias("id"), key.alias("key"), once(words_of(text)).alias("words"))
    # a row for each document, and one for each of its grams that the table holds
    whole = F.array(F.struct(F.lit(0).alias("n"), F.lit(-1).alias("place"), F.lit(None).cast("long").alias("h")))
    rows = base.select("id", "key", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(whole, *(doc_grams(F.col("words"), n) for n in sizes))).alias("g")).select("id", "key", "n_words", "g.*")
    if sizes:
        grams = item_grams(windows, sizes[0])
        for n in sizes[1:]:
            grams = grams.union(item_grams(windows, n))
        grams = cut_lineage(grams.withColumn("met", F.lit(True)))
        rows = rows.join(F.broadcast(grams) if grams.count() <= BROADCAST_GRAMS else grams, ["n", "h"], "left").where((F.col("place") < 0) | F.col("met"))
    rows = cut_lineage(rows.select("id", "key", "n_words", "n", "place"))
    met = cut_lineage(rows.where("place >= 0").groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(F.collect_set(F.struct("n", "place")).alias("met")))
    few = (met.agg(F.sum(F.size("met"))).first()[0] or 0) <= BROADCAST_GRAMS
    again = docs.select(doc_id.alias("id"), key.alias("key"), text.alias("text")).join(F.broadcast(met) if few else met, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    made = again.select("id", "key", "met", once(words_of(F.col("text"))).alias("words"))
    found = F.concat(*(windows_at(F.col("words"), F.col("met"), n) for n in sizes)) if sizes else F.array().cast("array<struct<start:int,n:int,window:string>>")
    each = made.select("id", "key", F.explode(found).alias("w")).select("id", "key", "w.*")
    verified = each.join(F.broadcast(windows) if small else windows, ["n", "window"])
    agg = verified.groupBy("id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    hit_words = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.n - 1)))))
    agg = agg.select(F.col("id").alias("i"), F.col("key").alias("k"), "items", "spans", hit_words.cast("long").alias("n_hit"))
    out = rows.where("place < 0").join(agg, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"), F.col("key").alias("text_key"),
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: some word is hit, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rule does not reject, all columns; rows of equal id and text go together."""
    found = contamination(docs, benchmark, size, id_col, text_col).where(contaminated(F.col("n_hit"), F.col("n_words")))
    bad = cut_lineage(found.select(F.col(id_col).alias("__i"), F.col("text_key").alias("__t")).distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col("__i")) & (F.xxhash64(f"`{text_col}`") == F.col("__t")), "left_anti")
