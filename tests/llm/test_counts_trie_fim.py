"""Token counts, the conversation trie and fill-in-the-middle against a library and brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framesift.llm.counts import ByteTables, Lookup, PrefixCounter, fitting_prefix, prefix_tokens, token_count
from framesift.llm.fim import CHUNK, Scan, fim_restore, fim_transform
from framesift.llm.trie import conversation_trie, prefix_trie, rebuilt, rebuilt_trie, numbered_turns, running

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_counts_at_every_prefix_equal_library(library):
    counter, rnd = PrefixCounter(ByteTables.load(VOCABULARY)), random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\n\n", "'", "re", "ll", "'ve", "1", "22", "!", "...", "é", "日本", "\t", " 's", "<|endoftext|>", "<|endof", "\x1c", "ing", "aaaaaaa", "-----", "🙂", "\xa0", "Σ", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(600)] + ["", "x" * 3000, "ab" * 900 + " " * 50, "\n" * 40 + "a"]
    for text, got in zip(texts, counter.prefixes(texts)):
        ends = range(1, len(text) + 1) if len(text) < 500 else rnd.sample(range(1, len(text) + 1), 40)
        assert len(got) == len(text)
        for k in ends:
            assert got[k - 1] == len(library.encode(text[:k], add_special_tokens=False).ids), (text[:k], k)


def test_tokens_stand_for_themselves_and_borders_are_merges(library):
    t = ByteTables.load(VOCABULARY)
    assert t.whole.sum() >= 50_000
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(256, 50256, 2000), rnd.integers(256, 50256, 2000)
    names = {i: s for s, i in library.get_vocab().items()}
    model = library.model
    for x, y, apart in zip(a.tolist(), b.tolist(), t.apart(a, b)):
        assert apart == ([z.id for z in model.tokenize(names[x] + names[y])] == [x, y])


def test_lookup_holds_what_it_is_given():
    rnd = np.random.default_rng(4)
    keys = np.unique(rnd.integers(0, 1 << 40, 5000))
    table = Lookup(keys[:10], np.arange(10))
    for at in range(10, len(keys), 700):
        table.add(keys[at : at + 700], np.arange(at, min(at + 700, len(keys))))
    assert (table.get(keys) == np.arange(len(keys))).all() and (table.get(keys + (1 << 41)) == -1).all()
    small = Lookup(np.zeros(0, np.int64), np.zeros(0, np.int32), most=16)
    small.add(np.arange(16), np.arange(16))
    small.add(np.arange(20, 24), np.arange(4))  # over the bound: emptied first
    assert small.get(np.arange(20, 24)).tolist() == [0, 1, 2, 3] and small.get(np.array([3]))[0] == -1


def test_counts_answer_budgets(spark, library):
    rows = [(1, "The quick brown fox, doesn't it?  \n\n yes", 5), (2, None, 1), (3, "", 1), (1, "twice", 9), (None, "no id " * 400, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prefix_tokens int").repartition(2)
    got = prefix_tokens(df, VOCABULARY).select("*", token_count(F.col("prefix_tokens")).alias("n"), token_count(F.col("prefix_tokens"), F.lit(7)).alias("seven"), fitting_prefix(F.col("prefix_tokens"), 3).alias("fit")).collect()
    assert len(got) == len(rows)
    n = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for r in got:
        text = r.text or ""
        assert (r.n, r.seven) == (n(text), n(text[:7])) and r.fit == max([k for k in range(len(text) + 1) if n(text[:k]) <= 3])
    assert prefix_tokens(df.limit(0), VOCABULARY).count() == 0


def brute_rebuilt(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", x or ""))
    conv = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c in conv:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = tuple(conv.get(base, [])[:h] + conv[c][h:])
    return out


def brute_trie(full):
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += kids[s] == 0
            saved[s[:d]] += (len(m) - 1) * words
    rows = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if full[c] == s)))
        rows.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def talk(seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(-25, 45)]), rnd.choice([None, 0, 1, 2]), rnd.choice(["u", None, "a"]), rnd.choice(["x y", "x", None, "", " ", "z z z"])) for _ in range(300)]
    return rows + [(c, i, "u", "a b") for c, n in ((100, 200), (101, 200), (140, 150), (160, 1)) for i in range(n)]


def test_trie_equals_brute_force(spark):
    rows = talk(5)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, part int").repartition(5)
    out = rebuilt_trie(df).collect()
    got = sorted((tuple(r)[:8] for r in out), key=lambda r: r[:2])
    assert got == brute_trie(brute_rebuilt(rows))
    # places are preorder: a subtree is the nodes from its place to its end
    at = {(r.conv_id, r.depth): r for r in out}
    assert sorted(r.position for r in out) == list(range(len(out)))
    for r in out:
        if r.depth:
            up = at[r.parent_conv_id, r.depth - 1]
            assert up.position < r.position <= r.subtree_end <= up.subtree_end
    assert rebuilt_trie(df.limit(0)).count() == 0


def test_trie_of_conversations_as_they_stand(spark):
    rows = [(1, 0, "u", "hi you"), (1, 1, "a", "yes"), (2, 0, "u", "hi you"), (3, 0, "u", "hi you"), (3, 1, "a", "no no"), (4, None, None, None)]
    got = sorted(tuple(r)[:7] for r in conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(1, 0, None, 4, 2, 3, 4), (1, 1, 1, 3, 2, 2, 4), (1, 2, 1, 1, 0, 1, 0), (3, 2, 1, 1, 0, 1, 0), (4, 1, 1, 1, 0, 1, 0)]


def test_trie_counts_conversations_without_turns(spark):
    rows = [(21, 0, "u", "gone"), (5, 0, "u", "gone")]  # first turns given up for those of absent conversations
    turns, lengths = rebuilt(numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    want = brute_rebuilt(rows)
    assert {r.conv: r.n for r in lengths.collect()} == {c: len(s) for c, s in want.items()}
    assert sorted(tuple(r)[:8] for r in prefix_trie(turns, lengths).collect()) == brute_trie(want)


def test_running_folds_go_on_over_partitions(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i, rnd.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    sums, xors, want = defaultdict(int), defaultdict(int), set()
    for k, i, v in sorted(rows):
        sums[k] += v
        xors[k] ^= v
        want.add((k, i, sums[k], xors[k]))
    assert set(map(tuple, running(df, ["k", "i"], "k", ["i"], {"s": "v"}, {"x": "v"}).collect())) == want
    total, want = 0, set()
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        total += v
        want.add((i, total))
    assert set(map(tuple, running(df, ["i"], None, ["i"], {"s": "v"}).collect())) == want


def brute_fim(doc_id, text):
    units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    n = len(units)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((*units, len(text))[v % (n + 1)] for v in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def snippets():
    rnd = random.Random(2)
    parts = ["a", "Bc", "P", "<", "<M", ">", " ", "é", "1", "zz", "\n", "🙂", "<S>"]
    texts = ["".join(rnd.choice(parts[: 12 + (rnd.random() < 0.1)]) for _ in range(rnd.choice([0, 1, 3, 10, 300, 900]))) for _ in range(150)]
    texts += [None, "", "<P>", "x" * 2000, "<" * 700, "a b" * 300, "S" * 511 + "<M" + ">"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, texts[0]), (200, texts[5]), (201, texts[5]), *[(300 + k, "copies of <a> giant, " * 60) for k in range(20)]]


@pytest.mark.parametrize("chunk", [CHUNK, 7, 300])
def test_fim_equals_brute_force(spark, chunk):
    rows = snippets()
    df = spark.createDataFrame([(*r, "clash", "kept") for r in rows], "doc_id long, text string, n string, digest string").repartition(3)
    got = fim_transform(df, chunk=chunk).withColumn("back", fim_restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and all(r.back == (r.text or "") and r.digest == "kept" for r in got)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert [tuple(r[2:]) for r in sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=order)] == [brute_fim(i, t or "") for i, t in sorted(rows, key=order)]
    assert fim_transform(df.limit(0), chunk=chunk).count() == 0


def test_functions_of_lanes_compose():
    rnd = random.Random(7)
    text = "".join(rnd.choice("aP<>S 1") for _ in range(4000))
    to, units, marks = Scan([text]).composed()
    parts = [text[k : k + 500] for k in range(0, len(text), 500)]
    to_, units_, marks_ = Scan(parts).composed()
    for start in range(4):
        state, n, m = start, 0, 0
        for k in range(len(parts)):
            n, m, state = n + units_[k, state], m + marks_[k, state], to_[k, state]
        assert (state, n, m) == (to[0, start], units[0, start], marks[0, start])
