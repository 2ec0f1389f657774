"""Operators without SQL against independent scans and exhaustive search."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm import queries
from framesift.llm.common import with_ids
from framesift.llm.licenses import BASE, license_scan
from framesift.llm.secrets import COMMON, DATE, NEXT, corpus_words, guess_cost, secret_spans
from framesift.llm.simhash import near_duplicate_classes, run_links
from framesift.llm.topk import top_k
from framesift.llm.toxicity import CODE, character_counts, character_model, decode, fit, held_out, readings

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- operator 3: components of any magnitude


def test_top_k_of_huge_components(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    rows += [(150, [65536.0, 1, 0, 0, 0, 0]), (151, [70000.0, 1, 0, 0, 0, 0]), (200, [1e30, -1e30, 1, 1, 1, 1]), (201, [1e30, -1e30, 1, 1, 1, 1.5]), (202, [3e38, 1, 1, 1, 1, 1]), (250, [-3e38, 0, 0, 0, 0, 2]), (300, [-65536.0] * 6)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("id", T.StringType()), T.StructField("part", T.StringType())])
    doubled = [(50, None, "x", "y"), (50, [float("nan")] * 6, "x", "y")]  # bad rows of a good query's id
    df = spark.createDataFrame([(*r, "x", "y") for r in rows] + doubled, schema)
    q = {i: [math.floor(256 * np.float64(np.float32(x))) for x in v] for i, v in rows}
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    want = []
    for i in (i for i in q if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:5]
        want += [(i, k + 1, j, clip(-s)) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0"), 5).collect())) == sorted(want)


# --- operator 4: the held-out fold, and decoding


def test_toxicity_never_learns_from_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    _, weights, bias = fit(docs, labels)
    _, other, same = fit(docs, turned)
    assert weights == other and bias == same and weights
    assert [r.h for r in spark.range(20).select(held_out(F.col("id")).alias("h")).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(20)]


def test_decoding_equals_exhaustive_spelling(spark):
    text = "the rotten idiot and the stupid moron are total losers and liars all of them " * 20
    costs = character_model(character_counts(spark.createDataFrame([(text,)], "text string")))

    def cost(spelling):
        a = b = total = 0
        for c in spelling + " ":
            total, a, b = total + costs[a, b, CODE[c]], b, CODE[c]
        return total

    for token in ("1d10t", "m.o.r", "l0$ers", "stttupid", "l1@r", "x9!"):
        ways = itertools.product(*(readings(token, i) for i in range(len(token))))
        best = min(sum(w for _, w in way) + cost("".join(c for c, _ in way)) for way in ways)
        got = decode(token, costs)
        mine = min(sum(w for _, w in way) + cost(got) for way in itertools.product(*(readings(token, i) for i in range(len(token)))) if "".join(c for c, _ in way) == got)
        assert abs(mine - best) < 1e-9
    assert len(decode("a." * 30_000, costs)) > 1000  # linear in the token


# --- operator 7: base spans, guess costs


def scan_base(text):
    """Base spans by walking over the text: leftmost, non-overlapping for each kind."""
    low, found = text.lower(), []
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at) and text[at : at + len(w)].isascii()), None)
        if word is None:
            at += 1
            continue
        i = at + len(word)
        i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
        while text[i : i + 1] == " ":
            i += 1
        if text[i : i + 1] not in (":", "="):
            at += 1
            continue
        i += 1
        while text[i : i + 1] == " ":
            i += 1
        i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
        j = i
        while j < len(text) and text[j] in value:
            j += 1
        if j == i:
            at += 1
            continue
        if j - i >= 6:
            found.append((at, 0, j))
        at = j
    for kind, head, signs, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            j = at + len(head)
            while text.startswith(head, at) and j < len(text) and text[j] in signs:
                j += 1
            if text.startswith(head, at) and j > at + len(head):
                if j - at >= least:
                    found.append((at, kind, j))
                at = j
            else:
                at += 1
    return sorted(found)


def test_base_spans_equal_a_plain_scan(spark):
    kinds = ("assign", "access", "hex")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op7_secrets(spark, MIDDLE).collect()}
    some = 0
    for i, text in texts.items():
        want = scan_base(text or "")
        base = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), i
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        some += len(want)
    assert some > 20
    odd = ["password password: abcdef", "ToKeN='==abc=' token=abc", "secret:=x secret: 'a.b/c+d", "AKIAAKIA" + "0" * 16 + "a" * 25, "apikey = \"" + "0f" * 20, "ſecret=abcdefg PASSWD:é", "token" * 3 + ":abcdef"]
    for r in secret_spans(spark.createDataFrame(list(enumerate(odd)), "id long, text string")).collect():
        assert [(s.start, kinds.index(s.kind), s.end) for s in r.secrets if s.kind != "guess"] == scan_base(odd[r.id])


def exhaustive_cost(value):
    """The cheapest of all segmentations, each piece priced on its own."""
    low = value.lower()
    plain = low.translate(str.maketrans("013457@$!", "oleastasi"))
    pool = math.log10(10 if value.isdigit() else 16 if re.fullmatch("[0-9a-f]+", value) else 26 if value.isalpha() and value in (low, value.upper()) else 62 if value.isalnum() else 94)

    def piece(i, j):
        part, n = low[i:j], j - i
        prices = [pool] if n == 1 else []
        if plain[i:j] in COMMON:
            prices.append(math.log10(COMMON.index(plain[i:j]) + 2) + 0.5 * (plain[i:j] != part) + 0.3 * (value[i:j] != value[i:j].lower()))
        if DATE.fullmatch(value[i:j]):
            prices.append(4.6)
        if n >= 3 and len(set(part)) == 1:
            prices.append(pool + math.log10(n))
        prices += [pool * w + math.log10(n) for w in (2, 3, 4) if n >= 2 * w and n % w == 0 and part == part[:w] * (n // w)]
        steps = [ord(b) - ord(a) for a, b in zip(part, part[1:])]
        if n >= 4 and all(frozenset(p) in NEXT or abs(ord(p[1]) - ord(p[0])) == 1 for p in zip(part, part[1:])):
            prices.append(1.7 + math.log10(n) + 0.4 * sum(a != b for a, b in zip(steps, steps[1:])))
        return min(prices, default=math.inf)

    best = math.inf
    for cuts in itertools.product((0, 1), repeat=len(value) - 1):
        ends = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(value)]
        cost = 0.0
        for a, b in zip(ends, ends[1:]):
            one = piece(a, b)
            cost += one + (0.3 if a and b - a > 1 else 0.0)
            if cost >= best:
                break
        best = min(best, cost)
    return best


def test_guess_cost_is_the_best_segmentation():
    rnd = random.Random(3)
    values = ["pass2020", "qwerty12", "aaaa1111", "P4ssword", "abcabc99", "x1y2z3", "monkey7!", "19991231", "asdf!!!!", "zzzz", "a", "aaaabc", "1219991", "201912", "abababa1", "qwertyu", "aaaassss", "wertrewq"]
    values += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(2, 11))) for alphabet in ("abqwe12!A", "aab", "019", "asdfg") for _ in range(25)]
    for v in values:
        assert abs(guess_cost(v) - exhaustive_cost(v)) < 1e-9, v


def test_words_of_the_corpus(spark):
    rows = [(1, "the token is required1 here"), (2, "a token is required2 there, as required3"), (3, "the token is Zq8vKp4mmXw! 0123456789abcdefcab required"), (4, "0123456789abcdefcab"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_words(df) == ["required", "the"] and corpus_words(df, most=1) == []  # both or neither
    spans = {r.doc_id: [s.kind for s in r.secrets if s.kind != "hex"] for r in secret_spans(df).collect()}
    assert spans == {1: [], 2: [], 3: ["guess"], 4: [], 5: []}


def test_values_of_letters_alone_are_judged(spark):
    prose, secret = "correct horse battery staple", "password is qzkvxwtrypljmnb"
    rows = [(1, secret), (2, "password is Qzkvxwtrypljmnb and token is whatever"), (3, "my login is correcthorsebatterystaple"), (4, prose), (5, prose), (6, None), (7, ""), *[(8 + k, secret) for k in range(5)]]
    found = {r.doc_id: len(r.secrets) for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, **{8 + k: 1 for k in range(5)}}  # copies do not make a secret a word


# --- operator 9: base places


def test_base_places_equal_a_plain_scan(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()}
    got, some = {r.doc_id: r for r in queries.op9_licenses(spark, MIDDLE).collect()}, 0
    for i, text in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        some += len(at)
    assert some > 5


def test_worn_license_texts(spark):
    from framesift.llm.licenses import NOTICES

    rnd = random.Random(2)
    rows, want = [], {}
    for k, (label, text, key) in enumerate(NOTICES):
        words = text.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key.split())] == key.split())
        free = [i for i in range(len(words)) if not at <= i < at + len(key.split())]
        for i in rnd.sample(free, len(free) // 10):
            words[i] = "worn"
        rows.append((k, "some file header " + " ".join(words).title() + ". and code"))
        want[k] = label
    rows.append((99, " ".join(f"{w} filler" for w in NOTICES[0][1].split())))
    got = {r.doc_id: list(r.labels) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[k] in got[k] for k in want) and got[99] == []


# --- operator 5: large buckets


def test_large_buckets_give_the_links_of_all_pairs():
    rnd = np.random.default_rng(4)
    fp = np.unique(rnd.integers(0, 1 << 13, 5000, dtype=np.uint64) << np.uint64(20))
    run = np.zeros(len(fp), np.int64)
    for radius in (1, 2):
        a, b = run_links(fp, run, radius)
        label = {int(x): int(x) for x in fp}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            label[root(x)] = root(y)
        got = [root(int(x)) for x in fp]
        near = np.bitwise_count(fp[:, None] ^ fp[None]) <= radius
        want = np.arange(len(fp))
        while True:
            new = np.where(near, want[None], len(fp)).min(1)
            if (new == want).all():
                break
            want = new
        assert len(set(zip(got, want.tolist()))) == len(set(got)) == len(set(want.tolist()))


def test_large_groups_of_near_copies(spark):
    rnd = random.Random(21)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(400):  # each about 0.9 to the text they come from, so about 0.8 to each other
        w = list(base)
        for i in rnd.sample(range(300), 3):
            w[i] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{rnd.randrange(10**6)}" for _ in range(300)) for _ in range(50)]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(texts)], "doc_id long, text string, node int, part string").repartition(4)
    got = [r.class_id for r in near_duplicate_classes(df).orderBy("doc_id").collect()]
    assert got[400:] == list(range(400, 450)) and sum(c == 0 for c in got[:400]) >= 396


@pytest.mark.parametrize("far", [False, True])
def test_rows_by_id(spark, far):
    k = 10**12 if far else 1
    df = spark.range(-50, 200).selectExpr(f"id * {k} AS doc", "id")
    ids = spark.createDataFrame([(i * k,) for i in (-50, -1, 0, 1, 7, 8, 199, 199, 5000)], "id long")
    assert sorted(r.id for r in with_ids(df, "doc", ids).collect()) == [-50, -1, 0, 1, 7, 8, 199]
    assert with_ids(df, "doc", ids.limit(0)).count() == 0


def test_trigrams_do_not_depend_on_the_partitions(spark):
    from framesift.llm.toxicity import character_counts

    rows = [("one two",), ("",), (None,), ("a",), ("ab",), ("over and over again",)] * 7
    df = spark.createDataFrame(rows, "text string")
    counts = [dict(map(tuple, character_counts(df.repartition(n)).collect())) for n in (1, 4)]
    assert counts[0] == counts[1] and sum(counts[0].values()) == sum(len(x or "") for x, in rows)
    assert character_counts(df.limit(0)).count() == 0


def test_pivots_discard_no_pair_that_maps_allow():
    from framesift.llm import simhash as S

    rnd = np.random.default_rng(5)
    sets, key = [], []
    for k in range(30):  # runs of worn copies and of sets of other sizes, small and large
        base = rnd.integers(0, 1 << 63, rnd.choice([20, 60, 70, 300]), dtype=np.uint64)
        for _ in range(12):
            worn = base.copy()
            at = rnd.integers(0, len(base), rnd.integers(0, len(base) // 3))
            worn[at] = rnd.integers(0, 1 << 63, len(at), dtype=np.uint64)
            sets.append(np.unique(worn))
            key.append(k // 3)
    maps = np.stack([np.frombuffer(S.set_map(x), np.uint64) for x in sets])
    n, key = np.array([len(x) for x in sets]), np.array(key)
    pivots = S.pivot_table(key, maps)
    i, j = np.triu_indices(len(sets), 1)
    i, j = i[key[i] == key[j]], j[key[i] == key[j]]
    got, plain = S.alike(i, j, n, maps, pivots, 0.8), S.alike(i, j, n, maps, pivots[:0], 0.8)
    assert (got == plain).all() and got.any() and (pivots == 0).any(0).sum() >= 4
    a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    apart = (np.abs(pivots[:, i] - pivots[:, j]) > S.widest(a, b, 0.8)).any(0)
    assert apart.sum() > len(i) // 10 and not plain[apart].any()
    both = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j)])
    assert got[5 * both >= 4 * (n[i] + n[j] - both)].all()


def test_near_copies_share_keys_of_the_pivot_table(spark, monkeypatch):
    from framesift.llm import simhash as S

    rnd = random.Random(9)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(900)]
    texts = [" ".join(words), " ".join(words[:899]), "", " ".join(f"y{rnd.randrange(10**6)}" for _ in range(900))]
    a, b = (S.shingle_set(x, 5) for x in texts[:2])
    fp = np.array([S.set_simhash(x, S.set_map(x)) for x in (a, b)], np.uint64)
    assert fp.tolist() == [S.majority(S.bit_counts(x), len(x)) for x in (a, b)] and np.bitwise_count(fp[0] ^ fp[1]) <= S.RADIUS
    monkeypatch.setattr(S, "set_keys", lambda hashes, similarity: hashes[:0])  # without least hashes
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in S.near_duplicate_classes(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
