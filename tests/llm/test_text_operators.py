"""Text operators against brute force, libraries, round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from framesift.llm import queries
from framesift.llm.bpe import bpe_round_trip
from framesift.llm.decontaminate import contamination, decontaminate
from framesift.llm.licenses import license_scan
from framesift.llm.lines import drop_boilerplate
from framesift.llm.secrets import guess_cost, secret_spans
from framesift.llm.simhash import keep_one_of_each, near_duplicate_classes, simhash_components
from framesift.llm.substrings import fenwick_chain, repeated_passages
from framesift.llm.tokenstore import compress, decompress, read_tokens, store_path, write_tokens
from framesift.llm.topk import top_k
from framesift.llm.toxicity import Restorer, character_counts, character_model, toxicity

SCHEMA = "doc_id long, text string, source string, ids string, fp string, score string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "er", "ing"]) for _ in range(n))


def corpus():
    rnd = random.Random(1)
    base = [prose(i, rnd.randrange(60, 200)) for i in range(30)]
    texts = [*base, *base[:5], base[7].replace("alpha", "omega", 1), None, "", "  \n ", "a", "Ünï ÇÖDÉ <|endoftext|> #", prose(99, 6000), "x" * 20000]
    rows = [(i, t, f"host{i % 3}") for i, t in enumerate(texts)] + [(0, base[0], "host0"), (None, "no id here", None)]
    return [(*r, "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_library(docs, none):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe_round_trip(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_range_coder_round_trip():
    rnd = np.random.default_rng(2)
    blocks = [rnd.integers(0, 50257, n) for n in (0, 1, 7, 900)] + [np.full(500, 50256), np.tile([5, 6, 7], 300), rnd.zipf(1.5, 2000) % 50257]
    coded = compress(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decompress(coded, [len(b) for b in blocks])))
    assert len(coded[4]) < 200 and len(coded[5]) < 400


def test_token_store(spark, docs, none):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = store_path(spark)
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = read_tokens(spark, path).orderBy("start").collect()
    start = 0
    for (i, text, *_), r in zip(sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0)), got):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(corpus())
    write_tokens(none, path + "-none", public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert read_tokens(spark, path + "-none").count() == 0


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(20)]  # ties
    bad = [(500, None), (550, []), (600, [float("nan")] * 8), (650, [None] + [0.1] * 7), (700, [float("inf")] * 8), (None, [0.5] * 8)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    df = spark.createDataFrame(rows + bad, schema)
    q = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows}
    want = []
    for i in (i for i in q if i % 50 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_toxicity_held_out(spark):
    out = queries.op4_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    hits = out.where("held_out").join(labels, "doc_id").groupBy((F.col("predicted") == F.col("toxic")).alias("right")).count().collect()
    n = {r.right: r["count"] for r in hits}
    assert n[True] / sum(n.values()) > 0.97


def test_toxicity_restores_and_edges(spark, docs, none):
    costs = character_model(character_counts(spark.createDataFrame([("the idiot and the moron are idiot moron loser " * 50,)], "text string")))
    r = Restorer(costs)
    assert [r.restore(x) for x in ("1di0t", "m.o.r.o.n", "looooser")] == ["idiot", "moron", "loser"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == len(corpus()) and all(0 <= x.score <= 1 for x in rows)
    assert toxicity(none, labels).count() == 0 and toxicity(docs, labels.limit(0)).count() == len(corpus())


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, docs, none):
    rows = [(i, t) for i, t, *_ in corpus() if i is not None and len(t or "") < 15000]
    rnd = random.Random(8)
    rows += [(1000 + i, " ".join(rnd.choices("ab", k=3))) for i in range(40)]
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in fp}
    while True:
        new = {}
        for i, x in fp:
            new[i] = min(label[j] for j, y in fp if (x ^ y).bit_count() <= 2)
        if new == label:
            break
        label = new
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{x:016x}", label[i]) for i, x in fp)
    assert simhash_components(docs).count() == len(corpus()) and simhash_components(none).count() == 0


def test_near_duplicates(spark, docs, none):
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs).collect()}
    assert all(got[30 + i] == i for i in range(5)) and got[35] == 7 and got[8] == 8
    left = {r.doc_id for r in keep_one_of_each(docs).collect()}
    assert None in left and 8 in left and not left & {30, 31, 35}
    assert keep_one_of_each(none).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(12)
    texts = []
    for k in range(40):  # worn copies round similarity 0.8, of few words and of many
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([9, 30, 120, 400]))]
        texts.append(" ".join(words))
        for _ in range(4):
            worn = list(words)
            for _ in range(max(1, round(len(words) * rnd.choice([0.01, 0.02, 0.025, 0.03])))):
                worn[rnd.randrange(len(worn))] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(worn[: len(worn) - rnd.randrange(3)]))
    texts += ["again " * 300, "again " * 200, "", " "]
    sets = []
    for text in texts:
        w = text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in alike:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()} == dict(enumerate(label))


def test_lines(spark, none):
    rows = [(i, f"Menu home\nstory {i} only\n  Menu home ", "a") for i in range(8)] + [(20, None, "a"), (21, "", "b"), (22, "Menu home", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_boilerplate(df).collect()}
    assert got[3] == ("story 3 only", 3, 2) and got[20] == (None, 0, 0) and got[21] == ("", 1, 0) and got[22] == ("Menu home", 1, 0)
    assert drop_boilerplate(none).count() == 0


def test_lines_of_a_copy_group_stay(spark):
    from corpus_pipeline import drop_lines

    rows = [(i, f"Menu home\nstory {i} only", "a") for i in range(40)] + [(100 + i, "Menu home\ncopied story\nits end", "a") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in drop_lines(spark, df, "").collect()}
    assert got == {i: f"story {i} only" for i in range(40)} | {100 + i: "copied story\nits end" for i in range(20)}


def test_secrets(spark, docs, none):
    text = 'Password: "hunter2x" and AKIA' + "ABCD1234" * 2 + " ü hex " + "0a" * 12 + " token=abc bearer Zq8#kv!29xLm password=short1 pwd is qwerty123"
    r = secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = [(s.kind, text[s.start : s.end]) for s in r.secrets]
    assert ("access", "AKIA" + "ABCD1234" * 2) in found and ("hex", "0a" * 12) in found and ("guess", "Zq8#kv!29xLm") in found
    assert [x for k, x in found if k == "assign"] == ['Password: "hunter2x', "password=short1"]
    assert not any("qwerty123" in x for k, x in found if k == "guess")
    assert guess_cost("password1999") < 8 < guess_cost("Zq8#kv!29xLm") and guess_cost("") == 0
    assert secret_spans(docs).count() == len(corpus()) and secret_spans(none).count() == 0


def test_passages(spark, docs, none):
    shared = prose(500, 80)
    worn = shared.split()
    worn[20], worn[55] = "changed", "words"
    rows = [(1, prose(501, 150) + " " + shared), (2, shared + " " + prose(502, 100)), (3, prose(503, 200)), (4, prose(504, 30) + " " + " ".join(worn) + " " + prose(505, 30))]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 4} and got[1].is_first and not got[2].is_first
    assert got[1].start_word <= 152 and got[1].end_word == 230 and got[2].start_word == 0 and 78 <= got[2].end_word <= 82
    assert got[4].start_word <= 32 and got[4].end_word >= 108
    assert {r.doc_id for r in repeated_passages(docs).collect()} >= {0, 30, 7, 35} and repeated_passages(none).count() == 0
    best = fenwick_chain(*(np.array(x) for x in ([0, 10, 20, 5], [5, 15, 25, 9], [0, 11, 20, 90], [5, 16, 25, 94])))[0]
    assert best == [0, 1, 2]


def test_licenses(spark, docs, none):
    text = "Under the MIT License. See: Apache License, Version 2; not under the mit. CC-BY-NC! Redistribution and use in source and binary forms, with or without modification, are permitted"
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert list(r.starts) == [0, 5, 13] and list(r.base_labels) == ["apache-2", "cc-by-nc", "mit"] and "bsd" in r.labels and r.score == 1.0
    assert license_scan(docs).where("size(labels) > 0").count() == 0 and license_scan(none).count() == 0


def test_decontamination_equals_brute_force(spark, docs, none):
    item = corpus()[3][1].split()
    bench = spark.createDataFrame([(1, " ".join(item[10:40]).upper()), (2, "a"), (3, None), (4, "never seen words here"), (10, " ".join(item[20:33]))], "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r.item_id: words(r.text) for r in bench.collect()}
    want = []
    for i, t, *_ in corpus():
        w, hit, ids = words(t), set(), set()
        for item_id, x in items.items():
            n = min(13, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    ids.add(str(item_id))
        want.append((str(i), len(w), len(hit), tuple(sorted(ids))))
    got = contamination(docs, bench)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == sorted(want)
    assert 3 not in {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert contamination(none, bench).count() == 0 and contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_queries_have_the_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    want = {
        "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op2_tokens": "doc_id start n_tokens ids_crc32", "op3_topk": "query_id rank vec_id score",
        "op4_toxicity": "doc_id held_out score predicted", "op5_simhash": "doc_id fingerprint component_id", "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op9_licenses": "doc_id n_words n_base first_word last_word base_labels labels score", "op10_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    }
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, d).columns == cols.split()


def test_secret_digest(spark):
    d = "/root/testdata/sf0.01"
    r = queries.op7_secrets(spark, d).where("n_assign > 0").first()
    base = ",".join(x for x in r.spans.split(",") if not x.startswith("guess"))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    rows = p.run(spark, d).collect()
    assert 0.5 * n < len(rows) < n and len({r.doc_id for r in rows}) == len(rows)
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, empty, d)
        assert out.count() == 0 and (name == "bpe" or out.columns == empty.columns)


def test_pipeline_stages_take_nulls_ties_and_repeats(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    names = spark.read.parquet(f"{d}/documents.parquet").columns
    text = prose(77, 90)
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, "en", None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (None, text + " more", None, "a", 1), (5, prose(78, 90) + "\n" + "y" * 30_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(names)
    for name, stage in p.STAGES:
        out = stage(spark, docs, d)
        ids = sorted((r.doc_id for r in out.collect()), key=str)
        assert ids == ([1, 1, 3, 5, None] if name == "simhash_near_dedup" else [1, 1, 2, 3, 4, 5, None]), name


def test_pipeline_catches_near_copies(spark):
    from corpus_pipeline import drop_copies

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    label = {i: i for i in first.values()}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    heads, holders, pairs = sorted(label), {}, 0
    for i in heads:
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    for i, j in {(i, j) for some in holders.values() for j in some for i in some if i < j}:
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            pairs += 1
            a, b = sorted((root(i), root(j)))
            label[b] = a
    want = {i for i in heads if root(i) == i}
    got = {r.doc_id for r in drop_copies(spark, docs, "").collect()}
    gone = set(sets) - want
    assert pairs and got >= want  # no clean document goes
    assert len(gone - got) >= 0.98 * len(gone)


def test_lines_by_join_and_by_broadcast(spark, monkeypatch):
    from framesift.llm import lines

    rows = [(i, f"\tMenu home \r\nstory {i}\nshared {i % 30}\x0b\n\n", f"h{i % 2}", "x", "y", 7) for i in range(120)] + [(500, "only page\nonly page", "lone", "x", "y", 7), (501, None, "h0", "x", "y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string, key string, n_lines int").repartition(3)
    small = sorted(map(str, drop_boilerplate(df).collect()))
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    large = drop_boilerplate(df).collect()
    assert sorted(map(str, large)) == small
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in large}
    assert got[500] == ("only page\nonly page", 2, 0) and got[501] == (None, 0, 0)
    assert got[7] == ("story 7\n\n", 5, 2)  # 4 of a host's 61 pages share a line


def test_decontamination_by_join_and_by_broadcast(spark, docs, monkeypatch):
    from framesift.llm import decontaminate as d

    item = corpus()[3][1]
    bench = spark.createDataFrame([(1, " ".join(item.split()[5:40])), (2, "alpha"), (3, " ".join(corpus()[4][1].split()[:13]))], "item_id long, text string")
    rows = lambda: sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"], r.spans)) for r in contamination(docs, bench).collect())
    small, left = rows(), sorted(str(r.doc_id) for r in decontaminate(docs, bench).collect())
    for name in ("BROADCAST_CHARS", "BROADCAST_GRAMS", "BROADCAST_ROWS"):
        monkeypatch.setattr(d, name, 0)
    assert rows() == small and sorted(str(r.doc_id) for r in decontaminate(docs, bench).collect()) == left
