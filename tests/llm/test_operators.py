"""Each operator against its brute-force version, on supplied texts and on awkward ones."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from brute import alnum_words, classes, contamination, crc, jump_hash, line_dedup, perspectives, quality, repeats, simhash, space_words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import (
    bpe, chat_format, components, decontaminate, quality_knn, quality_rules, registry, sharding, simhash_dedup, suffix_dedup, toxic_segments, words,
)
from lumenframe.llm import line_dedup as lines_op

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_words long, fingerprint string, doc string"
PASSAGE = " ".join(f"word{i}" for i in range(60))
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "a b c d e " * 30), (7, "x\ny\nz\nx\ny\nz\n\nx\ny\nz"), (8, "é É ß 日本 😀 <|endoftext|> it's  "),
    (9, PASSAGE + " tail a"), (10, "head b " + PASSAGE), (11, "p q\n" + PASSAGE + "\nr s"), (12, "W" * 40_000), (13, "lorem ipsum " * 9_000),
    (14, "\n".join(f"line {i % 5} of it" for i in range(40))), (15, "# * $ % & | < > ! SHOUTING ALL THE WAY UP HERE NOW"), (-3, "negative id " * 8),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Awkward texts, with columns named like the operators' own, two rows repeated and one null id."""
    rows = [(i, t, 7, "f", "d") for i, t in AWKWARD]
    return spark.createDataFrame([*rows, rows[8], rows[3], (None, PASSAGE, 7, "f", "d")], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return [(r["doc_id"], r["text"]) for r in words.documents(spark, SMALL).select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_patterns(small):
    for _, text in [*small[:50], *AWKWARD]:
        assert [w.decode() for w in words.space_words(text)] == space_words(text)
        assert [w.decode() for w in words.alnum_words(text)] == alnum_words(text)


def test_quality_measures(spark, small, awkward):
    rows = registry.op2_quality_rules(spark, SMALL).collect()
    texts = dict(small)
    for r in rows:
        want = quality(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (r["kept"] and r["base_failed"])
    for r in quality_rules.ledger(awkward).collect():
        if r["doc_id"] in dict(AWKWARD):
            want = quality(dict(AWKWARD)[r["doc_id"]])
            assert {k: r[k] for k in want} == want


def test_quality_random_repeats():
    draw = random.Random(3)
    for _ in range(200):
        found = [draw.choice("abc") for _ in range(draw.randrange(40))]
        codes = np.array([ord(c) for c in found], np.int64) - 97
        assert quality_rules.repeated_word_count(codes) == quality(" ".join(found))["n_repeat_words"]


def test_quality_policies_and_ablations(spark, awkward, empty):
    book = quality_rules.ledger(awkward)
    kept = quality_rules.apply_policy(book, "v1")
    found = {r["rule"]: r for r in quality_rules.ablations(book, "v1").collect()}
    assert set(found) == set(quality_rules.POLICIES["v1"])
    total = kept.filter("kept").count()
    mask = quality_rules.policy_mask("v1")
    bits = [r["fail_bits"] & mask for r in book.collect()]
    for rule in quality_rules.RULES:
        r = found[rule.name]
        assert r["n_kept"] == total and r["n_failed"] == sum(b >> rule.bit & 1 for b in bits)
        assert r["n_kept_without"] == sum(b & ~(1 << rule.bit) == 0 for b in bits)
    assert quality_rules.keep_documents(awkward).columns == awkward.columns
    assert quality_rules.keep_documents(awkward).count() == total
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.keep_documents(empty).count() == 0


def test_bpe_equals_library(spark, small, awkward, empty):
    path = str(public_tokenizers.path(registry.VOCABULARY))
    library = Tokenizer.from_file(path)
    rows = [(r["doc_id"], r["text"], list(r["ids"]), r["decoded"]) for r in bpe.encode(awkward, path).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect()]
    encoder = bpe.Encoder(path)
    texts = [t for _, t in small]
    ids, counts = encoder.encode_batch(texts)
    split = np.split(ids, np.cumsum(counts)[:-1])
    rows += [(d, t, i.tolist(), x) for (d, t), i, x in zip(small, split, encoder.decode_batch(ids, counts))]
    for _, text, got, decoded in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got == want
        assert decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0
    digest = {r["doc_id"]: r for r in registry.op3_bpe(spark, SMALL).collect()}
    for d, _, got, decoded in rows[-20:]:
        assert digest[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, got)).encode()).hexdigest()
        assert digest[d]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_random_bytes_and_classes():
    path = str(public_tokenizers.path(registry.VOCABULARY))
    library, encoder, draw = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(5)
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(chr(draw.choice(points[:600] if draw.random() < 0.8 else points)) for _ in range(60)) for _ in range(300)]
    texts += [draw.choice(["", " "]) + "".join(draw.choice("etaoin shrdlu  'st\n") for _ in range(80)) for _ in range(100)]
    ids, counts = encoder.encode_batch(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_forgets_without_harm(monkeypatch, small):
    path = str(public_tokenizers.path(registry.VOCABULARY))
    texts = [t for _, t in small[:40]]
    want = bpe.Encoder(path).encode_batch(texts)[0].tolist()
    monkeypatch.setattr(bpe, "MOST_WORDS", 1)
    encoder = bpe.Encoder(path)
    encoder.encode_batch(texts[:20])
    assert encoder.encode_batch(texts)[0].tolist() == want


@pytest.mark.parametrize(("most_bytes", "shard_bytes"), [(1 << 20, 1), (0, 20_000), (0, 1 << 24)])
def test_decontamination(spark, small, awkward, empty, most_bytes, shard_bytes):
    """With the benchmark sent whole, and with documents in many shards and in one."""
    ways = {"most_bytes": most_bytes, "shard_bytes": shard_bytes}
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    extra = [(900, "word3 word4 word5"), (901, None), (902, " . "), (903, "lorem ipsum"), (900, "word50 word51"), (None, "Shouting ALL the")]
    more = spark.createDataFrame([*items, *extra], "item_id long, text string")
    for docs, pairs, b, its in ((words.documents(spark, SMALL), small, bench, items), (awkward, AWKWARD, more, items + extra)):
        found = decontaminate.matches(docs, b, **ways).select(
            "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"), "matches",
        )
        rows = found.collect()
        assert len(rows) == docs.count()
        for r in rows:
            if r["doc_id"] is not None:
                want = contamination(dict(pairs)[r["doc_id"]], its)
                assert {k: r[k] for k in want} == want
                doc = alnum_words(dict(pairs)[r["doc_id"]])
                texts = {}
                for i, t in its:
                    texts.setdefault(str(i) if i is not None else "", []).append(alnum_words(t))
                for m in r["matches"]:
                    piece = doc[m["doc_start"] : m["doc_start"] + m["length"]]
                    assert any(t[m["item_start"] : m["item_start"] + m["length"]] == piece for t in texts[m["item_id"]])
    kept = decontaminate.remove_contaminated(awkward, more, **ways)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == {d for d, t in AWKWARD if not contamination(t, items + extra)["contaminated"]}
    none = bench.limit(0)
    assert decontaminate.matches(awkward, none, **ways).filter("size(items) > 0 OR size(spans) > 0").count() == 0
    assert decontaminate.matches(empty, bench, **ways).count() == 0
    plan = decontaminate.matches(awkward, more, **ways)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_suffix_array_is_sorted():
    draw = np.random.default_rng(1)
    for codes in (draw.integers(0, 3, 400), np.tile([0, 1], 300), np.zeros(50), draw.integers(0, 300, 500), np.array([4])):
        array = decontaminate.suffix_array(codes.astype(np.int32), np.arange(len(codes)))
        keys = [tuple(codes[i:]) for i in array]
        assert keys == sorted(keys) and sorted(array) == list(range(len(codes)))


def test_longest_matches_with_places():
    """Against every alignment of every item with every document."""
    draw = random.Random(9)
    for window in (2, 4, 13):
        items = [(str(i % 7), " ".join(draw.choice("abcd") for _ in range(draw.randrange(25)))) for i in range(12)]
        docs = [[draw.choice("abcdx").encode() for _ in range(draw.randrange(40))] for _ in range(15)]
        found = decontaminate.shard_matches(docs, decontaminate.Queries(items, window))
        for doc, (_, names, got) in zip(docs, found):
            best = {}
            for item, text in items:
                words = text.encode().split()
                for i in range(len(words)):
                    for j in range(len(doc)):
                        n = 0
                        while i + n < len(words) and j + n < len(doc) and words[i + n] == doc[j + n]:
                            n += 1
                        if n >= window or len(words) < window and i == 0 and n == len(words):
                            best[item] = max(best.get(item, (0, 0)), (n, -j))
            assert {m["item_id"]: (m["length"], -m["doc_start"]) for m in got} == best and names == sorted(best)


def test_simhash(spark, small, awkward, empty):
    for docs, pairs in ((words.documents(spark, SMALL), small), (awkward.filter("doc_id IS NOT NULL"), AWKWARD)):
        found = simhash_dedup.near_duplicates(docs).select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fp"), "component_id").collect()
        prints = [(d, simhash(t)) for d, t in pairs]
        want = classes(prints)
        assert {(r["doc_id"], r["fp"], r["component_id"]) for r in found} == {(d, f"{fp:016x}", want[d]) for d, fp in prints}
        assert len(found) == docs.count()
        assert {r["doc_id"] for r in simhash_dedup.keep_one(docs).collect()} == set(want.values())
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0
    one = simhash_dedup.keep_one(awkward)
    assert one.columns == awkward.columns and one.count() == one.distinct().count()


@pytest.mark.parametrize(("radius", "tile"), [(4, 2048), (4, 3), (2, 1), (0, 2048)])
def test_simhash_links_near_prints(spark, radius, tile):
    """Groups of near copies and single prints, in whole cells and in cells cut into several tiles."""
    draw = random.Random(radius * 100 + tile)
    fps = []
    for _ in range(12):
        base = draw.getrandbits(64) if draw.random() < 0.7 else draw.getrandbits(20)
        fps += [base] + [base ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 7))) for _ in range(15)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = simhash_dedup.links(df, radius, tile).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        assert r["a"] != r["b"]
        root[find(r["a"])] = find(r["b"])
    want = classes(list(zip(range(len(fps)), fps)), radius)
    for i in range(len(fps)):
        for j in range(i):
            assert (find(signed[i]) == find(signed[j])) == (want[i] == want[j])


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 201), (201, 202), (202, 200), (300, 300)] + [(400, k) for k in range(401, 440)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == 100 and found[202] == 200 and found[439] == 400 and 300 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jump_sharding(spark, small, awkward, empty):
    rows = registry.op8_jump_sharding(spark, SMALL).collect()
    texts = dict(small)
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (jump_hash(r["doc_id"], 8), jump_hash(r["doc_id"], 9))
        assert (r["size"], r["text_crc32"], r["law"]) == (len((texts[r["doc_id"]] or "").encode()) + 1, crc(texts[r["doc_id"]]), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    for docs in (awkward, words.documents(spark, SMALL)):
        slots = {}
        for r in sharding.assign(docs, 8, bin_rows=3).collect():
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == docs.count()
    assert sharding.assign(empty, 8).count() == 0


def test_sharding_of_many_equal_rows_and_other_ids(spark):
    """One row repeated past several pieces, ids that are texts, null ids."""
    docs = spark.range(20_000).select(F.lit("same").alias("doc_id"), F.lit("text").alias("text"))
    docs = docs.union(spark.createDataFrame([("12", "a"), ("x y", None), (None, "b"), (None, None)], "doc_id string, text string"))
    rows = sharding.assign(docs, 8, piece_rows=64).collect()
    assert len(rows) == 20_004
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        if r["doc_id"] is None:
            assert r["shard"] == jump_hash(0, 8)
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == "same"}) == 1
    for kind in ("int", "decimal(9,2)", "date"):
        assert sharding.assign(spark.range(3).select(F.lit(None).cast(kind).alias("doc_id"), F.lit("t").alias("text"))).count() == 3


@pytest.mark.parametrize("shards", [1, 2, 47, 48, 49, 300])
def test_jump_hash_of_many_shards(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[random.Random(7).getrandbits(62) for _ in range(60)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), [shards]).alias("s"))
    assert {r["k"]: r["s"][f"b{shards}"] for r in df.collect()} == {k: jump_hash(k, shards) for k in keys}


def test_suffix_dedup(spark, small, awkward, empty):
    pairs = [(d, t) for d, t in AWKWARD if t and len(t) < 20_000]
    longer = [(100 + i, " ".join(random.Random(i // 3).choices("abcdefgh", k=120)) + f" end{i} " + PASSAGE) for i in range(9)]
    copies = [(200 + i, t) for i, (_, t) in enumerate(small[:5])] + [(300 + i, t) for i, (_, t) in enumerate(small[:3])]
    for rows in (small, pairs + longer, copies):
        want = repeats(rows)
        found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        spread = lambda spans: {i for s in spans for i in range(s["start"], s["end"])}
        assert {r["doc_id"] for r in found} == set(want)
        for r in found:
            both, later = want[r["doc_id"]]
            assert spread(r["spans"]) == both and r["n_repeated"] == len(both)
            assert spread(r["removed"]) == later and r["n_removed"] == len(later)
            assert min(r["first_ids"]) <= r["doc_id"]
    found = {r["doc_id"] for r in suffix_dedup.repeated_passages(awkward).collect()}
    assert {9, 10, 11, None} <= found and not found & {1, 2, 3, 4, 5, 8, 12}
    assert suffix_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize(("size", "gram"), [(6, 3), (5, 5), (4, 1)])
def test_suffix_dedup_of_dense_repeats(spark, size, gram):
    draw = random.Random(size)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(60)))) for i in range(40)]
    want = repeats(rows, size)
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=size, gram=gram).collect()
    got = {r["doc_id"]: tuple({i for s in r[c] for i in range(s["start"], s["end"])} for c in ("spans", "removed")) for r in found}
    assert got == {d: (b, x) for d, (b, x) in want.items()}


def test_line_dedup(spark, small, awkward, empty):
    for rows in (small, [(d, t) for d, t in AWKWARD]):
        found = lines_op.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["text"] for r in found} == line_dedup(rows)
    out = lines_op.dedup_documents(awkward)
    assert out.columns == [*awkward.columns, "lines_removed"] and out.count() == awkward.count()
    assert lines_op.dedup_documents(empty).count() == 0


def test_perspectives(spark, empty):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi\nall"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (1, 3, "carl", "ciao"), (2, 0, "system", "x"),
        (3, 5, "", "who"), (3, 6, None, "me"), (3, 7, "dan", ""), (4, 0, "solo", "talk"),
    ]
    schema = "conv_id long, turn long, role string, text string, speaker string, part int"
    df = spark.createDataFrame([(*t, "s", 1) for t in turns], schema)
    rows = chat_format.perspectives(df).collect()
    want = perspectives(turns)
    assert {(r["conv_id"], r["speaker"]): (r["text"], r["mask"]) for r in rows} == want
    for r in rows:
        ends = {r["text"][s["start"] : s["end"]] for s in r["spans"]}
        assert all(e.endswith("<|end|>") for e in ends) and len(r["spans"]) == r["mask"].count("1") == r["n_own"]
    parted = chat_format.perspectives(df, part_turns=2).collect()
    joined = {}
    for r in sorted(parted, key=lambda r: (r["part"], r["piece"])):
        key = r["conv_id"], r["speaker"]
        joined[key] = joined.get(key, "") + r["text"]
    assert joined == {k: t for k, (t, _) in want.items()}
    assert chat_format.perspectives(df.limit(0)).count() == 0
    loose = spark.createDataFrame([(None, None, "ann", "a"), (None, 0, "bob", "b")], "conv_id long, turn long, role string, text string")
    assert chat_format.perspectives(loose).count() == 4


def test_hot_parts_of_conversations(spark):
    """A third of all rows under one turn number, others under none, one very long text: pieces stay small and whole."""
    draw = random.Random(4)
    turns = [(None, 7, draw.choice("ab"), f"same number {i}") for i in range(700)] + [(1, None, draw.choice("ab"), f"no number {i}") for i in range(300)]
    turns += [(2, i, "a", f"turn {i}") for i in range(90)] + [(2, 5, "b", "x" * 100_000)] + [(2, 6, "a", "again")] * 50
    rows = chat_format.perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), part_turns=16).collect()
    joined = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["piece"])):
        text, mask = joined.get((r["conv_id"], r["speaker"]), ("", ""))
        joined[r["conv_id"], r["speaker"]] = text + r["text"], mask + r["mask"]
    assert joined == perspectives(turns)
    assert max(r["n_turns"] for r in rows) <= 40 and sum(r["piece"] > 0 for r in rows) > 50


def brute_segments(scores):
    """Maximal segments by their recursive definition: the best run, then both sides of it."""
    best, where = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, where = total, (i, j + 1)
    if where is None:
        return []
    i, j = where
    return brute_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_maximal_segments():
    draw = np.random.default_rng(2)
    for _ in range(150):
        scores = draw.normal(-0.3, 1, draw.integers(0, 25))
        got, want = toxic_segments.segments(scores), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_nearest_takes_the_first_of_equals():
    draw = np.random.default_rng(3)
    cosines = draw.integers(0, 4, (200, 40)) / 4
    for k in (1, 7, 40):
        want = [sorted(sorted(range(40), key=lambda j: (-row[j], j))[:k]) for row in cosines]
        assert quality_knn.nearest(cosines, k).tolist() == want


def brute_bag(text, model):
    """A document's weighted terms, from their definition, as a plain dictionary."""
    import xxhash

    found = {}
    for word in space_words(text):
        raw = word.encode()
        kinds = "".join("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or ord(c) > 127 else "0" if "0" <= c <= "9" else c for c in raw.decode("latin-1"))
        runs = "".join(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        for term in (xxhash.xxh3_64_intdigest(low) % 4096, 4096 + xxhash.xxh3_64_intdigest(runs.encode("latin-1")) % 1024):
            found[term] = found.get(term, 0) + 1
    for term in quality_knn.level_terms(quality_rules.measure(text)):
        found[5120 + term] = 1
    out = {t: (1 + math.log(n)) * model.idf[t] for t, n in found.items()}
    for low, high, weight in ((0, 4096, 0.4), (4096, 5120, 1.0), (5120, 5632, 1.2)):
        size = math.sqrt(sum(v * v for t, v in out.items() if low <= t < high))
        out |= {t: v * weight / size for t, v in out.items() if low <= t < high}
    return out


def test_quality_query_against_brute_force(spark, small):
    """Every score of the query from plain cosines and votes; document frequencies and latent space too."""
    got = {r["doc_id"]: r["score"] for r in registry.op4_quality_knn(spark, SMALL).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    model = quality_knn.fit(words.documents(spark, SMALL), spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = dict(small)
    sample = sorted(d for d, y in labels.items() if d in texts and y in (0, 1) and crc(str(d)) % 5)
    assert [labels[d] for d in sample] == model.labels.tolist()
    df = np.zeros(quality_knn.TERMS)
    terms = quality_knn.Terms()
    for _, t in small:
        df[terms.count(t)[0]] += 1
    assert np.allclose(model.idf, np.log((1 + len(small)) / (1 + df)) + 1)
    x = np.zeros((len(sample), quality_knn.TERMS))
    for i, d in enumerate(sample):
        for term, v in brute_bag(texts[d], model).items():
            x[i, term] = v
    _, values, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[: min(quality_knn.RANK, (values > 1e-4).sum())].T
    unit = lambda z: z / np.linalg.norm(z, axis=-1, keepdims=True)
    sampled = unit(x @ axes)
    for d, t in small:
        row = np.zeros(quality_knn.TERMS)
        for term, v in brute_bag(t, model).items():
            row[term] = v
        counted = [terms.count(t)]
        whole = [int(v) for v in model.latent(counted)[0]]
        exact = [sum(a * int(b) for a, b in zip(whole, v)) / quality_knn.ONE**2 for v in model.vectors]
        assert np.abs(np.array(exact) - sampled @ unit(row @ axes)).max() < 1e-5
        near = sorted(range(len(sample)), key=lambda j: (-exact[j], j))[: quality_knn.NEIGHBOURS]
        weights = [max(exact[j], 1e-6) ** 4 for j in near]
        want = sum(w * labels[sample[j]] for w, j in zip(weights, near)) / sum(weights)
        assert abs(got[d] - want) < 1e-12


def test_quality_scores_do_not_hang_on_blocks(spark, small, monkeypatch):
    model = quality_knn.fit(words.documents(spark, SMALL), spark.read.parquet(f"{SMALL}/labels.parquet"))
    terms = quality_knn.Terms()
    counted = [terms.count(t) for _, t in small]
    whole = model.score(counted).tolist()
    monkeypatch.setattr(quality_knn, "BLOCK", 7)
    monkeypatch.setattr(quality_knn, "GATHER", 500)
    assert model.score(counted).tolist() == whole == [float(model.score([c])[0]) for c in counted]


def test_quality_of_repeated_ids(spark):
    """The smallest text under a labelled id is learnt from, in whatever order rows come."""
    rows = [(i, f"text {i} {'good words ' * 9 if i % 2 else '# $ %'}") for i in range(40)] + [(1, "zz other"), (2, "aa other"), (2, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    runs = []
    for order in (rows, rows[::-1]):
        found = quality_knn.score(spark.createDataFrame(order, "doc_id long, text string"), labels).collect()
        runs.append(sorted((r["doc_id"], r["score"]) for r in found))
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)


def test_toxicity_query_against_brute_force(spark, small):
    """Every score of the query from plain counts, recursive segments and a plain logistic fit."""
    import xxhash

    got = {r["doc_id"]: r["score"] for r in registry.op5_toxic_segments(spark, SMALL).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    sample = {d: labels[d] for d, _ in small if labels.get(d) in (0, 1) and crc(str(d)) % 5}
    size, m = toxic_segments.BUCKETS, toxic_segments
    keys = lambda w: [(0, xxhash.xxh3_64_intdigest(w, 1) % size), (1, xxhash.xxh3_64_intdigest(w[:4], 4) % size), (2, xxhash.xxh3_64_intdigest(w[:5], 5) % size)]
    counts = [{}, {}, {}]
    for d, t in small:
        for w in {w.encode() for w in alnum_words(t)}:
            for k in keys(w):
                for which in (0, *([1 + sample[d]] if d in sample else [])):
                    counts[which][k] = counts[which].get(k, 0) + 1
    sums = [[sum(n for (f, _), n in c.items() if f == kind) for c in counts] for kind in range(3)]
    everywhere = [sums[k][0] + 0.01 * size for k in range(3)]

    def bucket_score(k):
        kind, (corpus, clean, toxic) = k[0], (c.get(k, 0) for c in counts)
        if toxic < 2:
            return -m.DRIFT
        alpha = m.PRIOR * (corpus + 0.01) / everywhere[kind]
        t, c, all_t, all_c = toxic + alpha, clean + alpha, sums[kind][2] + m.PRIOR, sums[kind][1] + m.PRIOR
        return min(8, math.log(t / (all_t - t)) - math.log(c / (all_c - c)) - m.BELOW * math.sqrt(1 / t + 1 / c))

    def word_score(w):
        best = max(map(bucket_score, keys(w.encode())))
        return best if best >= m.LEAST else -m.DRIFT

    spread = {}
    for k in counts[0]:
        if k[0] == 0:
            s = bucket_score(k)
            s = round(s, 12) if s >= m.LEAST else -m.DRIFT
            spread[s] = spread.get(s, 0) + counts[1].get(k, 0) + m.PRIOR * (counts[0][k] + 0.01) / everywhere[0]
    empty = size - sum(k[0] == 0 for k in counts[0])
    spread[-m.DRIFT] = spread.get(-m.DRIFT, 0) + empty * m.PRIOR * 0.01 / everywhere[0]
    total, low, high = sum(spread.values()), 1e-4, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(p / total * math.exp(mid * s) for s, p in spread.items()) < 1 else (low, mid)
    found = {}
    for d, t in small:
        scores = [word_score(w) for w in alnum_words(t)]
        where = [i for i, s in enumerate(scores) if s > 0]
        # Far apart positive words cannot share a segment, so the recursion looks at runs of them.
        runs, reach = [], 0.0
        for i in where:
            if runs and (i - runs[-1][1] - 1) * m.DRIFT < reach:
                reach -= (i - runs[-1][1] - 1) * m.DRIFT
                runs[-1][1] = i
            else:
                runs.append([i, i])
                reach = 0.0
            reach += scores[i]
        found[d] = len(scores), [(a + x, a + y, s) for a, b in runs for x, y, s in brute_segments(np.array(scores[a : b + 1]))]
    clean = [d for d, y in sample.items() if not y]
    k = (sum(s >= m.LEAST for d in clean for *_, s in found[d][1]) + 0.5) * math.exp(low * m.LEAST) / (sum(found[d][0] for d in clean) + 1)

    def statistic(d):
        n, segments = found[d]
        expected = [k * n * math.exp(-low * s) for *_, s in segments]
        return sum(-math.log(-math.expm1(-e)) if e > 1e-12 else -math.log(max(e, 1e-300)) for e in expected if e <= m.SIGNIFICANT)

    points = [(math.log1p(round(statistic(d), 3)), y) for d, y in sample.items()]
    w = np.zeros(2)
    for _ in range(50):
        slope = np.zeros(2) - 1e-3 * w
        bend = 1e-3 * np.eye(2)
        for x, y in points:
            p, v = 1 / (1 + math.exp(-max(-30, min(30, w[0] * x + w[1])))), np.array([x, 1.0])
            slope, bend = slope + v * (y - p), bend + p * (1 - p) * np.outer(v, v)
        w = w + np.linalg.solve(bend, slope)
    for d, _ in small:
        want = 1 / (1 + math.exp(-max(-30, min(30, w[0] * math.log1p(statistic(d)) + w[1]))))
        assert abs(got[d] - want) < 1e-3, d


def _accuracy(spark, rows, label, at):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all((r["score"] >= at) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows)
    return sum(p == y for p, y in held) / len(held)


def test_quality_classifier(spark, awkward, empty):
    rows = registry.op4_quality_knn(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and _accuracy(spark, rows, "quality", 0.3) >= 0.95
    assert all(r["held_out"] == (crc(str(r["doc_id"])) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in AWKWARD], "doc_id long, quality int")
    assert quality_knn.score(awkward, labels).filter("score BETWEEN 0 AND 1").count() == awkward.count()
    assert quality_knn.score(empty, labels).count() == 0
    assert quality_knn.score(awkward, labels.limit(0)).filter("score <> 0.5").count() == 0


def test_toxicity(spark, awkward, empty):
    rows = registry.op5_toxic_segments(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and _accuracy(spark, rows, "toxic", 0.5) >= 0.9
    labels = spark.createDataFrame([(i, i % 2) for i, _ in AWKWARD], "doc_id long, toxic int")
    assert toxic_segments.score(awkward, labels).filter("score BETWEEN 0 AND 1").count() == awkward.count()
    assert toxic_segments.score(empty, labels).count() == 0
    assert toxic_segments.score(awkward, labels.limit(0)).filter("score <> 0.5").count() == 0
