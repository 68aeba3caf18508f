from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexispark.llm import components, simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in lowered + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{doc_id: smallest doc_id reachable} of (doc_id, fingerprint) by all pairs."""
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if i < j and bin(a ^ b).count("1") <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in prints}


def test_fingerprint_is_brute_force():
    rng = random.Random(2)
    for text in [None, "", " \t", "One", "one TWO", "a b c", "a b c d", "É é x\x85y z \x1c q", "same " * 50]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    for _ in range(40):
        text = " ".join(rng.choice("the of and in on at by to".split()) for _ in range(rng.randrange(1, 90)))
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_query_on_whole_table_is_brute_force(spark, sf_dir):
    from lexispark.llm.queries_text import op3_simhash

    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_components(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in docs}


def near_prints(rng, n):
    """Clusters, chains and strangers."""
    prints = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(prints) < n:
        f = rng.choice(prints)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 5])):
            f ^= 1 << rng.randrange(64)
        prints.append(f)
    return prints


def test_links_and_components_are_brute_force(spark):
    rng = random.Random(9)
    prints = sorted({simhash.signed(f) for f in near_prints(rng, 500)})
    edges = simhash.link_edges(spark.createDataFrame([(f,) for f in prints], "fp bigint"))
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    want = brute_components([(f, f & (1 << 64) - 1) for f in prints])
    assert {f: roots.get(f, f) for f in prints} == want


def test_forest_by_masks_is_the_same_partition():
    rng = random.Random(4)
    base = rng.getrandbits(63)
    members = np.unique(np.array([base ^ rng.getrandbits(24) & rng.getrandbits(24) & rng.getrandbits(24) for _ in range(400)], dtype=np.int64))

    def groups(edges):
        parent = {int(m): int(m) for m in members}
        for a, b in edges:
            parent[a] = b
        return parent

    assert groups(simhash.forest(members)) == groups(simhash._forest_by_masks(members, 3))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text.upper()), (9, None), (8, " "), (None, text), (None, "other words stand here alone"), (2, "long " * 20_000), (2, "long " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, fp int, component_id string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got[:6] == [("2", 2), ("2", 2), ("3", 3), ("5", 3), ("8", 8), ("9", 8)]
    assert {c for _, c in got[6:]} == {None, 3}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "8", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_shingles(text, words=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    own = [w for w in lowered.split(" ") if w]
    return {" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def brute_similar(docs, similarity=0.8):
    """{doc_id: smallest doc_id reachable} by the Jaccard similarity of all pairs."""
    sets = {i: brute_shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or len(a & b) >= similarity * len(a | b)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in sets}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_similar_documents_are_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(500)]
    docs, passage = [], rng.choices(vocabulary, k=60)
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randrange(4, 150))
        if rng.random() < 0.4:
            base += passage  # shared by many documents that are not near copies
        docs += [(len(docs) + n, " ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3])))) for n in range(rng.choice([1, 1, 2, 5, 9]))]
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, " \t"), (len(docs) + 3, "one two"), (len(docs) + 4, "One  TWO")]
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], "doc_id bigint, text string, fp int, n int, hashes int, values int").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
    assert got == brute_similar(docs)


def test_long_lists_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_MEMBERS", 16)
    rng = random.Random(3)
    base = rng.choices([f"w{i}" for i in range(900)], k=300)
    docs = [(i, " ".join(edited(rng, base, rng.randrange(1, 6)))) for i in range(120)] + [(200, "something else that stands alone here")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
    assert got == brute_similar(docs) and set(got.values()) == {0, 200}


def test_similar_documents_on_a_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_similar([(r.doc_id, r.text) for r in table.collect()])
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()} == want


def test_keep_first_with_clashing_columns_and_edges(spark):
    text = "some quite ordinary words that stand in one line for this test"
    schema = "doc_id bigint, text string, _key string, _hash int, fp int, id int, body int, shown int, digest int, component_id int, rows int"
    rows = [(i, t, "k", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in [(4, text), (2, text + " again"), (2, text + " again"), (None, "alone here"), (7, None)]]
    docs = spark.createDataFrame(rows, schema)
    kept = simhash.keep_first(docs, similarity=0.8)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r._key) for r in kept.collect()) == [("2", "k"), ("7", "k"), ("None", "k")]
    assert simhash.keep_first(docs).count() == 4  # the last word is more than 3 bits
    empty = spark.createDataFrame([], schema)
    assert simhash.keep_first(empty).count() == simhash.keep_first(empty, similarity=0.8).count() == simhash.similar_documents(empty).count() == 0


def templated(rng, n, groups=1, share=85, size=100):
    """Pairs at a similarity of 0.818 among texts that share a template of 85 % (0.739 to all others)."""
    docs = []
    for g in range(groups):
        template = [f"t{g}x{i}" for i in range(share + 4)]
        for p in range(n // groups):
            kept = [f"k{g}x{p}x{i}" for i in range((size - share) // 3)]
            docs += [template + kept + [f"o{g}x{p}x{side}x{i}" for i in range(size - share - len(kept))] for side in (0, 1)]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("bound", [4096, 16])
def test_templates_lose_no_pair(spark, monkeypatch, bound):
    # lists of one template are long, and a text's partner is hardly nearer than the others
    monkeypatch.setattr(simhash, "LIST_MEMBERS", bound)
    docs = templated(random.Random(1), 150)
    sets = [brute_shingles(t) for _, t in docs[:4]]
    near, far = (len(sets[0] & s) / len(sets[0] | s) for s in (sets[1], sets[2]))
    assert near >= 0.8 > 0.75 > far
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == {i: i - i % 2 for i, _ in docs} == brute_similar(docs)


def test_the_exact_filter_alone_finds_all_pairs(spark, monkeypatch):
    # nothing from the samples: every link comes through the prefixes
    monkeypatch.setattr(simhash, "similar_edges", lambda signed_, similarity: signed_.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, t) for i, t in templated(rng, 20)]
    for _ in range(50):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 8, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 4])):
            own = edited(rng, base, rng.choice([0, 1, 2, 3]))
            docs.append((len(docs), " ".join(own + rng.choices(vocabulary, k=rng.choice([0, 0, 1, 5, 14])))))
    docs += [(len(docs), ""), (len(docs) + 1, None)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_similar(docs)


def test_template_lists_lead_to_few_pairs(spark):
    docs = spark.createDataFrame(templated(random.Random(3), 200), "doc_id bigint, text string")
    prints = simhash.signatures(docs, key="doc_id", text="text", words=5).cache()
    postings = simhash.prefix_postings(docs, simhash.shingle_counts(prints), text="text", words=5, similarity=0.8).cache()
    longest = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("small").cast("int")).alias("small")).agg(F.max("n"), F.max("small")).first()
    assert longest[0] == 400 and longest[1] <= 2  # the template is in every list as the larger side alone
    nobody = spark.createDataFrame([], "node bigint, root bigint")
    assert simhash.left_out_pairs(postings, nobody, 0.8).count() == 200


def test_counters_do_not_change_the_result(spark, monkeypatch):
    docs = templated(random.Random(4), 40, groups=4)
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    for counters in ((1, 1), (64, 64)):
        monkeypatch.setattr(simhash, "COUNTERS", counters)
        monkeypatch.setattr(simhash, "COUNT_AT_A_TIME", 500)
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
        assert got == {i: i - i % 2 for i, _ in docs}
