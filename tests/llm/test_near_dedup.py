"""Near-duplicates against all pairs, on a small table."""

import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string"


def brute(texts: dict[int, str | None]) -> dict[int, int]:
    """The smallest id of each id's component under exact links, by comparing every pair."""

    def grams(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: grams(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        a, b = sets[i], sets[j]
        if (texts[i] or "") == (texts[j] or "") or a and len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((root(i), root(j)))
            label[y] = x
    return {i: root(i) for i in texts}


def vary(rng, words, share):
    return " ".join("w%d" % rng.integers(1e6) if rng.random() < share else w for w in words)


def made() -> dict[int, str | None]:
    rng = np.random.default_rng(3)
    draw = lambda n: ["w%d" % x for x in rng.integers(0, 5000, n)]
    texts: dict[int, str | None] = {}
    base = draw(120)
    for _ in range(60):  # near copies around one base, some past the threshold
        texts[len(texts)] = vary(rng, base, rng.random() * 0.06)
    texts[len(texts)] = " ".join(base)
    chain = draw(300)
    for k in range(8):  # a chain: neighbours are alike, the ends are not
        chain = chain[6:] + draw(6)
        texts[len(texts)] = " ".join(chain)
    for _ in range(60):
        texts[len(texts)] = " ".join(draw(rng.integers(1, 200)))
    for t in (None, "", "", "one", "One!", "...", "???", " ".join(draw(60_000))):
        texts[len(texts)] = t
    return texts


def frame(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_classes_equal_all_pairs(spark):
    texts = made()
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute(texts)


def test_one_row_of_each_class_stays(spark):
    texts = made()
    kept = nd.keep_one(frame(spark, texts).union(frame(spark, texts)))
    assert kept.columns == list(nd.DOCUMENT_COLUMNS)
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert sorted(got) == sorted(set(brute(texts).values())) and kept.count() == len(got)
    assert all((texts[i] or "") == (t or "") for i, t in got.items())


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e f", None, None, None, "x"), (7, "a b c d e f", None, None, None, "x"), (7, "a b c d e f", None, None, None, "x"), (None, "other words stand here now", None, None, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["class_size"]) for r in nd.near_duplicates(docs).collect())
    assert got == [(-1, -1, 1), (-1, 7, 3), (7, 7, 3), (7, 7, 3)]
    assert sorted(r["text"] for r in nd.keep_one(docs).collect()) == ["a b c d e f", "other words stand here now"]
    assert nd.near_duplicates(docs.limit(0)).count() == 0 and nd.keep_one(docs.limit(0)).count() == 0


def test_marks_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 400, dtype=np.uint64)
    w = 1 + rng.exponential(1, 400)
    a, b = (np.sort(keys[:300]), w[:300]), (np.sort(keys[100:]), w[100:])
    sa, sb = nd.signatures([a, b], 4000)
    assert abs((sa == sb).mean() - nd.probability_jaccard(a, b)) < 0.03
    same = (a[0], np.ones(300)), (b[0], np.ones(300))
    assert abs(nd.probability_jaccard(*same) - nd.jaccard(a[0], b[0])) < 1e-9


def test_components_of_a_long_path(spark):
    edges = [(bytes([0] * 15 + [i]), bytes([0] * 15 + [i + 1])) for i in range(40)] + [(b"z" * 16, b"y" * 16)]
    got = {bytes(r["node"]): bytes(r["label"]) for r in nd.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert len(got) == 43 and all(v == (b"y" * 16 if k[0] else bytes(16)) for k, v in got.items())


def test_components_of_nothing(spark):
    assert nd.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_hot_bucket_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "PART_PAIRS", 3)
    texts = made()
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute(texts)


def test_repeats_do_not_hide_links(spark):
    rng = np.random.default_rng(11)
    texts: dict[int, str | None] = {}
    for n, line, times in [(100, 30, 50), (40, 20, 20), (200, 60, 20), (60, 40, 200)] * 5:
        head, repeated = (["w%d" % x for x in rng.integers(0, 10**6, k)] for k in (n, line))
        for k in (1, times):  # one set of shingles but for those across the joints, very unequal counts
            texts[len(texts)] = " ".join(head + repeated * k)
    want = brute(texts)
    assert len(set(want.values())) <= len(texts) * 3 // 4
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(frame(spark, texts)).collect()} == want


def test_low_bytes_do_not_choose_the_band(spark):
    """An earlier band whose marks agree in their low bytes only is no bucket of the pair."""
    a, b, marks = bytes(16), b"b" * 16, bytes(nd.M)
    one, other = list(range(100, 100 + nd.BANDS)), list(range(200, 200 + nd.BANDS))
    one[5], one[9] = other[5], other[9] = 7, 8  # all bands agree in low bytes, only these have one key
    signed = spark.createDataFrame([(a, 1, 100, marks, one), (b, 1, 90, marks, other)], "node binary, copies long, size long, marks binary, bands array<long>")
    none = spark.createDataFrame([], "node binary, label binary")
    got = nd.cross_pairs(nd.shared_buckets(signed), signed, none, nd.LEAST_ESTIMATE).collect()
    assert [{bytes(r["a"]), bytes(r["b"])} for r in got] == [{a, b}]


def measured(spark, texts):
    """Of the pairs that comparing all finds linked, the share that ends in one class."""
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(frame(spark, texts)).collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in texts.items() for w in [re.findall(r"[^\W_]+", (t or "").lower())] if w}
    linked = [(i, j) for i, j in combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return len(linked), sum(got[i] == got[j] for i, j in linked) / max(1, len(linked)), got


def test_recall_with_repeated_shingles(spark):
    """Pairs of 400 common words and 20 other words that are repeated 40 times: alike as sets, unlike as counts."""
    rng = np.random.default_rng(5)
    draw = lambda n: ["w%d" % x for x in rng.integers(0, 10**6, n)]
    texts: dict[int, str | None] = {}
    for _ in range(60):
        common = draw(400)
        for _ in range(2):
            texts[len(texts)] = " ".join(common + draw(20) * 40)
    n, recall, got = measured(spark, texts)
    assert n == 60 and recall == 1 and got == brute(texts)


def test_sizes_split_buckets_without_loss(spark, monkeypatch):
    """Growing texts: each linked to the next by size alone at the limit, all in shared buckets."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    words = ["w%d" % i for i in range(4000)]
    sizes = [round(100 * 1.118**k) for k in range(20)]
    texts = {k: " ".join(words[: n + 4]) for k, n in enumerate(sizes)} | {20 + k: " ".join(words[: n + 4] + [f"x{k}"]) for k, n in enumerate(sizes)}
    n, recall, got = measured(spark, texts)
    assert n > 40 and recall == 1 and got == brute(texts)
    for a, b in ((100, 80), (1000, 800), (125, 100), (5, 4), (10**6, 8 * 10**5)):  # at the very limit: not further than one class
        classes = [int(np.floor(np.log(x) / (np.log(1 / nd.THRESHOLD) + 1e-9))) for x in (a, b)]
        assert classes[0] - classes[1] in (0, 1)


def test_no_table_is_left_in_the_catalogue(spark):
    before = {t.name for t in spark.catalog.listTables()}
    texts = nd.distinct_texts(spark.createDataFrame([(b"a" * 16, "x"), (b"b" * 16, "y"), (b"a" * 16, "x")], "node binary, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted((bytes(r["node"])[:1], r["copies"]) for r in texts.collect()) == [(b"a", 2), (b"b", 1)]
    joined = texts.join(texts.selectExpr("node as n", "text as t"), texts["node"] == F.col("n"))
    assert joined.count() == 2
