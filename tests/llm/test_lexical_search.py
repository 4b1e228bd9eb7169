"""Ranked search against scoring every document, and the trie's bounds against the documents below."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from strandworks.llm import lexical_search as ls

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, top=20):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for d, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item_id, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **k):
    return sorted((tuple(r) for r in ls.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **k).collect()), key=str)


def drawn(seed, n=300):
    r = random.Random(seed)
    word = lambda: f"t{int(r.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 20, 60, 300])))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)] + [(3, docs[5][1].upper()), (None, docs[7][1]), (None, None), (n + 40, "...")]
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 8, 40])))) for i in range(25)]
    return docs, [*items, items[0], (0, "t1 t1, T2"), (90, None), (91, "unknownword"), (None, "t1"), (92, docs[7][1])]


@pytest.mark.parametrize("seed", range(3))
def test_equals_scoring_every_document(spark, seed, monkeypatch):
    docs, items = drawn(seed)
    if seed:  # small trees and leaves, several blocks of items
        monkeypatch.setattr(ls, "TREE_DOCS", 70)
        monkeypatch.setattr(ls.Tree.__init__, "__defaults__", (2,))
    assert run(spark, docs, items, item_terms_of_a_block=40 if seed == 2 else ls.ITEM_TERMS) == plain(docs, items)


def test_empty_tables_and_other_columns(spark):
    docs, items = drawn(1, 40)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, [(1, None), (2, "--")], items) == []
    clash = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, item string, score int")
    asked = spark.createDataFrame([("k", "B c", 7)], "item_id string, text string, rank int")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in ls.search(clash, asked).collect()] == [("k", 1, 1)]


def made_tree(seed, leaf):
    r = np.random.default_rng(seed)
    n, width = 400, 60
    sets = [np.unique((width * r.power(0.4, r.integers(1, 25))).astype(int)) for _ in range(n)]
    sets[10:60] = [sets[10]] * 50
    tfs = [r.integers(1, 9, len(s)) for s in sets]
    m = r.integers(75, 400, n)
    counts = np.bincount(np.concatenate(sets), minlength=width)
    rank = np.argsort(np.argsort(-counts, kind="stable"))
    return ls.Tree(list(range(n)), sets, tfs, m, rank, leaf), sets, tfs, m


@pytest.mark.parametrize(("seed", "leaf"), [(0, 1), (1, 4), (2, 24)])
def test_nodes_part_the_documents_and_bound_them(seed, leaf):
    tree, sets, _, _ = made_tree(seed, leaf)
    assert (tree.first[0], tree.last[0]) == (0, len(sets)) and sorted(tree.ids) == list(range(len(sets)))
    for at, children in enumerate(tree.children):
        a, b = tree.first[at], tree.last[at]
        assert (tree.bound[at] >= tree.exact[a:b].max(0)).all()
        if children:
            assert [tree.first[c] for c in children] + [b] == [a] + [tree.last[c] for c in children]
        else:
            assert b - a <= leaf or tree.paths[a] == tree.paths[b - 1]
    for i, doc in enumerate(tree.ids):  # the path is the set, and shares beginnings
        assert len(tree.paths[i]) == 4 * len(sets[doc])


def test_search_leaves_out_documents_but_no_results():
    tree, sets, tfs, m = made_tree(3, 4)
    rare = np.array([57, 58, 59, 40])
    weights = np.array([4000.0, 5000.0, 4500.0, 10.0])
    best: list = []
    scored = tree.search(rare, weights, best, 5)
    want = []
    for d, (s, k) in enumerate(zip(sets, tfs, strict=True)):
        tf = dict(zip(s.tolist(), k.tolist(), strict=True))
        score = sum(int(w) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * int(m[d]))) for t, w in zip(rare.tolist(), weights, strict=True) if t in tf)
        want += [(-score, False, d)] if score else []
    assert best == sorted(want)[:5] and 0 < scored < len(sets) / 2


def test_the_registered_query_equals_plain_python_and_sql(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted((tuple(r) for r in ls.op12_lexical_search(spark, SF).collect()), key=str)
    assert got == plain(docs, items)
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(duck.execute(f"SELECT item_id, rank, doc_id, score FROM ({ls.op12_sql()})").fetchall(), key=str) == got
