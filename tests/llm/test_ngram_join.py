"""The n-gram Jaccard join against all pairs."""

import random
import re

import pyarrow as pa
import pytest

from strandworks.llm import ngram_join as nj
from strandworks.llm.wordhash import WordHasher

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def plain(rows, share=(85, 100)):
    """Every pair, one by one."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * share[1] >= (len(sets[i]) + len(sets[j]) - both) * share[0]:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows, **k):
    return sorted((tuple(r) for r in nj.ngram_components(spark.createDataFrame(rows, SCHEMA), **k).collect()), key=str)


def drawn(seed, n=220):
    """Texts of a few families: copies, edits of up to a sixth of the words, chains, shared passages, short ones."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    bases = [[word() for _ in range(r.choice([3, 8, 40, 120, 400]))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        if r.random() < 0.3:
            w = [word() for _ in range(r.randrange(1, 150))]
        if r.random() < 0.6:
            for _ in range(r.randrange(0, max(1, len(w) // 18) + 1)):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1])] = [word()]
        if r.random() < 0.2:
            w = w + passage
        sep = r.choice([" ", "\n", " \t "])
        rows.append((i, sep.join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed, monkeypatch):
    if seed:  # small batches and fragments: tokens common in a batch, many fragments
        monkeypatch.setattr(nj, "BATCH", 2000)
        monkeypatch.setattr(nj.cut, "__defaults__", (2000, 5))
    rows = drawn(seed)
    want = plain(rows)
    assert len({c for _, _, c in want}) < len(rows) - 40
    assert run(spark, rows, fragment_bytes=5000 if seed else nj.FRAGMENT_BYTES) == want


def test_words_over_the_borders_of_texts_and_pieces(monkeypatch):
    monkeypatch.setattr("strandworks.llm.wordhash.PIECE", 50)
    texts = ["ab cd", "ef", "", None, "gh  Ab\tEF ", "x" * 200 + " ab " + "y " * 90, "é ab ɸ", "cd"]
    for column in (pa.array(texts), pa.array(["zz", *texts])[1:], pa.array(texts, pa.large_string())):
        seen, names = {}, {}
        at = 0
        for lo, hi, hashes, counts in WordHasher(nj.SPACES)(column):
            assert lo == at and hi - lo == len(counts)
            at, k = hi, 0
            for i in range(lo, hi):
                words = (texts[i] or "").translate(LOWER).split()
                assert counts[i - lo] == len(words)
                for w, h in zip(words, hashes[k : k + len(words)].tolist(), strict=True):
                    assert seen.setdefault(w, h) == h and names.setdefault(h, w) == w
                k += len(words)
        assert at == len(texts)


def test_just_at_the_threshold(spark):
    """Sets of 100 with 85 of a union of 100, and with one less."""
    words = [f"a{i}" for i in range(103)]
    whole, most, less = " ".join(words), " ".join(words[:88]), " ".join(words[:87])
    assert [c for _, _, c in run(spark, [(1, whole), (2, most)])] == [1, 1]
    assert [c for _, _, c in run(spark, [(1, whole), (2, less)])] == [1, 2]


def test_a_chain_is_one_component(spark):
    words = [f"a{i}" for i in range(160)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(12)]
    assert run(spark, rows) == plain(rows)
    assert {c for _, _, c in plain(rows)} == {0}


def test_nulls_repeats_and_other_columns(spark):
    rows = [(5, "one two three four five"), (5, "ONE two  three four five"), (None, "one two three four five"), (None, "alone here with these words"), (3, None), (4, ""), (None, None), (7, "x"), (6, "x"), (8, "x y"), (9, "   ")]
    found = run(spark, rows)
    assert found == plain(rows)
    clash = spark.createDataFrame([(1, "a b c d", "n", 2, "t")], "doc_id long, text string, node string, size int, token string")
    assert [tuple(r) for r in nj.ngram_components(clash).collect()] == [(1, 1, 1)]
    assert run(spark, []) == []


def test_many_copies_and_near_copies(spark):
    """A third of all rows is one text, a third differs from it in a few words each."""
    r = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(1200)]
    for i in range(1200, 1500):
        w = list(base)
        for _ in range(3):
            w[r.randrange(200)] = f"e{i}.{r.random()}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"u{r.randrange(10**6)}" for _ in range(60))) for i in range(1500, 1600)]
    got = {d: (n, c) for d, n, c in run(spark, rows)}
    assert all(got[d][1] == 0 for d in range(1500)) and all(got[d][1] == d for d in range(1500, 1600))


def broadcasts(plan):
    """Of a plan that has run: what stands below each broadcast."""

    def below(p):
        name = p.nodeName()
        kids = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        found = [below(k) for k in kids]
        names = [name, *(x for names, _ in found for x in names)]
        return names, [x for _, own in found for x in own] + ([names] if name == "BroadcastExchange" else [])

    return below(plan)[1]


def test_rows_dealt_out_in_copies_are_not_broadcast(spark, monkeypatch):
    """A pair has a row for each piece, and Spark takes them all for the size of the pairs."""
    seen, written = {}, nj.written

    def watched(df, name):
        df.collect()
        seen.setdefault(name, []).append(broadcasts(df._jdf.queryExecution().executedPlan()))
        return written(df, name)

    monkeypatch.setattr(nj, "written", watched)
    rows = drawn(0)
    assert run(spark, rows) == plain(rows)
    assert len(seen["overlaps"]) == len(seen["pairs"]) == 2
    assert not [(name, names) for name, plans in seen.items() for plan in plans for names in plan if "Generate" in names]
    assert not seen["pairs"][0]  # nor the hubs, of which there is one for each shingle


def test_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in nj.op11_ngram_join(spark, sf).collect()), key=str) == plain(rows)
