"""Best-fit packing: against a plain search, and its invariants."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandworks.llm import packing as pk


def plain(sizes, capacities):
    """The cheapest of the plain packings by least opened length."""
    tried = [plain_once(sizes, capacities, capacities[k:]) for k in range(len(capacities))]
    return min(tried, key=lambda x: round(sum(map(pk.cost, x[1])), 6))


def plain_once(sizes, capacities, opened):
    """The same rule, looking at every open bin and every piece to come."""
    bins, out = [], []

    def costs(c, size, rest):
        held, left = size, c - size
        for r in sorted(rest, reverse=True):
            if r <= left:
                held, left = held + r, left - r
        return pk.cost(c) / held, c

    for k, size in enumerate(sizes):
        fitting = [(cap - used - size, -last, b) for b, (cap, used, last) in enumerate(bins) if cap - used >= size]
        if fitting:
            b = min(fitting)[2]
        else:
            b = len(bins)
            bins.append([min((costs(c, size, sizes[k + 1 :]) for c in opened if c >= size))[1], 0, 0])
        bins[b][1] += size
        bins[b][2] = len(out)
        out.append(b)
    return out, [next(c for c in capacities if c >= used) for _, used, _ in bins]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_equals_plain_search(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets, lengths = pk.best_fit(np.array(sizes, np.int64), (8, 16, 32, 64))
    want, want_lengths = plain(sizes, (8, 16, 32, 64))
    assert bins.tolist() == want and lengths.tolist() == want_lengths
    for b in range(len(lengths)):
        spans = sorted((o, o + s) for o, s, x in zip(offsets.tolist(), sizes, bins.tolist(), strict=True) if x == b)
        assert spans[0][0] == 0 and all(p[1] == q[0] for p, q in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= lengths[b]


def documents(spark, counts):
    rows = [(i, None if n is None else "w " * n, "x") for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "doc_id long, text string, BIN string")


def test_every_token_once(spark):
    rng = np.random.default_rng(1)
    counts = [None, 0, 1, 512, 4096, 4097, 12_288, 50_000, *rng.integers(1, 900, 300).tolist()]
    docs = documents(spark, counts)
    got = pk.pack_documents(docs.union(docs.limit(3)), block_pieces=60).collect()
    seen: dict[int, int] = {}
    bins: dict[tuple, list] = {}
    for r in got:
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["n_tokens"]
        if r["n_tokens"]:
            assert r["bin_length"] in pk.CAPACITIES
            bins.setdefault((r["block"], r["bin"], r["bin_length"]), []).append((r["bin_offset"], r["n_tokens"]))
        else:
            assert r["block"] is None and r["bin"] is None
    assert seen == {i: (n or 0) * (2 if i < 3 else 1) for i, n in enumerate(counts)}
    assert len({k[0] for k in bins}) > 3 and len({k[:2] for k in bins}) == len(bins)
    for (_, _, length), parts in bins.items():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= length and not any(c >= end for c in pk.CAPACITIES if c < length)
    again = pk.pack_documents(docs.union(docs.limit(3)).repartition(7), block_pieces=60).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", "x"), (2**60 + 1, "c", "x")], "doc_id long, text string, BIN string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in pk.pack_documents(docs).collect()) == [(0, 2), (2**60 + 1, 1)]
    assert pk.pack_documents(docs.limit(0)).count() == 0


def test_little_waste(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pk.pack_documents(docs).where("n_tokens > 0")
    tokens = got.agg({"n_tokens": "sum"}).first()[0]
    slots = got.select("block", "bin", "bin_length").distinct().agg({"bin_length": "sum"}).first()[0]
    assert tokens / slots > 0.97


def test_lengths_are_chosen_by_what_is_to_come():
    for size, length in ((600, 2048), (500, 1024), (1300, 4096), (900, 1024)):  # three in 2,048, two in 1,024, three in 4,096, one in 1,024
        lengths = pk.best_fit(np.full(60, size))[2]
        assert (lengths == length).mean() > 0.9
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.choice([520, 700, 1100, 1400, 2100], 3000))[::-1]
    lengths = pk.best_fit(sizes)[2]
    alone = [pk.best_fit(sizes, (c,))[2] for c in pk.CAPACITIES if c >= 2100]
    total = lambda x: sum(pk.cost(int(n)) for n in x)
    assert total(lengths) <= min(map(total, alone))
    free = pk.pack_once(sizes, pk.CAPACITIES, pk.CAPACITIES)[2]
    assert len(set(free.tolist())) > 2  # several lengths are opened, not one


def test_equal_rows_are_dealt_over_blocks(spark):
    docs = spark.range(30_000).selectExpr("1L as doc_id", "repeat('w ', 100) as text", "'x' as BIN")
    got = pk.pack_documents(docs, block_pieces=1000).groupBy("block").count().collect()
    assert sum(r["count"] for r in got) == 30_000 and len(got) == 30 and max(r["count"] for r in got) < 1300
