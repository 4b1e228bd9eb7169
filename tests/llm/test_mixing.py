"""Mixing to target weights: fitted margins, calibrated sampling, edges."""

import math

import duckdb
import pytest

from strandworks.llm import mixing as mx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Topic string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def margins(rows, by, value):
    out: dict = {}
    for r in rows:
        out[r[by]] = out.get(r[by], 0.0) + value(r)
    whole = sum(out.values())
    return {k: v / whole for k, v in out.items()}


def test_margins_meet_the_targets(docs):
    given = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}}
    rows = mx.mix_documents(docs, given, most_sweeps=60).collect()
    fitted = margins(rows, "lang", lambda r: r["weight"] * r["tokens"])
    assert all(abs(fitted[k] - v) < 0.01 for k, v in given["lang"].items())
    plain = margins(rows, "source", lambda r: r["tokens"])
    tempered = {k: math.sqrt(v) for k, v in plain.items()}
    fitted = margins(rows, "source", lambda r: r["weight"] * r["tokens"])
    assert all(abs(fitted[k] - v / sum(tempered.values())) < 0.01 for k, v in tempered.items())


def test_many_cells_take_the_other_way(docs, monkeypatch):
    few = {r["doc_id"]: r["probability"] for r in mx.mix_documents(docs, most_sweeps=3).collect()}
    monkeypatch.setattr(mx, "SMALL_CELLS", 0)
    many = {r["doc_id"]: r["probability"] for r in mx.mix_documents(docs, most_sweeps=3).collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few)


def test_sample_has_the_target_mix(docs):
    """Expected margins are the targets, whatever the fraction; the draw is off by chance only."""
    given = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, "topic": {"prose": 0.5, "markup": 0.2}}
    for fraction in (0.05, 0.5, 1.0):
        rows = mx.mix_documents(docs, given, fraction=fraction).collect()
        assert all(0 <= r["probability"] <= 1 for r in rows)
        reached = sum(r["probability"] * r["tokens"] for r in rows) / sum(r["tokens"] for r in rows)
        most = max(r["probability"] for r in rows)
        assert reached <= fraction + 1e-9 and (abs(reached - fraction) < 1e-9 or abs(most - 1) < 1e-9)  # a full cell, or the whole fraction
        for d in mx.DIMENSIONS:
            expected = margins(rows, d, lambda r: r["probability"] * r["tokens"])
            plain = margins(rows, d, lambda r: r["tokens"])
            free = {k: v ** mx.TEMPERATURES[d] for k, v in plain.items() if k not in given.get(d, {})}
            left = 1 - sum(given.get(d, {}).values())
            want = given.get(d, {}) | {k: left * v / sum(free.values()) for k, v in free.items()}
            assert all(abs(expected[k] - want[k]) < 1e-6 for k in expected)
            whole = sum(r["tokens"] * r["sampled"] for r in rows)
            for k in expected:
                own = [r for r in rows if r[d] == k]
                spread = math.sqrt(sum(r["tokens"] ** 2 * r["probability"] * (1 - r["probability"]) for r in own))
                assert abs(sum(r["tokens"] * r["sampled"] for r in own) - sum(r["tokens"] * r["probability"] for r in own)) < 4.5 * spread + 1e-6
            assert whole > 0


def test_default_sample_is_large(docs):
    rows = mx.mix_documents(docs).collect()
    assert sum(r["probability"] * r["tokens"] for r in rows) > 0.3 * sum(r["tokens"] for r in rows)


def test_every_default_target_moves_and_is_met(docs):
    """No dimension keeps its shares, the sample is expected to have the targets, and its size is told."""
    rows = mx.mix_documents(docs).collect()
    for d in mx.DIMENSIONS:
        plain, expected = margins(rows, d, lambda r: r["tokens"]), margins(rows, d, lambda r: r["probability"] * r["tokens"])
        tempered = {k: v ** mx.TEMPERATURES[d] for k, v in plain.items()}
        want = {k: v / sum(tempered.values()) for k, v in tempered.items()}
        assert all(abs(expected[k] - v) < 1e-3 for k, v in want.items()) and sum(abs(want[k] - plain[k]) for k in plain) > 0.01
    reached = sum(r["probability"] * r["tokens"] for r in rows) / sum(r["tokens"] for r in rows)
    assert all(abs(r["reached"] - reached) < 1e-6 for r in rows)


def test_targets_that_nothing_meets_end(spark):
    frame = spark.createDataFrame([(i, "w " * 50, "en", "a" if i % 2 else "b", 1, "x") for i in range(8)], SCHEMA)
    got = mx.mix_documents(frame, {"source": {"a": 0.9, "c": 0.1}}, most_sweeps=5).collect()
    assert len(got) == 8 and all(0 <= r["probability"] <= 1 for r in got)


def test_equals_sql(spark, docs):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(duck.execute(f"SELECT doc_id, source, lang, topic, tokens, weight, probability, sampled, reached FROM ({mx.op10_sql()})").fetchall())
    got = sorted(tuple(r) for r in mx.op10_mixing(spark, "/root/testdata/sf0.001").collect())
    assert [x[:5] + x[7:8] for x in got] == [x[:5] + x[7:8] for x in want]
    assert all(abs(x[8] - y[8]) < 2e-6 for x, y in zip(got, want, strict=True))
    assert all(abs(a - b) < 2e-6 for x, y in zip(got, want, strict=True) for a, b in zip(x[5:7], y[5:7], strict=True))


def test_edges(spark):
    rows = [(1, None, None, None, None, "x"), (None, "", "en", None, None, "x"), (3, "a b", "en", "s", 3, "x"), (3, "a b", "en", "s", 3, "x"), (4, "word " * 100_000, None, "s", 1, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mx.mix_documents(frame).collect()
    assert sorted((r["doc_id"] or 0, r["tokens"], r["topic"]) for r in got) == [(0, 1, "brief"), (1, 1, "brief"), (3, 2, "brief"), (3, 2, "brief"), (4, 100_000, "prose")]
    assert len({(r["probability"], r["sampled"]) for r in got if r["doc_id"] == 3}) == 1
    assert mx.mix_documents(frame.limit(0)).count() == 0


def test_repeated_sample_meets_the_targets(docs):
    given = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}}
    mixed = mx.mix_documents(docs, given, most_sweeps=60)
    rows = mixed.collect()
    assert max(r["copies"] for r in rows) > 1  # scarce cells are wanted more than once
    for d in mx.DIMENSIONS:
        for value in {r[d] for r in rows}:
            own = [(r["tokens"], mx.FRACTION * r["weight"], r["copies"]) for r in rows if r[d] == value]
            spread = math.sqrt(sum(n * n * (x % 1) * (1 - x % 1) for n, x, _ in own))
            assert abs(sum(n * (k - x) for n, x, k in own)) < 4 * spread + 1e-6
    assert abs(sum(r["weight"] * r["tokens"] for r in rows) / sum(r["tokens"] for r in rows) - 1) < 1e-6
    sample = mx.repeated_sample(docs, given=given, most_sweeps=60)
    assert sample.columns == list(mx.DOCUMENT_COLUMNS)
    counts = {r["doc_id"]: r["count"] for r in sample.groupBy("doc_id").count().collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_reached_margins_are_told(docs):
    mixed = mx.mix_documents(docs)
    rows = mixed.collect()
    got = {(r["dimension"], r["value"]): r for r in mx.reached_margins(mixed).collect()}
    kinds = {"plain": lambda r: 1, "wanted": lambda r: r["weight"], "expected": lambda r: r["probability"], "drawn": lambda r: r["sampled"], "repeated": lambda r: r["copies"]}
    for d in mx.DIMENSIONS:
        for kind, value in kinds.items():
            want = margins(rows, d, lambda r: value(r) * r["tokens"])  # noqa: B023
            assert all(abs(got[d, k][kind] - v) < 1e-9 for k, v in want.items())
    assert mx.reached_margins(mixed.limit(0)).count() == 0
