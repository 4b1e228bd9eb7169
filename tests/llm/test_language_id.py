"""The recurrent network: gradients, held-out accuracy, edges."""

import zlib

import numpy as np
import pytest

from strandworks.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Lang string"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = li.initial(("a", "b", "c"), 3, 5)
    net = li.Net(net.languages, *[p.astype(np.float32) for p in net[1:]])
    windows, target = rng.integers(97, 103, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    mask = np.arange(6) < np.array([6, 4, 6, 2])[:, None]
    _, grads = li.gradients(net, windows, target, mask)
    for p, g in zip(net[1:], grads, strict=True):
        for at in [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g), axis=None)[:4]]:
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = li.gradients(net, windows, target, mask)[0]
            p[at] = old - eps
            down = li.gradients(net, windows, target, mask)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 0.02 * max(0.05, abs(g[at]))


def plain_positions(net, raw):
    """Probabilities position by position, one number at a time: the unit's equations, and a window's margins as told."""
    logistic = lambda x: 1 / (1 + np.exp(-x))
    k = net.u.shape[2]

    def run(d, part):
        h, out = np.zeros(k), []
        for byte in part:
            a, s = net.table[d, byte].astype(float) + net.b[d], net.u[d].astype(float) @ h
            z, r = logistic(a[:k] + s[:k]), logistic(a[k : 2 * k] + s[k : 2 * k])
            q = np.tanh(a[2 * k :] + r * s[2 * k :])
            h = z * h + (1 - z) * q
            out.append(h)
        return out

    rows = []
    for w in range(0, len(raw), li.WINDOW):
        a, b = max(0, w - li.MARGIN), min(len(raw), w + li.WINDOW + li.MARGIN)
        there, back = run(0, raw[a:b]), run(1, raw[a:b][::-1])[::-1]
        for i in range(w, min(len(raw), w + li.WINDOW)):
            y = net.v.astype(float) @ np.concatenate([there[i - a], back[i - a]]) + net.c
            rows.append(np.exp(y - y.max()) / np.exp(y - y.max()).sum())
    return np.array(rows)


def test_every_position_as_in_a_plain_network(monkeypatch):
    net = li.initial(("a", "b", "c"), 5, 1)
    texts = [bytes(range(256)) * 3 + b"end", "é".encode() * 64, b"x", b"y" * (li.WINDOW + 1), b"z" * li.WINDOW * 5]
    want = [plain_positions(net, t) for t in texts]
    for size in (li.BATCH_BYTES, 300, 1):  # texts are cut by bytes, with the same outcome
        monkeypatch.setattr(li, "BATCH_BYTES", size)
        assert np.allclose(li.predict(net, [*texts, b""]), [*(w.mean(0) for w in want), np.zeros(3)], atol=1e-5)
    for t, w in zip(texts[:2], want, strict=False):
        runs = li.spans(net, t.decode("latin-1" if t[0] == 0 else "utf-8")) if t[0] else None
        best = [net.languages[k] for k in w.argmax(1)]
        assert runs is None or [x for a, b, x in runs for _ in range(a, b)] == best


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, docs):
    net = li.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify(docs, net).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([got[r["doc_id"]][0] == r["lang"] for r in held]) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())
    text = docs.where("lang = 'de' and length(text) > 500").first()["text"]
    runs = li.spans(net, text + " And that is what the others thought of with them")
    assert runs[0][0] == 0 and runs[-1][1] == len(text.encode()) + 49 and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))
    assert li.keep_identified(docs, net).count() >= 0.995 * docs.count()


def test_learns_only_from_its_part(spark, docs):
    ids = [r["doc_id"] for r in li.training_rows(docs, 100).select("doc_id").collect()]
    assert ids and not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)
    counts = {r["lang"]: r["count"] for r in li.training_rows(docs, 60).groupBy("lang").count().collect()}
    assert set(counts.values()) == {60}


def test_repeated_and_null_ids_are_learnt_from(spark):
    words = {"de": "der die und nicht ein auch sich mit auf dem", "en": "the of and not with which also this that were"}
    text = lambda i, x: f"{words[x]} {i % 400}"
    many = spark.range(400_000).selectExpr("id % 100 as doc_id", "case when id % 2 = 0 then 'de' else 'en' end as lang", "id")
    de, en = (f"concat('{words[x]} ', cast(id % 1000 as string))" for x in ("de", "en"))
    many = many.selectExpr("doc_id", f"case when lang = 'de' then {de} else {en} end as text", "lang", "'s' as source", "1L as n_chars")
    got = li.training_rows(many, 150).collect()
    assert {x: sum(r["lang"] == x for r in got) for x in words} == {"de": 150, "en": 150} and len({r["text"] for r in got}) == 300
    none = [(None, text(i, x), x, "s", 1, "x") for i in range(40) for x in words]
    frame = spark.createDataFrame(none, SCHEMA)
    assert li.training_rows(frame, 150).count() == 80
    same = spark.createDataFrame([(i % 3, text(0, x), x, "s", 1, "x") for i in range(300) for x in words], SCHEMA)
    assert sorted(r["lang"] for r in li.training_rows(same, 150).collect()) == ["de", "en"]
    kept = li.stage(spark, same, "")
    assert kept.count() == 600  # the corpus is not lost


def test_edges(spark, docs):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (3, "123 ... !", None, "s", 0, "x"), (None, "und der die das", None, None, None, "x"), (3, "é", "fr", "s", 1, "x"), (5, "the of and " * 60_000, "en", "s", 1, "x")]
    few = spark.createDataFrame(rows, SCHEMA)
    net = li.fit(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify(few, net).collect()]
    assert [(i, p, s) for i, p, s in got if p == li.UND] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and len(got) == 6
    assert sorted((r["doc_id"] or 0) for r in li.keep_identified(few, net).collect()) == [0, 3, 5]
    assert li.fit(few.limit(0)) is None
    assert [r["lang_pred"] for r in li.identify(few.limit(2), None).collect()] == ["und", "und"]
    assert li.identify(few.limit(0), net).count() == 0
    assert li.keep_identified(few, None).count() == 0


def test_windows_are_drawn_from_the_whole_text(spark):
    texts = {i: "".join(f"{k:07d} " for k in range(1600)) for i in range(40)} | {90: "short é", 91: "x" * 300}
    rows = [(i, t, "en", "s", 1, "x") for i, t in texts.items()]
    got = {r["doc_id"]: [bytes(p) for p in r["pieces"]] for r in li.training_windows(spark.createDataFrame(rows, SCHEMA), 12).collect()}
    assert got[90] == ["short é".encode()] and b"".join(got[91]) == b"x" * 300
    at = {i: [int(p[:7]) // 16 for p in got[i]] for i in range(40)}
    assert all(len(set(x)) == 12 and x == sorted(x) for x in at.values())
    met = {k for x in at.values() for k in x}
    assert len(met) > 90 and max(met) == 99  # of 100 windows


def test_learns_past_a_shared_opening(spark):
    rng = np.random.default_rng(2)
    draw = lambda words, n: " ".join(rng.choice(words.split(), n))
    opening = draw("all rights reserved terms of use and notices", 400)  # over 1,536 bytes
    bodies = {"de": "der die und nicht ein auch sich mit auf dem", "en": "the of and not with which also this that were", "fr": "les des une dans pour avec sur est pas qui"}
    rows = [(i, opening + " " + draw(bodies[x], 1500), x, "s", 1, "x") for i in range(90) for x in [sorted(bodies)[i % 3]]]
    net = li.fit(spark.createDataFrame(rows, SCHEMA))
    bare = [(x, draw(words, 200).encode()) for x, words in bodies.items() for _ in range(5)]
    best = li.predict(net, [t for _, t in bare]).argmax(1)
    assert [net.languages[k] for k in best] == [x for x, _ in bare]
