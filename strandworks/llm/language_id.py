"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

A text is read as its UTF-8 bytes in windows of WINDOW bytes, each with MARGIN bytes of what stands before and after it; both
directions of a gated recurrent unit run over each window, a softmax layer labels every position, and a document's
probabilities are the mean over its positions. A direction so has read MARGIN bytes at least when it comes to a position that
counts, unless the text begins there. The whole text is read, whatever its length: windows keep the state that a step holds
bounded, and texts are taken by bytes, not by rows.

Training is by backpropagation through time on a bounded sample: at most `per_language` distinct texts of each label, picked
by a hash of the text, and at most `windows_per_document` windows of each, picked by a hash of doc_id (the least of the text's)
and window number from all of it. So the sample does not depend on partitioning or on how often a text is repeated, and it is
empty only where no row has a label and letters. Both are documented bounds; everything else covers all rows.

Null texts and texts without letters are `und` with score 0. Where there is no label to learn from, every document is `und`.
Null doc_ids are learnt from, as they are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOCUMENT_COLUMNS, pick, table, written

WINDOW = 128
MARGIN = 16
HIDDEN = 6
UND = "und"
ROWS = 2048  # windows that run together
BATCH_BYTES = 4 << 20


class Net(NamedTuple):
    """Both directions are stacked on the first axis; gates in the order update, reset, candidate."""

    languages: tuple[str, ...]
    table: np.ndarray  # 2 x 256 x 3H: what a byte adds to the gates
    u: np.ndarray  # 2 x 3H x H: what the state adds
    b: np.ndarray  # 2 x 3H
    v: np.ndarray  # C x 2H
    c: np.ndarray  # C


def initial(languages: tuple[str, ...], hidden: int, seed: int) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Net(
        languages,
        draw(2, 256, 3 * hidden, scale=0.3),
        draw(2, 3 * hidden, hidden, scale=hidden**-0.5),
        np.zeros((2, 3 * hidden), np.float32),
        draw(len(languages), 2 * hidden, scale=0.3),
        np.zeros(len(languages), np.float32),
    )


def states(net: Net, x: np.ndarray, valid: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """x: windows of bytes, T x N, the second direction's reversed: 2 x T x N. Returns the states, 2 x T x H x N.

    valid: T x N, 0 at what fills a window up; a direction that meets it first starts after it.
    keep: gets what each step of backpropagation needs.
    """
    h3, n, steps = net.u.shape[1], x.shape[2], x.shape[1]
    k = h3 // 3
    # half-scaled update and reset gates, so that one tanh serves all three
    half = np.ones(h3, np.float32)
    half[: 2 * k] = 0.5
    table = np.ascontiguousarray(((net.table + net.b[:, None]) * half).transpose(0, 2, 1))  # 2 x 3H x 256
    u = net.u * half[None, :, None]
    h = np.zeros((2, k, n), np.float32)
    out = np.empty((2, steps, k, n), np.float32)
    a = np.empty((2, h3, n), np.float32)
    for t in range(steps):
        for d in (0, 1):
            np.take(table[d], x[d, t], axis=1, out=a[d], mode="clip")
        s = u @ h
        g = a[:, : 2 * k] + s[:, : 2 * k]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        z, r = g[:, :k], g[:, k:]
        m = s[:, 2 * k :]
        q = r * m
        q += a[:, 2 * k :]
        np.tanh(q, out=q)
        if keep is not None:
            keep.append((h.copy(), z.copy(), r.copy(), q.copy(), m.copy()))
        h = h - q
        h *= z
        h += q
        if valid is not None:
            h[0] *= valid[t]
            h[1] *= valid[steps - 1 - t]
        out[:, t] = h
    return out


def both_ways(windows: np.ndarray) -> np.ndarray:
    """N x T bytes -> 2 x T x N, the second reversed in time."""
    x = np.ascontiguousarray(windows.T)
    return np.stack([x, x[::-1]])


def logits(net: Net, out: np.ndarray) -> np.ndarray:
    """States of both directions at each position -> T x C x N."""
    k = out.shape[2]
    return net.v[:, :k] @ out[0] + net.v[:, k:] @ out[1][::-1] + net.c[:, None]


def softmax(y: np.ndarray, axis: int) -> np.ndarray:
    y = y - y.max(axis=axis, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=axis, keepdims=True)
    return y


def position_probabilities(net: Net, windows: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """N x T bytes, valid (N x T) where they are text (default: everywhere) -> T x C x N, zeros elsewhere."""
    v = None if valid is None or valid.all() else np.ascontiguousarray(valid.T).astype(np.float32)
    p = softmax(logits(net, states(net, both_ways(windows), v)), 1)
    return p if v is None else p * v[:, None]


def gradients(net: Net, windows: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the unmasked positions and its gradients by backpropagation through time."""
    x, keep = both_ways(windows), []
    m = mask.T.astype(np.float32)
    out = states(net, x, m, keep)
    p = softmax(logits(net, out), 1)
    steps, _, n = p.shape
    k = net.u.shape[2]
    total = max(1.0, float(m.sum()))
    loss = float(-(np.log(p[:, target, np.arange(n)] + 1e-9) * m).sum() / total)
    p[:, target, np.arange(n)] -= 1
    p *= m[:, None] / total
    both = np.concatenate([out[0], out[1][::-1]], axis=1)  # T x 2H x N
    dv, dc = np.einsum("tcn,tkn->ck", p, both), p.sum((0, 2))
    down = np.einsum("ck,tcn->tkn", net.v, p)
    given = np.stack([down[:, :k], down[::-1, k:]])  # 2 x T x H x N, each in its own order of time
    dtable, du, db = np.zeros_like(net.table), np.zeros_like(net.u), np.zeros_like(net.b)
    dh = np.zeros((2, k, n), np.float32)
    ut = net.u.transpose(0, 2, 1)
    da = np.empty((2, 3 * k, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, q, s = keep[t]
        dh = dh + given[:, t]
        dh[0] *= m[t]
        dh[1] *= m[steps - 1 - t]
        dq = dh * (1 - z) * (1 - q * q)
        dz = dh * (h - q) * z * (1 - z)
        dr = dq * s * r * (1 - r)
        da[:, :k], da[:, k : 2 * k], da[:, 2 * k :] = dz, dr, dq
        ds = da.copy()
        ds[:, 2 * k :] = dq * r
        du += ds @ h.transpose(0, 2, 1)
        db += da.sum(2)
        for d in (0, 1):
            np.add.at(dtable[d], x[d, t], da[d].T)
        dh = dh * z + ut @ ds
    return loss, [dtable, du, db, dv, dc]


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], hidden: int = HIDDEN, steps: int = 120, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Net:
    """Adam on cross-entropy of every position; windows N x T, lengths of what is text, labels by index."""
    net, rng = initial(languages, hidden, seed), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net[1:]]
    second = [np.zeros_like(p) for p in net[1:]]
    mask = np.arange(windows.shape[1]) < lengths[:, None]
    for step in range(1, steps + 1):
        rows = rng.choice(len(windows), min(batch, len(windows)), replace=False)
        _, grads = gradients(net, windows[rows], labels[rows], mask[rows])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        now = rate * min(1.0, 4 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net[1:], grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def cut(raw: bytes, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as rows of width, the last filled up with 0, and each row's length."""
    rows = max(1, -(-len(raw) // width))
    x = np.zeros(rows * width, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    lengths = np.full(rows, width)
    lengths[-1] = len(raw) - width * (rows - 1)
    return x.reshape(rows, width), lengths


def with_margins(raw: bytes, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows first .. last - 1 of a text with their margins, and where they hold text: rows of MARGIN + WINDOW + MARGIN bytes."""
    width = WINDOW + 2 * MARGIN
    a, b = first * WINDOW - MARGIN, (last - 1) * WINDOW + WINDOW + MARGIN
    part = raw[max(0, a) : min(b, len(raw))]
    x = np.zeros(b - a, np.uint8)
    x[max(0, -a) : max(0, -a) + len(part)] = np.frombuffer(part, np.uint8)
    text = np.zeros(b - a, bool)
    text[max(0, -a) : max(0, -a) + len(part)] = True
    rows = lambda y: np.lib.stride_tricks.sliding_window_view(y, width)[::WINDOW]
    return rows(x), rows(text)


def pooled(net: Net, parts: list[tuple[int, np.ndarray, np.ndarray]], sums: np.ndarray) -> None:
    """Adds the probabilities of the positions of parts (text, windows with margins, where they hold text) to their texts' sums."""
    windows, valid = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    owner = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
    # like lengths run together, so what is filled up costs little, and windows without any need no mask
    ends = valid.shape[1] - valid[:, ::-1].argmax(1)
    order = np.lexsort((-ends, ~valid.all(1)))
    for i in range(0, len(order), ROWS):
        rows = order[i : i + ROWS]
        longest = int(ends[rows].max())
        p = position_probabilities(net, windows[rows, :longest], valid[rows, :longest])
        np.add.at(sums, owner[rows], p[MARGIN : MARGIN + WINDOW].sum(0).T)


def predict(net: Net, texts: list[bytes]) -> np.ndarray:
    """Pooled probabilities, one row a text; about BATCH_BYTES of text at a time, so neither many nor long texts make the step large."""
    sums = np.zeros((len(texts), len(net.languages)))
    parts, most = [], max(1, BATCH_BYTES // WINDOW)
    held = 0
    for k, raw in enumerate(texts):
        n = -(-len(raw) // WINDOW)
        for first in range(0, n, most):
            part = with_margins(raw, first, min(n, first + most))
            parts.append((k, *part))
            held += len(part[0])
            if held >= most:
                pooled(net, parts, sums)
                parts, held = [], 0
    if parts:
        pooled(net, parts, sums)
    return sums / np.maximum(1, [len(t) for t in texts])[:, None]


def spans(net: Net, text: str) -> list[tuple[int, int, str]]:
    """Runs of positions of one label: start and end in bytes, language."""
    raw = text.encode()
    if not raw:
        return []
    n = -(-len(raw) // WINDOW)
    best = np.concatenate([position_probabilities(net, *with_margins(raw, a, min(n, a + ROWS)))[MARGIN : MARGIN + WINDOW].argmax(1).T.reshape(-1) for a in range(0, n, ROWS)])[: len(raw)]
    edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(raw)]
    return [(a, b, net.languages[best[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def held_out(doc_id: Column, of: int = 4, part: int = 2) -> Column:
    """crc32 of doc_id as text, modulo `of`, is `part`; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == part, F.lit(False))


def training_rows(docs: DataFrame, per_language: int, salt: str = "lid") -> DataFrame:
    """doc_id, text, lang of at most per_language distinct texts of each label; all of a label that has no more.

    A label's texts are told apart and drawn by a hash of the text alone. A first look, without texts, thins each label to
    about twice what is wanted, by an estimate of its distinct texts; those hashes, bounded by per_language times the number
    of labels, are ranked and then pick one row each.
    """
    able = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("text", F.lit(salt)))
    wanted = F.lit(2.0 * per_language + 50)
    share = able.groupBy("lang").agg(F.least(F.lit(1.0), wanted / F.approx_count_distinct("h")).alias("share"))
    share = written(share.select(F.col("lang").alias("_lang"), "share"), "label-shares")  # a row a label
    at = F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40))
    thinned = able.select("lang", "h").join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(at < F.col("share")).select("lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = written(thinned.withColumn("_k", rank).where(F.col("_k") <= per_language).select(F.col("lang").alias("_lang"), F.col("h").alias("_h")), "chosen-texts")
    found = able.join(F.broadcast(chosen), (F.col("lang") == F.col("_lang")) & (F.col("h") == F.col("_h")), "left_semi")
    return found.groupBy("lang", "h").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("r.doc_id", "r.text", "lang")


def training_windows(rows: DataFrame, windows_per_document: int) -> DataFrame:
    """rows (doc_id, text, lang) -> doc_id, lang, pieces: at most so many windows of a text, in its order, wherever they stand in it."""
    raw = pick(rows, "doc_id", "lang", "text").select("doc_id", "lang", F.col("text").cast("binary").alias("raw"))
    last = F.ceil(F.octet_length("raw") / WINDOW).cast("int") - 1
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.struct(F.xxhash64("doc_id", k, F.lit("window")).alias("h"), k.alias("k"))))
    picked = F.array_sort(F.slice(ranked, 1, windows_per_document).getField("k"))
    return raw.select("doc_id", "lang", F.transform(picked, lambda k: F.substring(F.col("raw"), k * WINDOW + 1, F.lit(WINDOW))).alias("pieces"))


def fit(docs: DataFrame, per_language: int = 150, windows_per_document: int = 12, **options) -> Net | None:
    """The network for docs (doc_id, text, lang), or None if no row may be learnt from.

    The driver receives the sample only: per_language texts a label, of each at most windows_per_document windows.
    """
    sample = training_windows(training_rows(docs, per_language), windows_per_document).select("lang", "pieces").toPandas()
    if not len(sample):
        return None
    sample["raw"] = [b"".join(map(bytes, x)) for x in sample["pieces"]]  # only a text's last window may be short
    sample = sample.sort_values(["lang", "raw"], ignore_index=True)
    languages = tuple(sorted(sample["lang"].unique()))
    cuts = [cut(bytes(r)) for r in sample["raw"]]
    labels = np.repeat([languages.index(x) for x in sample["lang"]], [len(c[1]) for c in cuts])
    return train(np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts]), labels, languages, **options)


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("raw"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("readable"))
    kind = dict(rows.dtypes)["doc_id"]
    if net is None:
        return rows.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [r if ok else b"" for r, ok in zip(b.column("raw").to_pylist(), b.column("readable").to_pylist(), strict=True)]
            p = predict(net, texts)
            best = p.argmax(1)
            lang = [net.languages[j] if t else UND for j, t in zip(best, texts, strict=True)]
            score = [float(p[k, j]) if t else 0.0 for k, (j, t) in enumerate(zip(best, texts, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Net | None, least: float = 0.3) -> DataFrame:
    """The documents whose language is known: not `und`, and with a score of at least `least`. Same rows, same columns."""
    rows = pick(docs, *DOCUMENT_COLUMNS)
    if net is None:
        return rows.where(F.lit(False))
    scored = rows.withColumn("_raw", F.col("text").cast("binary")).withColumn("_readable", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [r if ok else b"" for r, ok in zip(b.column("_raw").to_pylist(), b.column("_readable").to_pylist(), strict=True)]
            good = (predict(net, texts).max(1, initial=0.0) >= least) & np.array([bool(t) for t in texts], bool)
            yield b.filter(pa.array(good)).select(list(DOCUMENT_COLUMNS))

    return scored.mapInArrow(run, rows.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, fit(docs))
