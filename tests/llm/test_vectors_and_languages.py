"""Hard negatives, codes of vectors and languages of texts, against plain versions and at their edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives, language_id, queries, vector_codes

SF = "/root/testdata/sf0.01"
KINDS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, n=260, width=12, seed=3, more=()):
    """Vectors with many ties: small components, copies, a hot group of equal rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = (rng.integers(-6, 7, (n, width)) / 8).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]
    rows = [(k, v.tolist(), int(rng.integers(0, 4))) for k, v in enumerate(x)]
    odd = [(9000, None, 1), (9001, [NAN] + [0.0] * (width - 1), 1), (9002, [INF] * width, 2), (9003, [None] + [1.0] * (width - 1), 2), (9100, [0.5] * width, None), (9004, [-INF] * width, None)]
    return spark.createDataFrame(rows + odd + list(more), KINDS), rows


def negatives_by_hand(rows, every=100, positives=5, negatives=10):
    x = {i: [math.floor(256 * c) for c in v] for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    out = []
    for a in sorted(i for i in x if i % every == 0):
        score = {b: sum(p * q for p, q in zip(x[a], x[b], strict=True)) for b in x if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if label[b] == label[a]][:positives]:
            fit = [b for b in order if label[b] != label[a] and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 5])
def test_hard_negatives_by_hand(spark, partitions, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)  # several blocks and slices
    monkeypatch.setattr(hard_negatives, "HELD", 4)
    points, rows = vectors(spark)
    found = hard_negatives.mine(points.repartition(partitions), every=10)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == negatives_by_hand(rows, every=10)


def test_hard_negatives_in_several_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    points, rows = vectors(spark, seed=5)
    assert sorted(map(tuple, hard_negatives.mine(points, every=7).collect())) == negatives_by_hand(rows, every=7)


def test_bounds_of_rests_hold_and_discard():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (400, 32)) * (np.arange(32)[::-1] > 26).astype(int) * 3 + rng.integers(-9, 9, (400, 32))
    rotation = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    a, b = hard_negatives.Turned(x[:20], rotation), hard_negatives.Turned(x, rotation)
    true = x[:20] @ x.T
    low = np.partition(true, -5, axis=1)[:, -5].astype(float)
    seen = []
    i, j = hard_negatives.bounded(a, slice(0, 20), b, np.ones(true.shape, bool), low, np.full(20, np.inf), lambda lo, hi, live: (seen.append((lo, hi)), low)[1])
    assert (seen[0][0] <= true).all() and (true <= seen[0][1]).all()
    assert set(zip(*np.nonzero(true >= low[:, None]), strict=True)) <= set(zip(i, j, strict=True)) and len(i) < 0.1 * true.size


def test_hard_negatives_at_the_edges(spark):
    points, rows = vectors(spark, n=40)
    assert hard_negatives.mine(points.limit(0)).count() == 0
    assert hard_negatives.mine(points.filter("vec_id = 1")).count() == 0
    assert hard_negatives.mine(points.filter("vec_id >= 9000")).count() == 0
    clashing = points.withColumns({c: F.lit("other") for c in ("x", "v", "score", "place", "block", "slice", "key", "kind", "ids", "anchor_id", "rank")})
    want = negatives_by_hand(rows, every=10)
    assert sorted(map(tuple, hard_negatives.mine(clashing, every=10).collect())) == want
    # null ids take no part; vectors without components and of other lengths score by what they have; far values count as the limit
    more = [(None, [1.0] * 12, 1), (300, [], 1), (301, [1.0], 2), (310, [1e30] * 12, 1), (311, [3e38] * 12, 2)]
    assert hard_negatives.mine(vectors(spark, n=40, more=more)[0], every=10).filter("anchor_id = 310 AND rank = 1").count() <= 5
    # a repeated row is a row of its own among the others, an anchor counts once
    twice = points.unionByName(points.filter("vec_id = 20"))
    again = [tuple(r) for r in hard_negatives.mine(twice, every=10).collect()]
    assert {r[0] for r in again} == {r[0] for r in want} and max(r[2] for r in again) <= 10


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: r[0])
    x = np.floor(4096 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        at = d.argmin(2)
        if step < rounds:
            for p in range(parts):
                for k in range(books.shape[1]):
                    if (at[:, p] == k).any():
                        books[p, k] = x[at[:, p] == k, p].sum(0) // (at[:, p] == k).sum()
    error = d.min(2).sum(1)
    label = {}
    for r, e in zip(rows, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + int(e)
    return sorted((r[0], bytes(a.tolist()), int(e), label[r[2]]) for r, a, e in zip(rows, at, error, strict=True)), books


@pytest.mark.parametrize("n,width", [(400, 16), (300, 8), (9, 16)])
def test_codes_by_hand(spark, n, width):
    rng = np.random.default_rng(n)
    x = (rng.integers(-3, 4, (n, width)) / 4 + (rng.random((n, width)) < 0.3) * rng.normal(0, 1, (n, width))).astype(np.float32)
    x[n // 3 : n // 2] = x[1]
    rows = [(3 * k - 20, v.tolist(), int(k % 3) if k % 5 else None) for k, v in enumerate(x)]
    odd = [(-99, None, 1), (-98, [NAN] * width, 1), (-97, [INF] * width, 1), (-96, [None] * width, None)]
    coded, books = vector_codes.encode(spark.createDataFrame(rows + odd, KINDS).repartition(3))
    want, want_books = codes_by_hand(rows)
    assert books.tolist() == want_books.tolist()
    found = vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()
    assert sorted((r.vec_id, bytes(r.code), r.error, r.label_error) for r in found) == want


def test_bounds_skip_groups_and_stay_true():
    """After each move, the bounds hold; entries that stay put leave nothing to look at."""
    rng = np.random.default_rng(2)
    x, book = rng.integers(-500, 500, (2000, 6)), rng.integers(-500, 500, (16, 6))
    group = vector_codes.grouped(book, 4)
    at, upper, lower = vector_codes.Bounds(x, book, group).first()
    for step in range(6):
        moved = book + rng.integers(-40 // (step + 1), 40 // (step + 1) + 1, book.shape)
        drift = np.sqrt(((moved - book) ** 2).sum(1)) * (1 + 1e-12)
        book = moved
        at, upper, lower = vector_codes.Bounds(x, book, group).moved(at, upper, lower, drift)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all()
        far = np.sqrt(d)
        assert (upper >= far[np.arange(len(at)), at] - 1e-9).all()
        far[np.arange(len(at)), at] = np.inf
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= far[:, group == g].min(1, initial=np.inf) + 1e-9).all()
    same = vector_codes.Bounds(x, book, group).moved(at, upper, lower, np.zeros(16))
    assert (same[0] == at).all()


def test_codes_at_the_edges(spark):
    points, rows = vectors(spark, n=40, width=10)  # filled up to 16
    clashing = points.withColumns({c: F.lit("other") for c in ("v", "kind", "code", "error", "at", "upper", "lower", "sums", "label_error")})
    coded, books = vector_codes.encode(clashing)
    assert coded.count() == 41 and books.shape == (8, 16, 2) and coded.columns == ["vec_id", "label", "code", "error"]
    none, no_books = vector_codes.encode(points.limit(0))
    assert none.count() == 0 and vector_codes.with_label_error(none).count() == 0 and no_books.size == 0
    odd = spark.createDataFrame([(None, [1.0], 1), (1, [], None), (1, [], None), (2, [1e30, -3e38], 3)], KINDS)
    coded, books = vector_codes.encode(odd)
    assert coded.count() == 4 and books.shape == (8, 4, 1)
    assert {r.error for r in coded.collect()} == {0}
    empty, books = vector_codes.encode(spark.createDataFrame([(1, [], 1), (2, [], 1)], KINDS))
    assert [r.error for r in empty.collect()] == [0, 0]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = language_id.train([("a", b"xyz"), ("b", b"uvw"), ("c", b"rst")], units=3, steps=1)
    for w in model.weights():
        w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    model = language_id.Model(model.langs, *(w.astype(np.float64) for w in model.weights()))
    windows, truth = rng.integers(97, 103, (6, 5)), np.array([0, 1, 2, 1, 0])
    windows[4:, 3] = language_id.PAD
    loss, slopes = language_id.gradients(model, windows, truth)
    for w, g in zip(model.weights(), slopes, strict=True):
        for place in rng.choice(w.size, 12):
            at = np.unravel_index(place, w.shape)
            if w is model.inputs:
                at = (at[0], int(windows[at[1] % 4, 0]), at[2])
            old, step = w[at], 1e-2
            w[at] = old + step
            above = language_id.gradients(model, windows, truth)[0]
            w[at] = old - step
            below = language_id.gradients(model, windows, truth)[0]
            w[at] = old
            assert g[at] == pytest.approx((above - below) / (2 * step), rel=0.02, abs=2e-4)


def test_windows_hold_every_byte():
    texts = [b"", b"a", b"b" * 64, b"c" * 65, b"d" * 1000]
    windows, of = language_id.windows_of(texts)
    back = [bytes(windows[of == k].ravel()[windows[of == k].ravel() != language_id.PAD].astype(np.uint8)) for k in range(len(texts))]
    assert back == texts


def test_languages_of_held_out_documents(spark):
    found = queries.op12_language_id(spark, SF)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "boolean", "string", "double"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_at_the_edges(spark):
    kinds = "doc_id long, text string, lang string, probs int, score string, _read string"
    words = {"en": "the of and to in that with ", "de": "der die und nicht ein mit auf ", "fr": "le la des est dans pour que "}
    rows = [(k, w * (1 + k % 9), lang, 1, "x", "y") for k in range(20) for lang, w in words.items()]
    odd = [(90, None, "en", 1, "x", "y"), (91, "", "de", 1, "x", "y"), (92, "12 34 !?\n", None, 1, "x", "y"), (None, "der und nicht", None, 1, "x", "y"), (93, "le la des " * 200_000, None, 1, "x", "y"), (94, "é", None, 1, "x", "y"), (94, "é", None, 1, "x", "y")]
    docs = spark.createDataFrame(rows + odd, kinds).drop("_read")
    model = language_id.fit(docs, ident="doc_id", text="text", lang="lang", steps=80)
    found = language_id.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "probs", "lang_pred", "score"] and found.count() == len(rows) + len(odd)
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert all((by[k][-1].lang_pred, by[k][-1].score) == ("und", 0.0) for k in (90, 91, 92))
    assert by[93][0].lang_pred == "fr" and by[None][0].lang_pred == "de" and by[94][0][-2:] == by[94][1][-2:]
    assert all(r.lang_pred == r.lang for k in range(20) for r in by[k])
    nothing = language_id.fit(docs.limit(0), ident="doc_id", text="text", lang="lang")
    assert nothing.langs == [] and {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0
    one = language_id.fit(docs.filter("lang = 'en'"), ident="doc_id", text="text", lang="lang")
    assert {r.lang_pred for r in language_id.predict(docs.filter("doc_id < 5"), one).collect()} == {"en"}
