"""Hard negatives, filter audit and language-model scores against brute force."""

import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from weathernorm.llm import filter_audit, hard_negatives, lm_scoring

LABELS = "doc_id long, quality int, toxic int"


# --- operator 12


def plain_audit(docs, labels):
    """The audit by going through every order, document by document; rows are (doc_id, text, lang)."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and smallest[text] < i}
        rows.append((lang or "", {f for f, failed in fails.items() if failed}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = [r for r in rows if r[0] == part and f in r[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


@pytest.fixture(scope="module")
def audit_docs():
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "GAMMA", "été", "漢字", "d#e", "100%", "x", "a\x00b"]
    texts = [" ".join(rng.choice(words[: rng.integers(1, 9)], rng.integers(0, 400))) for _ in range(60)]
    texts += ["\t".join(f"w{k}" for k in range(300)), "\n".join(f"W{k}" for k in range(250)), "a\x0bb\x0cc\r\x1cd", None, "", " ", "long" * 80_000, "A" * 300_000 + " " + "A" * 300_000, "y" * 400 + "1 " + "y" * 400 + "2 " + "y" * 400 + "1"]
    docs = [(k if k % 11 else None, t, ["en", "de", None, ""][k % 4]) for k, t in enumerate(texts)]
    return docs + [(500, texts[3], "en"), (500, texts[3], "en"), (501, texts[3], "de"), (None, texts[3], "en"), (2, texts[4], "en"), (502, "", None)]


@pytest.fixture(scope="module")
def some_labels():
    return [(k, k % 2, int(k % 3 == 0)) for k in range(0, 70, 2)] + [(4, 0, 0), (500, 1, 1), (None, 1, 1), (6, None, 1), (501, 1, None)]


def test_audit_matches_going_through_every_order(spark, audit_docs, some_labels):
    docs = spark.createDataFrame([(*d, "k", 1) for d in audit_docs], "doc_id long, text string, lang string, part string, fails int")
    found = filter_audit.audit(docs, spark.createDataFrame(some_labels, LABELS)).collect()
    assert audited(found) == plain_audit(audit_docs, some_labels)
    assert len(found) == 3 * 600


def test_audit_sql_says_the_same(spark, audit_docs, some_labels):
    docs = [d for d in audit_docs if "\x00" not in (d[1] or "")]
    pdf, known = spark.createDataFrame(docs, "doc_id long, text string, lang string").toPandas(), spark.createDataFrame(some_labels, LABELS).toPandas()
    for frame, ints in ((pdf, ["doc_id"]), (known, ["doc_id", "quality", "toxic"])):
        for c in ints:
            frame[c] = frame[c].astype("Int64")
    con = duckdb.connect()
    con.register("documents", pdf)
    con.register("labels", known)
    cursor = con.execute(filter_audit.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    rows = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    mine = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert mine == plain_audit(docs, some_labels)


def test_audit_of_nothing_and_without_labels(spark, make, none, odd):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, labels).count() == 0
    found = filter_audit.audit(odd, labels).collect()
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert audited(found) == plain_audit(docs, [])


def test_words_that_share_a_slot_are_compared():
    """All words in a table with one slot value: each is compared with those that are there."""
    words = [b"a" * n + t for n in (1, 7, 8, 9, 15, 16, 17, 300) for t in (b"", b"x", b"y", b"x")]
    raw = b" ".join(words) + b" "
    buf, ends = np.frombuffer(raw, np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
    found = filter_audit.Words(buf, ends - [len(w) for w in words], ends, np.zeros(len(words), np.int64))
    found.hashes = lambda: np.zeros(len(words), np.uint64)
    assert found.distinct(1).tolist() == [len(set(words))]


# --- operator 11


def plain_negatives(rows, every=100, positives=5, negatives=10):
    one = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v):
            x = [math.floor(256 * c) for c in v]
            one[i] = min(one.get(i, (label, x)), (label, x))
    items = {i: ((label + 1) % 10 if i % 7 == 0 else label, x) for i, (label, x) in one.items()}
    out = []
    for a, (label, x) in items.items():
        if a % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y) in items.items() if i != a))
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a, positive, k, i, -p, -s) for k, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, rank int, score double")


def mined(found):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def clustered(n, seed, width=8, clusters=12, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, width))
    x = (centres[rng.integers(0, clusters, n)] + rng.normal(0, spread, (n, width))).astype(np.float32)
    return [(int(i), [float(c) for c in v], int(label)) for i, v, label in zip(range(n), x, rng.integers(0, 10, n), strict=True)]


@pytest.mark.parametrize("spread", [0.02, 0.7])
def test_negatives_match_brute_force(spark, monkeypatch, spread):
    """Small shards and seeds: many cells, split cells, several waves."""
    for name, value in (("SHARD", 32), ("SEED", 24), ("BLOCK", 4), ("CELL_ROWS", 8), ("GROWTH", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(1_200, 5, spread=spread)
    rows += [(2_000 + k, rows[100][1], 3) for k in range(150)]  # a hot vector, all ties
    assert mined(hard_negatives.hard_negatives(vectors(spark, rows), every=50)) == plain_negatives(rows, every=50)


def test_negatives_of_odd_rows(spark):
    rows = clustered(240, 9)
    rows += [(None, [1.0] * 8, 1), (900, None, 1), (901, [1.0] * 8, None), (902, [1.0] * 7 + [None], 1), (903, [1.0] * 7 + [float("nan")], 1), (904, [1.0] * 7 + [float("inf")], 1), (905, [0.0] * 8, 2), (100, [0.5] * 8, 9), (100, [0.5] * 8, 9), (3, rows[4][1], 0)]
    expected = plain_negatives(rows)
    # another length than most, and a score beyond 64 bits, take no part
    assert mined(hard_negatives.hard_negatives(vectors(spark, [*rows, (906, [1.0] * 3, 1), (907, [], 1), (908, [1e30] * 8, 1), (909, [-3e38] * 8, 1)]))) == expected
    assert expected


def test_negatives_of_nothing(spark):
    for rows in ([], [(None, None, None)], [(1, [1.0], 1)], [(100, [1.0, 2.0], 1)], [(100, [], 1), (200, [], 1)]):
        assert mined(hard_negatives.hard_negatives(vectors(spark, rows))) == []


def test_bounds_hold_and_the_heap_goes_down_in_order():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (500, 6)).astype(float)
    books = [hard_negatives.kmeans(h, 5) for h in (x[:, :3], x[:, 3:])]
    (c1, d1), (c2, d2) = (hard_negatives.nearest_codes(h, b) for h, b in zip((x[:, :3], x[:, 3:]), books, strict=True))
    cells, counts = np.unique(np.stack([c1, c2], 1), axis=0, return_counts=True)
    index = hard_negatives.MultiIndex(books, [np.array([d[c == k].max(initial=0) for k in range(5)]) for c, d in ((c1, d1), (c2, d2))], cells, counts)
    q = x[:20]
    (u1, u2), (l1, l2) = index.bounds(q), index.bounds(q, -1)
    s = hard_negatives.scores(q.astype(np.int64), x.astype(np.int64))
    assert (s <= u1[:, c1] + u2[:, c2]).all() and (s >= l1[:, c1] + l2[:, c2]).all()
    for i in range(20):
        bound = u1[i][cells[:, 0]] + u2[i][cells[:, 1]]
        order = np.argsort(-bound)
        reached = np.searchsorted(np.cumsum(counts[order]), 77)
        assert index.descend([u1[i], u2[i]], np.zeros(len(cells), bool), 77) == pytest.approx(bound[order[reached]])
        passed = bound > np.median(bound)
        assert index.descend([u1[i], u2[i]], passed, 40) == pytest.approx(index.sweep(bound, passed, 40))
    assert index.descend([u1[0], u2[0]], np.zeros(len(cells), bool), 501) == index.sweep(bound, np.zeros(len(cells), bool), 501) == -math.inf


# --- operator 13


def lm_words(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lm_scoring._LOWER)), b""]


def plain_base(docs):
    learned = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    c = Counter(w for t in learned for w in lm_words(t))
    n, v = sum(c.values()), len(c)
    return c, [(i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(lm_words(t)), sum(c[w] > 0 for w in lm_words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lm_words(t))) for i, t in docs]


@pytest.fixture(scope="module")
def lm_docs():
    rng = np.random.default_rng(4)
    texts = []
    for k in range(300):
        words = [f"{'en' if k % 2 else 'de'}{w}{'ing' if k % 2 else 'ung'}" for w in np.minimum(rng.zipf(1.4, rng.integers(1, 120)), 3_000)]
        texts.append(" ".join(words))
    return [*enumerate(texts), (None, texts[0]), (1, texts[2]), (1, texts[1]), (400, None), (401, ""), (402, " \n\x0b "), (403, "WORD Word word É é"), (404, "z" * 300_000), (405, "der " * 60_000), (406, "a\x00b 漢")]


def test_scores_and_base_match_a_plain_count(spark, lm_docs):
    docs = spark.createDataFrame([(*d, 1.5, 2) for d in lm_docs], "doc_id long, text string, score double, n int")
    found = lm_scoring.lm_scores(docs, shortlist=40, buckets=16, frequent=60, epochs=1).collect()
    _, expected = plain_base(lm_docs)
    rows = lambda x: sorted((-1 if r[0] is None else r[0], *r[1:5], round(r[5], 6)) for r in x)
    assert rows([tuple(r)[:6] for r in found]) == rows(expected)
    assert all(r.score < 0 for r in found)


def test_model_beats_the_unigram_on_held_out_texts(spark, lm_docs):
    """With two rounds over 300 short texts a little, with ten a tenth of a digit a token."""
    docs = spark.createDataFrame([d for d in lm_docs if d[0] is not None and d[0] < 300], "doc_id long, text string")
    for epochs, margin in ((lm_scoring.EPOCHS, 0.0), (10, 0.1)):
        held = [r for r in lm_scoring.lm_scores(docs, shortlist=40, buckets=16, epochs=epochs).collect() if r.held_out]
        assert len(held) > 15
        assert sum(r.score for r in held) > sum(r.base_score for r in held) + margin * sum(r.n_tokens for r in held)


def test_probabilities_of_all_words_sum_to_one():
    words = [(b"", 5), (b"the", 9), (b"of", 4), (b"cat", 3), (b"hat", 2), (b"ox", 0)]
    v = lm_scoring.Vocabulary(words, [b"the", b"of"], {zlib.crc32(b"at") % 8: (5, 2), zlib.crc32(b"ox") % 8: (0, 0)}, 23, 8)
    model = lm_scoring.LogBilinear(v.counts)
    trainer = lm_scoring.Trainer(model, 1)
    for _ in range(30):
        trainer.read(np.array([1, 2, 3, 0, 1, 5, 0]), np.array([0, 4]))
    model.unpack(trainer.packed())
    near, far, z = model.tables()
    p = np.exp(near[4][None].astype(float) + far - z[4][:, None])
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    # z is what the hidden vector of the two symbols says
    h = model.hidden(np.array([[4, 2]]))[0]
    assert z[4, 2] == pytest.approx(np.log(np.exp(model.q @ h + model.b).sum()), abs=1e-6)
    # within a class: its known words, and one never seen
    k = zlib.crc32(b"at") % 8
    assert sum((n + 0.1) / 10 ** v.spread[k] for n in (3, 2, 0)) == pytest.approx(1)
    assert 0.1 / 10 ** v.spread[zlib.crc32(b"ox") % 8] == pytest.approx(1)


def test_contexts_end_at_texts():
    assert lm_scoring.contexts(np.array([4, 5, 0, 6, 7, 0]), np.array([0, 3])).tolist() == [[0, 0], [4, 0], [5, 4], [0, 0], [6, 0], [7, 6]]


def test_gradients_are_those_of_the_loss():
    model = lm_scoring.LogBilinear(np.array([5.0, 3, 2, 1]), width=3)
    t = lm_scoring.Trainer(model, 1, noise=4)
    t.r, t.q, t.b, t.c = (x.astype(np.float64) for x in (t.r, np.random.default_rng(1).normal(0, 1, (4, 3)), t.b, t.c))
    before, target, moved = np.array([[1, 2], [3, 1]]), np.array([2, 0]), {}
    drawn = np.minimum(np.searchsorted(t.cumulative, np.random.default_rng(1).random(4)), 3)
    t.rng = np.random.default_rng(1)
    t._move = lambda part, seen, gradient: moved.setdefault(id(part), gradient.copy())

    def gain():
        h = t.r[before[:, 0]] @ t.c[0] + t.r[before[:, 1]] @ t.c[1]
        log = lambda x: -np.log1p(np.exp(-x))
        own = (h * t.q[target]).sum(1) + t.b[target] - t.shift[target]
        return (log(own).sum() + log(-(h @ t.q[drawn].T + t.b[drawn] - t.shift[drawn])).sum()) / 2

    t.step(before, target)
    for part in (t.r, t.q, t.b, t.c):
        for at in itertools.islice(np.ndindex(part.shape), 12):
            kept, e = part[at], 1e-5
            part[at] = kept + e
            up = gain()
            part[at] = kept - e
            slope = (up - gain()) / (2 * e)
            part[at] = kept
            assert moved[id(part)][at] == pytest.approx(slope, abs=1e-4)


def test_scores_without_learning_texts(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    found = {r.n_tokens: r for r in lm_scoring.lm_scores(docs, shortlist=5, buckets=4).collect()}
    assert {k: (r.n_known, r.train_tokens, r.held_out) for k, r in found.items()} == {3: (0, 0, False), 1: (0, 0, False)}
    assert found[3].base_score == pytest.approx(0) and found[1].score == pytest.approx(math.log10(1 / 5))
    assert lm_scoring.lm_scores(docs.limit(0)).count() == 0


def test_scores_of_odd_rows(odd, none):
    found = lm_scoring.lm_scores(odd, epochs=1).collect()
    assert len(found) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert lm_scoring.lm_scores(none).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
