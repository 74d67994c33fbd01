"""Operators 1, 4 and 10: held-out accuracy, fixed folds, probabilities, and odd tables."""

import random
import zlib

import numpy as np
import pytest

from weathernorm.llm import language, quality, toxicity
from weathernorm.llm.common import table

SF = "/root/testdata/sf0.01"


def out_of(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.mark.parametrize(("f", "label", "cut", "least"), [(quality.quality, "quality", 0.3, 0.97), (toxicity.toxicity, "toxic", 0.5, 0.85)])
def test_held_out_accuracy(spark, f, label, cut, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in f(docs, labels).collect()}
    assert len(got) == docs.count()
    y = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [d for d in y if out_of(d, 5, 0)]
    assert all(got[d]["held_out"] == out_of(d, 5, 0) for d in got)
    score = np.array([got[d]["score"] for d in held])
    assert ((score >= 0) & (score <= 1)).all() and auc(score, np.array([y[d] for d in held])) > least
    assert all(r["predicted"] == int(r["score"] >= cut) for r in got.values())


@pytest.mark.parametrize("f", [quality.quality, toxicity.toxicity])
def test_held_out_labels_change_nothing(spark, f):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").toPandas()
    held = labels["doc_id"].map(lambda d: out_of(d, 5, 0))
    flipped = labels.copy()
    flipped.loc[held, ["quality", "toxic"]] = 1 - flipped.loc[held, ["quality", "toxic"]]
    a, b = (sorted(map(tuple, f(docs, spark.createDataFrame(x)).collect())) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("f", [quality.quality, toxicity.toxicity])
def test_odd_tables(spark, f, odd, none):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (6, 0, 1), (8, 1, 0), (999, 1, 1)], schema)
    rows = f(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({round(r["score"], 9) for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert f(none, labels).count() == 0
    one = f(odd, spark.createDataFrame([], schema)).collect()
    assert len({round(r["score"], 9) for r in one}) == 1


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4000) < 0.05)).astype(float)
    m = quality.AdditiveModel(pairs=1).fit(x[:3000], y[:3000])
    assert m.pairs[0][:2] == (0, 1)
    assert auc(m.score(x[3000:]), y[3000:]) > 0.9


def test_scores_are_sums_of_bins():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality.AdditiveModel(rounds=20, pairs=2, pair_rounds=10).fit(x[:500], y[:500])
    for row, score in zip(x[500:], m.score(x[500:]), strict=True):
        z = m.start
        for j, (edges, table) in enumerate(zip(m.edges, m.tables, strict=True)):
            z += table[sum(e < row[j] for e in edges)]
        for i, j, table in m.pairs:
            z += table[sum(e < row[i] for e in m.coarse[i]), sum(e < row[j] for e in m.coarse[j])]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))
    assert all(len(np.unique(np.diff(t))) > 1 for t in m.tables[:1])


def test_the_whole_query_is_its_model_by_hand(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and not out_of(r["doc_id"], 5, 0) and r["doc_id"] in texts}
    # the fit's rows come in the order of the hashes of their ids
    order = [r["d"] for r in spark.createDataFrame([(d,) for d in known], "d long").selectExpr("d", "xxhash64(d) h").orderBy("h", "d").collect()]
    m = quality.AdditiveModel().fit(np.array([quality.text_features(texts[d]) for d in order]), np.array([float(known[d]) for d in order]))
    want = dict(zip(texts, m.score(np.array([quality.text_features(t) for t in texts.values()])), strict=True))
    assert all(got[d] == pytest.approx(want[d], abs=1e-9) for d in texts)


def naive_kneser_ney(texts):
    """Chances by loops and dictionaries: context (three characters) and character."""
    from collections import Counter, defaultdict

    four = Counter()
    for t in texts:
        said = "   " + "".join(c if c.isalpha() else " " for c in t.lower())
        said = "   " + " ".join(said.split()) + " "
        four.update(said[k : k + 4] for k in range(len(said) - 3))
    levels = [four]
    for _ in range(3):
        shorter = Counter()
        for g in levels[-1]:
            shorter[g[1:]] += 1
        levels.append(shorter)
    tables = []
    for n in levels:
        once, twice = (sum(c == k for c in n.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in n.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables.append((n, d, total, kinds))

    def chance(g, level=0):
        if level == 4:
            return 1 / 65536
        n, d, total, kinds = tables[level]
        below = chance(g[1:], level + 1)
        if not total.get(g[:-1]):
            return below
        return max(n.get(g, 0) - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * below

    return chance


def test_languages_by_naive_models(spark, make):
    import math

    said = {"en": ["the cat sat on the mat", "a dog ran in the park today"], "de": ["der hund lief im park", "die katze sitzt auf der matte"], "fr": ["le chat est sur le tapis", "un chien court dans le parc"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t * 2) for lang, x in said.items() for t in x for _ in range(3))]
    docs = make(rows)
    learned = {lang: naive_kneser_ney([t for d, t, x in rows if x == lang and not out_of(d, 3, 1)]) for lang in said}
    asked = [(1000 + k, t, None) for k, t in enumerate(["the dog sat", "der park", "chat sur", "Katze!", "x", "42 cats & dogs"])]
    got = {r["doc_id"]: r for r in language.languages(docs.unionByName(make(asked))).collect()}
    for d, t, _ in asked:
        text = " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        text = (" " if not t[0].isalpha() else "") + text
        grams = ["   " + text][0]
        grams = [grams[k : k + 4] for k in range(len(grams) - 3)]
        cost = {lang: sum(-math.log2(chance(g)) for g in grams) / len(grams) for lang, chance in learned.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[d]["lang_pred"] == best, (t, cost)
        z = 1 / (1 + sum(2 ** -((cost[x] - cost[best]) * min(len(grams), language.CONFIDENT)) for x in cost if x != best))
        assert got[d]["score"] == pytest.approx(z, abs=1e-4) or not t[0].isalpha()


def test_copies_keep_their_labels(spark, make):
    """One mislabelled copy among many is not what the others are."""
    rows = [(k, "you utter rotter of a person" if k % 2 else "a kind word for you all") for k in range(400)]
    labels = spark.createDataFrame([(d, 1 if d == 2 else d % 2) for d, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(make(rows), labels, least_texts=1, least_lift=1.0).collect()}
    assert all(got[d] < 0.1 for d in range(0, 400, 2)) and all(got[d] > 0.5 for d in range(1, 400, 2))
    unlimited = toxicity.toxicity(make(rows), labels, lexicon=None, least_texts=1, least_lift=1.0).collect()
    assert {r["doc_id"]: r["score"] for r in unlimited} == pytest.approx(got)


def test_scores_of_toxicity_by_hand():
    x, n, t = [[0], [0, 1], [], [1]], np.array([30.0, 10.0, 500.0, 20.0]), np.array([25.0, 10.0, 3.0, 1.0])
    constant, w = toxicity.fit_words(x, n, t, 2)
    # the same rows one by one
    each = [r for r, k in zip(x, n, strict=True) for _ in range(int(k))]
    y = [1.0] * 25 + [0.0] * 5 + [1.0] * 10 + [1.0] * 3 + [0.0] * 497 + [1.0] + [0.0] * 19
    again, v = toxicity.fit_words(each, np.ones(len(each)), np.array(y), 2)
    assert constant == pytest.approx(again) and np.allclose(w, v)
    p = [1 / (1 + np.exp(-(constant + sum(w[k] for k in r)))) for r in x]
    grad = [sum(t[i] - n[i] * p[i] for i in range(4) if k in x[i]) for k in (0, 1)]
    assert np.allclose(grad, w, atol=1e-3)


def test_restored_texts():
    words = "the idiot was a moron and worthless stupid scum loser of pathetic trash clown disgusting people with this other that from there".split()
    total = np.zeros(64**3)
    for w in words * 20:
        c = toxicity.codes(f" {w} ").astype(int)
        np.add.at(total, (c[:-2] * 64 + c[1:-1]) * 64 + c[2:], 1)
    r = toxicity.Restorer(toxicity.CharModel(np.arange(64**3), total))
    for said, meant in {"a i d i o t": "idiot", "1d10t": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "s.c.u.m": "scum", "l0ser": "loser", "stuuupid": "stupid", "tr@sh": "trash", "w0rthle55": "worthless", "cl0wn!!": "clown", "p-a-t-h-e-t-i-c": "pathetic", "s  c  u  m": "scum", "i\td\ti\to\tt": "idiot", "m - o - r - o - n": "moron", "l. o.s -e  r": "loser"}.items():
        assert meant in r.words(f"there {said.upper()} other"), said
    assert r.words(None) == set() and r.words("plain words") == {"plain", "words"}


def test_long_spans_are_restored():
    words = "the idiot was a moron and stupid people with this other that from there".split()
    total = np.zeros(64**3)
    for w in words * 20:
        c = toxicity.codes(f" {w} ").astype(int)
        np.add.at(total, (c[:-2] * 64 + c[1:-1]) * 64 + c[2:], 1)
    r = toxicity.Restorer(toxicity.CharModel(np.arange(64**3), total))
    assert "idiot" in r.words("idi" + "o" * 100 + "t")
    # a word that lies across the 32nd letter of a run set apart
    run = " ".join("people" * 5 + "stupid" + "people")
    assert [m.group() for m in toxicity._SPACED.finditer(run)] == [run] and "stupid" in r.words(run)
    assert any("moron" in w for w in r.words("w1th" * 15 + "m0r0n"))
    for long in ("a b " * 50_000, "!" * 200_000, "x" * 200_000, "$" * 200_000 + "a", "ab1" * 30_000):
        assert r.words(long) is not None


def test_viterbi_finds_the_best_reading():
    import itertools

    rng = np.random.default_rng(1)
    n = rng.integers(0, 50, 64**3).astype(float)
    m = toxicity.CharModel(np.arange(64**3), n)

    def cost(reading):
        a = b = s = 0
        for ch in reading:
            z = 0 if ch == " " else toxicity._INDEX.get(ch, 1)
            s += float(m.log[a, b, z])
            a, b = b, z
        return s + float(m.log[a, b, 0])

    for span in ("1d10t", "a11y", "$6c!b"):
        best = max(itertools.product(*toxicity.lattice(span)), key=lambda p: cost("".join(x for x, _ in p)) - sum(c for _, c in p))
        assert toxicity.viterbi(span, m) == "".join(x for x, _ in best)

    def apart_cost(pick):
        return cost("".join(x for x, _ in pick)) - sum(c for _, c in pick)

    for span in ("a1d0", "m0b$"):  # a word may end before any letter
        ways = [r if not k else [*r, *((f" {x}", c + toxicity.NEW_WORD) for x, c in r)] for k, r in enumerate(toxicity.lattice(span))]
        best = max(itertools.product(*ways), key=apart_cost)
        assert toxicity.viterbi(span, m, apart=True) == "".join(x for x, _ in best)


def test_filter_keeps_columns(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert toxicity.without_toxic(none, labels).count() == 0


def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in language.languages(docs).collect()}
    held = [r for r in docs.collect() if out_of(r["doc_id"], 3, 1)]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    wrong = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'xx' ELSE lang END AS lang")
    assert {r["lang_pred"] for r in language.languages(wrong).collect()} == {"de", "en", "es", "fr"}


def test_language_odd_tables(odd, none):
    rows = {}
    for r in language.languages(odd).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == odd.count()
    assert all(rows[d][0]["lang_pred"] == "und" for d in (2, 3, 4, 5))
    assert rows[1][0]["lang_pred"] in ("en", "fr") and all(0 <= x["score"] <= 1 for r in rows.values() for x in r)
    assert language.languages(none).count() == 0


def test_kneser_ney_sums_to_one():
    rng = random.Random(1)
    text = "".join(rng.choice("abcd ") for _ in range(3000))
    g, n = np.unique(np.concatenate(list(language.grams(text))), return_counts=True)
    m = language.KneserNey(g, n)
    for context in (g[:5] >> np.uint64(16)).tolist():
        asked = np.array([(context << 16) | z for z in range(65536)], dtype=np.uint64)
        assert m.chance(asked).sum() == pytest.approx(1, abs=1e-6)


def test_models_hold_every_gram(spark, monkeypatch):
    docs = table(spark, SF, "documents").filter("doc_id % 5 = 0")
    whole = sorted(language.languages(docs).collect())
    g, n = zip(*[(r["gram"] & (2**64 - 1), r["n"]) for r in language.gram_counts(docs.filter("lang = 'fr'")).collect()], strict=True)
    g, n = np.array(g, np.uint64), np.array(n)
    monkeypatch.setattr(language, "GRAMS", 20)
    few = language.learn(docs)
    assert len(few.known) <= 80 and all(len(m.levels[0][1]) > 1000 for m in few.models)
    m = few.models[few.names.index("fr")]
    want = language.KneserNey(g, n)
    asked = np.concatenate([g, g ^ np.uint64(1), g ^ np.uint64(1 << 50)])
    assert np.allclose(m.chance(asked), want.chance(asked), rtol=1e-12)
    b = -np.log2(want.chance(g))
    assert few.own[few.names.index("fr")] == pytest.approx((b * n).sum() / n.sum())
    cut = sorted(language.languages(docs).collect())
    assert [r[:3] + r[4:] for r in cut] == [r[:3] + r[4:] for r in whole]
    assert np.allclose([r["score"] for r in cut], [r["score"] for r in whole])


def test_slices_make_the_same_grams(monkeypatch):
    text = "Hello, wörld!  123 again\nand " * 50
    whole = np.concatenate(list(language.grams(text)))
    monkeypatch.setattr(language, "_SLICE", 7)
    assert np.array_equal(whole, np.concatenate(list(language.grams(text))))


def test_without_labels_nothing_is_toxic(spark, make):
    docs = make([(k, f"some words {k}") for k in range(20)])
    for labels in ([], [(1, 0, 1)], [(1, 0, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert toxicity.without_toxic(docs, known).count() == 20
        assert {r.predicted for r in toxicity.toxicity(docs, known).collect()} == {0}


def test_few_toxic_texts_are_enough(spark):
    """The smallest table has ten toxic labels: no threshold may hide their words."""
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    rows = toxicity.op10_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert sum(r.predicted for r in rows if r.toxic) >= 7 and sum(r.predicted for r in rows if not r.toxic) == 0
