"""Operators 3, 5, 6, 7 and 9: against the libraries, brute force, round trips, and on odd tables."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weathernorm.llm import decontamination as dec
from weathernorm.llm import mixing, packing, pii, pretokens
from weathernorm.llm import token_counts as tc


@pytest.fixture(scope="module")
def sp():
    return pretokens.processor(pretokens.model_path())


def texts(n=300):
    rng = random.Random(4)
    parts = ["a", "ab", " ", "  ", "\n", "▁", "é", "<s>", "</s>", "\x00", "\t", "the ", "漢", "😀", "　", "\xa0", "!", "@", "ing", "²", "_", ".", "1", "m²", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_token_counts_are_the_library_s(make, odd, none, sp):
    docs = make([(k, t) for k, t in enumerate(texts())]).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.token_counts(docs).collect())
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 4096) for r in docs.collect())
    assert got == want
    assert tc.token_counts(none).count() == 0


@pytest.mark.parametrize("most", [0, 5, 150_000])
def test_slices_and_a_full_cache_change_nothing(sp, monkeypatch, most):
    monkeypatch.setattr(pretokens.Lengths, "CACHE_ENTRIES", most)
    monkeypatch.setattr(pretokens, "SLICE_BYTES", 64)
    monkeypatch.setattr(pretokens, "GATHERED", 10)
    encoder = pretokens.Encoder(pretokens.model_path())
    lengths = pretokens.Lengths(encoder, {"the": 1})
    said = [*texts(400), None, ""]
    column = pa.array(["", *said]).slice(1)
    want = [sp.encode(t or "") for t in said]
    assert [x.tolist() for x in encoder.ids(column)] == want
    for _ in range(2):
        assert encoder.lengths(column, lengths).tolist() == list(map(len, want))
    assert len(lengths.cache) <= most and list(encoder.ids(pa.array([], pa.string()))) == []


def test_packing_round_trip(make, odd, none, sp):
    docs = make([(k + 100, " ".join(texts(20)) * (1 + k % 40)) for k in range(40)]).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = packing.pack(docs, length=256, window_tokens=20_000).collect()
    parts = {}
    for r in rows:
        ids, cu = np.frombuffer(r["input_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 256 and cu[-1] == r["n_tokens"] and not ids[cu[-1] :].any()
        position = packing.positions(r["position_resets"], 256)
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], cu, cu[1:], strict=False):
            parts.setdefault(d, {}).setdefault(p, []).append(ids[a:b].tolist())
            assert position[a:b].tolist() == list(range(b - a))
    single = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in (1, None)}
    for d, text in single.items():
        assert sum((parts[d][k][0] for k in sorted(parts[d])), []) == sp.encode(text or "")
    assert sum(len(x) for p in parts[1].values() for x in p) == sum(len(sp.encode(r["text"])) for r in docs.filter("doc_id = 1").collect())
    assert packing.pack(none).count() == 0
    assert packing.matrix([r["input_ids"] for r in rows], 256).shape == (len(rows), 256)


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(1)
    sizes = [rng.randint(0, 64) for _ in range(500)]
    room = []
    for i in sorted(range(500), key=lambda i: (-sizes[i], i)):
        fits = [k for k, r in enumerate(room) if r >= sizes[i]]
        k = min(fits, key=lambda k: room[k], default=None)
        if k is None:
            room.append(64)
            k = len(room) - 1
        room[k] -= sizes[i]
    got = packing.best_fit_decreasing(sizes, 64)
    assert sorted(i for r in got for i in r) == list(range(500))
    assert sorted(64 - sum(sizes[i] for i in r) for r in got) == sorted(room)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, bench):
    w = WORD.findall((text or "").translate(LOW))
    hit, items = set(), set()
    for item, b in bench:
        v = WORD.findall((b or "").translate(LOW))
        for k in range(max(1, len(v) - 9)) if v and item is not None else ():
            win = v[k : k + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    items.add(str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination_is_brute_force(spark, make, odd, none, most):
    rng = random.Random(3)
    vocabulary = ["a", "B", "cé", "d1", "É", "the"]
    say = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(n))
    bench = [(1, say(14)), (2, say(10)), (10, "the cé the B"), (3, None), (None, say(12)), (4, ""), (5, "rare"), (5, "words")]
    docs = [(k, say(30)) for k in range(60)] + [(k + 100, f"{say(5)} {rng.choice(bench[:2])[1].upper().replace('É', 'é')} {say(4)}") for k in range(20)] + [(k + 200, bench[k % 2][1] + " " + bench[k % 2][1]) for k in range(4)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    frame = make(docs).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in dec.contamination(frame, b, max_windows=most).collect())
    want = sorted(repr((r["doc_id"], *brute_hits(r["text"], bench))) for r in frame.collect())
    assert got == want
    kept = dec.decontaminate(odd, b, max_windows=most)
    assert kept.columns == odd.columns and kept.count() == sum(not brute_hits(r["text"], bench)[-1] for r in odd.collect())
    cut = dec.decontaminate(frame, b, remove="spans", max_windows=most)
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert left[200] == "" and cut.count() == frame.count()
    passage = bench[1][1]
    kept = dec.decontaminate(make([(1, f"--Éa B?  (see: {passage}!) End."), (2, "Left  As-It, is"), (3, passage)]), b, remove="spans", max_windows=most)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: "--Éa B?  (see: End.", 2: "Left  As-It, is", 3: ""}
    assert dec.contamination(none, b, max_windows=most).count() == 0
    assert dec.contamination(frame, b.limit(0), max_windows=most).filter("contaminated").count() == 0


def test_mixing_meets_the_shares(spark, make, odd, none):
    docs = make([(k, "x" * 10, "en", "hot" if k % 3 else f"s{k % 5}") for k in range(6000)])
    out = mixing.mix(docs, weights={"hot": 0.25, "s0": 0.5, "s1": 0.25})
    share = {r["source"]: r["count"] / 6000 for r in out.groupBy("source").count().collect()}
    assert share["hot"] == pytest.approx(0.25, abs=0.03) and share["s0"] == pytest.approx(0.5, abs=0.04)
    assert set(share) == {"hot", "s0", "s1"}
    again = mixing.mix(docs.repartition(9), weights={"hot": 0.25, "s0": 0.5, "s1": 0.25})
    assert out.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).count() == 0
    # the inverse of the distribution: mean and variance are the rate
    n = spark.range(40_000).withColumn("c", mixing.poisson_cdf(F.lit(2.5)))
    n = n.withColumn("n", F.size(F.filter("c", lambda c: c <= mixing.uniform(F.col("id"), 1))))
    m = n.agg(F.avg("n"), F.var_pop("n")).first()
    assert m[0] == pytest.approx(2.5, abs=0.05) and m[1] == pytest.approx(2.5, abs=0.1)
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "copies_", "copy_"] and {r["copies"] for r in mixed.collect()} == {1}
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError, match="repetition rate"):
        mixing.mix(make([(k, "x" * (1 if k else 100_000), "en", "a" if k else "b") for k in range(3)]), weights={"a": 1.0})


@pytest.mark.parametrize("most", [20_000, 1])
def test_rates_of_any_size_are_inverted(make, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", most)
    docs = make([(1, "x", "en", "rare"), (2, "y" * 4_000_000, "en", "hot")])
    rate = 4_000_001 / (1 + 2000)
    copies = {r["doc_id"]: r["n"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    u = int(hashlib.md5(b"1:7:x").hexdigest()[:13], 16) / 16**13
    terms = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(4000)]
    assert copies[1] == int((np.cumsum(terms) <= u).sum())


def test_large_rates_by_brute_force(spark, make):
    for rate in (501.5, 39_000.0):
        k = np.arange(int(rate + 10 * rate**0.5 + 25))
        c = np.cumsum(np.exp(-rate + k * math.log(rate) - np.array([math.lgamma(x + 1) for x in k.tolist()])))
        got = spark.range(500).select(mixing.uniform(F.col("id"), 3).alias("u")).withColumn("n", mixing.poisson_count(F.lit(rate), F.col("u"))).collect()
        assert [r["n"] for r in got] == [int((c <= r["u"]).sum()) for r in got]
    docs = make([(k, "x" * (1 if k else 100_000), "en", "a" if k else "b") for k in range(3)])
    out = mixing.mix(docs, weights={"a": 1.0}, max_rate=None).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.max("copies").alias("copies")).collect()
    assert len(out) == 2 and all(r["n"] == r["last"] == r["copies"] and abs(r["n"] - 50_001) < 10 * 50_001**0.5 for r in out)


def test_rows_without_ids_draw_for_themselves(spark, make, monkeypatch):
    docs = make([(None, f"text {k}", "en", "a", 0.5, 1.0, 2, "x") for k in range(2000)], ", mix_rate double, mix_cdf double, mix_salt int, mix_source string")
    for most in (20_000, 0):
        monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", most)
        out = mixing.mix(docs)
        assert out.columns == [*docs.columns, "copies", "copy"]
        copies = [r["n"] for r in out.groupBy("text").agg(F.count("*").alias("n")).collect()]
        assert abs(sum(copies) - 2000) < 200 and {1, 2, 3} <= set(copies)


def test_items_that_share_a_window_many_times_are_joined(spark, make, monkeypatch):
    b = spark.createDataFrame([(k, "one two three") for k in range(50)], "item_id long, text string")
    joined = []
    monkeypatch.setattr(dec, "_scan_joined", lambda *x, f=dec._scan_joined: joined.append(1) or f(*x))
    got = dec.contamination(make([(1, "zero one, two THREE four")]), b, max_windows=5).first()
    assert joined and (got["n_hit"], got["n_items"]) == (3, 50)


def test_many_sources_are_joined(make, monkeypatch):
    docs = make([(k, "abc" * (1 + k % 7), "en", f"s{k % 11}" if k % 5 else None) for k in range(500)])
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 3)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect()) == want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    parts = ["a", "@", ".", "1", "23", "255", "+", "-", " ", "4111111111111111", "é", ".com", "(", "x@y.z", "00000001", ")", "@-", "+1 (555) 010-9999"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_adds_and_keeps(make, odd, none):
    rows = [(k + 1000, f"é mail me at user{k}@mail.org or call +1 (555) 010-{1000 + k} today, token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" here") for k in range(60)]
    rows += [(k + 2000, f"version 1.2.3 of section {k} costs 4111 1111 1111 1112 units") for k in range(60)]
    docs = make(rows).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    out = {r["doc_id"]: r for r in pii.pii_spans(docs).collect()}
    for d, t in rows:
        base = pii.joined(brute_spans(t))
        assert out[d]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(out[d]["spans"].split(","))
    assert (out[1005]["n_email"], out[1005]["n_phone"]) == (1, 1)
    assert sum("secret" in out[k + 1000]["spans"] for k in range(60)) == 60
    assert out[2]["spans"] == "" and len(out) == len({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert pii.pii_spans(none).count() == 0


def test_reliabilities_are_brute_force_em():
    rng = random.Random(9)
    good, patterns = {}, {}
    for _ in range(4000):  # labelers that are right nine, eight and six times in ten; two that abstain
        truth = rng.random() < 0.3
        vote = "".join("yn"[truth ^ (rng.random() < right)] for right in (0.9, 0.8, 0.6)) + "--"
        vote = vote.translate(str.maketrans("yn", "yn"))
        patterns[vote] = patterns.get(vote, 0) + 1
        good[vote] = good.get(vote, 0) + truth
    rows = [("card", v, n) for v, n in sorted(patterns.items())]
    got = pii.reliabilities(rows)
    # the same by loops over votes
    p = {v: min(0.95, max(0.05, (v.count("y") + 0.5) / (sum(c != "-" for c in v) + 1))) for v in patterns}
    for _ in range(50):
        n = sum(patterns.values())
        prior = min(0.99, max(0.01, sum(p[v] * patterns[v] for v in p) / n))
        odds = dict.fromkeys(p, math.log(prior / (1 - prior)))
        for j in range(5):
            chance = []
            for truth in (True, False):
                counts = {c: sum((p[v] if truth else 1 - p[v]) * patterns[v] for v in p if v[j] == c) for c in "yn-"}
                counts = {"y": counts["y"] + (2 if truth else 1), "n": counts["n"] + (1 if truth else 2), "-": counts["-"] + 1}
                chance.append({c: x / sum(counts.values()) for c, x in counts.items()})
            for v in odds:
                odds[v] += math.log(chance[0][v[j]] / chance[1][v[j]])
        p = {v: 1 / (1 + math.exp(-min(30, max(-30, x)))) for v, x in odds.items()}
    assert all(got["card", v] == pytest.approx(p[v], abs=1e-9) for v in p)
    assert got["card", "yyy--"] > 0.9 > 0.1 > got["card", "nnn--"]


def test_the_span_classifier_is_a_logistic_regression():
    patterns = [(v, f"phone|{k}|{k % 5}|{k % 4}", 0.9 if v[0] == "y" else 0.1, 5 + k) for k in range(10) for v in ("yyyyy", "nnn-n", "-ynyn", "ynyn-")]
    w = pii.fit_classifier(patterns)
    grad = dict.fromkeys(w, 0.0)
    for v, s, p, n in patterns:
        f = pii.features(v, s)
        q = 1 / (1 + math.exp(-sum(w[x] for x in f)))
        for x in f:
            grad[x] += n * (p - q)
    assert all(grad[x] == pytest.approx(w[x], abs=1e-3) for x in w)  # the ridge of 1 holds what is left


def test_recall_by_kind(make):
    luhn = lambda d: d + next(str(c) for c in range(10) if pii.luhn(d + str(c)))
    said = {
        "email": [f"write to user{k} (at) host{k} (dot) de or user{k}@host{k}.de" for k in range(40)],
        "ip": [f"der server 10.{k}.3.{k} antwortet" for k in range(40)],
        "card": [f"pay by card {luhn(str(4000_0000_0000_000 + 7919 * k))} please" for k in range(40)],
        "phone": [f"appeler le +33 6 12 34 56 {10 + k} demain" for k in range(40)],
        "secret": [f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}"' for k in range(40)],
        "name": [f"my name is {n.title()} Stone" for n in pii.GIVEN[:40]],
    }
    docs = [(len(x) * j + k, f"plain words first, {text}, and more after") for j, x in enumerate(said.values()) for k, text in enumerate(x)]
    docs += [(1000 + k, f"plain words about nothing in section {k} of the book, nobody is named") for k in range(100)]
    out = {r["doc_id"]: r for r in pii.pii_spans(make(docs)).collect()}
    for j, kind in enumerate(said):
        found = [f"{kind}:" in out[40 * j + k]["spans"] for k in range(40)]
        assert sum(found) >= 38, (kind, sum(found))
    assert not any(out[1000 + k]["has_pii"] for k in range(100)) and all(r["n_all"] == len([x for x in r["spans"].split(",") if x]) for r in out.values())


def test_pii_keeps_its_own_columns_apart(make):
    docs = make([(1, "mail a@b.de", "en", "s", 1, "x")], ", start int, votes string")
    assert [r["n_email"] for r in pii.pii_spans(docs).collect()] == [1]
    assert [r["n_tokens"] > 0 for r in tc.token_counts(docs.withColumn("n_tokens", F.lit("x"))).collect()] == [True]
    assert packing.pack(docs.withColumn("pieces", F.lit(1))).count() == 1


def test_spelt_addresses_of_any_case_and_all_patterns(monkeypatch):
    for text in ("JOHN (AT) EXAMPLE (DOT) COM", "john at example [dot] com", "john at example(dot)com", "john (at) example dot com"):
        assert (0, 0, len(text)) in pii.candidates(text, []), text
    patterns = [(v, f"email|{k}|{k % 5}|{k % 4}", 0.9 if v[0] == "y" else 0.2, 1 + k) for k in range(10) for v in ("yyyyy", "nnn-n", "-ynyn")]
    whole = pii.fit_classifier(patterns)
    monkeypatch.setattr(pii, "FIT_BLOCK", 7)
    parts = pii.fit_classifier(patterns)
    assert whole.keys() == parts.keys() and all(abs(whole[f] - parts[f]) < 1e-6 for f in whole)


@pytest.mark.parametrize("text", ["ACGT" * 250_000 + "1", "1" * 1_000_000 + ".2.3", "1." * 500_000, "a at b dot " * 90_000, ("a" * 1000 + " at ") * 1000 + "dot com", "a." * 500_000 + " at 1", "@ab-" + "a" * 1_000_000, "+1 " * 330_000, "token " * 160_000 + "= 1"])
def test_personal_data_takes_time_by_a_text_s_length(text):
    import time

    start = time.process_time()
    base = pii.base_spans(text)
    pii.candidates(text, base)
    assert time.process_time() - start < 4  # quadratic time would be minutes


def test_spelt_addresses_are_the_leftmost():
    import random
    import re

    plain = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}", re.I)
    draw = random.Random(5)
    for _ in range(5000):
        text = "".join(draw.choice(["1", "a", "B-", "_", " at ", "(at)", "[AT]", " dot ", "(dot)", " ", "com", "x%", "@", "."]) for _ in range(20))
        assert pii.spelt(text) == [m.span() for m in plain.finditer(text)]
