"""Operators 2 and 8 and the pipeline against brute force, and on odd tables."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weathernorm.llm import decontamination, neighbours
from weathernorm.llm import near_duplicates as nd
from weathernorm.llm.common import table


def sets_of(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> (links, smallest id of the cluster)."""
    s = {d: sets_of(t) for d, t in rows}
    parent, links = {d: d for d in s}, defaultdict(int)

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(s, 2):
        common = 0 if s[a].isdisjoint(s[b]) else len(s[a] & s[b])
        if common and common >= 0.8 * (len(s[a]) + len(s[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (links[d], root(d)) for d in s}


def corpus(groups, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for size, edits in groups:
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("small", "block"), [(48, 1024), (2, 8)])
def test_near_duplicates_are_brute_force(make, monkeypatch, small, block):
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus([(60, 6), (5, 1), (3, 0), *[(1, 0)] * 20])
    rows += [(1000 + k, "short text") for k in range(3)] + [(2000, "one"), (2001, "ONE ")]
    want = brute(rows)
    got = {r["doc_id"]: r for r in nd.near_duplicates(make(rows)).collect()}
    assert {d: (r["n_links"], r["cluster_id"]) for d, r in got.items()} == want
    if small > 2:
        kept = sorted(r["doc_id"] for r in nd.one_of_each(make(rows)).collect())
        assert kept == sorted({c for _, c in want.values()})


def test_near_duplicates_of_a_corpus(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_links"], r["cluster_id"]) for r in nd.near_duplicates(docs).collect()}
    links = sum(n for n, _ in want.values())
    assert links > 100 and abs(sum(n for n, _ in got.values()) - links) <= 0.002 * links
    assert sum(got[d] != want[d] for d in want) <= 2


def test_near_duplicates_odd_tables(odd, none, make):
    rows = nd.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r["n_links"])
    assert sorted(by[1]) == [0, 3, 3] and by[8] == [3] and by[None] == [3] and by[2] == by[3] == by[4] == [0]
    kept = nd.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12]))
    assert len({r["text"] for r in kept.filter("doc_id = 1").collect()}) == 2
    assert nd.near_duplicates(none).count() == 0 and nd.one_of_each(none).count() == 0
    assert nd.near_duplicates(make([(1, None), (2, "")])).count() == 2


def test_prefixes_shorten_to_the_recall():
    chance = [1 - (1 - 0.8**p) ** nd.TREES for p in range(1, nd.DEPTH + 1)]
    last = nd.length_for(0.8, 0.999)
    assert chance[last - 1] >= 0.999 > chance[last] and nd.length_for(0.99, 0.5) == nd.DEPTH


def test_prefixes_shorten_until_the_sample_s_pairs_are_found(make, monkeypatch):
    # one tree of six labels meets few pairs: only the measured recall makes the prefix short enough
    rows = corpus([*[(2, 8)] * 60])
    want = {d: c for d, (_, c) in brute(rows).items()}
    monkeypatch.setattr(nd, "length_for", lambda **_: nd.DEPTH)
    asked = []
    monkeypatch.setattr(nd, "_apart", lambda paths, length, labels, f=nd._apart: asked.append(length) or f(paths, length, labels))
    monkeypatch.setattr(nd, "_measured", lambda *x, f=nd._measured: asked.append(f(*x)) or asked[-1])
    got = {r["doc_id"]: r["cluster_id"] for r in nd.near_duplicates(make(rows)).collect()}
    assert got == want and asked and asked[-1] == 1.0


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(3)
    base = " ".join(f"w{x}" for x in rng.integers(0, 10_000, 400))
    texts = [base, base.replace("w1", "v1"), base.upper(), "one two three", "", None, "a b c d e"]
    sets = nd.shingle_sets(texts)
    assert [len(s) for s in sets[3:]] == [1, 0, 0, 1] and np.array_equal(sets[0], sets[2])
    assert all(np.array_equal(s, nd.shingle_sets([t])[0]) for s, t in zip(sets, texts, strict=True))
    agree = (nd.signature(sets[0]) == nd.signature(sets[1])).mean()
    assert abs(agree - nd.jaccard(sets[0], sets[1])) < 0.2
    probes = nd.Probes([s for s in sets if len(s)])
    assert probes.similar(sets[0]) == [] and nd.Probes([]).similar(sets[0]) == []
    assert nd.Probes([sets[0]]).similar(sets[0][:-2]) == [nd.digest(sets[0])]


def test_near_copies_without_ids_or_with_one(make):
    (_, text), (_, near) = corpus([(2, 0)])[0], corpus([(2, 0)])[1]
    near = text + " more"
    rows = [(None, text), (None, near), (None, text), (7, "other words that nobody else says here at all"), (7, "and " + text), (9, None), (9, "")]
    docs = make([(*r, "en", "s", "i", 1, 2) for r in rows], ", _id string, _hash int, near_id int")
    got = nd.one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert kept == sorted([(7, "and " + text), (7, rows[3][1]), (9, ""), (9, "")])
    alone = nd.one_of_each(make([(None, text), (None, near), (None, text)])).collect()
    assert len(alone) == 1
    links = sorted(r["n_links"] for r in nd.near_duplicates(docs).collect())
    assert links == [0, 0, 0, 3, 3, 3, 3]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r["rep"]: r["cluster"] for r in nd.components(edges, "chain").collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100


def test_clusters_are_merged_by_further_links(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21), (40, 41)], "a long, b long")
    labels = nd.components(edges, "some")
    new = spark.createDataFrame([(3, 11), (11, 21), (5, 21), (6, 7), (41, 40)], "a long, b long")
    got = {r["rep"]: r["cluster"] for r in nd.merged(labels, new, "some").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 1, 21: 1, 5: 1, 6: 6, 7: 6, 40: 40, 41: 40}
    none = nd.merged(labels, new.limit(0), "some").collect()
    assert sorted(map(tuple, none)) == sorted(map(tuple, labels.collect()))


def vectors(spark, rows):
    clash = [(*r, 1, "v", 0.5) for r in rows]
    return spark.createDataFrame(clash, "vec_id long, embedding array<float>, label int, j int, v string, x double")


def test_neighbours_recall_and_scores(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    pdf = df.toPandas()
    x, ids = np.array(pdf["embedding"].tolist(), dtype=np.float64), pdf["vec_id"].to_numpy()
    got = neighbours.nearest(df).toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["score"].is_monotonic_increasing
        assert np.allclose(mine["score"], [d[ids == v][0] for v in mine["vec_id"]])
        hit, total = hit + len(set(mine["vec_id"]) & set(ids[np.lexsort((ids, d))[:10]])), total + 10
    assert hit / total >= 0.95


def test_every_query_has_k_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 64))
    dense = [(centres[j % 4] + 0.01 * rng.standard_normal(64)).tolist() for j in range(1000)]
    sparse = rng.standard_normal((500, 64)).tolist()
    rows = [(j, v, 0) for j, v in enumerate(dense + sparse)]
    asked = {j for j in range(1500) if j % 7 == 0}
    got = neighbours.nearest(vectors(spark, rows), every=7).collect()
    found = {j: {r["vec_id"] for r in got if r["query_id"] == j} for j in asked}
    assert all(len(x) == 10 for x in found.values())
    x = np.array([v for _, v, _ in rows])
    true = {j: set(np.argsort(((x - x[j]) ** 2).sum(1), kind="stable")[1:11].tolist()) for j in asked}
    assert np.mean([len(found[j] & true[j]) / 10 for j in asked if j >= 1000]) > 0.9
    few = neighbours.nearest(vectors(spark, rows[995:1006]), every=1).collect()
    assert len(few) == 110


def test_neighbours_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist(), 0) for k in range(1, 60)]
    rows += [(k, [1.0] * 8, 0) for k in (100, 200, *range(300, 340))] + [(100, [1.0] * 8, 0)]
    rows += [(400, None, 0), (500, [0.0] * 8, 0), (600, [float("nan")] + [1.0] * 7, 0), (700, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (800, [1.0, 2.0], 0)]
    got = neighbours.nearest(vectors(spark, rows)).toPandas()
    assert set(got["query_id"]) == {100, 200, 300}
    of = lambda q: got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist()
    assert of(100) == [200, *range(300, 309)] and of(200) == [100, *range(300, 309)] and of(300) == [100, 200, *range(301, 309)]
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    assert neighbours.nearest(vectors(spark, [(100, [1.0, 2.0], 0)])).count() == 0
    few = neighbours.nearest(vectors(spark, [(100, [1.0, 2.0], 0), (7, [1.0, 3.0], 0)])).collect()
    assert [tuple(r) for r in few] == [(100, 1, 7, 1.0)]


@pytest.mark.parametrize("width", [16, 32, 64])
def test_probes_meet_all_codes_within_the_radius_once(width):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, (2000, 2)).astype(np.uint64)
    near = codes[:50] ^ (np.uint64(1) << rng.integers(0, 64, (50, 2)).astype(np.uint64))
    codes = np.concatenate([codes, near])
    for radius in (0, 3, 7, 40, 64, 128):
        split = neighbours.Substrings(2, width, radius, 3)
        postings = [neighbours.Postings(codes, split, j) for j in range(split.number)]
        firsts = [split.firsts(codes, j) for j in range(split.number)]
        for q in codes[:20]:
            want = np.flatnonzero(neighbours.hamming(codes, q) <= radius)
            found = []
            for j in range(split.number):
                at, h = postings[j].within(q)
                assert np.array_equal(h, neighbours.hamming(codes[at], q))
                assert split.reach[j] < 0 or np.isin(firsts[j][at], split.probes(q[None], j)).all()
                found += at.tolist()
            assert sorted(found) == want.tolist()


def test_small_shards_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((3, 16))
    rows = [(j, (centres[j % 3] + (0.02 if j % 3 else 1) * rng.standard_normal(16)).tolist(), 0) for j in range(600)]
    want = sorted(map(tuple, neighbours.nearest(vectors(spark, rows), every=5).collect()))
    monkeypatch.setattr(neighbours, "SHARD", 60)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, neighbours.nearest(vectors(spark, rows), every=5).collect())) == want and len(want) == 1200


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline

    sf, docs, kept = "/root/testdata/sf0.001", None, {}
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = (before, docs)
        assert name == "token_ids" or docs.columns == columns
    before, after = kept["near_duplicates"]
    want = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c in want.values()})
    before, after = kept["decontamination"]
    dirty = decontamination.contamination(before, table(spark, sf, "benchmark")).filter("contaminated").count()
    assert dirty and after.count() == before.count() - dirty
    packed = kept["token_ids"][1].select(F.explode("doc_ids")).distinct()
    assert packed.count() == kept["mixing"][1].select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept)


def test_stages_take_odd_tables(spark, odd, none):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    clash = odd.withColumn("_id", F.lit("x")).withColumn("mix_cdf", F.lit(1)).withColumn("pieces", F.lit(2))
    text = lambda df: sorted((r["doc_id"] or -1, r["text"] or "") for r in df.select("doc_id", "text").collect())
    rows = text(clash)
    want = {
        "toxicity": rows,
        "near_duplicates": [x for k, x in enumerate(rows) if x[0] != -1 and x[0] != 8 and x not in rows[:k]],
        "decontamination": rows,
        "mixing": None,
        "token_ids": None,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, sf)
        assert name == "token_ids" or out.columns == clash.columns
        if want[name] is not None:
            assert text(out) == want[name], name
        assert stage(spark, none, sf).count() == 0
    copies = {r["text"] for r in corpus_pipeline.mixed(spark, clash, sf).select("text").collect()}
    assert copies <= {r["text"] for r in clash.select("text").collect()}
    packed = corpus_pipeline.packed(spark, clash, sf).select(F.explode("doc_ids")).collect()
    assert {r[0] for r in packed} == {r["doc_id"] for r in clash.select("doc_id").collect()}


def test_the_run_leaves_its_result_only(spark):
    import corpus_pipeline
    from weathernorm.llm.common import scratch_tables

    with scratch_tables(spark) as made:
        out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
        rows = out.count()
        exists = lambda at: (p := spark._jvm.org.apache.hadoop.fs.Path(at)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        left = [at for at in made if exists(at)]
    assert rows and len(made) > 10 and len(left) == 1 and "token_ids" in left[0]


def test_an_id_with_two_vectors_counts_once(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [0.5, 0.6]), (2, [1.0, 0.1]), (2, [1.0, 0.1])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(100, 1, 1), (100, 2, 2)]  # [0.5, 0.5] is the smaller


def test_sets_are_made_by_bytes_and_blocks_by_their_sum(spark, make, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["word " * 100_000] * 40)], ["doc_id", "text"])
    assert [part.num_rows for part in near_duplicates._slices([batch], 1)] == [16, 16, 8]
    # a cluster of long texts: blocks of a few sets each, and every link is counted
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", 200_000)
    words = [f"w{k}" for k in range(12_000)]
    docs = make([(k, " ".join([*words[:k], f"new{k}", *words[k + 1 :]])) for k in range(0, 90, 6)])
    found = near_duplicates.near_duplicates(docs).collect()
    assert {r.n_links for r in found} == {len(found) - 1} and {r.cluster_id for r in found} == {0}
