"""Operator 2: n-gram Jaccard join by a MinHash LSH forest.

1. A task turns a text into the set of hashes of its runs of five lower-cased words (a text of fewer words
   is one run) and signs the set: ``TREES`` sequences of ``DEPTH`` minimum hashes, each the path of the text
   in one of the forest's prefix tries. Texts with equal sets are one class, known by a digest; all
   that follows is about one representative a class, so copies cost nothing.
2. A path is a string (its tree, then a label for each step), and a trie is the paths in order: texts below one
   node are those whose paths start alike. The search starts at full depth, where each text is compared to
   one leader of its node, another in every tree: one pair a text and node, however large the node. Pairs
   are verified on the sets themselves; verified pairs join texts to clusters (connected components, by
   hooking and pointer jumping).
3. Then prefixes are shortened by one label at a time, and what shares a node and no cluster yet is compared: to a
   leader again, and at the last length all pairs of a node of up to ``SMALL`` texts; in larger nodes blocks of ``BLOCK`` texts are held against
   each other in one task, which counts the common elements of their sets and gives a spanning forest of
   the links that it finds, never the pairs. So no link between clusters is lost, and rows stay linear.
   This ends at the first length at which a pair at the threshold is met with the chance ``recall``, and at
   which that share of the similar pairs of a sample is in one cluster: the sample's texts
   (``PROBES`` at most) are held against every text while those are signed.
4. Inside a cluster all links are counted exactly, in the same blocks.

The result has one row per document: its class, its cluster and its numbers of links.

Edge cases: NULL and empty texts and those without a word have no links, and are each a class of their
own; ids may be NULL or repeat (a class is named by its smallest id, NULL if it has none, and its text is found
by id and hash); other columns are kept or ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lean, saved, table
from .pretokens import slices

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 16, 6
#: Texts of a block in which links are counted, and of a node whose pairs are listed; bytes of a block's sets.
BLOCK, SMALL, BLOCK_BYTES = 1024, 12, 16 << 20
#: Pairs whose signatures agree in less than this share of places are not verified: at the threshold the
#: chance of so few is below 1e-6. 0 verifies every pair.
LEAST_AGREEMENT = 0.55
#: Texts of the sample that measures the recall, and bytes of all of them.
PROBES, PROBE_BYTES = 256, 16 << 20
_CHUNK = 4096


def length_for(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold shares a node with that chance."""
    length = DEPTH
    while length > 1 and 1 - (1 - threshold**length) ** TREES < recall:
        length -= 1
    return length


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)


_A, _B = _constants(TREES * DEPTH, 1)[:, None], _constants(TREES * DEPTH, 2)[:, None]
_M = _constants(WORDS, 3)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += _mixed(h[k : len(h) - n + 1 + k] * _M[k])
    return _mixed(out)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of the runs of words; empty if there is no word."""
    cut = [(text or "").lower().split() for text in texts]
    ends = np.cumsum([0, *map(len, cut)])
    words = np.fromiter(chain.from_iterable(cut), object, int(ends[-1]))
    h = pd.util.hash_array(words) if len(words) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        runs = _run_hashes(h, WORDS) if len(h) >= WORDS else np.zeros(0, np.uint64)
        return [np.unique(runs[a : b - WORDS + 1]) if b - a >= WORDS else _run_hashes(h[a:b], b - a) if b > a else h[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def signature(s: np.ndarray) -> np.ndarray:
    """The minimum of each hash function, 16 bits each, tree by tree."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), _CHUNK):
            low = np.minimum(low, (_A * s[k : k + _CHUNK] + _B).min(1))
        return (_mixed(low) >> np.uint64(48)).astype(np.uint16)


class Probes:
    """The sets of some texts, to find which of them are similar to another set."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        self.digests = [digest(s) for s in sets]
        every, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.element, self.owner = every[order], owner[order]

    def similar(self, s: np.ndarray) -> list[bytes]:
        """Digests of the texts of the sample that are similar to the set, but not equal to it."""
        a, b = np.searchsorted(self.element, s, "left"), np.searchsorted(self.element, s, "right")
        if not (b > a).any():
            return []
        hit = np.concatenate([self.owner[x:y] for x, y in zip(a[b > a], b[b > a], strict=True)])
        common = np.bincount(hit, minlength=len(self.size))
        near = (common >= THRESHOLD * (len(s) + self.size - common)) & ((common < len(s)) | (common < self.size))
        return [self.digests[k] for k in np.flatnonzero(near)]


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _probes(docs: DataFrame) -> Probes:
    """The sets of at most ``PROBES`` documents, picked by the hashes of their ids and texts, of all lengths: with
    ``PROBE_BYTES`` together, those that would not fit are passed over."""
    count, h = docs.count(), F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(5))
    some = docs.select("text", h.alias("h")).filter(F.col("h") / F.lit(2.0**64) + 0.5 <= 2 * PROBES / max(1, count))
    left, picked = PROBE_BYTES, []
    for r in some.select("h", F.octet_length("text").alias("n")).distinct().orderBy("h", "n").limit(2 * PROBES).collect():
        if r["n"] is not None and r["n"] <= left and len(picked) < PROBES:
            left -= r["n"]
            picked.append(r["h"])
    texts = some.filter(F.col("h").isin(picked)).dropDuplicates(["h"]).select("text").toPandas()["text"].tolist() if picked else []
    sets = {digest(s): s for s in shingle_sets(texts) if len(s)}
    return Probes([sets[d] for d in sorted(sets)])


def _slices(batches, column: int):
    """The rows of some batches in slices by the bytes of a column: what a task holds doesn't grow with its texts' lengths
    (a longer one is a slice of its own)."""
    for batch in batches:
        at = 0
        for part in slices(batch.column(column)):
            yield batch.slice(at, len(part))
            at += len(part)


def signed(docs: DataFrame, probes: Probes | None = None) -> DataFrame:
    """doc_id, digest (NULL without a word), signature, the text's own hash and the digests of similar texts of the sample."""
    sent = docs.sparkSession.sparkContext.broadcast(probes or Probes([]))

    def run(batches):
        for own in _slices(batches, 1):
            sets = shingle_sets(own.column(1).to_pylist())
            sig = [signature(s).tobytes() if len(s) else None for s in sets]
            near = [sent.value.similar(s) or None for s in sets]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(map(digest, sets), pa.binary()), pa.array(sig, pa.binary()), own.column(2), pa.array(near, pa.list_(pa.binary()))], ["doc_id", "digest", "sig", "text_hash", "probes"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) text_hash").mapInArrow(lean(run), "doc_id long, digest binary, sig binary, text_hash long, probes array<binary>")


def _paths(reps: DataFrame) -> DataFrame:
    """(rep, path): the paths of each representative, one in each trie: the tree's number and ``DEPTH`` labels."""
    each = [F.concat(F.unhex(F.lit(f"{tree:02x}")), F.substring("sig", 2 * DEPTH * tree + 1, 2 * DEPTH)) for tree in range(TREES)]
    return reps.select("rep", F.explode(F.array(*each)).alias("path"))


def _node(length: int) -> Column:
    """The node that a path goes through after ``length`` labels."""
    return F.substring("path", 1, 1 + 2 * length)


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose signatures agree in enough places."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, TREES * DEPTH) for k in (2, 3))
            keep = pa.array((a == b).mean(1) >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    sig = reps.select("rep", "sig")
    joined = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(lean(run), "a binary, b binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, exactly."""

    def run(batches):
        for batch in batches:
            ok = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= THRESHOLD for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    joined = pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(lean(run), "a binary, b binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(rep, cluster): the smallest rep of the connected component, for each end of an edge.

    Hooking (to the smallest label around) and pointer jumping: rounds grow with the logarithm of a
    component's diameter. Each round is written to the shared folder, which cuts the lineage.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("cluster"))
    labels = saved(labels, f"{name}-labels")
    while True:
        around = both.join(labels.select(F.col("rep").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("cluster").alias("near"))
        hooked = labels.join(around, "rep").select("rep", F.least("cluster", "near").alias("cluster"), F.col("cluster").alias("was"))
        # a text's cluster is a text as well: take over what that one has found
        root = labels.select(F.col("rep").alias("cluster"), F.col("cluster").alias("root"))
        new = saved(hooked.join(root, "cluster", "left").select("rep", F.least("cluster", F.coalesce("root", "cluster")).alias("cluster"), "was"), f"{name}-labels")
        changed = new.filter("cluster < was").limit(1).count()
        labels = new.select("rep", "cluster")
        if not changed:
            return labels


def merged(labels: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``labels`` (rep, cluster) with further links (a, b): only the clusters that these join are gone through again."""
    placed = new.join(labels.toDF("a", "cluster_a"), "a", "left").join(labels.toDF("b", "cluster_b"), "b", "left")
    placed = saved(placed.select("a", "b", F.coalesce("cluster_a", "a").alias("x"), F.coalesce("cluster_b", "b").alias("y")), f"{name}-placed")
    higher = components(placed.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), name).toDF("cluster", "top")
    ends = placed.select(F.col("a").alias("rep"), F.col("x").alias("cluster")).union(placed.select("b", "y"))
    every = labels.union(ends.filter("rep = cluster")).distinct()
    return saved(every.join(higher, "cluster", "left").select("rep", F.coalesce("top", "cluster").alias("cluster")), f"{name}-labels")


def _similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which of some sets are similar enough, exactly: common elements by products of 0/1 strips."""
    size = np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at) > 1  # an element of one set only is common to none
    row = np.repeat(np.arange(len(sets)), size)[often[at]]
    column = (np.cumsum(often) - 1)[at[often[at]]]
    common, shared = np.zeros((len(sets), len(sets)), np.float32), int(often.sum())
    for k in range(0, shared, 4096):
        use = (column >= k) & (column < k + 4096)
        m = np.zeros((len(sets), min(4096, shared - k)), np.float32)
        m[row[use], column[use] - k] = 1
        common += m @ m.T
    common = common.astype(np.float64)
    out = common / (size[:, None] + size[None, :] - common) >= THRESHOLD
    np.fill_diagonal(out, False)
    return out


def _in_blocks(members: DataFrame, by: str) -> DataFrame:
    """Deals the members of each group to the pairs of its blocks (``x`` <= ``y``): a block has about ``BLOCK`` members
    and ``BLOCK_BYTES`` of their sets at most, whichever is less."""
    many = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("set").cast("long")) / BLOCK_BYTES)
    sizes = members.groupBy(by).agg(F.ceil(many).cast("int").alias("blocks"))
    own = members.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))


def _forest(members: DataFrame) -> DataFrame:
    """(a, b): spanning forests of the links inside each node. ``members``: (node, rep, set)."""

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rep, near = pdf["rep"].tolist(), _similar([np.frombuffer(x, np.uint64) for x in pdf["set"]])
        left, edges = np.ones(len(rep), bool), []
        for root in range(len(rep)):
            todo = [root] if left[root] else []
            left[root] = False
            while todo:
                i = todo.pop()
                new = np.flatnonzero(near[i] & left)
                left[new] = False
                edges += [(rep[i], rep[j]) for j in new]
                todo += new.tolist()
        return pd.DataFrame(edges, columns=["a", "b"])

    return _in_blocks(members, "node").select("node", "x", "y", "rep", "set").groupBy("node", "x", "y").applyInPandas(link, "a binary, b binary")


def _links_inside(members: DataFrame) -> DataFrame:
    """(rep, links, copies): of each member of a cluster, the other members that are similar enough and
    the documents in their classes. ``members``: (rep, cluster, n_docs, set)."""

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        near = _similar([np.frombuffer(x, np.uint64) for x in pdf["set"]])
        if key[1] != key[2]:  # pairs of one block are counted where the block is alone
            block = pdf["block"].to_numpy()
            near &= block[:, None] != block[None, :]
        return pd.DataFrame({"rep": pdf["rep"], "links": near.sum(1), "copies": near @ pdf["n_docs"].to_numpy()})

    dealt = _in_blocks(members, "cluster").select("cluster", "x", "y", "block", "rep", "n_docs", "set")
    each = dealt.groupBy("cluster", "x", "y").applyInPandas(count, "rep binary, links long, copies long")
    return each.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, set) of the wanted representatives: ``wanted`` has (rep, rep_id, rep_hash)."""

    def run(batches):
        for own in _slices(batches, 1):
            sets = shingle_sets(own.column(1).to_pylist())
            ok = pa.array([digest(s) == d for s, d in zip(sets, own.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([own.column(0).filter(ok), pa.array([s.tobytes() for s in sets], pa.binary()).filter(ok)], ["rep", "set"])

    # always a shuffle of both: the wanted are a share of all documents, and their number no bound. The hash of
    # the text is part of the key, so that NULL or repeated ids don't meet
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    same = (F.col("own_hash") == F.col("rep_hash")) & F.col("own_id").eqNullSafe(F.col("rep_id"))
    once = texts.join(wanted.hint("merge"), same).select("rep", "text").dropDuplicates(["rep"])
    return once.mapInArrow(lean(run), "rep binary, set binary")


def _starred(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each text and the leader of its node, where that is of another cluster. The leader is
    the text with the smallest hash, another in every node. ``members``: (node, rep, cluster)."""
    least = F.min(F.struct(F.xxhash64("rep", "node").alias("h"), "rep", "cluster"))
    leader = members.groupBy("node").agg(least.alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", F.col("least.rep").alias("leader"), F.col("least.cluster").alias("own"))
    other = members.join(leader, "node").filter("cluster <> own")
    return other.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _apart(paths: DataFrame, length: int, labels: DataFrame) -> DataFrame:
    """(node, rep, cluster, n): what shares a node after ``length`` labels, and no cluster."""
    placed = paths.join(labels, "rep", "left").select(_node(length).alias("node"), "rep", F.coalesce("cluster", "rep").alias("cluster"))
    mixed = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("low"), F.max("cluster").alias("high")).filter("low <> high").select("node", "n")
    return placed.join(mixed, "node")


def _measured(rows: DataFrame, labels: DataFrame) -> float:
    """The share of the sample's similar pairs that are in one cluster; 1 if there are none."""
    pairs = rows.select(F.col("digest").alias("a"), F.explode("probes").alias("b")).distinct()
    found = pairs.join(labels.toDF("a", "cluster_a"), "a", "left").join(labels.toDF("b", "cluster_b"), "b", "left")
    return found.agg(F.avg(F.coalesce(F.col("cluster_a") == F.col("cluster_b"), F.lit(False)).cast("double"))).first()[0] or 1.0


def _clusters(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, digest), classes and, by class, clusters with numbers of links."""
    rows = saved(signed(docs, _probes(docs)), "near-signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    # ids may be NULL or repeat: a class is known by its digest, and its text by one row's id and hash
    classes = rows.filter("digest is not null").groupBy("digest").agg(first.alias("row"), F.count(F.lit(1)).alias("n_docs"), F.first("sig").alias("sig"))
    reps = saved(classes.select(F.col("digest").alias("rep"), F.col("row.doc_id").alias("rep_id"), F.col("row.text_hash").alias("rep_hash"), "n_docs", "sig"), "near-classes")
    known = reps.select("rep", "rep_id", "rep_hash")
    last = length_for(recall=recall)

    # only texts that share a node at the shortest prefix go on
    every = _paths(reps)
    shared = every.groupBy(_node(last).alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    paths = saved(every.withColumn("node", _node(last)).join(shared, "node").select("rep", "path"), "near-paths")

    if paths.isEmpty() and rows.filter("probes is not null").isEmpty():
        return rows.select("doc_id", "text_hash", "digest"), reps, docs.sparkSession.createDataFrame([], "rep binary, cluster binary, cluster_id long, links long, copies long")

    # at full depth: one pair a text and node
    tried = saved(_starred(paths.select(_node(DEPTH).alias("node"), "rep", F.col("rep").alias("cluster"))), "near-pairs")
    # one pass over the texts for all sets that may be asked for
    sets = _with_sets(docs, known, None, paths.select("rep"))
    labels = components(_verified(tried, sets), "near")

    for length in range(DEPTH - 1, 0, -1):
        if length < last and _measured(rows, labels) >= recall:
            break
        apart = saved(_apart(paths if length >= last else every, length, labels), "near-apart")
        if apart.isEmpty():
            continue
        if length > last:
            pairs, many = _starred(apart.select("node", "rep", "cluster")), apart.limit(0)
        else:
            few, many = apart.filter(F.col("n") <= SMALL).select("node", "rep", "cluster"), apart.filter(F.col("n") > SMALL).select("node", "rep")
            pairs = few.toDF("node", "a", "cluster_a").join(few.toDF("node", "b", "cluster_b"), "node").filter("cluster_a < cluster_b")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = pairs.join(tried, ["a", "b"], "left_anti")
        # texts that share a long prefix are mostly similar: only shorter ones are worth a look at the signatures first
        more = saved(new if length > last else _likely(new, reps), "near-pairs")
        if length < last:
            sets = _with_sets(docs, known, sets, more.select(F.col("a").alias("rep")).union(more.select("b")).union(many.select("rep")))
        new = _verified(more, sets)
        new = saved(new if length > last else new.union(_forest(many.join(sets, "rep"))), "near-links")
        tried = tried.union(more)
        if not new.isEmpty():
            labels = merged(labels, new, "near")

    labels = saved(labels.join(reps.select("rep", "rep_id", "n_docs"), "rep"), "near-labels")
    members = labels.join(sets, "rep").select("rep", "cluster", "n_docs", "set")
    named = labels.groupBy("cluster").agg(F.min("rep_id").alias("cluster_id"))
    found = labels.join(named, "cluster").join(_links_inside(members), "rep", "left").select("rep", "cluster", "cluster_id", "links", "copies")
    return rows.select("doc_id", "text_hash", "digest"), reps, found


def _with_sets(docs: DataFrame, known: DataFrame, sets: DataFrame | None, asked: DataFrame) -> DataFrame:
    """The sets, with those that are asked for (rep) and missing."""
    asked = asked.distinct() if sets is None else asked.distinct().join(sets.select("rep"), "rep", "left_anti")
    wanted = saved(known.join(asked, "rep", "left_semi"), "near-wanted")
    found = saved(_sets(docs, wanted), "near-sets")
    return found if sets is None else sets.union(found)


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash, digest, cluster (the digest that names it; NULL without a word), class_id, cluster_id, n_class
    (documents of the class), n_class_links (other classes that are similar), n_links (other documents that are
    equal or similar); one row per document."""
    rows, reps, found = _clusters(docs, recall)
    by_class = reps.join(found, "rep", "left").select(
        F.col("rep").alias("digest"),
        "rep_id",
        "n_docs",
        F.coalesce("cluster", "rep").alias("cluster"),
        F.when(F.col("cluster").isNull(), F.col("rep_id")).otherwise(F.col("cluster_id")).alias("cluster_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )
    joined = rows.join(by_class, "digest", "left")
    return joined.select(
        "doc_id",
        "text_hash",
        "digest",
        "cluster",
        F.coalesce("rep_id", "doc_id").alias("class_id"),
        F.coalesce("cluster_id", "doc_id").alias("cluster_id"),
        F.coalesce("n_docs", F.lit(1)).cast("long").alias("n_class"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_class_links"),
        F.coalesce(F.col("n_docs") - 1 + F.col("copies"), F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents without near-duplicates: of each cluster the row with the smallest id stays (NULL is the largest;
    of rows with that id, the one with the smallest hash of its text, and of equal rows any one); documents
    without a word all stay."""
    found = saved(near_duplicates(docs, recall).filter("digest is not null and n_links > 0").select("doc_id", "text_hash", "cluster"), "near-found")
    stays = found.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("n"))
    told = found.join(stays.select("cluster", "one"), "cluster").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash")))
    # rows with one id and text share a class, so they stay or go together
    told = told.groupBy("doc_id", "text_hash").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    own, own_hash = free_name(docs, "near_id"), free_name(docs, "near_hash")
    row = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(own_hash))
    told = saved(told, "near-told")
    gone, again = (told.filter(x).select("doc_id", "text_hash").toDF(own, own_hash) for x in ("not kept", "kept and n > 1"))
    left = docs.join(gone, row, "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, row, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, row, "left_anti").unionByName(once)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("digest", "text_hash", "cluster")
