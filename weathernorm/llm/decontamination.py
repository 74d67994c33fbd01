"""Operator 6: benchmark decontamination, in SQL functions only.

The benchmark's windows (10 consecutive words; an item of fewer words is one window) become a hash
table that every task gets as one value: an array of buckets, looked up by the hash of four words of a
window and verified on the whole window. Each document is scanned in its own row: no window is
exploded, and nothing is shuffled. The table's size is checked: beyond ``max_windows`` windows, or where items share windows too often, the
hashes of the documents' windows are joined to the benchmark's by a shuffle instead.

Edge cases: a NULL or empty text has no words and is clean; NULL item ids and texts match nothing; ids
may be NULL or repeat (each row stands for itself); other columns are kept or ignored; with an empty
benchmark every document is clean, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, free_name, table

WINDOW = 10
#: More windows than these are not sent to the tasks (about 200 bytes each) but joined.
MAX_WINDOWS = 500_000
#: Nor are more ids of items than these by window, on average.
ITEMS_A_WINDOW = 4
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text whose capitals are not lower-cased yet.
_BREAKS_CAPITALS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Maximal runs of digits, letters a-z (A-Z lower-cased) and characters past ASCII."""
    # lower() changes nothing but A-Z where all characters are ASCII, and is much faster
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(low, _BREAKS, -1), ""), F.array().cast("array<string>"))


def window_hash(w: Column, i: Column, n: int) -> Column:
    """Of four words of the window of ``n`` words at ``i``; equal windows have equal hashes."""
    at = sorted({0, n // 3, 2 * n // 3, n - 1})
    return F.xxhash64(F.lit(n), *(F.get(w, i + k) for k in at))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(n, window, h, items): the distinct windows and the sorted ids, as text, of their items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("item is not null and size(w) > 0")
    found = items.select("item", "w", F.least(F.size("w"), F.lit(size)).alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("i"))
    h = F.lit(None).cast("long")
    for n in range(1, size + 1):
        h = F.when(F.col("n") == n, window_hash(F.col("w"), F.col("i"), n)).otherwise(h)
    cut = F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ")
    return found.select("item", "n", cut.alias("window"), h.alias("h")).groupBy("n", "window", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hash_table(found: DataFrame, count: int) -> tuple[Column, int]:
    """The windows as one value: an array whose place is the bucket's number."""
    buckets = 1 << max(4, math.ceil(math.log2(4 * count + 1)))
    each = found.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("b")).agg(F.collect_list(F.struct("h", "n", "window", "items")).alias("entries"))
    empty = F.array().cast("array<struct<h:bigint,n:int,window:string,items:array<string>>>")
    every = found.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(each, "b", "left").select("b", F.coalesce("entries", empty).alias("entries"))
    gathered = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("b", "entries"))).alias("m"))
    spread = gathered.select(F.transform("m", lambda x: x["entries"]).alias("t"))
    return spread.scalar(), buckets


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS, name: str = "contamination") -> DataFrame:
    """``docs`` and a column of what was found: n_words, hits (position, length, items of each window)."""
    found = windows(benchmark, size)
    sizes = found.groupBy("n").agg(F.count(F.lit(1)).alias("count"), F.sum(F.size("items")).alias("items")).collect()  # at most ``size`` rows
    counts = {r["n"]: r["count"] for r in sizes}
    if max(sum(counts.values()), sum(r["items"] for r in sizes) // ITEMS_A_WINDOW) > max_windows:
        return _scan_joined(docs, found, sorted(counts), name)
    if not counts:
        return docs.withColumn(name, F.struct(F.size(words(F.col("text"))).alias("n_words"), F.array().cast("array<struct<i:int,n:int,items:array<string>>>").alias("hits")))
    windows_table, buckets = hash_table(found, sum(counts.values()))

    def hits(w: Column, table: Column, n: int) -> Column:
        def entries(i: Column) -> Column:
            return bound(window_hash(w, i, n), lambda h: F.filter(F.get(table, F.pmod(h, F.lit(buckets)).cast("int")), lambda e: (e["h"] == h) & (e["n"] == n) & (e["window"] == F.array_join(F.slice(w, i + 1, n), " "))))

        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        at = F.transform(starts, lambda i: F.struct(i.alias("i"), entries(i).alias("e")))
        return F.transform(F.filter(at, lambda x: F.size(x["e"]) > 0), lambda x: F.struct(x["i"].alias("i"), F.lit(n).alias("n"), x["e"][0]["items"].alias("items")))

    # the optimiser merges both projections: the table stays one value by reference, never a row's own
    passing = free_name(docs, "contamination_table")
    given = F.struct(words(F.col("text")).alias("w"), F.col(passing).alias("t"))
    found_in = bound(given, lambda x: F.struct(F.size(x["w"]).alias("n_words"), F.concat(*(hits(x["w"], x["t"], n) for n in sorted(counts))).alias("hits")))
    return docs.withColumn(passing, windows_table).withColumn(name, found_in).drop(passing)


def _scan_joined(docs: DataFrame, found: DataFrame, lengths: list[int], name: str) -> DataFrame:
    """The same by a shuffle: hashes of the documents' windows meet those of the benchmark, and what meets is verified
    on the whole window where the document lies. Rows are told apart by id and text, so equal rows get equal hits."""
    row, own = free_name(docs, "contamination_row"), free_name(docs, "contamination_hits")
    told = docs.withColumn(row, F.sha2(F.to_json(F.struct("doc_id", "text")), 256))
    w = F.col("w")
    each = told.select(F.col(row).alias("row"), words(F.col("text")).alias("w"))
    none = F.array().cast("array<int>")

    def hashed(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(none)
        return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), window_hash(w, i, n).alias("h")))

    met = each.select("row", F.inline(F.concat(*map(hashed, lengths)))).join(found, ["n", "h"])
    per = met.groupBy("row").agg(F.collect_set(F.struct("i", "n", "window", "items")).alias("met")).toDF(row, own)

    def verified(met: Column, w: Column) -> Column:
        true = F.filter(met, lambda x: x["window"] == F.array_join(F.slice(w, x["i"] + 1, x["n"]), " "))
        return F.transform(true, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["items"].alias("items")))

    no_hits = F.array().cast("array<struct<i:int,n:int,items:array<string>>>")
    joined = told.join(per, row, "left")
    given = F.struct(words(F.col("text")).alias("w"), F.col(own).alias("m"))
    found_in = bound(given, lambda x: F.struct(F.size(x["w"]).alias("n_words"), F.coalesce(verified(x["m"], x["w"]), no_hits).alias("hits")))
    return joined.withColumn(name, found_in).select(*docs.columns, name)


def hit_positions(hits: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    scanned = scan(docs.select("doc_id", "text"), benchmark, **options)
    digest = bound(
        F.col("contamination"),
        lambda c: F.struct(
            c["n_words"].cast("long").alias("n_words"),
            F.size(hit_positions(c["hits"])).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(c["hits"], lambda x: x["items"])))).alias("items"),
        ),
    )
    d = scanned.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("d"))
    return d.select("doc_id", "d.n_words", "d.n_hit", F.size("d.items").cast("long").alias("n_items"), F.sha2(F.array_join("d.items", ","), 256).alias("items_sha256"), (F.col("d.n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """The documents without those hit (``remove="documents"``), or with the words hit cut out of them
    (``"spans"``: each word hit goes with the break after it; all else stays as it was)."""
    name = free_name(docs, "contamination")
    scanned = scan(docs, benchmark, name=name, **options)
    hits = F.col(name)["hits"]
    if remove == "documents":
        return scanned.filter(F.size(hits) == 0).drop(name)
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    # the text is its parts between breaks, and the breaks: hit parts go, each with the break after it
    parts, breaks = F.split("text", _BREAKS_CAPITALS, -1), F.regexp_extract_all("text", F.lit(_BREAKS_CAPITALS), F.lit(0))
    given = F.struct(parts.alias("p"), breaks.alias("b"), hit_positions(hits).alias("hit"))

    def cut(x: Column) -> Column:
        first = F.when(x["p"][0] == "", 1).otherwise(0)  # a text that starts with a break has an empty part first
        kept = F.transform(x["p"], lambda part, i: F.when(F.array_contains(x["hit"], (i - first).cast("int")), "").otherwise(F.concat(part, F.coalesce(F.get(x["b"], i), F.lit("")))))
        return F.array_join(kept, "")

    return scanned.withColumn("text", F.when(F.size(hits) > 0, bound(given, cut)).otherwise(F.col("text"))).drop(name)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM bi),
lens AS (SELECT DISTINCT n FROM win),
di AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT di.r, di.i, di.n, win.item_id FROM di JOIN win ON di.n = win.n AND array_to_string(di.w[di.i : di.i + di.n - 1], ' ') = win.x),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
