"""Boosted trees for a set of rows that is too large for one task: the same trees, grown by sums in SQL.

The rows stay where they are. What a split needs is a table of counts and sums of residuals by (node, variable,
bin), which Spark adds up over all rows in one aggregate, NULLs in a bin of their own; its size is that of
the variables and bins, whatever the rows. The driver picks the split by the rule of ``boost.py``, and the
rows follow it by a column expression. So a tree takes as many aggregates as it has splits (the children of
the last one have their sums in their parent's table). Every ``KEEP`` trees the rows with their residuals are
written to the scratch folder, which bounds the expressions and the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, link
from ..sources.store import written
from .boost import BINS, Booster, best_splits, binned

KEEP = 10


def column_edges(df: DataFrame, columns: Sequence[str], exact: bool = False) -> list[np.ndarray]:
    """Borders of the bins of each column, in one pass: quantiles, to a ten-thousandth of the rows unless ``exact``."""
    q = np.linspace(0, 1, BINS)[1:-1].tolist()
    of = lambda c: F.percentile(c, q) if exact else F.percentile_approx(c, q, 10_000)
    found = df.agg(*(of(finite(F.col(c).cast("double"))).alias(f"q{j}") for j, c in enumerate(columns))).first()
    return [np.unique(np.array(found[j], float)) if found[j] is not None else np.zeros(0) for j in range(len(columns))]


def _with_bins(df: DataFrame, columns: Sequence[str], y: Column, edges: Sequence[np.ndarray]) -> DataFrame:
    """(bins, r): the bin of each column, and the response."""

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(columns))]) if columns else np.zeros((batch.num_rows, 0))
            b = binned(x, edges).astype(np.int8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * len(columns), pa.int32()), pa.array(b.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(len(columns))], ["bins", "r"])

    wanted = df.select(*(finite(F.col(c).cast("double")).alias(f"x{j}") for j, c in enumerate(columns)), y.alias("r")).filter(F.col("r").isNotNull())
    return wanted.mapInArrow(run, "bins array<tinyint>, r double")


def _sums(rows: DataFrame, node: Column, groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of residuals by (node, variable, bin); rows whose node is NULL are left out."""
    each = rows.select(node.alias("node"), "r", F.posexplode("bins").alias("variable", "bin")).filter(F.col("node").isNotNull())
    n, s = np.zeros((groups, width, BINS + 1)), np.zeros((groups, width, BINS + 1))
    for x in each.groupBy("node", "variable", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s")).collect():  # groups x variables x bins
        n[x["node"], x["variable"], x["bin"]], s[x["node"], x["variable"], x["bin"]] = x["n"], x["s"]
    return n, s


def _side(j: int, cut: int, first: int) -> Column:
    """The child that a row goes to."""
    v = F.get("bins", F.lit(j))
    return F.when(v == BINS, F.lit(first + 2)).when(v > cut, F.lit(first + 1)).otherwise(F.lit(first))


def fit_wide(df: DataFrame, columns: Sequence[str], trees: int = 100, rate: float = 0.1, splits: int = 2, least: int = 10, link_name: str = "linear", response: str = "value", exact: bool = False) -> Booster:
    """One model of all rows (with a ``set``, of those for training) whose response is finite; every tree sees every row.

    ``predict`` of the model, or :func:`predict_wide`, applies it; NULLs of the variables have branches of their own.
    """
    columns = list(columns)
    df = df.filter("set = 'training'") if "set" in df.columns else df
    y = finite(F.col(response).cast("double"))
    if link_name == "log":
        y = F.when(y > 0, link(y, "log"))
    edges = column_edges(df.filter(y.isNotNull()), columns, exact)
    rows = written(_with_bins(df, columns, y, edges), "boost-rows")
    start = rows.agg(F.avg("r")).first()[0]
    if start is None:
        raise ValueError("no training rows")
    out = Booster(columns, rate, splits, 1.0, least)
    out.start, out.edges = start, edges
    rows = rows.withColumn("r", F.col("r") - F.lit(start))
    grown = []
    for t in range(trees):
        tree, node = _grow(rows, len(columns), splits, least)
        grown.append(tree)
        values = F.array(*(F.lit(float(v)) for v in tree["value"]))
        rows = rows.withColumn("r", F.col("r") - F.lit(rate) * F.get(values, node))
        if (t + 1) % KEEP == 0 and t + 1 < trees:
            rows = written(rows, "boost-rows")
    for name in Booster.FIELDS:
        setattr(out, name, np.stack([tree[name] for tree in grown]))
    return out


def _grow(rows: DataFrame, width: int, splits: int, least: int) -> tuple[dict[str, np.ndarray], Column]:
    """A tree, and the column of the node that a row ends in."""
    nodes = 1 + 3 * splits
    tree = {"feature": np.full(nodes, -1), "cut": np.zeros(nodes, int), "child": np.full(nodes, -1), "value": np.zeros(nodes), "rows": np.zeros(nodes, int), "gain": np.zeros(nodes)}
    n, s = _sums(rows, F.lit(0), 1, width)
    if width:
        tree["rows"][0], tree["value"][0] = n[0, 0].sum(), s[0, 0].sum() / max(1, n[0, 0].sum())
    at, held = F.lit(0), {0: (n[0], s[0])}
    open_ = {0: tuple(x[0] for x in best_splits(n, s, least))}
    for k in range(splits):
        here = max(open_, key=lambda x: (open_[x][0], -x), default=None)
        if here is None or not open_[here][0] > 1e-12:
            break
        gain, j, cut = open_.pop(here)
        first, (n, s) = 1 + 3 * k, held.pop(here)
        tree["feature"][here], tree["cut"][here], tree["child"][here], tree["gain"][here] = j, cut, first, gain
        for c, part in enumerate((slice(0, cut + 1), slice(cut + 1, BINS), slice(BINS, BINS + 1))):
            count = n[j, part].sum()
            tree["rows"][first + c] = count
            tree["value"][first + c] = s[j, part].sum() / count if count else tree["value"][here]
        at = F.when(at == here, _side(int(j), int(cut), first)).otherwise(at)
        if k + 1 < splits:
            n, s = _sums(rows, F.when(at >= first, at - first), 3, width)
            found = best_splits(n, s, least)
            for c in range(3):
                held[first + c] = n[c], s[c]
                if tree["rows"][first + c] >= 2 * least:
                    open_[first + c] = tuple(x[c] for x in found)
    return tree, at


def predict_wide(df: DataFrame, model: Booster, link_name: str = "linear", name: str = "predicted") -> DataFrame:
    """``df`` with a prediction of every row, where it lies."""
    sent, schema = df.sparkSession.sparkContext.broadcast(model), df.drop(name).schema.add(name, "double")

    def run(batches):
        m = sent.value
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(f"_x{j}")).to_numpy(zero_copy_only=False).astype(float) for j in range(len(m.names))]) if m.names else np.zeros((batch.num_rows, 0))
            y = m.predict(x)
            y = np.exp(y) if link_name == "log" else y
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(schema) - 1], pa.array(y)], schema.names)

    fed = df.drop(name).withColumns({f"_x{j}": finite(F.col(c).cast("double")) for j, c in enumerate(model.names)})
    return fed.mapInArrow(run, schema)
