"""Whitening of embeddings: covariance by upper-triangle column aggregates, eigenvectors by LAPACK.

The covariance comes from generated Spark SQL: one aggregation with a sum of centred products for every pair of
dimensions i <= j.  Components are integers; they are centred at the rounded mean before they are multiplied, which
leaves small numbers, and what the rounding leaves is taken off exactly afterwards.  Sums of such integers are exact in
doubles up to 2**53, and then do not depend on how rows are spread.  Aggregation is partial in each task; one row of sums reaches the driver, whose size is
the square of the dimension and does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Sums of one aggregation; more pairs of dimensions take further passes.
MOST_PAIRS = 20_000
#: Share of the largest eigenvalue up to which a component counts as without variance.
RANK = 1e-10
_EXACT, _HOLD, _LONG = 2**53, 2**62, 2**63 - 1


def product_sums(df: DataFrame, columns: Sequence[str], centres: Sequence[int | float]) -> list[list[float]]:
    """Sums over all rows of (x_i - c_i) * (x_j - c_j), i <= j, as rows of the upper triangle.  The columns hold no
    nulls; saying so keeps the code that Spark makes of the sums short."""
    centred = df.selectExpr(*(f"coalesce(CAST(`{c}` - {m!r} AS DOUBLE), 0D) AS y{i}" for i, (c, m) in enumerate(zip(columns, centres, strict=True))))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    out = [[None] * len(columns) for _ in columns]
    for k in range(0, len(pairs), MOST_PAIRS):
        part = pairs[k : k + MOST_PAIRS]
        sums = centred.selectExpr(f"array({', '.join(f'sum(y{i} * y{j})' for i, j in part)}) AS sums").first()[0]
        for (i, j), v in zip(part, sums, strict=True):
            out[i][j] = v
    return out


def integers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is not null and holds no null or non-finite entry."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    hold = lambda x: F.greatest(F.least(x, F.lit(float(_HOLD))), F.lit(-float(_HOLD)))
    shifted = F.transform(vector, lambda x: hold(F.floor(x.cast("double") * SCALE).cast("double")).cast("long") + SHIFT)
    return df.where(F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), shifted.alias("x"))


class Whitening:
    """What is learnt: ``n``, the sums and, as columns by falling eigenvalue, the unit eigenvectors.  ``whole`` says that
    the sums of products are exact integers; else they are sums of doubles, as are the products."""

    def __init__(self, n: int, sums: Sequence[int], centres: Sequence[int], products: Sequence[Sequence[float]], whole: bool):
        d = len(sums)
        self.n, self.sums, self.centres = n, list(sums), list(centres)
        self.rest = [Fraction(s - n * c, n) for s, c in zip(sums, centres, strict=True)]  # mean less centre
        v = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p = products[i][j]
                v[i, j] = v[j, i] = float(Fraction(int(p), n) - self.rest[i] * self.rest[j]) if whole else p / n - float(self.rest[i]) * float(self.rest[j])
        self.covariance = v
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")
        self.values, self.vectors = np.maximum(values[order], 0.0), vectors[:, order]
        # one sign for all rows: the largest entry is positive
        top = np.abs(self.vectors).argmax(0)
        self.vectors = self.vectors * np.where(self.vectors[top, np.arange(d)] < 0, -1.0, 1.0)
        self.trace = float(np.trace(v))
        self.varied = self.values > RANK * (self.values[0] if d else 0)


def fit(columns: DataFrame, names: Sequence[str]) -> Whitening:
    """Fit on all rows of a table with one long column per dimension."""
    asked = [f"{f}({'CAST' if f == 'sum' else ''}{f'(`{c}` AS DECIMAL(38,0))' if f == 'sum' else f'`{c}`'})" for c in names for f in ("sum", "min", "max")]
    got = columns.selectExpr("count(*)", *asked).first()
    n = got[0]
    sums, low, high = ([int(v) for v in got[k::3]] for k in (1, 2, 3))
    centres = [(2 * s + n) // (2 * n) for s in sums]
    reach = max(max(h - c, c - a) for a, h, c in zip(low, high, centres, strict=True))
    return Whitening(n, sums, centres, product_sums(columns, names, centres), n * reach * reach < _EXACT)


def whitened_columns(columns: DataFrame, names: Sequence[str], model: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, w0, w1, ...) of every row; a component without variance is null."""
    k, d = min(components, len(names)), len(names)
    spark = columns.sparkSession
    scale = np.where(model.varied[:k], 1 / np.sqrt(np.where(model.varied[:k], model.values[:k], 1.0)), 0.0)
    sent = spark.sparkContext.broadcast((model.vectors[:, :k] * scale, model.varied[:k], np.array(model.centres, np.int64), np.array([float(r) for r in model.rest]), np.array([s - model.n * c for s, c in zip(model.sums, model.centres, strict=True)], object), model.n))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, varied, centres, rest, left, n = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            y = np.column_stack([b.column(1 + i).to_numpy() for i in range(d)]) - centres
            w = (y - rest) @ matrix
            # sum of (n * x - S)^2, exactly: n * x - S is n * y less what the centres leave of S
            reach = n * int(np.abs(y).max()) + max(abs(int(v)) for v in left)
            if reach < 2**31 and d * reach * reach < 2**63:
                gap = n * y - left.astype(np.int64)
                deviation = (gap * gap).sum(1)
            else:
                gap = y.astype(object) * n - left
                deviation = np.array([min(int(v), _LONG) for v in (gap * gap).sum(1)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation), *(pa.array(np.ascontiguousarray(w[:, j])) if varied[j] else pa.nulls(len(w), pa.float64()) for j in range(k))], names=["vec_id", "deviation", *(f"w{j}" for j in range(k))])

    return columns.select("vec_id", *names).mapInArrow(run, ", ".join(["vec_id long", "deviation long", *(f"w{j} double" for j in range(k))]))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): the first ``components`` principal
    components, whitened, of every row whose vector is not null and holds no null or non-finite entry.

    An entry c becomes floor(64 * c) + 1000000 (the former held to 62 bits).  The fit list is all such vectors of the
    commonest length (the longer of two that are as common); each vector of another length comes back once, with nulls
    from ``component`` on.  A component whose eigenvalue is at most RANK of the largest has no variance to whiten: its
    ``whitened`` is null and it does not count in ``identity_error``, which is null if there is no other; ``explained`` is null
    where nothing varies.  Repeated rows count each; a null id comes back null.  A deviation beyond a long is held to
    its end.  Vectors of no entry have no component; an empty table gives none.
    """
    spark = df.sparkSession
    bound_batches(spark)
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    held = integers(df, key, vector)
    sizes = held.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(2).collect()
    if not sizes or (sizes[0]["size"] == 0 and len(sizes) == 1):
        return spark.createDataFrame([], result)
    d = sizes[0]["size"]
    others = held.where(F.size("x") != d).selectExpr("vec_id", *(f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in result.split(", ")[1:]))
    if d == 0:
        return others
    names = [f"x{i}" for i in range(d)]
    columns = stage(held.where(F.size("x") == d).select("vec_id", *(F.col("x")[i].alias(c) for i, c in enumerate(names))), "columns")
    model = fit(columns, names)
    k = min(components, d)
    rows = stage(whitened_columns(columns, names, model, k), "whitened")
    varied = [j for j in range(k) if model.varied[j]]
    error = None
    if varied:
        means = rows.selectExpr(*(f"avg(w{j}) AS w{j}" for j in varied)).first()
        sums = product_sums(rows, [f"w{j}" for j in varied], list(means))
        error = max(abs(sums[i][j] / model.n - (i == j)) for i in range(len(varied)) for j in range(i, len(varied)))
    share = [float(model.values[j] / model.trace) if model.trace > 0 else None for j in range(k)]
    each = F.explode(F.array(*(F.struct(F.lit(j + 1).alias("component"), F.col(f"w{j}").alias("whitened"), F.lit(share[j]).cast("double").alias("explained")) for j in range(k)))).alias("c")
    out = rows.select("vec_id", "deviation", each).select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
    return out if len(sizes) == 1 else out.unionByName(others)
