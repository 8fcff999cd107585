"""Items that appear together (problem 6).

Method: exact pair counts, held against a fitted bipartite configuration model in which each item
keeps its frequency and each basket its size. Under the model the count of a pair is a sum of
independent draws with different chances; its Poisson-binomial tail gives a p-value and the
Benjamini-Hochberg rule over all pairs of the vocabulary a q-value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Baskets of at most this many items are expanded in place; larger ones in cells of two blocks of
#: about half as many items, so no row ever holds more pairs than the square of this.
BLOCK = 256
#: Cells of a matrix that are held at once.
CELLS = 1 << 21
#: p-values are ranked in bins of this width in log10, which bounds the ranking by the exponent range.
BIN = 0.01
#: Below this log10 p-values share one bin.
FLOOR = -320.0


def pair_counts(baskets: DataFrame, basket: str, item: str, min_count: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab): baskets that hold both items, item_a < item_b by code points.

    Rows with a null basket or item are ignored and an item counts once per basket. Baskets with
    equal contents are expanded once, with their number as weight. Exact for baskets of any size.
    """
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    # Items below min_count in all cannot reach it in a pair.
    if min_count > 1:
        frequent = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("item")
        rows = rows.join(frequent, "item", "left_semi")
    sizes = rows.groupBy("basket").agg(F.count("*").alias("size"))
    big = sizes.where(F.col("size") > BLOCK)
    sets = rows.join(big, "basket", "left_anti").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items")).groupBy("items").agg(F.count("*").alias("w"))
    small = sets.select("items", "w", F.posexplode("items").alias("p", "item_a")).select("w", "item_a", F.explode(F.expr("slice(items, p + 2, greatest(size(items) - p - 1, 0))")).alias("item_b"))
    blocks = F.ceil(F.col("size") * 2 / BLOCK).cast("int")
    cells = (
        rows.join(big, "basket")
        .withColumn("k", blocks)
        .withColumn("b", F.pmod(F.xxhash64("item"), F.col("k")).cast("int"))
        .select("basket", "item", "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
        .select("basket", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), F.struct("item", "b").alias("x"))
        .groupBy("basket", "lo", "hi")
        .agg(F.collect_list("x").alias("xs"))
        .select("lo", "hi", "xs", F.explode("xs").alias("a"))
        .select("a", F.explode(F.filter("xs", lambda y: (y["item"] > F.col("a.item")) & ((F.col("lo") == F.col("hi")) | (y["b"] != F.col("a.b"))))).alias("y"))
        .select(F.lit(1).cast("long").alias("w"), F.col("a.item").alias("item_a"), F.col("y.item").alias("item_b"))
    )
    return small.unionByName(cells).groupBy("item_a", "item_b").agg(F.sum("w").alias("n_ab")).where(F.col("n_ab") >= min_count)


def _chunks(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows so that a matrix of one and `width` columns has at most CELLS cells, or one row."""
    step = max(1, CELLS // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def fit_configuration(freq: np.ndarray, freq_many: np.ndarray, size: np.ndarray, size_many: np.ndarray, rounds: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the maximum-entropy model given both margins, see chances.

    Only the two vectors are kept; the matrix of chances is gone through a part at a time.
    """
    total = float((size * size_many).sum())
    if not len(freq) or not len(size) or not total:
        return np.zeros(len(freq)), np.zeros(len(size))
    x, y = freq / math.sqrt(total), size / math.sqrt(total)
    for _ in range(rounds):
        was, x, below = x, x.copy(), np.zeros(len(y))
        for s in _chunks(len(x), len(y)):
            x[s] = np.minimum(freq[s] / np.maximum((size_many * y / (1 + np.outer(x[s], y))).sum(1), 1e-300), 1e12)
            below += ((freq_many[s] * x[s])[:, None] / (1 + np.outer(x[s], y))).sum(0)
        y = np.minimum(size / np.maximum(below, 1e-300), 1e12)
        if np.abs(x / was - 1).max() < tol:
            break
    return x, y


def chances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """p[i, k]: the chance that an item of x[i] is in a basket of y[k]."""
    xy = np.outer(x, y)
    return xy / (1 + xy)


def _log_mills(w: np.ndarray) -> np.ndarray:
    """Mills ratio of the normal distribution."""
    near = np.array([0.5 * math.erfc(v / math.sqrt(2)) * math.exp(v * v / 2) * math.sqrt(2 * math.pi) if v < 25 else 0.0 for v in w])
    far = 1 / np.maximum(w, 1) - 1 / np.maximum(w, 1) ** 3 + 3 / np.maximum(w, 1) ** 5 - 15 / np.maximum(w, 1) ** 7
    return np.where(w < 25, near, far)


def log10_tail(n: np.ndarray, p: np.ndarray, many: np.ndarray) -> np.ndarray:
    """log10 P(X >= n[i]) for X the sum over k of many[k] draws of chance p[i, k], by the lattice saddlepoint.

    n of 0 gives 0 and n beyond the number of draws minus infinity.
    """
    n = n.astype(float)
    top = many.sum()
    out = np.zeros(len(n))
    mean = (p * many).sum(1)
    p = np.clip(p, 1e-300, 1 - 1e-15)
    out[n > top] = -np.inf
    all_ = n == top
    out[all_] = (many * np.log10(p[all_])).sum(1)
    todo = (n > 0) & (n < top)
    if not todo.any():
        return out
    m, q = n[todo], p[todo]
    lo, hi = np.full(len(m), -60.0), np.full(len(m), 60.0 + 0.0)
    hi = np.maximum(hi, np.log(m / np.maximum(mean[todo], 1e-300)) + 40)
    for _ in range(80):
        s = (lo + hi) / 2
        t = q * np.exp(np.minimum(s, 700))[:, None]
        up = (many * t / (1 - q + t)).sum(1) < m
        lo, hi = np.where(up, s, lo), np.where(up, hi, s)
    s = (lo + hi) / 2
    t = q * np.exp(np.minimum(s, 700))[:, None]
    z = 1 - q + t
    k0 = (many * np.log(z)).sum(1)
    k2 = np.maximum((many * t * (1 - q) / z**2).sum(1), 1e-300)
    w = np.sign(s) * np.sqrt(np.maximum(2 * (s * m - k0), 0))
    u = -np.expm1(-s) * np.sqrt(k2)
    # Around the mean the expansion has no value of its own; the normal tail with half a step stands in.
    flat = np.abs(w) < 1e-3
    w_, u_ = np.where(flat, 1.0, w), np.where(flat, 1.0, u)
    upper = w_ > 0
    tail = np.where(upper, _log_mills(np.abs(w_)), 0) - np.where(upper, 1 / w_ - 1 / u_, 0)
    log_p = -w_**2 / 2 - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(tail, 1e-300))
    phi = np.exp(-w_**2 / 2) / math.sqrt(2 * math.pi)
    below = 1 - np.array([0.5 * math.erfc(abs(v) / math.sqrt(2)) for v in w_]) - phi * (1 / w_ - 1 / u_)
    res = np.where(upper, log_p, np.log(np.clip(below, 1e-300, 1)))
    sd = np.sqrt(k2)
    normal = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in (m - 0.5 - mean[todo]) / sd])
    out[todo] = np.where(flat, np.log(np.clip(normal, 1e-300, 1)), np.minimum(res, 0)) / math.log(10)
    return out


def surprising_pairs(baskets: DataFrame, basket: str, item: str, min_count: int = 4) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, expected, lift, log10_p, q_value) of every pair in at least min_count baskets.

    n is the number of baskets with an item; lift is n_ab n / (n_a n_b); expected and log10_p come
    from the fitted model; q_value is the false-discovery rate at which the pair would be accepted,
    ranked among all pairs that occur and counted over all pairs of the vocabulary. What reaches the
    driver are two histograms (items by frequency, baskets by size), whose lengths are at most the
    square root of twice the input, and the bins of the p-values; the tasks get the two vectors of
    the model. An empty table gives no rows.
    """
    spark = baskets.sparkSession
    # Read five times below; what produced the baskets should run once.
    rows = cut(baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct())
    counts = rows.groupBy("item").agg(F.count("*").alias("n"))
    by_size = rows.groupBy("basket").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("many")).orderBy("size").collect()
    by_freq = counts.groupBy("n").agg(F.count("*").alias("many")).orderBy("n").collect()
    size, size_many = np.array([r.size for r in by_size], float), np.array([r.many for r in by_size], float)
    freq, freq_many = np.array([r.n for r in by_freq], float), np.array([r.many for r in by_freq], float)
    n = int(size_many.sum())
    x, y = fit_configuration(freq, freq_many, size, size_many)
    vocabulary = float(freq_many.sum())
    shared = spark.sparkContext.broadcast((freq, x, y, size_many))

    pairs = cut(
        pair_counts(rows, "basket", "item")
        .join(counts.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(counts.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .select("item_a", "item_b", "n_ab", "n_a", "n_b")
    )

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq, x, y, many = shared.value
        for d in batches:
            # Pairs of the same three counts have the same tail.
            kinds, of = np.unique(d[["n_ab", "n_a", "n_b"]].to_numpy(), axis=0, return_inverse=True)
            mean, tail = np.zeros(len(kinds)), np.zeros(len(kinds))
            for s in _chunks(len(kinds), len(y)):
                p = chances(x[np.searchsorted(freq, kinds[s, 1])], y) * chances(x[np.searchsorted(freq, kinds[s, 2])], y)
                mean[s], tail[s] = (p * many).sum(1), log10_tail(kinds[s, 0], p, many)
            of = of.reshape(-1)
            yield d.assign(expected=mean[of], log10_p=np.maximum(tail, FLOOR)[of])

    kind = dict(rows.dtypes)["item"]
    in_bin = F.floor(F.col("log10_p") / BIN).cast("int")
    scored = cut(pairs.where(F.col("n_ab") >= min_count).mapInPandas(tails, f"item_a {kind}, item_b {kind}, n_ab long, n_a long, n_b long, expected double, log10_p double").withColumn("bin", in_bin))
    rare = pairs.where(F.col("n_ab") < min_count).groupBy("n_ab", "n_a", "n_b").agg(F.count("*").alias("many")).mapInPandas(tails, "n_ab long, n_a long, n_b long, many long, expected double, log10_p double")
    every = scored.select("bin", F.lit(1).cast("long").alias("many")).unionByName(rare.select(in_bin.alias("bin"), "many"))
    bins = every.groupBy("bin").agg(F.sum("many").alias("many")).orderBy("bin").collect()
    tests, seen, q = vocabulary * (vocabulary - 1) / 2, 0, []
    for r in bins:
        seen += r.many
        # The upper edge of a bin stands for its p-values, so a q-value is never too small.
        q.append((r.bin, min(1.0, 10 ** ((r.bin + 1) * BIN) * tests / seen)))
    for i in range(len(q) - 2, -1, -1):
        q[i] = (q[i][0], min(q[i][1], q[i + 1][1]))
    ranks = F.broadcast(spark.createDataFrame(q, "bin int, q_value double"))
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    return scored.join(ranks, "bin").select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"), "expected", lift.alias("lift"), "log10_p", "q_value")
