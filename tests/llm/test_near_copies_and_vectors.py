"""SuperMinHash near-duplicates, whitening and centroid clustering against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrain.llm import clustering, minhash_dedup, ngram_join, registry, whitening
from lodegrain.llm.common import table

CLASHING = ("token", "root", "node", "a", "b", "key", "hub", "bands", "n", "fp1", "_id", "v", "x", "id", "cluster", "component", "w0", "x0", "deviation")


def clashing(df):
    return df.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)))


# --- SuperMinHash ---------------------------------------------------------------------------------------


def test_signatures_estimate_similarity_with_less_variance():
    rng, size = np.random.default_rng(1), 200
    error, plain = [], []
    for _ in range(150):
        a, b, both = (rng.integers(0, 2**52, k, dtype=np.uint64) for k in (12, 12, 16))
        sets = [np.unique(np.concatenate([x, both])) for x in (a, b)]
        off = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        s = minhash_dedup.signatures(np.concatenate(sets), off, size)
        error.append((s[0] == s[1]).mean() - 0.4)
        plain.append(rng.binomial(size, 0.4) / size - 0.4)
    assert abs(np.mean(error)) < 0.012
    assert np.var(error) < 0.85 * np.var(plain)  # what independent hash functions have


def test_signatures_are_of_the_set_and_stop_early():
    rng, counted = np.random.default_rng(2), []
    t = np.unique(rng.integers(0, 2**52, 3000, dtype=np.uint64))
    off = np.array([0, 0, len(t), len(t) + 1, len(t) + 1])
    s = minhash_dedup.signatures(np.concatenate([t, t[:1]]), off, 200, counted)
    assert (s[[0, 3]] == 2**64 - 1).all()
    assert (np.sort(s[2] >> np.uint64(32)) == np.arange(200)).all()  # one token fills every place with another rank
    assert sum(counted) < 3 * len(t) + 200
    shuffled = rng.permutation(t)
    assert (minhash_dedup.signatures(shuffled, np.array([0, len(t)]), 200)[0] == s[1]).all()
    many = minhash_dedup.signatures(np.tile(t, 40), np.arange(41) * len(t), 200)  # over several blocks
    assert (many == s[1]).all()


def test_bands_miss_few_pairs_at_any_similarity():
    for percent in (50, 60, 80, 90, 100):
        bands, rows = minhash_dedup.banding(percent)
        assert bands * rows <= 255 and (1 - (percent / 100) ** rows) ** bands <= 1e-7
    with pytest.raises(ValueError):
        minhash_dedup.banding(5)


def shingles(text, size=4):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(texts, percent=80, size=4):
    sets = {}
    for i, t in texts:
        sets.setdefault(i, []).append(shingles(t, size))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


WORDS = [f"w{i}" for i in range(300)]


def families(rng, n, words=60):
    """Texts with copies, chains of edits and templates just above and below the threshold."""
    rows, i = [], 0
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(20, words))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 18)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((i, " ".join(w)))
            base, i = w if rng.random() < 0.5 else base, i + 1
    return rows


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(1)
    rows = families(rng, 45)
    rng.shuffle(rows)
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "ONE"), (9005, "one two three"), (9006, "x " * 60_000), (9007, "x x x x"), (None, rows[0][1]), (None, None)]
    rows += [(9100, rows[0][1]), (9100, rows[-30][1]), (9101, rows[1][1]), (9101, rows[1][1])]  # one id for two texts; a repeated row
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = minhash_dedup.near_duplicates(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = sorted((i is None, i or 0, len(shingles(t))) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]) for r in got) == sizes
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_links_that_no_first_document_sees(spark):
    """A large group of variants of one text, most of which resemble each other only in part."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_other_thresholds(spark):
    rows = families(random.Random(8), 25)
    for percent, size in ((60, 3),):
        got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()}
        assert got == brute(rows, percent, size)


# --- whitening ------------------------------------------------------------------------------------------


def whitened(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviation, values, y @ vectors / np.sqrt(np.maximum(values, 1e-300))


def test_whitening_is_numpy(spark):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 1 + j / 5) for j in range(40)]) for i in range(300)] + [(None, [0.5] * 40), (700, [0.25] * 40), (700, [0.25] * 40)]
    bad = [(500, None), (501, [float("nan")] * 40), (502, [None] + [1.0] * 39), (503, [float("-inf")] + [1.0] * 39)]
    df = clashing(spark.createDataFrame(good + bad + [(600, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    got = whitening.whiten(df).collect()
    n, deviation, values, plain = whitened(good)
    other = [r for r in got if r["component"] is None]
    assert [(r["vec_id"], r["whitened"], r["n"]) for r in other] == [(600, None, None)]
    assert len(got) == 32 * len(good) + 1
    for r in got:
        if r["component"] is not None:
            assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
    for c in (1, 2, 32):
        mine = sorted((r["deviation"], abs(r["whitened"])) for r in got if r["component"] == c)
        want = sorted(zip(deviation, np.abs(plain[:, c - 1])))
        assert [d for d, _ in mine] == [d for d, _ in want]
        assert np.allclose(sorted(w for _, w in mine), sorted(w for _, w in want), atol=1e-8)
        assert len({r["whitened"] > 0 for r in got if r["component"] == c and r["vec_id"] == 700}) == 1
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_without_variance_and_beyond_longs(spark):
    rows = [(i, [float(i % 5), 3.0, float(-(i % 5))]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert max(r["identity_error"] for r in got) < 1e-12 and {round(r["explained"], 9) for r in got if r["component"] == 1} == {1.0}
    one = whitening.whiten(spark.createDataFrame([(1, [2.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert max(r["deviation"] for r in far) == 2**63 - 1 and all(abs(abs(r["whitened"]) - math.sqrt(1.5)) < 1e-6 for r in far if r["component"] == 1 and r["vec_id"] != 3)
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).count() == 0


def test_whitening_query_is_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = registry.op12_whitening(spark, folder).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    n, deviation, values, plain = whitened(rows)
    assert len(got) == 32 * n and (got.n == n).all() and got.identity_error.max() < 1e-9
    for c in range(1, 33):
        mine = got[got.component == c].set_index("vec_id").loc[[i for i, _ in rows]]
        assert mine.deviation.tolist() == deviation
        sign = np.sign((mine.whitened.to_numpy() * plain[:, c - 1]).sum())
        assert np.abs(mine.whitened.to_numpy() - sign * plain[:, c - 1]).max() < 1e-7
        assert abs(mine.explained.iloc[0] - values[c - 1] / values.sum()) < 1e-12


# --- clustering -----------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dimension, scale):
    kept = [(i, [max(-(2**63), min(2**63 - 1, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [near(v) for _, v in kept]
    total = [min(2**63 - 1, sum(d for d, j in found if j == c)) for c in range(len(at))]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    everything = min(2**63 - 1, sum(d for d, _ in found))
    return sorted(((i is None, i or 0), j, min(2**63 - 1, d), total[j], everything, prints[j]) for (i, _), (d, j) in zip(kept, found))


def clustered(df, **more):
    names = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), *(r[c] for c in names)) for r in clustering.cluster_vectors(df, **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_are_lloyds(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-3, 4) / 2 + rng.choice([0, 0, 0.1]) for _ in range(4)]) for i in range(400)]  # many ties
    rows += [(i, [0.5, 0.5, -0.5, 1.0]) for i in range(400, 600)]
    rows += [(700, None), (701, []), (702, [1.0] * 5), (703, [None] * 4), (704, [float("nan")] * 4), (705, [float("inf")] * 4), (None, [0.1] * 4), (None, [0.2] * 4), (9, [1.0] * 4), (9, [1.0] * 4)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(5)
    assert clustered(df, dimension=4, scale=8) == lloyd(rows, 8, 10, 4, 8)
    assert clustered(df, dimension=4, scale=8, k=3, rounds=0) == lloyd(rows, 3, 0, 4, 8)
    assert clustered(df.where("vec_id < 3"), dimension=4) == lloyd([r for r in rows if r[0] is not None and r[0] < 3], 8, 10, 4, 1024)
    assert clustered(df.limit(0), dimension=4) == []


def test_clusters_of_very_long_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(0, 30) for _ in range(3)]) for i in range(60)]
    assert clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dimension=3, k=4) == lloyd(rows, 4, 10, 3, 1024)


def test_bounds_skip_distances_and_nothing_else():
    rng = np.random.default_rng(6)
    middle = rng.integers(-5000, 5000, (8, 64))
    x = middle[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 64))
    at, state, computed = x[:8].copy(), (None, None, None), []
    c = clustering.Centroids(at)
    for _ in range(6):
        cluster, upper, lower, n = clustering.assign(x, c, *state)
        gap = ((x[:, None, :] - c.at[None]) ** 2).sum(2)
        assert (cluster == gap.argmin(1)).all()
        assert (upper**2 >= gap[np.arange(len(x)), cluster]).all() and (lower**2 <= gap).all()
        computed.append(n)
        state = (cluster, upper, lower)
        moved = np.array([x[cluster == j].sum(0) // (cluster == j).sum() if (cluster == j).any() else c.at[j] for j in range(8)])
        c = clustering.Centroids(moved, c.at)
    assert computed[0] <= 8 * len(x) and computed[-1] < 0.2 * 8 * len(x)


def test_tokens_are_those_of_the_join():
    assert minhash_dedup.SIZE == 4 and ngram_join.SIZE == 5
