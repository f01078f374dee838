"""The learners against plain versions: a loop over rows, recursion over nodes, and nothing distributed."""

import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions import columns as C
from patronage.operators import kernel, models, online, trees, weighted
from patronage.plans import jobs, registry
from patronage.session import materialise, scratch_path
from patronage.sources import sparse_lines
from patronage.sources.shop import CUTOFF


@pytest.fixture(scope="module")
def table(shop):
    return materialise(jobs.priced_features(shop), "features")


# ---- sparse lines

def written(spark, lines):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "line string").write.text(path)
    return sparse_lines.read_lines(spark, path)


def test_lines_by_hand(spark):
    rows = {r["id"]: r for r in written(spark, [
        "1 '7 |f a:2.5 b:x c", "0 '8 |f", "0.5 '9 |f  a:-1   d:1e3|", "", "'10 |f a:1", "1 '11 |f a:b:c", "oops"]).collect()}
    pairs = {k: [tuple(f) for f in r["features"]] for k, r in rows.items()}
    assert pairs == {7: [("a", "2.5"), ("b", "x"), ("c", "1")], 8: [], 9: [("a", "-1"), ("d", "1e3")], 10: [("a", "1")], 11: [("a", "b:c")], None: []}
    assert [rows[k]["label"] for k in (7, 8, 9, 10)] == [1.0, 0.0, 0.5, None]


def test_typed_columns_by_hand(spark):
    fields = T.StructType.fromDDL("a double, b string, c int, z double")
    rows = sparse_lines.lines_as_table(written(spark, ["1 '7 |f a:2.5 b:x c:4", "0 '8 |f c:oops a:1 a:2"]), fields).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(7, 1.0, 2.5, "x", 4, None), (8, 0.0, 1.0, None, None, None)]


def test_vectors_by_hand(spark):
    rows = sparse_lines.lines_as_vectors(written(spark, ["1 '7 |f a:2.5 b:x a:1 e:0", "0 '8 |f b:y n:NaN"]), bits=20).orderBy("id").collect()
    slot = {t: v % (1 << 20) for t, v in spark.range(1).select(*[F.xxhash64(F.lit(t)).alias(t) for t in ("a", "b=x", "b=y", "n=NaN", "Constant")]).first().asDict().items()}
    assert dict(zip(rows[0]["slots"], rows[0]["values"])) == {slot["a"]: 3.5, slot["b=x"]: 1.0, slot["Constant"]: 1.0}
    assert dict(zip(rows[1]["slots"], rows[1]["values"])) == {slot["b=y"]: 1.0, slot["n=NaN"]: 1.0, slot["Constant"]: 1.0}
    assert rows[0]["slots"] == sorted(rows[0]["slots"])


def test_no_lines(spark):
    assert written(spark, []).count() == 0
    assert sparse_lines.lines_as_vectors(written(spark, [])).count() == 0


# ---- online quantile learner

def plain_updates(rows, model, tau, rate):
    """The updates with a dictionary per quantity, one feature at a time."""
    w, s, g, scale, seen, loss = *model, 0.0
    for slots, values, label in rows:
        for i, x in zip(slots, values):
            if abs(x) > s.get(i, 0.0):
                w[i] = w.get(i, 0.0) * s.get(i, 0.0) / abs(x)
                s[i] = abs(x)
        guess = sum(w.get(i, 0.0) * x for i, x in zip(slots, values))
        loss += tau * (label - guess) if label > guess else (1 - tau) * (guess - label)
        slope = -tau if label > guess else 1 - tau
        scale += sum((x / s[i]) ** 2 for i, x in zip(slots, values))
        seen += 1
        for i, x in zip(slots, values):
            g[i] = g.get(i, 0.0) + (slope * x) ** 2
            w[i] -= rate * (seen / scale) ** 0.5 * slope * x / (s[i] * g[i] ** 0.5)
    return (w, s, g, scale, seen), loss


@pytest.fixture()
def examples(spark):
    rnd, rows = random.Random(5), []
    for i in range(300):
        slots = sorted(rnd.sample(range(1, 40), rnd.randrange(1, 9)))
        values = [rnd.choice([1.0, rnd.gauss(0, 1), rnd.gauss(0, 50)]) or 1.0 for _ in slots]
        rows.append((i, float(sum(slots) % 3 == 0) if i % 50 else None, [0, *slots], [1.0, *values]))
    return spark.createDataFrame(rows, "id bigint, label double, slots array<int>, values array<double>")


def in_order(df, seed_columns=("id", "label", "slots", "values")):
    rows = df.where("label is not null").withColumn("place", F.xxhash64(F.lit(1), *seed_columns)).orderBy("place").collect()
    return [(r["slots"], r["values"], r["label"]) for r in rows]


def test_one_part_equals_the_plain_loop(examples):
    model, losses = online.fit(examples, passes=4, bits=6, hold_out=None)
    state = ({}, {}, {}, 0.0, 0.0)
    rows = in_order(examples)
    for number in range(4):
        state, loss = plain_updates(rows, state, 0.6, 0.85)
        assert losses[number][0] == pytest.approx(loss / len(rows), rel=1e-9)
    for i, w in state[0].items():
        assert model.weights[i] == pytest.approx(w, rel=1e-9, abs=1e-12)
    assert np.count_nonzero(model.weights) == len([w for w in state[0].values() if w])


def test_parts_are_averaged_by_what_they_saw(examples):
    model, _ = online.fit(examples, passes=1, bits=6, rows_per_part=100, hold_out=None)
    placed = examples.where("label is not null").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3)))
    ends = [plain_updates(in_order(placed.where(F.col("part") == p)), ({}, {}, {}, 0.0, 0.0), 0.6, 0.85)[0] for p in range(3)]
    for i in range(40):
        seen = [(e[2][i], e[0][i]) for e in ends if i in e[2]]
        if seen:
            assert model.weights[i] == pytest.approx(sum(g * w for g, w in seen) / sum(g for g, _ in seen), rel=1e-9)


def test_best_pass_by_held_out_rows(examples):
    model, losses = online.fit(examples, passes=30, bits=6)
    held = [h for _, h in losses]
    assert len(held) <= 31 and (len(held) == 31 or min(held) == held[-4])
    rows = [r for r in examples.where("label is not null").where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(10)) == 0).collect()]
    mine = [r["label"] - float(model.weights[r["slots"]] @ np.array(r["values"])) for r in rows]
    assert np.mean([max(0.6 * x, -0.4 * x) for x in mine]) == pytest.approx(min(held), rel=1e-9)
    scored = {r["id"]: r["score"] for r in online.predict(model, examples).collect()}
    assert all(scored[r["id"]] == pytest.approx(float(model.weights[r["slots"]] @ np.array(r["values"])), abs=1e-9) for r in rows)


def test_nothing_to_learn(examples):
    model, losses = online.fit(examples.limit(0), bits=6)
    assert not model.weights.any() and losses == []
    assert {r["score"] for r in online.predict(model, examples).collect()} == {0.0}


def test_learns_what_can_be_learnt(spark):
    """A third of the rows have a sign that decides the label: the loss falls well below that of the best constant."""
    rnd = random.Random(3)
    rows = [(i, float(k), [0, 1 if i % 3 else 2 + k, 5 + rnd.randrange(40)], [1.0, 1.0, 1.0]) for i in range(2000) for k in [rnd.randrange(2)]]
    df = spark.createDataFrame(rows, "id bigint, label double, slots array<int>, values array<double>")
    model, losses = online.fit(df, bits=6)
    assert online.pinball(online.predict(model, df).join(df, "id")) < 0.85 * 0.2


def test_late_split(shop, table):
    """Every late row of the shop has a score."""
    scored = registry.queries()["ml_quantile_linear"](shop.spark, shop.sf_dir)
    train = table.where("label <> 0.5").where(~C.is_early("offer_date", CUTOFF))
    assert sorted(r["id"] for r in scored.collect()) == sorted(r["id"] for r in train.collect())


# ---- trees

@pytest.fixture()
def rows(spark):
    rnd, out = random.Random(11), []
    for i in range(400):
        x = [rnd.random(), float(rnd.randrange(4)), rnd.gauss(0, 1), 7.0]
        out.append((i, int((x[0] > 0.6) ^ (x[1] == 2) ^ (rnd.random() < 0.1)) if i % 40 else None, x))
    return spark.createDataFrame(out, "id bigint, label int, x array<double>")


def local(df):
    found = [r for r in df.collect() if r["label"] is not None]
    return np.array([r["x"] for r in found]), np.array([r["label"] for r in found])


def gini(w, y):
    p, n = w[y > 0].sum(), w[y <= 0].sum()
    return 2 * p * n / (p + n) if p + n else 0.0


def plain_tree(bins, y, w, depth, gain, min_split, min_leaf):
    """A nested rule (column, bin, left, right) or a vote, by trying every cut of every node."""
    root = gini(w, y)

    def node(at, level):
        vote = 1.0 if w[at][y[at] > 0].sum() >= w[at][y[at] <= 0].sum() else -1.0
        if level > depth or len(at) < min_split:
            return vote
        best = (0.0, None)
        for c in range(bins.shape[1]):
            for b in range(32):
                left = bins[at, c] <= b
                if left.sum() >= min_leaf and (~left).sum() >= min_leaf:
                    better = gini(w[at], y[at]) - gini(w[at][left], y[at][left]) - gini(w[at][~left], y[at][~left])
                    if better > best[0] + 1e-12:
                        best = (better, (c, b))
        if best[1] is None or best[0] < gain * root:
            return vote
        c, b = best[1]
        left = bins[at, c] <= b
        return c, b, node(at[left], level + 1), node(at[~left], level + 1)

    return node(np.arange(len(y)), 0)


def vote(rule, row):
    while not isinstance(rule, float):
        rule = rule[2] if row[rule[0]] <= rule[1] else rule[3]
    return rule


def test_boosting_equals_a_plain_loop(rows):
    model = trees.boost(rows, 4, rounds=6, min_split=20, min_leaf=7)
    x, y = local(rows)
    bins = np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(model.edges)])
    w, margin = np.ones(len(y)), np.zeros(len(y))
    for alpha, error in zip(model.alphas, model.errors):
        rule = plain_tree(bins, y, w, 30, 0.012, 20, 7)
        votes = np.array([vote(rule, b) for b in bins])
        wrong = votes != np.where(y > 0, 1, -1)
        assert error == pytest.approx(w[wrong].sum() / w.sum(), rel=1e-9)
        assert alpha == pytest.approx(0.5 * np.log((1 - error) / error), rel=1e-9)
        w = w * np.exp(np.where(wrong, alpha, -alpha))
        margin += alpha * votes
    found = {r["id"]: r for r in trees.boosted_scores(model, rows).collect()}
    ids = [r["id"] for r in rows.collect() if r["label"] is not None]
    assert len(model.trees) >= 3 and len(found) == rows.count()
    for i, m in zip(ids, margin):
        assert found[i]["margin"] == pytest.approx(m, abs=1e-9) and found[i]["score"] == pytest.approx(1 / (1 + np.exp(-2 * m)))


def test_boosting_edges(rows):
    assert trees.boost(rows.limit(0), 4).trees == []
    one = trees.boost(rows.where("label = 1"), 4)
    assert len(one.trees) == 1 and one.errors == [0.0]
    assert {r["score"] > 0.99 for r in trees.boosted_scores(one, rows).collect()} == {True}


def plain_extra(x, y, seed, number, candidates):
    """Value of each row's leaf in one tree, by recursion with the same draws."""
    out = np.zeros(len(y))

    def node(at, name):
        low, high = x[at].min(axis=0), x[at].max(axis=0)
        out[at] = y[at].mean()
        if len(set(y[at])) < 2 or not (high > low).any():
            return
        columns, cuts = trees.draws(seed, number, np.array([name], "u8"), low[None], high[None], candidates)
        best = None
        for c, cut in zip(columns[0], cuts[0]):
            left = x[at, c] <= cut
            if high[c] > low[c] and 0 < left.sum() < len(at):
                left_over = gini(np.ones(left.sum()), y[at][left]) + gini(np.ones((~left).sum()), y[at][~left])
                if best is None or left_over < best[0] - 1e-12:
                    best = left_over, left
        if best is not None:
            node(at[best[1]], 2 * name)
            node(at[~best[1]], 2 * name + 1)

    node(np.arange(len(y)), 1)
    return out


def test_extra_trees_equal_a_plain_version(rows, monkeypatch):
    monkeypatch.setattr(trees, "FOREST_ROWS", 90)  # several tasks
    forest = trees.extra_trees(rows, 4, trees=5, seed=9)
    x, y = local(rows)
    want = np.mean([plain_extra(x, y, 9, k, 2) for k in range(5)], axis=0)
    found = {r["id"]: r["score"] for r in trees.forest_scores(forest, rows, 4).collect()}
    ids = [r["id"] for r in rows.collect() if r["label"] is not None]
    assert [found[i] for i in ids] == pytest.approx(want.tolist())
    assert np.mean((want > 0.5) == y) > 0.97  # fully grown
    shares = trees.column_importances(forest, ["a", "b", "c", "d"])
    assert sum(shares.values()) == pytest.approx(1) and shares["d"] == 0 and shares["a"] > shares["c"]


def test_extra_trees_edges(rows):
    for few in (rows.limit(0), rows.where("label = 0")):
        forest = trees.extra_trees(few, 4, trees=2)
        assert all(len(t[0]) == 1 for t in forest)
    assert max(len(t[0]) for t in trees.extra_trees(rows, 4, trees=3, most_leaves=8)) <= 15
    assert max(len(t[0]) for t in trees.extra_trees(rows, 4, trees=2, depth=2)) <= 7


@pytest.mark.parametrize("most", [1 << 16, 20])
def test_subtrees_stay_distributed(rows, monkeypatch, most):
    whole = trees.extra_trees(rows, 4, trees=3, seed=9, most_leaves=most)
    want = sorted((r["id"], r["score"]) for r in trees.forest_scores(whole, rows, 4).collect())
    monkeypatch.setattr(trees, "SUBTREE_ROWS", 60)
    forest = trees.extra_trees(rows, 4, trees=3, seed=9, most_leaves=most)
    assert max(len(t[0]) for t in forest.upper) < 40 and forest.subtrees.count() == sum(map(len, forest.roots)) > 3
    for a, b in zip(forest, whole):
        assert all((x == y).all() for x, y in zip(a, b)) and len(a[0]) <= 2 * most
    assert sorted((r["id"], r["score"]) for r in trees.forest_scores(forest, rows, 4).collect()) == want
    names = ["a", "b", "c", "d"]
    assert trees.column_importances(forest, names) == pytest.approx(trees.column_importances(whole, names))


def test_codes(spark):
    frame = spark.createDataFrame([(1, 1, "a", 2.0), (2, 0, None, None), (3, 1, "b", float("nan")), (4, 0, "a", 1.0)], "id int, label int, k string, v double")
    x = {r["id"]: r["x"] for r in trees.coded(frame, ["k"], ["v"]).collect()}
    assert x[1][0] == x[4][0] != x[3][0] and 0 <= x[1][0] < 1 and x[2] == [-1.0, 0.0] and x[3][1] == 0.0


# ---- kernel classifier

@pytest.fixture()
def ring(spark):
    """A disc inside a ring, which no line separates."""
    rnd, rows = np.random.default_rng(4), []
    for i in range(300):
        inside, angle = i % 2, rnd.uniform(0, 2 * np.pi)
        r = rnd.uniform(0, 0.8) if inside else rnd.uniform(1.5, 2.2)
        rows.append((i, float(inside), [3, 70], [float(r * np.cos(angle)), float(r * np.sin(angle))]))
    return spark.createDataFrame(rows, "id int, label double, slots array<int>, values array<double>")


def test_kernel_separates_a_ring(ring):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    def right(scored):
        rows = scored.join(ring.select("id", "label"), "id").collect()
        return sum((r["score"] > 0) == (r["label"] > 0) for r in rows) / len(rows)

    model, gamma = kernel.fit(ring, size=200, gamma=1.0, c=100.0)
    assert gamma == 1.0 and right(kernel.margins(model, ring, 200, 1.0)) > 0.97
    flat = ring.select("id", "label", array_to_vector("values").alias("features"))
    from pyspark.ml.functions import vector_to_array
    line = LinearSVC(maxIter=50).fit(flat).transform(flat).select("id", vector_to_array("rawPrediction")[1].alias("score"))
    assert right(line) < 0.75


def test_kernel_error_falls_with_the_size(ring):
    few, many = (kernel.kernel_error(ring, size, 0.5) for size in (32, 2048))
    assert many < 0.04 < few


def test_random_features_by_hand(spark):
    rows = spark.createDataFrame([(1, [5, 9], [2.0, -1.0]), (2, [], []), (3, [9], [4.0])], "id int, slots array<int>, values array<double>").repartition(3)
    phase = np.random.default_rng([7, 1 << 40]).uniform(0, 2 * np.pi, 16)
    w = {s: np.random.default_rng([7, s]).normal(0, 0.8 ** 0.5, 16) for s in (5, 9)}
    want = {1: 2 * w[5] - w[9] + phase, 2: phase, 3: 4 * w[9] + phase}
    for r in kernel.mapped(rows, 16, 0.4, 7).collect():
        assert r["features"].toArray() == pytest.approx(np.cos(want[r["id"]]) * (2 / 16) ** 0.5)


def test_sparse_rows_by_hand(spark):
    frame = spark.createDataFrame([(1, 1, "a", 2.0), (2, 0, None, None), (3, 1, "a", float("nan"))], "id int, label int, k string, v double")
    rows = {r["id"]: r for r in kernel.sparse_rows(frame, ["k"], ["v"]).collect()}
    assert rows[1]["values"] == [1.0, 2.0] and rows[2]["slots"] == [] and rows[3]["slots"] == rows[1]["slots"][:1]


# ---- weighted factorization

def plain_factors(rows, rank, iterations, ridge, alpha, items):
    r = {}
    for u, i, x in rows:
        r[u, i] = r.get((u, i), 0.0) + x
    users = {}
    for _ in range(iterations):
        for side, own, other in ((0, users, items), (1, items, users)):
            shared = sum(np.outer(y, y) for y in other.values()) + ridge * np.eye(rank)
            for k in sorted({p[side] for p in r}):
                a, b = shared.copy(), np.zeros(rank)
                for p, x in r.items():
                    if p[side] == k:
                        y = other[p[1 - side]]
                        a += alpha * x * np.outer(y, y)
                        b += (1 + alpha * x) * y
                own[k] = np.linalg.solve(a, b)
    return users, items


def test_factors_equal_a_plain_alternation(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(1, 12), rnd.randrange(1, 8), rnd.choice([1.0, 2.5, 6.0])) for _ in range(50)] + [(13, 3, 1.0), (1, 1, 0.5), (1, 1, 0.5)]
    pairs = spark.createDataFrame([*rows, (None, 2, 1.0), (2, None, 1.0), (2, 2, None)], "user_idx int, item_idx int, value double")
    users, items = weighted.weighted_factors(pairs, rank=3, iterations=4)
    ids = pairs.where("item_idx is not null").select(F.col("item_idx").alias("id")).distinct()
    begin = {r["id"]: np.array(list(r)[1:]) for r in weighted.start(ids, 3, 42).collect()}
    want = plain_factors(rows, 3, 4, 0.02, 1.0, {k: v for k, v in begin.items() if k in {i for _, i, _ in rows}})
    for found, plain in zip((users, items), want):
        found = {r["vec_id"]: r["features"] for r in found.collect()}
        assert set(found) == set(plain)
        assert all(found[k] == pytest.approx(plain[k].tolist(), abs=1e-6) for k in plain)
    short = weighted.weighted_factors(pairs, rank=3, iterations=1)
    clean = pairs.dropna().groupBy("user_idx", "item_idx").agg(F.sum("value").alias("value"))
    assert weighted.loss(clean, users, items) < weighted.loss(clean, *short)
    dense = np.array([[want[0][u] @ want[1][i] for i in sorted(want[1])] for u in sorted(want[0])])
    total = {(u, i): 0.0 for u in want[0] for i in want[1]}
    for u, i, x in rows:
        total[u, i] += x
    plain_loss = sum((1 + total[u, i]) * (float(total[u, i] > 0) - dense[a, b]) ** 2 for a, u in enumerate(sorted(want[0])) for b, i in enumerate(sorted(want[1])))
    plain_loss += 0.02 * sum((v ** 2).sum() for side in want for v in side.values())
    assert weighted.loss(clean, users, items) == pytest.approx(plain_loss, rel=1e-6)


def test_no_pairs(spark):
    users, items = weighted.weighted_factors(spark.createDataFrame([], "user_idx int, item_idx int, value double"))
    assert users.count() == items.count() == 0


# ---- fits whose numbers the queries return

def test_logistic_against_a_plain_descent(spark):
    from pyspark.ml.functions import array_to_vector

    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 2))
    y = (x @ [1.0, -2.0] + rnd.normal(size=60) > 0.3).astype(float)
    df = spark.createDataFrame([(i, float(t), [float(a) for a in r]) for i, (t, r) in enumerate(zip(y, x))], "id int, label double, a array<double>")
    frame = df.select("id", "label", array_to_vector("a").alias("features"))
    found = {r["id"]: r["score"] for r in models.fit_and_score(models.logistic(4.0, 60, 200), frame, frame).collect()}
    w, b = np.zeros(2), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= 0.05 * (x.T @ (p - y) / 60 + w / (4.0 * 60))
        b -= 0.05 * (p - y).mean()
    assert [found[i] for i in range(60)] == pytest.approx((1 / (1 + np.exp(-(x @ w + b)))).tolist(), abs=2e-3)


def test_every_customer_has_the_nearest_centroid(shop):
    from patronage.operators import clusters, factors

    rows = materialise(factors.products(jobs.fitted_factor_rows(shop, shop.history_base)), "rows")
    found = clusters.fit_assign(rows, 6).join(rows.select("id", "uv"), "id").toPandas()
    x = np.array(found["uv"].tolist())
    centre = np.array([x[found["cluster"] == k].mean(axis=0) for k in sorted(found["cluster"].unique())])
    near = ((x[:, None] - centre[None]) ** 2).sum(axis=2)
    number = {k: i for i, k in enumerate(sorted(found["cluster"].unique()))}
    own = near[np.arange(len(x)), [number[k] for k in found["cluster"]]]
    assert (own <= near.min(axis=1) + 1e-6).mean() > 0.9


def test_grid_winner_goes_into_the_loops(shop):
    assert models.logistic(0.5, 200).getRegParam() == pytest.approx(0.01)
    row = registry.queries()["cv_auc"](shop.spark, shop.sf_dir).first()
    assert row["loops"] == 8 and row["c"] in models.C_GRID and 0 <= row["mean_auc"] <= 1


def test_rows_of_known_sizes_learn_alike(monkeypatch):
    """After the first pass no value is new, and the rows of a batch share what does not depend on the weights."""
    rnd = np.random.default_rng(3)
    rows = [(float(rnd.random() < 0.4), i % 7 == 0, np.sort(rnd.choice(64, 9, replace=False)).tolist(), rnd.gamma(1, 5, 9).tolist()) for i in range(300)]
    rows.append((1.0, True, [1, 2], [1e6, 1.0]))  # held out: teaches nothing, however large
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([0] * len(x), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*x), (pa.float64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float64()))))],
        ["part", "label", "held", "slots", "values"]) for x in (rows[:120], rows[120:])]
    known, calls = online.Linear.empty(6), []
    for _, held, slots, values in rows:
        if not held:
            online.learn(known, np.array(slots), np.array(values), 0.5, 0.6, 0.85)
    alone = known.copy()
    for label, held, slots, values in rows:
        if not held:
            online.learn(alone, np.array(slots), np.array(values), label, 0.6, 0.85)
    monkeypatch.setattr(online, "learn", lambda *a: calls.append(a) or 0.0)
    [out] = online._pass_rows(known, 0.6, 0.85)(iter(batches))
    assert not calls
    more = alone.gradients - known.gradients
    at = np.flatnonzero(alone.largest)
    np.testing.assert_allclose(out.column(2).to_numpy()[:-1], (more * alone.weights)[at], rtol=1e-9)
    np.testing.assert_allclose(out.column(1).to_numpy(), np.append(more[at], alone.scale - known.scale), rtol=1e-9)


def test_splits_are_fitted_at_the_same_time(spark):
    rows = [(i, f"2000-01-{1 + i % 28:02}", float(i % 2), Vectors.dense([float(i % 5), float(i % 2)])) for i in range(60)]
    frame = spark.createDataFrame(rows, ["id", "offerdate", "label", "features"])
    both = threading.Barrier(2)

    class Waiting(LogisticRegression):
        def fit(self, dataset, params=None):
            both.wait(60)  # breaks if a split is fitted alone
            return super().fit(dataset, params)

    mean, sd = models.cross_validate(Waiting(maxIter=5), frame, loops=2)
    assert 0.5 <= mean <= 1.0 and sd >= 0.0
