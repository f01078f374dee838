"""Nearest vectors, source mix, toxicity and the pipeline against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import prose
from patronage.llm import mixing, neighbours, toxicity


def plain_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and None not in v and len(v) == 8) if np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            near = sorted((-float((v * w).sum()), i) for i, w in good if i != q)[:k]
            out[q] = [i for _, i in near], [-s for s, _ in near]
    return out


@pytest.mark.parametrize("n", [1, 3, 300])
def test_nearest(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.2, 3)).tolist()) for i in range(n)]
    same = [1.0] * 8
    rows += [(1000 + i, same) for i in range(60)] if n > 100 else []
    rows += [(400, None), (420, [0.0] * 8), (440, [1.0] * 7 + [None]), (460, [1.0] * 7 + [float("nan")]), (480, [float("inf")] + [1.0] * 7), (None, same), (500, [1.0] * 3)] if n > 100 else []
    rows += rows[:1]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score string")
    rows = [(r["vec_id"], None if r["embedding"] is None else list(r["embedding"])) for r in df.collect()]
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {q: x for q, x in plain_nearest(rows, 20).items() if x[0]}
    assert set(got) == set(want)
    hits = 0
    for q, (ids, scores) in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(ids) + 1))
        hits += len(set(ids) & {i for _, i, _ in got[q]})
        for (_, i, s), t in zip(got[q], scores):
            assert s <= t + 1e-12
    assert hits >= 0.9 * sum(len(i) for i, _ in want.values())
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == neighbours.nearest(df, df.limit(0)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(100)], "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()):
        got[r["query_id"]].append(r["vec_id"])
    assert got == {q: [i for i in range(7) if i != q][:5] for q in range(0, 100, 20)}


def test_wide_windows_are_one_over_all(spark):
    """Random vectors have no near neighbours on a curve; four windows that add up to the table miss some, one over all misses none."""
    v = np.random.default_rng(4).standard_normal((7000, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()):
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, 7000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        assert got[q] == np.argsort(-s)[:20].tolist()


def test_tile_by_brute_force():
    """Ties, equal vectors and windows of some blocks only."""
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, (900, 5)).astype(float)
    block = np.sort(rng.integers(3, 12, 900))
    ids = [sorted(rng.choice(10 ** 6, rng.integers(1, 5), replace=False).tolist()) for _ in v]
    order = rng.permutation(900)
    rows = neighbours._Rows(pa.table({
        "low": block[order], "vector": pa.array([v[i].tobytes() for i in order]), "ids": pa.array([ids[i] for i in order], pa.list_(pa.int64()))}))
    queries, low = rng.integers(-2, 3, (40, 5)).astype(float), np.sort(rng.integers(0, 10, 40))
    high = np.maximum.accumulate(low + rng.integers(0, 5, 40))
    got = defaultdict(list)
    for q, s, i in zip(*rows.nearest(queries, low, high, 6)):
        got[int(q)].append((float(s), int(i)))
    for q in range(40):
        near = sorted((-float(w @ queries[q]), i) for w, b, found in zip(v, block, ids) if low[q] <= b <= high[q] for i in found)
        assert got[q] == [(-s, i) for s, i in near[:6]]


@pytest.mark.parametrize("curves, reach", [(3, 2500), (1, 20_000)])
def test_a_query_meets_every_block_of_its_window_once(monkeypatch, curves, reach):
    monkeypatch.setattr(neighbours, "ASKED", 7)
    n, rng = 20_000, np.random.default_rng(3)
    windows = neighbours._Windows({0: 0, 1: n // 2, 2: n}, n, curves, reach, span=3)
    curve = np.repeat(np.arange(curves, dtype="i4"), 40)
    at = curve * n + rng.integers(0, n + 1, len(curve))
    place = np.concatenate((np.arange(curves * n), at))
    query = np.arange(len(place)) >= curves * n
    part = np.minimum(np.searchsorted([n // 2, n], place, "right"), 2)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (np.concatenate((np.repeat(np.arange(curves, dtype="i4"), n), curve)), part.astype("i4"), place - np.array([0, n // 2, n])[part], query, np.arange(len(place)))]
        + [pa.array([b""] * len(place)), pa.array([[1]] * len(place))], ["curve", "part", "place", "query", "mark", "vector", "ids"])
    counts = pa.Table.from_batches(windows.spans([batch.slice(curves * n)]))
    tiles = windows.deal(dict(zip(counts["span"].to_pylist(), counts["n"].to_pylist())))
    blocks, asked = defaultdict(set), []
    for r in pa.Table.from_batches(windows.to_tiles([batch])).to_pylist():
        assert 0 <= r["tile"] < tiles
        if r["query"]:
            asked.append((r["mark"], r["tile"], r["low"], r["high"]))
        else:
            assert r["low"] == r["high"] == r["mark"] // neighbours.BLOCK
            blocks[r["tile"]].add((r["mark"] // n, r["low"]))
    met = defaultdict(list)
    for mark, tile, low, high in asked:
        met[mark] += [b for b in blocks[tile] if low <= b[1] <= high]
    for mark, c, p in zip(range(curves * n, len(place)), curve.tolist(), at.tolist()):
        want = {(c, x // neighbours.BLOCK) for x in range(max(p - reach, c * n), min(p + reach, (c + 1) * n - 1) + 1)}
        assert sorted(met[mark]) == sorted(want)


def test_hilbert_curve_is_one_path():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = side[np.argsort(neighbours.hilbert_keys(side, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_recall_on_the_table(spark, con):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    v = np.array([np.array(r[1], float) for r in rows])
    ids = np.array([r[0] for r in rows])
    got = defaultdict(set)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    found = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        found += len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert found >= 0.9 * 20 * (ids % 20 == 0).sum()


def plain_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    open_, rest = set(names), share * sum(sizes.values())
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rest / total >= most * sizes[s]}
        if not over:
            target |= {s: weight[s] * rest / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def _mix_rows(rnd):
    rows = [(i, prose(rnd, rnd.randrange(200)), rnd.choice(["a", "b", "b", "b", "b", "é", "Z", None, "tiny"] if i % 50 == 0 else ["a", "b", "b", "b", "b", "é", "Z", None])) for i in range(900)]
    return rows + [(7, rows[7][1], rows[7][2]), (None, "x y", "a"), (901, None, "a"), (902, "", "none"), (903, prose(rnd, 20_000), "long")]


def test_mix(documents, rnd):
    rows = _mix_rows(rnd)
    df = documents(rows)
    got = mixing.mix(df.repartition(6)).collect()
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes, taken = Counter(), Counter()
    for r in sorted(got, key=key):
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["passes"] * r["size"] + r["to_word"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    targets = plain_targets(sizes, (3, 1, 2), 1.5, 2.0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= mixing.BLOCK_WORDS + 0.01 * t, (s, taken[s], t)
    assert mixing.mix(df.limit(0)).count() == mixing.mixed_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1.5, 1.0, 0.6, 2.25])
def test_fractional_cap(documents, rnd, most):
    """Sources at the cap give that fraction of their words, and no document gives more of its own."""
    rows = _mix_rows(rnd)
    sizes, taken = Counter(), Counter()
    for r in mixing.mix(documents(rows), share=most, most=most).collect():
        assert r["taken"] <= most * r["size"] + 1e-9
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in plain_targets(sizes, (3, 1, 2), most, most).items():
        docs = sum(1 for _, _, x in rows if x == s)
        assert abs(taken[s] - t) <= mixing.BLOCK_WORDS + 0.01 * t + docs, (s, taken[s], t)


def test_many_shards(documents, rnd, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2048)
    got = mixing.mix(documents(_mix_rows(rnd))).collect()
    total = defaultdict(int)
    for r in got:
        total[r["source"], r["target"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for (s, t), n in total.items():
        assert abs(n - t) <= 0.02 * t + 2 * mixing.BLOCK_WORDS, (s, t, n)


def test_mixed_documents(documents, rnd):
    rows = _mix_rows(rnd)
    df = documents(rows)
    out = mixing.mixed_documents(df)
    words = defaultdict(int)
    for r in out.collect():
        whole = [t for d, t, s in rows if d == r["doc_id"] and s == r["source"]]
        assert any(t.startswith(r["text"]) for t in whole if t) and r["class"] == "extra" and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["taken"]
    assert out.columns == df.columns and words == {d: n for d, n in want.items() if n}


def test_sainte_lague(spark, rnd):
    parts = [(i, rnd.randrange(1, 1000), rnd.randrange(1, 40)) for i in range(30)]
    df = spark.createDataFrame(parts, "part int, weight int, most bigint").withColumn("seats", F.lit(200).cast("bigint"))
    got = {r["part"]: r["held"] for r in mixing.apportion(df, [], "seats", "weight", "most", "held", [F.col("part")]).collect()}
    held = dict.fromkeys(got, 0)
    for _ in range(200):
        best = max(((w / (2 * held[i] + 1), -i) for i, w, m in parts if held[i] < m), default=None)
        if best:
            held[-best[1]] += 1
    assert got == held


def test_toxicity(documents, spark, rnd):
    def text(bad):
        words = prose(rnd, rnd.randrange(20, 80), "abcdefghijklm", 4).split()
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "Nasty", "foul,"]))
        return " ".join(words)

    truth = {i: i % 5 == 0 for i in range(1200)}
    rows = [(i, text(bad)) for i, bad in truth.items()]
    df = documents([*rows, (1, rows[1][1]), (None, "x"), (5000, None), (5001, ""), (5002, text(False) + " " + prose(rnd, 40_000) + " vile")])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in truth.items()] + [(3, 0, 0), (None, 1, 1), (2, 1, None), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(right) >= 0.97 * len(right)
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] in (5000, 5001, 5002)} == {5000: 0, 5001: 0, 5002: 1}
    # Labels of held-out rows change nothing.
    other = labels.where(~toxicity.held_out(F.col("doc_id")))
    assert sorted(toxicity.toxicity(df, other).collect(), key=str) == sorted(got, key=str)
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(df.limit(3), labels.limit(0)).collect()} == {0.5}


def test_toxicity_on_the_table(spark, con):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r[0], r[1]): r[2] for r in rows}
    assert n[0, 0] + n[1, 1] >= 0.94 * sum(n.values()) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
