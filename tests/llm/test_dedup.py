"""Near copies and repeated strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import prose
from patronage.llm import near_copies, repeats


def shingles(text, k=5):
    w = [x.encode() for x in (text or "").encode().decode().split()]
    out, seen = [], Counter()
    for i in range(max(1, len(w) - k + 1) if w else 0):
        s = tuple(w[i:i + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def lcs_similarity(a, b):
    a, b = shingles(a), shingles(b)
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1]) if a and b else 0.0


def plain_classes(rows):
    """Least id of the class of each row, by comparing all pairs."""
    texts = sorted({t for _, t in rows if t is not None})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if find(a) != find(b) and lcs_similarity(a, b) >= 0.8:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for d, t in rows:
        if t is not None:
            ids[find(t)].append(d)
    return {(d, t): d if t is None else min(x for x in ids[find(t)] if x is not None) for d, t in rows}


def changed(rnd, text, n):
    w = text.split()
    for _ in range(n):
        i = rnd.randrange(len(w))
        w[i:i + rnd.randrange(2)] = [prose(rnd, 1)] * rnd.randrange(2)
    return " ".join(w)


@pytest.fixture()
def copies(rnd):
    texts = [prose(rnd, rnd.randrange(60, 160)) for _ in range(25)]
    for base in texts[:12]:
        texts += [changed(rnd, base, rnd.randrange(1, 5)) for _ in range(rnd.randrange(1, 5))]
    family = prose(rnd, 150)
    texts += [changed(rnd, family, rnd.randrange(1, 4)) for _ in range(25)]
    texts += [texts[0], texts[0], texts[3], "one two", "one  two", "a b c d", "a b c e", "", "", " ", None, None, "w " * 300, "w " * 290]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies(documents, copies):
    rows = [*copies, copies[3]]
    got = near_copies.near_copies(documents(rows).repartition(4)).collect()
    want = plain_classes(rows)
    text = dict(copies)
    assert len(got) == len(rows)
    wrong = [r["doc_id"] for r in got if r["class_id"] != want[r["doc_id"], text[r["doc_id"]]]]
    assert not wrong
    size = Counter(want[r] for r in rows)
    assert all(r["class_size"] == size[r["class_id"]] for r in got if text[r["doc_id"]] is not None)


def test_keep_one(documents, copies):
    df = documents([*copies, copies[3], (None, "text of a null id that is like no other")])
    kept = near_copies.keep_one(df)
    rows = kept.collect()
    want = {c for (d, t), c in plain_classes(copies).items()}
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in rows) == Counter(want | {None})
    assert near_copies.keep_one(df.limit(0)).count() == near_copies.near_copies(df.limit(0)).count() == 0


def test_similarity_is_the_alignment(rnd):
    for _ in range(120):
        a = prose(rnd, rnd.randrange(1, 60), "ab", 4)
        b = changed(rnd, a, rnd.randrange(0, 3)) if rnd.random() < 0.8 else prose(rnd, 20, "ab", 4)
        x, y = (near_copies.items(np.frombuffer(t.encode(), "u1")) for t in (a, b))
        plain = lcs_similarity(a, b)
        assert near_copies.similarity(x, np.argsort(x), y) == pytest.approx(plain if plain >= 0.8 else 0.0)


def test_long_text_in_parts(rnd, monkeypatch):
    h = near_copies.items(np.frombuffer(prose(rnd, 3000).encode(), "u1"))
    whole = near_copies.sketches(h)
    monkeypatch.setattr(near_copies, "_WIDTH", 100)
    assert (near_copies.sketches(h) == whole).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 201), (201, 200)] + [(300, 300 + i) for i in range(1, 30)]
    name = lambda i: i.to_bytes(2, "big")
    df = spark.createDataFrame([(name(a), name(b)) for a, b in links], "a binary, b binary")
    got = {int.from_bytes(r[0], "big"): int.from_bytes(r[1], "big") for r in near_copies.components(df).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == got[95] == 90 and got[201] == 200 and got[329] == 300


def loose_family(seed, size=200, words=600):
    """Texts that share buckets, no two of them similar but the first two."""
    rnd = random.Random(seed)

    def changed_at(places, text):
        text = list(text)
        for i in places:
            text[i] = "x%d" % rnd.getrandbits(60)
        return text

    base = prose(rnd, words).split()
    spots = list(range(6, words - 6, 6))
    picked = rnd.sample(spots, 14)
    both = changed_at(picked[:2], base)
    taken = [set(picked[:8]), {*picked[:2], *picked[8:]}]
    texts = [changed_at(picked[2:8], both), changed_at(picked[8:], both)]
    while len(texts) < size:
        places = set(rnd.sample(spots, 8))
        if all(len(places & other) <= 2 for other in taken):
            taken.append(places)
            texts.append(changed_at(places, base))
    return [" ".join(x) for x in texts]


def test_a_step_without_a_link_does_not_end_the_search(documents):
    texts = [t for seed in (0, 3) for t in loose_family(seed)]
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(documents(list(enumerate(texts))).repartition(4)).collect()}
    assert lcs_similarity(texts[0], texts[1]) >= 0.8 and lcs_similarity(texts[200], texts[201]) >= 0.8
    assert got == {i: i - (i in (1, 201)) for i in range(400)}


def test_near_copies_with_a_partition_for_each_row(spark, documents):
    """Nothing depends on which rows of a bucket a partition holds."""
    settings = {"spark.sql.shuffle.partitions": "240", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(documents(list(enumerate(loose_family(0, 12))))).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - (i == 1) for i in range(12)}


def test_short_texts_that_are_similar_always_meet(rnd):
    missed = met = 0
    for _ in range(3000):
        w = ["x%d" % rnd.getrandbits(60) for _ in range(rnd.choice([9, rnd.randrange(8, 19)]))]
        one = rnd.choice([w[1:], w[:-1], w[1:-1], w[2:], w[:-2], [*w[1:], "x"], ["x", *w[1:]]])
        a, b = (near_copies.items(np.frombuffer(" ".join(x).encode(), "u1")) for x in (w, one))
        if len(a) + len(b) <= 26 and near_copies.similarity(a, np.argsort(a), b) > 0:
            met += 1
            keys = [next(near_copies._sketch_rows([pa.record_batch({"node": [b"n"], "text": [" ".join(x)]})])) for x in (w, one)]
            missed += not set(keys[0]["key"].to_pylist()) & set(keys[1]["key"].to_pylist())
    assert met > 500 and not missed


def test_parities_leave_out_no_similar_pair(rnd):
    for _ in range(40):
        base = prose(rnd, rnd.randrange(1, 150))
        texts = [changed(rnd, base, rnd.randrange(0, 4)) for _ in range(8)]
        h = [near_copies.items(np.frombuffer(t.encode(), "u1")) for t in texts]
        rows = [(b"%d" % i, b"%d" % i, 0, len(x), near_copies._parities(x).tobytes()) for i, x in enumerate(h) if len(x)]
        found = {(a, b) for a, b, _ in near_copies._close(rows, True, 0.8)}
        similar = {(b"%d" % i, b"%d" % j) for j in range(8) for i in range(j) if near_copies.similarity(h[i], np.argsort(h[i]), h[j]) > 0}
        assert similar <= found


def plain_removed(texts, length):
    count = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                cover[i:i + length] = True
        runs = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        yield len(b), int(cover.sum()), runs, hashlib.sha256(np.frombuffer(b, "u1")[~cover].tobytes()).hexdigest()


@pytest.fixture()
def passages(rnd):
    def text(n):
        return "".join(rnd.choice("abcdé \n") for _ in range(n))

    base = [text(400) for _ in range(6)]
    texts = []
    for _ in range(80):
        t = text(rnd.randrange(200))
        for _ in range(rnd.randrange(3)):
            a = rnd.randrange(300)
            t += rnd.choice(base)[a:a + rnd.randrange(20, 120)] + text(rnd.randrange(5))
        texts.append(t)
    return texts + [texts[0], base[0], base[0], "a" * 500, "a" * 59, "a" * 60, "ab" * 200, "", base[1][:200] + "x" + base[1][201:], text(5000)] + [base[2] + text(30) for _ in range(30)]


@pytest.mark.parametrize("group_rows", [4096, 4])
def test_repeats(documents, passages, group_rows):
    got = repeats.removed(documents([*enumerate(passages), (None, None)]).repartition(4), length=60, group_rows=group_rows).collect()
    want = list(plain_removed([t.encode() for t in passages], 60))
    assert len(got) == len(passages) + 1
    for r in got:
        assert tuple(r)[1:] == (want[r["doc_id"]] if r["doc_id"] is not None else (0, 0, 0, hashlib.sha256(b"").hexdigest())), r["doc_id"]


def test_repeats_rows_and_ids(documents, rnd):
    a, b = prose(rnd, 100), prose(rnd, 100)
    got = repeats.removed(documents([(1, a), (1, a), (1, b), (None, prose(rnd, 100)), (2, prose(rnd, 100))]), length=60).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"] - r["n_removed"]) for r in got if r["n_removed"]) == [(1, 0), (1, 0)]
    assert repeats.removed(documents([]), length=60).count() == 0


def test_segments_of_long_texts(documents, passages, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT_BITS", 9)
    data = [t.encode() for t in passages]
    for b in data:
        last = -1
        for h, pos, first, until in repeats.anchors(np.frombuffer(b, "u1"), 60):
            for p, x, y in zip(pos.tolist(), first.tolist(), until.tolist()):
                assert x == last + 1 and x <= y and x <= p <= x + 44 and y <= p
                last = y
        assert last == max(-1, len(b) - 60)


def test_cut_keeps_columns(documents, rnd):
    shared, own = prose(rnd, 40) + "é", prose(rnd, 30)
    df = documents([(1, own + shared), (2, shared + prose(rnd, 30)), (3, own[:50]), (4, None)])
    out = repeats.cut_repeats(df, length=60)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == df.columns and len(rows) == 4 and rows[3]["text"] == own[:50] and rows[4]["text"] is None
    assert rows[1]["text"].startswith(own[:-5]) and len(rows[1]["text"]) <= len(own) and rows[1]["n_chars"] == len(rows[1]["text"])


def test_spans_grow_with_the_repeated_rows_not_with_their_square(documents, rnd):
    shared = prose(rnd, 60)
    a, b = (f"{prose(rnd, 40)} {shared} {prose(rnd, 40)}" for _ in range(2))
    n = [repeats.repeated_spans(documents([(1, a)] * m + [(2, b)]), length=60).count() for m in (10, 40)]
    assert 0 < n[1] < 6 * n[0]
    df = documents([(1, a)] * 40 + [(2, b)])
    held = repeats._with_spans(df, repeats.repeated_spans(df, length=60), "doc_id", "text").where("doc_id = 1").collect()
    assert len(held) == 40 and all(len(r["_spans"]) == len(set(r["_spans"])) for r in held)


def test_texts_without_a_partner_end_where_they_are_read(spark, documents, rnd):
    """The map of the nodes lets each of them through, once, and few others reach the shuffle; a full map only costs time."""
    rows = [(i, prose(rnd, 12)) for i in range(3000)]
    known = documents(rows + rows[:40]).repartition(4).withColumn("node", F.unhex(F.md5("text")))
    nodes = known.where("doc_id < 200").select("node").distinct()
    for most in (near_copies.MAP_BITS, 8):
        found = near_copies._of_nodes(known, nodes, most)
        assert sorted(r["text"] for r in found.collect()) == sorted(t for _, t in rows[:200])
    assert near_copies._marked(known, nodes).count() < 500
    assert near_copies._of_nodes(known, nodes.where("false")).count() == 0


CLASHING = ["_node", "_doc", "_mark", "_spans", "_dealt", "_nth", "_until", "_cut", "row", "doc", "dealt", "until", "text_key", "KEPT_KEY", "kept_id", "spans", "row_key", "span_mark", "mark"]


@pytest.fixture()
def clashing(spark):
    """Documents with columns that have the names of all helpers, each with a value of its own."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}{k}" for c in CLASHING]) for k, (i, t) in enumerate(rows)], schema)

    return make


def test_stages_keep_columns_of_any_name(clashing, rnd):
    from patronage.llm import mixing

    passage = prose(rnd, 120, longest=9)
    rows = [(i, prose(rnd, 60) + " " + passage + " " + prose(rnd, 30)) for i in range(4)] + [(7, prose(rnd, 80)), (8, None), (9, ""), (None, prose(rnd, 70))]
    docs = clashing(rows)
    before = {r["doc_id"]: r for r in docs.collect()}
    for out in (near_copies.keep_one(docs), repeats.cut_repeats(docs, 256), mixing.mixed_documents(docs, share=1.0)):
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == before[r["doc_id"]][c] for r in found for c in CLASHING)
    cut = {r["doc_id"]: r for r in repeats.cut_repeats(docs, 256).collect()}
    assert len(cut) == len(rows) and all(len(cut[i]["text"]) < len(before[i]["text"]) - 256 and cut[i]["n_chars"] == len(cut[i]["text"]) for i in range(4))
    assert cut[8]["text"] is None and cut[9]["text"] == ""


def test_text_that_is_left(documents, rnd):
    passage = prose(rnd, 150, longest=9)
    rows = [(1, "ä" + passage + "é end"), (2, "ö" + passage + "é stop"), (3, passage[:300]), (4, None)]
    found = {r["doc_id"]: r for r in repeats.removed(documents(rows)).collect()}
    assert [found[i]["text"] for i in (1, 2, 3, 4)] == ["äend", "östop", passage[:300], ""]
    for i, text in rows:
        left = found[i]
        assert left["n_bytes"] == len((text or "").encode()) and (left["n_removed"] > 0) == (i < 3)
