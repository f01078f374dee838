"""The pipeline against a brute-force version of its stages on a small corpus."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest_llm import prose
from patronage.llm import quality
from patronage.llm.tokens import public_file
from test_dedup import changed, plain_classes, plain_removed
from test_rules import plain_counts
from test_search_mix import plain_targets


@pytest.fixture()
def corpus(rnd):
    texts = [prose(rnd, rnd.randrange(40, 150), longest=9) + "." for _ in range(40)]
    passage = prose(rnd, 110, longest=9)
    texts += [changed(rnd, t, 2) for t in texts[:8]] + texts[8:12] + [prose(rnd, 60) + ". " + passage + ", " + prose(rnd, 70) for _ in range(4)]
    texts += [None, "", "Buy!! now!! " * 40, "a b c " * 50, "\n".join([prose(rnd, 70) + ".", "Home | News | Sport | About"])]
    return [(i, t, rnd.choice(["x", "x", "x", "y", None])) for i, t in enumerate(texts)]


def tokens_of(pieces):
    out = Counter()
    for r in pieces:
        out[r["doc_id"], r["doc_tokens"]] += r["length"]
    return out


def assert_gapless(pieces, window=1024):
    at = defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert sorted(at) == list(range(len(at))) and all(n == window for s, n in at.items() if s < len(at) - 1)


def test_stages(spark, documents, corpus, tmp_path):
    documents(corpus).write.parquet(f"{tmp_path}/documents.parquet")
    docs, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs.collect())
        if len(out) < 5:
            assert docs.columns == documents([]).columns

    text = {i: t for i, t, _ in corpus}
    kept = {r["doc_id"]: r["text"] for r in out[0]}
    assert {i for i, t in text.items() if not plain_counts(t)[-1] and not any(map(quality.line_fails, t.split("\n")))} <= set(kept)
    assert all(not plain_counts(text[i])[-1] and not any(map(quality.line_fails, t.split("\n"))) for i, t in kept.items())

    classes = plain_classes(list(kept.items()))
    assert Counter(r["doc_id"] for r in out[1]) == Counter(set(classes.values()))

    before = [(r["doc_id"], r["text"]) for r in out[1]]
    left = {r["doc_id"]: r for r in out[2]}
    lost = list(plain_removed([t.encode() for _, t in before], 256))
    assert sum(n for _, n, _, _ in lost) > 0 and len(left) == len(before)
    for (i, t), (n, gone, _, _) in zip(before, lost):
        assert len(left[i]["text"].encode()) == n - gone and left[i]["n_chars"] == len(left[i]["text"])

    sizes, taken = Counter(), Counter()
    for r in out[2]:
        sizes[r["source"]] += len(r["text"].split())
    for r in out[3]:
        taken[r["source"]] += len(r["text"].split())
        assert left[r["doc_id"]]["text"].startswith(r["text"])
    for s, t in plain_targets(sizes, (3, 1, 2), 1.5, 2.0).items():
        assert abs(taken[s] - t) <= 64 + 0.01 * t

    tokenizer = Tokenizer.from_file(public_file())
    total = Counter()
    for r in out[3]:
        total[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    pieces, sequence = defaultdict(int), defaultdict(int)
    for r in out[4]:
        pieces[r["doc_id"]] += r["length"]
        sequence[r["sequence_id"]] += r["length"]
    assert pieces == dict(total)
    assert_gapless(out[4])
    assert all(n == 1024 for s, n in sequence.items() if s < max(sequence))

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert tokens_of(whole) == tokens_of(out[4])  # where a document lies depends on the partitions, what is packed does not
    assert_gapless(whole)


def test_empty(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
