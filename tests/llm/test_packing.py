"""Packing: ids against the tokenizer, cuts against plain dynamic programming, whole coverage."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def check(rows, got, tokenizer):
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    pieces, seqs = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for s, n in sorted(pieces[d]):
            assert s == at
            at += n
        assert at == len(x)
    pad = 0
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    return pad / sum(map(len, ids.values()))


def test_query(spark, sf_dir, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(rows, queries.op7_packing(spark, sf_dir).collect(), tokenizer) < 0.01


def test_cases(spark, tokenizer):
    odd = "It's I'LL don't 'S a<|endoftext|>b <|startoftext|> x́y é İSTANBUL ΣΑΣ ½ ² 1234 ªº    wide　 日本語 ａｂ \U0001f600 \x00\x1c\x85 ... (end.) ŉ ß"
    rows = [(1, None), (2, ""), (3, odd), (4, "no stop " * 9000), (5, "a. " * 6000), (6, odd * 40), (7, "same"), (8, "same")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").coalesce(1)
    assert check(rows, packing.pack(df).collect(), tokenizer) < 0.01
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_the_best(seed):
    rng = np.random.default_rng(seed)
    pos = np.cumsum(rng.integers(1, 8, 60))
    pen = rng.choice([0, 2, 5], 60)
    cap = 20
    best = {0: (0, [])}
    for i in range(60):
        options = [(best[a][0] + cap - (pos[i] - a) + pen[i], best[a][1] + [int(pos[i])]) for a in [0, *pos[:i].tolist()] if 0 < pos[i] - a <= cap]
        best[int(pos[i])] = min(options, key=lambda x: x[0])
    got = packing.best_cuts(pos, pen, cap)
    cost = lambda cuts: sum(cap - (b - a) + int(pen[list(pos).index(b)]) for a, b in zip([0, *cuts], cuts))
    assert cost(got) == best[int(pos[-1])][0] and got[-1] == pos[-1]


@pytest.mark.parametrize("seed", range(6))
def test_stretches_force_no_padding(seed):
    """Many short stretches pad about as little as one pass, whose cuts are the best."""
    rng = np.random.default_rng(seed)
    batches = []
    for k in range(200):
        ends = np.cumsum(rng.integers(1, 90 if k % 9 else 700, 5))
        sentences = np.unique(rng.integers(1, ends[-1], 12)) if k % 7 else np.zeros(0, int)
        batches.append(([5 * k + x for x in range(5)], rng.integers(0, 99, ends[-1]).astype(np.uint32), ends, sentences))
    padding = []
    for flush in (2000, 1 << 30):
        p = packing._Packer(0, 256, flush)
        for b in batches:
            p.add(*b)
            if p.end - p.begin >= p.flush:
                p.settle(False)
                assert p.end - p.begin <= 256
        p.settle(True)
        sizes = {}
        for r in p.rows:
            sizes[r[5]] = sizes.get(r[5], 0) + r[2]
        padding.append(sum(0 if n & (n - 1) == 0 else 256 - n for n in sizes.values()))
    assert len(sizes) > 100 and padding[0] <= padding[1] + 256


def test_the_end_is_free():
    def final(*pos):
        c = packing.Cuts(11)
        c.extend(np.array(pos, int), np.zeros(len(pos), int))
        return c.path(c.final())

    assert final(7) == [] and packing.best_cuts(np.array([3, 10, 19]), np.zeros(3, int), 11) == [10, 19] and final(3, 10, 19) == [10]
    assert final(3, 10, 21) == [10, 21]  # a full sequence is as good as a free end
    assert final() == []


def test_forgotten_words_change_no_ids(monkeypatch, tokenizer):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(packing, "_MAX_WORDS", 40)
    words = packing.WordIds(packing.tokenizer_path(), 2)
    for _ in range(20):
        texts = [" ".join([*(f"Often{k % 7}." for k in range(20)), *("w" + "".join(rng.choice(list("abcé!'"), 5)) for _ in range(15))]) for _ in range(3)]
        ids, ends, _ = words.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(words) < 150
