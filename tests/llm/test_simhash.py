"""Fingerprints and links against brute force."""

from __future__ import annotations

import time
import time
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidemark.llm import queries, simhash
from tidemark.llm.components import connected


def brute_fp(text, width=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    """fps: {doc_id: fingerprint} -> {doc_id: smallest reachable doc_id}."""
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in fps}


def test_position_sets_cover_all_fives():
    assert all(any(set(p) <= set(five) for p in simhash.POSITIONS) for five in combinations(range(8), 5))


def test_query_against_brute_force(spark, sf_dir):
    fps = {r.doc_id: brute_fp(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_components(fps)
    got = queries.op6_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_links_connect_what_pairs_connect(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {0: 0}
    for k in range(400):
        x = int(base[k % 40])
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            x ^= 1 << int(b)
        fps[k + 1] = x
    want = brute_components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in set(fps.values())], "fp long")
    comp = {r.node: r.component for r in connected(simhash.fingerprint_links(df)).collect()}
    groups = {}
    for d, x in fps.items():
        groups.setdefault(comp.get(signed(x), signed(x)), set()).add(want[d])
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want.values()))


@pytest.mark.parametrize("pairwise", [2, 16, 64, 4096])
def test_long_lists_are_cut_by_more_bytes(pairwise):
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 32, 700, dtype=np.uint64) & np.uint64(0xFF00FFFF))
    links = simhash._link(fps, 3, (4, 5, 6, 7), block=64, pairwise=pairwise)
    want = brute_components({k: int(x) for k, x in enumerate(fps)})
    got, at = {k: k for k in range(len(fps))}, {int(x): k for k, x in enumerate(fps)}
    for a, b in links:
        ra, rb = at[a], at[b]
        while got[ra] != ra:
            ra = got[ra]
        while got[rb] != rb:
            rb = got[rb]
        got[max(ra, rb)] = min(ra, rb)

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    assert {k: root(k) for k in got} == want


def test_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (1, "A b"), (2, "a  B"), (7, "other words that are here"), (None, "a b")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got[5] == got[3] == got[9] == ("0" * 16, 3) and got[1] == got[2] == got[None] and got[1][1] == 1
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_a_crowded_list_is_not_compared_in_pairs():
    """Many fingerprints that share five bytes: labels spread over the cube of their bits."""
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 20, 3000, dtype=np.uint64) * np.uint64(2))
    a, b = simhash._cube_labels(fps, 3), simhash._pair_labels(fps, 3, 512)
    assert (a == b).all()
    many = np.unique(rng.integers(0, 1 << 24, 100_000, dtype=np.uint64))
    began = time.perf_counter()
    assert len(simhash._link(many, 3, (3, 4, 5, 6, 7))) >= len(many) - 20
    assert time.perf_counter() - began < 60


def test_the_tally_counts_shared_bytes():
    x = np.array([0, 1, 0x8000000000000000, 0xFF00FF, 0x0101010101010101, 2**64 - 1], np.uint64)
    assert simhash.shared_bytes(x).tolist() == [8, 7, 7, 6, 0, 0]


@pytest.mark.parametrize("n", [1, 7, 40])
def test_components_of_a_chain(spark, n):
    df = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(100, 101), (101, 100), (7000, 7000)], "a long, b long")
    got = {r.node: r.component for r in connected(df).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 100: 100, 101: 100}


def test_near_groups(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    text = lambda n: list(rng.choice(vocab, n))
    rows, want = [], {}
    for g in range(12):
        w = text(int(rng.integers(60, 600)))
        for c in range(4):
            v = list(w)
            for k in rng.choice(len(v), max(1, len(v) // 80) if c else 1, replace=False):
                v[k] = "changed"
            rows.append((g * 10 + c, " ".join(v)))
            want[g * 10 + c] = g * 10
    for k in range(60):
        rows.append((1000 + k, " ".join(text(200))))
        want[1000 + k] = 1000 + k
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two")]
    want |= {2000: 2000, 2001: 2000, 2002: 2002, 2003: 2002}
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def plain_lists(keys, nodes, short):
    pairs, members = set(), set()
    for k in sorted(set(keys)):
        m = sorted({int(n) for kk, n in zip(keys, nodes) if kk == k})
        if len(m) <= short:
            pairs |= {(b, a) for a, b in combinations(m, 2)}
        else:
            pairs |= {(b, m[0]) for b in m[1:]} | set(zip(m[1:], m[:-1]))
            members |= {(int(k), n) for n in m}
    return pairs, members


@pytest.mark.parametrize("step", [1, 2, 3, 5, 100])
def test_lists_may_span_batches(step):
    rng = np.random.default_rng(step)
    keys = np.sort(rng.choice([1, 2, 3, 4, 9, 9, 9], 60))
    nodes = rng.integers(-9, 9, 60)
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    lists, pairs, members = simhash.ListPairs(short=4), [], []
    for a in range(0, 60, step):
        lists.add(keys[a : a + step], nodes[a : a + step])
        if a % 4 == 0:
            got = lists.take().to_pylist()
            pairs += [(r["a"], r["b"]) for r in got if r["key"] is None]
            members += [(r["key"], r["a"]) for r in got if r["key"] is not None]
    lists.end()
    got = lists.take().to_pylist()
    pairs += [(r["a"], r["b"]) for r in got if r["key"] is None]
    members += [(r["key"], r["a"]) for r in got if r["key"] is not None]
    want = plain_lists(keys, nodes, 4)
    assert (set(pairs), set(members)) == want and len(members) == len(set(members)) and want[0] and want[1]


def test_positional_bytes_are_a_lower_bound():
    rng = np.random.default_rng(1)
    for d in (0, 1, 5, 40, 200):
        a = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
        b = np.unique(np.r_[a[d // 2 :], rng.integers(0, 1 << 63, d - d // 2, dtype=np.uint64)])
        assert (simhash.positional_bytes(a) == simhash.positional_bytes(b)).sum() >= 256 - d
    for n in (1, 1024, 1025, 5000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        x = simhash.long_bytes(h)
        assert (x is None) == (n <= 1024) and (x is None or (simhash.folded(np.frombuffer(x, np.uint8), 256) == simhash.positional_bytes(h)).all())
    x = simhash._unpack_set(simhash._pack_set(a))
    assert (x >> np.uint64(16) == a >> np.uint64(16)).all()


def shingle_set(text, width=5):
    w = text.lower().split()
    return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}


def brute_groups(texts, similarity=0.8):
    """{doc_id: text} -> {doc_id: smallest doc_id that similar pairs reach}."""
    sets, parent = {d: shingle_set(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if 1e9 * shared >= 1e9 * similarity * len(sets[a] | sets[b]) - 1:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in texts}


def near(spark, texts):
    return {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_near_groups_of_short_texts(spark):
    """From 1 shingle up: one more word (4 shingles and 5 are similar at 0.8), and an edit at an end."""
    rng = np.random.default_rng(8)
    texts = {}
    for n in range(1, 41):
        for c in range(4):
            w = [f"w{x}" for x in rng.integers(0, 1 << 40, n + 4)]
            for v in (w, [*w, "more"], ["edited", *w[1:]], w[:-1]):
                texts[len(texts)] = " ".join(v)
    want = brute_groups(texts)
    assert len(set(want.values())) < len(want) / 2
    assert near(spark, texts) == want


def test_near_groups_at_the_threshold(spark):
    """Long texts: 400 shingles and 500 are similar at exactly 0.8, 400 and 501 are not."""
    rng = np.random.default_rng(9)
    texts = {}
    for more in (80, 90, 95, 99, 100, 101, 102, 105, 110) * 4:
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 404 + more)]
        texts[len(texts)] = " ".join(w[:404])
        texts[len(texts)] = " ".join(w)
    want = brute_groups(texts)
    assert len(texts) - len(set(want.values())) == 20
    assert near(spark, texts) == want


def test_near_groups_of_families(spark):
    """Copies of one text with different edits, about half of the pairs similar; the smallest ids
    are of copies that are similar to few others, so that lists begin with them."""
    rng = np.random.default_rng(10)
    texts = {}
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]
        for c in range(40):
            w = list(base)
            for k in rng.choice(200, 5 if c < 15 else 3 if c < 30 else 2, replace=False):
                w[k] = f"e{c}"
            texts[len(texts)] = " ".join(w)
    want = brute_groups(texts)
    assert 20 < len(set(want.values())) < 220
    assert near(spark, texts) == want


def test_near_groups_of_long_lists(spark):
    """One common line in many short texts and a crowd of near copies: lists beyond those whose
    pairs are all tallied at once, in which some members are similar to few others."""
    rng = np.random.default_rng(12)
    line = " ".join(f"line{k}" for k in range(12))
    texts = {}
    for _ in range(150):
        texts[len(texts)] = line + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, int(rng.integers(0, 6))))
    for x in (line + " tail", "head " + line, line):
        texts[len(texts)] = x
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 90)]
    for c in range(120):
        w = list(base)
        for k in rng.choice(88, 1 + c % 4, replace=False):
            w[k] = f"e{c}"
        texts[len(texts)] = " ".join(w)
    want = brute_groups(texts)
    assert near(spark, texts) == want


@pytest.mark.parametrize("seed", [13, 15])
def test_near_groups_under_common_headers(spark, seed):
    """Headers of 70 to 95 %, whole or with words left out, before tails that are the documents' own or few
    documents': pairs that share common shingles only, of one common part and of different ones."""
    rng = np.random.default_rng(seed)
    head = [f"h{k}" for k in range(104)]
    texts = {}
    for _ in range(420):
        cut = int(rng.choice([0, 0, 0, 3, 6, 10, 14]))
        own = int(rng.choice([2, 6, 10, 14, 18, 20, 22, 24, 26, 30, 40]))
        tail = [f"t{rng.integers(0, 6)}x{k}" for k in range(own)] if rng.random() < 0.15 else [f"w{x}" for x in rng.integers(0, 1 << 40, own)]
        texts[len(texts)] = " ".join(head[cut:] + tail if rng.random() < 0.8 else tail + head[: len(head) - cut])
    want = brute_groups(texts)
    assert 60 < len(set(want.values())) < 400
    assert near(spark, texts) == want


def test_one_header_of_many_documents_is_one_pass(spark):
    """30,000 documents under a header of 85 %: comparing all pairs of the header's list takes minutes."""
    n, p = 30_000, simhash.NearParams()
    rng = np.random.default_rng(14)
    node, size = np.arange(n), rng.integers(98, 104, n)
    marks = rng.integers(0, 256, (n, 256), dtype=np.uint8)
    for nearest in (True, False):
        began = time.monotonic()
        found = np.concatenate(list(simhash._through_parts(node, node, size, marks, np.full(n, 5), np.full(n, 85), nearest, p)))  # noqa: SLF001
        assert not len(found) and time.monotonic() - began < 10
    size[7] = 85
    found = np.concatenate(list(simhash._through_parts(node, node, size, marks, np.full(n, 5), np.full(n, 85), False, p)))  # noqa: SLF001
    assert {tuple(x) for x in found.tolist()} == {(k, 7) for k in range(n) if k != 7}
