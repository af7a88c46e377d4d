import random

import numpy as np
import pytest
import xxhash

from trawl.llm import simhash


def slow_print(text, shingle=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] if len(words) >= shingle else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == label:
            return label
        label = new
    return label


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinÉshr") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    base = [[rng.choice(words) for _ in range(rng.randrange(0, 120))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        out.append(rng.choice([" ", "\n", "\t "]).join(t))
    return out


def test_fingerprints_equal_the_slow_way(monkeypatch):
    for block in (simhash.BLOCK, 10):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for t in [*texts(1, 60), "", None, "a", "A b", "one\x1ctwo three\x0bfour", "É\xa0É x y"]:
            assert simhash.fingerprint(t) == slow_print(t), repr(t)


def test_golay_code_is_perfect_and_words_two_bits_apart_share_an_index():
    _, _, errors = simhash.golay_tables()
    assert len(np.unique(errors)) == 2048
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 4000)
    near = words.copy()
    for _ in range(2):
        near ^= 1 << rng.integers(0, 23, 4000)
    a, b = simhash.codeword_indices(words), simhash.codeword_indices(near)
    assert all(set(x) & set(y) for x, y in zip(a, b, strict=True))
    assert {len(set(x)) for x in a} <= set(range(1, 8))


def test_prints_two_bits_apart_share_a_key():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    near = prints.copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    (ra, ka), (rb, kb) = simhash.keys(prints), simhash.keys(near)
    a, b = [set() for _ in prints], [set() for _ in prints]
    for r, k, s in ((ra, ka, a), (rb, kb, b)):
        for i, x in zip(r, k, strict=True):
            s[i].add(int(x))
    assert all(x & y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("most", [32, 2, 0])
def test_links_find_all_components(spark, most):
    rng = random.Random(most)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            prints.add(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    prints |= {0, (1 << 64) - 1, 1 << 63}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = components(len(prints), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), most).collect()
    at = {s: k for k, s in enumerate(signed)}
    joined = {(at[e.a], at[e.b]) for e in edges}
    got = components(len(prints), lambda i, j: (i, j) in joined or (j, i) in joined)
    assert got == want


def test_query_shape_with_nulls_repeats_and_odd_texts(spark):
    rows = list(enumerate(texts(5, 90))) + [(200, None), (201, ""), (202, "\n"), (7, "extra row of the same id"), (None, "x y z"), (203, "x y z"), (204, "word " * 50_000)]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, fp int, component_id string").repartition(3)
    prints = [slow_print(t) for _, t in rows]
    label = components(len(rows), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    least = {g: min(rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None) for g in set(label)}
    want = sorted((str(rows[i][0]), f"{prints[i]:016x}", least[label[i]]) for i in range(len(rows)))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
