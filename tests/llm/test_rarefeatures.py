import hashlib
import math
import random
from collections import Counter

import numpy as np

from trawl.llm import rarefeatures as rf


def slow_features(text: bytes) -> list[bytes]:
    """The windows chosen, one by one as the docstring has it."""
    if len(text) < 64:
        return [text] if text else []
    ranks = []
    for s in range(len(text) - 63):
        total = sum(sum(int(rf._STEP[j]) for j in range(1, c + 1)) for c in Counter(text[s : s + 64]).values())
        h = min(1000, max(0, (rf._FULL - total) * 1000 // rf._FULL))
        ranks.append(rf._NEVER if h < 100 else int(1e6 * math.exp(-(((h - 690) / 60) ** 2) / 2)))
    votes = Counter()
    for i in range(-63, len(ranks)):
        some = [(ranks[j], j) for j in range(max(0, i), min(len(ranks), i + 64))]
        if some and min(some)[0] < rf._NEVER:
            votes[min(some)[1]] += 1
    chosen = [j for j in range(len(ranks)) if votes[j] >= 16]
    if not chosen:
        chosen = sorted(sorted(votes, key=lambda j: (-votes[j], j))[:16]) or [0]
    return list(dict.fromkeys(text[j : j + 64] for j in chosen))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshr dlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))).encode() for _ in range(n)]


def hashes(windows):
    return [int((rf._mixed(np.frombuffer(w.ljust(64, b"\0"), np.uint64).reshape(1, -1)) + np.uint64(len(w) if len(w) < 64 else 0))[0]) for w in windows]


def test_features_are_those_of_the_slow_way_at_any_part_size(monkeypatch):
    some = [*texts(1, 6), b"", b"short", b"x" * 64, b"a" * 500, b"In. " * 200, bytes(range(256)) * 3]
    want = [hashes(slow_features(t)) for t in some]
    for part in (1 << 20, 300):
        monkeypatch.setattr(rf, "PART", part)
        got = [[int(h) for h in x] for x in rf.features(some)]
        for k, t in enumerate(some):
            if part > len(t) or k < 6:
                assert got[k] == want[k], (part, k)


def test_likeness():
    a, b = texts(2, 2)[0] * 3, texts(3, 2)[1] * 3
    a, b, empty = *(x[:4000] for x in (texts(2, 1)[0] + texts(4, 1)[0] + texts(5, 1)[0], texts(3, 1)[0] + texts(6, 1)[0] + texts(7, 1)[0])), b""
    da, db, de, dh = rf.digests([a, b, empty, a[: len(a) // 2] + b[: len(a) - len(a) // 2]])
    assert rf.likeness(da, da) == 1 and rf.likeness(da, db) < 0.1 and 0.3 < rf.likeness(da, dh) < 0.75
    assert rf.likeness(de, de) == 1 and rf.likeness(da, de) == 0
    again = rf.Digest.parse(da.text())
    assert again.text() == da.text() and rf.likeness(again, dh) == rf.likeness(da, dh)


def test_every_row_meets_the_next_one(spark, monkeypatch):
    monkeypatch.setattr(rf, "RANGE", 7)
    rng = random.Random(8)
    rows = [(k * 3 - 20, t.decode()) for k, t in enumerate(texts(9, 40))] + [(None, "last"), (200, None), (201, ""), (202, "日本語" * 30), (202, "a tie")]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, range int").repartition(3)
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in rf.edited_pairs(df).collect()}
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = (text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()
        r = got[doc_id, len(text), hashlib.sha256(edited).hexdigest()]
        d, e, n = rf.digests([text.encode(), edited, after.encode()])
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (d.text(), e.text(), rf.likeness(d, e), rf.likeness(d, n))
    assert rf.edited_pairs(df.limit(0)).count() == 0
    one = rf.edited_pairs(df.where("doc_id = 202 and text = 'a tie'")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert rf.fingerprints(df).count() == len(rows)
