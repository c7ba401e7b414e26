"""Order MinHash against a plain version of itself, and the succession of documents where one doc_id holds most rows."""

import hashlib

import numpy as np

from sheafspark.llm import order_minhash as M

TOP = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & TOP
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & TOP
    return x ^ (x >> 31)


def plain(text):
    """Entry by entry: number each sequence, take the least of them by one hash, keep their text order, hash the tuple."""
    base = int(M._BASE)
    codes = [ord(c) for c in text]
    if 0 < len(codes) < M.GRAM:
        codes += [0] * (M.GRAM - len(codes))
    seen, hashes, named = {}, [], []
    for i in range(len(codes) - M.GRAM + 1 if codes else 0):
        h = 0
        for c in codes[i : i + M.GRAM]:
            h = (h * base + c + 1) & TOP
        h = mixed(h)
        n = seen[h] = seen.get(h, -1) + 1
        hashes.append(h)
        named.append(h if n == 0 else mixed((h + n * base) & TOP))
    out = []
    for odd in M._ODD.tolist():
        value = [((x >> 32) * odd) & 0xFFFFFFFF for x in named]
        least = sorted(range(len(named)), key=lambda i: (value[i], i))[: M.TUPLE]
        entry = 0
        for x in [0] * (M.TUPLE - len(least)) + [hashes[i] for i in sorted(least)]:
            entry = (entry * base + x) & TOP
        out.append(mixed(entry) >> 32)
    return out


def test_plain_version():
    for text in ["", "a", "abcdef", "abc" * 40, "the cat sat on the mat " * 7 + "é漢😀", "x" * 9000 + "yz"]:
        assert M.fingerprint(text).tolist() == plain(text)


def test_equal_hashes_stand_together():
    few = np.array([5, 3, 5, 5 + (1 << 20), 5, 3, 5 + (1 << 20)], np.uint64)  # alike in their upper bits
    assert M._grouped(few).tolist() == [1, 5, 0, 2, 4, 3, 6]
    many = np.random.default_rng(1).integers(0, 50, 500, dtype=np.uint64) << np.uint64(30)
    assert M._grouped(many).tolist() == np.argsort(many, kind="stable").tolist()


def test_half_equal_texts_are_near():
    rng = np.random.default_rng(2)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    near = []
    for _ in range(200):
        own = text(600)
        near.append(M.likeness(M.fingerprint(own), M.fingerprint(own[:300] + text(300))))
    assert min(near) > 0 and M.likeness(M.fingerprint(text(600)), M.fingerprint(text(600))) == 0


def test_one_id_holds_most(spark):
    data = [(None if i % 3 else 7, f"{chr(97 + i % 26)}{i} " * (i % 5)) for i in range(400)] + [(i, f"text {i}") for i in range(60)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    found = M.successive(docs, "text", M._compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    ordered = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(ordered):
        own, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(own) // 2
        want.append((d, len(own), hashlib.sha256((own[: len(own) - n] + after[:n]).encode()).hexdigest()))
    key = lambda r: (r[0] is None, *(x or 0 for x in r[:2]), r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found.collect()), key=key) == sorted(want, key=key)
    assert found.rdd.getNumPartitions() > 1
