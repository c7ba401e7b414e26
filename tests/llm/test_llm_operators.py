"""The training-data operators against brute-force versions, on a sample of documents with awkward rows."""

import hashlib
import math
import re
import struct
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from conftest import SF
from pyspark.sql import functions as F

from sheafspark.llm import bpe, chat, mixing, order_minhash, quality_model, quality_rules, secrets, simhash, substrings, warc
from sheafspark.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, component_id string"
GAP = " \t\n\x0b\x0c\r"


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def data(spark):
    con = duckdb.connect()
    rows = con.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    base = max((r[1] for r in rows[:50]), key=len)
    odd = [None, "", " \n\t ", "one", "a b", base, base, base + " tail", base.replace(" ", "\n", 3), long, long + " x", "x\x1cy z q \U0001f600 　 a\x0bb", "AKIA" + "Q7" * 9 + ' api_key: "zz' + "9k" * 6 + '" password=short token=secret:abcdefgh12 ' + "0f" * 20, "All rights reserved.\n" * 3, "tok " * 40]
    rows += [(1000 + i, t, "en", None if i % 4 == 0 else "odd") for i, t in enumerate(odd)]
    rows += [(None, base, None, None), (None, None, "en", "odd"), (1003, "one", "en", "odd")]
    return [(*r, len(r[1] or ""), "clash", 7, "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, data, none):
    got = Counter(quality_rules.measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None))
    want = Counter()
    for doc_id, text, *_ in data:
        ws, t = tokens(text), text or ""
        seen = defaultdict(list)
        for i in range(len(ws) - 7):
            seen[tuple(ws[i : i + 8])].append(i)
        cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
        full = [x for x in t.split("\n") if tokens(x)]
        failed = len(ws) < 20 or 100 * len(cover) > 30 * len(ws)
        want[(doc_id, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(cover), failed)] += 1
    assert got == want
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()
    assert quality_rules.clean(none).count() == quality_rules.measured(none).count() == 0


def test_clean_documents_stay(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id")
    judged = quality_rules.measured(good).where("not base_failed")
    assert judged.where("not kept").count() == 0


def test_line_rules(spark):
    lines = ["A plain sentence stands here.", "Home | News | About | Contact", "BUY!! NOW!! HERE!! CHEAP!!", "read more", "Licensed under the MIT License.", ""]
    got = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", quality_rules.line_verdict(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == [None, "navigation", "punctuation", "punctuation", "boilerplate", None]


def base_spans(text):
    key = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def entropy_spans(text):
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        c = m[0]
        if not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)) or re.search(secrets.ALLOWED, c):
            continue
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", c) else "alphanumeric" if re.fullmatch("[A-Za-z0-9]+", c) else "base64"
        best = max(math.log2(20) - sum(n * math.log2(n) for n in Counter(c[i : i + 20]).values()) / 20 for i in range(len(c) - 19))
        if best >= secrets.LEAST_BITS[kind] - 1e-6:
            yield (m.start(), 3, m.end(), "entropy")


def test_secrets(docs, data, none):
    joined = lambda found: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    df = secrets.scanned(docs)
    got = Counter((r.doc_id, r.b, r.s) for r in df.select("doc_id", secrets._joined(F.col("base_found")).alias("b"), secrets._joined(F.col("spans_found")).alias("s")).collect())
    want = Counter((d, joined(base_spans(t or "")), joined([*base_spans(t or ""), *entropy_spans(t or "")])) for d, t, *_ in data)
    assert got == want
    assert any(s for _, _, s in want)
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert secrets.scanned(clean).where(F.size("base_found") > 0).count() == 0
    assert secrets.redacted(none).count() == 0


def test_mixing(spark, docs, data, none):
    got = mixing.mix(mixing.sized(docs)).collect()
    assert len(got) == len(data)
    size = Counter()
    for _, text, _, source, *_ in data:
        size[source] += len(tokens(text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in names:
        target[s] = 3 * size[s] if s in capped else level * weight[s]
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source]) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert sum(taken.values()) == sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 2 + target[s] / 1024 for s in names)
    assert sorted(map(str, mixing.mix(mixing.sized(docs)).collect())) == sorted(map(str, got))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = mixed.select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r.source: r.n for r in words} == {s: n for s, n in taken.items() if n}
    assert mixing.mix(mixing.sized(none)).count() == 0 and mixing.mixed(none).count() == 0


def fingerprint(text):
    ws = [w.encode() for w in tokens(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] * bool(ws)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(fps):
    """The least id that links of 3 bits or fewer lead to, for (id, fingerprint) pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, f, least[find(i)]) for i, (d, f) in enumerate(fps)]


def test_simhash(spark, docs, data, none):
    want = Counter(linked([(d, fingerprint(t)) for d, t, *_ in data]))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.clustered(simhash.fingerprints(docs)).collect())
    assert got == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in want if c is not None})
    assert simhash.clustered(simhash.fingerprints(none)).count() == 0 and simhash.deduplicated(none).count() == 0


def test_simhash_large_groups(spark, monkeypatch):
    """Dense balls and chains of fingerprints, with groups far beyond the bound, which are split and lose no link."""
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(3):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(120):
            fps.add(x ^ sum(1 << int(b) for b in rng.integers(0, 24, 4)))
        for _ in range(40):
            x ^= sum(1 << int(b) for b in rng.integers(0, 64, 3))
            fps.add(x)
    pairs = list(enumerate(sorted(fps)))
    monkeypatch.setattr(simhash, "GROUP", 16)
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in pairs], "doc_id long, fp long")
    assert Counter((r.doc_id, r.component_id) for r in simhash.clustered(df).collect()) == Counter((d, c) for d, _, c in linked(pairs))


def test_near_pairs():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 20, 600, dtype=np.uint64))
    group = (np.arange(len(fps)) % 3).astype(np.int64)
    sorted_fps, a, b = simhash.near_pairs(fps, group)
    got = {frozenset((int(sorted_fps[i]), int(sorted_fps[j]))) for i, j in zip(a, b)}
    want = {frozenset((int(fps[i]), int(fps[j]))) for i in range(len(fps)) for j in range(i) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert got == want and len(a) == len(want)


def test_substrings(docs, data, none, monkeypatch):
    first = {}
    ordered = sorted(((d if d is not None else 1 << 63, t) for d, t, *_ in data), key=lambda x: x[0])
    cuts = {}
    for d, t in ordered:
        ws = tokens(t)
        for i in range(len(ws) - 49):
            first.setdefault(tuple(ws[i : i + 50]), d)
    want = Counter()
    for d, t in ordered:
        ws = tokens(t)
        cut = {i + k for i in range(len(ws) - 49) if first[tuple(ws[i : i + 50])] < d for k in range(50)}
        left = " ".join(w for i, w in enumerate(ws) if i not in cut)
        want[(d if d < 1 << 63 else None, len(ws), len(cut), hashlib.sha256(left.encode()).hexdigest())] += 1
    read = lambda df: Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())
    assert read(substrings.removed(docs)) == want
    monkeypatch.setattr(substrings, "GROUP", 1)  # all groups at full prefix length
    assert read(substrings.removed(docs, texts=False)) == want
    assert substrings.removed(none).count() == 0
    assert sum(n for (_, _, n, _), _ in want.items()) > 0


def test_substrings_of_one_id(spark):
    """Rows of one doc_id with the same words and other white space: each loses the passage of the smaller doc_id."""
    words = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, "a " + " ".join(words) + " z"), (2, "a  " + "  ".join(words) + "  z"), (2, "other")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 60, 0), (2, 62, 60), (2, 62, 60), (2, 1, 0)])


def test_deduplicated_by_row(spark):
    """Rows of one doc_id with unlike texts are rows of their own; null ids give way to others."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    df = spark.createDataFrame([(1, a), (3, a), (3, b), (None, b), (None, "only"), (None, "only")], "doc_id long, text string")
    from sheafspark.llm import near

    for kept in (simhash.deduplicated(df), near.deduplicated(df)):
        assert Counter(map(tuple, kept.collect())) == Counter([(1, a), (3, b), (None, "only")])


def test_warc(spark):
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>" + "a" * 200, None, "", "<p>" + "a" * 200, "short", "short", "é" * 60, "<p>" + "a" * 200, "b" * 300_000])]
    pages += [(None, None, "<p>" + "a" * 200), (0, "http://x/0", "<p>" + "a" * 200)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    folder = scratch(spark) + "/bundles"
    index = warc.written(warc.planned(df), folder)
    got = Counter((r.page_id, r.url, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index, folder).collect())
    want = Counter()
    for page, url, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if h == html and p is not None]
        first = min(same) if len(raw) >= 100 else page
        revisit = page != first
        want[(page, url, None if revisit else raw, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == want
    row = index.where("page_id = 8").first()
    with open(f"{folder.removeprefix('file://')}/{row.bundle}", "rb") as f:
        whole = f.read()
    plain = b"".join(x for x in zstandard.ZstdDecompressor().read_to_iter(whole, skip_bytes=0)) if False else zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
    assert b"WARC/1.1\r\nWARC-Type: warcinfo" in plain and b"b" * 300_000 in plain
    assert struct.unpack("<I", whole[-4:])[0] == warc.SEEKABLE
    assert warc.read(warc.written(warc.planned(df.where("false")), folder), folder).count() == 0


def test_quality_model(spark, docs, none):
    everything, labels = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    rows = quality_model.measured(everything)
    model = quality_model.fitted(rows, labels)
    out = quality_model.scored(rows, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.95
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality_model.fitted(rows, flipped).weights, model.weights)
    scored = quality_model.scored(quality_model.measured(docs), model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality_model.scored(quality_model.measured(none), quality_model.fitted(quality_model.measured(none), labels)).count() == 0
    assert {r.score for r in quality_model.scored(rows, quality_model.fitted(rows, labels.where("false"))).collect()} == {0.5}
    raw, value = quality_model.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert value.tolist() == [0, 0.5, 0.5, 1]


def test_order_minhash(docs, data, none):
    got = Counter(order_minhash.successive(docs, "text", order_minhash._compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None))
    ordered = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    hexed = lambda x: x.astype(">u4").tobytes().hex()
    want = Counter()
    for i, (d, t, *_) in enumerate(ordered):
        own, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(own) // 2
        edited = own[: len(own) - n] + after[:n]
        a, b, c = (order_minhash.fingerprint(x) for x in (own, edited, after))
        want[(d, len(own), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), order_minhash.likeness(a, b), order_minhash.likeness(a, c))] += 1
    assert got == want
    one = order_minhash.fingerprint
    assert order_minhash.likeness(one("abc" * 50), one("abc" * 50)) == 1
    text = data[3][1]
    small, large = (order_minhash.likeness(one(text), one(text[:k] + "#" * (len(text) - k))) for k in (len(text) * 19 // 20, len(text) // 3))
    assert small > large
    assert order_minhash.successive(none, "text", order_minhash._compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").count() == 0


def cheapest(roles):
    """Least cost of a legal conversation, by search over all choices."""
    best = {chat.START: 0}
    for r in roles:
        now = {}
        for s, c in best.items():
            for t in (chat.SYSTEM, chat.USER, chat.ASSISTANT):
                label = 0 if r == t else chat.RELABEL
                ways = [label] * ((s, t) in chat.LEGAL) + [chat.MERGE + label] * (s == t) + [chat.INSERT + label for x in range(1, 4) if (s, x) in chat.LEGAL and (x, t) in chat.LEGAL]
                for w in ways:
                    now[t] = min(now.get(t, 1 << 30), c + w)
        best = now
    return min(c + chat.INSERT * len(chat.CLOSING[s]) for s, c in best.items())


def test_chat(spark):
    rng = np.random.default_rng(3)
    names = ["system", "user", "assistant", "Human", "tool", None]
    rows = [(c, t, names[rng.integers(0, 6)], None if rng.random() < 0.1 else f"m{t}", "x") for c in range(30) for t in range(int(rng.integers(1, 12)))]
    rows += [(99, t, names[rng.integers(0, 6)], f"m{t}", "x") for t in range(300)] + [(None, 0, "user", "hi", "x"), (None, None, "assistant", "yo", "x"), (5, 0, "user", "again", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string").repartition(3)
    got = defaultdict(list)
    for r in chat.repaired(df).collect():
        got[r.conv_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for conv, turns in got.items():
        turns.sort(key=lambda r: (r.turn is None, (r.turn or 0) // chat.CHUNK, r.place))
        text = "".join(r.piece for r in turns)
        shape = "".join(m[0].upper() for m in re.findall(r"<\|(system|user|assistant)\|>", text))
        assert re.fullmatch("S?(UA)+", shape), (conv, shape)
        code = lambda role: chat.ALIASES.get((role or "").lower(), 0)
        cost = sum(chat.RELABEL * (code(r.role) != chat.NAMES.index(r.new_role)) + chat.MERGE * (r.action == "merge") + chat.INSERT * len([x for x in r.inserted.split(",") if x]) for r in turns)
        assert cost == cheapest([code(r.role) for r in turns])
    assert chat.repaired(df.where("false")).count() == 0


def test_bpe(docs, data, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for d, t, *_ in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want[(d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), raw)] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in bpe.encoded(docs).collect())
    assert got == want
    assert Counter(tuple(r) for r in bpe.encoded(docs, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == Counter(x[:4] for x in want.elements())
    assert bpe.encoded(none).count() == 0


def test_bpe_text_rules():
    from tokenizers import Tokenizer

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        rules = bpe.Vocabulary(f.read())
    words = ["hello", "help", "held", "world", "a", "ab"]
    coder = bpe.Coder(rules, bpe.Automaton(bpe.Automaton.build({w.encode(): rules.merge(w.encode()) for w in words})))
    assert coder.known.automaton.lookup(b"hel") is None and coder.known.automaton.lookup(b"held") == rules.merge(b"held")
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for t in ["Hello  World's 12 éa <|endoftext|>Ab ΑΣ İ don't !!! x_y", "", "  ", "a​b \x85 q z \x1c y ǅ K ß ﬁ", "AB<|endoftext|><|startoftext|>c", "'S 'LL I'Ve", "🙂🙂 ñÑ", "a\x00b", "é", "<|endoftext", "한국어 中文 العربية"]:
        ids = library.encode(t, add_special_tokens=False).ids
        raw = coder.encode(t)
        assert raw == struct.pack(f"<{len(ids)}I", *ids), t
        assert coder.decode(raw) == library.decode(ids, skip_special_tokens=False)
        assert coder.both(t)[1].decode() == coder.decode(raw)
    long = "".join(np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    short = long[:3000]
    assert rules.merge(short.encode()) == library.encode(short, add_special_tokens=False).ids
    began = time.time()
    assert len(rules.merge(long.encode())) > 50_000 and time.time() - began < 20
    for t in ("aaaa" * 40, "ab" * 100, "the" * 60):
        assert rules.merge(t.encode()) == library.encode(t, add_special_tokens=False).ids


def test_oracles(spark, duck):
    """Queries whose results SQL states."""
    from conftest import rows

    from sheafspark.llm import queries

    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cur = duck.execute(sql)
        assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall()), name


def test_pipeline(spark, docs):
    import corpus_pipeline

    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF).cache()
        assert df.count() > 0
        if name != "bpe":
            assert df.columns == columns, name
