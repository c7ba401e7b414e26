"""Random secrets joined to names, in groups, and of several alphabets."""

import random
import string
import uuid

from pyspark.sql import functions as F

from sheafspark.llm import secrets

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.ascii_lowercase + string.digits,
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "-_",
}


def found(spark, texts):
    df = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r.n > 0 for r in df.select("doc_id", F.size("_entropy").alias("n")).orderBy("doc_id").collect()]


def test_random_values(spark):
    rng = random.Random(11)
    for name, letters in ALPHABETS.items():
        for head in ("", "id=", "SAMPLE_DSN=", "2024-01-02-"):
            texts = []
            while len(texts) < 250:
                x = "".join(rng.choices(letters, k=20))
                if any(c.isdigit() for c in x) and any(c.isalpha() for c in x):
                    texts.append(f"see {head}{x} here")
            assert sum(found(spark, texts)) >= 0.98 * len(texts), (name, head)
    texts = [f"{h}{uuid.UUID(int=rng.getrandbits(128))}" for h in ("", "key-", "key=") for _ in range(200)]
    assert sum(found(spark, texts)) >= 0.99 * len(texts)


def test_no_secrets(spark):
    texts = ["top-10-things-to-do-in-the-old-town", "2024-01-02-notes-of-the-meeting", "your_example_key_placeholder_1", "2024-01-02/2024-02-03/2024-03-04", "internationalisation2024", "a" * 30 + "1", "SAMPLE_NAME=some_words_here_2", "1234567890-1234567890-abcdefg"]
    assert found(spark, texts) == [False] * len(texts)


def test_paths_and_words(spark):
    clean = [
        "https://site.com/articles/2024/how-we-built-5-things-fast-and-well", "docs/guides/getting-started/part-2/step-3", "https://news.example.org/2024/11/26/world/the-2nd-longest-bridge",
        "getElementsByClassName2 isAVeryLongMethodNameWithWords1", "static/js/vendor/jquery-3/plugins/v2/index", "Annual-Report-2023-Final-Version-2", "covid19-vaccination-statistics-2021",
    ]
    assert found(spark, clean) == [False] * len(clean)
    assert found(spark, ["QwErTyUiOpAsDfGhJkLzXcVbNm12"]) == [True]


def test_many_matches_and_redaction(spark):
    """Thousands of matches in one text cost little; spans within spans are replaced together."""
    import time

    many = " ".join(f"token=abcdefgh{i:05d}" for i in range(16_000))
    inside = "password=" + "x" * 5 + "AKIA" + "A1" * 8 + ("/AKIA" + "B2" * 8) * 30 + " rest " + "0f" * 20 + " end"
    texts = [many, inside, None, "", "nothing here"]
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, spans_found string")
    began = time.time()
    out = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert time.time() - began < 60
    assert out[0].text == " ".join(["[SECRET]"] * 16_000) and out[0].n_chars == len(out[0].text)
    assert out[1].text == "[SECRET] rest [SECRET] end"
    assert out[2].text is None and out[3].text == "" and out[4].text == "nothing here" and out[4].spans_found == "x"
    got = secrets.scanned(df.select("doc_id", "text")).where("doc_id = 0").select(F.explode("base_found").alias("x")).select("x.start", "x.end").collect()
    assert [tuple(x) for x in got] == [(20 * i, 20 * i + 19) for i in range(16_000)]


def test_counts_match_entropy(spark):
    """high_entropy against a fresh count of every window."""
    import math
    from collections import Counter

    rng = random.Random(4)
    texts = ["".join(rng.choices(rng.choice(list(ALPHABETS.values())), k=rng.randrange(20, 80))) for _ in range(300)] + ["ab" * 40, "a" * 19 + "b" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, c string")
    got = [r.h for r in df.select("i", secrets.high_entropy(F.col("c"), lambda _: F.lit(round(20 * (math.log2(20) - 3.4) * 1e6))).alias("h")).orderBy("i").collect()]
    best = [max(math.log2(20) - sum(n * math.log2(n) for n in Counter(t[i : i + 20]).values()) / 20 for i in range(len(t) - 19)) for t in texts]
    assert got == [b >= 3.4 for b in best] and any(got) and not all(got)
