"""Operator 4: secret scans, in DataFrame functions only.

Fixed-form secrets come from patterns; others from candidate strings whose windows have a high Shannon entropy for
their character class: whole runs, and the values in them by their own alphabets. A window slides with the counts of
its characters as state; its entropy, in integer micro-bits, changes by the counts of the character that leaves and the
one that enters. Allow-listed candidates and parts are suppressed; a span is the whole run.

Spans are in code points, end exclusive. A null text is an empty one and has no spans; repeated rows are scanned each
by themselves; an empty table gives an empty result; result columns replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import bound, table


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")" + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = "^(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")" + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN_CHARS = 8
#: A run below the least length can't hide a longer one, so the length is in the pattern itself.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

#: A candidate: a run of such characters with a digit and a letter, at least a window long.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window must reach, by the candidate's class.
LEAST_BITS = {"hex": 3.0, "alphanumeric": 3.7, "base64": 3.9}
#: A word as names and paths have them: lower case, capitalised or capitals, joined words, or a word with a short number.
_NAME = "(?:(?:(?:[A-Z][a-z](?=[A-Z]))?[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)+(?:[0-9]{1,4})?|[A-Za-z]|[vV][0-9]{1,4}|[0-9]{1,4}(?:st|nd|rd|th)|[0-9]{1,8})"
#: Candidates that are no secrets: dates and numbers, repeated or counted characters, words said to be examples, and
#: paths and slugs, whose parts between separators are all names or short numbers.
ALLOWED = r"(?i:example|sample|placeholder|changeme|dummy|your[_-]|xxxx|0{8}|1234567|abcdefg)|^[0-9+/_=-]+$|^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}.*)$|^[/_=-]*" + _NAME + "(?:[/_=-]+" + _NAME + ")*[/_=-]*$"
#: A run's values are judged by themselves too: pieces between =, and their parts between / _ and -.
#: Bits a character that all but 1 in 1,000 strings of 20 random characters of the alphabet exceed (simulated).
PART_BITS = {"hex": 2.70, "base32": 3.14, "base36": 3.22, "base62": 3.48, "base64": 3.48}
#: Parts of a piece that are no secrets and are left out of it: those that name an example, and a date at the start.
ALLOWED_PART = r"(?i)^[0-9]{4}-[0-9]{2}-[0-9]{2}[t_/-]?|(?:^|(?<=[/_-]))[^/_-]*(?:example|sample|placeholder|changeme|dummy|your|xxxx|0{8}|1234567|abcdefg)[^/_-]*(?:[/_-]|$)"
#: Hex digits in groups, such as a UUID; judged without the hyphens.
GROUPED = "(?:[0-9a-f]{4,}(?:-[0-9a-f]{4,})+|[0-9A-F]{4,}(?:-[0-9A-F]{4,})+)"
KINDS = ("assign", "access", "hex", "entropy")
#: Matches whose lengths are summed together.
BLOCK = 64


def _started(lengths: Column) -> Column:
    """Array of (gap, own) lengths: (start, own) of each, in two levels of prefix sums, so that many matches cost little."""
    both = lambda a, x: a + x["gap"] + x["own"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))

    def within(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), both))
        before = bound(sums, lambda s: F.transform(s, lambda x, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), lambda a, y: a + y)))
        inner = lambda x, base: F.transform(x, lambda y, j: F.struct((base + F.aggregate(F.slice(x, F.lit(1), j), F.lit(0), both) + y["gap"]).alias("start"), y["own"].alias("own")))
        return bound(before, lambda bases: F.flatten(F.transform(blocks, lambda x, b: inner(x, F.get(bases, b)))))

    return bound(blocks, within)


def _ends_before(spans: Column) -> Column:
    """The furthest end among the spans before each, 0 for the first; in two levels as in _started."""
    most = lambda x: F.aggregate(x, F.lit(0), lambda a, y: F.greatest(a, y))
    ends = F.transform(spans, lambda x: x["end"])

    def within(ends: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(0), F.floor(F.size(ends) / BLOCK).cast("int")), lambda b: most(F.slice(ends, b * BLOCK + 1, BLOCK)))
        before = bound(tops, lambda t: F.transform(t, lambda x, b: most(F.slice(t, F.lit(1), b))))
        return bound(before, lambda t: F.transform(ends, lambda x, i: F.greatest(F.get(t, F.floor(i / BLOCK).cast("int")), most(F.slice(ends, i - i % BLOCK + 1, i % BLOCK)))))

    return bound(ends, within)


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, end, rank, kind) of the pattern's matches, leftmost first, that keep() accepts."""
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")
    rank = KINDS.index(kind)

    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.transform(found, lambda x, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(x).alias("own")))
        spans = bound(bound(lengths, _started), lambda at: F.transform(at, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["own"]).alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))))
        return spans if keep is None else bound(spans, lambda s: F.array_compact(F.transform(s, lambda x, i: F.when(keep(F.get(found, i)), x))))

    found = lambda: F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.when(text.rlike(pattern), bound(F.struct(found().alias("found"), F.split(text, pattern, -1).alias("gaps")), lambda m: placed(m["found"], m["gaps"]))).otherwise(empty)


def _micro(count: Column) -> Column:
    """count * log2(count) in micro-bits, for counts up to WINDOW: values of a rule, not measured ones."""
    return F.element_at(F.array(*(F.lit(round(c * math.log2(c) * 1e6) if c else 0) for c in range(WINDOW + 1))), (count + 1).cast("int"))


def _least(candidate: Column) -> Column:
    """Most micro-bits of repetition that a window may have: WINDOW * (log2(WINDOW) - least bits)."""
    most = {k: round(WINDOW * (math.log2(WINDOW) - v) * 1e6) for k, v in LEAST_BITS.items()}
    return F.when(candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(most["hex"])).when(candidate.rlike("^[A-Za-z0-9]+$"), F.lit(most["alphanumeric"])).otherwise(F.lit(most["base64"]))


def _part_least(part: Column) -> Column:
    """As _least, by the alphabet of a part. Joined words of one case are no alphabet and need the base64 bits of a run."""
    most = {k: F.lit(round(WINDOW * (math.log2(WINDOW) - v) * 1e6)) for k, v in PART_BITS.items()}
    alphabets = {"hex": "^(?:[0-9a-f]+|[0-9A-F]+)$", "base32": "^(?:[a-z2-7]+|[A-Z2-7]+)$", "base36": "^(?:[a-z0-9]+|[A-Z0-9]+)$", "base62": "^[A-Za-z0-9]+$", "base64": "^(?=.*[a-z])(?=.*[A-Z])"}
    found = [F.when(part.rlike(p), most[k]) for k, p in alphabets.items()]
    return F.coalesce(*found, F.lit(round(WINDOW * (math.log2(WINDOW) - LEAST_BITS["base64"]) * 1e6)))


def _values(run: Column) -> Column:
    """The strings of a run that may be secrets by themselves."""
    pieces = F.transform(F.split(run, "="), lambda x: F.regexp_replace(x, ALLOWED_PART, ""))
    grouped = lambda x: F.transform(F.regexp_extract_all(x, F.lit(GROUPED), 0), lambda g: F.replace(g, F.lit("-"), F.lit("")))
    return F.filter(F.flatten(F.transform(pieces, lambda x: F.concat(F.array(x), F.split(x, "[/_-]"), grouped(x)))), lambda x: F.length(x) >= WINDOW)


def high_entropy(candidate: Column, least: Callable[[Column], Column] = _least) -> Column:
    """Whether some window of the candidate reaches its class's entropy.

    H = log2(W) - sum(c log2 c) / W over the counts c in a window. The state holds the count of each character of the
    candidate's own alphabet in the window, and the sum; a step takes one from the count of the character that leaves,
    adds one to that of the character that enters, and changes the sum by these two counts alone.
    """

    def scan(places: Column, size: Column) -> Column:
        # places: each character as its place in the alphabet; size: how many characters that has.
        counted = F.transform(F.sequence(F.lit(0), size - 1), lambda c: F.size(F.filter(F.slice(places, 1, WINDOW), lambda x: x == c)))
        total = lambda counts: F.aggregate(counts, F.lit(0), lambda s, c: (s + _micro(c)).cast("int"))
        start = bound(counted, lambda n: bound(total(n), lambda s: F.struct(n.alias("counts"), s.alias("sum"), s.alias("best"))))

        def step(state: Column, i: Column) -> Column:
            # The window that begins at i has lost the character at i - 1 and gained the one at i + WINDOW - 1.
            def moved(old: Column, new: Column) -> Column:
                counts = F.transform(state["counts"], lambda c, k: c - F.when(k == old, 1).otherwise(0) + F.when(k == new, 1).otherwise(0))
                n_old, n_new = F.get(state["counts"], old), F.get(state["counts"], new)
                change = F.when(old == new, 0).otherwise(_micro(n_old - 1) - _micro(n_old) + _micro(n_new + 1) - _micro(n_new))
                return bound((state["sum"] + change).cast("int"), lambda s: F.struct(counts.alias("counts"), s.alias("sum"), F.least(state["best"], s).alias("best")))

            return bound(F.struct(F.element_at(places, i - 1).alias("old"), F.element_at(places, i + WINDOW - 1).alias("new")), lambda x: moved(x["old"], x["new"]))

        rest = F.when(F.size(places) > WINDOW, F.sequence(F.lit(2), F.size(places) - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rest, start, step, lambda a: a["best"])

    placed = lambda chars, alphabet: F.struct(F.transform(chars, lambda c: (F.array_position(alphabet, c) - 1).cast("int")).alias("places"), F.size(alphabet).alias("size"))
    best = bound(F.split(candidate, ""), lambda chars: bound(F.array_distinct(chars), lambda alphabet: bound(placed(chars, alphabet), lambda x: scan(x["places"], x["size"]))))
    return best <= least(candidate)


def spans(text: Column) -> dict[str, Column]:
    """For each kind, the array of spans (start, end, rank, kind) in the text."""
    body = F.coalesce(text, F.lit(""))
    long_value = lambda m: F.length(F.regexp_replace(m, ASSIGN_HEAD, "")) >= ASSIGN_CHARS
    likely = lambda m, least: F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(ALLOWED), high_entropy(m, least)).otherwise(F.lit(False))
    secret = lambda run: bound(run, lambda m: likely(m, _least) | F.exists(_values(m), lambda x: likely(x, _part_least)))
    return {"assign": _spans(body, ASSIGN, "assign", long_value), "access": _spans(body, ACCESS, "access"), "hex": _spans(body, HEX, "hex"), "entropy": _spans(body, CANDIDATE, "entropy", secret)}


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the arrays assign, access, hex, entropy of spans, and all of them in order (spans_found)."""
    each = spans(F.col(text))
    df = docs.withColumns({f"_{k}": v for k, v in each.items()})
    by_start = lambda *kinds: F.array_sort(F.transform(F.concat(*(F.col(f"_{k}") for k in kinds)), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return df.withColumns({"base_found": by_start(*KINDS[:3]), "spans_found": by_start(*KINDS)})


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark, overlapping ones together; columns as in docs."""
    own = docs.columns
    df = scanned(docs.select(*own, F.struct(*own).alias("__sheaf_row")), text)
    body = F.coalesce(F.col(text), F.lit(""))
    piece = lambda x, end: F.when(x["start"] >= end, F.concat(F.substring(body, end + 1, x["start"] - end), F.lit(mark))).otherwise(F.lit(""))
    pieces = lambda s: bound(_ends_before(s), lambda ends: F.transform(s, lambda x, i: piece(x, F.get(ends, i))))
    tail = F.substring(body, F.array_max(F.transform("spans_found", lambda x: x["end"])) + 1, F.length(body))
    cleaned = F.when(F.size("spans_found") == 0, F.col(text)).otherwise(F.concat(F.array_join(pieces(F.col("spans_found")), ""), tail))
    df = df.withColumn("_text", cleaned)
    return df.select(*(F.col("_text").alias(c) if c == text else F.when(F.size("spans_found") == 0, F.col(f"__sheaf_row.{c}")).otherwise(F.length("_text")).cast("long").alias(c) if c == "n_chars" else F.col(f"__sheaf_row.{c}").alias(c) for c in own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3])
    return df.select("doc_id", *counts, F.sha2(_joined(F.col("base_found")), 256).alias("base_sha256"), _joined(F.col("spans_found")).alias("spans"))
