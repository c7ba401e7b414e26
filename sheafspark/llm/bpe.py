"""Operator 10: BPE encoding and decoding through a minimal acyclic transducer of frequent words.

All words of the corpus are counted; the most frequent LEXICON of them are compiled into an automaton that shares
prefixes and suffixes. Each arc carries how many accepted words sort before it, so a word's path sums to its rank, and
the rank leads to its ids. The automaton is one block of bytes that every worker maps into memory. Words it doesn't
accept are merged exactly, lowest rank first, in time n log n. No rule of such a file looks across white space, so a
text is cut there first, and a stretch's ids and decoded text are kept per worker in a dictionary of bounded size.

The result equals that of the tokenizers library for files of this kind (normalizer NFC, white space, lower case;
split pattern; byte level; word end mark): added tokens in the text are found first, then each stretch between them is
normalized and split. A null text is an empty one and has no tokens. Repeated rows are encoded each by themselves;
an empty table gives an empty result; result columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import stored, table

#: Words in the automaton: a top-k by count over the whole corpus.
LEXICON = 50_000
#: Distinct stretches, and characters, a task counts before it hands its counts on.
COUNTED = 300_000
COUNTED_CHARS = 1 << 26
#: Stretches in a worker's dictionary, and the longest that is kept there.
KEPT = 300_000
KEPT_CHARS = 256
#: Words up to so many bytes are merged by a plain scan, longer ones by a heap.
SCANNED = 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves; the others take the characters from 256 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


class Automaton:
    """A minimal acyclic automaton over bytes whose accepted words are numbered in sorted order.

    Built from sorted words by freezing each finished suffix and looking it up in a register of frozen nodes. The
    block: number of nodes, words and ids; per node the first arc and whether it accepts; per arc its label, target
    and the words before it; per word the first id; the ids.
    """

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> bytes:
        nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        register: dict[tuple, int] = {}

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(nodes)
                nodes.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # the nodes of the last word: accepting, frozen arcs
        last = b""

        def shorten(to: int) -> None:
            while len(path) - 1 > to:
                done = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], done))

        for w in sorted(words):
            same = len(os.path.commonprefix([last, w]))
            shorten(same)
            path.extend([False, []] for _ in range(len(w) - same))
            path[-1][0], last = True, w
        shorten(0)
        root = freeze(path[0])
        reach = np.zeros(len(nodes), np.int64)
        label, target, before, first = [], [], [], []
        for i, (accepts, arcs) in enumerate(nodes):  # children come before their parents
            first.append(len(label))
            n = int(accepts)
            for byte, to in arcs:
                label.append(byte)
                target.append(to)
                before.append(n)
                n += int(reach[to])
            reach[i] = n
        first.append(len(label))
        ids = [words[w] for w in sorted(words)]
        offsets = np.cumsum([0, *map(len, ids)])
        arrays = (np.array(first, "<u4"), np.array([a for a, _ in nodes], "u1"), np.array(label, "u1"), np.array(target, "<u4"), np.array(before, "<u4"), offsets.astype("<u4"), np.array([x for i in ids for x in i], "<u4"))
        head = struct.pack("<8I", root, *(len(a) for a in arrays))
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 4) for a in arrays)

    def __init__(self, block) -> None:
        self.root, *sizes = struct.unpack_from("<8I", block, 0)
        at, found = 32, []
        for n, kind in zip(sizes, ("<u4", "u1", "u1", "<u4", "<u4", "<u4", "<u4")):
            a = np.frombuffer(block, kind, n, at)
            at += a.nbytes + -a.nbytes % 4
            found.append(memoryview(a))
        self.first, self.accepts, self.label, self.target, self.before, self.offsets, self.ids = found

        self.arcs: dict[int, dict[int, tuple[int, int]]] = {}

    def _node(self, node: int) -> dict[int, tuple[int, int]]:
        """A node's arcs, byte -> (target, words before it), read from the block when first walked."""
        lo, hi = self.first[node], self.first[node + 1]
        self.arcs[node] = found = {self.label[i]: (self.target[i], self.before[i]) for i in range(lo, hi)}
        return found

    def lookup(self, word: bytes) -> list[int] | None:
        """The ids of an accepted word; None for others."""
        node, rank, arcs = self.root, 0, self.arcs
        for byte in word:
            arc = (arcs.get(node) or self._node(node)).get(byte)
            if arc is None:
                return None
            node, before = arc
            rank += before
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist() if self.accepts[node] else None


class Vocabulary:
    """Pieces, merge ranks and text rules of a tokenizer file."""

    def __init__(self, text: str) -> None:
        import regex

        spec = json.loads(text)
        model = spec["model"]
        pieces = model["vocab"]
        self.end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.single = [pieces[s] for s in symbols]
        self.final = [pieces[s + self.end] for s in symbols]
        pair = lambda m: m if isinstance(m, list) else m.split(" ", 1)
        # Both sides as single numbers: left * size + right -> rank * size + merged.
        self.size = size = max(pieces.values()) + 1
        self.none = (len(model["merges"]) + 1) * size
        self.merges = {pieces[a] * size + pieces[b]: rank * size + pieces[a + b] for rank, (a, b) in enumerate(map(pair, model["merges"]))}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space is Unicode's property; Python's own class has four control characters more.
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.blank = regex.compile(r"\p{White_Space}+")
        # Without a decoder, decoding joins the pieces as they are written by blanks.
        self.written = [""] * (max([*pieces.values(), *self.added.values()]) + 1)
        for p, i in [*pieces.items(), *self.added.items()]:
            self.written[i] = p

    def normalized(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return lowered(self.blank.sub(" ", text))

    def stretches(self, text: str) -> list[tuple[list[str], int | None]]:
        """The text's words between added tokens, each list with the id of the added token after it."""
        if self.cut is None or "<" not in text:
            return [(self.split.findall(self.normalized(text)), None)]
        parts = self.cut.split(text)
        return [(self.split.findall(self.normalized(p)), self.added[parts[i + 1]] if i + 1 < len(parts) else None) for i, p in enumerate(parts) if i % 2 == 0]

    def merge(self, word: bytes) -> list[int]:
        """The word's pieces: the pair of lowest rank is merged first, the leftmost of equals; only its neighbours change."""
        ids = [self.single[b] for b in word[:-1]] + [self.final[word[-1]]]
        size, none, get = self.size, self.none, self.merges.get
        if len(ids) > SCANNED:
            return self._merged_by_heap(ids)
        pairs = [get(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i, to = pairs.index(best), best % size
            ids[i : i + 2] = [to]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] * size + to, none)
            if i < len(pairs):
                pairs[i] = get(to * size + ids[i + 1], none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """As merge: pairs wait in a heap by (rank, place), pieces are linked to their neighbours; a stale pair is skipped."""
        size, get, n = self.size, self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found, i) for i in range(n - 1) if (found := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if (found := get(ids[i] * size + ids[after[i]])) is not None:
                heapq.heappush(heap, (found, i))

        while heap:
            found, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] * size + ids[j]) != found:
                continue
            ids[i], ids[j], after[i] = found % size, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


def lowered(text: str) -> str:
    """Lower case letter by letter: no rule looks at a letter's neighbours, so a final capital sigma is an ordinary one."""
    if "Σ" not in text:
        return text.lower()
    return "σ".join(x.lower() for x in text.split("Σ"))


#: White space to str.split() that is none to Unicode's property.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


def chunks(text: str, blank) -> list[str]:
    """The stretches of a text between white space; blank: the pattern of white space."""
    if any(c in text for c in _CONTROLS):
        return [x for x in blank.split(text) if x]
    return text.split()


Made = tuple[bytes, bytes]


class _Known(dict):
    """Stretch without white space -> (its ids as packed 32-bit integers, its decoded text and a blank), made when first asked for.

    When it is full it becomes the older half, which is asked before a stretch is made anew, and another is begun.
    """

    def __init__(self, vocabulary: Vocabulary, automaton: Automaton) -> None:
        self.vocabulary, self.automaton, self.older = vocabulary, automaton, {}
        self.odd: dict[str, Made] = {}

    def packed(self, ids: list[int]) -> Made:
        return struct.pack(f"<{len(ids)}I", *ids), "".join([self.vocabulary.written[i] + " " for i in ids]).encode("utf-8", "surrogatepass")

    def word(self, word: str) -> Made:
        """Of a normalized word: from the automaton, or else merged."""
        raw = word.encode("utf-8", "surrogatepass")
        found = self.automaton.lookup(raw)
        return self.packed(self.vocabulary.merge(raw) if found is None else found)

    def piece(self, word: str) -> Made:
        if word.isascii() and word.isalpha():  # a stretch by itself
            return self[word]
        if word not in self.odd:
            if len(self.odd) >= KEPT or len(word) > KEPT_CHARS:
                self.odd.clear()
            self.odd[word] = self.word(word)
        return self.odd[word]

    def made(self, chunk: str) -> Made:
        if chunk.isascii() and chunk.isalpha():
            low = chunk.lower()
            return self.word(chunk) if low == chunk else self[low]
        found = []
        for ws, after in self.vocabulary.stretches(chunk):
            found += map(self.piece, ws)
            if after is not None:
                found.append(self.packed([after]))
        return found[0] if len(found) == 1 else (b"".join([x for x, _ in found]), b"".join([x for _, x in found]))

    def __missing__(self, chunk: str) -> Made:
        made = self.older.get(chunk) or self.made(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[chunk] = made
        return made


class Coder:
    """Encodes and decodes texts."""

    def __init__(self, vocabulary: Vocabulary, automaton: Automaton) -> None:
        self.vocabulary, self.known = vocabulary, _Known(vocabulary, automaton)

    def both(self, text: str) -> tuple[bytes, bytes]:
        """The ids as little-endian unsigned 32-bit integers, and the UTF-8 of what they decode to."""
        found = list(map(self.known.__getitem__, chunks(text, self.vocabulary.blank)))
        return b"".join([x for x, _ in found]), b"".join([x for _, x in found])[:-1]

    def encode(self, text: str) -> bytes:
        return self.both(text)[0]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.vocabulary.written.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapped(block: bytes) -> mmap.mmap:
    """The block in a memory map of its own, without a file."""
    found = mmap.mmap(-1, len(block))
    found[:] = block
    return found


_CODERS: dict[str, Coder] = {}
_VOCABULARIES: dict[str, Vocabulary] = {}


def _vocabulary(text: str) -> Vocabulary:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(text)
    return _VOCABULARIES[key]


def _coder(text: str, block: bytes) -> Coder:
    key = hashlib.sha256(text.encode() + block).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(_vocabulary(text), Automaton(_mapped(block)))
    return _CODERS[key]


def word_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """word, n: how often each normalized word occurs in the whole corpus.

    vocabulary: the tokenizer file's text, a bounded value that tasks get by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, counts, seen = _vocabulary(shared.value), Counter(), 0

        def emit() -> pa.RecordBatch:
            of: dict[str, int] = {}
            for chunk, n in counts.items():
                for ws, _ in rules.stretches(chunk):
                    for w in ws:
                        of[w] = of.get(w, 0) + n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(of.keys(), pa.string()), pa.array(of.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                body = t.as_py() or ""
                counts.update(chunks(body, rules.blank))
                seen += len(body)
                if len(counts) > COUNTED or seen > COUNTED_CHARS:
                    yield emit()
                    seen = 0
        yield emit()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compiled(counts: DataFrame, vocabulary: str, size: int = LEXICON) -> bytes:
    """The automaton of the size most frequent words, built on the driver: size bounds it."""
    # Written first: a collect() would send each task's own top words to the driver.
    top = stored(counts.orderBy(F.desc("n"), "word").limit(size).select("word")).collect()
    rules = _vocabulary(vocabulary)
    raw = [r.word.encode("utf-8", "surrogatepass") for r in top]
    return Automaton.build({w: rules.merge(w) for w in raw if w})


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (packed little-endian 32-bit integers).

    path: the tokenizer file; it is read on the driver.
    """
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        vocabulary = f.read()
    block = compiled(word_counts(docs, vocabulary, text), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, block))
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        at = kept.index(text)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                got, n, sha, back = [], [], [], []
                for t in part.column(at):
                    packed, written = coder.both(t.as_py() or "")
                    n.append(len(packed) // 4)
                    if ids:
                        got.append(packed)
                    sha.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(written).hexdigest())
                columns = [*part.columns, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(got, pa.binary())] if ids else [])], names)

    return docs.select(*kept).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, ids=False).drop("text")
