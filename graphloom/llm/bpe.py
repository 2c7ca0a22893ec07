"""Byte-pair encoding and decoding with a given vocabulary, in time linear in the text.

Encoding a word runs an Aho-Corasick automaton over it for the longest token at each
place, then walks left to right: a token may follow another only if byte-pair merging
would leave a seam between them, which undoing the two tokens' merges decides (each
answer goes into the pair table).  When nothing fits, the walk steps back and takes the
next shorter token; a place that failed is never tried twice.  The ids equal those of
merging by rank.  Decoding cuts tokens out of one byte string by an offset table.

Texts are split, lower-cased and composed as the vocabulary file's own settings say:
canonical composition, lower case, then contractions, runs of letters, single digits
and runs of other characters.  The file's added tokens are found in the raw text first.

Defined results.  Null and empty texts, and texts of white space alone, give no ids and decode to the empty
string.  Long texts are encoded whole.  Rows are independent, so repeated rows give equal results.  An empty table
gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
#: Bytes that each of a worker's two generations of remembered words takes at most (a full one replaces the older), and the longest word kept.
REMEMBERED, LONGEST = 96 << 20, 64
#: Pairs of tokens whose seam is remembered.
SEAMS = 200_000

# Where the library's Unicode tables differ from those of Python, by code point.
#: Taken for letters or numbers by the pattern module, which is newer, but not by the library.
_NEITHER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CF, 0xA7CF), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Marks that the library's older composition takes for plain characters, and one that it doesn't compose.
_UNCOMPOSED = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
#: Lower case that Python does not know yet: first and last code point, and the first's lower case.
_LOWERED = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]


def _set(ranges: list[tuple[int, ...]]) -> str:
    return "".join(f"\\U{r[0]:08x}-\\U{r[1]:08x}" for r in ranges)


_UNCOMPOSED_AT = re.compile(f"([{_set(_UNCOMPOSED)}])")
_LOWERED_AT = re.compile(f"[{_set(_LOWERED)}]")
_LOWER_OF = {c: to + c - a for a, b, to in _LOWERED for c in range(a, b + 1)}
#: Fixed values of the vocabulary format: how a normalised text splits into words.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_set(_NEITHER)}]]+|[\p{{N}}--[{_set(_NEITHER)}]]|[[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{{L}}\p{{N}}]||[{_set(_NEITHER)}]]+", regex.V1)
#: The same for texts whose letters are all below U+0180 and whose digits are ASCII.
_PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-ſ]*\Z")
_SPLIT_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-ſ]+|[0-9]|[^\t-\r a-z0-9\xc0-\xd6\xd8-\xf6\xf8-ſ]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the tables that encoding and decoding read."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.added.values()]) + 1
        letters = byte_letters()
        # One character a symbol: a byte within a word, or a byte that ends it.
        symbol = {x: chr(i) for i, x in enumerate(letters)} | {x + END: chr(256 + i) for i, x in enumerate(letters)}
        self.left, self.right = [-1] * size, [-1] * size
        self.rank = [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        spelled: dict[str, str] = {t: s for t, s in symbol.items() if t in ids}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = a + b
            spelled[whole] = spelled[a] + spelled[b]
            t = ids[whole]
            self.left[t], self.right[t], self.rank[t] = ids[a], ids[b], n
            self.merged[ids[a], ids[b]] = n
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        by_symbols = {}
        for token, s in spelled.items():
            self.length[ids[token]] = len(s)
            by_symbols[s] = ids[token]
            self.automaton.add_word(s, ids[token])
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for s, t in by_symbols.items():
            self.shorter[t] = next((by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_symbols), -1)
        # Words that are one token: a token is reached by its own merges.
        self.whole = {(s[:-1] + chr(ord(s[-1]) - 256)).encode("latin-1"): t for s, t in by_symbols.items() if ord(s[-1]) >= 256}
        self.seams: dict[tuple[int, int], bool] = {}
        names = [b""] * size
        for token, t in [*ids.items(), *self.added.items()]:
            names[t] = token.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.bytes = b"".join(names)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def seam(self, a: int, b: int) -> bool:
        """Whether merging leaves a seam between tokens a and b when they stand side by side; the answer is remembered."""
        x, y, before = a, b, len(self.merged)
        while True:
            # A merge over the seam comes first if its rank is below that of the merge just undone; of equal ranks the left one does.
            if self.merged.get((x, y), before) < before:
                out = False
                break
            if self.rank[x] > self.rank[y]:
                before, x = self.rank[x], self.right[x]
            elif self.rank[y] >= 0:
                before, y = self.rank[y] + 1, self.left[y]
            else:
                out = True
                break
        if len(self.seams) > SEAMS:
            self.seams.clear()
        self.seams[a, b] = out
        return out

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        if (whole := self.whole.get(word)) is not None:
            return [whole]
        symbols = word[:-1].decode("latin-1") + chr(256 + word[-1])
        longest = [-1] * (n + 1)
        length, shorter, seams = self.length, self.shorter, self.seams
        # Matches come by their end, so the last one to start at a place is the longest there.
        for end, t in self.automaton.iter(symbols):
            longest[end - length[t] + 1] = t
        failed: set[int] = set()
        out: list[int] = []
        at, t = 0, longest[0]
        while at < n:
            if out:
                last = out[-1]
                while t >= 0:
                    if at + length[t] not in failed:
                        fits = seams.get((last, t))
                        if fits is None:
                            fits = self.seam(last, t)
                        if fits:
                            break
                    t = shorter[t]
            else:
                while t >= 0 and length[t] in failed:
                    t = shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                t = longest[at]
            else:
                failed.add(at)
                t = out.pop()
                at -= length[t]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b" ".join(self.bytes[self.offsets[t] : self.offsets[t + 1]] for t in ids)


def split(text: str) -> list[str]:
    """The words of a text without added tokens."""
    if not text.isascii():
        if _UNCOMPOSED_AT.search(text):
            text = "".join([x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(_UNCOMPOSED_AT.split(text))])
        else:
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")
        if _LOWERED_AT.search(text):
            text = text.translate(_LOWER_OF)
    text = text.lower()
    return (_SPLIT_PLAIN if text.isascii() or _PLAIN.match(text) else _SPLIT).findall(text)


class Coder(dict):
    """Remembers for each short word its ids and its decoded tokens, both as text.

    Words in use move on to the new generation, so frequent ones are never forgotten.  Memory is counted in bytes.
    """

    #: What an entry takes besides its letters, about.
    ENTRY = 400

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, tuple[str, str]] = {}
        self.room = self.remembered = remembered

    def entry(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.vocabulary.decode(ids).decode()

    def __missing__(self, word: str) -> tuple[str, str]:
        out = self.older.get(word)
        if out is None:
            out = self.entry(self.vocabulary.encode_word(word.encode("utf-8", "surrogatepass")))
        if len(word) <= LONGEST:
            if self.room <= 0:
                self.older = dict(self)
                self.clear()
                self.room = self.remembered
            self.room -= self.ENTRY + 3 * len(word)
            self[word] = out
        return out

    def words(self, text: str) -> list[tuple[str, str]]:
        v = self.vocabulary
        if v.cut is None or "<" not in text:
            return list(map(self.__getitem__, split(text)))
        out = []
        for part in v.cut.split(text):
            if (t := v.added.get(part)) is not None:
                out.append(self.entry([t]))
            elif part:
                out += [self[w] for w in split(part)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(t) for ids, _ in self.words(text or "") for t in ids.split(" ")]


class BinaryCoder(Coder):
    """Remembers for each word its ids as little-endian 32-bit integers."""

    ENTRY = 220

    def entry(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def array(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.words(text or "")), dtype="<i4")


_CODERS: dict[tuple[type, int, str], Coder] = {}


def coder(vocabulary: str, kind: type = Coder, remembered: int = REMEMBERED) -> Coder:
    """The worker's coder for a vocabulary file's contents; words stay known from one task to the next."""
    key = kind, remembered, hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = kind(Vocabulary(vocabulary), remembered)
    return _CODERS[key]


def read_vocabulary(path: str | None = None) -> str:
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids array<int>``."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array([c.encode(x) for x in batch.column("text").to_pylist()], pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id, ids``."""
    sent = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = coder(sent.value).vocabulary
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([v.decode(x or ()).decode() for x in batch.column("ids").to_pylist()], pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``.  Workers remember words within ``remembered`` bytes, twice; where other stages share them, fewer are better."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent.value, Coder, remembered)
        for batch in batches:
            count, ids, decoded = [], [], []
            for text in batch.column("text"):
                words = c.words(text.as_py() or "")
                line = " ".join([w[0] for w in words])
                count.append(line.count(" ") + 1 if line else 0)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([w[1] for w in words]).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
