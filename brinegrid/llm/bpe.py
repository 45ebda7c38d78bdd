"""BPE encoding and decoding of a public word-level vocabulary, by a priority queue of merge ranks.

A text is normalised (NFC, runs of white space to a space, lower case) and cut into words by the vocabulary's pattern.
A word's symbols form a doubly linked list; a heap holds the ranks of adjacent pairs, and entries whose symbols have
changed since are skipped. Decoding concatenates vocabulary strings with a space between, as a tokenizer without a
decoder does. Special tokens' strings in a text are those tokens.

Defined cases: null text is empty and has no ids; a symbol outside the vocabulary is dropped, as there is no unknown
token; letters and digits are those of Unicode 16, as in the tokenizers library, whatever the regex module has (NOT_YET_LETTERS);
rows are independent, so ties and repeated rows need no rule; other columns are neither read nor carried; a text of any length is one row; an empty table gives an empty
result. A vocabulary file with other steps than these (flags of special tokens, other splits, a decoder) is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose encoding a Python worker keeps; beyond that it starts a new table.
CACHE_WORDS = 400_000

#: Fixed values of the byte-level alphabet: the printable bytes stand for themselves, the others follow from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


#: Code points that are letters, or digits, only after Unicode 16.
NOT_YET_LETTERS = (
    "\\u0558\\u058B-\\u058C\\u088F\\u0C5C\\u0CDC\\u208F\\u209D-\\u209F\\uA7CE-\\uA7CF\\uA7D2\\uA7D4\\uA7DD\\uA7E2\\uA7F1\\uAB6C-\\uAB6D"
    "\\U000107BB-\\U000107BF\\U00010940-\\U00010959\\U00010EC5-\\U00010EC7\\U00010ED9-\\U00010EEE\\U00011B0A\\U00011DB0-\\U00011DDB"
    "\\U00011DF1\\U00016EA0-\\U00016EB8\\U00016EBB-\\U00016ED3\\U00016FF2-\\U00016FF3\\U000187F8-\\U000187FF\\U00018CD6-\\U00018CDA"
    "\\U00018D09-\\U00018D20\\U00018D80-\\U00018DF2\\U00018E00-\\U00019191\\U000191A0-\\U000191D2\\U0001B123-\\U0001B128\\U0001B168"
    "\\U0001D6A6\\U0001DF1F-\\U0001DF24\\U0001DF2B-\\U0001DF81\\U0001DF90-\\U0001DF96\\U0001DFCD-\\U0001DFFF\\U0001E6C0-\\U0001E6DE"
    "\\U0001E6E0-\\U0001E6E2\\U0001E6E4-\\U0001E6E5\\U0001E6E7-\\U0001E6ED\\U0001E6F0-\\U0001E6F4\\U0001E6FE-\\U0001E6FF"
    "\\U0002B73A-\\U0002B73F\\U0002B81E\\U0002CEA2-\\U0002CEAD\\U000323B0-\\U00033479\\U0003D000-\\U0003FC3F"
)
NOT_YET_NUMBERS = "\\U00011DE0-\\U00011DE9\\U0001246F\\U00012475-\\U0001247F\\U00012550-\\U00012686\\U00016FF4-\\U00016FF6"
#: First and last capital of Unicode 16 and 17 that Python's tables lack, and the first one's small letter.
LATE_CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5)]
LATE_CAPITALS += [(0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
LATE = {chr(c): chr(small + c - first) for first, last, small in LATE_CAPITALS for c in range(first, last + 1)}
LATE_CAPITAL = regex.compile("[" + "".join(LATE) + "]")


#: A heap's entry: the rank of a pair times PLACES, plus the place of its left symbol.
PLACES = 1 << 32
ASTRAL = re.compile("[\U00010000-\U0010FFFF]")


def byte_letters() -> list[str]:
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(PRINTABLE) else chr(next(others)) for b in range(256)]


def plain_pattern(pattern: str, classes: dict[str, str]) -> re.Pattern | None:
    """The pattern with its classes written out as ranges of the first 65,536 code points, for the faster module.

    None if a class stands outside brackets, where ranges cannot.
    """
    if "\\" in re.sub(r"\[[^\]]*\]", "", pattern):
        return None
    every = "".join(map(chr, range(0x10000)))
    for name, known in classes.items():
        runs = [m[0] for m in regex.finditer(f"[{known}]+", every, regex.V1)]
        pattern = pattern.replace(name, "".join([f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in runs]))
    return re.compile(pattern)


class Known(dict):
    """Ids of the words met so far; a new word is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


class Bpe:
    """Encoder and decoder of one vocabulary file (JSON, its contents given as text)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.ids.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = max(self.ids.values()) + 1
        self.ranks = {self.ids[a] * self.base + self.ids[b]: rank * PLACES for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.specials.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        split, *rest = spec["pre_tokenizer"]["pretokenizers"]
        flags = [t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        plain = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and [p["type"] for p in rest] == ["ByteLevel"]
        if any(flags) or not plain or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["unk_token"] or model["byte_fallback"]:
            raise ValueError("the vocabulary file asks for steps that are not built here")
        # the same classes of characters as in the file, less those that its library does not know yet
        classes = {"\\p{L}": f"[\\p{{L}}--[{NOT_YET_LETTERS}]]", "\\p{N}": f"[\\p{{N}}--[{NOT_YET_NUMBERS}]]", "\\s": "\\s"}
        known = split["pattern"]["Regex"]
        self.plain = plain_pattern(known, classes)
        for name, held in classes.items():
            known = known.replace(name, held)
        self.word = regex.compile(known, regex.V1)
        # a byte's symbol inside a word and at its end, or none
        self.inner, self.last = ([self.ids.get(x + end) for x in byte_letters()] for end in ("", self.suffix))
        self.known = Known(self.encode_word)

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost among equals."""
        n, ids, base, rank_of = len(symbols), symbols[:], self.base, self.ranks.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [rank + i for i in range(n - 1) if (rank := rank_of(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), PLACES)
            j = after[i]
            if j < 0 or rank_of(ids[i] * base + ids[j]) != rank * PLACES:
                continue  # stale: one of the two symbols has been merged since
            ids[i], k = self.merged[rank], after[j]
            ids[j], after[j], after[i] = -1, -1, k
            if k >= 0:
                before[k] = i
                if (rank := rank_of(ids[i] * base + ids[k])) is not None:
                    heapq.heappush(heap, rank + i)
            if (h := before[i]) >= 0 and (rank := rank_of(ids[h] * base + ids[i])) is not None:
                heapq.heappush(heap, rank + h)
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        symbols = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        return as_bytes(self.merge([x for x in symbols if x is not None]))

    def words(self, text: str) -> list[str]:
        return self.word.findall(text) if self.plain is None or ASTRAL.search(text) else self.plain.findall(text)

    def encode_plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        # white space parts words and is dropped, whatever its run, so folding its runs changes nothing
        return list(map(self.known.__getitem__, self.words(lowered(text))))

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        at = 0
        for found in self.special.finditer(text):
            out += self.encode_plain(text[at : found.start()])
            out.append(as_bytes([self.specials[found[0]]]))
            at = found.end()
        return b"".join(out + self.encode_plain(text[at:]))

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def as_bytes(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def lowered(text: str) -> str:
    """Lower case letter by letter: a final sigma is not told from others."""
    if text.isascii():
        return text.lower()
    text = LATE_CAPITAL.sub(lambda m: LATE[m[0]], text)
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


_made: dict[str, Bpe] = {}


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) for every whole text; `vocabulary` is the text of a tokenizer's JSON file, of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    name = hashlib.sha256(vocabulary.encode()).hexdigest()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made[name] = Bpe(shared.value)
        bpe = _made[name]
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
                texts = [bpe.decode(np.frombuffer(x, "<u4")) if decoded else None for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
