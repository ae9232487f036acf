"""BPE encoding and decoding with forced-boundary splitting.

A merge only ever makes vocabulary tokens. So if a pair of bytes stands side by side inside no token of the vocabulary, no
merge can span that place in any text: it is a certain cut. Every piece that the pre-tokenizer gives is cut at all
such places, the fragments are encoded independently by merge rank and concatenated. Fragments recur far more often
than texts do, so their encodings are kept in a bounded table.

The vocabulary file is of the public `tokenizers` kind: a byte-level BPE model, here with word ends, NFC, lower case, and
special tokens that are found in the raw text first. Merging follows rank, then position, as that library does.

Letters, numbers and normal forms are those of that library's Unicode tables, which are not Python's: code points that the two see differently, and
all that Python's tables do not know, are found once by asking the library's normalizer and classes. Texts with such a code point are
normalised by the library and cut by its classes.
"""

from __future__ import annotations

import functools
import heapq
import json
import sys
import unicodedata
from itertools import pairwise

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Encodings of fragments and of words that a worker keeps at most; the table starts anew beyond it.
CACHE_ENTRIES = 250_000

#: From so many symbols on, a heap finds the next merge.
HEAP_FROM = 48

#: Characters that the pre-tokenizer's `\s` takes (str.split also takes U+001C to U+001F).
SPACE = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def classes() -> tuple[str, str, str]:
    """Code points to treat with the library's tables, and its letters and numbers, each as the inside of a set of a pattern."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(points)

    def members(pattern: str) -> set[str]:
        """Those that a class of the library's patterns holds."""
        rest = pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text)
        return set(points) - {c for _, (start, end) in rest for c in points[start:end]}

    letters, numbers = members(r"\p{L}"), members(r"\p{N}")
    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    py_letters, py_numbers = (set(regex.findall(rf"\p{{{k}}}", text)) for k in "LN")
    odd = (letters ^ py_letters) | (numbers ^ py_numbers) | {c for c in points if unicodedata.category(c) == "Cn"}
    odd |= {c for c in points if c not in odd and normal.normalize_str(c) != plain_form(c)}
    return ranges(odd), ranges(letters), ranges(numbers)


def ranges(chars: set[str]) -> str:
    """Characters as the inside of a set."""
    found: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in found)


def plain_form(text: str) -> str:
    """NFC and lower case by Python's tables."""
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower() has a form for the end of words; the vocabulary's library has not
        text = text.replace("Σ", "σ")
    return text.lower()


class ForcedBoundaryBPE:
    def __init__(self, spec: str | bytes, tables: tuple[str, str, str] | None = None) -> None:
        """spec: the vocabulary file's JSON; tables: what classes() gave, if it is known."""
        self.tables = tables or classes()
        #: odd[c]: whether a code point needs the library's tables.
        self.odd = np.zeros(sys.maxunicode + 1, bool)
        for low, high in regex.findall(r"\\U(.{8})(?:-\\U(.{8}))?", self.tables[0]):
            self.odd[int(low, 16) : int(high or low, 16) + 1] = True
        spec = json.loads(spec)
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("only byte-level BPE files with NFC, white space, lower case and no decoder are known")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.names = {i: str(i) for i in self.tokens}
        chars = byte_characters()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + self.suffix] for c in chars]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[(a[: len(a) - len(self.suffix)] if a.endswith(self.suffix) and self.suffix else a) + b]) for rank, (a, b) in enumerate(pairs)}
        of = {c: b for b, c in enumerate(chars)}
        inside = set()
        for token in vocab:
            own = [of[c] for c in token.removesuffix(self.suffix)] if token not in (self.suffix,) else []
            inside.update(pairwise(own))
        #: joined[a * 256 + b]: whether some token has byte b right after byte a. Elsewhere is a forced boundary.
        self.joined = bytearray(1 << 16)
        for a, b in inside:
            self.joined[a << 8 | b] = 1
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.odd_piece: regex.Pattern | None = None
        self.words: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[bytes, bool], tuple[int, ...]] = {}

    def cut_points(self, data: bytes) -> list[int]:
        joined = self.joined
        return [i for i, (a, b) in enumerate(pairwise(data), 1) if not joined[a << 8 | b]]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none for null."""
        ids: list[int] = []
        parts = self.special_at.split(text or "") if self.special_at else [text or ""]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.special[part])
                continue
            if not part.isascii() and self.odd[np.frombuffer(part.encode("utf-32-le"), np.uint32)].any():
                ids += self.odd_part(part)
                continue
            words, known = part.lower() if part.isascii() else plain_form(part), self.words
            for word in [words] if _NOT_SPACE.search(words) else words.split():
                got = known.get(word)
                ids += self.word(word) if got is None else got
        return ids

    def odd_part(self, part: str) -> list[int]:
        """With the library's tables throughout."""
        from tokenizers import normalizers

        if self.odd_piece is None:
            letters, numbers = self.tables[1:]
            self.odd_piece = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        return list(self.pieces(self.odd_piece.findall(normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(part))))

    def word(self, word: str) -> tuple[int, ...]:
        out = self.pieces(self.piece.findall(word))
        if len(word) < 64:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[word] = tuple(out)
        return tuple(out)

    def pieces(self, found: list[str]) -> list[int]:
        out: list[int] = []
        for piece in found:
            data = piece.encode()
            ends = [*self.cut_points(data), len(data)]
            start = 0
            for end in ends:
                fragment = data[start:end], end == len(data)
                got = self.fragments.get(fragment)
                if got is None:
                    got = tuple(self.merged(*fragment))
                    if len(data) < 64:
                        if len(self.fragments) >= CACHE_ENTRIES:
                            self.fragments.clear()
                        self.fragments[fragment] = got
                out += got
                start = end
        return out

    def merged(self, data: bytes, ends_word: bool) -> list[int]:
        ids = [self.first[b] for b in data]
        if ends_word:
            ids[-1] = self.last[data[-1]]
        if len(ids) >= HEAP_FROM:
            return self.merged_by_heap(ids)
        none = (1 << 30, 0)
        merges = self.merges.get
        ranks = [merges(p, none) for p in pairwise(ids)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = merges((ids[i], ids[i + 1]), none)
        return ids

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], a, b) for i, (a, b) in enumerate(pairwise(ids)) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by a blank, special tokens included: what the library gives for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_BUILT: dict[int, ForcedBoundaryBPE] = {}


def built(spec: bytes, tables: tuple[str, str, str]) -> ForcedBoundaryBPE:
    """One encoder a worker process, with its table of fragments."""
    key = hash(spec)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ForcedBoundaryBPE(spec, tables)
    return _BUILT[key]


def loader(df: DataFrame, vocabulary: str):
    """What makes the encoder on an executor. The file is read on the driver and broadcast; its size is that of one vocabulary, whatever the data."""
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast((f.read(), classes()))
    return lambda: built(*sent.value)


def bpe_encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and ids array<int> for each row; no ids for null and empty texts. Repeated rows stay; other columns are not read."""
    kind = dict(docs.dtypes)[id_column]
    return map_batches(docs.select(id_column, text_column), lambda c, bpe: {"ids": [bpe.encode(t) for t in c[text_column]]}, f"{id_column} {kind}, ids array<int>", loader(docs, vocabulary))


def bpe_decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """id and decoded string for each row of (id, ids); null ids decode as no ids."""
    kind = dict(encoded.dtypes)[id_column]
    return map_batches(encoded.select(id_column, "ids"), lambda c, bpe: {"decoded": [bpe.decode(x or []) for x in c["ids"]]}, f"{id_column} {kind}, decoded string", loader(encoded, vocabulary))
