"""Oversized documents cut at natural boundaries by lexical cohesion.

A document with more than ``limit`` tokens is cut into consecutive pieces of at most ``limit`` tokens; each piece begins
``overlap`` tokens before the end of the one before. The cut of a piece is searched in its size window, the last half of the
room it has. Natural boundaries there (ends of paragraphs, lines and sentences outside words) are scored by the dip in the
similarity of the words before and after them: the cosine of word counts in sliding blocks of ``block`` words, and its depth
below the nearest peaks on both sides. The deepest valley wins; ties go to the stronger kind of boundary, then to the later
one. Where the window holds no natural boundary, the whole room is searched, then ends of words, and only then does the
piece end after its last token.

Defined results: null and empty texts and documents within the limit give no piece; rows are handled one by one, so repeated
documents give repeated pieces; texts of any length are tokenized whole; other columns are ignored. An overlap never begins
inside a character: where a token does, the overlap grows by the one to three tokens that complete it.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP, BLOCK = 1024, 64, 40
_ENCODERS: dict[str, object] = {}
_BOUNDARY = re.compile(r"\n[ \t]*\n\s*|\n+|[.!?…。！？][\"'”’»)\]]*[ \t]+")
_WORD_GAP = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None):
    """The byte-level BPE of a rank file, made once in each worker."""
    path = path or vocabulary_path()
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_ends(enc, text: str) -> np.ndarray:
    """For each token, the number of UTF-8 bytes up to its end."""
    ids = enc.encode_ordinary(text)
    if not ids:
        return np.zeros(0, dtype=np.int64)
    return np.cumsum([len(x) for x in enc.decode_tokens_bytes(ids)])


class _Text:
    """A text with its tokens, characters and words on one scale."""

    def __init__(self, text: str, ends: np.ndarray):
        self.text, self.ends = text, ends
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        self.char_at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte where each character starts
        self.n_bytes = len(raw)
        starts = np.concatenate([[0], ends[:-1]])
        self.whole = np.isin(starts, self.char_at)  # tokens that begin a character
        spans = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
        self.word_at = np.array([s for s, _ in spans], dtype=np.int64)
        names: dict[str, int] = {}
        self.words = [names.setdefault(w, len(names)) for _, w in spans]
        cuts: dict[int, int] = {}
        for m in _BOUNDARY.finditer(text):
            kind = 3 if m.group().count("\n") > 1 else 2 if "\n" in m.group() else 1
            cuts[m.start() + len(m.group().rstrip())] = kind
        self.cut_at = np.array(sorted(cuts), dtype=np.int64)
        self.kind = np.array([cuts[int(c)] for c in self.cut_at], dtype=np.int64)

    def byte_of(self, char: int) -> int:
        return int(self.char_at[char]) if char < len(self.char_at) else self.n_bytes

    def char_of(self, byte: int) -> int:
        return int(np.searchsorted(self.char_at, byte))

    def tokens_to(self, char: int) -> int:
        """Whole tokens that end at or before a character."""
        return int(np.searchsorted(self.ends, self.byte_of(char), side="right"))

    def cohesion(self, char: int, block: int) -> float:
        w = int(np.searchsorted(self.word_at, char))
        left, right = Counter(self.words[max(0, w - block) : w]), Counter(self.words[w : w + block])
        if not left or not right:
            return 0.0
        dot = sum(n * right[x] for x, n in left.items())
        return dot / math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))


def _deepest(t: _Text, low: int, high: int, block: int) -> int | None:
    """Tokens up to the deepest valley among the natural boundaries that end in tokens (low, high]."""
    a = np.searchsorted(t.cut_at, t.char_of(int(t.ends[low - 1])) if low else 0, side="right")
    b = np.searchsorted(t.cut_at, t.char_of(int(t.ends[high - 1])), side="right")
    if a >= b:
        return None
    level = [t.cohesion(int(c), block) for c in t.cut_at[a:b]]
    best, choice = None, None
    for i, s in enumerate(level):
        left = i
        while left and level[left - 1] >= level[left]:
            left -= 1
        right = i
        while right + 1 < len(level) and level[right + 1] >= level[right]:
            right += 1
        end = t.tokens_to(int(t.cut_at[a + i]))
        if low < end <= high:
            key = (round(level[left] + level[right] - 2 * s, 9), int(t.kind[a + i]), end)
            if best is None or key > best:
                best, choice = key, end
    return choice


def piece_bounds(text: str, ends: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK, count=None) -> list[tuple[int, int]]:
    """Token ranges [start, end) of the pieces. ``count`` tokenizes a piece by itself: a piece that begins inside a word may
    then have a few tokens more, and is shortened until it fits."""
    n = len(ends)
    if n <= limit:
        return []
    t = _Text(text, ends)
    pieces, start, tight = [], 0, 0
    while True:
        if n - start <= limit - 8 or n - start <= limit and not (count and count(text[t.char_of(int(ends[start - 1])) if start else 0 :]) > limit):
            pieces.append((start, n))
            return pieces
        least, most = start + overlap + 3, start + limit - tight
        while most > least + 1 and not t.whole[most]:
            most -= 1
        end = _deepest(t, max(least, start + limit // 2), most, block) or _deepest(t, least, most, block)
        if end is None:
            gap = max((m.end() if m.end() > m.start() + 1 else m.start() for m in _WORD_GAP.finditer(text, t.char_of(int(ends[least])), t.char_of(int(ends[most - 1])))), default=0)
            end = t.tokens_to(gap) if gap else most
            end = end if least < end <= most else most
        if count and end - start > limit - 8 and end - tight > least and count(text[t.char_of(int(ends[start - 1])) if start else 0 : t.char_of(int(ends[end - 1]))]) > limit:
            tight += 4
            continue
        tight = 0
        pieces.append((start, end))
        start = end - overlap
        while start > 0 and not t.whole[start]:
            start -= 1


def split_text(enc, text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int, int, int]]:
    """(first token, last token + 1, first character, last character + 1) of each piece."""
    ends = token_ends(enc, text)
    if len(ends) <= limit:
        return []
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    char_at = np.flatnonzero((raw & 0xC0) != 0x80)
    at = lambda k: int(np.searchsorted(char_at, ends[k - 1])) if k else 0
    return [(a, b, at(a), at(b)) for a, b in piece_bounds(text, ends, limit, overlap, block, lambda piece: len(enc.encode_ordinary(piece)))]


def split_documents(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    block: int = BLOCK,
    vocabulary: str | None = None,
    with_text: bool = True,
) -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, first_char, n_chars, piece_text) of every document above ``limit`` tokens.

    A token holds at least one byte, so texts of at most ``limit`` bytes leave before they reach Python.
    """
    if overlap + 4 >= limit:
        raise ValueError("overlap must be smaller than the limit")
    vocabulary = vocabulary or vocabulary_path()
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).where(F.octet_length("body") > limit)
    fields = [rows.schema["doc_id"], *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "first_token", "n_tokens")), *(T.StructField(c, T.LongType()) for c in ("first_char", "n_chars"))]
    if with_text:
        fields.append(T.StructField("piece_text", T.StringType()))
    names = [f.name for f in fields]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            out = []
            for doc, body in zip(pdf["doc_id"], pdf["body"]):
                for k, (a, b, c, d) in enumerate(split_text(enc, body, limit, overlap, block)):
                    out.append((doc, k, a, b - a, c, d - c, body[c:d])[: len(names)])
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(cut, T.StructType(fields))
