"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

A sequence of tokens is the BPE encoding of its text exactly if each token and each pair of neighbours
would be encoded as they stand. So the encoding of a prefix is known by its last token alone: the rest is
the encoding of the prefix without it. The walk keeps the last token of every prefix on its path; what two
words share is worked out once. Words are visited in sorted order, which is the depth-first order of their
trie, so the path is all of the trie that is ever held.

The vocabulary file is one of the public ones with word ends ("</w>"), lower case and byte-level symbols;
its path is a parameter and is opened where it is used. Each Python worker has its own bounded table of words,
which its later tasks go on with.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os.path
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Characters of words (each with 60 for its tables) whose encodings a worker keeps, and of text that it encodes at once.
KEPT_CHARS, CHARS = 40_000_000, 8_000_000
#: Tokens are told apart by their last END bytes before they are looked up; shorter ones are always tried.
END, SHORT = 3, (2, 1)
SEPARATORS = re.compile(r"[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _sizes(tokens: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """By last END bytes, the lengths of tokens that end so, longest first."""
    out: dict[bytes, set[int]] = {}
    for t in tokens:
        if len(t) >= END:
            out.setdefault(t[-END:], set(SHORT)).add(len(t))
    return {e: tuple(sorted(n, reverse=True)) for e, n in out.items()}


#: Characters met so far, by whether Python's tables know them.
MET: dict[bool, set[str]] = {True: set(), False: set()}


def unassigned(text: str) -> set[str]:
    """The text's characters that Python's tables don't know; each character is looked up once."""
    chars = set(text)
    for c in chars - MET[True] - MET[False]:
        MET[unicodedata.category(c) != "Cn"].add(c)
    return chars & MET[False]


@functools.lru_cache(maxsize=100_000)
def newer(c: str) -> tuple[str, str]:
    """Lower case of a character that Python doesn't know, and a sign of its class: by the tables of the library that texts are encoded alike with."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    is_in = lambda p: [part for part, _ in pre_tokenizers.Split(Regex(p), "removed").pre_tokenize_str(f"!{c}")] == ["!"]
    return normalizers.Lowercase().normalize_str(c), "a" if is_in(r"\p{L}") else "1" if is_in(r"\p{N}") else "#"


class Vocabulary:
    """Tokens, merges and the special tokens of a file; encodes sorted distinct words."""

    def __init__(self, path: str, kept_chars: int = KEPT_CHARS):
        self.kept_chars = kept_chars
        data = json.load(open(path, encoding="utf-8"))
        model, byte = data["model"], byte_symbols()
        self.end = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.inner: dict[bytes, int] = {}  # tokens within a word by their bytes
        self.last: dict[bytes, int] = {}  # those that end one
        self.size: dict[int, int] = {}
        for t, i in model["vocab"].items():
            ends = t.endswith(self.end) and len(t) > len(self.end)
            raw = bytes(byte[c] for c in (t[: -len(self.end)] if ends else t))
            (self.last if ends else self.inner)[raw] = i
            self.size[i] = len(raw)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}  # rank of the merge that makes a token; -1 for single symbols
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = model["vocab"][a], model["vocab"][b]
            self.rank[pair] = r
            t = model["vocab"][a + b]
            if t not in self.parts:
                self.parts[t], self.made[t] = pair, r
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        # fixed values: white space and the split pattern of this kind of vocabulary
        self.space = regex.compile(r"\p{White_Space}+")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.fits: dict[int, bool] = {}
        self.inner_sizes, self.last_sizes = _sizes(self.inner), _sizes(self.last)
        self.known: dict[str, tuple[str, str]] = {}  # ids and tokens of words and of chunks, that is, words without white space between
        self.held = 0

    def stands(self, a: int, b: int) -> bool:
        """Whether BPE leaves a followed by b as they are, that is, no merge ever crosses from a's end to b's start.

        Runs time backwards: undoing the later of the two merges beside the boundary shows which symbols met
        there, and a merge of theirs crosses if its turn came before either grew further. Of equal turns the
        leftmost comes first.
        """
        if (known := self.fits.get(a << 32 | b)) is not None:
            return known
        x, y, x_grows, y_grows = a, b, 1 << 60, 1 << 60
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < x_grows and r <= y_grows:
                out = False
                break
            mx, my = self.made.get(x, -1), self.made.get(y, -1)
            if mx > my:
                x_grows, x = mx, self.parts[x][1]
            elif my >= 0:
                y_grows, y = my, self.parts[y][0]
            else:
                out = True
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a << 32 | b] = out
        return out

    def step(self, word: bytes, d: int, tokens: dict[bytes, int], sizes: dict[bytes, tuple[int, ...]], path: list[int]) -> int:
        """The last token of word[:d], given those of all its prefixes; tokens: which may come last; sizes: how long they are by their ends."""
        fits = self.fits
        for n in sizes.get(word[d - END : d], SHORT) if d >= END else range(d, 0, -1):
            if n <= d and (t := tokens.get(word[d - n : d])) is not None:
                if n == d:
                    return t
                if (known := fits.get(path[d - n] << 32 | t)) is None:
                    known = self.stands(path[d - n], t)
                if known:
                    return t
        raise ValueError(f"no token of the vocabulary ends {word[:d]!r}")

    def walk(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """The encoding of each word; words: distinct and sorted. path[d] is the last token of the current word's first d bytes."""
        path, before, step = [0], b"", self.step
        inner, last, inner_sizes, last_sizes, size = self.inner, self.last, self.inner_sizes, self.last_sizes, self.size
        for w in words:
            shared_bytes = len(os.path.commonprefix([before, w]))
            del path[min(shared_bytes, len(path) - 1) + 1 :]
            for d in range(len(path), len(w)):
                path.append(step(w, d, inner, inner_sizes, path))
            before, d, out = w, len(w), []
            t = step(w, d, last, last_sizes, path)
            while True:
                out.append(t)
                d -= size[t]
                if not d:
                    break
                t = path[d]
            yield out[::-1]

    def chunks(self, text: str) -> list[str]:
        """The text between white space, normalised and in lower case, and its special tokens as they stand.

        No word crosses white space, so a chunk's words are those that it has by itself.
        """
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)) if any(t in text for t in self.specials) else [(0, text)]:
            if k % 2:
                out.append(part)
            elif part:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
                if not plain.isascii() and (odd := unassigned(plain)):
                    plain = plain.translate({ord(c): newer(c)[0] for c in odd})
                # split() alone takes four controls for white space too, which have no such property
                out += [c for c in self.space.split(plain.lower()) if c] if SEPARATORS.search(plain) else plain.lower().split()
        return out

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk; characters that Python doesn't know count as their class."""
        if chunk.isascii() or not (odd := unassigned(chunk)):
            return self.split.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.split.finditer(chunk.translate({ord(c): newer(c)[1] for c in odd}))]

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that aren't known yet by their distinct words."""
        known = self.known
        if self.held > self.kept_chars:
            known.clear()
            self.held = 0
        known |= {t: (str(i), t) for t, i in self.specials.items()}
        new = [c for c in chunks if c not in known]
        mixed = {c: self.words(c) for c in new if not c.isalpha()}
        words = {c for c in new if c.isalpha()}.union(*mixed.values())
        words = sorted(w.encode() for w in words if w not in known)
        for w, ids in zip(words, self.walk(words), strict=True):
            known[w.decode()] = " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])
            self.held += len(w) + 60
        for c, ws in mixed.items():
            if ws != [c]:
                known[c] = " ".join([known[w][0] for w in ws]), " ".join([known[w][1] for w in ws])
                self.held += len(c) + 60

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids, joined by spaces, and the text that decoding them gives: the tokens, joined by spaces."""
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        for chunks in split:
            found = [self.known[c] for c in chunks]
            yield " ".join([f[0] for f in found]), " ".join([f[1] for f in found])


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str, kept_chars: int) -> Vocabulary:
    """A worker's vocabulary, with the words that its tasks have met."""
    return Vocabulary(path, kept_chars)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids string, decoded string) per document, null texts as empty: the operator's real output."""
    return _mapped(docs, path, "ids string, decoded string", lambda a, b: (a, b))


def digests(docs: DataFrame, path: str | None = None, kept_chars: int = KEPT_CHARS, chars: int = CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document, null texts as empty. Repeated rows stay.

    kept_chars, chars: what a worker holds, as KEPT_CHARS and CHARS; the rows don't depend on them. Workers keep it while
    later stages run in them.
    """
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda a, b: (a.count(" ") + 1 if a else 0, sha(a), sha(b)), kept_chars, chars)


def _mapped(docs: DataFrame, path: str | None, schema: str, row: Callable[[str, str], tuple], kept_chars: int = KEPT_CHARS, at_once: int = CHARS) -> DataFrame:
    path = path or default_path()
    names = [f.split()[0] for f in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = _vocabulary(path, kept_chars)
        for texts in batches:
            rows, some, chars = [], [], 0
            for t in [*texts, None]:
                if some and (t is None or chars + len(t) > at_once):
                    rows += [row(a, b) for a, b in vocabulary.encode(some)]
                    some, chars = [], 0
                if t is not None:
                    some.append(t)
                    chars += len(t)
            yield pd.DataFrame(rows, columns=names)

    return shared.texts(docs).select("doc_id", run("text").alias("out")).select("doc_id", "out.*")
