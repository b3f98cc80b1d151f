"""Fast whole-text encoding with the tokenizers library.

Texts are cut at spaces into chunks that the tokenizer treats independently, a batch's distinct chunks are
found by Arrow, each is cut into pre-tokens, and every distinct pre-token is encoded once by the library's
model and kept. A document is the concatenation of its chunks' ids, which numpy gathers for a batch at once:

* "word" tokenizers drop white space, so any cut at a space or line feed is between pre-tokens; chunks of
  plain letters and marks after them are cut by Arrow too, so that forms of a word that differ in case or
  in marks are looked up once;
* byte-level ones attach one space to the word after it, so a cut before a space is between pre-tokens
  if no white space follows it; texts where some does are encoded whole.

What isn't plainly cut (special strings, characters that a normaliser may change) goes to the library as
it is.
"""

from __future__ import annotations

import gc
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tagweave.llm.common import only, release, worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Pre-tokens that a Python worker keeps in each of two generations; of chunks it keeps half as many.
KEEP = 300_000

#: The published pre-token patterns of the two vocabularies. Fixed values.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def pattern(published: str) -> regex.Pattern:
    """A published pattern for Python's regex, whose \\s also holds four control characters."""
    white = published.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")
    return regex.compile(white)


_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where a cut before some space is not between byte-level pre-tokens.
CROWDED = f"(?s) {_SPACE}|{_SPACE} \\z"

#: Chunks of "word" tokenizers that Arrow cuts: Latin-1 letters, then ASCII marks other than those of special strings.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "<|")


def _byte_characters() -> dict[int, str]:
    """Byte to character: printable Latin-1 ones stand for themselves, all others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SHOWN = _byte_characters()
_SHOWN_SPACE = _SHOWN[32]


def shown(text: str) -> str:
    """A pre-token as the model's vocabulary writes it."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", _SHOWN_SPACE)
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SHOWN)


class Kept:
    """Values by key, learnt when they are first asked for; the latest `keep` keys or more stay, in two generations."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], keep: int) -> None:
        self.learn, self.keep = learn, keep
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, keys: list[str]) -> list[bytes]:
        got = list(map(self.new.get, keys))
        gaps = [i for i, x in enumerate(got) if x is None]
        if gaps:
            if len(self.new) > self.keep:
                self.old, self.new = self.new, {}
            new, old = self.new, self.old
            unknown = []
            for i in gaps:
                x = old.get(keys[i])
                if x is None:
                    unknown.append(i)
                else:
                    new[keys[i]] = got[i] = x
            names = list(dict.fromkeys([keys[i] for i in unknown]))
            new.update(zip(names, self.learn(names), strict=True))
            for i in unknown:
                got[i] = new[keys[i]]
        return got

    def forget(self) -> None:
        self.new, self.old = {}, {}


class Encoder:
    """Ids of pre-tokens, chunks and whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, keep: int = KEEP, special: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = special
        self.model = self.tokenizer.model
        self.words = str(self.tokenizer.pre_tokenizer.__class__.__name__) != "ByteLevel"
        self.split = pattern(WORD if self.words else BYTE_LEVEL)
        self.before = "" if self.words else " "
        self.pretokens = Kept(self._pretokens, keep)
        #: Chunks after a space; one after a null character is the first of its text.
        self.kept = Kept(self._chunks, keep // 2)
        #: Plain words in lower case, of "word" tokenizers.
        self.stems = Kept(self._stems, keep)

    def forget(self) -> None:
        """Drop all that was learnt; the tokenizer stays."""
        for kept in (self.pretokens, self.kept, self.stems):
            kept.forget()
        release()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretokens(self, pre: list[str]) -> list[bytes]:
        tokenize = self.model.tokenize
        return [self.whole(p[1:]) if p[0] == "\0" else array("I", [t.id for t in tokenize(p)]).tobytes() for p in pre]

    def _stems(self, stems: list[str]) -> list[bytes]:
        return self._pretokens(list(map(shown, stems)))

    def ids(self, pre: list[str]) -> list[bytes]:
        """Ids of pre-tokens as the vocabulary writes them, and of uncut chunks after a null character."""
        return self.pretokens.get(pre)

    def cut(self, chunk: str, before: str) -> list[str]:
        """The pre-tokens of a chunk with `before` in front; all of it where only the library can tell."""
        if not chunk:
            return [_SHOWN_SPACE] if before else []
        if self.words:
            if not chunk.isascii() and max(chunk) > "\xff":  # normal forms and cases beyond may be odd
                return ["\0" + before + chunk]
            if self.special and "<|" in chunk:
                return ["\0" + before + chunk]
            chunk = chunk.lower()
        space = _SHOWN_SPACE if before else ""
        if chunk.isalpha():
            return [space + (chunk if chunk.isascii() else shown(chunk))]
        head, last = chunk[:-1], chunk[-1]
        if last in ".,;:!?)" and head.isalpha():
            return [space + (head if head.isascii() else shown(head)), last]
        if self.special and "<|" in chunk or not chunk.isascii():
            return ["\0" + before + chunk]
        return list(map(shown, self.split.findall(before + chunk)))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        flat, ends = [], []
        for c in chunks:
            flat += self.cut(c, self.before) if c[:1] != "\0" else self.cut(c[1:], "")
            ends.append(len(flat))
        ids, out, at = self.ids(flat), [], 0
        for end in ends:
            out.append(ids[at] if end == at + 1 else b"".join(ids[at:end]))
            at = end
        return out

    def chunks(self, chunks: list[str], first: bool = False) -> list[bytes]:
        """Ids of chunks that follow a space, or that begin a text."""
        if first and self.before:
            return self.kept.get(["\0" + c for c in chunks])
        odd = [i for i, c in enumerate(chunks) if c[:1] == "\0"]
        out = self.kept.get(chunks)
        for i in odd:
            out[i] = self.whole(self.before + chunks[i])
        return out

    def worded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has) of a "word" tokenizer."""
        stem = pc.ascii_rtrim(chunks, characters=MARKS)
        is_plain = pc.match_substring_regex(stem, f"^[{LATIN}]+$")
        plain = is_plain.to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(stem.filter(is_plain)).dictionary_encode()
        marks = pc.utf8_ltrim(chunks.filter(is_plain), characters=LETTERS).dictionary_encode()
        pieces = self.stems.get(stems.dictionary.to_numpy(zero_copy_only=False).tolist())
        front, back = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        front[plain] = stems.indices.to_numpy()
        front[~plain] = len(pieces) + np.arange(len(chunks) - len(stems))
        pieces += self.chunks(chunks.filter(pc.invert(is_plain)).to_pylist())
        back[plain] = len(pieces) + marks.indices.to_numpy()
        pieces += self.chunks(marks.dictionary.to_pylist())
        back[~plain] = len(pieces)
        pieces.append(b"")
        ids, sizes = gathered(*joined(pieces), np.stack([front, back], 1).ravel())
        return ids, sizes.reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, where each text's end); null is empty, and `end` follows every text."""
        texts = pc.fill_null(texts, "")
        if self.words:
            texts, odd = pc.replace_substring(texts, "\n", " "), np.zeros(len(texts), bool)
        else:
            odd = pc.match_substring_regex(texts, CROWDED).to_numpy(zero_copy_only=False)
        cut = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(cut, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets -= offsets[0]
        which = coded.indices.to_numpy().astype(np.int64)
        collected = gc.isenabled()
        gc.disable()  # millions of short-lived strings, no cycles
        try:
            if self.words:
                ids, sizes = self.worded(coded.dictionary)
            else:
                pieces = self.chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        finally:
            if collected:
                gc.enable()
        if not self.words:  # a text's first chunk has no space before it
            first = lists.values.take(pa.array(lists.offsets.to_numpy()[:-1])).to_pylist()
            own = {c: len(pieces) + i for i, c in enumerate(dict.fromkeys(first))}
            pieces += self.chunks(list(own), first=True)
            which[offsets[:-1]] = [own[c] for c in first]
            for i in np.flatnonzero(odd).tolist():
                which[offsets[i]] = len(pieces)
                pieces.append(self.whole(texts[i].as_py()))
            ids, sizes = joined(pieces)
        if end:
            which = np.insert(which, offsets[1:], len(sizes))
            ids, sizes = np.r_[ids, np.frombuffer(end, "<u4")], np.r_[sizes, len(end) // 4]
            offsets = offsets + np.arange(len(offsets))
        ids, n = gathered(ids, sizes, which)
        return ids, np.r_[0, np.cumsum(n)][offsets[1:]]


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, how many each has)."""
    return np.frombuffer(b"".join(pieces), "<u4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4


def gathered(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the pieces which names, one after the other, how many each has); sizes: of the pieces that ids is made of."""
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(sizes) - sizes)[which] - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return ids[at], n


_HELD: dict[tuple[str, bool], Encoder] = worker_cache("tokens")


def encoder(path: str, keep: int = KEEP, special: bool = True) -> Encoder:
    """The worker's encoder for a tokenizer file; it outlives a task."""
    only("tokens")
    if (path, special) not in _HELD:
        _HELD[path, special] = Encoder(path, keep, special)
    held = _HELD[path, special]
    held.pretokens.keep, held.kept.keep, held.stems.keep = keep, keep // 2, keep
    return held
