"""Byte-pair encoding of whole texts with the tokenizers library's merges, each distinct
word once.

Before a space that a non-space follows, the byte-level pre-tokenizer always starts a new
piece, and a line end between non-spaces is always a piece of its own, so texts are cut
there into words.  A new word is cut by the pre-tokenizer's own expression, each new piece
is merged by the library, and the ids are kept in a bounded pool, from which those of many
texts are gathered at once.  What this module's character classes
cannot vouch for is handed to the library as it stands.
"""

from __future__ import annotations

import codecs
import gc
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np

#: Before such a space a new piece always starts.
_CUT = re.compile(r" (?=\S)")
#: Such a line end is a piece of its own.
_LINE = re.compile(r"\n(?<=\S\n)(?=\S)")
#: White space to Python only.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The pre-tokenizer's expression, in ASCII and over the characters that ``_OTHER`` excludes: Latin
#: letters up to U+024F, general punctuation and currency signs, whose classes are settled.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞₠-₿]")
#: White space that is rare.
_RARE = ("\t", "\r", "\v", "\f")
#: Marks that are a piece of their own after letters, at the end of a word; the frequent ones
#: become words.
_ENDS = frozenset(".,;:!?)")
_COMMA, _STOP = re.compile(r",(?<=[^\W\d_],)(?=[ \n])"), re.compile(r"\.(?<=[^\W\d_]\.)(?=[ \n])")
#: Before a key: the piece stands as it is, or the library is to cut it; else a space stands before the word.
_BARE, _RAW = "\x1c", "\x1d"
#: Pieces that are put into the byte alphabet at once.
_BLOCK = 1 << 13
_KEPT: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "WordEncoder":
    """One encoder for each Python worker; its pool serves all tasks there."""
    if path not in _KEPT:
        _KEPT[path] = WordEncoder(path)
    return _KEPT[path]


class WordEncoder:
    """``encode(texts)`` gives the ids of all texts in one array (uint32), and the edges of
    each text's part of it.  Null counts as empty.  Texts that spell a special token are
    ordinary text.  Very long texts are cut into slices, and at most about ``at_once``
    words are held as strings."""

    def __init__(self, path: str, limit: int = 1_250_000, at_once: int = 1_000_000, slice_chars: int = 1 << 20, longest: int = 64):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the byte alphabet: printable characters stand for themselves, the rest follow from 256
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        letters = {b: 256 + i for i, b in enumerate(rest)}
        self.letters = "".join(chr(letters.get(b, b)) for b in range(256))
        self.limit, self.at_once, self.slice_chars, self.longest = limit, at_once, slice_chars, longest
        self._reset([], np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _reset(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        # numbers of words; one that is met first gets the next number and comes last
        self.slots = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.held = len(words)
        self.pool, self.counts, self.starts = ids, counts, np.cumsum(counts) - counts
        self.uses = np.zeros(len(words), np.int32)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _fresh(self) -> list[str]:
        """The words that have come since the last call, in the order of their numbers."""
        words = list(islice(reversed(self.slots), len(self.slots) - self.held))
        self.held = len(self.slots)
        return words[::-1]

    def _learn(self) -> None:
        """Ids of the new words go to the end of the pool: first of words of one piece, then,
        copied from these, of words of several."""
        slots, known = self.slots, len(self.counts)
        words = self._fresh()
        single: list[int] = []
        pieces: list[str] = []
        raw: list[int] = []
        several: list[int] = []
        parts: list[int] = []
        sizes: list[int] = []
        for n, word in enumerate(words, known):
            if word.isalpha():
                single.append(n)
                pieces.append(" " + word)
            elif word[-1] in _ENDS and word[:-1].isalpha():
                several.append(n)
                sizes.append(2)
                parts += slots[word[:-1]], slots[_BARE + word[-1]]
            elif word[0] == _RAW:
                raw.append(n)
            else:
                whole = word[1:] if word[0] == _BARE else " " + word
                found = (_ASCII if word.isascii() else _LATIN).findall(whole)
                if len(found) == 1:
                    single.append(n)
                    pieces.append(whole)
                else:
                    several.append(n)
                    sizes.append(len(found))
                    parts += [slots[x[1:] if x[0] == " " and not x.isspace() else _BARE + x] for x in found]
        more = self._fresh()  # pieces that have not been words so far
        single += range(known + len(words), known + len(words) + len(more))
        pieces += [x[1:] if x[0] == _BARE else " " + x for x in more]
        ids: list[int] = []
        counts: list[int] = []
        merge = self.tokenizer.model.tokenize
        for lo in range(0, len(pieces), _BLOCK):
            # the byte alphabet for many at once; no piece holds the control between them
            joined = codecs.charmap_decode("\x1f".join(pieces[lo : lo + _BLOCK]).encode(), "strict", self.letters)[0]
            for piece in joined.split(self.letters[0x1F]):
                got = [t.id for t in merge(piece)]
                ids += got
                counts.append(len(got))
        for n in raw:
            got = self._library(words[n - known][1:])
            ids += got
            counts.append(len(got))
        self._add(single + raw, np.array(ids, np.uint32), np.array(counts, np.int64), len(words) + len(more))
        if several:
            copied, edges = self._gather(np.array(parts, np.int64))
            ends = edges[np.cumsum(sizes)]
            self._add(several, copied, np.diff(ends, prepend=0))
        for word in [w for x in (words, more) for w in x if len(w) > self.longest]:
            del slots[word]
        self.held = len(slots)

    def _add(self, numbers: list[int], ids: np.ndarray, counts: np.ndarray, new: int = 0) -> None:
        """Ids of the words of these numbers, after room was made for ``new`` numbers."""
        if new:
            self.counts, self.starts, self.uses = (np.concatenate([x, np.zeros(new, x.dtype)]) for x in (self.counts, self.starts, self.uses))
        at = np.array(numbers, np.int64)
        self.counts[at], self.starts[at] = counts, len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, ids])

    def _forget(self) -> None:
        """Above the limit only words of several batches stay; if these are too many, none."""
        if len(self.slots) <= self.limit and len(self.pool) <= 16 * self.limit:
            return
        kept = [(w, i) for w, i in self.slots.items() if self.uses[i] > 1]
        if 2 * len(kept) > self.limit:
            kept = []
        at = np.array([i for _, i in kept], np.int64)
        self._reset([w for w, _ in kept], self._gather(at)[0], self.counts[at])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words one after another, and the edges of each."""
        counts = self.counts[at]
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self.pool[np.repeat(self.starts[at] - edges[:-1], counts) + np.arange(edges[-1])], edges

    def _words(self, text: str) -> list[str]:
        """Keys of the words of a text."""
        if text.isascii():
            plain = not any(map(text.__contains__, _CONTROLS))
            odd = False
        else:
            odd = _OTHER.search(text) is not None
            plain = not odd or text.isprintable() or not any(c.isspace() and c not in "\t\n\v\f\r " for c in set(text))
        if not plain:
            return [_RAW + text]
        if text[-1] == " " or "  " in text or any(map(text.__contains__, _RARE)) or " \n" in text:
            words = _CUT.split(text)
        else:
            text = _STOP.sub(f" {_BARE}.", _COMMA.sub(f" {_BARE},", text))
            words = (_LINE.sub(f" {_BARE}\n {_BARE}", text) if "\n" in text else text).split(" ")
        words[0] = _BARE + words[0]
        if odd:
            words = [w if w.isascii() or _OTHER.search(w, w[0] == _BARE) is None else _RAW + (w[1:] if w[0] == _BARE else " " + w) for w in words]
        return words[1:] if words[0] == _BARE else words

    def _slices(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > self.slice_chars:
            end = _CUT.search(text, at + self.slice_chars)
            if end is None:
                break
            out.append(text[at : end.start()])
            at = end.start()
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found: list[np.ndarray] = [np.zeros(0, np.uint32)]
        lengths = np.zeros(len(texts), np.int64)
        words: list[str] = []
        marks: list[tuple[int, int]] = []

        def flush() -> None:
            nonlocal words, marks
            self._forget()
            at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
            if len(self.slots) > self.held:
                self._learn()
            self.uses += np.bincount(at, minlength=len(self.uses)) > 0
            ids, edges = self._gather(at)
            found.append(ids)
            a = 0
            for i, b in marks:
                lengths[i] += edges[b] - edges[a]
                a = b
            words, marks = [], []

        collecting = gc.isenabled()
        gc.disable()  # millions of strings and no cycles
        try:
            for i, text in enumerate(texts):
                for part in self._slices(text) if text else ():
                    words += self._words(part)
                    marks.append((i, len(words)))
                    if len(words) > self.at_once:
                        flush()
            flush()
        finally:
            if collecting:
                gc.enable()
        return np.concatenate(found), np.concatenate([[0], np.cumsum(lengths)])
