"""SentencePiece encoding and decoding with seeded merge-dropout.

Merges of a merge-type model are taken from an agenda, best score first and leftmost among
equals.  With dropout, a hash keyed by seed, document, place of the word, and the span and
cut of the candidate decides, when the agenda comes to it, whether that merge is skipped; so
each occurrence draws its own merges, and a segmentation can be had again after a lost task.
Every segmentation decodes to the text that was encoded.

No piece of a merge-type model holds a space mark after another character, so words are
segmented apart.  The agendas of many words run side by side in arrays: first those of a
batch's distinct words without any skip; then, for occurrences that skip a merge of these,
each one's own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import documents, mix, span_hashes

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Symbols from here on are characters that are no pieces: this number and the code point.
_CHARACTER = 1 << 20
_NONE = np.iinfo(np.int32).max
_KEPT: dict[tuple, "PieceCoder"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def coder(path: str, seed: int, dropout: float) -> "PieceCoder":
    """One coder for each Python worker and setting."""
    key = (path, seed, dropout)
    if key not in _KEPT:
        _KEPT[key] = PieceCoder(*key)
    return _KEPT[key]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def _plain(model: bytes) -> bool:
    """Whether a model's normaliser only puts a space before the text and marks spaces."""
    spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
    # no character map, a space in front, no white space removed, spaces marked
    return not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


def _lists(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values`` one after another, and the edges of each."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    return values[np.repeat(starts - edges[:-1], counts) + np.arange(edges[-1])], edges


def _cuts(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Numbers of the merges of characters i..j-1 and j..k-1."""
    return ((i.astype(np.uint64) << np.uint64(42)) + (j.astype(np.uint64) << np.uint64(21)) + k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """Words without a skip: their characters, symbols and merges, by number."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}
        self.codes, self.symbols, self.cuts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # where a word's part of each of the three begins, and its length
        self.at, self.n, self.uses = np.zeros((3, 0), np.int64), np.zeros((3, 0), np.int64), np.zeros(0, np.int32)

    def add(self, hashes: list[int], codes: np.ndarray, symbols: np.ndarray, cuts: np.ndarray, n: np.ndarray) -> None:
        first = len(self.uses)
        self.number.update(zip(hashes, range(first, first + len(hashes)), strict=True))
        began = np.array([[len(self.codes)], [len(self.symbols)], [len(self.cuts)]])
        self.at, self.n = np.hstack([self.at, began + np.cumsum(n, axis=1) - n]), np.hstack([self.n, n])
        self.codes, self.symbols, self.cuts = np.concatenate([self.codes, codes]), np.concatenate([self.symbols, symbols]), np.concatenate([self.cuts, cuts])
        self.uses = np.concatenate([self.uses, np.zeros(len(hashes), np.int32)])

    def frequent(self, limit: int) -> "_Words":
        """Words of more than one batch alone, or none if these are too many."""
        out = _Words()
        kept = [(h, i) for h, i in self.number.items() if self.uses[i] > 1]
        if 2 * len(kept) <= limit:
            at = np.array([i for _, i in kept], np.int64)
            parts = [_lists(x, self.at[r, at], self.n[r, at])[0] for r, x in enumerate((self.codes, self.symbols, self.cuts))]
            out.add([h for h, _ in kept], *parts, self.n[:, at])
        return out


class PieceCoder:
    """``encode(texts, keys)`` gives the ids of all texts in one array (uint32) and the edges
    of each text's part; ``decode(ids, edges)`` the texts."""

    def __init__(self, path: str, seed: int = 0, dropout: float = 0.0, rows: int = 16_384, longest: int = 48, words: int = 60_000, limit: int = 200_000):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        self.normalize = (lambda t: MARK + t.replace(" ", MARK)) if _plain(m.serialized_model_proto()) else m.normalize
        self.seed, self.limit, self.rows, self.longest, self.words = seed, round(dropout * 65536), rows, longest, words
        self.known, self.most = _Words(), limit
        self.unknown, self.ids, self.bytes_ = m.unk_id(), {}, {}
        score: dict[str, float] = {}
        spelled = []
        for i in range(m.piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes_[int(piece[1:-1], 16)] = i
                spelled.append(bytes([int(piece[1:-1], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                spelled.append(" ⁇ ".encode() if m.is_unknown(i) else b"")
            else:
                spelled.append(piece.replace(MARK, " ").encode())
                if not m.is_unused(i):
                    self.ids[piece], score[piece] = i, m.get_score(i)
                    if MARK in piece.lstrip(MARK):
                        raise ValueError("a piece holds a space mark after another character")
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_counts = np.array([len(x) for x in spelled], np.int64)
        order = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {piece: order[x] for piece, x in score.items()}
        self.of_char = np.arange(0x110000, dtype=np.int64) + _CHARACTER
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        merges: dict[int, int] = {}
        known = lambda x: self.ids.get(x, _CHARACTER + ord(x) if len(x) == 1 else None)
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = known(piece[:cut]), known(piece[cut:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = i
        self._index(merges)

    def _index(self, merges: dict[int, int]) -> None:
        """An open hash table of merges: places after the home are looked at in turn."""
        bits = max(4, int(np.ceil(np.log2(6 * len(merges) + 16))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.merged = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys = np.array(list(merges), np.int64)
        values, home = np.array(list(merges.values()), np.int32), self._home(keys)
        self.reach = 1
        while len(keys):
            place = (home + self.reach - 1) & self.mask
            _, first = np.unique(place, return_index=True)
            first = first[self.slots[place[first]] < 0]
            self.slots[place[first]], self.merged[place[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, home = keys[left], values[left], home[left]
            self.reach += len(keys) > 0
        by_id = np.full(max(self.ids.values(), default=0) + 1, _NONE, np.int32)
        for piece, i in self.ids.items():
            by_id[i] = self.rank[piece]
        self.rank_of = by_id

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE if they don't merge) and merged piece of neighbouring symbols."""
        keys = left.astype(np.int64) << 32 | right
        home = self._home(keys)
        rank, merged = np.full(len(keys), _NONE, np.int32), np.zeros(len(keys), np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.reach):
            there = self.slots[home]
            hit = there == keys
            at = todo[hit]
            merged[at] = self.merged[home[hit]]
            rank[at] = self.rank_of[merged[at]]
            on = (there >= 0) & ~hit
            if not on.any():
                break
            todo, keys, home = todo[on], keys[on], (home[on] + 1) & self.mask
        return rank, merged

    def _skips(self, keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Whether the merges that ``cuts`` number (see ``_cuts``) are skipped for their keys."""
        return (mix(keys + cuts) >> np.uint64(48)).astype(np.uint32) < self.limit

    def segment(self, word: str, key: int | None = None) -> list[int]:
        """Symbols of one word by an agenda of its own; no merge is skipped without a key."""
        symbols: list[int | None] = self.of_char[[ord(c) for c in word]].tolist()
        n = len(symbols)
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []
        parts: list[str] = list(word)

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (rank := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(agenda, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or parts[i] != left or j >= n or parts[j] != right:
                continue  # one side has merged since
            k = after[j]
            if key is not None and self._skips(np.array([key], np.uint64), _cuts(*(np.array([x], np.int64) for x in (i, j, k))))[0]:
                continue
            parts[i] = left + right
            symbols[i], symbols[j], after[i] = self.ids[parts[i]], None, k
            offer(i)
            if k < n:
                before[k] = i
            if before[i] >= 0:
                offer(before[i])
        return [x for x in symbols if x is not None]

    def _agendas(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Symbols of words of up to ``longest`` characters after all merges, their counts by
        word, and the agenda's steps by word: their counts, merges and whether skipped."""
        order = np.argsort(lengths, kind="stable")
        words, out, made = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))]
        at = 0
        while at < len(order):
            # words of like lengths together, as many as ``rows`` words of eight characters fill
            longest = int(lengths[order[min(len(order), at + self.rows) - 1]])
            own = order[at : at + max(1, self.rows * 8 // max(8, longest))]
            at += len(own)
            got, counts = self._run(symbols, starts[own], lengths[own], None if keys is None else keys[own], own, made)
            out.append(got)
            words.append(np.stack([own, counts]))
        own, counts = np.concatenate(words, axis=1)
        values = np.concatenate(out)
        back = np.argsort(own)
        word, cuts, skipped = (np.concatenate(x) for x in zip(*made, strict=True))
        by = np.argsort(word, kind="stable")
        return _lists(values, (np.cumsum(counts) - counts)[back], counts[back])[0], counts[back], (np.bincount(word, minlength=len(starts)), cuts[by], skipped[by])

    def _run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None, names: np.ndarray, made: list) -> tuple[np.ndarray, np.ndarray]:
        """One block of words side by side: a row for each, a column for each character and
        one beyond."""
        n, wide = len(starts), int(lengths.max()) + 1
        column = np.arange(wide)
        inside = column < lengths[:, None]
        word = np.full((n, wide), -1, np.int64)
        word[inside] = _lists(symbols, starts, lengths)[0]
        after = np.minimum(column + 1, lengths[:, None]).astype(np.int32)
        before = np.tile((column - 1).astype(np.int32), (n, 1))
        rank, merged = np.full((n, wide), _NONE, np.int32), np.zeros((n, wide), np.int32)
        pair = column < lengths[:, None] - 1
        a, b = word[:, :-1][pair[:, :-1]], word[:, 1:][pair[:, :-1]]
        rank[pair], merged[pair] = self._pairs(a, b)
        done_rows, done_words = [], []
        rows = np.arange(n)
        while len(rows):
            best = rank.argmin(axis=1)
            flat = np.arange(len(rows)) * wide + best
            on = rank.ravel()[flat] < _NONE
            if on.sum() <= 0.75 * len(rows):
                done_rows.append(rows[~on])
                done_words.append(word[~on])
                rows, rank, merged, word, after, before, best = (x[on] for x in (rows, rank, merged, word, after, before, best))
                flat = np.arange(len(rows)) * wide + best
            else:
                best, flat = best[on], flat[on]
            if not len(best):
                continue
            live = flat - best  # where the rows begin
            links, back, word_, rank_, merged_ = after.reshape(-1), before.reshape(-1), word.reshape(-1), rank.reshape(-1), merged.reshape(-1)
            j = links[flat]
            k = links[live + j]
            row, cuts = rows[live // wide], _cuts(best, j, k)
            skip = np.zeros(len(row), bool) if keys is None else self._skips(keys[row], cuts)
            made.append((names[row], cuts, skip))
            if skip.any():
                rank_[flat[skip]] = _NONE
                best, flat, live, j, k = (x[~skip] for x in (best, flat, live, j, k))
            word_[flat] = merged_[flat]
            links[flat] = k
            rank_[live + j] = _NONE
            word_[live + j] = -1
            back[live + k] = best
            ahead = word_[live + k]
            h = back[flat]
            has = h >= 0
            prior = (live + h)[has]
            left = np.concatenate([word_[flat], word_[prior]])
            right = np.concatenate([ahead, word_[flat[has]]])
            to = np.concatenate([flat, prior])
            rank_[to], merged_[to] = self._pairs(left, np.where(right < 0, (1 << 31) - 1, right))
        final = np.full((n, wide), -1, np.int64)
        for r, w in zip(done_rows, done_words, strict=True):
            final[r] = w
        alive = final >= 0
        return final[alive], alive.sum(axis=1)

    def _number(self, codes: np.ndarray, symbols: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words in ``known`` by their hashes, and whether their characters are
        those of the word known by it; new words are worked out and put there."""
        if len(self.known.uses) > self.most:
            self.known = self.known.frequent(self.most)
        hashes, first, kind = np.unique(span_hashes(codes, a, a + n), return_index=True, return_inverse=True)
        listed = hashes.tolist()
        number = np.array([self.known.number.get(h, -1) for h in listed], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            at = first[new]
            values, counts, (steps, cuts, _) = self._agendas(symbols, a[at], n[at], None)
            number[new] = np.arange(len(self.known.uses), len(self.known.uses) + len(new))
            self.known.add([listed[i] for i in new.tolist()], _lists(codes, a[at], n[at])[0], values, cuts, np.stack([n[at], counts, steps]))
        known = self.known
        known.uses[number] += 1
        number = number[kind]
        same = n == known.n[0, number]
        mine, edges = _lists(codes, a, n)
        theirs = _lists(known.codes, np.where(same, known.at[0, number], 0), np.where(same, n, 0))[0]
        alike = same.copy()
        alike[same] = ~np.logical_or.reduceat(mine[np.repeat(same, n)] != theirs, np.concatenate([[0], np.cumsum(n[same])])[:-1]) if same.any() else False
        return number, alike

    def _symbols(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words of a batch, and their counts by word."""
        symbols = self.of_char[codes]
        counts = np.zeros(len(starts), np.int64)
        where = np.zeros(len(starts), np.int64)
        pool: list[np.ndarray] = []
        size = 0

        def put(words: np.ndarray, values: np.ndarray, own: np.ndarray) -> None:
            nonlocal size
            counts[words], where[words] = own, size + np.cumsum(own) - own
            pool.append(values)
            size += len(values)

        long = np.flatnonzero(lengths > self.longest)
        for w in long.tolist():
            text = "".join(map(chr, codes[starts[w] : starts[w] + lengths[w]].tolist()))
            got = self.segment(text, None if keys is None else int(keys[w]))
            put(np.array([w]), np.array(got, np.int64), np.array([len(got)]))
        short = np.flatnonzero(lengths <= self.longest)
        if len(short):
            a, n = starts[short], lengths[short]
            number, alike = self._number(codes, symbols, a, n)
            known = self.known
            put(short, *(lambda x: (x[0], known.n[1, number]))(_lists(known.symbols, known.at[1, number], known.n[1, number])))
            dirty = ~alike
            if keys is not None:
                own = keys[short]
                many = known.n[2, number]
                cuts, edges = _lists(known.cuts, known.at[2, number], many)
                skip = self._skips(np.repeat(own, many), cuts)
                # the skipped among a word's merges as bits
                bits = skip.astype(np.uint64) << (np.arange(len(skip)) - np.repeat(edges[:-1], many)).astype(np.uint64)
                bits = np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(bits, dtype=np.uint64)])[edges])
                dirty |= bits > 0
                again = np.flatnonzero(dirty)
                # one of those that skip the same merges of the same word goes first; others of
                # which no draw differs on its way end alike
                _, lead, group = np.unique(mix(number[again].astype(np.uint64) + mix(bits[again])), return_index=True, return_inverse=True)
                first = again[lead]
                values, own_n, (steps, cuts, skipped) = self._agendas(symbols, a[first], n[first], own[first])
                many, begin = steps[group], (np.cumsum(steps) - steps)[group]
                step, edges = _lists(np.arange(len(cuts)), begin, many)
                differ = self._skips(np.repeat(own[again], many), cuts[step]) != skipped[step]
                same = (np.diff(np.concatenate([[0], np.cumsum(differ)])[edges]) == 0) & alike[again] & alike[first[group]] & (number[again] == number[first[group]])
                same[lead] = True
                put(short[again[same]], *(lambda x: (x[0], own_n[group[same]]))(_lists(values, (np.cumsum(own_n) - own_n)[group[same]], own_n[group[same]])))
                dirty[again[same]] = False
            again = np.flatnonzero(dirty)
            if len(again):
                values, own_n, _ = self._agendas(symbols, a[again], n[again], None if keys is None else keys[short[again]])
                put(short[again], values, own_n)
        values = np.concatenate(pool) if pool else np.zeros(0, np.int64)
        return _lists(values, where, counts)[0], counts

    def _spell_unknown(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become their bytes' pieces, or the unknown piece."""
        odd = symbols >= _CHARACTER
        if not odd.any():
            return symbols, counts
        spelled, kind = np.unique(symbols[odd], return_inverse=True)
        lists = [[self.bytes_[b] for b in chr(x - _CHARACTER).encode()] if self.bytes_ else [self.unknown] for x in spelled.tolist()]
        sizes = np.array([len(x) for x in lists])
        pool = np.concatenate([symbols, [x for own in lists for x in own]])
        many, starts = np.ones(len(symbols), np.int64), np.arange(len(symbols))
        many[odd], starts[odd] = sizes[kind], (len(symbols) + np.cumsum(sizes) - sizes)[kind]
        edges = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(counts)])]
        return _lists(pool, starts, many)[0], np.diff(edges)

    def encode(self, texts: list[str | None], keys: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``keys`` set documents apart; texts of one key and seed draw alike."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)]
        sizes = np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray, np.ndarray | None]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            codes = np.concatenate([x[1] for x in held])
            edges = np.concatenate([[0], np.cumsum([len(x[1]) for x in held])])
            marks = codes == ord(MARK)
            begins = marks.copy()
            begins[1:] &= ~marks[:-1]
            begins[edges[:-1]] = True
            starts = np.flatnonzero(begins)
            lengths = np.diff(np.concatenate([starts, [len(codes)]]))
            drawn = None
            if self.limit:
                # a word's place in its text goes into its key; slices of a text carry on the count
                text = np.searchsorted(edges, starts, side="right") - 1
                first = np.searchsorted(starts, edges[:-1])
                place = np.arange(len(starts)) - first[text] + np.array([x[3] for x in held])[text]
                own = mix(np.array([x[2] for x in held], np.uint64) ^ mix(np.array([self.seed & (1 << 64) - 1], np.uint64)))
                drawn = mix(place.astype(np.uint64) + own[text])
            symbols, counts = self._spell_unknown(*self._symbols(codes, starts, lengths, drawn))
            found.append(symbols)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, edges)]
            for (i, *_), n in zip(held, np.diff(ends).tolist(), strict=True):
                sizes[i] += n
            held, size = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            key, before = (keys[i] if keys else 0) & (1 << 64) - 1, 0
            whole = self.normalize(text)
            at = 0
            while at < len(whole):
                # very long texts go by slices that end before a word
                end = len(whole) if len(whole) - at <= 8 * self.words else re.compile(f"(?<!{MARK}){MARK}").search(whole, at + 8 * self.words)
                end = end if isinstance(end, int) else len(whole) if end is None else end.start()
                part = whole[at:end]
                codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                held.append((i, codes, key, before))
                if end < len(whole):
                    before += len(_WORD.findall(part))
                size += len(codes)
                at = end
                if size > 8 * self.words:
                    flush()
        flush()
        return np.concatenate(found).astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """Texts of the ids between the edges; the space that encoding put first goes."""
        counts = self.spelled_counts[ids]
        starts = (np.cumsum(self.spelled_counts) - self.spelled_counts)[ids]
        out = []
        # by stretches, so that a long text's bytes are not gathered with all others
        raw, ends = _lists(self.spelled, starts, counts)
        data, cuts = raw.tobytes(), ends[edges].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append(data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace"))
        return out


def _ids_array(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian uint32 bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((4 * edges).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())


def encode_pieces(docs: DataFrame, model: str | None = None, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """doc_id, text and ids (little-endian uint32 bytes) of every whole text.

    ``dropout`` 0 gives the library's own ids.  Null and empty texts have no ids; rows that
    repeat a doc_id are encoded each, equal texts under equal doc_ids alike (a null doc_id
    counts as 0); equal scores merge leftmost first; very long texts are encoded by slices
    with the same result; other columns are not read; an empty table gives no rows."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model, seed, dropout)
        for batch in batches:
            ids, edges = code.encode(batch.column(1).to_pylist(), [d or 0 for d in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, _ids_array(ids, edges)], names=["doc_id", "text", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, text string, ids binary")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` (with doc_id, text and ids) and ``decoded``: the text that the ids spell
    (null ids: empty)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model, 0, 0.0)
        for batch in batches:
            raw = [x or b"" for x in batch.column(2).to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
            text = code.decode(np.frombuffer(b"".join(raw), "<u4"), edges)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=["doc_id", "text", "ids", "decoded"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, text string, ids binary, decoded string")


def op1_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian uint32) and lossless: the
    decoded ids equal the text (null: empty)."""
    got = decode_pieces(encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))
