"""Token ids of whole texts by a public tokenizer, with a memory for words.

Both vocabularies never merge across a single blank between two other
characters, nor from a Latin letter to a common mark, so a text is cut there,
each distinct cut is encoded once by the tokenizers library, and the ids are
joined. The cuts of many texts are found in their bytes, Arrow numbers the
distinct ones, and the ids are gathered by number, so Python sees each distinct
cut of a batch once. A letter and any ASCII mark are parted. Where blanks count,
texts with white space other than blank, tab and line ends are encoded as a
whole; where they are dropped, so is such a cut alone. Texts with the string of
a special token are encoded as a whole; such a string gives the special token's
id, as the library's plain call does.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa

from squelch.llm.shared import forgettable, text_buffer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_MARKS = ".,;:!?"
_RARE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_RUN = re.compile(r"[ \t\r\n]{2,}")
#: Stands between words that are encoded in one call: a private character, or a line end where that has an id.
_MARK = "\ue000"
_PRIVATE = re.compile("[\ue000-\uefff]")
_CALL = 20_000
#: Units of letters or marks that stand in one string for the merges: a string for each costs half as much again.
_JOINT = 30
_PLAIN = re.compile(f" ?[{_LETTERS}]+|[{_MARKS}]+")


def _flags(of: bytes | str) -> np.ndarray:
    """True for these bytes."""
    found = np.zeros(256, bool)
    found[list(of.encode() if isinstance(of, str) else of)] = True
    return found


_WHITE, _ASCII_MARKS = _flags(" \t\r\n"), _flags(string.punctuation)
#: Bytes that begin white space of ``_RARE``.
_RARE_BYTES = _flags(b"\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")


def _latin_ends() -> np.ndarray:
    """True at 256 times a byte plus the next one if a Latin letter ends with them."""
    found = np.zeros((256, 256), bool)
    for letter in filter(re.compile(f"[{_LETTERS}]").match, map(chr, range(0x250))):
        *lead, last = letter.encode()
        found[lead or slice(None), last] = True
    return found.ravel()


_LATIN_ENDS = _latin_ends()
#: Where white space is dropped: any is a blank; ASCII capitals are small too.
_BLANKED = bytes.maketrans(b"\t\r\n", b"   ")
_LOWERED = _BLANKED.lower()
_MARKED = _ASCII_MARKS.tobytes()


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def _with_last_letters(model: str, letters: dict[int, str]) -> tuple[dict[str, int], list[tuple[str, str]], list[int]]:
    """Vocabulary and merges in which a word's last letter is a letter of its own instead of the letter and a suffix; the ids that end with one.

    No merge goes beyond such a letter, so words can follow each other in one string.
    """
    held = json.loads(model)["model"]
    suffix = held["end_of_word_suffix"]
    last = {letter: chr(_LAST + b) for b, letter in letters.items()}

    def renamed(token: str) -> str:
        stem = token.removesuffix(suffix)
        return token if stem == token else stem[:-1] + last[stem[-1]]

    vocab = {renamed(token): i for token, i in held["vocab"].items()}
    merges = [tuple(map(renamed, x.split(" ") if isinstance(x, str) else x)) for x in held["merges"]]
    return vocab, merges, [i for token, i in held["vocab"].items() if token.endswith(suffix)]


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ids, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.arange(sizes.sum()) + np.repeat(starts - (ends - sizes), sizes)]


#: Last letters begin here, in the private use area.
_LAST = 0xE000
#: Cuts that a process remembers before it forgets the older half (some 200 bytes each), unless the caller says otherwise; the longest of them.
MEMORY, LONGEST = 400_000, 48


class Encoder:
    """ids as little-endian uint32 bytes, equal to the library's for the whole text (``add_special_tokens=False``)."""

    def __init__(self, path: str, room: int = MEMORY):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.room = room
        self.tokenizer = Tokenizer.from_file(path)
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.IGNORECASE)
        self.hint = re.match(r"[^\w\s]*", os.path.commonprefix(special))[0]  # marks that all of them begin with
        self.blanks_count = "Split" not in str(self.tokenizer.pre_tokenizer)
        letters = _byte_letters()
        self.codes = np.array([ord(letters[b]) for b in range(256)], "<u4")
        # The merges alone: their input is cut and mapped already. A word ends where the id is one of ``ends``.
        self.suffixed = bool(self.tokenizer.model.end_of_word_suffix)
        if self.suffixed:
            vocab, merges, ends = _with_last_letters(self.tokenizer.to_str(), letters)
            self.units = Tokenizer(BPE(vocab=vocab, merges=merges))
        else:
            self.units = Tokenizer(self.tokenizer.model)
            vocab, ends = self.units.get_vocab(), [self.units.token_to_id(letters[0])]
            if sum(letters[0] in token for token in vocab) != 1:
                raise ValueError("the character 0 isn't a token of its own")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[ends] = True
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Where white space is dropped: the cuts that are remembered, by number; where their ids begin in ``ids``, how many, how often used.
        self.known = pa.array([], pa.large_string())
        self.ids, self.starts, self.sizes, self.uses = np.zeros(0, "<u4"), *np.zeros((3, 0), np.int64)

    def wholes(self, raw: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts that have to be encoded as a whole."""
        rare = np.flatnonzero(_RARE_BYTES[raw])
        two = raw[rare] == 0xC2
        two[two] = ~np.isin(raw[rare[two] + 1], [0x85, 0xA0])  # nothing rare
        hints = [m.start() for m in re.finditer(re.escape(self.hint.encode()), raw.tobytes())]
        found = np.unique(np.searchsorted(offsets, np.concatenate([rare[~two], np.array(hints, np.int64)]), "right") - 1)
        texts = ((k, raw[offsets[k] : offsets[k + 1]].tobytes().decode()) for k in found[found < len(offsets) - 1].tolist())
        return [k for k, x in texts if _RARE.search(x) or self.special.search(x)]

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the cuts of texts begin, in bytes, if blanks count.

        A run of white space is a cut, but for its last character where
        something follows: a blank begins what follows it, others stand alone.
        """
        n = len(raw)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        white, begins = _WHITE[raw], first[:n].copy()
        begins[1:] |= white[1:] & ~white[:-1]
        begins[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]
        begins[1:] |= ~white[1:] & white[:-1] & (raw[:-1] != 0x20)
        marks = np.flatnonzero(_ASCII_MARKS[raw])
        marks = marks[marks > 0]
        begins[marks[_LATIN_ENDS[raw[marks - 2].astype(np.uint16) << 8 | raw[marks - 1]]]] = True
        for k in self.wholes(raw, offsets):
            begins[offsets[k] + 1 : offsets[k + 1]] = False
        return np.flatnonzero(begins)

    def bare_cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The cuts of texts if white space is dropped, ASCII letters small, and the number of each text's.

        An ASCII letter stays as it is in texts with combining marks, as a small
        one may compose where the capital doesn't.
        """
        n, held = len(raw), raw.tobytes()
        low = np.frombuffer(held.translate(_LOWERED), np.uint8)
        hints = [m.start() for m in re.finditer(re.escape(self.hint.encode()), held)]
        whole = [(a, b) for a, b in self.spans(hints, offsets) if self.special.search(held[a:b].decode())]
        marked = self.spans(np.flatnonzero((raw == 0xCC) | (raw == 0xCD)), offsets)
        if whole or marked:
            low = low.copy()
        for a, b in marked:
            low[a:b] = np.frombuffer(held[a:b].translate(_BLANKED), np.uint8)
        white = low == 0x20
        begins = ~white
        begins[1:] &= white[:-1]
        firsts = offsets[offsets < n]
        begins[firsts] = ~white[firsts]
        marks = np.flatnonzero(np.frombuffer(low.tobytes().translate(_MARKED), bool))
        marks = marks[marks > 0]
        begins[marks[_LATIN_ENDS[low[marks - 2].astype(np.uint16) << 8 | low[marks - 1]]]] = True
        # A letter after a mark, but for the apostrophe, which may begin a token with it.
        marks = marks[(marks < n - 2) & (low[marks] != 0x27)]
        one, two = low[marks + 1], low[marks + 2]
        begins[marks[_LATIN_ENDS[one] | (one >= 0xC3) & _LATIN_ENDS[one.astype(np.uint16) << 8 | two]] + 1] = True
        for a, b in whole:
            low[a:b], white[a:b], begins[a:b] = raw[a:b], False, False
            begins[a] = True
        keep = ~white
        data, at = low[keep], np.append(np.flatnonzero(begins[keep]), np.count_nonzero(keep))
        cuts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        return cuts, np.diff(np.searchsorted(np.flatnonzero(begins), offsets))

    @staticmethod
    def spans(places: Iterable[int], offsets: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of the texts that hold these places."""
        found = np.unique(np.searchsorted(offsets, np.asarray(places, np.int64), "right") - 1)
        return list(zip(offsets[found].tolist(), offsets[found + 1].tolist(), strict=True))

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units of Latin letters or marks alone, where each one's begin and end: the merges run over them, many in a string, without pre-tokenizing."""
        joint = "\0".join(words) + "\0"
        raw = np.frombuffer((joint if self.blanks_count else joint.lower()).encode(), np.uint8)
        points, zeros = self.codes[raw], np.flatnonzero(raw == 0)
        stops = zeros + 1
        if self.suffixed:
            points[zeros - 1] = raw[zeros - 1].astype("<u4") + _LAST
            points, stops = np.delete(points, zeros), zeros - np.arange(len(zeros))
        mapped = points.tobytes().decode("utf-32-le")
        units = [mapped[a:b] for a, b in pairwise([0, *stops[_JOINT - 1 : -1 : _JOINT].tolist(), len(mapped)])]
        ids = np.array(self.units.encode_batch_fast([units], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):
            raise ValueError("units can't be told apart")
        return ids, np.append(0, ends[:-1] + 1), ends + self.suffixed

    def learn_plain(self, words: list[str]) -> None:
        ids, begins, ends = self.merged(words)
        self.memory.update(zip(words, map(ids.tobytes().__getitem__, map(slice, (4 * begins).tolist(), (4 * ends).tolist()))))

    def learn(self, words: list[str]) -> None:
        """Encodes words many at a time: a call for each word costs ten times as much."""
        plain = list(filter(_PLAIN.fullmatch, words))
        for k in range(0, len(plain), _CALL):
            self.learn_plain(plain[k : k + _CALL])
        words = [x for x in words if x not in self.memory]
        alone = [x for x in words if _PRIVATE.search(x) or _RARE.search(x) or _RUN.search(x) or "\n" in x or not x.strip() or self.hint in x and self.special.search(x)]
        for x in alone:
            self.memory[x] = self.whole(x)
        skip = set(alone)
        words = [x for x in words if x not in skip]
        between = "\n" if self.blanks_count else f" {_MARK} "
        mark = np.array(self.tokenizer.encode(between, add_special_tokens=False).ids, "<u4")
        for k in range(0, len(words), _CALL):
            some = words[k : k + _CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            hit = ids[: len(ids) - len(mark) + 1] == mark[0]
            for j in range(1, len(mark)):
                hit &= ids[j : len(ids) - len(mark) + 1 + j] == mark[j]
            at = np.flatnonzero(hit)
            if len(at) != len(some) - 1:
                raise ValueError("a word's ids can't be told from those of the mark")
            raw, begin = ids.tobytes(), 0
            for x, end in zip(some, [*at.tolist(), len(ids)], strict=True):
                self.memory[x] = raw[4 * begin : 4 * end]
                begin = end + len(mark)

    def unknown(self, words: set[str]) -> set[str]:
        """Those that aren't remembered; what only the older half holds moves to the newer one."""
        missing = words.difference(self.memory)
        again = {x: self.older[x] for x in missing if x in self.older}
        self.memory.update(again)
        return missing.difference(again)

    def turn(self) -> None:
        """Forgets the older half when the newer one is full."""
        if 2 * len(self.memory) > self.room:
            self.memory, self.older = {}, self.memory

    def forget_long(self, words: Iterable[str]) -> None:
        for x in words:
            if len(x) > LONGEST:
                self.memory.pop(x, None)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of each text's."""
        if not self.blanks_count:
            return self.encode_bare(column)
        self.turn()
        raw, offsets = text_buffer(column)
        begins = self.cuts(raw, offsets)
        cut = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(np.append(begins, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        words, of = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), cut.indices.to_numpy()
        known = list(map(self.memory.get, words))
        new = [k for k, x in enumerate(known) if x is None]
        missing = self.unknown({words[k] for k in new})
        self.learn(list(missing))
        for k in new:
            known[k] = self.memory[words[k]]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        self.forget_long(missing)
        counts = sizes[of]
        ends = np.append(0, np.cumsum(counts))
        return _gathered(ids, starts[of], counts), np.diff(ends[np.searchsorted(begins, offsets)])

    def encode_bare(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_column``, if white space is dropped: Arrow numbers the remembered cuts first, so only those after them are new."""
        cuts, texts = self.bare_cuts(*text_buffer(column))
        numbered = pa.concat_arrays([self.known, cuts]).dictionary_encode()
        words, of = numbered.dictionary, numbered.indices.to_numpy()[len(self.known) :]
        ids, starts, sizes = self.encode_cuts(words.slice(len(self.known)).to_pylist())
        ids, starts, sizes = np.append(self.ids, ids), np.append(self.starts, starts + len(self.ids)), np.append(self.sizes, sizes)
        counts = sizes[of]
        ends = np.append(0, np.cumsum(counts))
        uses = np.bincount(of, minlength=len(words))
        uses[: len(self.known)] += self.uses
        self.keep(words, ids, starts, sizes, uses)
        return _gathered(ids, starts[of], counts), np.diff(ends[np.append(0, np.cumsum(texts))])

    def encode_cuts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct cuts, where each one's begin and how many they are."""
        starts, sizes, made, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, "<u4")], 0
        plain = [k for k, x in enumerate(words) if _PLAIN.fullmatch(x)]
        for k in range(0, len(plain), _CALL):
            some = plain[k : k + _CALL]
            ids, begins, ends = self.merged([words[j] for j in some])
            starts[some], sizes[some] = at + begins, ends - begins
            made.append(ids)
            at += len(ids)
        others = np.setdiff1d(np.arange(len(words)), plain).tolist()
        if others:
            self.learn([words[j] for j in others])
            each = [self.memory.pop(words[j]) for j in others]
            sizes[others] = np.fromiter(map(len, each), np.int64, len(each)) // 4
            starts[others] = at + np.cumsum(sizes[others]) - sizes[others]
            made.append(np.frombuffer(b"".join(each), "<u4"))
        return np.concatenate(made), starts, sizes

    def keep(self, words: pa.Array, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, uses: np.ndarray) -> None:
        """Remembers these cuts but for long ones; the most used half of the room where they are too many."""
        stay = np.flatnonzero(np.diff(text_buffer(words)[1]) <= LONGEST)
        if len(stay) > self.room:
            stay = np.sort(stay[np.argpartition(uses[stay], -(self.room // 2))[-(self.room // 2) :]])
            uses = uses // 2
        if len(stay) < len(words):
            words, starts, sizes, uses = words.take(pa.array(stay)), starts[stay], sizes[stay], uses[stay]
            ids, starts = _gathered(ids, starts, sizes), np.cumsum(sizes) - sizes
        self.known, self.ids, self.starts, self.sizes, self.uses = words, ids, starts, sizes, uses

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        ids, counts = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        return [raw[a:b] for a, b in pairwise(ends)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}
forgettable(_encoders.clear)


def encoder(path: str, room: int = MEMORY) -> Encoder:
    """One for each path and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, room)
    return _encoders[path]
