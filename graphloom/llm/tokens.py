"""Token ids of whole texts by the tokenizers library, with a memo of its words.

The byte-level pre-tokenizer cuts a text into words that are encoded one by one, so the ids of a
word don't depend on its neighbours.  ``Encoder`` cuts likewise, a batch of texts at a time over arrays of their
bytes, and asks the library for each word it doesn't remember.  A file with a normalizer or another pre-tokenizer
has whole texts encoded by the library, and so has a text that holds one of the file's added tokens.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import common

FILE = "byte_bpe_50k.json"
_SPACE = r"\t-\r \x85\xa0  -     　"
BLANK, LETTER, NUMBER, OTHER = range(4)
_APOSTROPHE = ord("'")
#: What an apostrophe at the beginning of a word takes with it.
_ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
#: A word of up to so many bytes is its own key: two numbers, the upper one with the length in its highest byte.
KEY = 15
_KEEP = [np.array([(1 << 8 * min(max(n - first, 0), 8)) - 1 for n in range(KEY + 1)], np.uint64) for first in (0, 8)]
_LENGTH = np.arange(KEY + 1, dtype=np.uint64) << np.uint64(56)
#: Longer words are remembered up to so many bytes, as objects, so fewer by so many times.
LONG, LONG_SHARE = 64, 4
#: Words looked up at once.
RUN = 1 << 17
_tables: dict[str, np.ndarray] = {}


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(FILE)


def _cuts_words(tokenizer) -> bool:
    """Whether a tokenizer cuts texts as ``word_starts`` does, and encodes what it cuts apart from the rest."""
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return False
    cut = json.loads(tokenizer.pre_tokenizer.__getstate__())
    return cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]


def _kinds_of(name: str, first: int, end: int) -> np.ndarray:
    """Kind of each code point of a range."""
    if name not in _tables:
        signs = "".join(map(chr, range(first, end)))
        kinds = np.full(end - first, OTHER, np.uint8)
        for kind, pattern in ((BLANK, rf"[{_SPACE}]+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, signs):
                kinds[m.start() : m.end()] = kind
        _tables[name] = kinds
    return _tables[name]


def _kinds(raw: np.ndarray) -> np.ndarray:
    """Kind of the character of each byte, slice by slice to bound the memory of a long text."""
    ascii_kinds = np.concatenate([_kinds_of("ascii", 0, 128), np.full(128, OTHER, np.uint8)])
    out, first = np.empty(len(raw), np.uint8), 0
    while first < len(raw):
        end = min(first + common.SLICE_BYTES, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        part, kinds = raw[first:end], out[first:end]
        np.take(ascii_kinds, part, out=kinds)
        lead = np.flatnonzero(part >= 0xC0)
        if len(lead):
            padded = np.concatenate([part, np.zeros(3, np.uint8)])
            head, two = part[lead].astype(np.int32), padded[lead + 1].astype(np.int32) & 63
            if head.max() < 0xE0:
                kinds[lead] = kinds[lead + 1] = _kinds_of("two bytes", 0, 0x800)[(head & 31) << 6 | two]
            else:
                three, four = (padded[lead + i].astype(np.int32) & 63 for i in (2, 3))
                code = np.where(head < 0xE0, (head & 31) << 6 | two, np.where(head < 0xF0, (head & 15) << 12 | two << 6 | three, (head & 7) << 18 | two << 12 | three << 6 | four))
                kind = _kinds_of("all", 0, 0x110000)[code]
                for i, least in enumerate((0, 0, 0xE0, 0xF0)):
                    longer = head >= least
                    kinds[lead[longer] + i] = kind[longer]
        first = end
    return out


def word_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the words begin that the byte-level pre-tokenizer cuts texts into.

    ``raw``: the bytes of the texts, end to end; ``ends``: 0 and where each ends.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    kinds = _kinds(raw)
    starts, begins = np.empty(n + 1, bool), np.zeros(n + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:n])
    begins[ends] = True
    starts |= begins  # both also hold the end
    # The last of some blanks before a word is a word of its own, or, if a space, belongs to that word.
    after = np.flatnonzero(starts[1:n] & (kinds[:-1] == BLANK) & ~begins[1:n]) + 1
    last = after - 1
    while (inside := raw[last] & 0xC0 == 0x80).any():
        last = last - inside
    starts[last] = True
    starts[after[raw[last] == 32]] = False
    # Endings of words.
    at = np.flatnonzero((raw[:-1] == _APOSTROPHE) & starts[: n - 1] & ~begins[1:n] & (kinds[1:] == LETTER))
    if len(at):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        one, two, whole = padded[at + 1], padded[at + 2], ~begins[np.minimum(at + 2, n)]
        for ending in _ENDINGS:
            found = at[(one == ending[0]) & ((two == ending[1]) & whole if len(ending) > 1 else True)]
            starts[found + 1] = False
            starts[found + 1 + len(ending)] = True
    return np.flatnonzero(starts[:n])


class _Memo:
    """Keys of words, open-addressed: (lower key, upper key, value); upper key 0 is free."""

    def __init__(self):
        self.rows, self.bits, self.table = 0, 12, np.zeros((1 << 12, 3), np.uint64)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (common.mix64(low ^ (high * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of keys, 0 for those that aren't there."""
        slots = self._slots(low, high)
        rows = self.table[slots]
        out = np.where((rows[:, 0] == low) & (rows[:, 1] == high), rows[:, 2], 0)
        left = np.flatnonzero((out == 0) & (rows[:, 1] != 0))
        slots, low, high = slots[left], low[left], high[left]
        while len(left):
            slots = (slots + 1) & (len(self.table) - 1)
            rows = self.table[slots]
            same = (rows[:, 0] == low) & (rows[:, 1] == high)
            out[left[same]] = rows[same, 2]
            on = ~same & (rows[:, 1] != 0)
            left, slots, low, high = left[on], slots[on], low[on], high[on]
        return out

    def put(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Add keys that aren't there, each once."""
        self.rows += len(low)
        if 2 * self.rows > len(self.table):
            old = self.table[self.table[:, 1] != 0]
            while 2 * self.rows > 1 << self.bits:
                self.bits += 1
            self.table = np.zeros((1 << self.bits, 3), np.uint64)
            self._fill(old)
        self._fill(np.stack([low, high, value], 1))

    def _fill(self, rows: np.ndarray) -> None:
        slots = self._slots(rows[:, 0], rows[:, 1])
        while len(rows):
            free = np.flatnonzero(self.table[slots, 1] == 0)
            self.table[slots[free]] = rows[free]  # of some that met in one slot the last stays
            on = (self.table[slots, 0] != rows[:, 0]) | (self.table[slots, 1] != rows[:, 1])
            rows, slots = rows[on], (slots[on] + 1) & (len(self.table) - 1)


class Encoder:
    """Ids of texts as arrays of ``dtype``; ``memo`` words are remembered (a quarter of that of long ones), those met first.

    A remembered word takes 48 to 96 bytes, a long one about 250.
    """

    def __init__(self, path: str | None = None, memo: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = _cuts_words(self.tokenizer)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # by the byte-level alphabet, a sign is a byte
        self.memo, self.long, self.most = _Memo(), {}, memo
        self.pool, self.used = np.empty(1 << 12, self.dtype), 1  # ids of words; a value is (first id << 32 | ids), never 0

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype)

    def _ask(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, list[int]]:
        """(the words in another order, their ids end to end, ids of each), by the library.

        Words of a blank and letters are encoded end to end, since the pre-tokenizer parts them again, and told apart by
        the bytes that ids stand for; a run for which that doesn't come out, and all other words, are encoded one by one.
        """
        plain, single = [], []
        for word in words:
            (plain if word[:1] == b" " and word[1:].decode().isalpha() else single).append(word)
        order, parts, counts = [], [np.empty(0, self.dtype)], []
        for a in range(0, len(plain), 256):
            some = plain[a : a + 256]
            joined = b"".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, self.dtype)
            cuts, ends = np.cumsum(self.bytes_of[ids]), np.cumsum([len(w) for w in some])
            last = np.searchsorted(cuts, ends)
            if len(cuts) and cuts[-1] == ends[-1] and (cuts[last] == ends).all() and not any(s in joined for s in self.specials):
                order += some
                parts.append(ids)
                counts += np.diff(last, prepend=-1).tolist()
            else:
                single += some
        for a in range(0, len(single), 4096):
            some = single[a : a + 4096]
            order += some
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            counts += map(len, found)
            parts.append(np.array([i for ids in found for i in ids], self.dtype))
        return order, np.concatenate(parts), counts

    def _learn(self, words: dict[bytes, int], low: np.ndarray, high: np.ndarray) -> dict[bytes, int]:
        """Values of new words, good until more are learned; as many as there is room for are remembered.

        ``words`` have the place of their keys in ``low`` and ``high``.
        """
        short, long = [w for w in words if len(w) <= KEY], [w for w in words if KEY < len(w) <= LONG]
        keep = dict.fromkeys(short[: max(0, self.most - self.memo.rows)] + long[: max(0, self.most // LONG_SHARE - len(self.long))])
        out, end = {}, self.used
        for some, stay in ((list(keep), True), ([w for w in words if w not in keep], False)):
            some, ids, counts = self._ask(some)
            while end + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[end : end + len(ids)] = ids
            n = np.array(counts, np.int64)
            values = ((end + np.cumsum(n) - n) << 32 | n).tolist()
            out.update(zip(some, values))
            end += len(ids)
            if stay:
                self.long.update((w, v) for w, v in zip(some, values) if len(w) > KEY)
                at = [words[w] for w in some if len(w) <= KEY]
                self.memo.put(low[at], high[at], np.array([v for w, v in zip(some, values) if len(w) <= KEY], np.uint64))
                self.used = end
        return out

    def _ids(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words end to end, ids of each)."""
        wide = np.zeros(len(raw) // 8 + 4, np.uint64)
        wide.view(np.uint8)[: len(raw)] = raw
        at, down, size = starts >> 3, (starts & 7).astype(np.uint64) << np.uint64(3), np.minimum(lengths, KEY)
        up, one = np.uint64(64) - down, wide[at + 1]  # numpy gives 0 for a number shifted by 64
        low = (wide[at] >> down | one << up) & _KEEP[0][size]
        high = (one >> down | wide[at + 2] << up) & _KEEP[1][size] | _LENGTH[size]
        values = self.memo.find(low, high)
        values[lengths > KEY] = 0
        missing = np.flatnonzero(values == 0)
        if len(missing):
            data, new = raw.tobytes(), {}
            words = [data[a:b] for a, b in zip(starts[missing].tolist(), (starts + lengths)[missing].tolist())]
            for word, i in zip(words, missing.tolist()):
                if word not in self.long:
                    new[word] = i
            found = self._learn(new, low, high) if new else {}
            values[missing] = [found[w] if w in found else self.long[w] for w in words]
        counts = (values & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.cumsum(counts)
        return self.pool[np.repeat((values >> np.uint64(32)).astype(np.int64) - ends + counts, counts) + np.arange(ends[-1])], counts

    def _batch(self, raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that stand end to end; ``ends``: 0 and where each ends."""
        data, n = raw.tobytes(), len(ends) - 1
        marked = set() if self.by_word else {*range(n)}
        for mark in self.specials if self.by_word else []:
            at = data.find(mark)
            while at >= 0:
                i = int(np.searchsorted(ends, at, "right")) - 1
                if at + len(mark) <= ends[i + 1]:  # a mark inside a text is the library's business
                    marked.add(i)
                    at = data.find(mark, int(ends[i + 1]))
                else:
                    at = data.find(mark, at + 1)
        if marked:
            texts = [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            other = [t for i, t in enumerate(texts) if i not in marked]
            plain = iter(self._batch(np.frombuffer(b"".join(other), np.uint8), np.cumsum([0, *map(len, other)])) if other else [])
            return [self._whole(t) if i in marked else next(plain) for i, t in enumerate(texts)]
        starts = word_starts(raw, ends)
        if not len(starts):
            return [np.empty(0, self.dtype)] * n
        lengths, parts, counts = np.diff(starts, append=len(raw)), [], [np.zeros(1, np.int64)]
        for a in range(0, len(starts), RUN):
            some = slice(a, a + RUN)
            ids, each = self._ids(raw[starts[a] : starts[some][-1] + lengths[some][-1]], starts[some] - starts[a], lengths[some])
            parts.append(ids)
            counts.append(each)
        ids, cuts = np.concatenate(parts), np.cumsum(np.concatenate(counts))[np.searchsorted(starts, ends)].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text (a null is empty)."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        return [ids for _, raw, ends in common.text_slices(column) for ids in self._batch(raw, ends)]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process: a Python worker keeps it from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def batches(frames, column: int, target: int = 1 << 20):
    """(frame, first row, texts) in runs of whole texts, of about ``target`` bytes."""
    for frame in frames:
        texts, first = frame.column(column), 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + target, "right")))
            yield frame, first, texts.slice(first, last - first)
            first = last
