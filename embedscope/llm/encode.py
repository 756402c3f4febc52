"""Encoding whole texts with a public tokenizer file, a word at a time.

Both tokenizer families split a text before their merges, and no part of that
split spans the place where white space follows a word.  A text's ids are
therefore the ids of its chunks, one after the other, and a chunk (mostly a
word) has to be encoded by the library only once; the ids of recent chunks are
kept packed in a dictionary of bounded size.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa

from embedscope.llm.work import release_memory

CACHE_BYTES = 80 << 20  # of each of two generations
ENTRY_BYTES = 170
GROUP_CHARS = 1 << 20

#: Byte-level vocabularies show a byte as a character: printable Latin-1 as
#: itself, the others as U+0100 and up, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_SHOWN_BYTES = np.array([_SHOWN.get(b, b) for b in range(256)], "<u2")
_SHOWN_BYTES[10] = 10  # between words

#: A word of Latin letters: its letters, a sign after it.
_WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc2[\xaa\xb5\xba])+)([.,]?)")
#: 1: space and line end; 2: ASCII letters and digits; 3: the second byte of a Latin
#: letter after 0xC3 (signs of multiplication and division are none).
_KIND = np.zeros(256, np.uint8)
_KIND[[10, 32]] = 1
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 2
_KIND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = 3
_AS_SPACE = bytes(32 if b in b"\t\n\r\x0b\x0c" else b for b in range(256))
_CHUNK = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_UNEVEN = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r")
#: White space other than space, tab and line ends: runs of it may join the
#: space before a chunk, so such texts are encoded whole.
_CONTROL = (b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_OTHER_SPACE = re.compile("[" + "".join(map(chr, (
    0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")


class Encoder:
    """``packed(texts)``: each text's ids as little-endian unsigned integers of
    ``dtype``.

    ``keeps_space``: white space belongs to the following word (byte-level
    vocabularies); else it only separates words and is dropped.  Special tokens
    written out in a text are what the library makes of them, or ordinary text
    with ``plain_specials``.  ``lead_space`` puts a space before each text.
    """

    def __init__(self, path: str, keeps_space: bool, plain_specials: bool = False, lead_space: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        # a text with an added token goes through the library whole
        added = [] if plain_specials else self.tokenizer.get_added_tokens_decoder().values()
        self.added = ["" if t.normalized else t.content for t in added]  # "": any text
        self.lead_space = lead_space
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keeps_space = keeps_space
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        mark = self.tokenizer.encode("\n" if keeps_space else "~", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.line_end = np.array(mark, self.dtype).tobytes()
        self.merges = self.tokenizer.model.tokenize
        self.signs = {c.encode(): array(self.code, [t.id for t in self.merges(c)]).tobytes() for c in ".,"}
        self.recent: dict = {}
        self.older: dict = {}
        self.held = 0

    # A key says which part of a text it stands for: bytes with a leading space or
    # line end for that and a word, a sign for itself after a letter or digit,
    # (0, word) for a word at the start of the text, (1, chunk) for any other chunk.

    def _even(self, text: str) -> bytes | None:
        """The bytes of a text whose words are divided by one space or one line end
        each, with none at the ends; else None."""
        if any(map(text.__contains__, self.added)):
            return None
        data = text.encode("utf-8")
        if not self.keeps_space:
            return data.translate(_AS_SPACE)  # at ASCII white space
        if any(c in data for c in _CONTROL) if data.isascii() else _OTHER_SPACE.search(text):
            return None
        # each gap is one space or one line end, none at the ends
        if data and data[0] not in b" \n" and data[-1] not in b" \n" and not any(g in data for g in _UNEVEN):
            return data
        return None

    def _keys(self, text: str) -> list | None:
        """The keys of any text; None for one that goes through the library whole."""
        if any(map(text.__contains__, self.added)):
            return None
        data = text.encode("utf-8")
        if any(c in data for c in _CONTROL) if data.isascii() else _OTHER_SPACE.search(text):
            return None
        keys = []
        for c in _CHUNK.findall(b" " + data if self.lead_space else data):
            word = c.lstrip(b" \t\n\r")
            gap = c[:len(c) - len(word)]
            if not word or len(gap) > 1 or gap not in (b"", b" ", b"\n") or (not gap and keys):
                keys.append((1, c))
            else:
                keys.append(c if gap else (0, c))
        return keys

    def _library(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in done]

    def _unit(self, key) -> tuple[bytes, bytes, bool]:
        """What precedes the ids of a key's text, the text, and whether marks
        around the text leave its ids alone."""
        if not self.keeps_space:
            return b"", key[1:], b"~" not in key  # the mark is a word of its own
        if type(key) is tuple:  # the mark is a line end
            return b"", key[1], key[0] == 0 and bool(key[1])
        return (self.line_end, key[1:], len(key) > 1) if key[:1] == b"\n" else (b"", key, True)

    def _merged(self, words: list[bytes], space: bool) -> list[bytes]:
        """The ids of words of Latin letters (after a space) straight from the
        library's merges: such a word is one part of the split."""
        if not words:
            return []
        data = (b" " if space else b"") + (b"\n " if space else b"\n").join(words)
        if not self.keeps_space:
            data = data.decode("utf-8").lower().encode("utf-8")
        shown = _SHOWN_BYTES[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le").split("\n")
        tokens = list(map(self.merges, shown))
        ids = array(self.code, [t.id for word in tokens for t in word]).tobytes()
        ends = list(accumulate([len(word) * self.dtype.itemsize for word in tokens]))
        return [ids[i:j] for i, j in zip([0, *ends], ends)]

    def _fresh(self, keys: list) -> dict:
        """The ids of many keys: words of Latin letters with at most one full stop
        or comma after them by the merges, a sign being a part of the split; for
        the rest one text with marks between theirs, whose ids are cut at the marks;
        what marks could touch is encoded alone."""
        found: dict = {}
        units: list = []
        after, bare, signed = [], [], []  # words after a space, others, words with a sign
        get, get_older, match, signs = self.recent.get, self.older.get, _WORD.fullmatch, self.signs
        for k in keys:
            if type(k) is bytes:
                if k[1:].isalpha():  # ASCII letters alone: most of the keys
                    (after if k[0] == 32 else bare).append(k)
                    continue
                if k in signs:
                    found[k] = signs[k]
                    continue
                word = match(k, 1)
            else:
                word = None if k[0] else match(k[1])
            if word is None:
                units.append((k, *self._unit(k)))
                continue
            to = after if type(k) is bytes and k[0] == 32 else bare
            if word[2]:
                alone = (0, word[1]) if type(k) is not bytes else k[:-1]
                ids = get(alone) or get_older(alone)
                if ids is not None:
                    found[k] = ids + signs[word[2]]
                else:  # the word alone is kept as well
                    signed.append((k, alone, signs[word[2]]))
                    to.append(alone)
            else:
                to.append(k)
        after, bare = list(dict.fromkeys(after)), list(dict.fromkeys(bare))
        found.update(zip(after, self._merged([k[1:] for k in after], self.keeps_space)))
        ids = self._merged([k[1] if type(k) is tuple else k[1:] for k in bare], False)
        found.update((k, i if type(k) is tuple else self.line_end + i) for k, i in zip(bare, ids))
        found.update([(k, found[alone] + sign) for k, alone, sign in signed])
        joined = [u for u in units if u[3]] if self.mark is not None else []
        w = self.dtype.itemsize
        for i in range(0, len(joined), 512):
            part = joined[i:i + 512]
            text = (b"\n" if self.keeps_space else b" ~ ").join([u[2] for u in part]).decode("utf-8")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(ids == self.mark)
            if len(at) != len(part) - 1:
                continue
            data = ids.tobytes()
            starts, ends = [0, *((at + 1) * w).tolist()], [*(at * w).tolist(), len(data)]
            found.update({u[0]: u[1] + data[a:b] for u, a, b in zip(part, starts, ends)})
        alone = [u for u in units if u[0] not in found]
        for i in range(0, len(alone), 512):
            part = alone[i:i + 512]
            done = self._library([u[2].decode("utf-8") for u in part])
            found.update({u[0]: u[1] + d for u, d in zip(part, done)})
        return found

    def packed(self, texts: list[str | None]):
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]):
        # many lists and tuples without cycles: seek none until they are gone
        gc.disable()
        try:
            found = self._found(texts)
        finally:
            gc.enable()
        return found

    def _known(self, keys: list) -> list[bytes]:
        """The ids of each key, kept or new."""
        recent, older = self.recent, self.older
        found = list(map(recent.get, keys))
        holes = []
        wanted: dict = {}
        for i in [i for i, v in enumerate(found) if v is None]:
            k = keys[i]
            v = older.get(k)
            if v is None:
                holes.append((i, k))
                wanted[k] = None
            else:
                found[i] = recent[k] = v
                self.held += len(k) + len(v) + ENTRY_BYTES
        if wanted:
            fresh = self._fresh(list(wanted))
            for i, k in holes:
                found[i] = fresh[k]
            recent.update(fresh)
            self.held += sum(map(len, fresh)) + sum(map(len, fresh.values())) + ENTRY_BYTES * len(fresh)
        if self.held > CACHE_BYTES:
            self.recent, self.older, self.held = {}, recent, 0
        return found

    def _found(self, texts: list[str]) -> list[bytes]:
        even = [self._even(t) for t in texts]
        keys, which, sizes = distinct([e for e in even if e is not None], b"".join(self.signs))
        if self.keeps_space and not self.lead_space:  # the first word of a text has no space before it
            first = np.cumsum(sizes) - sizes
            starts = [(0, keys[i][1:]) for i in which[first].tolist()]
            which[first] = np.arange(len(keys), len(keys) + len(starts))
            keys += starts
        at = len(keys)
        odd = [self._keys(t) if e is None else () for t, e in zip(texts, even)]
        for more in odd:
            keys += more or ()
        found = self._known(keys)
        # the ids of the words of even texts, one text after the other
        w = self.dtype.itemsize
        pool = np.frombuffer(b"".join(found[:at]), self.dtype)
        lengths = np.fromiter(map(len, found[:at]), np.int64, at) // w
        starts = np.cumsum(lengths) - lengths
        each = lengths[which]
        ends = np.cumsum(each)
        data = pool[np.repeat(starts[which] - (ends - each), each) + np.arange(len(pool) and int(each.sum()))].tobytes()
        stops = iter((np.concatenate([[0], ends])[np.cumsum(sizes)] * w).tolist())
        out, done = [], 0
        for t, e, more in zip(texts, even, odd):
            if e is not None:
                start, done = done, next(stops)
                out.append(data[start:done])
            elif more is None:
                out += self._library([" " + t if self.lead_space else t])
            else:
                out.append(b"".join(found[at:at + len(more)]))
                at += len(more)
        return out


def distinct(texts: list[bytes], signs: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(keys, which, sizes)`` of even texts, each after a space: the distinct keys,
    the place among them of each key of each text, and the keys of each text.  A sign
    after an ASCII letter or digit or a Latin letter, at the end of a word, is a key of
    its own: both vocabularies' splits part it from what precedes it."""
    data = b"".join([b" " + t for t in texts])
    at = np.frombuffer(data, np.uint8)
    cut = _KIND[at] == 1
    if signs and len(at):
        sign = np.flatnonzero(np.isin(at, np.frombuffer(signs, np.uint8)) & np.append(cut[1:], True))
        kind = _KIND[at[sign - 1]]
        sign = sign[(kind == 2) | ((kind == 3) & (at[sign - 2] == 0xC3))]
        cut[sign] = True
    starts = np.flatnonzero(cut)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return (words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64),
            np.diff(np.searchsorted(starts, first)))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, keeps_space: bool, plain_specials: bool = False, lead_space: bool = False) -> Encoder:
    """This worker process's encoder for a vocabulary file."""
    key = (path, keeps_space, plain_specials, lead_space)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def forget() -> None:
    """Drops this worker process's encoders: workers are reused, and the caches
    of a finished stage would stay beside what the next stage needs.  Operators
    that encode nothing call it at the start of a task."""
    if _encoders:
        _encoders.clear()
        release_memory()
