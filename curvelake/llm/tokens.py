"""Exact token ids by the public tokenizers: each distinct span of a batch is encoded once, the rest is gathered in numpy.

Both vocabularies may be cut before a blank that a character other than white space follows. A part between two such
places that has only letters, runs of MARKS, and single line feeds is cut between those as well; any other part
is one span. Spans are the library's own pieces, or whole runs of them, so their ids stand one after the other. New
spans go to the library in batches, and a memo bounded in bytes keeps the short ones.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa

from curvelake.llm import common

#: Bytes that one memo of a Python worker may hold, of both generations; the longest key it keeps; bytes of an entry
#: beside key and value.
MEMO, LONGEST, ENTRY = 128 << 20, 64, 170
#: Bytes of text that are cut into spans together, and spans in one string for the library.
SLICE, JOINED = 8 << 20, 400
ODD, LETTER, MARK, FEED = range(4)
#: Runs of these are pieces of both vocabularies, and no special token has one.
MARKS = ".,!#$%&*"
KIND = np.zeros(256, np.uint8)
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3]] = LETTER
KIND[[*map(ord, MARKS)]] = MARK
KIND[ord("\n")] = FEED
#: Second bytes of Latin-1 letters after 0xC3.
SECOND = np.zeros(256, bool)
SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: First bytes of characters that are never white space.
SOLID = np.ones(256, bool)
SOLID[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[.,!#$%&*]+)").fullmatch


class Memo(dict):
    """Keeps what ``make`` gave for short keys. Once the younger generation holds half of ``most`` bytes it becomes the
    older one, whose entries are dropped unless they are asked for before the next change."""

    def __init__(self, make: Callable, most: int = MEMO) -> None:
        super().__init__()
        self.make, self.most, self.held, self.old = make, most, 0, {}

    def keep(self, keys: list, values: list[bytes]) -> None:
        short = [len(k) <= LONGEST for k in keys]
        keys, values = list(compress(keys, short)), list(compress(values, short))
        self.update(zip(keys, values, strict=True))
        self.held += ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, values))
        if self.held > self.most // 2:
            self.old, self.held = dict(self), 0
            self.clear()

    def __missing__(self, key) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self[key] = value
            self.held += ENTRY + len(key) + len(value)
            if self.held > self.most // 2:
                self.keep([], [])
        return value

    def many(self, keys: list) -> list[bytes]:
        """The values of distinct keys; ``make`` gets the list of those that aren't kept."""
        out = list(map(self.get, keys))
        lacking = [i for i, v in enumerate(out) if v is None]
        asked = [keys[i] for i in lacking]
        found = list(map(self.old.get, asked))
        new = [j for j, v in enumerate(found) if v is None]
        for j, v in zip(new, self.make([asked[j] for j in new]), strict=True):
            found[j] = v
        for i, v in zip(lacking, found, strict=True):
            out[i] = v
        self.keep(asked, found)
        return out


def byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: printable ones as they are, others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def spans(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the spans of texts begin, and the end; ``at``: where the texts begin, and the end."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    kind = KIND[data]
    pair = np.flatnonzero(data[:-1] == 0xC3) + 1
    kind[pair[SECOND[data[pair]]]] = LETTER
    inside = np.ones(n + 1, bool)  # whether a byte has one before it in its text
    inside[at] = False
    blank = np.flatnonzero((data[:-1] == 0x20) & SOLID[data[1:]] & inside[1:n])
    odd = kind == ODD
    odd[blank] = False
    feeds = np.flatnonzero(data == 0x0A)
    odd[feeds[1:][np.diff(feeds) == 1]] = True
    kind[blank] = kind[blank + 1]
    begins = ~inside
    begins[blank] = True
    parts = np.flatnonzero(begins[:n])
    plain = np.repeat(~np.logical_or.reduceat(odd, parts), np.diff(np.append(parts, n)))
    begins[1:n] |= (kind[1:] != kind[:-1]) & plain[1:]
    return np.flatnonzero(begins)


def split(values: pa.Array) -> list[bytes]:
    """The values of a binary array that isn't a slice of another, without a scalar for each."""
    _, offsets, data = values.buffers()
    if not len(values) or data is None:
        return [b""] * len(values)
    at, data = np.frombuffer(offsets, np.int32, len(values) + 1).tolist(), data.to_pybytes()
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


def slices(data: np.ndarray, at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: first text, number of texts, where they begin and end. A longer text comes
    in several slices of itself, cut before a blank and a letter."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        begin = int(at[i])
        while at[j] - begin > 2 * most:  # one text
            window = data[begin + most : begin + 2 * most]
            cut = np.flatnonzero((window[:-1] == 0x20) & (KIND[window[1:]] == LETTER))
            if not len(cut):
                break
            yield i, 1, np.array([begin, begin + most + int(cut[0])])
            begin += most + int(cut[0])
        yield i, j - i, np.concatenate([[begin], at[i + 1 : j + 1]])
        i = j


class Encoder:
    """Ids of whole texts. ``joined``: a blank belongs to the word after it (else white space is dropped)."""

    def __init__(self, path: str, joined: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)  # for spans that are pieces: without the search for pieces
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.joined = joined
        self.characters = byte_characters() | {ord("\n"): " "}
        self.bytes = np.zeros(size, np.int64)  # that a token stands for
        self.bytes[list(vocabulary.values())] = [len(t.removesuffix("</w>")) if not joined else len(t) for t in vocabulary]
        self.memo = Memo(self.new)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind.char, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def new(self, keys: list[bytes]) -> list[bytes]:
        """Ids of spans. Words and marks go to the model many at once, as the characters that stand for their bytes; the
        tokens' bytes show where each ends."""
        out: list[bytes] = [b""] * len(keys)
        simple = list(map(bool, map(PLAIN, keys)))
        plain = [i for i, x in enumerate(simple) if x]
        size = self.kind.itemsize
        for group in (plain[i : i + JOINED] for i in range(0, len(plain), JOINED)):
            own = [keys[i] for i in group] if self.joined else [keys[i].lstrip() for i in group]
            text = b"\n".join(own)
            if not self.joined:
                text = text.decode().lower().encode()
            ids = array(self.kind.char, self.model.encode_batch_fast([text.decode("latin-1").translate(self.characters)])[0].ids)
            reach, wanted = np.cumsum(self.bytes[ids]), np.cumsum(list(map(len, own)))
            ends = np.searchsorted(reach, wanted) + 1
            if ends[-1] != len(ids) or (reach[ends - 1] != wanted).any():
                raise ValueError("a span of this vocabulary isn't a piece of its own")
            raw, begin = ids.tobytes(), 0
            for i, end in zip(group, (size * ends).tolist(), strict=True):
                out[i] = raw[begin:end]
                begin = end
        odd = [i for i, x in enumerate(simple) if not x]
        for i, ids in zip(odd, self.whole([keys[i].decode() for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return out

    def encode(self, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with the end id after each, and where each text's begin."""
        out, counts = [], np.zeros(len(at) - 1, np.int64)
        for first, n, own in slices(data, at):
            piece = data[own[0] : own[-1]]
            begin = spans(piece, own - own[0])
            starts = np.searchsorted(begin, own[:-1] - own[0])
            buffers = [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(piece)]
            coded = pa.Array.from_buffers(pa.binary(), len(begin) - 1, buffers).dictionary_encode()
            values = [*self.memo.many(split(coded.dictionary)), np.array([end], self.kind).tobytes()]
            reach = np.append(0, np.cumsum(np.fromiter(map(len, values), np.int32))).astype(np.int32)
            table = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(reach), pa.py_buffer(b"".join(values))])
            # the end id comes after a text, so after the last slice of a longer one
            closed = np.append(starts[1:], len(begin) - 1) if own[-1] == at[first + n] else starts[1:]
            codes = np.insert(coded.indices.to_numpy(), closed, len(values) - 1)
            _, place, ids = table.take(pa.array(codes)).buffers()
            place = np.frombuffer(place, np.int32, len(codes) + 1) // self.kind.itemsize
            out.append(np.frombuffer(ids, self.kind, int(place[-1])) if place[-1] else np.empty(0, self.kind))
            ends = place[np.append(starts + np.arange(n), len(codes))]
            counts[first : first + n] += np.diff(ends)
        return np.concatenate([*out, np.empty(0, self.kind)]), np.append(0, np.cumsum(counts))


def encoder(path: str, joined: bool) -> Encoder:
    return common.held(("encoder", path, joined), lambda: Encoder(path, joined))


def id_bytes(path: str, joined: bool) -> int:
    """Bytes of an id. The driver needs no more of the tokenizer, and keeps none of it."""
    size = encoder(path, joined).kind.itemsize
    common.release()
    return size


def encode_rows(batch: pa.RecordBatch, column: str, path: str, joined: bool, end: int) -> tuple[pa.Array, np.ndarray, np.dtype]:
    """Each text's ids as little-endian bytes with the end id, and their numbers; null is the empty text."""
    e = encoder(path, joined)
    ids, at = e.encode(*common.flat(batch.column(column)), end)
    offsets = (at * e.kind.itemsize).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
    return rows, np.diff(at), e.kind
