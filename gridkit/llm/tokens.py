"""Ids of a byte-level BPE vocabulary inside Spark tasks.

The ids are those of the ``tokenizers`` file.  Texts whose characters all lie below
U+0280 are encoded whole by the same vocabulary as tiktoken ranks; in that range both
libraries cut alike (tested); ``tokenizers`` encodes all other texts.  A batch of
texts is cut at white space, where no word of the pattern goes across, and each of its
distinct parts is encoded once.  Nothing is kept between batches, so a worker's memory
does not grow with the words it has seen.  Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .arrays import flat, pieces

#: patterns that tiktoken matches faster, with the same words
FASTER = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+":
          r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"}
#: the same words where all white space is one space before a word or one line's end
LINES = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+":
         r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n"}
#: least lead byte of characters from U+0280 on
_BEYOND = 0xCA
#: about so many bytes of text are taken together to find their distinct parts; a text
#: of more than twice as many is encoded alone
BATCH = 1 << 22
_SPACE, _NEWLINE = 0x20, 0x0A
_WHITE = np.zeros(256, bool)
_WHITE[[_SPACE, 9, _NEWLINE, 11, 12, 13]] = True


def _two_byte_white(data: np.ndarray) -> np.ndarray:
    """Places of U+0085 and U+00A0, the other white space below U+0280."""
    lead = np.flatnonzero(data[:-1] == 0xC2)
    return lead[np.isin(data[lead + 1], (0x85, 0xA0))]


def _parts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bounds of the parts of all texts: words with at most a space before them, and
    white space.  Of a run of white space before a word, the pattern takes all but the
    last character, and that one goes with the word if it is a space.  A text with
    characters from U+0280 on, where there is more white space, is one part."""
    white = _WHITE[data]
    two = _two_byte_white(data)
    white[two] = white[two + 1] = True
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    turn = np.flatnonzero(white[1:] != white[:-1]) + 1  # white space and words begin by turns
    word = turn[int(white[0] ^ True):: 2]
    cut[turn[int(white[0]):: 2]] = True
    word = word[~cut[word]]
    last = data[word - 1]
    cut[word - 1 - (last >= 0x80)] = True
    cut[word[last != _SPACE]] = True
    beyond = np.flatnonzero(data >= _BEYOND)
    for i in np.unique(np.searchsorted(offsets, beyond, "right") - 1).tolist():
        cut[offsets[i] + 1: offsets[i + 1]] = False
    return np.flatnonzero(cut)


def vocabulary(name: str = "byte_bpe_50k") -> dict:
    """Places of the vocabulary's files; read on the driver, sent as a parameter."""
    import public_tokenizers

    return {"json": public_tokenizers.path(f"{name}.json"), "ranks": public_tokenizers.path(f"{name}.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both columns of batches that follow each other, joined until they hold ``BATCH`` bytes."""
    held, size = [], 0

    def joined():
        return held[0] if len(held) == 1 else tuple(map(pa.concat_arrays, zip(*held)))

    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        if held and size + texts.nbytes > 2 * BATCH:
            yield joined()
            held, size = [], 0
        held.append((batch.column(0), texts))
        size += texts.nbytes
        if size >= BATCH:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


class Encoder:
    def __init__(self, files: dict):
        import tiktoken

        self.files, self.slow = files, None
        with open(files["ranks"], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast, self.lines = (
            tiktoken.Encoding("ranks", pat_str=by.get(files["pattern"], files["pattern"]),
                              mergeable_ranks=ranks, special_tokens={}) for by in (FASTER, LINES))
        self.newline = ranks[b"\n"]

    def ids(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if np.frombuffer(text, np.uint8).max() < _BEYOND:
            return self.fast.encode_to_numpy(text.decode(), disallowed_special=())
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.files["json"])
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Of batches (doc_id, text), joined or cut to about ``BATCH`` bytes: the doc_ids,
        the bounds of each text's ids, and the ids."""
        for names, texts in _joined(batches):
            offsets, data = flat(texts)
            for low, high in pieces(offsets, 2 * BATCH):
                own = offsets[low: high + 1]
                yield names.slice(low, high - low), *self._batch(own - own[0], data[own[0]: own[-1]])

    def _batch(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(offsets) == 2 and len(data) > 2 * BATCH or not len(data):
            ids = self.ids(data.tobytes())
            return np.linspace(0, len(ids), len(offsets)).astype(np.int64), ids
        bounds = _parts(offsets, data)
        n = len(bounds) - 1
        parts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        parts = parts.dictionary_encode()
        place, ids = self._distinct(*flat(parts.dictionary))
        ids = ids.take(pa.array(place[parts.indices.to_numpy()]))
        end, ids = flat(ids)
        return end[np.searchsorted(bounds, offsets)] // 4, ids.view(np.uint32)

    def _distinct(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The place of each part, and the ids (as bytes) by place.  Words are encoded line
        by line: no word holds a line's end, and it is an id of its own between them."""
        ends = offsets[1:] - 1
        alone = _WHITE[data[ends]]
        two = _two_byte_white(data) + 1
        at = np.minimum(np.searchsorted(ends, two), len(ends) - 1)
        alone[at[ends[at] == two]] = True  # white space, or a text that is one part
        alone |= np.maximum.reduceat(data, offsets[:-1]) >= _BEYOND
        order = np.argsort(alone, kind="stable")  # words come first
        lines = np.insert(data, offsets[1:], _NEWLINE)[np.repeat(~alone, np.diff(offsets) + 1)]
        ids = self.lines.encode_to_numpy(lines.tobytes().decode(), disallowed_special=())
        word = ids != self.newline
        sizes = np.diff(np.flatnonzero(~word), prepend=-1) - 1
        found = [ids[word]]
        for i in np.flatnonzero(alone).tolist():
            found.append(self.ids(data[offsets[i]: offsets[i + 1]].tobytes()))
        found, sizes = np.concatenate(found), np.append(sizes, np.array([len(x) for x in found[1:]], np.int64))
        end = np.append(0, np.cumsum(4 * sizes))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return place, pa.Array.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(end), pa.py_buffer(found)])


#: where a Python worker keeps its encoders: functions of this package come to it by
#: value, so a module of its own outlives the task
_HELD = "_word_encoders"


def encoder(files: dict) -> Encoder:
    """This process's encoder of a vocabulary; the next tasks need not read the vocabulary again."""
    held = sys.modules.setdefault(_HELD, types.ModuleType(_HELD)).__dict__
    key = (files["json"], files["ranks"])
    if key not in held:
        held[key] = Encoder(files)
    return held[key]
