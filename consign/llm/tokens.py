"""Encoding whole texts to token ids, word by word.

Byte-level BPE never merges across pre-tokens, and a pre-token boundary depends
on its neighbours only inside runs of white space.  So where every run of white
space in a text is a single character between two others, the text can be cut into
units that are encoded on their own: before each space (" word"), before and after
each other white space, and before a full stop or comma that follows an ASCII or Latin-1
letter or a digit and ends its word.  Units repeat: a slice of texts is dictionary-encoded,
each unit is looked up or encoded once, and the ids of the texts are gathered from the
units'.  The ids of recent units are kept in a dictionary of bounded size.  Any
other text is encoded in one piece.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST_KEPT = 64  # characters of a unit whose ids are kept
SLICE, SLICE_BYTES = 4096, 6 << 20  # rows and bytes of text that are worked on at a time
KEPT = 600_000  # units; about 130 MB


def _plain(text: str) -> bool:
    """Whether all runs of white space are one character long and between two others."""
    words = text.split()
    return (len(text) - sum(map(len, words)) == len(words) - 1 and "<|" not in text  # a special token's text
            and "\u180e" not in text)  # of which not all libraries agree that it is no space


def _surely_plain(col: pa.Array) -> np.ndarray:
    """For each text, whether its bytes show that it is plain; False where _plain has to look."""
    at, c = _bytes(col)
    if not len(c):
        return np.zeros(len(col), dtype=bool)
    kind = np.frombuffer(c.tobytes().translate(_KINDS), dtype=np.uint8)
    space = kind == 1
    odd = kind == 2
    odd[1:] |= space[1:] & space[:-1]
    a, b = at[:-1], at[1:]
    ok = b > a
    ok[np.searchsorted(at, np.flatnonzero(odd), side="right") - 1] = False
    rows = np.flatnonzero(ok)
    ok[rows] = ~(space[a[rows]] | space[b[rows] - 1])
    return ok


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins (and the end) in the texts' bytes, and the bytes."""
    data = col.buffers()
    at = np.frombuffer(data[1], dtype=np.int32)[col.offset:col.offset + len(col) + 1]
    c = np.frombuffer(data[2], dtype=np.uint8)[at[0]:at[-1]] if data[2] is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], c


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ODD = (ord("|"), 0xC2, 0xE1, 0xE2, 0xE3)  # bars, and first bytes of all wider white space
_KINDS = bytes(1 if _SPACE[i] else 2 if i in _ODD else 0 for i in range(256))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _units(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of plain texts, without copying them, and how many each text has."""
    row, c = _bytes(col)
    n = len(c)
    start = c == 32
    space = np.frombuffer(c.tobytes().translate(_KINDS), dtype=np.uint8) == 1
    other = space & ~start
    start |= other
    start[1:] |= other[:-1]
    last = start.copy()  # whether the next byte is white space or the text's end
    last[:-1] = space[1:]
    last[row[1:] - 1] = True
    mark = np.flatnonzero(last & ((c == 44) | (c == 46)))
    mark = mark[~np.isin(mark, row)]
    letter = _LETTER[c[mark - 1]] | ((c[mark - 2] == 0xC3) & (c[mark - 1] != 0x97) & (c[mark - 1] != 0xB7) & (mark > 1))
    start[mark[letter]] = True
    start[row[:-1]] = True
    begin = np.flatnonzero(start)
    offsets = np.append(begin, n).astype(np.int32)
    units = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(c))
    return units, np.diff(np.searchsorted(begin, row))


class WordEncoder:
    """A column of texts -> (all ids as uint32, how many each text has); null encodes as the empty text."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kept: int = KEPT,
                 encode_units: Callable[[list[str]], list[bytes]] | None = None) -> None:
        self.encode, self.kept, self.encode_units = encode, kept, encode_units or encode
        self.known: dict[str, bytes] = {}

    def _ids(self, units: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.kept:
            known.clear()
        ids = list(map(known.get, units))
        new = [i for i, x in enumerate(ids) if x is None]
        fresh = [units[i] for i in new]
        for i, u, x in zip(new, fresh, self.encode_units(fresh)):
            ids[i] = x
            if len(u) <= LONGEST_KEPT:
                known[u] = x
        return ids

    def _plain_ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        units, per_text = _units(col)
        coded = units.dictionary_encode()
        index = coded.indices.to_numpy()
        ids = self._ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        n = size[index]
        stop = np.cumsum(n, dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        at = np.repeat(start[index] - stop + n, n)
        at += np.arange(stop[-1], dtype=np.int32)
        return flat[at], np.add.reduceat(n, np.cumsum(per_text) - per_text)

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        col = pc.fill_null(col.cast(pa.string()), "")
        plain = _surely_plain(col)
        for i in np.flatnonzero(~plain).tolist():
            plain[i] = bool(t := col[i].as_py()) and _plain(t)
        counts = np.zeros(len(col), dtype=np.int64)
        values = np.zeros(0, dtype="<u4")
        if plain.any():
            values, counts[plain] = self._plain_ids(col.filter(pa.array(plain)))
        rest = np.flatnonzero(~plain)
        if len(rest):
            other = dict(zip(rest.tolist(), self.encode([col[i].as_py() for i in rest.tolist()])))
            stop = np.cumsum(counts)
            counts[rest] = [len(x) // 4 for x in other.values()]
            out, at = [], 0
            for i, x in other.items():
                out += [values[at:stop[i]], np.frombuffer(x, dtype="<u4")]
                at = stop[i]
            values = np.concatenate([*out, values[at:]])
        return values, counts


# How byte-level vocabularies write each byte: printable Latin-1 as itself, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_LIBRARY: dict[str, WordEncoder] = {}


def library_encoder(path: str) -> WordEncoder:
    """A WordEncoder over a tokenizers JSON file; one for each worker process."""
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)

        def encode(texts: list[str]) -> list[bytes]:
            return [np.asarray(e.ids, dtype="<u4").tobytes()
                    for e in tk.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

        vocab = tk.get_vocab()
        spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids of tokens that begin with a space
        spaced[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True
        line = np.zeros(len(spaced), dtype=bool)
        line[vocab["\u010a"]] = True

        def joined(units: list[str], between: str, marks: np.ndarray, skip: int) -> list[bytes]:
            # One text of many units: of a unit's tokens the first alone is among the marks.
            out: list[bytes] = []
            for at in range(0, len(units), 1024):
                part = units[at:at + 1024]
                found = tk.encode_batch_fast([between + between.join(part)], add_special_tokens=False)[0]
                ids = np.asarray(found.ids, dtype="<u4")
                starts = np.flatnonzero(marks[ids])
                if len(starts) != len(part):
                    raise ValueError("the tokenizer is not byte-level BPE with the usual split at white space")
                raw, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
                out += [raw[a:b] for a, b in zip((4 * (starts + skip)).tolist(), ends)]
            return out

        model, wide = tk.model.tokenize, {i: "".join(_BYTE_CHARS[b] for b in chr(i).encode()) for i in range(128, 592)}

        def encode_units(units: list[str]) -> list[bytes]:
            # Latin letters, with or without a space before them, are one pre-token: the model takes it as it is.
            out: list[bytes] = [b""] * len(units)
            rest: dict[str, list[int]] = {" ": [], "\n": [], "": []}
            for i, u in enumerate(units):
                spaced_unit = u[0] == " "
                w = u[1:] if spaced_unit else u
                if w.isalpha() and (w.isascii() or max(w) < "\u0250"):
                    w = w if w.isascii() else w.translate(wide)
                    out[i] = array("I", [t.id for t in model("\u0120" + w if spaced_unit else w)]).tobytes()
                else:
                    rest[" " if spaced_unit else "" if u.isspace() else "\n"].append(i)
            for kind, at in rest.items():
                part = [units[i] for i in at]
                found = encode(part) if not kind else joined(part, *(("", spaced, 0) if kind == " " else ("\n", line, 1)))
                for i, x in zip(at, found):
                    out[i] = x
            return out

        _LIBRARY[path] = WordEncoder(encode, encode_units=encode_units)
    return _LIBRARY[path]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows and, beyond one row, ``size`` bytes, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            todo = [b.slice(at, rows)]
            while todo:
                piece = todo.pop()
                if (n := piece.num_rows) > 1 and piece.nbytes > size:
                    todo += [piece.slice(n // 2), piece.slice(0, n // 2)]
                else:
                    yield piece


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most SLICE rows and, beyond one row, about ``size`` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < b.num_rows:
            n = max(1, min(SLICE, int(np.searchsorted(total, before + size, side="right")) - at))
            yield b.slice(at, n)
            at, before = at + n, int(total[at + n - 1])


def by_row(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw, stop = np.ascontiguousarray(values, dtype="<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [raw[a:b] for a, b in zip([0, *stop[:-1]], stop)]
