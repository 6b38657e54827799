"""
Token ids of many texts at once: texts are cut into tiles, each distinct tile of a batch is encoded once, all new
ones in one call, and numpy gathers the ids.

A tile is a word with the single space before it, a run of digits, of punctuation, or a line end. Cutting there doesn't change what the
tokenizer gives where it starts a new word at such a place anyway; `Encoder` knows two kinds of tokenizers that do. Texts in which
a cut could matter, and those of other tokenizers, go to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text encoded at once, unless a text alone is longer.
CHUNK = 8 << 20
#: Tiles a worker remembers, twice that at most, and the longest of them in bytes: some 60 MB in all.
REMEMBERED, LONG = 150_000, 48
_SPACE, _NEWLINE = 0x20, 0x0A
_HEAD, _TAIL, _LINE, _BAD = 0, 1, 2, 3
#: ASCII letters, digits and punctuation: words end between two of these. An apostrophe may go on a word, as may all beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _k in range(0x21, 0x7F):
    _CLASS[_k] = 1 if chr(_k).isalpha() else 2 if chr(_k).isdigit() else 0 if chr(_k) == "'" else 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters below this are letters to every Unicode version, and composed already.
_LATIN = "\u0250"


def chunks(batches: Iterator[pa.RecordBatch], column: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of some record batches in slices whose texts (binary, in `column`) have about `size` bytes."""
    held, waiting = [], 0
    for batch in batches:
        ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1] if batch.num_rows else np.zeros(1, np.int32)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size - waiting, "right")) - 1)
            held.append(batch.slice(start, stop - start))
            waiting += int(ends[stop] - ends[start])
            start = stop
            if waiting >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, waiting = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, and where its texts begin, with the end of the last."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def tiles(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tiles, the code of each tile in turn, and how many tiles stand before each text (and before the end)."""
    begins = (data == _SPACE) | (data == _NEWLINE)
    kind = _CLASS[data]
    begins[1:] |= (data[:-1] == _NEWLINE) | ((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
    begins[starts[:-1][starts[:-1] < len(data)]] = True
    first = np.flatnonzero(begins)
    offsets = np.append(first, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.searchsorted(first, starts)


class Encoder:
    """Ids that the tokenizers library gives for whole texts, without special tokens added."""

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        bare = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the model writes each byte of a space or a letter.
        self.letter = {b: bare.pre_tokenize_str(text)[0][0][k] for text in map(chr, range(0x20, ord(_LATIN))) for k, b in enumerate(text.encode())}
        #: Whether ASCII letters are written as themselves.
        self.ascii_same = all(self.letter[b] == chr(b) for b in range(256) if chr(b).isalpha() and b < 128)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        steps = made["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers") or [steps]
        #: White space is dropped, and no word goes across it.
        self.dropping = (
            steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and steps[0]["pattern"].get("Regex", "").endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") and all(not s.get("add_prefix_space") for s in steps)
            and [s["type"] for s in (made["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        #: A single space begins a word, a single line end is one.
        self.leading = made["normalizer"] is None and len(steps) == 1 and steps[0].get("type") == "ByteLevel" and not steps[0]["add_prefix_space"] and steps[0]["use_regex"]
        self.special = [t["content"].encode() for t in made["added_tokens"]]
        #: Ids of tiles as bytes: those met last, and those met before; unfit tiles and line ends of a batch.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.odd: dict[bytes, int] = {}

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.width)

    def kind(self, tile: bytes) -> int:
        text = tile.decode("utf-8", "replace")
        if text == "\n":
            return _LINE
        word = text.removeprefix(" ")
        if not word or word[0].isspace() or word[-1].isspace():
            return _BAD
        return _TAIL if text[0] == " " else _HEAD

    def _row(self, words: list[bytes], between: bytes, within: int) -> list[bytes]:
        """
        Ids of words that stand in one text with `between` after each; a token belongs to the word in whose place it begins.

        `within` is 1 where `between` is a token of its own.
        """
        found = self.tokenizer.encode(between.join(words).decode("utf-8", "replace"), add_special_tokens=False)
        starts = np.fromiter((start for start, _ in found.offsets), np.int64, len(found))
        sizes = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, len(words))
        edges = np.concatenate([[0], np.cumsum(sizes + len(between))])
        ids = np.array(found.ids, self.width)
        if within:
            kept = starts < (edges[1:] - len(between))[np.searchsorted(edges, starts, "right") - 1]
            ids, starts = ids[kept], starts[kept]
        cuts = np.searchsorted(starts, edges) * self.width.itemsize
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _fresh(self, names: list[bytes]) -> list[bytes]:
        """Ids of tiles not met before: those of letters alone from the tokenizer's model, all others by few calls of the library."""
        out: list = [b""] * len(names)
        others, plain, ids, ends = [], [], [], [0]
        tokenize, letter, space, ascii_same, dropping = self.model.tokenize, self.letter, self.letter[_SPACE], self.ascii_same, self.dropping
        for k, name in enumerate(names):
            text = name.decode("utf-8", "replace")
            word = text.removeprefix(" ")
            if dropping:
                text = word = word.lower()
            if not word.isalpha():
                others.append(k)
                continue
            if ascii_same and word.isascii():
                written = word if len(word) == len(text) else space + word
            elif max(word) < _LATIN:
                written = "".join([letter[b] for b in text.encode()])
            else:
                others.append(k)
                continue
            plain.append(k)
            ids += [t.id for t in tokenize(written)]
            ends.append(len(ids))
        raw, size = np.array(ids, self.width).tobytes(), self.width.itemsize
        for k, x, y in zip(plain, ends, ends[1:], strict=False):
            out[k] = raw[x * size : y * size]
        for k, ids in zip(others, self._mixed([names[k] for k in others]), strict=True):
            out[k] = ids
        return out

    def _mixed(self, names: list[bytes]) -> list[bytes]:
        out: list = [b""] * len(names)
        if self.dropping:
            groups = {(b" ", 0): [(k, word) for k, name in enumerate(names) if (word := name.strip(b" \n"))]}
        else:
            kinds = list(map(self.kind, names))
            groups = {
                (b"", 0): [(k, names[k]) for k, kind in enumerate(kinds) if kind == _TAIL],
                (b"\n", 1): [(k, names[k]) for k, kind in enumerate(kinds) if kind == _HEAD],
            }
            for k, kind in enumerate(kinds):
                if kind in (_LINE, _BAD):
                    self.odd[names[k]] = kind
                if kind == _LINE:
                    out[k] = self.whole(names[k]).tobytes()
        for (between, within), members in groups.items():
            if members:
                for (k, _), ids in zip(members, self._row([word for _, word in members], between, within), strict=True):
                    out[k] = ids
        return out

    def found(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds of tiles, their ids end to end, and how many ids each has."""
        rows: list = list(map(self.known.get, names))
        missing = [k for k, row in enumerate(rows) if row is None]
        fresh = []
        self.odd = {}
        older = self.older.get
        for k in missing:
            row = older(names[k])
            # what a cut may harm isn't remembered, so that it is seen each time
            if row is None:
                fresh.append(k)
            else:
                rows[k] = row
        if fresh:
            for k, ids in zip(fresh, self._fresh([names[k] for k in fresh]), strict=True):
                rows[k] = ids
        known, odd = self.known, self.odd
        for k in missing:
            name = names[k]
            if len(name) <= LONG and name not in odd:
                if len(known) >= REMEMBERED:
                    self.older, self.known = known, {}
                    known = self.known
                known[name] = rows[k]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // self.width.itemsize
        kinds = np.fromiter((name[:1] == b" " for name in names), np.uint8, len(names))
        if self.odd:
            for k in fresh:
                if names[k] in self.odd:
                    kinds[k] = self.odd[names[k]]
        return kinds, np.frombuffer(b"".join(rows), self.width), lengths

    def _apart(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts that hold a special token."""
        raw, out = data.tobytes(), np.zeros(len(starts) - 1, bool)
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                out[np.searchsorted(starts, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts (a binary array) end to end, and how many ids each text has."""
        n = len(texts)
        if not (self.dropping or self.leading):
            own = [self.whole(text) for text in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.width), *own]), np.fromiter(map(len, own), np.int64, n)
        data, starts = joined(texts)
        names, codes, edges = tiles(_LOWER[data] if self.dropping else data, starts)
        kinds, flat, lengths = self.found(names.to_pylist())
        apart = self._apart(data, starts)
        if self.leading:
            apart |= _unfit(kinds[codes], edges)
        ends = np.cumsum(lengths)
        sizes = lengths[codes]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.arange(total[-1]) + np.repeat((ends - lengths)[codes] - total[:-1], sizes)]
        per_text = total[edges[1:]] - total[edges[:-1]]
        if not apart.any():
            return ids, per_text
        cut = np.split(ids, np.cumsum(per_text)[:-1])
        for k in np.flatnonzero(apart).tolist():
            cut[k] = self.whole(data[starts[k] : starts[k + 1]].tobytes())
        return np.concatenate(cut), np.fromiter(map(len, cut), np.int64, n)


def _unfit(kinds: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """
    Texts in which white space isn't single: a tile is unfit, a space begins a text or a line, or a line is empty.

    Before the first tile of a text, and behind its last, stands the same as a line end.
    """
    plain = (kinds == _HEAD) | (kinds == _TAIL)
    before = np.concatenate([[False], plain[:-1]])
    before[edges[:-1][edges[:-1] < len(kinds)]] = False
    behind = np.concatenate([plain[1:], [False]])
    last = edges[1:] - 1
    behind[last[last >= 0]] = False
    bad = (kinds == _BAD) | ((kinds == _TAIL) & ~before) | ((kinds == _LINE) & ~(before & behind))
    sums = np.concatenate([[0], np.cumsum(bad)])
    return sums[edges[1:]] > sums[edges[:-1]]
