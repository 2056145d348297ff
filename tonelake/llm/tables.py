"""Tables of distinct text chunks, kept by a Python worker and used again by its later tasks.

Natural text repeats its words, so a tokenizer's work is done once per distinct chunk; every
occurrence is then an index into flat arrays. A table starts anew when it holds ``limit`` chunks,
which bounds its memory and changes no result.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np


class Codes(dict):
    """chunk -> running number; numbers of new chunks are given on first sight."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Ragged:
    """Rows of different lengths in one flat array."""

    def __init__(self, dtype):
        self.flat, self.starts, self.lens = np.empty(0, dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def extend(self, flat: np.ndarray, lens: np.ndarray) -> None:
        lens = np.asarray(lens, np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, np.asarray(flat, self.flat.dtype)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after another, and the length of each."""
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        at = np.repeat(self.starts[rows] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], lens


def bounds(lens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions at which documents begin and end among concatenated rows; ``counts``: rows of each document."""
    ends = np.concatenate([[0], np.cumsum(lens)])
    return ends[np.concatenate([[0], np.cumsum(counts)])]


class ChunkTable:
    """Base: ``codes`` of chunks plus whatever ``fill`` keeps for each."""

    limit = 400_000

    def __init__(self):
        self.codes = Codes()

    def clear(self) -> None:
        self.codes = Codes()

    def fill(self, new: list) -> None:
        raise NotImplementedError

    def look_up(self, lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all chunks of all documents, and the number of chunks of each document."""
        if len(self.codes) > self.limit:
            self.clear()
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        if self.codes.new:
            self.fill(self.codes.new)
            self.codes.new = []
        return codes, counts


# --- sentencepiece ---

_MARKED = re.compile("▁*[^▁]+|▁+$")


def marked_words(text: str) -> list[str]:
    """The text's marked words, each without its first marker. Joined as ``marker + word`` they give the normalised text."""
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _MARKED.findall("▁" + text.replace(" ", "▁"))]


class PieceTable(ChunkTable):
    """Ids and decoded text of distinct marked words of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.sp.get_piece_size()):
            if "▁" in self.sp.id_to_piece(i).lstrip("▁"):
                raise ValueError("a piece crosses a whitespace marker: this model needs whole texts")
        self.anchor, self.line = self.sp.encode("a"), self.sp.encode("a\n")[-1:]
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.ids, self.texts = Ragged(np.uint32), []

    def fill(self, new: list) -> None:
        ids = self.sp.encode(new, num_threads=1)
        ids = [x if w else [self.sp.piece_to_id("▁")] for w, x in zip(new, ids, strict=True)]
        self.ids.extend(np.fromiter(chain.from_iterable(ids), np.uint32), [len(x) for x in ids])
        # words without line breaks are decoded together, as lines of one text
        lines = [x for w, x in zip(new, ids, strict=True) if "\n" not in w]
        joined = list(chain.from_iterable(chain.from_iterable((self.line, x) for x in lines)))
        at = iter(self.sp.decode(self.anchor + joined).split("\n")[1:])
        skip = len(self.sp.decode(self.anchor))
        self.texts.extend(next(at) if "\n" not in w else self.sp.decode(self.anchor + x)[skip:] for w, x in zip(new, ids, strict=True))


# --- byte-level BPE ---

#: Printable letters and signs without white space, up to the Latin supplements.
_PLAIN = re.compile("[!-~¡-ɏ]+")
_ISOLATED = re.compile(r"(?<=\S) (?=\S)")


def spaced_chunks(text: str) -> list:
    """Chunks between single spaces. All but the first (a 1-tuple) have a space before them that belongs to their text."""
    if not text:
        return []
    first, *rest = text.split(" ")
    return [(first,), *rest]


def edge_chunks(text: str) -> list:
    """The same for texts with longer runs of white space: only a space between two other characters is a border."""
    if not text:
        return []
    first, *rest = _ISOLATED.split(text)
    return [(first,), *rest]


def loose(chunk) -> bool:
    """Whether white space at the chunk's edge may belong to a run with its neighbour."""
    word = chunk[0] if isinstance(chunk, tuple) else chunk
    return not word or word[0].isspace() or word[-1].isspace()


def text_of(chunk) -> str:
    return chunk[0] if isinstance(chunk, tuple) else " " + chunk


class BpeTable(ChunkTable):
    """Ids of distinct chunks under a byte-level BPE, as the tokenizers library gives them for a .json file.

    Plain chunks are encoded many at a time from the rank file of the same vocabulary; chunks with special
    tokens, white space inside or unusual letters go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        import tokenizers

        super().__init__()
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.exact = tokenizers.Tokenizer.from_file(json_path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.newline = self.ranks[b"\n"]
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.ids, self.loose = Ragged(np.uint32), np.empty(0, bool)

    def plain(self, chunk) -> bool:
        word = chunk[0] if isinstance(chunk, tuple) else chunk
        return _PLAIN.fullmatch(word) is not None and ("<|" not in word or not any(x in word for x in self.special))

    def encode_plain(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks: one text of lines, cut at the newline's id."""
        if not chunks:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        ids = np.asarray(self.fast.encode_to_numpy("\n".join(map(text_of, chunks)), disallowed_special=()), np.uint32)
        cut = np.flatnonzero(ids == self.newline)
        assert len(cut) == len(chunks) - 1
        return np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1

    def encode(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        plain = self.plain_now = np.fromiter(map(self.plain, chunks), bool, len(chunks))
        some, some_lens = self.encode_plain([c for c, p in zip(chunks, plain, strict=True) if p])
        rest = [e.ids for e in self.exact.encode_batch_fast([text_of(c) for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False)]
        lens = np.empty(len(chunks), np.int64)
        lens[plain], lens[~plain] = some_lens, [len(x) for x in rest]
        flat, of_plain = np.empty(int(lens.sum()), np.uint32), np.repeat(plain, lens)
        flat[of_plain], flat[~of_plain] = some, np.fromiter(chain.from_iterable(rest), np.uint32)
        return flat, lens

    def fill(self, new: list) -> None:
        self.ids.extend(*self.encode(new))
        self.note_loose(new, self.plain_now)

    def note_loose(self, new: list, plain: np.ndarray) -> None:
        edges = ~plain
        edges[edges] = [loose(new[i]) for i in np.flatnonzero(edges)]
        self.loose = np.concatenate([self.loose, edges])

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the chunks of each text, and their number for each text."""
        lists = [spaced_chunks(t) for t in texts]
        codes, counts = self.look_up(lists)
        odd = np.zeros(len(texts), bool)
        np.logical_or.at(odd, np.repeat(np.arange(len(texts)), counts), self.loose[codes])
        if odd.any():
            codes, counts = self.look_up([edge_chunks(t) if o else x for t, o, x in zip(texts, odd, lists, strict=True)])
        return codes, counts


_kept: dict = {}


def kept(kind: type, *args):
    """The worker's own table of this kind; a worker that is replaced builds it anew."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held((kind, args), lambda: kind(*args))


def held(key: tuple, build):
    """One table at a time: what an earlier stage left in the worker is given up before another is built."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]
