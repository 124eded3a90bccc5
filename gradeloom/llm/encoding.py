"""Token ids of whole texts by the ``tokenizers`` library, with a cache of space-separated chunks.

A byte-level tokenizer cuts a text before every single space that follows a character other than white
space or precedes one, so the chunks between such spaces can be encoded apart. Texts where that does
not hold (runs of mixed white space, added tokens in the text, other kinds of tokenizer) are encoded
whole. It also cuts around a line end that stands by itself, so where all do, a line's first word is a chunk of
its own. Each distinct chunk of some texts is looked up once. A chunk of letters with marks after them, or two such on two lines, is cut as the tokenizer
cuts it and its parts go straight to the library's merge model; other chunks go through the whole
library. The ids are the library's either way.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNSAFE = re.compile(r"\s \s|\s \Z")
#: In every unsafe text, and sooner looked for.
_SUSPECT = re.compile(r" (?:\s|\Z)")
#: A line end at the edge of a text or beside other white space.
_LOOSE = re.compile(r"\n(?:(?<=\A\n)|(?<=\s\n)|(?=\s)|\Z)")
#: Ranges without gaps of code points that are letters in every version of Unicode, and ASCII marks other than those of contractions.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u4e00-\u9fa5]+"
_MARKS = "[!#$%&*,.:;?|]*"
_PLAIN = re.compile(f"({_LETTERS})({_MARKS})(?:\n({_LETTERS})({_MARKS}))?")


#: Chunks that a worker remembers, about 240 bytes each, in two halves: those asked for since the last turn, and those of the turn before.
CACHED = 1_200_000
#: Characters of texts that are encoded together, but for longer texts.
TOGETHER = 4 << 20


def _byte_letters() -> dict[int, str]:
    """The letter of a byte-level vocabulary for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids of chunks after a space; those that are lacking come over from ``old``, or are made."""

    def __init__(self, make, old: dict[str, bytes]):
        super().__init__()
        self.make, self.old = make, old

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            return self.make(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        kind = str(self.tok.pre_tokenizer)
        self.chunked = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tok.normalizer is None
        self.merge = self.tok.model.tokenize
        self.letters = _byte_letters()
        self.space, self.line = self.letters[0x20], self.letters[0x0A]
        self.below = self._merged(self.line, "") if self.chunked else b""
        self.marks: dict[str, bytes] = {"": b""}
        self.cache = _Chunks(self._made, {})
        self.cached = cached
        self.run = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.run(texts, add_special_tokens=False)]

    def _merged(self, before: str, part: str) -> bytes:
        """Ids of one part that the tokenizer does not cut; ``before`` is in the vocabulary's letters."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.merge(before + part)]).tobytes()

    def _marked(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            ids = self.marks[marks] = self._merged("", marks)
        return ids

    def _made(self, chunk: str) -> bytes:
        """Ids of a chunk after a space, or of a line end and the chunk behind it. All are remembered but those of two plain words on two lines, as such pairs seldom come again."""
        below = chunk[:1] == "\n"
        m = _PLAIN.fullmatch(chunk, int(below))
        if below:
            ids = self.below + (self._merged("", m[1]) + self._marked(m[2]) if m and m[3] is None else self._encoded([chunk[1:]])[0])
        elif m is None:
            ids = self._encoded([" " + chunk])[0]
        else:
            word, marks, below, more = m.groups()
            ids = self.cache[word] + self._marked(marks) if len(word) < len(chunk) else self._merged(self.space, word)
            if below is not None:
                return ids + self.below + self._merged("", below) + self._marked(more)
        self.cache[chunk] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), without added special tokens."""
        texts = [t or "" for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        whole, by_lines, by_spaces = [], [], []
        for i, t in enumerate(texts):
            if not self.chunked or (_SUSPECT.search(t) and _UNSAFE.search(t)) or any(a in t for a in self.added):
                whole.append(i)
            else:
                (by_spaces if _LOOSE.search(t) else by_lines).append(i)
        for own in (by_lines, by_spaces):
            for some in _groups(own, texts):
                for i, ids in zip(some, self._together([texts[i] for i in some], own is by_lines), strict=True):
                    out[i] = ids
        if whole:
            for i, b in zip(whole, self._encoded([texts[i] for i in whole]), strict=True):
                out[i] = np.frombuffer(b, self.dtype)
        return out

    def _together(self, texts: list[str], lines: bool) -> list[np.ndarray]:
        """Ids of texts that are cut at spaces, and before line ends if ``lines``."""
        if 2 * len(self.cache) > self.cached:
            self.cache = _Chunks(self._made, self.cache)
            self.cache.old.old = {}  # its elder goes
        column = pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(column, "\n", " \n") if lines else column, " ")
        chunks, edges = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        at = chunks.indices.to_numpy().astype(np.int64)
        heads = chunks.dictionary.take(pa.array(at[edges[:-1]])).to_pylist()
        at[edges[:-1]] = np.arange(len(texts)) + len(chunks.dictionary)  # no space before them
        known = self.cache.__getitem__
        made = [known(c) if lines or c[:1] != "\n" else self._encoded([" " + c])[0] for c in chunks.dictionary.to_numpy(zero_copy_only=False).tolist()]
        made += self._encoded(heads)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
        starts, n = np.cumsum(sizes) - sizes, sizes[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(made), self.dtype)[np.repeat(starts[at] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[edges].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _groups(some: list[int], texts: list[str]) -> Iterator[list[int]]:
    """In order, groups of texts of about TOGETHER characters."""
    group, size = [], 0
    for i in some:
        group.append(i)
        size += len(texts[i])
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


_encoders: dict[str, Encoder] = {}


def encoder(path: str, cached: int = CACHED) -> Encoder:
    """One encoder for each file and process, which remembers at most about ``cached`` chunks."""
    gc.disable()  # a fifth of the time; common.release turns it on again at the end of the task's rows
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cached = cached
    return _encoders[path]


def forget(path: str) -> None:
    """Gives up the encoder of a file with all that it remembers."""
    gone = _encoders.pop(path, None)
    if gone:
        gone.cache = None  # it knows its encoder, which the collector alone would find out
