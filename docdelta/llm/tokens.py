"""Token ids of whole texts with a public tokenizer, through a cache of pieces.

The vocabulary drops white space and never joins characters across it, so the
ids of a text are those of its words (runs without ASCII white space) in turn.
The distinct words of a block of texts are cut into the pieces that the
tokenizer's own pattern gives, whose ids are kept for later blocks. A word with
unusual characters is a piece of its own, which the whole tokenizer encodes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 2
SLICE = 1 << 15

#: Characters that lower-case and cut alike in all Unicode versions and are in normal form; no numerals but digits.
PLAIN = "!-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f"
UNUSUAL = re.compile(f"[^{PLAIN}\n]")
#: Words with any other character, or with the brackets of special tokens, among words a line.
ODD = re.compile(f"^.*(?:[^{PLAIN}\n]|<\\|).*$", re.MULTILINE)
# Fixed value: the pattern by which this vocabulary cuts text into pieces, for plain words a line.
PIECE = re.compile(r"\n|\x00[^\n]*|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache(dict):
    """A dict that makes unknown entries by itself; with ``old``, the one before it, whose entries it takes over as they are met."""

    def __init__(self, make, old: dict | None = None) -> None:
        self.make, self.old = make, old or {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def next(self, most: int) -> Cache:
        """This one, or an empty one before it if it holds over ``most`` entries."""
        if len(self) <= most:
            return self
        self.old = {}
        return Cache(self.make, self)


class WordEncoder:
    """ids of texts as packed unsigned integers (two bytes each where the vocabulary allows)."""

    def __init__(self, source: bytes, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source.decode())
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.mark = np.iinfo(self.dtype).max  # no id: the end of a word
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.most, self.pieces = most, Cache(self._new_piece)
        self.letters = byte_letters()

    def _new_piece(self, p: str) -> bytes:
        if p == "\n":
            return self.mark.to_bytes(self.dtype.itemsize, "little")
        if p[0] == "\0":
            return np.array(self.tokenizer.encode(p[1:], add_special_tokens=False).ids, self.dtype).tobytes()
        packed = self.packed
        # Bytes of ASCII pieces are their own letters.
        return b"".join([packed[t.id] for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters))])

    def _words(self, words: pa.Array) -> pa.Array:
        """Packed ids of distinct words, as an array of the same length."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py()
        lines = text.lower()
        if odd := set(ODD.findall(text)) if UNUSUAL.search(text) or "<|" in text else ():
            lines = lines.split("\n")
            for i, w in enumerate(text.split("\n")):
                if w in odd:
                    lines[i] = "\0" + w
            lines = "\n".join(lines)
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, PIECE.findall(lines + "\n"))), self.dtype)
        self.pieces = self.pieces.next(self.most)
        inner = ids != self.mark
        ends = np.flatnonzero(~inner)
        at = np.r_[0, (ends - np.arange(len(ends))) * self.dtype.itemsize].astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids[inner].tobytes())])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each UTF-8 text.

        Arrow splits and numbers the words and gathers their ids; Python sees the pieces of each distinct word once.
        """
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded = pc.dictionary_encode(split.flatten())
        if not len(coded):
            return [b""] * len(texts)
        words = coded.dictionary
        gathered = pa.concat_arrays([self._words(words.slice(i, SLICE)) for i in range(0, len(words), SLICE)]).take(coded.indices)
        packed = memoryview(gathered.buffers()[2])
        at = np.frombuffer(gathered.buffers()[1], np.int64, len(gathered) + 1, 8 * gathered.offset)[split.offsets.to_numpy()]
        return [bytes(packed[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[bytes, WordEncoder] = {}


def source_of(path: str) -> bytes:
    """The tokenizer's file, which the driver reads and executors get by broadcast (a few MB)."""
    with open(path, "rb") as f:
        return f.read()


def encoder(source: bytes | str) -> WordEncoder:
    """One encoder for each tokenizer (its file's bytes, or its path) and process."""
    source = source_of(source) if isinstance(source, str) else source
    key = hashlib.sha256(source).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(source)
    return _ENCODERS[key]


def in_blocks(texts, most: int = 1 << 23):
    """Lists of texts of about ``most`` bytes together (at least one text each)."""
    block, held = [], 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block
