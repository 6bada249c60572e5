"""BPE encoding and decoding.

Encoding follows the backtracking scheme: an Aho-Corasick automaton over the vocabulary gives the longest
token that starts at each symbol; a token is appended only if it is compatible with the token before it
(no merge across their boundary would have come first), else the next shorter token is tried, else the last
token is taken back. The only sequence whose neighbours are all compatible is the one that merging in rank
order yields, so the result is exact, in time linear in the text.

Decoding is a gather from one byte pool through a table of offsets.

Vocabularies are read from the JSON files of the `tokenizers` library: byte symbols, an optional end-of-word
suffix, merges in rank order. Text goes through normaliser and pre-tokeniser as that library defines them; for
words below U+0250 this is done here with equal rules, other words go through the library's own stages.

Null text encodes as empty text: no tokens, the digest of zero bytes. Empty tables give empty results; columns of
the input besides the key and the text are ignored, whatever their names; each input row gives one row, repeated
or not.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, one_thread

VOCABULARY = "word_bpe_49k.json"
#: Decoded at once, so that one long text does not need an index of all its bytes.
DECODE_BLOCK = 1 << 16
#: Text that the rules below reproduce: Latin letters whose classes and lower-case forms are one code point each.
#: Dotted capital I lower-cases to two code points, and U+001C-U+001F are white space to Python only.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-įı-ɏ]")
_LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_NUMBER = "".join(c for c in map(chr, range(0x250)) if c.isnumeric())
_SPACE = "\t-\r \x85\xa0"
_ASCII_SPACE = re.compile("[\t-\r ]+")


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and pair compatibility of one vocabulary file. Symbols are single characters: U+0000-U+00FF
    stand for bytes, U+0100-U+01FF for bytes that end a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in whole["added_tokens"]}
        symbols = byte_symbols()
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}

        def inner(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            at = [symbols[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return "".join(map(chr, at[:-1] if ends else at)) + (chr(0x100 + at[-1]) if ends else "")

        vocab = {inner(t): i for t, i in model["vocab"].items()}
        self.base = {s: i for s, i in vocab.items() if len(s) == 1}
        self.text = {i: s for s, i in vocab.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {i: -1 for i in self.base.values()}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[inner(left)], vocab[inner(right)]
            made = vocab[inner(left) + inner(right)]
            self.merge.setdefault((a, b), (rank, made))
            if made not in self.parts:
                self.parts[made], self.rank[made] = (a, b), rank
        #: The pair-compatibility table, filled as pairs come up.
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging leaves ``left`` and ``right`` as they are when they stand side by side. Walks back through
        the merges that made the two tokens, latest first; a merge over their boundary of an earlier rank (or of an
        equal one that lies further left) would have come first. ``below``: only merges under this rank count."""
        known = self.pairs.get((left, right)) if below is None else None
        if known is not None:
            return known
        limit, a, b = sys.maxsize if below is None else below, left, right
        rank, parts, merge = self.rank, self.parts, self.merge
        while True:
            across = merge.get((a, b))
            if across is not None and across[0] < limit:
                fits = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                fits = True
                break
            if ra > rb:  # the right edge of the left token was made last
                limit, a = ra, parts[a][1]
            else:  # made at the same time, the left one comes first: equal ranks are still open on the right
                limit, b = rb + 1, parts[b][0]
        if below is None:
            if len(self.pairs) >= 2_000_000:
                self.pairs.clear()
            self.pairs[left, right] = fits
        return fits

    @property
    def reachable(self) -> dict[str, int]:
        """Tokens that merging their own text yields; others never occur in a result."""
        good = dict(self.base)
        for made, (a, b) in sorted(self.parts.items(), key=lambda x: self.rank[x[0]]):
            if self.text[a] in good and self.text[b] in good and self.compatible(a, b, self.rank[made]):
                good[self.text[made]] = made
        return good


class Encoder:
    """Token ids of texts, exactly as merging in rank order gives them."""

    def __init__(self, path: str):
        import ahocorasick

        one_thread()
        self.path, self.vocabulary, self.back = path, Vocabulary(path), byte_symbols()
        tokens = self.tokens = self.vocabulary.reachable
        self.automaton = ahocorasick.Automaton()
        for symbols, i in tokens.items():
            self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self.length = {i: len(s) for s, i in tokens.items()}
        #: The longest other token that the token begins with; -1 for one symbol.
        self.shorter = {i: next((tokens[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in tokens), -1) for s, i in tokens.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocabulary.added, key=len, reverse=True))) or r"(?!)")
        self.piece = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_NUMBER}]|[^{_SPACE}{_LATIN}{_NUMBER}]+")
        self.pieces = Memo(lambda p: self._piece(p.encode()))
        self.memo = Memo(self.chunk)

    def symbols(self, data: bytes) -> str:
        s = data.decode("latin-1")
        return s[:-1] + chr(0x100 + ord(s[-1])) if self.vocabulary.suffix and s else s

    def merged(self, symbols: str) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.tokens.get(symbols)) is not None:
            return [whole]
        n, length, shorter, vocabulary = len(symbols), self.length, self.shorter, self.vocabulary
        known, compatible = vocabulary.pairs.get, vocabulary.compatible
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(symbols):
            longest[end - size + 1] = i  # matches come by rising end, so the longest stays
        out: list[int] = []
        if not n:
            return out
        closed: set[int] = set()  # positions that lead to a dead end
        at, last, token = 0, -1, longest[0]
        while True:
            end = at + length[token]
            if last < 0:
                fits = end not in closed
            else:
                fits = known((last, token))
                if fits is None:
                    fits = compatible(last, token)
                fits = fits and not (closed and end in closed)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            elif (less := shorter[token]) >= 0:
                token = less
            else:
                closed.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]

    def _piece(self, piece: bytes) -> bytes:
        ids = self.merged(self.symbols(piece))
        return struct.pack(f"<{len(ids)}i", *ids)

    def chunk(self, word: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a word: lower-cased if it is usual, else as it is. White space parts
        pre-tokens in any case, and nothing is normalised across it."""
        if _UNUSUAL.search(word):
            return b"".join(self._piece(p.encode()) for p in self._library(word))
        return b"".join(map(self.pieces.__getitem__, self.piece.findall(word)))

    def _library(self, text: str) -> list[str]:
        """Pre-tokens by the library's own stages."""
        back = self.back
        normaliser, pre_tokeniser = _library(self.path)
        return [bytes(back[c] for c in p).decode() for p, _ in pre_tokeniser.pre_tokenize_str(normaliser.normalize_str(text))]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if "<|" in text and (found := list(self.special.finditer(text))):
            out, at = [], 0
            for m in found:
                out += [self.encode(text[at : m.start()]), self.vocabulary.added[m[0]].to_bytes(4, "little")]
                at = m.end()
            return b"".join([*out, self.encode(text[at:])])
        if _UNUSUAL.search(text):
            words = (w if _UNUSUAL.search(w) else w.lower() for w in _ASCII_SPACE.split(text) if w)
        else:
            words = text.lower().split()
        return b"".join(map(self.memo.__getitem__, words))


class Offsets:
    """Strings by id in one byte pool, each after a separator; joins the strings of many ids with one gather."""

    def __init__(self, strings: dict[int, bytes], separator: bytes = b" "):
        top = max(strings, default=-1) + 1
        parts = [separator + strings[i] if i in strings else b"" for i in range(top)]
        self.pool = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if top else np.zeros(0, np.int64)
        self.skip = len(separator)

    def blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        """The joined strings, in blocks; without the first separator."""
        for at in range(0, len(ids), DECODE_BLOCK):
            some = ids[at : at + DECODE_BLOCK]
            size = self.size[some]
            end = np.cumsum(size)
            where = np.arange(end[-1], dtype=np.int64) + np.repeat(self.start[some] - (end - size), size)
            yield self.pool[where].tobytes()[0 if at else self.skip :]

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.blocks(ids))


class Decoder:
    """Text of token ids, as the library's decode with special tokens kept: without a decoder stage of its own a
    vocabulary's token names are joined by one space; a byte-level one yields the bytes that the names stand for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        added = {x["id"]: x["content"].encode() for x in whole["added_tokens"]}
        vocab = whole["model"]["vocab"]
        if whole.get("decoder") is None:
            self.table = Offsets({i: t.encode() for t, i in vocab.items()} | added)
        else:
            back = byte_symbols()
            self.table = Offsets({i: bytes(back[c] for c in t) for t, i in vocab.items()} | added, b"")

    def decode(self, ids: np.ndarray) -> str:
        return self.table.joined(ids).decode("utf-8", "replace")


@cache
def _library(path: str):
    """The normaliser (None if there is none) and the pre-tokeniser; each access makes new ones, so they are kept."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return whole.normalizer, whole.pre_tokenizer


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, memo included."""
    return Encoder(path)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


@cache
def decimals(path: str) -> Offsets:
    return Offsets({i: str(i).encode() for i in encoder(path).vocabulary.names})


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (x.as_py() for x in batch.column("text"))


def _keyed(df: DataFrame, key: str, text: str | Column) -> DataFrame:
    return df.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(enc.encode(t), dtype="<i4") for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    rows = _keyed(df, key, text)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from (key, ids); null ids decode as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(path)
        for batch in batches:
            texts = [dec.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text where it is read, so that neither ids
    nor decoded text leave the task; the digests are fed block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec, dig = encoder(path), decoder(path), decimals(path)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for t in _texts(batch):
                ids = np.frombuffer(enc.encode(t), dtype="<i4")
                sizes.append(len(ids))
                for table, out in ((dig, coded), (dec.table, decoded)):
                    digest = hashlib.sha256()
                    for block in table.blocks(ids):
                        digest.update(block)
                    out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = _keyed(df, key, text)
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
