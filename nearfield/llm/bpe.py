"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that no vocabulary token holds side by side can never be joined by a merge, so a text may be cut there
before encoding: the fragments are encoded one by one and their ids concatenated.  Bytes of white space are in no token,
so every white-space run is such a cut, and so is every end of a piece of the vocabulary's own splitting pattern; within a
piece the pair table of the vocabulary gives the rest.  Pieces repeat, so each worker keeps a bounded dictionary of those
already encoded; texts become ids, and ids text, by look-ups over whole chunks.

Null texts encode as empty texts; an empty text has no ids and decodes to the empty string; texts of any length are
encoded whole; ties and repeated rows give repeated results; an empty table gives an empty result; other columns are
carried as they are, and those named like results are replaced.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, tidy

#: Bytes of text encoded at once, unless one text alone is longer.
CHUNK = 1 << 19
#: Pieces kept by a worker; a full dictionary is emptied, which costs time and changes nothing else.
KEPT_PIECES = 150_000


#: Below this code point letters, numbers and lower case are the same in every Unicode version, and all text is NFC.
_LATIN_END = chr(0x250)
_LATIN = [chr(c) for c in range(0x250)]
_LETTERS = re.escape("".join(c for c in _LATIN if c.isalpha()))
_NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
_SPACES = re.compile(r"[\x09-\x0d\x20]+")
_LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\x09-\x0d\x20\x85\xa0{_LETTERS}{_NUMBERS}]+")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBoundaryEncoder:
    """Encodes and decodes as the vocabulary file's own tokenizer does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normalizer = whole.normalizer
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        self.pairs = np.zeros((256, 256), bool)  # pairs that some token holds
        for token in spec["model"]["vocab"]:
            raw = np.array([of_letter[c] for c in token.removesuffix(self.suffix) if c in of_letter], np.uint8)
            self.pairs[raw[:-1], raw[1:]] = True
        bare = {"version": spec["version"], "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.last = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"]}))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.text_of = {i: t for t, i in whole.get_vocab(with_added_tokens=True).items()}
        # the tokens' texts, a space after each
        table = [self.text_of.get(i, "").encode() + b" " for i in range(max(self.text_of) + 1)]
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_size = np.array(list(map(len, table)), np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.clear()
        del whole, spec, bare, table  # tens of megabytes in each worker
        tidy()

    def clear(self) -> None:
        """Forget all pieces but the special tokens, which no other piece equals."""
        self.place: dict[str, int] = {t: i for i, t in enumerate(self.special)}
        self.start, self.count = np.arange(len(self.special), dtype=np.int64), np.ones(len(self.special), np.int64)
        self.pool = np.array(list(self.special.values()), np.int32)

    def fragments(self, pieces: list[str]) -> list[list[str]]:
        """Each piece cut wherever two neighbouring bytes are in no token; all pieces at once, a space between them."""
        raw = np.frombuffer(" ".join(pieces).encode(), np.uint8)
        cuts = np.flatnonzero(~self.pairs[raw[:-1], raw[1:]]) + 1
        # cuts beside a space part the pieces; one inside a character can't be written as text and is left out
        cuts = cuts[(raw[cuts] & 0xC0 != 0x80) & (raw[cuts] != 32) & (raw[cuts - 1] != 32)]
        if not len(cuts):
            return [[p] for p in pieces]
        bounds = np.flatnonzero(np.concatenate(([True], raw == 32, [True])))
        owner = np.searchsorted(bounds, cuts, "right") - 1
        out = [[p] for p in pieces]
        for i in np.unique(owner).tolist():
            own = pieces[i].encode()
            edges = [0, *(cuts[owner == i] - bounds[i]).tolist(), len(own)] if len(cuts) < 64 else [0, *(cuts[slice(*np.searchsorted(owner, [i, i + 1]))] - bounds[i]).tolist(), len(own)]
            out[i] = [own[x:y].decode() for x, y in zip(edges, edges[1:], strict=False)]
        return out

    def split(self, part: str) -> list[str]:
        """The pieces of a text without special tokens: what merges can never leave."""
        if part.isascii() or (part and max(part) < _LATIN_END):
            return _LATIN_PIECES.findall(part.lower())
        out: list[str] = []
        run: list[str] = []  # words in Latin letters that follow one another
        for word in _SPACES.split(part):
            if word.isascii() or max(word) < _LATIN_END:
                run.append(word)
                continue
            out += _LATIN_PIECES.findall(" ".join(run).lower())
            run.clear()
            word = self.normalizer.normalize_str(word)
            out += [p for p, _ in self.pieces.pre_tokenize_str(word)] if word else []
        return out + _LATIN_PIECES.findall(" ".join(run).lower())

    def pieces_of(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.special_split and "<|" in text:
            parts = self.special_split.split(text)
            return [x for part in parts for x in ((part,) if part in self.special else self.split(part))]
        return self.split(text)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not in the dictionary yet."""
        cut = self.fragments(pieces)
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        last, sizes = self._encoded(self.last, [p[-1] for p in cut])
        if n.sum() > len(cut):
            inner, inner_sizes = self._encoded(self.inner, [f for p in cut for f in p[:-1]])
            final = np.zeros(n.sum(), bool)
            final[np.cumsum(n) - 1] = True
            # all fragments in order, each a run of the last ones' ids or of the inner ones'
            start, size = np.empty(len(final), np.int64), np.empty(len(final), np.int64)
            start[final], size[final] = np.cumsum(sizes) - sizes, sizes
            start[~final], size[~final] = np.cumsum(inner_sizes) - inner_sizes + len(last), inner_sizes
            last = np.concatenate((last, inner))[_runs(start, size)]
            sizes = np.add.reduceat(size, np.cumsum(n) - n)
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(sizes) - sizes))
        self.count = np.concatenate((self.count, sizes))
        self.pool = np.concatenate((self.pool, last))

    @staticmethod
    def _encoded(tokenizer, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments, one after the other, and how many each has; they are given as the words of one text."""
        encoded = tokenizer.encode(fragments, is_pretokenized=True, add_special_tokens=False)
        ids, owner = np.array(encoded.ids, np.int32), np.array(encoded.word_ids, np.int64)
        return ids, np.bincount(owner, minlength=len(fragments))

    def encode(self, texts: list[str | None], kept: int = KEPT_PIECES) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.place) > kept:
            self.clear()
        each = [self.pieces_of(t) for t in texts]
        new = list(set().union(*each).difference(self.place))
        if new:
            self.learn(new)
        n = np.fromiter(map(len, each), np.int64, len(each))
        piece = np.fromiter((p for own in each for p in map(self.place.__getitem__, own)), np.int64, n.sum())
        count = self.count[piece]
        ids = self.pool[_runs(self.start[piece], count)]
        total = np.concatenate(([0], np.cumsum(count)))
        ends = np.cumsum(n)
        return ids, total[ends] - total[ends - n]

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each of several runs of ids: tokens joined by a space, as the vocabulary's tokenizer (it has no
        decoder) writes them; specials stay, and numbers that are no token are left out."""
        known = (ids >= 0) & (ids < len(self.token_size))
        known[known] = self.token_size[ids[known]] > 1
        if not known.all():
            owner = np.repeat(np.arange(len(counts)), counts)[known]
            ids, counts = ids[known], np.bincount(owner, minlength=len(counts))
        size = self.token_size[ids]
        data = self.token_bytes[_runs(self.token_start[ids], size)]
        total = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        # the space after a text's last token goes
        keep = np.ones(len(data), bool)
        some = counts > 0
        keep[total[1:][some] - 1] = False
        offsets = total - np.concatenate(([0], np.cumsum(some)))
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep])).cast(pa.string())


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


_ENCODERS: dict[str, ForcedBoundaryEncoder] = {}


def encoder(path: str) -> ForcedBoundaryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ForcedBoundaryEncoder(path)
    return _ENCODERS[path]


def encode_documents(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded", kept: int = KEPT_PIECES) -> DataFrame:
    """``df`` with its token ids (array of int) and, unless ``decoded`` is None, the text that they decode to.

    Columns of ``df`` named like the results are replaced by them.  One pass without a shuffle; a worker keeps ``kept``
    pieces or so.
    """
    held = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*held, T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in chunks(batch, text, CHUNK):
                flat, counts = enc.encode(part.column(text).to_pylist(), kept)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                columns = [part.column(f.name) for f in held] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns + ([enc.decode_many(flat, counts)] if decoded else []), names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in held]).mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids decode to; null ids give the empty text."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != decoded], T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in schema.names[:-1]), enc.decode_many(flat, counts)], names=schema.names)

    return df.select(*[F.col(f"`{n}`") for n in schema.names[:-1]]).mapInArrow(run, schema)
