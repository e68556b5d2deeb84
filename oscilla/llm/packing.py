"""Vector best-fit packing of token pieces into bounded sequences.

Every document is tokenised, closed by one end id, and cut only where it exceeds a sequence. Pieces are spread
over groups of bounded size by a hash of their row number, so no source or repeated document can make a group hot,
and each group is packed on its own: pieces in descending order go to the open bin that scores best among those
where *every* residual capacity (tokens, documents, attention cost = sum of squared lengths) still holds them.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, kept, text_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of either cache of an encoder: some 70 MB each at most for words of usual length.
_CACHED = 300_000
#: Letters and signs of which the pre-tokenizer's classes are those of ``re``, and which normalise to themselves but for case.
_PLAIN = re.compile(r"[\x21-\x7E\xA1-\xB1\xB4-\xB8\xBA\xBB\xBF-\u012F\u0131-\u024F]*")
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_KNOWN = (
    {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: The printable letter that stands for each byte in a byte-level vocabulary.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_LETTERS = [chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256)]


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, how bins are scored, and how many pieces one packing task takes."""

    tokens: int = 2048
    documents: int | None = None
    attention: float | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"
    group: int = 8192

    def __post_init__(self) -> None:
        if self.tokens < 1 or self.group < 1 or (self.documents or 1) < 1 or (self.attention or 1) <= 0:
            raise ValueError("capacities must be positive")
        if self.score not in ("norm", "dot"):
            raise ValueError("score is 'norm' or 'dot'")

    @property
    def limits(self) -> np.ndarray:
        """Capacities as a vector; an absent one is as large as the token capacity allows, so it never binds."""
        return np.array([self.tokens, self.documents or self.tokens, self.attention or float(self.tokens) ** 2], dtype=float)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, by way of two caches of bounded size.

    For vocabularies whose normaliser and pre-tokenizer are those of ``_KNOWN``, neither reaches across a blank (a line
    feed counts as one), so the ids of a text are those of its blank-separated parts in a row. A part in plain Latin
    letters is cut as the pre-tokenizer would, so that words which differ in case or punctuation are encoded once;
    other parts go to the tokenizer whole, as do the texts under any other vocabulary. Full caches take no more
    entries: frequent words come early.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that spell one of these, in whatever case, go to the tokenizer whole.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        self.known = (spec["normalizer"], spec["pre_tokenizer"]) == _KNOWN
        self.parts: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            letters = word if word.isascii() else "".join([_LETTERS[c] for c in word.encode()])
            ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.words) < _CACHED:
                self.words[word] = found
        return found

    def _part(self, part: str) -> bytes:
        if _PLAIN.fullmatch(part):
            found = b"".join(map(self._word, _PRE_TOKEN.findall(part.lower())))
        else:
            found = self._whole(part)
        if len(self.parts) < _CACHED:
            self.parts[part] = found
        return found

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _spells_added(self, text: str) -> bool:
        low = text.lower()
        return any(t in low for t in self.added)

    def encode(self, text: str) -> bytes:
        if not self.known or self._spells_added(text):
            return self._whole(text)
        parts = text.replace("\n", " ").split(" ")
        found = list(map(self.parts.get, parts))
        if None in found:
            for k in itertools.compress(range(len(found)), map(is_, found, itertools.repeat(None))):
                found[k] = self._part(parts[k])
        return b"".join(found)


def encoder(path: str) -> Encoder:
    """The encoder of ``path``, made once a process."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def token_pieces(docs: DataFrame, vocabulary: str, tokens: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start, length, ids_crc32.

    Null or empty text is the end id alone; a null doc_id stays null; repeated rows each give their pieces.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = model.encode(body.as_py()) + end
                for k, start in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[start : start + 4 * tokens]
                    rows.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """Bin number of each piece. Pieces go in descending length (ties: given order); ties of a score: the older bin."""
    limits = capacity.limits
    weights = np.asarray(capacity.weights) / limits
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    left = np.empty((3, len(lengths)))
    names = np.empty(len(lengths), dtype=np.int64)
    opened = used = 0
    least = float(lengths.min(initial=0))
    for at, i in enumerate(order):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (need > limits).any():
            raise ValueError("a piece exceeds the capacities of an empty sequence")
        rest = left[:, :opened] - need[:, None]
        fits = np.flatnonzero((rest >= 0).all(axis=0))
        if len(fits):
            if capacity.score == "norm":
                value = ((rest[:, fits] * weights[:, None]) ** 2).sum(axis=0)
                pick = fits[np.argmin(value)]
            else:
                value = ((left[:, fits] * weights[:, None]) * (need / limits)[:, None]).sum(axis=0)
                pick = fits[np.argmax(value)]
        else:
            pick, opened = opened, opened + 1
            left[:, pick] = limits
            names[pick] = used
            used += 1
        left[:, pick] -= need
        bins[i] = names[pick]
        if at % 64 == 63:  # close the bins that no later piece can enter
            open_ = np.flatnonzero((left[:, :opened] >= [[max(least, 1)], [1], [max(least, 1) ** 2]]).all(axis=0))
            left[:, : len(open_)], names[: len(open_)] = left[:, open_], names[open_]
            opened = len(open_)
    return bins


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (any columns, with ``length``) plus sequence_id long and offset long.

    ``pieces`` must be stable when read twice (a written table): rows are numbered to spread them over groups. An empty
    table gives no rows; columns called sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    groups = max(1, round(pieces.count() / capacity.group))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    name = fresh(pieces, "group")

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins = best_fit(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty_like(lengths)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return (
            table.drop_columns([name])
            .append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins))
            .append_column("offset", pa.array(offset))
        )

    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias(name)
    return pieces.select("*", spread).groupBy(name).applyInArrow(one, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), end_id: int = 0) -> DataFrame:
    """Documents (doc_id, text) as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tokens = capacity.tokens if capacity.attention is None else min(capacity.tokens, max(1, int(capacity.attention**0.5)))
    return pack(durable(token_pieces(docs, vocabulary, tokens, end_id)), capacity)
