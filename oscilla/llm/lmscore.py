"""Cross-entropy difference scoring with a target and a background bigram model over one shared vocabulary.

Both models count the same things: words and word pairs of every document (background) and of the target documents.
The vocabulary is shared and open: every word and every pair is counted under its own key, in distributed counts that
grow with the corpus, so no rare pair reads what strangers have counted. A pair's probability backs off to its word's
with a Dirichlet prior, in both models alike, and the background's counts are scaled to the target's size, so that
neither gains by having seen more. The score of a document is its mean loss per word under the background less that
under the target: higher is closer to the target.

Plan: a token's loss is ``log(count(before) + s) - log(count(before, word) + s p(word))``. The first term needs one
word's count and the second what is known where a word and its pairs are counted, so a token travels to its word once
and comes back as a part of its document's sums. What is common (a share of the corpus or more than a task's worth;
hence of bounded number) is counted beforehand, after adding up in each task, and broadcast: tokens of common pairs
travel nowhere, and those of a common word are spread by the word before them. Tokens travel in compressed columns,
not as rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, text_of
from .minhash import mix

_WORD = re.compile(r"\w+|[^\w\s]")
_U = np.uint64
#: A common word's code is its place among them; any other's is the hash of the word, which is no less than this.
_RARE = _U(1 << 32)
#: In place of the word before: none, and the mark of a text's last word, which comes before none.
_FIRST, _LAST, _SHIFT = 0, 1, 2
_COLD, _SPREAD, _HOME = 0, 1, 2
#: Documents of a chunk at most: their number and a flag fill 16 bits.
_DOCS = 1 << 15
_TASKS = 1 << 16
#: Rows, drawn at random, in which likely common words are looked for.
SAMPLE = 10_000


@dataclass(frozen=True)
class Shape:
    """Words the uniform prior reckons with (or those there are, if more), tokens a task takes at once, strength of both
    priors, and the share of all tokens (one in ``share``) from which a word or pair is common, if that is below ``pairs``."""

    words: int = 1 << 18
    pairs: int = 3 << 19
    strength: float = 20.0
    share: int = 1 << 14


def _digest(word: str) -> bytes:
    """Eight bytes, the highest first, of a word; as a number no less than _RARE."""
    found = xxhash.xxh3_64_digest(word.encode("utf-8", "replace"))
    return found if found[:4] != b"\0\0\0\0" else b"\0\0\0\1" + found[4:]


class _Parts(dict):
    """What stands between two blanks to the codes of its words (no word holds a blank). Full, it takes no more."""

    def __init__(self, common: np.ndarray):
        super().__init__()
        hashes = common.astype(">u8").tobytes()
        self.place = {hashes[8 * k : 8 * k + 8]: k.to_bytes(8, "big") for k in range(len(common))}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = _digest(word)
        found = self.place.get(found, found)
        if len(self.words) < 200_000:
            self.words[word] = found
        return found

    def __missing__(self, part: str) -> bytes:
        low, known = part.lower(), self.words.get
        if low.isalpha():  # one word
            found = known(low) or self._word(low)
        else:
            found = b"".join([known(w) or self._word(w) for w in _WORD.findall(low)])
        if len(self) < 300_000:
            self[part] = found
        return found

    def of(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split(" "))), dtype=">u8").astype(_U)


@dataclass
class _Chunk:
    """Some documents: ids (Arrow), flags of the target, and their words' codes, with each word's document."""

    ids: pa.Array
    wanted: np.ndarray
    codes: np.ndarray
    which: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch], parts: _Parts, most: int) -> Iterator[_Chunk]:
    """Chunks of ``most`` words or a document more, of columns doc_id, text, wanted."""
    ids, wanted, codes, size = [], [], [], 0

    def flush() -> _Chunk:
        which = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        return _Chunk(pa.array(ids, pa.int64()), np.array(wanted, dtype=bool), np.concatenate(codes), which)

    for batch in batches:
        for doc, body, chosen in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            ids.append(doc.as_py())
            wanted.append(chosen.as_py())
            codes.append(parts.of(body.as_py()))
            size += len(codes[-1])
            if size >= most or len(ids) == _DOCS:
                yield flush()
                ids, wanted, codes, size = [], [], [], 0
    if ids:
        yield flush()


def _packed(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(columns)}I", *map(len, columns)) + b"".join(planes))


def _unpacked(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{len(types)}I", raw)
    at, found = 4 * len(types), []
    for n, t in zip(sizes, map(np.dtype, types), strict=True):
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * t.itemsize, offset=at).reshape(t.itemsize, n)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += n * t.itemsize
    return found


def _edges(parts: int) -> np.ndarray:
    """The first number of each of ``parts`` ranges of 64-bit numbers but the first."""
    return np.array([(k << 64) // parts for k in range(1, parts)], dtype=_U)


def _slices(ordered: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(range, slice) of each range of ``edges`` that has some of ``ordered``."""
    ends = [0, *np.searchsorted(ordered, edges).tolist(), len(ordered)]
    for k in range(len(ends) - 1):
        if ends[k] < ends[k + 1]:
            yield k, slice(ends[k], ends[k + 1])


def _by_part(sent: DataFrame, parts: int, add: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``add`` of all rows of each part: one part a task, or beyond _TASKS parts several, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start < end:
                    if held and held[0].column(0)[0].as_py() != part[start]:
                        yield from add(pa.Table.from_batches(held)).to_batches()
                        held = []
                    held.append(batch.slice(start, end - start))
        if held:
            yield from add(pa.Table.from_batches(held)).to_batches()

    tasks = min(parts, _TASKS)
    placed = sent.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    return (placed if tasks == parts else placed.sortWithinPartitions("part")).mapInArrow(run, schema)


def _summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, each key's place among them, and the weights' sums."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at, [np.bincount(at, weights=w, minlength=len(distinct)) for w in weights]


def _marked(docs: DataFrame, target: DataFrame, text: str) -> DataFrame:
    """doc_id, text, wanted of every row. Ids are broadcast after a check of their number; beyond, the join is written."""
    ids = durable(target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
    few = ids.count() <= BROADCAST_ROWS
    wanted = ids.withColumn("wanted", F.lit(True))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    joined = body.join(F.broadcast(wanted) if few else wanted, "doc_id", "left").select("doc_id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    return joined if few else durable(joined)


def _common(marked: DataFrame, known: np.ndarray, parts: int, least: int, most: int) -> tuple[list[np.ndarray], list[np.ndarray], tuple[int, int, int]]:
    """Exact counts, in one pass, of the words and pairs seen ``least`` times or more: (hashes, seen, wanted) of words;
    (pairs of hashes, seen, wanted) of pairs of ``known`` words; and words seen, wanted and different in all.

    Tasks add up their chunks before the shuffle. What comes back is no more than the tokens over ``least``.
    """
    shared = marked.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, own = _edges(parts), shared.value
        for chunk in _chunks(batches, _Parts(own), most):
            words = chunk.codes.copy()
            some = np.flatnonzero(words < _RARE)
            words[some] = own[words[some].astype(np.int64)]
            a, first = _before(chunk)
            both = ~first & (a < _RARE) & (chunk.codes < _RARE)
            found = []
            for kind, key, chosen in ((0, words, chunk.wanted[chunk.which]), (1, (a[both] << _U(32)) | chunk.codes[both], chunk.wanted[chunk.which[both]])):
                distinct, seen = np.unique(key, return_counts=True)
                target, times = np.unique(key[chosen], return_counts=True)
                wanted = np.zeros(len(distinct), dtype=np.uint32)
                wanted[np.searchsorted(distinct, target)] = times
                place = mix(distinct)
                order = np.argsort(place)
                distinct, seen, wanted = distinct[order], seen[order].astype(np.uint32), wanted[order]
                found += [(k, kind, _packed(distinct[s], seen[s], wanted[s])) for k, s in _slices(place[order], edges)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int8(), pa.binary()))], names=["part", "kind", "blob"]
            )

    def add(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for kind in (0, 1):
            blobs = table.filter(pc.equal(table.column("kind"), kind)).column("blob")
            if not len(blobs):
                continue
            key, seen, wanted = (np.concatenate(c) for c in zip(*(_unpacked(b.as_py(), _U, np.uint32, np.uint32) for b in blobs), strict=True))
            distinct, _, (n, m) = _summed(key, seen, wanted)
            some = n >= least
            rows += zip([kind] * int(some.sum()), distinct[some].view(np.int64).tolist(), n[some].astype(np.int64).tolist(), m[some].astype(np.int64).tolist(), strict=True)
            if kind == 0:
                rows.append((2, len(distinct), int(n.sum()), int(m.sum())))
        return pa.table({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate((("kind", pa.int8()), ("key", pa.int64()), ("seen", pa.int64()), ("wanted", pa.int64())))})

    sent = marked.mapInArrow(count, "part long, kind tinyint, blob binary")
    rows = _by_part(sent, parts, add, "kind tinyint, key long, seen long, wanted long").toArrow()
    kind, key, seen, wanted = (rows.column(k).to_numpy() for k in range(4))

    def of(k: int) -> list[np.ndarray]:
        own = kind == k
        code = key[own].astype(np.int64).view(_U)
        order = np.argsort(code)
        return [code[order], seen[own][order].astype(float), wanted[own][order].astype(float)]

    total = kind == 2
    words, pairs = of(0), of(1)
    pairs[0] = np.stack([known[(pairs[0] >> _U(32)).astype(np.int64)], known[(pairs[0] & _U((1 << 32) - 1)).astype(np.int64)]]) if len(pairs[0]) else np.zeros((2, 0), dtype=_U)
    return words, pairs, (int(seen[total].sum()), int(wanted[total].sum()), int(key[total].sum()))


def _before(chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The code before each word (anything for a text's first), and whether it is the first."""
    a = np.r_[_U(0), chunk.codes[:-1]][: len(chunk.codes)]
    return a, np.r_[True, chunk.which[1:] != chunk.which[:-1]][: len(a)]


def counts(docs: DataFrame, target: DataFrame, shape: Shape = Shape(), text: str = "text") -> DataFrame:
    """(a, b, seen, wanted): occurrences of each word (a null) and pair over all rows and over rows in ``target``.

    Words are their hashes as signed numbers; before a text's first word stands -1. Tasks add up before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, _Parts(np.zeros(0, dtype=_U)), shape.pairs):
            a, first = _before(chunk)
            b, a = chunk.codes.view(np.int64), np.where(first, -1, a.view(np.int64))
            chosen = chunk.wanted[chunk.which].astype(np.int64)
            table = pa.table({"a": pa.array(np.r_[a, a], mask=np.r_[np.ones(len(a), dtype=bool), np.zeros(len(a), dtype=bool)]), "b": np.r_[b, b], "wanted": np.r_[chosen, chosen]})
            summed = table.group_by(["a", "b"]).aggregate([("wanted", "count"), ("wanted", "sum")]).select(["a", "b", "wanted_count", "wanted_sum"])
            yield from summed.rename_columns(["a", "b", "seen", "wanted"]).to_batches()

    found = _marked(docs, target, text).mapInArrow(run, "a long, b long, seen long, wanted long")
    return found.groupBy("a", "b").agg(F.sum("seen").alias("seen"), F.sum("wanted").alias("wanted"))


@dataclass
class _Model:
    """What is common and the sizes of both models, known to every task."""

    words: np.ndarray
    word: tuple[np.ndarray, np.ndarray]
    pairs: np.ndarray
    pair: tuple[np.ndarray, np.ndarray]
    size: tuple[float, float]
    scale: float
    vocabulary: int
    strength: float

    def prior(self, m: int, n: np.ndarray) -> np.ndarray:
        """Strength times the probability of a word seen ``n`` times by model ``m``."""
        return self.strength * (n + 1.0) / (self.size[m] + self.vocabulary)


def _places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's place among the known ones, and whether it is one."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys


def _sent(chunk: _Chunk, number: int, model: _Model, edges: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(part, chunk, kind, blob): what a chunk's tasks need of other tasks, and its documents with what is known here."""
    b, which, n = chunk.codes, chunk.which, len(chunk.ids)
    a, first = _before(chunk)
    last = np.r_[first[1:], True][: len(b)]
    common = b < _RARE
    known = np.zeros(len(b), dtype=bool)
    at = np.zeros(len(b), dtype=np.int64)
    both = np.flatnonzero(~first & common & (a < _RARE))
    at[both], known[both] = _places(model.pairs, (a[both] << _U(32)) | b[both])
    sums = []
    inner, begun = np.flatnonzero(common & ~last), np.flatnonzero(common & first)
    here = np.flatnonzero(known)
    for m in (0, 1):
        word = model.word[m]
        total = np.bincount(which[inner], weights=np.log(word[b[inner].astype(np.int64)] + model.strength), minlength=n)
        total -= np.bincount(which[begun], weights=np.log(model.prior(m, word[b[begun].astype(np.int64)]) / model.strength), minlength=n)
        total -= np.bincount(which[here], weights=np.log(model.pair[m][at[here]] + model.prior(m, word[b[here].astype(np.int64)])), minlength=n)
        sums.append(total)
    doc = ((which << 1) | chunk.wanted[which]).astype(np.uint16)
    before = np.where(a < _RARE, a + _U(_SHIFT), (a & _U((1 << 47) - 1)) | _U(1 << 47))
    before[first] = _FIRST
    found = []
    # Rare words: all their tokens by the word; the last token of a text once more, as it comes before none.
    rare = np.flatnonzero(~common)
    ends = np.flatnonzero(~common & last)
    word = np.concatenate([b[rare], b[ends]])
    order = np.argsort(word)
    word = word[order]
    prev = np.concatenate([before[rare], np.full(len(ends), _LAST, dtype=_U)])[order]
    docs = np.concatenate([doc[rare], doc[ends]])[order]
    for part, s in _slices(word, edges):
        distinct, times = np.unique(word[s], return_counts=True)
        found.append((part, number, _COLD, _packed(distinct, times.astype(np.uint32), prev[s], docs[s])))
    # Common words in pairs that aren't: spread by the pair.
    spread = np.flatnonzero(common & ~first & ~known)
    pair = mix(mix(b[spread]) + before[spread])
    order = np.argsort(pair)
    spread = spread[order]
    for part, s in _slices(pair[order], edges):
        some = spread[s]
        found.append((part, number, _SPREAD, _packed(b[some].astype(np.uint32), before[some], doc[some])))
    ids = np.array(chunk.ids.fill_null(0), dtype=np.int64)
    null = np.array(chunk.ids.is_null(), dtype=np.uint8)
    home = int(mix(np.array([number], dtype=_U))[0]) * (len(edges) + 1) >> 64
    found.append((home, number, _HOME, _packed(ids, null, np.bincount(which, minlength=n).astype(np.int64), *sums)))
    return found


def _added(table: pa.Table, model: _Model) -> Iterator[tuple[int, bytes]]:
    """(chunk, blob) with the sums that the tokens of one part add to each of a chunk's documents."""
    chunk, kind, blob = table.column("chunk").to_numpy(), table.column("kind").to_numpy(), table.column("blob")
    numbers, place = np.unique(chunk, return_inverse=True)
    whose: list[np.ndarray] = []
    losses: list[list[np.ndarray]] = [[], []]

    def owner(rows: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        doc = np.concatenate(docs)
        return np.repeat(place[rows].astype(np.int64), [len(d) for d in docs]) * _DOCS + (doc >> 1), (doc & 1).astype(float)

    rows = np.flatnonzero(kind == _COLD)
    if len(rows):
        columns = [_unpacked(blob[int(k)].as_py(), _U, np.uint32, _U, np.uint16) for k in rows]
        word = np.concatenate([np.repeat(w, t) for w, t, _, _ in columns])
        before = np.concatenate([p for _, _, p, _ in columns])
        own, chosen = owner(rows, [d for _, _, _, d in columns])
        del columns
        real = (before != _LAST).astype(float)
        _, at, (seen, wanted) = _summed(word, real, real * chosen)
        paired = before >= _SHIFT
        pairs, where, (both, both_wanted) = _summed(mix(word[paired] + mix(before[paired])), np.ones(int(paired.sum())), chosen[paired])
        whose.append(own)
        for m, (alone, together) in enumerate(((seen * model.scale, both * model.scale), (wanted, both_wanted))):
            prior = model.prior(m, alone)[at]
            pair = np.zeros(len(word))
            pair[paired] = together[where]
            # Before a first word stands none: its loss is that of the word alone.
            loss = -np.log((pair + prior) / np.where(before == _FIRST, model.strength, 1.0))
            losses[m].append(np.where(before == _LAST, 0.0, loss) + np.where(before == _LAST, -1.0, 1.0) * np.log(alone + model.strength)[at])
    rows = np.flatnonzero(kind == _SPREAD)
    if len(rows):
        columns = [_unpacked(blob[int(k)].as_py(), np.uint32, _U, np.uint16) for k in rows]
        word = np.concatenate([w for w, _, _ in columns])
        before = np.concatenate([p for _, p, _ in columns])
        own, chosen = owner(rows, [d for _, _, d in columns])
        del columns
        _, where, (both, both_wanted) = _summed(mix(mix(word.astype(_U)) + before), np.ones(len(word)), chosen)
        whose.append(own)
        for m, together in enumerate((both * model.scale, both_wanted)):
            losses[m].append(-np.log(together[where] + model.prior(m, model.word[m][word])))
    if whose:
        own, _, sums = _summed(np.concatenate(whose), *(np.concatenate(x) for x in losses))
        ends = np.searchsorted(own, np.arange(len(numbers) + 1) * _DOCS)
        for k, number in enumerate(numbers):
            s = slice(ends[k], ends[k + 1])
            if s.start < s.stop:
                yield int(number), _packed((own[s] % _DOCS).astype(np.uint16), *(x[s].astype(np.float32) for x in sums))


def score(docs: DataFrame, target: DataFrame, shape: Shape = Shape(), text: str = "text") -> DataFrame:
    """doc_id, n_words, background_loss, target_loss, score of every row's whole text; models count every row.

    target: doc_id of the documents the target model is made of. Null text counts as empty; a text without words has
    zeros; repeated rows count and are scored each; without target documents that model is uniform. ``docs`` must be
    stable when read twice, as a table is.
    """
    marked = _marked(docs, target, text)
    size, rows = marked.agg(F.sum(F.length("text")), F.count("*")).first()
    size = size or 0
    parts = max(1, -(-size // (6 * shape.pairs)))
    least = min(max(2, size // (6 * shape.share)), shape.pairs)
    # Which words are likely common is taken from some rows, and decides no count: it saves a pass over all texts.
    part = min(1.0, SAMPLE / max(1, rows))
    likely = marked if part == 1 else marked.sample(part, seed=1)
    likely, _, _ = _common(likely, np.zeros(0, dtype=_U), max(1, round(parts * part)), max(2, int(least * part / 2)), shape.pairs)
    (words, seen, wanted), (pairs, both, both_wanted), (all_seen, all_wanted, distinct) = _common(marked, likely[0], parts, least, shape.pairs)
    scale = all_wanted / all_seen if all_wanted else 1.0  # matched: the background's counts as in a sample of the target's size
    # Words of a common pair are common: their places among these.
    pairs = (np.searchsorted(words, pairs[0]).astype(_U) << _U(32)) | np.searchsorted(words, pairs[1]).astype(_U)
    order = np.argsort(pairs)
    pairs, both, both_wanted = pairs[order], both[order], both_wanted[order]
    shared = docs.sparkSession.sparkContext.broadcast(
        _Model(words, (seen * scale, wanted), pairs, (both * scale, both_wanted), (all_seen * scale, float(all_wanted)), scale, max(shape.words, distinct), shape.strength)
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, edges, task = shared.value, _edges(parts), TaskContext.get().partitionId()
        for k, chunk in enumerate(_chunks(batches, _Parts(model.words), shape.pairs)):
            rows = _sent(chunk, task << 32 | k, model, edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int8(), pa.binary()), strict=True)],
                names=["part", "chunk", "kind", "blob"],
            )

    def add(table: pa.Table) -> pa.Table:
        home = table.filter(pc.equal(table.column("kind"), _HOME)).select(["chunk", "kind", "blob"])
        found = list(_added(table, shared.value))
        own = pa.table({"chunk": pa.array([c for c, _ in found], pa.int64()), "kind": pa.array([_COLD] * len(found), pa.int8()), "blob": pa.array([b for _, b in found], pa.binary())})
        return pa.concat_tables([home.cast(own.schema), own])

    def finish(table: pa.Table) -> pa.Table:
        kind, blob = table.column("kind").to_pylist(), table.column("blob")
        ids, null, n, *sums = _unpacked(blob[kind.index(_HOME)].as_py(), np.int64, np.uint8, np.int64, np.float64, np.float64)
        sums = [s.copy() for s in sums]
        for k, b in zip(kind, blob, strict=True):
            if k != _HOME:
                doc, *more = _unpacked(b.as_py(), np.uint16, np.float32, np.float32)
                for s, x in zip(sums, more, strict=True):
                    s[doc] += x
        losses = [np.where(n > 0, s / np.maximum(n, 1), 0.0) for s in sums]
        return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_words": n, "background_loss": losses[0], "target_loss": losses[1]})

    sent = marked.mapInArrow(send, "part long, chunk long, kind tinyint, blob binary")
    added = _by_part(sent, parts, add, "chunk long, kind tinyint, blob binary")
    found = added.groupBy("chunk").applyInArrow(finish, "doc_id long, n_words long, background_loss double, target_loss double")
    return found.withColumn("score", F.col("background_loss") - F.col("target_loss"))
