"""Benchmark decontamination by canonical templates.

Numbers, names and the units after numbers become typed slots, so that a question with other figures and other people
still has the same template. A capitalised word may be a name or not, whatever precedes it, so it is looked up both as
itself and as a name's slot, on both sides. Windows of five template tokens of every document meet those of the benchmark by hash;
where at least 0.8 of an item's windows occur, the template tokens themselves and the slots are compared: within an
occurrence one slot value of the item must stand for one value throughout. A document leaks if any occurrence does.

Up to BLOCK characters of benchmark become one index that is broadcast: the hash-join then needs no shuffle, so neither
a hot source nor a passage that many documents share gathers anywhere. A larger benchmark's windows are a table of
their own, and both sides' windows meet in a shuffled hash-join; only the pairs that cover enough see the texts again.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, kept, light, text_of

WINDOW, COVERAGE = 5, 0.8
#: Characters of benchmark text that are broadcast as one index: some 100 MB in a worker at most.
BLOCK = 4_000_000
#: Template tokens that are looked up at once.
SLICE = 1 << 17
#: A window says something only with so many words that aren't slots.
LITERALS = 2
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?\n]")
_UNITS = frozenset(
    "mm cm m km g kg mg t l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent mile miles foot feet inch inches pound pounds ounce ounces litre litres liter liters meter meters metre metres gram grams "
    "kilometer kilometers kilometre kilometres dollar dollars euro euros cent cents degree degrees hz khz mhz ghz kb mb gb tb w kw v".split()
)
#: Words that are no names though a sentence may start with them.
_PLAIN = frozenset(
    "a an the this that these those there here what why how who whom whose which when where whether is are was were am be been do does did "
    "has have had can could will would shall should may might must if then than so as and or but nor not no yes in on at of for to from by "
    "with without into over under after before between about i you he she it we they me him her us them my your his its our their each every "
    "all some any many much more most few both either neither one two suppose find given let consider while since because until during".split()
)
_WORD, _NAME, _NUMBER, _END, _UNIT = range(5)
_U = np.uint64
_SLOTS = {_NAME: "<NAME>", _NUMBER: "<NUM>", _UNIT: "<UNIT>"}
_MASK = 0xFFFFFFFFFFFFFFF8


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) & _MASK


class _Codes(dict):
    """Token to the hash of its case-folded form, with what it may be in the lowest three bits, as bytes."""

    def __missing__(self, token: str) -> bytes:
        low = token.lower()
        if token[0].isdigit():
            kind = _NUMBER
        elif token in ".!?\n":
            kind = _END
        elif low in _UNITS:
            kind = _UNIT
        else:
            kind = _NAME if low not in _PLAIN and token[0] != low[:1] and token[1:] == token[1:].lower() else _WORD
        found = (_hash(token.casefold()) | kind).to_bytes(8, "little")
        if len(self) < 100_000:
            self[token] = found
        return found


class _Parts(dict):
    """What stands between two blanks to the codes of its tokens; no token holds a blank. Full, it takes no more."""

    def __init__(self) -> None:
        super().__init__()
        self.codes = _Codes()

    def __missing__(self, part: str) -> bytes:
        codes = self.codes
        found = codes[part] if part.isalpha() else b"".join([codes[t] for t in _TOKEN.findall(part)])
        if len(self) < 300_000:
            self[part] = found
        return found

    def of(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split(" "))), dtype=np.uint64)


_SLOT_HASH = np.array([0, _hash("<NAME>"), _hash("<NUM>"), 0, _hash("<UNIT>")], dtype=np.uint64)


def _templates(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template token hashes of all texts in a row, each one's kind and its text's number. Ends of sentences are none."""
    known = kept("template codes", _Parts)
    parts = [known.of(t) for t in texts]
    codes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    which = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    kind = (codes & _U(7)).astype(np.int8)
    if len(kind):
        after = np.r_[False, (kind[:-1] == _NUMBER) & (which[1:] == which[:-1])]
        kind[(kind == _UNIT) & ~after] = _WORD
    hashes = np.where((kind == _NUMBER) | (kind == _UNIT), _SLOT_HASH[kind], codes & _U(_MASK))
    inner = np.flatnonzero(kind != _END)
    return hashes[inner], kind[inner], which[inner]


def template(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Template token hashes, each one's kind, and the tokens. What may be a name has its word's hash."""
    hashes, kind, _ = _templates([text])
    return hashes, kind, [t for t in _TOKEN.findall(text) if t not in ".!?\n"]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = (total ^ (total >> _U(29))) * _U(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return total


def readings(hashes: np.ndarray, kind: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of every window, with each of what may be names in it as a word and as a name."""
    own = windows(hashes, size)
    yield np.arange(len(own)), own
    if not len(own):
        return
    name = kind == _NAME
    named = np.zeros(len(own), dtype=np.int8)
    for k in range(size):
        named |= name[k : k + len(own)].astype(np.int8) << k
    some = np.flatnonzero(named)
    named = named[some]
    for chosen in range(1, 1 << size):
        at = some[(named & chosen) == chosen]
        if len(at):
            total = np.full(len(at), size, dtype=np.uint64)
            for k in range(size):
                total = (total ^ (total >> _U(29))) * _U(0x9E3779B97F4A7C15) + (_SLOT_HASH[_NAME] if chosen >> k & 1 else hashes[at + k])
            yield at, total


def _usable(kind: np.ndarray, size: int) -> np.ndarray:
    """Places of an item's windows that say something."""
    literal = np.convolve(kind == _WORD, np.ones(size, dtype=int), "valid")
    return np.flatnonzero(literal >= min(LITERALS, literal.max()))


class Block:
    """Some items of the benchmark, ready to meet documents."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: dict[int, tuple[np.ndarray, np.ndarray, list[str], int, int]] = {}
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (item, text) in enumerate(items):
            hashes, kind, tokens = template(text)
            size = min(WINDOW, len(hashes))
            if not size:
                continue
            usable = _usable(kind, size)
            self.items[number] = (hashes, kind, tokens, size, len(usable))
            wanted = set(usable.tolist())
            for places, keys in readings(hashes, kind, size):
                for q, key in zip(places.tolist(), keys.tolist(), strict=True):
                    if q in wanted:
                        self.at[size][key].append((number, q))
        self.names = [item for item, _ in items]
        self.sorted = {size: np.sort(np.fromiter(at, dtype=np.uint64, count=len(at))) for size, at in self.at.items()}
        # A bit for each key's last bits: most windows need no search.
        self.bits = {size: max(12, min(26, (16 * len(known)).bit_length())) for size, known in self.sorted.items()}
        self.maybe = {size: np.zeros(1 << bits, dtype=bool) for size, bits in self.bits.items()}
        for size, known in self.sorted.items():
            self.maybe[size][(known & _U((1 << self.bits[size]) - 1)).astype(np.int64)] = True

    def _hits(self, texts: list[str]) -> dict[int, dict[int, set[tuple[int, int]]]]:
        """Of each text that shares windows with an item, the pairs of places, by the item's number."""
        hashes, kind, which = _templates(texts)
        first = np.searchsorted(which, np.arange(len(texts)))
        hits: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for size, known in self.sorted.items():
            last = _U((1 << self.bits[size]) - 1)
            for start in range(0, len(hashes), SLICE):
                end = start + SLICE + size - 1
                for where, own in readings(hashes[start:end], kind[start:end], size):
                    some = np.flatnonzero(self.maybe[size][(own & last).astype(np.int64)])
                    if not len(some):
                        continue
                    place = np.searchsorted(known, own[some])
                    place[place == len(known)] = 0
                    for k in some[known[place] == own[some]]:
                        p = start + int(where[k])
                        text = int(which[p])
                        if which[p + size - 1] == text:
                            for number, q in self.at[size][int(own[k])]:
                                hits[text][number].add((p - int(first[text]), q))
        return hits

    def leaks_of(self, texts: list[str]) -> list[list[tuple[int, float, int]]]:
        """For each text (item, covered share, first token's place) of every item that it contains."""
        found: list[list[tuple[int, float, int]]] = [[] for _ in texts]
        for text, hits in sorted(self._hits(texts).items()):
            own = None
            for number, pairs in sorted(hits.items()):
                theirs, their_kind, their_tokens, size, usable = self.items[number]
                if len({q for _, q in pairs}) < COVERAGE * usable:
                    continue
                own = own or template(texts[text])
                confirmed = self._confirmed(sorted(pairs), size, own, (theirs, their_kind, their_tokens))
                free = {q for _, q, slots in confirmed if not slots}
                best, first = 0, 0
                for hits_of in self._occurrences(confirmed):
                    consistent = self._consistent(hits_of)
                    covered = len(free.union(q for _, q in consistent))
                    if covered > best:
                        best, first = covered, min(p for p, _ in consistent or hits_of)
                if best >= COVERAGE * usable:
                    found[text].append((self.names[number], best / usable, first))
        return found

    def leaks(self, text: str) -> list[tuple[int, float, int]]:
        return self.leaks_of([text])[0]

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
        """(row, leaks) of every text of a column; a million characters are looked up at once, or one text."""
        rows, size, start = [], 0, 0
        for t in texts:
            rows.append(t.as_py() or "")
            size += len(rows[-1])
            if size > 1 << 20:
                yield from enumerate(self.leaks_of(rows), start)
                start += len(rows)
                rows, size = [], 0
        yield from enumerate(self.leaks_of(rows), start)

    @staticmethod
    def _occurrences(confirmed):
        """The document's hits as a whole; those of each diagonal; and each run in which the item's windows go forward."""
        diagonals, places = defaultdict(list), defaultdict(list)
        for hit in confirmed:
            diagonals[hit[0] - hit[1]].append(hit)
            places[hit[0]].append(hit)
        runs, last = [], -1
        for p in sorted(places):
            following = [q for _, q, _ in places[p] if q > last]
            if not runs or not following:
                runs.append([])
            last = min(following or [q for _, q, _ in places[p]])
            runs[-1] += places[p]
        return [confirmed, *diagonals.values(), *runs] if confirmed else []

    @staticmethod
    def _confirmed(pairs, size, own, theirs):
        """Pairs of windows whose tokens are truly the same, with what each slot value of the item stands for."""
        confirmed = []
        for p, q in pairs:
            slots, same, literal, words = [], True, 0, 0
            for k in range(size):
                kind, other = int(theirs[1][q + k]), int(own[1][p + k])
                word, stands = theirs[2][q + k].casefold(), own[2][p + k].casefold()
                literal += kind in (_WORD, _NAME) and word == stands
                words += kind in (_WORD, _NAME)
                if kind != other and {kind, other} != {_WORD, _NAME} or _WORD in (kind, other) and word != stands:
                    same = False
                    break
                if kind != _WORD:
                    slots.append(((kind, word), stands))
            if same and literal >= min(LITERALS, words):
                confirmed.append((p, q, slots))
        return confirmed

    @staticmethod
    def _consistent(hits):
        """Those of an occurrence's hits whose slots agree with what each value mostly stands for in it."""
        bindings = defaultdict(Counter)
        for _, _, slots in hits:
            for value, stands in slots:
                bindings[value][stands] += 1
        chosen = {value: max(stands.items(), key=lambda x: (x[1], x[0]))[0] for value, stands in bindings.items()}
        return [(p, q) for p, q, slots in hits if all(chosen[v] == s for v, s in slots)]


_LEAK = "item_id long, coverage double, first_token long"


def _shared(benchmark: DataFrame, item: str, text: str):
    """The whole benchmark as a broadcast index, where it has no more than BLOCK characters; else None."""
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    # An item counts as a hundred characters at least.
    if (items.agg(F.sum(F.length("t") + 100)).first()[0] or 0) > BLOCK:
        return None
    rows = [(r["i"], r["t"]) for r in items.collect()]
    return benchmark.sparkSession.sparkContext.broadcast(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])))


def _keyed(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, key) of every window of every size in ``sizes``."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            row = batch.column(0).to_numpy()
            hashes, kind, which = _templates(batch.column(1).to_pylist())
            for size in sizes:
                for start in range(0, len(hashes), SLICE):
                    end = start + SLICE + size - 1
                    for where, keys in readings(hashes[start:end], kind[start:end], size):
                        text = which[start + where]
                        own = text == which[start + where + size - 1]
                        yield pa.RecordBatch.from_arrays([pa.array(row[text[own]]), pa.array(keys[own].view(np.int64))], names=["row", "key"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, text) to (number, q, key, usable, size) of every usable window."""
    names = ["number", "q", "key", "usable", "size"]
    for batch in batches:
        found: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in names]
        for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            hashes, kind, _ = template(body.as_py())
            size = min(WINDOW, len(hashes))
            if not size:
                continue
            usable = _usable(kind, size)
            for places, keys in readings(hashes, kind, size):
                good = np.isin(places, usable)
                n = int(good.sum())
                own = (np.full(n, number), places[good], keys[good].view(np.int64), np.full(n, len(usable)), np.full(n, size))
                for column, part in zip(found, own, strict=True):
                    column.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=names)


def _joined(docs: DataFrame, benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """row, item_id, coverage, first_token by a hash-join of both sides' windows; ``docs``: row, text, written.

    A document's equal windows are one row before the shuffle, and a pair of document and item is confirmed by its texts.
    """
    items = durable(benchmark.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("number"), F.col(item).cast("long").alias("item_id"), F.col(text).alias("item")))
    theirs = durable(items.select("number", "item").mapInArrow(_item_windows, "number long, q long, key long, usable long, size long"))
    sizes = tuple(sorted(r["size"] for r in theirs.select("size").distinct().collect()))
    own = docs.mapInArrow(lambda batches: _keyed(batches, sizes), "row long, key long")
    # Windows that no item has go before anything is shuffled twice.
    met = own.join(theirs.select("key").distinct(), "key", "left_semi").distinct()
    enough = (
        met.join(theirs, "key").groupBy("row", "number").agg(F.count_distinct("q").alias("n"), F.first("usable").alias("usable"))
        .where(F.col("n") >= COVERAGE * F.col("usable")).select("row", "number")
    )
    both = enough.join(items, "number").join(docs, "row").select("row", "item_id", "item", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (row, *leak)
                for row, name, item, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
                for leak in Block([(name, item)]).leaks(body)
            ]
            yield _table(rows, "row")

    return both.mapInArrow(confirm, f"row long, {_LEAK}")


def _table(rows: list[tuple], first: str) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[first, "item_id", "coverage", "first_token"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, first_token: one row for each benchmark item that a row of ``docs`` contains.

    Null and empty texts on either side match nothing; an item under five tokens is one window; repeated rows are
    reported each, and so are repeated items. Columns besides doc_id, item_id and the texts are ignored.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    shared = _shared(benchmark, item, text)
    if shared is None:
        rows = durable(body.withColumn("row", F.monotonically_increasing_id()))
        found = _joined(rows.select("row", "text"), benchmark, item, text)
        return found.join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "coverage", "first_token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield _table([(ids[k], *leak) for k, leaks in block.batch(batch.column(1)) for leak in leaks], "doc_id")

    return body.mapInArrow(run, f"doc_id long, {_LEAK}")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; every other row as it was.

    Null and empty texts stay; repeated rows go or stay together; an empty table on either side changes nothing.
    """
    shared = _shared(benchmark, item, text)
    if shared is None:
        row = fresh(docs, "row")
        rows = durable(docs.withColumn(row, F.monotonically_increasing_id()))
        leaky = _joined(rows.select(F.col(row).alias("row"), text_of(text).alias("text")), benchmark, item, text)
        return rows.join(light(leaky.select(F.col("row").alias(row)).distinct()), row, "left_anti").select(docs.columns)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([not leaks for _, leaks in block.batch(batch.column(where))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
