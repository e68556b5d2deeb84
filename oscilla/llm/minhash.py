"""Near-duplicate classes by BagMinHash: unbiased weighted-Jaccard signatures, banding, exact multiset overlap.

A text is the multiset of its five-word shingles. Every shingle carries Poisson processes over time and weight, one
for each dyadic strip (0,1], (1,2], (2,4], ... of the weight axis; the strip's points are split down to the unit
levels that the shingle's count covers by their mark. Each register keeps the earliest point assigned to it, so two
texts agree in a register with the probability of their weighted Jaccard similarity.

Texts that are word for word the same are folded first. Buckets of texts that share a band are named by their first
text, and those of one name are one group, since the bands of near copies mostly have the same first text. A group is
compared in tiles of bounded size that hold the texts themselves, so that a text is sent once for each tile and not for
each pair; every pair that the signatures allow is verified there. In large groups the texts are verified against the
first one before: pairs within one class need no test, as the result is the class. There it is also counted how many of
a text's shingles any other text of the group has: two texts have no more in common than that, so whoever has too few for
the threshold is near none of them and meets none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, kept, light, numbered, text_of

SHINGLE, REGISTERS, ROWS, SIMILARITY = 5, 128, 4, 0.8
#: Signatures may fall this far below the threshold: over eight standard deviations of the estimate.
SLACK = 0.3
#: Texts and characters on one side of a tile.
TILE, ROOM = 256, 4_000_000
#: Groups of more texts are first verified against their first text.
HOT = 256
#: Characters of a large group whose shingles are counted in one task.
PART = 16_000_000
#: Columns of one product of tables of common shingles.
COLUMNS = 4096
_WORD = re.compile(r"\w+")
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[str]) -> np.ndarray:
    known = kept("word hashes", _Hashes)
    if len(known) > 200_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``size`` words; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = total * _U(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(total)


def multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and how often each occurs."""
    return np.unique(shingles(word_hashes(_WORD.findall(text.lower()))), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; of two empty ones 1."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum()) + int(b[1].sum()) - common
    return common / union if union else 1.0


def elements(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each occurrence as an element of its own: what two multisets have in common is then what two sets have."""
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(keys, counts) + nth.astype(np.uint64) * _U(0xD1342543DE82EF95))


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`overlap` of ``bags[a[k]]`` and ``bags[b[k]]`` for every k; where pairs are many, by products of tables."""
    if len(a) < 4 * len(bags):
        return np.array([overlap(bags[i], bags[j]) for i, j in zip(a, b, strict=True)])
    sizes = np.array([int(counts.sum()) for _, counts in bags])
    _, column, texts = np.unique(elements(*(np.concatenate([bag[k] for bag in bags]) for k in (0, 1))), return_inverse=True, return_counts=True)
    column = np.where(texts > 1, np.cumsum(texts > 1) - 1, -1)[column]
    order = np.argsort(column, kind="stable")
    column, text = column[order], np.repeat(np.arange(len(bags)), sizes)[order]
    left, i = np.unique(a, return_inverse=True)
    right, j = np.unique(b, return_inverse=True)
    common = np.zeros((len(left), len(right)))
    for low in range(0, int((texts > 1).sum()), COLUMNS):
        at = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        has = np.zeros((len(bags), COLUMNS), dtype=np.float32)
        has[text[at], column[at] - low] = 1
        common += has[left] @ has[right].T
    union = sizes[a] + sizes[b] - common[i, j]
    return np.where(union > 0, common[i, j] / np.maximum(union, 1), 1.0)


def signatures(keys: np.ndarray, counts: np.ndarray, docs: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) hashes of the earliest points; ``docs`` numbers each key's text. A text without keys has zeros.

    Points are drawn in rounds for all texts at once; a process ends when its next point is later than the latest
    register of its text, which is what makes few points a shingle enough.
    """
    strips = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 2))).astype(np.int64) + 1, 1)
    element = np.repeat(np.arange(len(keys)), strips)
    strip = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip == 0, 0, 1 << np.maximum(strip - 1, 0))
    width = np.maximum(low, 1).astype(float)
    doc, weight = docs[element], counts[element]
    seed = mix(keys[element] + (strip.astype(np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
    time = np.zeros(len(element))
    drawn = np.zeros(len(element), dtype=np.uint64)
    first = np.full(n * registers, np.inf)
    active = np.arange(len(element))
    while len(active):
        k = int(np.clip(16_384 // len(active), 1, 128))
        step = np.arange(1, k + 1, dtype=np.uint64)[None, :]
        bits = mix(seed[active][:, None] + (drawn[active][:, None] + step) * _U(0x9E3779B97F4A7C15))
        gap = -np.log(((bits >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (width[active] * registers)[:, None]
        # One running sum, point by point, so that the times don't depend on how many are drawn at once.
        times = np.add.accumulate(np.concatenate([time[active][:, None], gap], axis=1), axis=1)[:, 1:]
        other = mix(bits ^ _U(0xA0761D6478BD642F))
        mark = low[active][:, None] + 1 + np.floor((other >> _U(40)).astype(float) * 2.0**-24 * width[active][:, None]).astype(np.int64)
        inside = mark <= weight[active][:, None]
        register = (other % _U(registers)).astype(np.int64) + (doc[active] * registers)[:, None]
        np.minimum.at(first, register[inside], times[inside])
        time[active] = times[:, -1]
        drawn[active] += _U(k)
        latest = first.reshape(n, registers).max(axis=1)
        active = active[time[active] < latest[doc[active]]]
    found = mix(first.view(np.uint64))
    found[np.isinf(first)] = 0
    return found.reshape(n, registers)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, bands) keys as signed 64-bit numbers; the band's number is part of its key."""
    n, registers = signature.shape
    bands = registers // rows
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    for k in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + signature[:, k::rows][:, :bands])
    return key.view(np.int64)


_SIGNED = "row long, doc_id long, words binary, bands array<long>, signature binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            start, total = at, 0
            words, hashes = [], []
            while at < batch.num_rows and (total < 200_000 or at == start):
                found = _WORD.findall(batch.column(2)[at].as_py().lower())
                hashes.append(shingles(word_hashes(found)))
                words.append(xxhash.xxh3_128_digest(" ".join(found).encode("utf-8", "replace")))
                total += len(found)
                at += 1
            n = at - start
            docs = np.repeat(np.arange(n), [len(h) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.lexsort((flat, docs))
            flat, docs = flat[order], docs[order]
            new = np.ones(len(flat), dtype=bool)
            new[1:] = (flat[1:] != flat[:-1]) | (docs[1:] != docs[:-1])
            where = np.flatnonzero(new)
            counts = np.diff(np.append(where, len(flat)))
            signature = signatures(flat[where], counts, docs[where], n)
            bands = band_keys(signature)
            empty = np.array([len(h) == 0 for h in hashes])
            short = signature.astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[start:at],
                    batch.column(1)[start:at],
                    pa.array(words, pa.binary()),
                    pa.array([[] if e else b for e, b in zip(empty, bands, strict=True)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in short], pa.binary()),
                ],
                names=["row", "doc_id", "words", "bands", "signature"],
            )


def _tiles(limit: int, least: float):
    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        """Pairs of one tile between classes that the signatures allow: for two classes the ``limit`` likeliest."""
        n = table.num_rows
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        side = table.column("side").to_numpy()
        values = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype="<u2").reshape(n, -1)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        sized = "size" in table.column_names
        size, shared = (table.column(c).to_numpy() if sized else np.zeros(n) for c in ("size", "shared"))
        a, b, s = [], [], []
        for i in left:
            able = _enough(np.minimum(shared[right], shared[i]), size[right] + size[i])
            some = right[able & (labels[right] != labels[i]) & ((side[i] == 0) | (ids[right] > ids[i]))]
            alike = (values[some] == values[i]).mean(axis=1)
            ok = alike >= least
            a.append(np.full(int(ok.sum()), i))
            b.append(some[ok])
            s.append(alike[ok])
        a, b, s = (np.concatenate([np.zeros(0, dtype=kind), *x]) for x, kind in ((a, int), (b, int), (s, float)))
        more = False
        if len(a) > limit:
            low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
            order = np.lexsort((-s, high, low))
            a, b, low, high = a[order], b[order], low[order], high[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            rank = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            more = bool((rank >= limit).any())
            a, b = a[rank < limit], b[rank < limit]
        return pa.table(
            {"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "more": np.full(len(a), more)},
            schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())]),
        )

    return pairs


def _forest(a: list[int], b: list[int]) -> np.ndarray:
    """Which of the links (a[k], b[k]) join what those before them don't."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    needed = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x], needed[k] = y, True
    return needed


_COUNTED = "pivot long, part int, id long, elements binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of each text (id, text, groups of pivot and parts) once for each group, dealt out to its parts.

    Half of an element's bits are sent: two that are taken for one only add to what is counted as shared.
    """
    schema = pa.schema([("pivot", pa.int64()), ("part", pa.int32()), ("id", pa.int64()), ("elements", pa.binary())])
    for batch in batches:
        rows, total = [], 0
        for k in range(batch.num_rows):
            found = elements(*multiset(batch.column(1)[k].as_py()))
            low, short = found & _U(0xFFFFFFFF), (found >> _U(32)).astype("<u4")
            for group in batch.column(2)[k].as_py():
                part = low % _U(group["parts"])
                for p in range(group["parts"]):
                    rows.append((group["pivot"], p, batch.column(0)[k].as_py(), short[part == p].tobytes()))
                total += len(found)
            if total > 1_000_000 or len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, total = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """How many elements each text has in this part, and how many of them another text of the group has as well."""
    found = table.column("elements").to_pylist()
    size = np.array([len(x) // 4 for x in found])
    values = np.frombuffer(b"".join(found), dtype="<u4")
    order = np.argsort(values)
    same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    twice = np.zeros(len(values), dtype=bool)
    twice[order[same]] = twice[order[same + 1]] = True
    shared = np.bincount(np.repeat(np.arange(len(size)), size)[twice], minlength=len(size))
    return pa.table({"pivot": table.column("pivot"), "id": table.column("id"), "size": size, "shared": shared})


def _enough(shared, sizes):
    """Whether two texts of together ``sizes`` elements, ``shared`` of them common at most, may reach the threshold."""
    return shared * (1 + SIMILARITY) + 1e-6 >= sizes * SIMILARITY


def _links(least: float):
    candidates = _tiles(1 << 40, least)

    def links(key: tuple, table: pa.Table) -> pa.Table:
        """Pairs of one tile at the threshold or above, no more than hold its classes together."""
        pairs = candidates(key, table)
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        if len(a):
            ids, labels, side = (table.column(c).to_numpy() for c in ("id", "label", "side"))
            order = np.argsort(ids)
            i, j = (order[np.searchsorted(ids, x, sorter=order)] for x in (a, b))
            i, j = np.where(side[i] == 1, j, i), np.where(side[i] == 1, i, j)
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            bags = [multiset(text) for text in table.column("text").take(pa.array(used)).to_pylist()]
            near = overlaps(bags, place[: len(i)], place[len(i) :]) >= SIMILARITY
            needed = _forest(labels[i[near]].tolist(), labels[j[near]].tolist())
            a, b = a[near][needed], b[near][needed]
        return pa.table({"a": a, "b": b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) in the order of b, as a merge join gives them, so that b is read once."""
    last, known = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for k in range(batch.num_rows):
            if b[k] != last:
                last, known = b[k], multiset(batch.column(3)[k].as_py())
            keep.append(overlap(multiset(batch.column(2)[k].as_py()), known) >= SIMILARITY)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): the smallest id it is linked to over any number of links.

    Labels spread to neighbours and then jump to their label's label; every round is a written table.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = durable(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("heard"))
        spread = labels.join(heard, labels["id"] == heard["a"], "left").select(
            "id", F.least("label", "heard").alias("label"), F.col("label").alias("old")
        )
        target = labels.select(F.col("id").alias("to"), F.col("label").alias("next"))
        moved = durable(
            spread.join(target, spread["label"] == target["to"], "left").select(
                "id", F.least("label", "next").alias("label"), (F.least("label", "next") != F.col("old")).alias("changed")
            )
        )
        labels = moved.select("id", "label")
        if moved.where("changed").isEmpty():
            return labels


def _labelled(ids: DataFrame, labels: DataFrame) -> DataFrame:
    return ids.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _shared(members: DataFrame, large: DataFrame, bodies: DataFrame) -> DataFrame:
    """(pivot, id, size, shared) of the texts of ``large`` groups: their shingles, and those that another text there has."""
    of = members.join(large, "pivot")
    parts = of.join(bodies.select("id", "chars"), "id").groupBy("pivot").agg(F.ceil(F.sum("chars") / PART).cast("int").alias("parts"))
    groups = of.join(parts, "pivot").groupBy("id").agg(F.collect_list(F.struct("pivot", "parts")).alias("groups"))
    dealt = bodies.select("id", "text").join(groups, "id").mapInArrow(_parts, _COUNTED)
    counted = dealt.groupBy("pivot", "part").applyInArrow(_count, "pivot long, id long, size long, shared long")
    return durable(counted.groupBy("pivot", "id").agg(F.sum("size").alias("size"), F.sum("shared").alias("shared")))


def near_rows(docs: DataFrame, row: str, text: str = "text") -> DataFrame:
    """As :func:`near_classes`, and ``row``: the number of each row in column ``row`` of ``docs``, a written table."""
    body = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    signed = durable(body.mapInArrow(_sign, _SIGNED))
    # Copies word for word share their signature, so any of them stands for all.
    texts = durable(
        signed.groupBy("words").agg(F.min("row").alias("id"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"))
    )
    entries = texts.select("id", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = durable(entries.join(buckets, "band").where("id <> pivot").select("pivot", "id").distinct())
    members = stars.union(stars.select("pivot", F.col("pivot").alias("id")).distinct())
    wanted = members.select("id").distinct()
    bodies = durable(
        body.select(F.col("row").alias("id"), "text", F.length("text").alias("chars")).join(light(wanted), "id", "left_semi")
    )
    # The first text comes last in the join, hence read once for all its group's.
    large = durable(stars.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("pivot"))
    found = (
        stars.join(large, "pivot")
        .select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        .join(bodies.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(bodies.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    )
    links = durable(found.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))
    known = components(links)
    # Of a large group the first text's class is set apart: its texts meet the others only.
    of = known.select(F.col("id").alias("pivot"), F.col("label").alias("first"))
    placed = durable(
        _labelled(members, known)
        .join(of, "pivot", "left")
        .withColumn("apart", F.coalesce(F.col("label") == F.col("first"), F.lit(False)))
        .join(bodies.select("id", "chars"), "id")
        .join(_shared(members, large, bodies), ["pivot", "id"], "left")
        .fillna(0, ["size", "shared"])
        # Near means that what is common is at least that share of either text.
        .where(F.col("shared") + 1e-6 >= F.col("size") * SIMILARITY)
    )

    def tiles_of(some: Column) -> Column:
        return F.ceil(F.sum(F.when(some, F.greatest(F.lit(1 / TILE), F.col("chars") / ROOM)).otherwise(0))).cast("int")

    groups = (
        placed.groupBy("pivot")
        .agg(tiles_of(~F.col("apart")).alias("tiles"), tiles_of(F.col("apart")).alias("more"), F.min("label").alias("l"), F.max("label").alias("h"))
        .where("l <> h")
        .drop("l", "h")
    )
    tile = F.when(F.col("apart"), F.col("tiles") + F.pmod(F.xxhash64("id"), "more")).otherwise(F.pmod(F.xxhash64("id"), "tiles")).cast("int")
    last = F.when(F.col("apart"), F.col("tiles")).otherwise(F.col("tiles") + F.col("more")) - 1
    spread = (
        placed.join(groups, "pivot")
        .withColumns({"tile": tile, "other": F.explode(F.sequence(F.lit(0), last))})
        .select(
            "pivot",
            F.least("tile", "other").alias("i"),
            F.greatest("tile", "other").alias("j"),
            F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1).alias("side"),
            "id",
            "label",
            "size",
            "shared",
        )
    )
    tiles = spread.join(bodies.select("id", "text"), "id").join(texts.select("id", "signature"), "id")
    near = durable(tiles.groupBy("pivot", "i", "j").applyInArrow(_links(SIMILARITY - SLACK), "a long, b long"))
    labels = components(links.union(near))
    classes = _labelled(texts.select("id", "words"), labels).select("words", "label")
    rows = durable(signed.select("row", "doc_id", "words").join(classes, "words"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    whole = rows.groupBy("label").agg(first, F.count("*").alias("class_size"))
    return rows.join(whole, "label").select(
        "row", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept")
    )


def near_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (its class's smallest doc_id), class_size, kept.

    A class is what links of similarity 0.8 or more hold together. Null text counts as empty, and texts without words
    are one class; texts under five words are one shingle. A null doc_id names a class only where there is no other;
    of rows repeated under the class_id one is kept. Other columns are ignored; an empty table gives no rows.
    """
    return near_rows(*numbered(docs.select("doc_id", text)), text).drop("row")


def drop_near(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of :func:`near_classes`; of nulls, empty texts and repeats the same holds.

    ``docs`` is written once with its rows numbered. Every column stays, whatever its name; an empty table stays empty.
    """
    rows, row = numbered(docs)
    dropped = near_rows(rows, row, text).where(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(light(dropped), row, "left_anti").drop(row)
