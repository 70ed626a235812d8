"""Benchmark decontamination: which documents contain a test item.

Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes; a shingle is five words (of a shorter text,
all of them together; a text without words has none). A document contains an item if it has at least `threshold` of
the item's distinct shingles, anywhere in it. Null texts contain nothing; items that are null or have no word are
found nowhere. Repeated rows of either table are answered for each row.

Candidates come from a size-partitioned MinHash search. Items are dealt into classes whose shingle count ends at
16, 32, 64 ... For each class a document is cut into windows of twice that many shingles, overlapping by half, so a
short item and the window around it are of like size, however long the document is; an item and a window meet if one
of `functions` minima agrees. At the least overlap that matters (an item half as long as its class allows, four
fifths of it inside the window) a pair meets with probability over 0.9999. Windows of larger classes are merged from
those of the smaller ones. Items with fewer different shingles than that (all of the least class, and such as repeat
themselves) are looked up instead: of n shingles a document that contains the item lacks n - ceil(threshold * n) at
most, so one of any n - ceil(threshold * n) + 1 is in it, and none of those items is missed. Candidates are verified
by exact containment over the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import mix64, slices, small_batches, table, utf8_buffers

WIDTH, THRESHOLD, FUNCTIONS, LEAST_CLASS = 5, 0.8, 48, 16
#: Items are searched for in blocks of at most so many bytes of text, each block in a pass of its own over the documents.
BLOCK_BYTES = 2 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_ODD = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word in rows of UTF-8 bytes, and the row it is in."""
    inside = _WORD_BYTE[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    starts, lengths = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lengths = lengths - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    values = (_LOWER[data[inside]] + np.uint64(1)) * _ODD[place & 1023]
    hashes = mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _ODD[1024])
    return hashes, np.searchsorted(bounds, starts, "right") - 1


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle of rows of UTF-8 bytes, and the row it is in, rows ascending."""
    words, rows = word_hashes(data, bounds)
    counts = np.bincount(rows, minlength=len(bounds) - 1)
    full = max(len(words) - width + 1, 0)
    hashes = np.zeros(full, np.uint64)
    for j in range(width):
        hashes += words[j : full + j] * _ODD[2048 + j]
    whole = rows[:full] == rows[width - 1 :] if full else np.zeros(0, bool)
    hashes, at = mix64(hashes[whole]), rows[:full][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        own = [mix64(np.array([sum(int(words[first[r] + j]) * int(_ODD[2048 + j]) for j in range(counts[r])) + int(counts[r]) & (1 << 64) - 1], np.uint64))[0] for r in short]
        hashes, at = np.concatenate((hashes, np.array(own, np.uint64))), np.concatenate((at, short))
        order = np.argsort(at, kind="stable")
        hashes, at = hashes[order], at[order]
    return hashes, at


def minima(hashes: np.ndarray, function: int, starts: np.ndarray) -> np.ndarray:
    """The least 32-bit value under one hash function in each run of hashes that begins at starts."""
    h = hashes * _ODD[3000 + function]
    h ^= h >> np.uint64(29)
    return np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), starts)


def shingles(text: bytes, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves."""
    words = WORD.findall(text.lower())
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(width)), strict=False))


@dataclass
class ItemIndex:
    """Minima of a block of items by size class and hash function, shingles of the short ones, and what verification needs."""

    ids: list
    shingles: list[set]
    classes: list[int]
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    short: tuple[np.ndarray, np.ndarray, np.ndarray]
    bits: int

    @classmethod
    def of(cls, ids: list, texts: list[str], functions: int, width: int, threshold: float = THRESHOLD) -> ItemIndex:
        raw = [t.encode() for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        hashes, rows = shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds, width)
        sizes = np.bincount(rows, minlength=len(raw))
        present = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes[present]) - sizes[present]).astype(np.int64)
        bits = int(np.clip(np.ceil(np.log2(64 * (len(present) + 1))), 12, 22))
        different = np.array([len(np.unique(hashes[a : a + n])) for a, n in zip(starts, sizes[present], strict=True)], np.int64)
        few = np.zeros(len(raw), bool)
        classes, tables, upper, below = [], [], LEAST_CLASS, 0
        values = [minima(hashes, k, starts) if len(starts) else np.zeros(0, np.uint32) for k in range(functions)]
        while len(present) and below < sizes.max():
            of_size = (sizes[present] > below) & (sizes[present] <= upper)
            is_few = different <= max(LEAST_CLASS, upper // 2)
            few[present[of_size & is_few]] = True
            chosen = np.flatnonzero(of_size & ~is_few)
            of_class = []
            for k in range(functions):
                own = values[k][chosen]
                of_class.append(_lookup(own, present[chosen], bits))
            classes.append(upper)
            tables.append(of_class if len(chosen) else [])
            below, upper = upper, upper * 2
        short = _lookup(*_needed(hashes[few[rows]], rows[few[rows]], threshold), bits)
        return cls(ids, [shingles(r, width) for r in raw], classes, tables, short, bits)

    def candidates(self, hashes: np.ndarray, rows: np.ndarray, n_rows: int, functions: int) -> np.ndarray:
        """Distinct row * items + item of rows and items that share a minimum in some window or a shingle looked up."""
        found: list[np.ndarray] = []
        if not len(hashes) or not self.classes:
            return np.zeros(0, np.int64)
        found.append(self._meet(hashes, rows, self.short))
        sizes = np.bincount(rows, minlength=n_rows)
        for k in range(functions if any(self.tables) else 0):
            step, values, own = LEAST_CLASS, None, None
            for upper, of_class in zip(self.classes, self.tables, strict=True):
                if values is None:
                    blocks, starts, own = _runs(sizes, step)
                    values = minima(hashes, k, starts)
                else:
                    blocks, starts, own = _runs(blocks, 2)
                    values = np.minimum.reduceat(values, starts)
                if not of_class:
                    continue
                windows = values.copy()
                same = own[1:] == own[:-1]
                windows[:-1][same] = np.minimum(values[:-1][same], values[1:][same])
                found.append(self._meet(windows, own, of_class[k]))
        return np.unique(np.concatenate(found))

    def _meet(self, values: np.ndarray, own: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Distinct row * items + item where one of the values, of rows own, is an item's."""
        sorted_values, items, seen = known
        hit = np.flatnonzero(seen[_top(values, self.bits)])
        low = np.searchsorted(sorted_values, values[hit], "left")
        many = np.searchsorted(sorted_values, values[hit], "right") - low
        spread = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.unique(np.repeat(own[hit], many) * len(self.ids) + items[spread])


def _top(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> values.dtype.type(8 * values.dtype.itemsize - bits)


def _lookup(values: np.ndarray, items: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values sorted, their items, and which leading bits occur."""
    order = np.argsort(values, kind="stable")
    seen = np.zeros(1 << bits, bool)
    seen[_top(values, bits)] = True
    return values[order], items[order], seen


def _needed(hashes: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """So many of each row's distinct hashes, the rarest first, that a text without them all has less than the threshold."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, rows = hashes[first], rows[first]
    _, which, uses = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.lexsort((hashes, uses[which], rows))
    hashes, rows = hashes[order], rows[order]
    sizes = np.bincount(rows) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
    wanted = sizes - np.maximum(np.ceil(threshold * sizes), 1) + 1
    keep = place < wanted[rows]
    return hashes[keep], rows[keep]


def _runs(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of so many elements cut into runs of step: runs of each row, where each run starts, and its row."""
    blocks = -(-sizes // step)
    own = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return blocks, (np.cumsum(sizes) - sizes)[own] + nth * step, own


def _item_blocks(spark: SparkSession, items: DataFrame, item_id_col: str, item_text_col: str, threshold: float, width: int, functions: int) -> Iterator:
    """Broadcast indexes of the items, a block of at most BLOCK_BYTES each; only one block at a time is on the driver."""
    small = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = small.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    for block in range(blocks):
        own = small.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else small
        rows = own.collect()
        yield spark.sparkContext.broadcast(ItemIndex.of([r.item_id for r in rows], [r.text for r in rows], functions, width, threshold))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every document that contains an item.

    Only a block of items of at most BLOCK_BYTES comes to the driver and is sent to the executors at a time; the
    documents are not shuffled.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_types = source.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    found = None
    for index in _item_blocks(docs.sparkSession, items, item_id_col, item_text_col, threshold, width, functions):
        part = source.mapInArrow(_searcher(index, threshold, width, functions), f"doc_id {id_types[0]}, item_id {id_types[1]}, n_shared long, n_item long, containment double")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, functions: int = FUNCTIONS) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; rows are judged where they are, without a shuffle."""
    place = docs.columns.index(text_col)
    for index in _item_blocks(docs.sparkSession, items, item_id_col, item_text_col, threshold, width, functions):
        docs = docs.mapInArrow(_sieve(index, place, threshold, width, functions), docs.schema)
    return docs


def _hits(known: ItemIndex, column: pa.Array, threshold: float, width: int, functions: int) -> tuple[list[int], list[int], list[int]]:
    """Rows of a text column, items they contain, and how many shingles they share."""
    bounds, data = utf8_buffers(column)
    rows_out, items_out, shared_out = [], [], []
    for a, b in slices(bounds, 1 << 19):
        raw = data[bounds[a] : bounds[b]]
        at = bounds[a : b + 1] - bounds[a]
        hashes, rows = shingle_hashes(raw, at, width)
        pairs = known.candidates(hashes, rows, b - a, functions)
        last, own = -1, set()
        for row, item in zip((pairs // max(1, len(known.ids))).tolist(), (pairs % max(1, len(known.ids))).tolist(), strict=True):
            if row != last:
                last, own = row, shingles(raw[at[row] : at[row + 1]].tobytes(), width)
            wanted = known.shingles[item]
            shared = sum(s in own for s in wanted)
            if shared >= threshold * len(wanted):
                rows_out.append(a + row)
                items_out.append(item)
                shared_out.append(shared)
    return rows_out, items_out, shared_out


def _sieve(index, place: int, threshold: float, width: int, functions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[_hits(index.value, batch.column(place), threshold, width, functions)[0]] = False
            yield batch.filter(pa.array(clean))

    return run


def _searcher(index, threshold: float, width: int, functions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: ItemIndex = index.value
        item_type = pa.int64() if all(isinstance(x, int | None) for x in known.ids) else None
        for batch in batches:
            rows_out, items_out, shared_out = _hits(known, batch.column(1), threshold, width, functions)
            n_item = [len(known.shingles[i]) for i in items_out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows_out, pa.int64())),
                    pa.array([known.ids[i] for i in items_out], item_type),
                    pa.array(shared_out, pa.int64()),
                    pa.array(n_item, pa.int64()),
                    pa.array([s / n for s, n in zip(shared_out, n_item, strict=True)], pa.float64()),
                ],
                names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
            )

    return run


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_item of every document and benchmark item it contains."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, row by row; other rows of the same id, or without one, stay."""
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}

ORACLES = {
    "op1_decontamination": """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM dw WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM iw WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY 1),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item
"""
}
