"""Exact substring deduplication: every byte inside a 50-byte string that starts in an earlier document as well goes.

Texts are UTF-8 bytes (null: empty); matches never cross documents; strings are judged on the input. Rows that share
an id are one document, whose rows do not remove each other; a row without id comes after all others.

Each 50-byte window has one anchor, the leftmost least-hashed 28-byte string in it, so equal windows have equal
anchors. Neighbouring windows with one anchor make a fragment. Anchors are grouped over the cluster. A fragment that an
earlier document has whole is settled by its hash; only where an anchor has several different fragments (the edges of
repeats, and chance repeats of an anchor) are the fragments themselves compared, bucket by bucket: their
Burrows-Wheeler transform is extended backwards breadth-first, which finds the places where the common prefix of
neighbouring suffixes ends at length 0, 1, 2 ... and stops at 50; suffixes between two such places share 50 bytes.

An anchor that many documents share sends one row for each input slice and distinct fragment, not one for each document.

The number of parts and buckets follows the bytes counted. An anchor with very many different surroundings (the edge of
a passage that a third of all documents hold) would still make one part, and one bucket, as large as the input allows.
Such anchors are looked for on a sample, and fragments around them are dealt by the hash of each of their 50-byte
windows instead, which has no hot group: equal windows are settled by the smallest id, first inside a slice, then over
the cluster. The sample decides which of the two ways a fragment takes, not what is found; both are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, mix64, slices, table, utf8_buffers

LENGTH, ANCHOR = 50, 28
#: Window starts looked at together, and bytes of fragments compared together.
CHUNK, BUCKET = 1 << 20, 1 << 20
#: Bytes of text read at a time, and for each part of the shuffle.
SLICE_BYTES, PART_BYTES = 1 << 24, 1 << 24
#: One in so many texts is looked at for hot anchors; the share of a part's fragments, and their least number, that make
#: an anchor hot; most such anchors.
SAMPLE, HOT_SHARE, HOT, MOST_HOT = 16, 0.125, 1024, 1_000_000
#: Bytes of text for each fragment, about.
STRIDE = 12
BASE = 0x9E3779B97F4A7C15
LAST = np.iinfo(np.int64).max

_ANCHORS = "part int, ids array<long>, ths array<long>, counts array<int>, starts array<int>, more array<tinyint>, anchors array<int>, low array<int>, high array<smallint>, spans array<int>"
_FOUND = "id long, th long, starts array<int>, more array<int>, open_starts array<int>, open_more array<int>, anchors array<long>"


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _fragments(data: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """doc, first window, windows after it, anchor hash, fragment hash, single (False) of all fragments of the rows.

    Instead of a fragment whose anchor is among `hot` (sorted) come its windows, one by one, each its own anchor (single).
    """
    owner_ends = bounds[1:]
    for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        text = data[at : at + CHUNK + LENGTH - 1].astype(np.uint64)
        n = len(text) - LENGTH + 1
        h2 = text[:-1] * _power(1) + text[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        h16 = h8[:-8] * _power(8) + h8[8:]
        spots = n + LENGTH - ANCHOR
        h12 = h8[16 : spots + 16] * _power(4) + h4[24 : spots + 24]
        anchors = mix64(h16[:spots] * _power(12) + h12)
        least = (anchors & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(anchors), dtype=np.uint64)
        span, width = LENGTH - ANCHOR + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: n], least[span - width : span - width + n])
        place = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        first_doc, last_doc = np.searchsorted(owner_ends, [at, at + n - 1], "right")
        ends = owner_ends[first_doc : last_doc + 1]
        inside = np.ones(n + 1, bool)
        for end in ends.tolist():
            inside[max(0, end - LENGTH + 1 - at) : max(0, min(n, end - at))] = False
        inside[n] = False
        change = np.flatnonzero((place[1:] != place[:-1]) | (inside[1:n] != inside[: n - 1])) + 1
        begins = np.concatenate(([0], change))
        finish = np.concatenate((change, [n])) - 1
        good = inside[begins]
        begins, finish = begins[good], finish[good]
        if not len(begins):
            continue

        def window(s: np.ndarray) -> np.ndarray:
            whole = (h16[s] * _power(16) + h16[s + 16]) * _power(16) + h16[s + 32]
            return whole * _power(2) + h2[s + 48]

        own = anchors[place[begins]]
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
            if is_hot.any():
                first, many = begins[is_hot], (finish - begins + 1)[is_hot]
                each = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                docs = np.searchsorted(owner_ends, each + at, "right")
                key = mix64(window(each) * np.uint64(0xD1B54A32D192ED03) + np.uint64(LENGTH))
                yield docs, each + at - bounds[docs], np.zeros(len(each), np.int64), key, key, np.ones(len(each), bool)
                begins, finish, own = begins[~is_hot], finish[~is_hot], own[~is_hot]
        same = mix64(mix64(window(begins)) + window(finish) * np.uint64(0xD1B54A32D192ED03) + (finish - begins).astype(np.uint64))
        docs = np.searchsorted(owner_ends, begins + at, "right")
        yield docs, begins + at - bounds[docs], finish - begins, own, same, np.zeros(len(docs), bool)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _merged(docs: np.ndarray, starts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts, sorted by document, with touching runs joined."""
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], (starts + more)[order]
    if not len(docs):
        return docs, starts, ends
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (starts[1:] > ends[:-1] + 1)))
    at = np.flatnonzero(new)
    return docs[at], starts[at], np.maximum.reduceat(ends, at) - starts[at]


def _hot_anchors(source: DataFrame, part_bytes: float) -> np.ndarray:
    """Anchors whose different fragments are HOT_SHARE of a part or more, as a sample of the texts has it, sorted.

    What comes to the driver is at most eight megabytes (MOST_HOT); if more anchors are hot, the hottest are taken.
    """
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = utf8_buffers(batch.column(0))
            for a, b in slices(bounds, SLICE_BYTES):
                for _, _, _, anchors, same, _ in _fragments(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], none):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (anchors, same)], names=["anchor", "same"])

    seen = source.where(F.pmod("th", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "anchor long, same long")
    sizes = materialize(seen.distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE >= max(HOT, HOT_SHARE * part_bytes / STRIDE)))
    levels = sorted(((r.level, r.anchors) for r in sizes.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("anchors")).collect()), reverse=True)
    least, total = None, 0
    for level, anchors in levels:
        total += anchors
        if total > MOST_HOT:
            break
        least = level
    if least is None:
        return none
    return np.sort(np.array([r.anchor for r in sizes.where(F.col("n") >= 2**least).select("anchor").collect()], np.int64).view(np.uint64))


def _anchor_rows(source: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """For each input slice and part, the anchors in it; copies inside the slice are settled at once.

    Parts from `parts` on hold single windows.
    """
    shared = source.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = utf8_buffers(batch.column(2))
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(bounds, SLICE_BYTES):
                yield from rows_of(ids[a:b], ths[a:b], data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])

    def rows_of(ids: np.ndarray, ths: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        pieces = list(_fragments(data, bounds, shared.value))
        if not pieces:
            return
        docs, starts, more, anchors, same, single = (np.concatenate(x) for x in zip(*pieces, strict=True))
        del pieces
        order = np.lexsort((ids[docs], same))
        head = np.concatenate(([True], same[order][1:] != same[order][:-1]))
        least = np.empty(len(order), np.int64)
        least[order] = ids[docs[order]][np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = ids[docs] > least
        yield from _settled_rows(ids, ths, *_merged(docs[later], starts[later], more[later]), parts)
        docs, starts, more, anchors, same, single = (x[~later] for x in (docs, starts, more, anchors, same, single))
        part = (anchors % np.uint64(parts)).astype(np.int64) + parts * single
        order = np.lexsort((docs, part))
        part, docs, starts, more, anchors, same = (x[order] for x in (part, docs, starts, more, anchors, same))
        numbers = part[np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))]
        offsets = np.concatenate((np.searchsorted(part, numbers), [len(part)]))
        runs = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (part[1:] != part[:-1]))))
        run_offsets = np.searchsorted(runs, offsets)
        counts = np.diff(np.concatenate((runs, [len(part)])))
        own = docs[runs]
        top = anchors >> np.uint64(32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(numbers, pa.int32()),
                _lists(ids[own], run_offsets, pa.int64()),
                _lists(ths[own], run_offsets, pa.int64()),
                _lists(counts, run_offsets, pa.int32()),
                _lists(starts, offsets, pa.int32()),
                _lists(more, offsets, pa.int8()),
                _lists(top.astype(np.uint32).view(np.int32), offsets, pa.int32()),
                _lists((same & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), offsets, pa.int32()),
                _lists((same >> np.uint64(48)).astype(np.uint16).view(np.int16), offsets, pa.int16()),
                _lists(np.zeros(0, np.int32), np.zeros(len(numbers) + 1), pa.int32()),
            ],
            names=[x.split()[0] for x in _ANCHORS.split(", ")],
        )

    return source.mapInArrow(run, _ANCHORS)


def _settled_rows(ids: np.ndarray, ths: np.ndarray, docs: np.ndarray, starts: np.ndarray, more: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    if len(docs):
        heads = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        offsets = np.concatenate((heads, [len(docs)]))
        own, none, ones = docs[heads], np.zeros(len(heads) + 1), np.arange(len(heads) + 1)
        empty = np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((mix64(ids[own].view(np.uint64) ^ ths[own].view(np.uint64)) % np.uint64(parts)).astype(np.int32)),
                _lists(ids[own], ones, pa.int64()),
                _lists(ths[own], ones, pa.int64()),
                _lists(np.diff(offsets), ones, pa.int32()),
                _lists(starts, offsets, pa.int32()),
                *[_lists(empty, none, t) for t in (pa.int8(), pa.int32(), pa.int32(), pa.int16())],
                _lists(more, offsets, pa.int32()),
            ],
            names=[x.split()[0] for x in _ANCHORS.split(", ")],
        )


def _settle(part: pa.Table, parts: int) -> pa.Table:
    """For each document in a part, what fragment hashes settle (starts, more) and the fragments that have to be compared.

    Single windows (parts from `parts` on) are settled by their hash alone.
    """
    settled = part.filter(pc.greater(pc.list_value_length(part["spans"]), 0))
    open_ = part.filter(pc.equal(pc.list_value_length(part["spans"]), 0))
    empty = _lists(np.zeros(0, np.int32), np.zeros(len(settled) + 1), pa.int32())
    out = [[pc.list_flatten(settled["ids"]), pc.list_flatten(settled["ths"]), settled["starts"], settled["spans"], empty, empty, empty.cast(pa.list_(pa.int64()))]]
    flat = {x: pc.list_flatten(open_[x]).to_numpy() for x in ("ids", "ths", "counts", "starts", "more", "anchors", "low", "high")}
    ids, ths = np.repeat(flat["ids"], flat["counts"]), np.repeat(flat["ths"], flat["counts"])
    starts, more, anchors = flat["starts"], flat["more"].astype(np.int32), flat["anchors"]
    same = flat["low"].astype(np.uint32).astype(np.uint64) | flat["high"].astype(np.uint16).astype(np.uint64) << np.uint64(32)
    if len(ids):
        order = np.lexsort((ids, same, anchors))
        ids, ths, starts, more, anchors, same = (x[order] for x in (ids, ths, starts, more, anchors, same))
        group = np.concatenate(([True], anchors[1:] != anchors[:-1]))
        head = group | np.concatenate(([True], same[1:] != same[:-1]))
        first = np.flatnonzero(head)
        later = ids > ids[first][np.cumsum(head) - 1]
        begins = np.flatnonzero(group)
        kept_ids = np.where(later, ids[begins][np.cumsum(group) - 1], ids)
        several = np.minimum.reduceat(kept_ids, begins) < np.maximum.reduceat(kept_ids, begins)
        number = int(part["part"][0].as_py())
        contested = ~later & several[np.cumsum(group) - 1] & (number < parts)
        at = np.flatnonzero(later | contested)
        at = at[np.lexsort((starts[at], ths[at], ids[at]))]
        if len(at):
            heads = np.concatenate(([True], (ids[at][1:] != ids[at][:-1]) | (ths[at][1:] != ths[at][:-1])))
            row, docs = np.cumsum(heads) - 1, at[heads]
            numbered = np.arange(len(docs) + 1)
            lists = []
            for chosen, columns in ((later, ((starts, pa.int32()), (more, pa.int32()))), (contested, ((starts, pa.int32()), (more, pa.int32()), ((anchors.astype(np.int64) & 0xFFFFFFFF) | number << 32, pa.int64())))):
                own = chosen[at]
                offsets = np.searchsorted(row[own], numbered)
                lists += [_lists(values[at[own]], offsets, kind) for values, kind in columns]
            out.append([pa.array(ids[docs]), pa.array(ths[docs]), *lists])
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64())]
    schema = pa.schema([(x.split()[0], kind) for x, kind in zip(_FOUND.split(", "), kinds, strict=True)])
    return pa.concat_tables([pa.table(columns, names=schema.names).cast(schema) for columns in out])


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text ordered by what follows them, up to depth symbols and not past their own end; ties in any order."""
    n = len(text)
    left = ends - np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        if j < n:
            key[: n - j] |= np.where(left[: n - j] > j, text[j:], 0).astype(np.uint64)
    have = 8
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([1], key[order][1:] != key[order][:-1]))).astype(np.uint64)
        key = rank << np.uint64(32)
        key[: max(n - have, 0)] |= np.where(left[: max(n - have, 0)] > have, rank[have:], 0)
        have *= 2


def shared_intervals(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of rows of bytes, and True where a suffix shares fewer than `length` symbols with the one before it.

    text holds no zero bytes but a row's last one, which is its end mark. With the transform's symbols sorted, the
    suffix at place i continues at place psi[i]. A place splits at prefix length l + 1 if its first symbol is new or if
    one of the places in (psi[i - 1], psi[i]] split at length l: each round extends the last round's splits backwards
    by one symbol, breadth-first, looks only at places that are still whole, and the rounds stop at `length`.
    """
    order = suffix_order(text, ends, 64)
    n = len(text)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    psi = inverse[np.minimum(order + 1, n - 1)]
    first = text[order]
    split = np.concatenate(([True], first[1:] != first[:-1]))
    split |= first == 0
    fresh, whole = split.copy(), np.flatnonzero(~split)
    for _ in range(length - 1):
        if not len(whole) or not fresh.any():
            break
        upto = np.cumsum(fresh, dtype=np.int32)
        now = upto[psi[whole]] != upto[psi[whole - 1]]
        fresh = np.zeros(n, bool)
        fresh[whole[now]] = True
        split |= fresh
        whole = whole[~now]
    return order, split


def _later_windows(text: np.ndarray, ends: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Positions of text (ids: of each position's document) whose next `length` bytes an earlier document has too."""
    order, split = shared_intervals(text, ends, length)
    heads = np.flatnonzero(split)
    least = np.minimum.reduceat(ids[order], heads)[np.cumsum(split) - 1]
    return np.sort(order[ids[order] > least])


def _compare(bucket: pa.Table) -> pa.Table:
    """id, th, starts, more of the windows in a bucket of fragments that an earlier document has."""
    anchors = bucket["anchor"].to_numpy()
    order = np.argsort(anchors, kind="stable")
    ids, ths, starts = (bucket[x].to_numpy()[order] for x in ("id", "th", "start"))
    sizes = pc.binary_length(bucket["piece"]).to_numpy()[order].astype(np.int64)
    anchors, pieces = anchors[order], bucket["piece"].take(pa.array(order)).to_pylist()
    new = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    total, cuts = np.concatenate(([0], np.cumsum(sizes + 1))), [0]
    for g in new[1:].tolist():
        if total[g] - total[cuts[-1]] >= BUCKET:
            cuts.append(g)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(pieces)], strict=True):
        raw = np.frombuffer(b"\x00".join(pieces[a:b]) + b"\x00", np.uint8)
        # zero marks an end; a zero byte inside a text becomes 255, which UTF-8 never has
        length = sizes[a:b] + 1
        ends = np.repeat(np.cumsum(length), length)
        row = np.repeat(np.arange(a, b), length)
        marks = np.zeros(len(raw), bool)
        marks[np.cumsum(length) - 1] = True
        text = np.where(marks, 0, np.where(raw == 0, 255, raw)).astype(np.uint8)
        if len(text):
            hit = _later_windows(text, ends, ids[row], LENGTH)
            docs, s, m = _merged(row[hit], starts[row[hit]] + hit - (np.cumsum(length) - length)[row[hit] - a], np.zeros(len(hit), np.int64))
            out.append((docs, s, m))
    docs, s, m = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    one = np.arange(len(docs) + 1)
    return pa.table([pa.array(ids[docs]), pa.array(ths[docs]), _lists(s, one, pa.int32()), _lists(m, one, pa.int32())], names=["id", "th", "starts", "more"])


def _packed(docs: DataFrame) -> DataFrame:
    """id, th, packed: texts compressed for their way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            texts = [codec.compress(x.as_buffer(), asbytes=True) if x.is_valid else b"" for x in batch.column(2)]
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], names=["id", "th", "n_bytes", "packed"])

    return docs.mapInArrow(run, "id long, th long, n_bytes long, packed binary")


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, decompressed_size=size, asbytes=True) if size else b""


def _pieces(contested: DataFrame, packed: DataFrame) -> DataFrame:
    """anchor, id, th, start, piece: the bytes of contested fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            columns = (batch.column(i).to_pylist() for i in range(7))
            for id_, th, size, packed_text, starts, more, anchors in zip(*columns, strict=True):
                text = _unpack(packed_text, size)
                for s, m, a in zip(starts, more, anchors, strict=True):
                    for column, value in zip(out, (a, id_, th, s, text[s : s + m + LENGTH]), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["anchor", "id", "th", "start", "piece"])

    found = contested.groupBy("id", "th").agg(*[F.flatten(F.collect_list(x)).alias(y) for x, y in (("open_starts", "starts"), ("open_more", "more"), ("anchors", "anchors"))])
    joined = packed.dropDuplicates(["id", "th"]).join(found, ["id", "th"])
    return joined.select("id", "th", "n_bytes", "packed", "starts", "more", "anchors").mapInArrow(run, "anchor long, id long, th long, start int, piece binary")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (a hash of the text), starts, more: runs of 50-byte windows that an earlier document has too.

    A run starts at byte `start` and has `more` windows after the first; runs of one document may touch.
    """
    source = _source(docs, id_col, text_col)
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dealt = _anchor_rows(source, parts, _hot_anchors(source, size / parts)).repartition(parts, "part")
    found = materialize(dealt.groupBy("part").applyInArrow(lambda part: _settle(part, parts), _FOUND))
    pieces = _pieces(found.where("size(anchors) > 0"), _packed(source))
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(8 * parts)).alias("bucket")  # more than tasks, to even them out
    compared = pieces.select(bucket, "*").repartition(parts, "bucket").groupBy("bucket").applyInArrow(_compare, "id long, th long, starts array<int>, more array<int>")
    return found.where("size(starts) > 0").select("id", "th", "starts", "more").unionByName(compared)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain) for every row of docs."""
    source = _source(docs, id_col, text_col)
    runs = repeated_windows(docs, id_col, text_col).groupBy("id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("more")).alias("more"))
    joined = _packed(source).join(materialize(runs), ["id", "th"], "left").select("id", "n_bytes", "packed", "starts", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for size, packed, starts, more in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                text = _unpack(packed, size)
                if starts:
                    step = np.zeros(size + 1, np.int32)
                    begins = np.asarray(starts)
                    np.add.at(step, begins, 1)
                    np.add.at(step, begins + np.asarray(more) + LENGTH, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    removed.append(int(gone.sum()))
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                else:
                    spans.append(0)
                    removed.append(0)
                    kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.when(F.col("id") != int(LAST), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """What remove_repeats should find, for small tests: (id, n_bytes, n_removed, n_spans, sha256)."""
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < i:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(bytes(gone).replace(b"\x00", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES: dict[str, str] = {}
