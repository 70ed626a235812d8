"""Importance resampling towards a target distribution, over bucket-partitioned inverted postings.

Features are runs of 1 to `longest` consecutive words, hashed into buckets by crc32. Texts are cut into blocks of a few
megabytes; each block gives one posting list a bucket, holding which of the block's documents have how many features
there (delta-coded bytes). A bucket's gain needs that bucket alone: the counts of both corpora meet by bucket, the gains
meet the posting lists by bucket, and each list gives its documents gain times count. What a task adds up for a block
is one partial sum a document; partial sums meet by block. So neither features nor pairs of document and bucket are
ever rows of a shuffle by themselves, and no task needs all postings of a bucket: Spark may split a large one.

Drawing is by Gumbel keys on the sum of gains: a document's noise comes from a digest of its id, so reruns agree. Ranks
are counted over ranges, no table is sorted in one task.

Null texts have no features and weight 0; null ids get the noise of an empty id and come last in ties; repeated rows
are ranked one after the other; empty tables give no gain (all buckets ln of the ratio of pseudo-counts) or no rows.
Only the named columns are read, so further columns with clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, slices, table, utf8_buffers
from quillspark.operators.ranking import sorted_ranks

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text and documents of a block.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 14
#: Blocks whose partial sums a task holds before it emits the oldest.
OPEN_BLOCKS = 64
#: Bytes up to which a word's checksum is made for all words at once; longer words are looked at one by one.
LONG_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _IN_WORD[_low : _high + 1] = False


def _byte_steps() -> np.ndarray:
    """The checksum register's change for each low byte (reflected polynomial of CRC-32)."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


_STEP = _byte_steps()


def _zero_steps() -> np.ndarray:
    """[n, k, b]: what byte b at place k of the register becomes after n zero bytes."""
    out = np.empty((LONG_WORD + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG_WORD + 1):
        out[n] = out[n - 1] >> 8 ^ _STEP[out[n - 1] & 255]
    return out


_ZEROS = _zero_steps()
_ALL = np.uint32(0xFFFFFFFF)


def _shifted(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The register after n zero bytes (n up to LONG_WORD)."""
    parts = [_ZEROS[n, k, register >> np.uint32(8 * k) & 255] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def feature_checksums(data: np.ndarray, bounds: np.ndarray, longest: int = LONGEST) -> tuple[list[np.ndarray], np.ndarray]:
    """crc32 of the runs of 1, 2 ... words that begin at each word, and each word's row.

    data: bytes of all rows; bounds: where rows begin (one more than rows). The i-th array holds runs of i + 1 words,
    with whatever value where a run would leave its row.
    """
    data = _LOWER[data]
    inside = _IN_WORD[data]
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(bounds, starts, "right") - 1
    lengths = ends - starts
    long_ = np.flatnonzero(lengths > LONG_WORD)
    size = np.minimum(lengths, LONG_WORD)
    order = np.argsort(-size, kind="stable")
    register, at = np.full(len(starts), _ALL, np.uint32), starts[order]
    live = np.searchsorted(-size[order], -np.arange(LONG_WORD), "left")
    for j in range(LONG_WORD):
        n = live[j]
        if not n:
            break
        register[:n] = register[:n] >> 8 ^ _STEP[(register[:n] ^ data[at[:n] + j]) & 255]
    own = np.empty_like(register)
    own[order] = register
    words = {int(i): data[starts[i] : ends[i]].tobytes() for i in long_}
    for i, word in words.items():
        own[i] = np.uint32(zlib.crc32(word) ^ 0xFFFFFFFF)
    alone = own ^ _shifted(np.full(len(own), _ALL, np.uint32), size)  # the word's share, whatever stood before it
    runs = [own]
    for k in range(1, longest):
        last = runs[-1][:-1] if len(runs[-1]) else runs[-1]
        spaced = last >> 8 ^ _STEP[(last ^ 32) & 255]
        n = len(spaced)
        joined = _shifted(spaced, size[k : k + n]) ^ alone[k : k + n]
        for i, word in words.items():
            if 0 <= i - k < n:
                joined[i - k] = np.uint32(zlib.crc32(word, int(spaced[i - k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
        runs.append(joined)
    return [r ^ _ALL for r in runs], rows


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low bits first, all but a value's last byte with the top bit; and where each value begins."""
    sizes = np.ones(len(values), np.int64)
    rest = values >> 7
    while rest.any():
        sizes += rest > 0
        rest = rest >> 7
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for j in range(int(sizes.max(initial=0))):
        here = sizes > j
        out[begins[here] + j] = (values[here] >> 7 * j & 127) | np.where(sizes[here] > j + 1, 128, 0)
    return out, begins


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of packed bytes, and where each begins."""
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    values = (data[begins] & 127).astype(np.int64)
    more = np.flatnonzero(ends > begins)
    j = 1
    while len(more):
        values[more] |= (data[begins[more] + j] & 127).astype(np.int64) << 7 * j
        j += 1
        more = more[ends[more] - begins[more] >= j]
    return values, begins


def block_postings(data: np.ndarray, bounds: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: buckets met, features in each, list offsets, list bytes; features and words of each row.

    An entry of a list is 4 * (row minus the row before) + count - 1; more than four features of a row in a bucket are
    several entries.
    """
    rows = len(bounds) - 1
    runs, of = feature_checksums(data, bounds, longest)
    keys, n_features = [], np.zeros(rows, np.int64)
    for k, run in enumerate(runs):
        whole = of[: len(run)] == of[k : k + len(run)]
        row = of[: len(run)][whole]
        n_features += np.bincount(row, minlength=rows)
        keys.append((run[whole] % np.uint32(buckets)).astype(np.int64) * rows + row)
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    parts = -(-counts // 4)
    key, left = np.repeat(found, parts), np.repeat(counts, parts)
    nth = np.arange(len(key)) - np.repeat(np.cumsum(parts) - parts, parts)
    count = np.minimum(4, left - 4 * nth)
    bucket, row = key // rows, key % rows
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    step = np.diff(row, prepend=0)
    step[first] = row[first]
    lists, begins = packed(4 * step + count - 1)
    offsets = np.concatenate((begins[first], [len(lists)])).astype(np.int32)
    total = np.add.reduceat(count, first) if len(first) else first
    return bucket[first], total, offsets, lists, n_features, np.bincount(of, minlength=rows)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, bucket, n (features), entries for each bucket of each block; and for each block a row without a bucket, with ids, features and words of its documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = T.StructType.fromDDL(f"block long, bucket int, n long, entries binary, ids array<{kind}>, features array<long>, words array<long>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            bounds, data = utf8_buffers(batch.column(1))
            for start, end in slices(bounds, block_bytes):
                for a in range(start, end, BLOCK_ROWS):
                    b = min(end, a + BLOCK_ROWS)
                    bucket, n, offsets, lists, features, words = block_postings(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], buckets, longest)
                    m = len(bucket)
                    entries = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(lists)])
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    none = lambda x: pa.nulls(m, x.type)
                    extra = [one(ids.slice(a, b - a)), one(pa.array(features)), one(pa.array(words))]
                    columns = [pa.array(np.full(m, block)), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64)), entries, *[none(x) for x in extra]]
                    yield pa.RecordBatch.from_arrays(columns, names=out.names)
                    head = [pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *extra]
                    yield pa.RecordBatch.from_arrays(head, names=out.names)
                    block += 1

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, out)


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for the buckets of source; both are postings, co-grouped by bucket."""
    zero = F.lit(0).cast("long")
    both = source.select("bucket", F.col("n").alias("s"), zero.alias("t")).unionByName(target.select("bucket", zero.alias("s"), F.col("n").alias("t")))
    met = materialize(both.where("bucket is not null").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))  # a row for each bucket
    all_s, all_t = met.agg(F.coalesce(F.sum("s"), zero), F.coalesce(F.sum("t"), zero)).first()
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * F.lit(float(all_s + buckets)) / ((d("s") + 1) * F.lit(float(all_t + buckets)))
    return met.where("s > 0").select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, sums: for the posting lists of a task, gain times count added up by document of a block."""
    held: dict[int, np.ndarray] = {}

    def emit(blocks: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([np.trim_zeros(held.pop(b), "b") for b in blocks], pa.list_(pa.int64()))], names=["block", "sums"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block, gain = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        entries = batch.column(2)
        _, offsets, raw = entries.buffers()
        wide = pa.types.is_large_binary(entries.type)
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[entries.offset : entries.offset + len(entries) + 1].astype(np.int64)
        values, begins = unpacked(np.frombuffer(raw, np.uint8)[at[0] : at[-1]])
        first = np.searchsorted(begins, at[:-1] - at[0])
        each = np.diff(np.append(first, len(values)))
        running = np.cumsum(values >> 2)
        row = running - np.repeat(running[first] - (values[first] >> 2), each)
        names, which = np.unique(block, return_inverse=True)
        width = int(row.max(initial=0)) + 1
        sums = np.zeros((len(names), width), np.int64)
        np.add.at(sums.reshape(-1), np.repeat(which, each) * width + row, np.repeat(gain, each) * ((values & 3) + 1))
        for name, own in zip(names.tolist(), sums, strict=True):
            before = held.pop(name, None)
            if before is None:
                held[name] = own.copy()
                continue
            if len(before) < width:
                before = np.concatenate((before, np.zeros(width - len(before), np.int64)))
            before[:width] += own
            held[name] = before
        if len(held) > OPEN_BLOCKS:
            yield emit(list(held)[: len(held) - OPEN_BLOCKS])
    if held:
        yield emit(list(held))


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_features, n_words, weight (the sum of gains) for every row of docs, and block, place (which row it is)."""
    source = materialize(postings(docs, id_col, text_col, buckets, longest, block_bytes))
    wanted = postings(target.select(F.lit(0).alias("_none"), F.col(target_text_col).alias("_text")), "_none", "_text", buckets, longest, block_bytes)
    gain = gains(source, wanted, buckets).hint("shuffle_hash")
    met = source.where("bucket is not null").select("block", "bucket", "entries").join(gain, "bucket").select("block", "gain", "entries")
    sums = met.mapInArrow(_partial_sums, "block long, sums array<bigint>")
    heads = source.where("bucket is null").select("block", "ids", "features", "words")
    out = T.StructType.fromDDL(f"block long, place long, doc_id {docs.schema[id_col].dataType.simpleString()}, n_features long, n_words long, weight long")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one block, each with the sum of its partial sums."""
        head, total = None, np.zeros(0, np.int64)
        for batch in batches:
            names = batch.schema.names
            if batch.column(names.index("ids")).null_count < batch.num_rows:
                head = [batch.filter(batch.column(names.index("ids")).is_valid()).column(names.index(c)) for c in ("block", "ids", "features", "words")]
            for own in batch.column(names.index("sums")).drop_null():
                own = own.values.to_numpy()
                if len(own) > len(total):
                    total = np.concatenate((total, np.zeros(len(own) - len(total), np.int64)))
                total[: len(own)] += own
        block, ids, features, words = head
        n = len(ids.flatten())
        weight = np.zeros(n, np.int64)
        weight[: len(total)] = total
        columns = [pa.array(np.full(n, block[0].as_py())), pa.array(np.arange(n)), ids.flatten(), features.flatten(), words.flatten(), pa.array(weight)]
        yield pa.RecordBatch.from_arrays(columns, names=out.names)

    # a group is a block's documents and one array from each task that had its buckets
    return heads.unionByName(sums, allowMissingColumns=True).groupBy("block").applyInArrow(added, out)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate out of a digest of seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **how) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and, for the percent of the eligible rows that are drawn, rank."""
    scored = materialize(weights(docs, target, **how).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words))
    drawn = scored.where("eligible").count() * percent // 100
    ranked = sorted_ranks(scored, [F.desc("eligible"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("block").asc(), F.col("place").asc()], name="rank")
    return ranked.select("doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("eligible") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents, drawn towards the benchmark texts."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_resample": op13_resample}

# crc32 by half bytes: the hexadecimal digits of a feature's bytes, the low digit of each byte first
ORACLES = {
    "op13_resample": r"""
WITH t16 AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
    3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS t),
x AS (SELECT true AS own, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT own, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
p AS (SELECT own, r, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT own, r, w[i] AS f FROM p UNION ALL SELECT own, r, w[i] || ' ' || w[i + 1] FROM p WHERE i < len(w) UNION ALL SELECT own, r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM p WHERE i + 1 < len(w)),
n AS (SELECT own, r, f, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h)), lambda k: (strpos('0123456789ABCDEF', substr(h, k + 2 - 2 * (k % 2), 1)) - 1)::BIGINT)),
    lambda a, b: xor(a >> 4, t[(xor(a, b) & 15) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM d, t16),
b AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM n JOIN c USING (f) GROUP BY 1),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM b),
g AS (SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * (z.s + 10000) / ((b.s + 1)::DOUBLE * (z.t + 10000))))::BIGINT AS gain FROM b, z),
v AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN c USING (f) JOIN g USING (bucket) WHERE own GROUP BY 1),
e AS (SELECT doc_id, len(w) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN v USING (r) WHERE own),
k AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (eligible) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND k <= 5 * n // 100 THEN k END AS rank FROM k
"""
}
