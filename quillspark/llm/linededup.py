"""Fuzzy line deduplication: MinHash over character shingles, verified by exact Jaccard similarity.

A line is compared by its form, which is the line without blanks at its ends. Lines of white space only are layout, not
content, and always stay; so do lines of fewer than `min_chars` characters where a caller asks for it (the operator and
the stage do not). Lines shorter than a shingle are linked if they are equal. Lines of at least `threshold` Jaccard similarity over their
character shingles are linked; of every connected component the line with the smallest (document id, line number)
stays. Null texts have no lines. A row is known by its id and a hash of its text, so rows that share an id, or have
none, are documents of their own (those without an id come first); rows equal in both are one document and keep the
same lines. Lines are identified by a 64-bit hash of their form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, materialize, mix64, slices, small_batches, table, utf8_buffers
from quillspark.llm.components import connected_components

SHINGLE, THRESHOLD, BANDS, ROWS, MIN_CHARS = 8, 0.8, 8, 3, 10
#: Most rows, and about most characters, of a bucket's block; two blocks are compared in one task.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 17


def _odd(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """id (struct of id and text_hash), line_no (from 0), line, form, h of every line that is long enough to compare."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    each = docs.select(row.alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    each = each.withColumn("form", F.trim("line")).where((F.length("form") >= min_chars) & F.col("form").rlike(r"(?U)\S"))
    return each.withColumn("h", F.xxhash64("form"))


def _points(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of rows of UTF-8 bytes, and where rows begin and end among them."""
    at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[bounds]
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64), at


def shingle_hashes(points: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams of code points that begin in a row (those that run over its end included; mind the
    counts) with one spare element at the end, and how many k-grams lie within each row."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    grams, width, factors = points.copy(), 1, iter(_odd(64, 11))
    wanted = max(len(points) - k + 1, 0)
    while width < k and wanted:
        step = min(width, k - width)
        grams = grams[: len(grams) - step] * next(factors) + grams[step:]
        width += step
    return np.append(mix64(grams[:wanted]), np.uint64(0)), counts


def rows_of(hashes: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of shingle_hashes' hashes those that lie within rows, row after row."""
    first = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    return hashes[np.arange(len(first)) + first]


def band_keys(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each row and band out of bands * rows minima (two 32-bit ones for each 64-bit hash function).

    Row i has the counts[i] hashes from starts[i] on; what lies between rows is passed over.
    """
    edges = np.stack((starts, starts + counts), axis=1).reshape(-1)
    halves = (bands * rows + 1) // 2
    minima = np.empty((len(counts), 2 * halves), np.uint64)
    for i, factor in enumerate(_odd(halves, 23)):
        h = hashes * factor
        h ^= h >> np.uint64(32)
        pair = h.view(np.uint32).reshape(-1, 2)
        minima[:, 2 * i] = np.minimum.reduceat(pair[:, 0], edges)[::2]
        minima[:, 2 * i + 1] = np.minimum.reduceat(pair[:, 1], edges)[::2]
    minima = minima[:, : bands * rows].reshape(len(counts), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(counts), 1))
    for j in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, :, j])
    return keys


def _signed(lines: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """h, id, line_no, chars (of the form), keys (an array of band keys; empty for lines shorter than a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = utf8_buffers(batch.column(3))
            found = np.zeros((batch.num_rows, bands), np.uint64)
            full = np.zeros(batch.num_rows, bool)
            for a, b in slices(bounds, 1 << 16):
                points, at = _points(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                hashes, counts = shingle_hashes(points, at, k)
                has = np.flatnonzero(counts)
                if len(has):
                    found[a + has] = band_keys(hashes, at[has], counts[has], bands, rows)
                    full[a + has] = True
            sizes = np.where(full, bands, 0)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[full].reshape(-1).view(np.int64)))
            chars = pc.utf8_length(batch.column(3)).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), chars, keys], names=["h", "id", "line_no", "chars", "keys"])

    id_type = lines.schema["id"].dataType.simpleString()
    return lines.select("h", "id", "line_no", "form").mapInArrow(run, f"h long, id {id_type}, line_no int, chars int, keys array<long>")


def jaccard(a: str, b: str, k: int) -> float:
    """Exact Jaccard similarity of two strings' character k-gram sets; a shorter string is one shingle."""
    x = {a[i : i + k] for i in range(max(1, len(a) - k + 1))}
    y = {b[i : i + k] for i in range(max(1, len(b) - k + 1))}
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def similarities(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Jaccard similarity of the shingle sets of a[i] and b[i]; shingles are told apart by 54 bits of their hash.

    All sets of up to 1024 pairs are sorted together, each element under its pair's number.
    """
    sides = []
    for column in (a, b):
        bounds, data = utf8_buffers(column)
        points, at = _points(data, bounds)
        hashes, counts = shingle_hashes(points, at, k)
        hashes = rows_of(hashes, at, counts)
        pair = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        ordered = np.sort(pair << np.uint64(54) | hashes >> np.uint64(10))
        sides.append(ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered)
    sizes = [np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=len(a)) for x in sides]
    merged = np.sort(np.concatenate(sides))
    both = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> np.uint64(54)).astype(np.int64), minlength=len(a))
    return both / np.maximum(sizes[0] + sizes[1] - both, 1)


def _verified(pairs: DataFrame, forms: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of pairs(a, b), those whose forms are similar enough. Forms hold a shingle at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep = pa.array(similarities(part.column(2), part.column(3), k) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(keep)

    left, right = forms.select(F.col("h").alias("a"), F.col("form").alias("fa")), forms.select(F.col("h").alias("b"), F.col("form").alias("fb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def _unlike(members: DataFrame, k: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """Links (a, b) between members of a bucket block whose components differ; enough to connect them, not all pairs.

    members: key, lo, hi, block, h, c, form. Rows of one key, lo and hi meet in one task as a run of a sorted stream.
    A pair is compared only while its components are not yet connected within the run, and only in the bucket of the
    first band that it shares. Shingles are told apart by their 64-bit hash.
    """

    def links(group: list[tuple], key: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}
        sets: dict[int, tuple[set[int], list[list[int]]]] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def shingles(i: int) -> tuple[set[int], list[list[int]]]:
            if i not in sets:
                own = set(group[i][3].tolist())
                each = list(own)
                sets[i] = own, [each[j : j + 64] for j in range(0, len(each), 64)]
            return sets[i]

        def alike(i: int, j: int) -> bool:
            """Whether two members are similar enough; ends as soon as too many shingles have no match."""
            small, large = sorted((shingles(i), shingles(j)), key=lambda x: len(x[0]))
            n, m = len(small[0]), len(large[0])
            most = n - threshold / (1 + threshold) * (n + m) + 1e-6
            both = seen = 0
            for part in small[1]:
                if most < seen - both:
                    return False
                both += len(large[0].intersection(part))
                seen += len(part)
            return both >= threshold * (n + m - both)

        keys = np.stack([member[4] for member in group])
        band = int(np.flatnonzero(keys[0] == key)[0])
        blocks, labels = np.array([member[0] for member in group]), np.array([member[2] for member in group])
        for i, (block, h, c, _, own) in enumerate(group):
            open_ = labels[:i] != c
            if lo != hi:
                open_ &= blocks[:i] != block
            if band:
                open_ &= (keys[:i, :band] != own[:band]).all(axis=1)
            if not open_.any():
                continue
            root = find(c)
            for j in np.flatnonzero(open_).tolist():
                other = find(group[j][2])
                if other != root and alike(i, j):
                    parent[other] = root
                    yield h, group[j][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, group = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            bounds, data = utf8_buffers(batch.column(6))
            points, at = _points(data, bounds)
            hashes, counts = shingle_hashes(points, at, k)
            forms = [hashes[i : i + n] for i, n in zip(at[:-1].tolist(), counts.tolist(), strict=True)]
            keys = band_keys(hashes, at[:-1], counts, bands, rows).view(np.int64) if len(counts) else ()
            for key, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns[:6]), forms, keys, strict=True):
                if (key, lo, hi) != head:
                    if len(group) > 1:
                        out += links(group, *head)
                    head, group = (key, lo, hi), []
                group.append(tuple(row))
            yield _pairs(out)
        if len(group) > 1:
            yield _pairs(list(links(group, *head)))

    dealt = members.select("key", "lo", "hi", "block", "h", "c", "form").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "h")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def line_groups(lines: DataFrame, signed: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """h, keep_id, keep_line for every form that occurs twice or has a near-duplicate (materialised).

    signed: what _signed makes of lines, materialised.

    Bucket members are first compared with the bucket's smallest hash, which settles most copies at one comparison
    each, and all pairs of a bucket of two. Buckets whose other members are still in different components are then
    looked into: large ones in pairs of blocks of bounded rows and bytes, each pair of blocks in a task of its own. No
    link between components is left out.
    """
    unique = materialize(signed.groupBy("h").agg(F.min(F.struct("id", "line_no")).alias("at"), F.count("*").alias("n"), F.first("chars").alias("chars"), F.first("keys").alias("keys")))
    index = unique.select("h", "chars", F.explode("keys").alias("key"))
    hubs = materialize(index.groupBy("key").agg(F.min("h").alias("hub"), F.max("h").alias("last")).where("hub <> last").drop("last"))
    crowded = materialize(index.join(broadcast_if_small(hubs), "key"))
    needed = materialize(crowded.select("h").distinct())
    forms = materialize(lines.select("h", "form").join(broadcast_if_small(needed), "h", "left_semi").groupBy("h").agg(F.first("form").alias("form")))
    pairs = crowded.where("h <> hub").select(F.col("h").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialize(_verified(pairs, forms, k, threshold))
    first = materialize(connected_components(links, rough_rounds=1))
    rest = crowded.where("h <> hub").drop("hub")  # a bucket's hub has been compared with all its members
    labelled = materialize(rest.join(broadcast_if_small(first.withColumnRenamed("node", "h")), "h", "left").select("key", "h", "chars", F.coalesce("component", "h").alias("c")))
    size = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("chars") / BLOCK_CHARS)).cast("int")
    split = materialize(labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), size.alias("blocks")).where("low <> high").select("key", "blocks"))
    sized = labelled.join(broadcast_if_small(split), "key").join(forms, "h")
    sized = sized.withColumn("block", F.pmod("h", "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    more = _unlike(sized.select("*", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi")), k, threshold, bands, rows)
    groups = materialize(connected_components(links.unionByName(more)))
    named = unique.select("h", "at", "n").join(groups.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or component is not null")
    named = named.withColumn("component", F.coalesce("component", "h"))
    keepers = materialize(named.groupBy("component").agg(F.min("at").alias("keep")))
    return materialize(named.join(broadcast_if_small(keepers), "component").select("h", F.col("keep.id").alias("keep_id"), F.col("keep.line_no").alias("keep_line")))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, text_hash, removed: for each document that loses lines, their numbers and hashes (an array of structs)."""
    lines = lines_of(docs, id_col, text_col, min_chars)
    signed = materialize(_signed(lines, k, bands, rows))
    groups = line_groups(lines, signed, k, threshold, bands, rows)
    lost = signed.select("id", "line_no", "h").join(broadcast_if_small(groups), "h").where("not (id <=> keep_id and line_no = keep_line)")
    return lost.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("line_no", "h"))).alias("removed")).select("id.id", "id.text_hash", "removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, **how) -> DataFrame:
    """docs with the removed lines cut out of the text column; other columns and untouched texts stay as they are."""
    lost = removed_lines(docs, id_col, text_col, min_chars, **how).select(F.col("id").alias("_lost_id"), F.col("text_hash").alias("_lost_hash"), F.col("removed").alias("_lost"))
    joined = docs.join(lost, F.expr(f"`{id_col}` <=> _lost_id and xxhash64(`{text_col}`) = _lost_hash"), "left")

    def stays(line, i):
        return ~F.array_contains("_lost", F.struct(i.alias("line_no"), F.xxhash64(F.trim(line)).alias("h")))

    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), stays), "\n")
    return joined.withColumn(text_col, F.when(F.col("_lost").isNull(), F.col(text_col)).otherwise(kept)).drop("_lost_id", "_lost_hash", "_lost")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined) of all documents."""
    docs = table(spark, sf_dir, "documents")
    lost = removed_lines(docs, min_chars=1).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.expr("array_sort(array_distinct(transform(removed, x -> x.line_no)))").alias("gone"))
    sizes = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n"), F.col("text").isNull().alias("none"))
    joined = sizes.join(lost, F.expr("doc_id <=> _id and h = _hash"), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines cut out; n_chars follows the text. No document goes."""
    small_batches(spark)
    found = dedup_lines(docs, min_chars=1)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES: dict[str, str] = {}
