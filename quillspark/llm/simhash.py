"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

Two forms: exact links of 64-bit fingerprints within a few bits (near_duplicates), and links of texts whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more (similar_documents). The latter finds pairs by 252-bit
fingerprints and verifies them on the sets. At 0.8 so many bits differ that no choice of segments holds one of one bit or
less for certain, so long fingerprints with many segments make it likely. Each segment is looked up together with an
anchor, the smallest of the set's hashes in an order of the segment's own: texts that have nothing in common share no
anchor, so they never meet, however many there are, and candidates grow with the texts, not with their pairs.

Null and empty texts have fingerprint zero and link like any other. Repeated rows keep their places: every input
row has one output row. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, materialize, mix64, slices, small_batches, table, utf8_buffers
from quillspark.llm.components import connected_components

BITS = 64
#: Distinct fingerprints up to which so many pieces keep signature buckets small.
PIECES = ((4_000_000, 3), (400_000_000, 5), (float("inf"), 6))
#: Long fingerprints: words of 63 bits, segments of a word and bits of a segment.
WORDS, PER_WORD, SEGMENT = 4, 4, 15
#: Similarity that links two texts, and most bits of long fingerprints in which pairs worth verifying differ: at 0.8
#: about 37 bits differ if a segment agrees, with a standard deviation of 6.
SIMILARITY, WIDE_DISTANCE = 0.8, 52
#: Pairs of one text that meet its shingle set in one place; a text in more pairs has its set copied.
PAIRS_A_COPY = 1000


def _shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles (as big-endian bytes), repeats included, block by block."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: -(width - 1)], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist(), strict=True)
        yield np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in spans]), np.uint8)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted; zero for a text without words."""
    votes, count = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes(text, width):
        votes += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        count += len(hashes) // 8
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted different hashes of a text's word shingles."""
    blocks = [raw.view(np.uint64) for raw in _shingle_hashes(text, width)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The long SimHash of a set of shingle hashes: WORDS longs of 63 bits; zeros for an empty set.

    A shingle's further bits are mixed out of its one hash.
    """
    votes = np.zeros(BITS * WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        wide = np.stack([mix64(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(WORDS)], axis=1)
        votes += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * votes > len(hashes)).view(np.uint64).astype(np.uint64) >> np.uint64(1)


def anchors(hashes: np.ndarray) -> np.ndarray:
    """For each segment the smallest hash of a set in an order of the segment's own; zeros for an empty set.

    Two sets have the same with a probability of their Jaccard similarity.
    """
    out = np.zeros(WORDS * PER_WORD, np.uint64)
    if len(hashes):
        for k in range(len(out)):
            mixed = hashes * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
            out[k] = (mixed ^ mixed >> np.uint64(32)).min()
    return out


def set_key(hashes: np.ndarray) -> int:
    """A hash of a whole shingle set, as a signed long."""
    key = xxhash.xxh64_intdigest(hashes.tobytes())
    return key - (1 << BITS) if key >> (BITS - 1) else key


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = utf8_buffers(batch.column(1))
            out = np.zeros(batch.num_rows, np.uint64)
            for a, b in slices(bounds, 1 << 20):
                raw = data[bounds[a] : bounds[b]].tobytes()
                at = (bounds[a : b + 1] - bounds[a]).tolist()
                for i in range(b - a):
                    out[a + i] = fingerprint(raw[at[i] : at[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fp long")


def signature_masks(distance: int, pieces: int) -> list[list[int]]:
    """Bit positions of the blocks of which one at least differs by one bit or less.

    Of `pieces` segments that share `distance` differing bits, the pieces - distance + 1 that differ least hold one
    differing bit at most (one segment, if there are no more pieces than bits), so those unions of segments are the blocks.
    """
    if 2 * pieces <= distance:
        raise ValueError("too few pieces: a segment could differ by two bits everywhere")
    edges = [round(i * BITS / pieces) for i in range(pieces + 1)]
    segments = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen, []) for chosen in combinations(segments, max(1, pieces - distance + 1))]


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def signatures(fps: DataFrame, distance: int, pieces: int) -> DataFrame:
    """fps with block, wild (the bit left out, -1: none) and rest, one row for each deletion variant."""
    variants = []
    for block, bits in enumerate(signature_masks(distance, pieces)):
        whole = sum(1 << b for b in bits)
        for wild in (-1, *bits):
            mask = whole & ~(1 << wild) if wild >= 0 else whole
            variants.append(F.struct(F.lit(block).alias("block"), F.lit(wild).alias("wild"), F.col("fp").bitwiseAND(_long(mask)).alias("rest")))
    return fps.select("*", F.explode(F.array(*variants)).alias("v")).select(*fps.columns, "v.block", "v.wild", "v.rest")


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def link_fingerprints(fps: DataFrame, distance: int = 4, pieces: int | None = None) -> DataFrame:
    """fp, component for the fingerprints that have a neighbour within `distance` bits (fps: distinct, materialised).

    First every signature bucket links its members to its smallest one, which joins dense groups with a number of
    links in proportion to their size. Then an equality join compares members of a bucket whose components still
    differ; a variant that leaves a bit out meets only such as have the other bit there, so a pair is compared once
    for each block. All pairs within `distance` bits are thereby linked, without listing the pairs of a group.

    The sides of that join are asked to be shuffled: Spark sizes them by the file below, not by the variants exploded
    out of it, and would broadcast them.
    """
    if pieces is None:
        count = fps.count()
        pieces = next(p for most, p in PIECES if count <= most)
    bucket = ["block", "wild", "rest"]
    plain = signatures(fps, distance, pieces).where("wild < 0")
    hubs = plain.groupBy(*bucket).agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).where("hub <> last").drop("last")
    stars = plain.join(broadcast_if_small(materialize(hubs)), bucket)
    near = materialize(stars.where((F.col("fp") != F.col("hub")) & _near(F.col("fp"), F.col("hub"), distance)).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())
    first = materialize(connected_components(near, rough_rounds=1))
    labelled = fps.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    index = signatures(materialize(labelled), distance, pieces)
    index = index.withColumn("bit", F.expr("(fp & shiftleft(1L, greatest(wild, 0))) <> 0"))
    left = index.where("wild < 0 or not bit").select(*bucket, F.col("fp").alias("a"), F.col("component").alias("ca"))
    right = index.where("wild < 0 or bit").select(*bucket, F.col("fp").alias("b"), F.col("component").alias("cb"))
    met = left.hint("merge").join(right, (left.block == right.block) & (left.wild == right.wild) & (left.rest == right.rest) & (F.col("ca") != F.col("cb")) & ((left.wild >= 0) | (F.col("a") < F.col("b"))) & _near(F.col("a"), F.col("b"), distance))
    more = met.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    merged = connected_components(near.unionByName(more))
    return merged.select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, pieces: int | None = None) -> DataFrame:
    """id, fp, component_id (smallest id reachable over links) for every row of docs.

    A document without id takes part in linking; where a component has no id at all, component_id is null.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")))
    linked = materialize(link_fingerprints(distinct.select("fp"), distance, pieces))
    groups = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    class_of = groups.join(least, "component").select("fp", "component_id")
    return prints.join(class_of, "fp").select("id", "fp", "component_id")


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """id, text_hash, fp (a hash of the shingle set), n (its size), words (the long fingerprint), anchors for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = utf8_buffers(batch.column(2))
            out, least = np.zeros((batch.num_rows, WORDS), np.uint64), np.zeros((batch.num_rows, WORDS * PER_WORD), np.uint64)
            keys, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                hashes = shingle_set(data[bounds[i] : bounds[i + 1]].tobytes(), width)
                out[i], least[i], keys[i], sizes[i] = wide_fingerprint(hashes), anchors(hashes), set_key(hashes), len(hashes)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).reshape(-1))) for x in (out, least)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(sizes), *lists], names=["id", "text_hash", "fp", "n", "words", "anchors"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, text_hash long, fp long, n long, words array<long>, anchors array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str = "text", width: int = 5) -> DataFrame:
    """fp, shingles (lower halves of the hashes) of the texts of docs whose hash is in wanted (text_hash), once each.

    Of 32 bits, two of a text's shingles share a value so seldom that no similarity changes by more than a trace.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = utf8_buffers(batch.column(0))
            for a, b in slices(bounds, 1 << 20):
                sets = [shingle_set(data[bounds[i] : bounds[i + 1]].tobytes(), width) for i in range(a, b)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), lists], names=["fp", "shingles"])

    source = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    texts = source.join(wanted, "text_hash", "left_semi").select("text")
    return texts.mapInArrow(run, "fp long, shingles array<int>").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def _segments(fps: DataFrame) -> DataFrame:
    """fps with block, anchor and seg, a row for each segment of the long fingerprint."""
    each = fps.select("*", F.posexplode("anchors").alias("block", "anchor")).drop("anchors")
    return each.withColumn("seg", F.expr(f"shiftright(words[cast(block div {PER_WORD} AS int)], {SEGMENT} * (block % {PER_WORD})) & {(1 << SEGMENT) - 1}L")).drop("words")


def _wide_near(pairs: DataFrame, known: DataFrame, distance: int) -> DataFrame:
    """Of pairs (a, b, ...) those that may be similar by the sizes and long fingerprints of known (fp, n, words)."""
    left = known.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("words").alias("wa"))
    right = known.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("words").alias("wb"))
    joined = pairs.join(broadcast_if_small(left), "a").join(broadcast_if_small(right), "b")
    bits = sum((F.bit_count(F.get("wa", k).bitwiseXOR(F.get("wb", k))) for k in range(1, WORDS)), F.bit_count(F.get("wa", 0).bitwiseXOR(F.get("wb", 0))))
    return joined.where((F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")) & (bits <= distance)).drop("na", "nb", "wa", "wb")


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, text_col: str, width: int) -> DataFrame:
    """Of pairs (a, b, ...; materialised) those whose shingle sets have a Jaccard similarity of SIMILARITY or more.

    texts (fp, text_hash) names a text for each set. A pair's text that is in more pairs is taken as b, and sets of texts
    in many pairs are copied, each copy for some of the pairs, so that no task has all pairs of a hot text.
    """
    both = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
    degree = materialize(both.groupBy("fp").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies")))
    wanted = materialize(texts.join(broadcast_if_small(degree), "fp", "left_semi").select("text_hash").distinct())
    sets = materialize(shingle_sets(docs, broadcast_if_small(wanted), text_col, width))
    of_a = broadcast_if_small(degree.select(F.col("fp").alias("a"), F.col("copies").alias("_ca")))
    of_b = broadcast_if_small(degree.select(F.col("fp").alias("b"), F.col("copies").alias("_cb")))
    turned = pairs.join(of_a, "a").join(of_b, "b").withColumn("_turn", F.col("_ca") > F.col("_cb"))
    turned = turned.withColumns({"_x": F.when(F.col("_turn"), F.col("b")).otherwise(F.col("a")), "_y": F.when(F.col("_turn"), F.col("a")).otherwise(F.col("b"))})
    turned = turned.withColumn("_part", F.pmod(F.xxhash64("_x"), F.greatest("_ca", "_cb")).cast("int"))
    right = sets.join(broadcast_if_small(degree), "fp").select(F.col("fp").alias("_y"), F.col("shingles").alias("_sy"), F.explode(F.expr("sequence(0, copies - 1)")).alias("_part"))
    met = turned.join(sets.select(F.col("fp").alias("_x"), F.col("shingles").alias("_sx")), "_x").join(right, ["_y", "_part"])
    met = met.withColumn("_common", F.size(F.array_intersect("_sx", "_sy")))
    return met.where(F.col("_common") >= SIMILARITY * (F.size("_sx") + F.size("_sy") - F.col("_common"))).select(pairs.columns)


def link_wide(fps: DataFrame, docs: DataFrame, text_col: str = "text", distance: int = WIDE_DISTANCE, width: int = 5) -> DataFrame:
    """fp, component for the shingle sets that have a similar one (fps: fp, n, words, anchors, text_hash; distinct, materialised).

    As in link_fingerprints: buckets of equal segments link their members to the smallest one, then one-wildcard variants
    of segments are joined where components still differ; links of both kinds are verified. Segments and variants are
    told apart by their anchors as well. Two texts of a similarity of 0.8, 0.85 or 0.9 share an anchor and its segment but
    for one bit with a probability of 0.99, 0.998 or over 0.999.
    """
    texts, signed, fps = fps.select("fp", "text_hash"), fps.select("fp", "words", "anchors"), fps.select("fp", "n", "words")
    plain = _segments(signed).select("fp", F.xxhash64("block", "anchor", "seg").alias("key"))
    hubs = plain.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).where("b <> last").drop("last")
    stars = plain.join(broadcast_if_small(materialize(hubs)), "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    near = materialize(_verified(materialize(_wide_near(stars, fps, distance)), docs, texts, text_col, width))
    first = materialize(connected_components(near, rough_rounds=2))
    labelled = signed.join(broadcast_if_small(first.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "words", "anchors", F.coalesce("component", "fp").alias("c"))
    # a variant without a bit meets only such as have the other bit there; the key is of block, anchor, wildcard and the rest
    index = _segments(materialize(labelled)).select("*", F.explode(F.sequence(F.lit(-1), F.lit(SEGMENT - 1))).alias("wild"))
    key = F.expr("xxhash64(block, anchor, wild, CASE WHEN wild < 0 THEN seg ELSE seg & ~shiftleft(1L, wild) END)")
    index = index.select("fp", "c", "wild", key.alias("key"), F.expr("(seg & shiftleft(1L, greatest(wild, 0))) <> 0").alias("bit"))
    left = index.where("wild < 0 or not bit").select("key", F.col("fp").alias("a"), F.col("c").alias("ca"))
    right = index.where("wild < 0 or bit").select("key", F.col("fp").alias("b"), F.col("c").alias("cb"))
    met = left.hint("merge").join(right, (left["key"] == right["key"]) & (F.col("ca") != F.col("cb"))).select("a", "b", "ca", "cb")
    met = _wide_near(met, fps, distance).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    merged = connected_components(near.unionByName(_verified(materialize(met), docs, texts, text_col, width)))
    return merged.select(F.col("node").alias("fp"), "component")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = WIDE_DISTANCE, width: int = 5) -> DataFrame:
    """id, component_id (smallest id reachable over links) for every row of docs; links are verified similarities of SIMILARITY or more.

    Texts without words are alike. Ids are treated as near_duplicates does.
    """
    prints = materialize(wide_fingerprints(docs, id_col, text_col, width))
    distinct = materialize(prints.groupBy("fp").agg(F.first("words").alias("words"), F.first("anchors").alias("anchors"), F.first("n").alias("n"), F.min("id").alias("least"), F.min("text_hash").alias("text_hash")))
    linked = materialize(link_wide(distinct.drop("least"), docs, text_col, distance, width))
    groups = distinct.select("fp", "least").join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.select("id", "fp").join(groups.join(least, "component").select("fp", "component_id"), "fp").select("id", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of similar documents; those without id stay.

    A row is known by its id and a hash of its text: texts of different groups stay, though they share an id, and of a
    group one row stays, though several have its smallest id.
    """
    small_batches(spark)
    text_hash = F.xxhash64("text")
    groups = similar_documents(docs.select(text_hash.alias("_h"), "text"), "_h").select(F.col("id").alias("_h"), F.col("component_id").alias("_group")).distinct()
    least = docs.where("doc_id is not null").groupBy(text_hash.alias("_h")).agg(F.min("doc_id").alias("_id"))
    keep = groups.join(least, "_h").groupBy("_group").agg(F.min(F.struct("_id", "_h")).alias("_keep")).select("_keep._id", "_keep._h")
    keep = broadcast_if_small(materialize(keep))
    kept = docs.join(keep, (F.col("doc_id") == F.col("_id")) & (text_hash == F.col("_h")))
    # texts are moved once more only where several rows have one id and one text
    several = docs.groupBy("doc_id", text_hash.alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1 and doc_id is not null")
    several = broadcast_if_small(materialize(several.select(F.col("doc_id").alias("_id"), "_h")))
    rank = F.row_number().over(Window.partitionBy("_id", "_h").orderBy("source", "lang"))
    first = kept.join(several, ["_id", "_h"], "left_semi").withColumn("_rank", rank).where("_rank = 1")
    parts = [kept.join(several, ["_id", "_h"], "left_anti"), first, docs.where("doc_id is null")]
    return parts[0].select(docs.columns).unionByName(parts[1].select(docs.columns)).unionByName(parts[2])


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
