"""Paragraph reflow and overlapping chunks as folds over arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line ends that finish a paragraph, lines that are page furniture, bullets.
#: What ends a sentence or a clause.
TERMINAL = r"[.:;!?”\")…]$"
PAGE_NOISE = r"(?i)^\s*(page\s+\d+(\s*(of|/)\s*\d+)?|\d{1,3}|\|\s*\d+\s*\|)\s*$"
BULLET = r"^\s*(?:[●•▪◦‣]|[-*–—]|\d{1,2}[.)]|[a-z][.)])\s+"
#: Glyphs that fonts put in place of plain characters.
GLYPHS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "ﬅ": "st", "ﬆ": "st", "‘": "'", "’": "'", "“": '"', "”": '"',
    "–": "-", "—": "-", "…": "...", "­": "",
}


def clean_glyphs(text: Column) -> Column:
    """Ligatures and typographic marks spelt out; line ends as \\n."""
    for glyph, plain in GLYPHS.items():
        text = F.replace(text, F.lit(glyph), F.lit(plain))
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalise_space(text: Column) -> Column:
    """Runs of blanks collapsed, lines stripped, at most one empty line in a row."""
    text = F.regexp_replace(text, r"[ \t   ]+", " ")
    text = F.regexp_replace(text, r"(?m)^[ \t]+|[ \t]+$", "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_heading(line: Column) -> Column:
    """Short, few words, no terminal mark."""
    return (F.length(line) <= 60) & (F.size(F.split(F.trim(line), r"\s+")) <= 9) & ~line.rlike(TERMINAL)


def is_fragmented(text: Column) -> Column:
    """A dozen lines or more, three fifths of which hold three words at most."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.filter(lines, lambda x: F.size(F.split(F.trim(x), r"\s+")) <= 3)
    return (F.size(lines) >= 12) & (F.size(short) >= 0.6 * F.size(lines))


def reflow(text: Column) -> Column:
    """Paragraphs of a page's lines: array<string>."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit("").alias("prev"))

    def close(a: Column) -> Column:
        return F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))

    def step(a: Column, raw: Column) -> Column:
        line = F.trim(raw)
        bullet = raw.rlike(BULLET)
        finished = raw.rlike(r"^\S") & (a["prev"] != "") & (a["prev"].rlike(TERMINAL) | is_heading(a["prev"]))
        fresh = (a["cur"] == "") | bullet | finished
        shown = F.when(bullet, F.regexp_replace(line, BULLET, "- ")).otherwise(line)
        kept = F.struct(F.when(fresh, close(a)).otherwise(a["done"]).alias("done"), F.when(fresh, shown).otherwise(F.concat_ws(" ", a["cur"], line)).alias("cur"), line.alias("prev"))
        blank = F.struct(close(a).alias("done"), F.lit("").alias("cur"), F.lit("").alias("prev"))
        noise = F.struct(a["done"].alias("done"), a["cur"].alias("cur"), F.lit("").alias("prev"))
        return F.when(line == "", blank).when(line.rlike(PAGE_NOISE), noise).otherwise(kept)

    return F.aggregate(F.split(text, "\n"), start, step, close)


def _hard_pieces(sentence: Column, limit: int) -> Column:
    """Cuts at the last space before limit, or at limit where that space comes before its half."""
    pattern = rf"(?s)\s*(.{{1,{limit}}}$|.{{{limit // 2},{limit - 1}}}(?= )|.{{1,{limit}}})"
    return F.filter(F.transform(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1)), F.trim), lambda x: x != "")


def units(paragraphs: Column, limit: int) -> Column:
    """Paragraphs, with those over limit cut into runs of sentences."""

    def cut(p: Column) -> Column:
        pieces = F.flatten(F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s: _hard_pieces(F.trim(s), limit)))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

        def step(a: Column, u: Column) -> Column:
            fits = (a["cur"] != "") & (F.length(a["cur"]) + 1 + F.length(u) <= limit)
            done = F.when(fits | (a["cur"] == ""), a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
            return F.struct(done.alias("done"), F.when(fits, F.concat_ws(" ", a["cur"], u)).otherwise(u).alias("cur"))

        return F.aggregate(pieces, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))

    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(cut(p))))


def _tail(text: Column, n: int) -> Column:
    last = F.substring(text, -n, n)
    space = F.instr(last, " ")
    return F.when(F.length(text) <= n, F.lit("")).when((space >= 1) & (space <= 40), F.substr(last, space + 1)).otherwise(last)


def pack(parts: Column, size: int, overlap: int, least: int = 120) -> Column:
    """array<struct<text, overlap_chars, paragraphs>>: units packed greedily, each chunk led by its predecessor's tail."""
    if size < 120 or not 0 <= overlap < size:
        raise ValueError("chunk size must be 120 or more and overlap smaller than it")
    kind = "array<struct<text:string,overlap_chars:int,paragraphs:int>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("cur"), F.lit(0).alias("used"), F.lit(0).alias("n"))

    def flush(a: Column) -> Column:
        before = F.when(F.size(a["done"]) == 0, F.lit("")).otherwise(F.element_at(a["done"], -1)["text"]) if overlap else F.lit("")
        tail = _tail(before, overlap) if overlap else F.lit("")
        text = F.when(tail == "", a["cur"]).otherwise(F.concat_ws("\n\n", tail, a["cur"]))
        chunk = F.struct(text.alias("text"), F.when(tail == "", 0).otherwise(F.length(tail) + 2).alias("overlap_chars"), a["n"].alias("paragraphs"))
        return F.when(a["n"] == 0, a["done"]).otherwise(F.concat(a["done"], F.array(chunk).cast(kind)))

    def step(a: Column, u: Column) -> Column:
        more = F.length(u) + F.when(a["n"] > 0, 2).otherwise(0)
        full = (a["n"] > 0) & (a["used"] + more > size)
        opened = F.struct(flush(a).alias("done"), u.alias("cur"), more.alias("used"), F.lit(1).alias("n"))
        longer = F.struct(a["done"].alias("done"), F.when(a["n"] == 0, u).otherwise(F.concat_ws("\n\n", a["cur"], u)).alias("cur"), (a["used"] + more).alias("used"), (a["n"] + 1).alias("n"))
        return F.when(full, opened).otherwise(longer)

    def fold_runt(c: Column) -> Column:
        last, prev = F.element_at(c, -1), F.element_at(c, -2)
        joined = F.struct(F.concat_ws("\n\n", prev["text"], last["text"]).alias("text"), prev["overlap_chars"].alias("overlap_chars"), (prev["paragraphs"] + last["paragraphs"]).alias("paragraphs"))
        return F.when((F.size(c) > 1) & (F.length(last["text"]) < least), F.concat(F.slice(c, 1, F.size(c) - 2), F.array(joined).cast(kind))).otherwise(c)

    packed = F.aggregate(parts, start, step, flush)
    return F.element_at(F.transform(F.array(packed), lambda c: F.when(F.size(c) > 1, fold_runt(c)).otherwise(c)), 1)


def _offsets(parts: Column, text: Column) -> Column:
    """array<struct<start, end>>: where each unit stands in the text, looked for from the end of the one before; a unit
    that is not found (its blanks were changed) is put there."""
    kind = "array<struct<start:int,end:int>>"

    def step(a: Column, u: Column) -> Column:
        at = F.call_function("locate", u, text, a["cursor"] + 1)
        start = F.when(at > 0, at - 1).otherwise(a["cursor"])
        place = F.struct(start.cast("int").alias("start"), (start + F.length(u)).cast("int").alias("end"))
        return F.struct(F.concat(a["done"], F.array(place)).cast(kind).alias("done"), (start + F.length(u)).cast("int").alias("cursor"))

    return F.aggregate(parts, F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("cursor")), step, lambda a: a["done"])


def _sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("sum"))
    step = lambda a, n: F.struct(F.concat(a["done"], F.array(a["sum"])).alias("done"), (a["sum"] + n).cast("int").alias("sum"))
    return F.aggregate(numbers, start, step, lambda a: a["done"])


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 150, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row per chunk: id, idx, chunk_id, text, chars, tokens_est, overlap_chars, paragraphs; with offsets also
    char_start and char_end.

    These tell where the chunk's own part (without the overlap) stands in the reflowed text, whose paragraphs are an
    empty line apart. They are looked for in the text unit by unit, which takes longer for long texts.
    """
    ready = docs.select(F.col(id_col), reflow(clean_glyphs(F.coalesce(F.col(text_col), F.lit("")))).alias("paras"))
    if offsets:
        cut = ready.select(id_col, F.array_join("paras", "\n\n").alias("whole"), units(F.col("paras"), size).alias("parts"))
        packed = cut.select(id_col, pack(F.col("parts"), size, overlap).alias("chunks"), _offsets(F.col("parts"), F.col("whole")).alias("places"))
        packed = packed.withColumn("before", _sums_before(F.transform("chunks", lambda c: c["paragraphs"])))
    else:
        packed = ready.select(id_col, pack(units(F.col("paras"), size), size, overlap).alias("chunks"))
    # an inner explode would have Spark ask for the chunks' number first, which cuts every text two more times
    each = packed.select(*[c for c in packed.columns if c != "chunks"], F.posexplode_outer("chunks").alias("idx", "c")).where("idx is not null")
    text, first = F.col("c.text"), F.get("before", F.col("idx"))
    places = [F.get("places", first)["start"].alias("char_start"), F.get("places", first + F.col("c.paragraphs") - 1)["end"].alias("char_end")]
    return each.select(
        id_col,
        "idx",
        F.format_string("c%04d-%s", F.col("idx"), F.substring(F.sha1(text.cast("binary")), 1, 6)).alias("chunk_id"),
        text.alias("text"),
        F.length(text).alias("chars"),
        F.greatest(F.lit(1), F.bround(F.length(text) / 4.0).cast("int")).alias("tokens_est"),
        "c.overlap_chars",
        "c.paragraphs",
        *(places if offsets else []),
    )


def chunk_summary(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Count, mean, least and largest size of each document's chunks."""
    return chunks.groupBy(id_col).agg(F.count("*").alias("chunks"), F.round(F.avg("chars"), 1).alias("avg_chars"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"))
