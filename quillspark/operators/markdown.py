"""Skill files as columns: front matter, sections, bullets, headings. Everything stays inside the JVM, a row at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks of folded and of literal blocks.
FOLDED, LITERAL = (">", ">-", ">+"), ("|", "|-", "|+")
_FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?(.*)\z"
_KEY = r"^([A-Za-z_][\w-]*):"


def _unquoted(value: Column) -> Column:
    """The value without white space around it and without one pair of like quotes."""
    value = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.regexp_replace(value, r"(?s)^\"(.*)\"$|^'(.*)'$", "$1$2")


def _last_of_each(entries: Column) -> Column:
    """A map of (key, value) entries in which the last entry of a key counts."""
    later = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, later))


def front_matter(text: Column) -> tuple[Column, Column, Column]:
    """Scalars (map of strings), nested maps (map of maps) and body of a markdown text (C-25).

    A block of key lines between two lines of dashes: a key line's continuation is what is blank or indented below it.
    Folded blocks are joined by blanks, literal ones by line breaks, a key without a value takes its indented keys as a
    map, other values lose their quotes; comments and lines without a key are skipped. A key's last value counts.
    """
    has = text.rlike(_FRONT)
    block = F.when(has, F.regexp_extract(text, _FRONT, 1)).otherwise(F.lit(""))
    body = F.when(has, F.regexp_extract(text, _FRONT, 2)).otherwise(text)
    # one part for each line that is not indented, with its continuation
    parts = F.filter(F.split(F.regexp_replace(block, r"\r\n?", "\n"), r"\n(?=\S)"), lambda p: p.rlike(_KEY))

    def parsed(part: Column) -> Column:
        key = F.regexp_extract(part, _KEY, 1)
        lines = F.split(part, "\n")
        rest = F.trim(F.substring(F.get(lines, 0), F.length(key) + 2, F.length(part)), F.lit(" \t"))
        more = F.slice(lines, 2, F.size(lines))
        content = F.filter(F.transform(more, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        pairs = F.filter(more, lambda x: x.rlike(r"^\s+[A-Za-z_][\w-]*:"))
        nested = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^\s+([A-Za-z_][\w-]*):", 1).alias("key"), _unquoted(F.regexp_extract(x, r"^\s+[A-Za-z_][\w-]*:\s*(.*)$", 1)).alias("value")))
        is_map = (rest == "") & (F.size(more) > 0)
        value = F.when(rest.isin(*FOLDED), F.array_join(content, " ")).when(rest.isin(*LITERAL), F.array_join(content, "\n")).when(~is_map, _unquoted(rest))
        return F.struct(key.alias("key"), value.alias("value"), F.when(is_map, _last_of_each(nested)).alias("nested"))

    def maps_of(every: Column) -> Column:
        last = F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda x: x["key"] == e["key"]))
        scalars = F.map_from_entries(F.transform(F.filter(last, lambda e: e["nested"].isNull()), lambda e: F.struct(e["key"], e["value"])))
        maps = F.map_from_entries(F.transform(F.filter(last, lambda e: e["nested"].isNotNull()), lambda e: F.struct(e["key"], e["nested"])))
        return F.struct(scalars.alias("scalars"), maps.alias("maps"))

    # an array of one, so that the lines are read once and not for every key
    found = F.get(F.transform(F.array(F.transform(parts, parsed)), maps_of), F.lit(0))
    return found["scalars"], found["maps"], body


def section(body: Column, heading: str) -> Column:
    """The text under `## heading` up to the next `## `, without white space around it; empty if there is none (C-26)."""
    found = F.regexp_extract(body, rf"(?smd)^##\s+\Q{heading}\E\s*$(.*?)(?=^##\s|\z)", 1)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def sections(body: Column) -> Column:
    """array of (heading, text): every `## ` section in order."""
    parts = F.filter(F.split(body, r"(?md)(?=^##\s)"), lambda p: p.rlike(r"^##\s+\S"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^##\s+([^\n]*?)\s*(?:\n|$)", 1).alias("heading"), F.regexp_replace(F.regexp_replace(p, r"^##\s+[^\n]*", ""), r"^\s+|\s+$", "").alias("text")))


def bullets(text: Column) -> Column:
    """The lines that begin with - or *, without it (C-27)."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: x.rlike(r"^\s*[-*]"))
    return F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*[-*]\s*", ""), r"\s+$", ""))


def use_when(body: Column) -> Column:
    """The bullets of the section that says when to use a skill."""
    return bullets(section(body, "When to use"))


def first_heading(body: Column) -> Column:
    """The first `# ` heading; empty if there is none."""
    return F.trim(F.regexp_extract(body, r"(?md)^#\s+(.+)$", 1))
