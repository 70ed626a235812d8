"""Skill files: front matter, sections, suggestions for a task, and the names closest to one that is not there.

The driver's tables hold no skill files, so the queries write each document into one first, with every form of value
that front matter has; the SQL knows the parts without reading any markdown.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.closest import closest
from quillspark.operators.markdown import first_heading, front_matter, section, sections, use_when
from quillspark.plans import skills
from quillspark.sources.adapters import on_duckdb, on_spark


def _parts(s: bool) -> str:
    """CTE of the documents as the parts of skill files: name, pack, phase and up to nine plain lines."""
    split = "split(text, '\\n')" if s else "string_split(text, chr(10))"
    plain = "trim(regexp_replace(substr(x, 1, 60), '[^A-Za-z0-9 ]', ''))" if s else "trim(regexp_replace(substr(x, 1, 60), '[^A-Za-z0-9 ]', '', 'g'))"
    mapped = f"transform({split}, x -> {plain})" if s else f"list_transform({split}, lambda x: {plain})"
    kept = f"filter({mapped}, x -> x <> '')" if s else f"list_filter({mapped}, lambda x: x <> '')"
    nine = f"slice({kept}, 1, 9)" if s else f"({kept})[1:9]"
    return f"parts AS (SELECT doc_id AS id, coalesce(source, 'none') || '-' || cast(doc_id AS varchar(20)) AS name, coalesce(source, 'none') AS pack, coalesce(lang, 'none') AS phase, {nine} AS l FROM {{documents}} WHERE text IS NOT NULL)"


def skill_files(spark, sf_dir):
    """id, name, text: a skill file for each document."""
    lines = lambda by: f"array_join(l, '{by}')"
    text = (
        "'---\\n# a comment: skipped\\nname: \"' || name || '\"\\ndescription: >-\\n  ' || " + lines("\\n\\n  ") + " || '\\nstray\\n  text: ignored\\nlicense:   MIT  \\nmetadata:\\n  pack: ' || pack || '\\n\\n  # inside\\n  phase: ''' || phase || '''\\n"
        "notes: |\\n    ' || " + lines("\\n    ") + " || '\\nversion: ''1.0''\\nlicense: ' || '''Apache ''' || '\\n---\\n\\n# ' || name || '\\nintro\\n## When to use \\n\\n' || array_join(transform(l, (x, i) -> CASE WHEN i % 3 = 2 THEN x WHEN i % 3 = 1 THEN '  * ' || x ELSE '- ' || x END), '\\n')"
        " || '\\n### deeper\\n## Workflow\\n1. ' || coalesce(get(l, 0), '') || '\\n'"
    )
    return on_spark(spark, sf_dir, f"WITH {_parts(True)} SELECT id, name, {text} AS text FROM parts")


def _front(spark, sf_dir):
    """C-25: scalars, folded and literal blocks, the nested map; the last of a repeated key counts."""
    files = skill_files(spark, sf_dir)
    scalars, maps, body = front_matter(F.col("text"))
    read = files.select("id", scalars.alias("f"), maps.alias("m"), F.length(body).alias("body_chars"))
    keys = F.array_join(F.sort_array(F.map_keys("f")), ",")
    return read.select("id", F.col("f")["name"].alias("name"), F.md5(F.col("f")["description"].cast("binary")).alias("description_md5"), F.md5(F.col("f")["notes"].cast("binary")).alias("notes_md5"), F.col("f")["license"].alias("license"), F.col("f")["version"].alias("version"), F.col("m")["metadata"]["pack"].alias("pack"), F.col("m")["metadata"]["phase"].alias("phase"), keys.alias("keys"))


def _sections(spark, sf_dir):
    """C-26, C-27: title, sections, when to use."""
    files = skill_files(spark, sf_dir).select("id", front_matter(F.col("text"))[2].alias("body"))
    found = files.select("id", "body", use_when(F.col("body")).alias("u"), sections(F.col("body")).alias("s"))
    return found.select("id", first_heading(F.col("body")).alias("title"), F.array_join(F.transform("s", lambda x: x["heading"]), ",").alias("headings"), F.size("u").cast("long").alias("n_bullets"), F.md5(F.array_join("u", "|").cast("binary")).alias("bullets_md5"), section(F.col("body"), "Workflow").alias("workflow"), section(F.col("body"), "None").alias("missing"))


def suggest(found, files, k: int = 4):
    """found (qid, name, score, rnk) with the first k bullets of when to use each skill (E-23); files: name, text."""
    bullets = files.select("name", F.slice(use_when(front_matter(F.col("text"))[2]), 1, k).alias("bullets"))
    return found.join(bullets, "name", "left").withColumn("bullets", F.coalesce("bullets", F.array().cast("array<string>")))


def _suggestions(spark, sf_dir):
    found = skills.QUERIES["s3_search"](spark, sf_dir)
    return suggest(found, skill_files(spark, sf_dir)).select("qid", "name", "score", "rnk", F.array_join("bullets", "|").alias("use_when"))


def _did_you_mean(spark, sf_dir):
    """E-24: for names of every id divisible by 100 with two characters wrong, the five nearest names; those that are there need none."""
    names = on_spark(spark, sf_dir, f"WITH {_parts(True)} SELECT name, id FROM parts")
    asked = names.where("id % 100 = 0").select(F.expr("substr(name, 1, 1) || 'x' || substr(name, 2, length(name) - 2)").alias("asked"))
    misses = asked.join(names, F.col("asked") == F.col("name"), "left_anti")
    return closest(names, misses)


QUERIES = {"s3_front_matter": _front, "s3_sections": _sections, "s3_suggest": _suggestions, "s3_did_you_mean": _did_you_mean}

_P = f"WITH {_parts(False)}"
_USE = "list_filter(list_transform(l, lambda x, i: CASE WHEN i % 3 = 0 THEN NULL ELSE x END), lambda x: x IS NOT NULL)"
ORACLES = {
    "s3_front_matter": on_duckdb(
        f"{_P} SELECT id, name, md5(array_to_string(l, ' ')) AS description_md5, md5(array_to_string(l, chr(10))) AS notes_md5, 'Apache ' AS license, '1.0' AS version, pack, phase, 'description,license,name,notes,version' AS keys FROM parts"
    ),
    "s3_sections": on_duckdb(
        f"{_P} SELECT id, name AS title, 'When to use,Workflow' AS headings, len({_USE}) AS n_bullets, md5(array_to_string({_USE}, '|')) AS bullets_md5, trim('1. ' || coalesce(l[1], '')) AS workflow, '' AS missing FROM parts"
    ),
    "s3_suggest": on_duckdb(f"{_P}, found AS ({skills.ORACLES['s3_search']}) SELECT qid, found.name, score, rnk, coalesce(array_to_string(({_USE})[1:4], '|'), '') AS use_when FROM found LEFT JOIN parts ON parts.name = found.name"),
    "s3_did_you_mean": on_duckdb(
        f"""{_P}, asked AS (SELECT DISTINCT substr(name, 1, 1) || 'x' || substr(name, 2, length(name) - 2) AS asked FROM parts WHERE id % 100 = 0),
    d AS (SELECT asked, name, levenshtein(asked, name)::INTEGER AS distance FROM asked, (SELECT DISTINCT name FROM parts) WHERE asked NOT IN (SELECT name FROM parts))
    SELECT asked, name, distance, rnk::INTEGER AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY distance, name) AS rnk FROM d WHERE distance <= 2) WHERE rnk <= 5"""
    ),
}
