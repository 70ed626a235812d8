"""Tickets and model answers: nested documents flattened, bug reports read strictly, envelopes unwrapped.

The driver's tables hold no JSON documents, so the queries write every text into one first, at varying depth and with
every eleventh cut short; the SQL knows what must come out without reading any JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.nested import bug_reports, flatten_text, unwrapped
from quillspark.sources.adapters import on_spark
from quillspark.sources.tables import table


def _quoted(c):
    """A string as JSON text."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _ticket_text(spark, sf_dir):
    """C-28, H-26: every line a text node, under zero to six wrappers; every eleventh document is not valid."""
    lines = F.split("text", "\n", -1)
    line = lambda x, i: F.concat(F.repeat(F.lit('{"type":"panel","content":['), F.pmod(i, F.lit(7))), F.lit('{"type":"paragraph","content":[{"type":"text","text":'), _quoted(x), F.lit('},[{"type":"hardBreak"}]]}'), F.repeat(F.lit("]}"), F.pmod(i, F.lit(7))))
    json = F.concat(F.lit('{"type":"doc","version":1,"content":['), F.array_join(F.transform(lines, line), ","), F.lit("]}"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.substring(json, F.lit(1), F.length(json) - 1)).otherwise(json).alias("json"))
    return flatten_text(docs, "json").select("doc_id", F.md5(F.col("flat").cast("binary")).alias("flat_md5"), F.col("flat").isNotNull().alias("valid"))


def _answers(spark, sf_dir):
    """Model answers made of the documents: the first line as summary, the next three as steps; some empty, some cut short."""
    docs = on_spark(spark, sf_dir, "SELECT doc_id, text, source, lang FROM {documents} WHERE text IS NOT NULL")
    lines = F.split("text", "\n", -1)
    steps = F.array_join(F.transform(F.slice(lines, 2, 3), _quoted), ",")
    severity = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("Critical"))
    bug = F.concat(F.lit('{"summary":'), _quoted(F.get(lines, 0)), F.lit(',"severity":'), _quoted(severity), F.lit(',"component":'), F.coalesce(_quoted(F.col("source")), F.lit("null")), F.lit(',"stepsToReproduce":['), steps, F.lit("]}"))
    bug = F.when(F.col("doc_id") % 13 == 0, F.lit("")).when(F.col("doc_id") % 11 == 0, F.substring(bug, F.lit(1), F.length(bug) - 1)).otherwise(bug)
    return docs.select("doc_id", F.concat(F.lit('{"choices":[{"message":{"content":'), _quoted(bug), F.lit("}}]}")).alias("answer"))


def _bug_reports(spark, sf_dir):
    """H-25, H-26: fields with their defaults, and the description document read back as text."""
    reports = bug_reports(_answers(spark, sf_dir), "answer").select("doc_id", "problem", "summary", "severity", "component", F.size("steps").alias("n_steps"), "description")
    flat = flatten_text(reports, "description")
    return flat.select("doc_id", "problem", F.md5(F.col("summary").cast("binary")).alias("summary_md5"), "severity", "component", F.coalesce(F.when(F.col("problem").isNull(), F.col("n_steps")), F.lit(0)).alias("n_steps"), F.md5(F.col("flat").cast("binary")).alias("description_md5"))


def _envelopes(spark, sf_dir):
    """A-17: turns of a conversation as a bare array, under a known key, or under a key that no one has named, after properties that are no arrays."""
    turns = table(spark, sf_dir, "conversations").where("role is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    rows = F.to_json(F.transform("t", lambda x: F.struct(x["turn"], x["role"])))
    kind = F.col("conv_id") % 4
    key = F.concat(F.lit('"k'), (F.col("conv_id") % 10).cast("string"), F.lit('":'))
    decoy = F.lit('"note":"[1,2]","zz":{"a":[9]},"count":3,')
    json = F.when(kind == 0, rows).when(kind == 1, F.concat(F.lit('{"aaa":[{"turn":-1}],"logs":'), rows, F.lit("}"))).when(kind == 2, F.concat(F.lit("{"), decoy, key, rows, F.lit(',"aaa":[{"turn":-2}]}'))).otherwise(F.concat(F.lit("{"), decoy, F.lit('"aaa":[{"turn":-3}],"7":'), rows, F.lit("}")))
    found = turns.select("conv_id", F.explode(unwrapped(json, "logs", "items")).alias("row"))
    return found.select("conv_id", F.expr("variant_get(row, '$.turn', 'bigint')").alias("turn"), F.expr("variant_get(row, '$.role', 'string')").alias("role"))


QUERIES = {"s6_ticket_text": _ticket_text, "s6_bug_reports": _bug_reports, "s4_envelopes": _envelopes}

ORACLES = {
    "s6_ticket_text": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE md5(replace(text, chr(10), '')) END AS flat_md5, doc_id % 11 <> 0 AS valid FROM documents WHERE text IS NOT NULL",
    "s6_bug_reports": """WITH a AS (SELECT *, string_split(text, chr(10)) AS lines, CASE WHEN doc_id % 13 = 0 THEN 'empty answer' WHEN doc_id % 11 = 0 THEN 'not valid JSON' END AS problem FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, trim(coalesce(nullif(lines[1], ''), 'Bug reported from screenshot'), ' ') AS summary, lines[2:4] AS steps FROM a)
SELECT doc_id, problem, CASE WHEN problem IS NULL THEN md5(summary) END AS summary_md5, CASE WHEN problem IS NULL THEN CASE WHEN doc_id % 3 = 0 THEN 'Major' ELSE 'Critical' END END AS severity,
    CASE WHEN problem IS NULL THEN nullif(source, '') END AS component, CASE WHEN problem IS NULL THEN len(steps) ELSE 0 END AS n_steps,
    CASE WHEN problem IS NULL THEN md5(summary || 'EnvironmentNot specifiedVisual detailsSee attached screenshot.Steps to reproduce'
        || CASE WHEN len(steps) = 0 THEN 'Not provided.' ELSE array_to_string(list_transform(steps, lambda s, i: i || '. ' || s), '') END || 'Expected behaviorNot specifiedActual behaviorNot specified') END AS description_md5 FROM b""",
    "s4_envelopes": "SELECT conv_id, turn, role FROM conversations WHERE role IS NOT NULL",
}
