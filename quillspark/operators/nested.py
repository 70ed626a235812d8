"""Nested JSON documents inside the JVM: flattening, envelopes and strict reading, over VARIANT values.

A document's nodes stay in its row: each level of nesting is an array of nodes, taken from the level above, so nothing
is shuffled and the work follows the nodes. Levels go on for as long as any document has a deeper one. Texts that are
not JSON are told apart, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.scratch import written

#: Levels between two looks at whether any document goes deeper.
LEVELS_AT_ONCE = 6

_KIDS = "coalesce(try_variant_get(p.node, '$', 'array<variant>'), try_variant_get(p.node, '$.content', 'array<variant>'))"
_DEEPER = f"flatten(transform(filter(_level, p -> {_KIDS} IS NOT NULL), p -> transform({_KIDS}, (c, i) -> struct(concat(p.path, array(i)) AS path, c AS node))))"
_TEXTS = "transform(filter(_level, p -> try_variant_get(p.node, '$.type', 'string') = 'text' AND try_variant_get(p.node, '$.text', 'string') IS NOT NULL), p -> struct(p.path AS path, try_variant_get(p.node, '$.text', 'string') AS text))"


def flatten_text(df: DataFrame, json_col: str, out: str = "flat") -> DataFrame:
    """df with the texts of a document's text nodes, depth first, joined without separators; null where the JSON is not valid (C-28).

    A node is an object whose `content` array, or an array whose elements, are its children.
    """
    root = "CASE WHEN _root IS NULL THEN array() ELSE array(struct(cast(array() AS array<int>) AS path, _root AS node)) END"
    found = df.withColumn("_root", F.try_parse_json(F.col(json_col)))
    found = found.withColumn("_valid", F.col("_root").isNotNull()).withColumn("_level", F.expr(root).cast("array<struct<path:array<int>,node:variant>>"))
    found = found.withColumn("_texts", F.expr("cast(array() AS array<struct<path:array<int>,text:string>>)")).drop("_root")
    while True:
        for _ in range(LEVELS_AT_ONCE):
            found = found.withColumn("_texts", F.concat("_texts", F.expr(_TEXTS))).withColumn("_level", F.expr(_DEEPER))
        found = written(found)
        if found.where("size(_level) > 0").isEmpty():
            break
    joined = F.array_join(F.transform(F.array_sort("_texts"), lambda t: t["text"]), "")
    return found.withColumn(out, F.when(F.col("_valid"), joined)).drop("_valid", "_level", "_texts")


def unwrapped(text: Column, *keys: str) -> Column:
    """The rows of an envelope, as an array of variants (A-17): the text's array; else the array under the first of keys that has one; else that of its first property with an array.

    Properties are tried in source order, whole numbers first in their own order as in the language such payloads come
    from. Null where there is no array or no JSON.
    """
    own = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    entries = F.map_entries(F.from_json(text, "map<string,variant>"))
    arrays = lambda e: F.try_variant_get(e["value"], "$", "array<variant>")
    with_array = F.filter(entries, lambda e: arrays(e).isNotNull())
    called = lambda k: F.get(F.filter(with_array, lambda e: e["key"] == k), 0)
    named = [called(k) for k in keys]
    number = lambda e: F.when(e["key"].rlike(r"^(0|[1-9][0-9]{0,8})$"), e["key"].try_cast("long"))
    ordered = F.array_sort(F.transform(with_array, lambda e, i: F.struct(F.coalesce(number(e), F.lit(1 << 40)).alias("n"), i.alias("i"))))
    first = F.get(with_array, F.get(ordered, 0)["i"])
    chosen = F.coalesce(*named, first) if named else first
    return F.coalesce(own, arrays(chosen))


def _text(v: str, path: str) -> Column:
    """A string of a variant; null if it is missing or empty."""
    return F.nullif(F.expr(f"try_variant_get({v}, '{path}', 'string')"), F.lit(""))


def bug_reports(df: DataFrame, answer_col: str) -> DataFrame:
    """df with a bug report read strictly out of a model's answer (H-25, H-26), and its description as a nested document.

    The answer is an envelope whose choices[0].message.content is the report as JSON text. problem says what is wrong with
    an answer that cannot be read ('empty answer', 'not valid JSON'); its other columns are null then.
    """
    content = F.nullif(F.expr(f"try_variant_get(try_parse_json({answer_col}), '$.choices[0].message.content', 'string')"), F.lit(""))
    read = df.withColumn("_content", content).withColumn("_bug", F.try_parse_json("_content"))
    problem = F.when(F.col("_content").isNull(), "empty answer").when(F.col("_bug").isNull(), "not valid JSON")
    read = read.withColumn("problem", problem)
    told = lambda name, default: F.coalesce(_text("_bug", f"$.{name}"), F.lit(default))
    steps = F.coalesce(F.expr("try_variant_get(_bug, '$.stepsToReproduce', 'array<string>')"), F.array().cast("array<string>"))
    read = read.withColumn("summary", F.trim(told("summary", "Bug reported from screenshot"))).withColumn("_steps", steps)
    # nodes of one shape; what a node lacks is null and left out of the JSON
    texts = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("text")))
    node = lambda kind, level, c: F.struct(F.lit(kind).alias("type"), (F.struct(F.lit(level).alias("level")) if level else F.lit(None).cast("struct<level:int>")).alias("attrs"), (texts(c) if c is not None else F.lit(None).cast("array<struct<type:string,text:string>>")).alias("content"))
    heading, para, rule = (lambda n, c: node("heading", n, c)), (lambda c: node("paragraph", None, c)), node("rule", None, None)
    title = lambda x: heading(2, F.lit(x))
    numbered = F.transform("_steps", lambda s, i: para(F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(s, F.lit("null")))))
    logs = _text("_bug", "$.errorLogs")
    nodes = F.concat(
        F.array(heading(1, F.col("summary")), rule, title("Environment"), para(told("environment", "Not specified")), rule, title("Visual details"), para(told("visualDetails", "See attached screenshot.")), rule, title("Steps to reproduce")),
        F.when(F.size("_steps") > 0, numbered).otherwise(F.array(para(F.lit("Not provided.")))),
        F.array(rule, title("Expected behavior"), para(told("expectedBehavior", "Not specified")), title("Actual behavior"), para(told("actualBehavior", "Not specified"))),
        F.when(logs.isNotNull(), F.array(title("Error logs"), para(logs))).otherwise(F.expr("slice(array(struct('' AS type, cast(NULL AS struct<level:int>) AS attrs, cast(NULL AS array<struct<type:string,text:string>>) AS content)), 1, 0)")),
    )
    fine = lambda c: F.when(F.col("problem").isNull(), c)
    document = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("doc").alias("type"), nodes.alias("content")))
    return (
        read.withColumn("description", fine(document))
        .withColumn("severity", fine(told("severity", "Major")))
        .withColumn("component", _text("_bug", "$.component"))
        .withColumn("environment", _text("_bug", "$.environment"))
        .withColumn("steps", fine(F.col("_steps")))
        .withColumn("summary", fine(F.col("summary")))
        .drop("_content", "_bug", "_steps")
    )
