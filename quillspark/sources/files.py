"""File sources and sinks: checked CSV, JSON import and export, markdown folders, vector collections."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a test-case file, in order.
CASE_COLUMNS = (
    "Issue Type", "Issue Key", "Summary", "Description", "Priority", "Component", "Labels", "Test Type",
    "Preconditions", "Steps", "Expected Result", "Browser", "Device", "Status",
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A test-case CSV with every cell stripped; a file without rows or with columns missing is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    missing = [c for c in CASE_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    cases = raw.select(*[F.trim(F.coalesce(F.col(f"`{names[c]}`"), F.lit(""))).alias(c) for c in CASE_COLUMNS])
    if cases.isEmpty():
        raise ValueError(f"no rows in {path}")
    return cases


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """An optional table: without rows, but with its columns, where the path does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.format(kind).schema(schema).option("header", True).load(path)


def unwrap(df: DataFrame, column: str, keys: tuple[str, ...], element: str) -> DataFrame:
    """One row for each element of a JSON text that is an array, or an object with an array under the first of keys it has.

    Texts that are neither give no row. element: the elements' type, as in "struct<id:string>".
    """
    text, kind = F.col(column), T._parse_datatype_string(f"array<{element}>")
    wrapped = [F.from_json(text, T._parse_datatype_string(f"struct<`{k}`:array<{element}>>"))[k] for k in keys]
    rows = F.when(text.rlike(r"^\s*\["), F.from_json(text, kind)).otherwise(F.coalesce(*wrapped))
    return df.select(F.explode(rows).alias("_row")).select("_row.*")


def checked_values(df: DataFrame, column: str, wanted: list[str]) -> list[str]:
    """wanted, if the column has all of these values; an error names those that it has (a small domain is expected)."""
    known = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(1001).collect())
    unknown = [w for w in wanted if w not in known]
    if unknown:
        raise ValueError(f"unknown {column}: {', '.join(unknown)}; known: {', '.join(known[:1000])}")
    return wanted


def delete_keys(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key is not among keys; write the result to another path than old's."""
    return old.join(keys.select(key).distinct(), key, "left_anti")


def siblings(spark: SparkSession, folder: str, name: str = "SKILL.md") -> DataFrame:
    """path of every file called name below folder, and the sorted names of the other files beside or below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    parent = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    homes = files.where(F.col("path").endswith("/" + name)).select(F.col("path").alias("home"), parent.alias("at"))
    steps = F.expr("filter(transform(sequence(1, size(split(path, '/')) - 1), n -> substring_index(path, '/', n)), p -> p <> '')")
    others = files.where(~F.col("path").endswith("/" + name)).select("path", F.explode(steps).alias("at"))
    beside = homes.join(others, "at", "left").groupBy("home", "at").agg(F.sort_array(F.collect_list(F.expr("substring(path, length(at) + 2)"))).alias("extra_files"))
    return beside.select(F.col("home").alias("path"), "extra_files")


def steps_of(steps: str = "Steps"):
    """The steps of a case without their numbers."""
    return F.transform(F.filter(F.split(F.col(steps), r" \| "), lambda s: F.trim(s) != ""), lambda s: F.regexp_replace(F.trim(s), r"^\d+\.\s*", ""))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs out of JSON that is a bare array or an object with a `jobs` array; unknown states become wishlist."""
    fields = "array<struct<id:string,company:string,role:string,status:string,dateApplied:string>>"
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", T._parse_datatype_string(f"struct<jobs:{fields}>"))["jobs"]
    rows = text.select(F.explode(F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", T._parse_datatype_string(fields))).otherwise(wrapped)).alias("j")).select("j.*")
    known = F.col("status").isin("wishlist", "applied", "followup", "interview", "offer", "rejected")
    return rows.withColumn("status", F.when(known, F.col("status")).otherwise("wishlist"))


def safe_name(name: str) -> str:
    """A file name without path parts or odd characters."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", name).lstrip(".") or "_"


def export(df: DataFrame, folder: str, name: str, kind: str = "csv", limit: int = 200) -> str:
    """Writes at most limit rows as csv, json or md under folder and returns the path."""
    path = f"{folder.rstrip('/')}/{safe_name(name)}"
    some = df.limit(limit).coalesce(1)
    if kind == "md":
        some.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(" |"))).write.mode("overwrite").text(path)
    else:
        some.write.mode("overwrite").format(kind).option("header", True).save(path)
    return path


#: The names that a case's fields have in a test-case file.
CASE_FIELDS = dict(zip(("issue_type", "issue_key", "summary", "description", "priority", "module", "labels", "test_type", "preconditions", "steps", "expected_result", "browser", "device", "status"), CASE_COLUMNS, strict=True))
_SHOWN = ("issue_key", "module", "test_type", "priority", "status", "browser", "device", "summary")


def case_file_rows(cases: DataFrame) -> DataFrame:
    """Cases under the fourteen names of a test-case file, in its order; fields that cases lack are empty (B-06)."""
    return cases.select(*[(F.col(f"`{c}`").cast("string") if c in cases.columns else F.lit("")).alias(name) for c, name in CASE_FIELDS.items()])


def export_cases(cases: DataFrame, folder: str, name: str, kind: str = "csv", limit: int = 200, title: str = "all modules") -> str:
    """Writes at most limit cases as csv (the original fourteen columns), json or md (a table with its header) and returns the path (A-13)."""
    if kind not in ("csv", "json", "md"):
        raise ValueError(f"unknown format: {kind}; valid: csv, json, md")
    if kind != "md":
        return export(case_file_rows(cases) if kind == "csv" else cases, folder, name, kind, limit)
    path = f"{folder.rstrip('/')}/{safe_name(name)}"
    some, total = cases.limit(limit), cases.count()
    names = [w.replace("_", " ").title() for w in _SHOWN]
    head = [f"# Test cases — {title}", "", f"- Rows exported: {min(limit, total)} of {total} matched", "", f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}"]
    lines = cases.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "_at long, value string")
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", "\\\\|") for c in _SHOWN]
    rows = some.select(F.monotonically_increasing_id().alias("_at"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    lines.unionByName(rows).coalesce(1).sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path)  # limit rows and the head
    return path


def export_skills(files: DataFrame, folder: str, name: str, kind: str = "md") -> str:
    """Writes skill files (pack, folder, text) as one text file each pack (md) or as rows (json) and returns the path (A-14)."""
    path = f"{folder.rstrip('/')}/{safe_name(name)}"
    if kind == "json":
        files.write.mode("overwrite").json(path)
    elif kind == "md":
        told = F.concat(F.lit("<!-- "), F.concat_ws("/", "pack", F.nullif("folder", F.lit(""))), F.lit(" -->\n"), F.col("text"))
        files.select("pack", "folder", told.alias("value")).repartition("pack").sortWithinPartitions("pack", "folder").select("pack", "value").write.mode("overwrite").partitionBy("pack").text(path)
    else:
        raise ValueError(f"unknown format: {kind}; valid: json, md")
    return path


def read_markdown(spark: SparkSession, folder: str, name: str = "SKILL.md") -> DataFrame:
    """path, front (map of the scalar front-matter keys), body of every such file below folder."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select("value", F.col("_metadata.file_path").alias("path"))
    block = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1)
    folded = F.regexp_replace(F.regexp_replace(block, r":[ \t]*>[ \t]*\n[ \t]+", ": "), r"\n[ \t]++(?![\w-]+:)", " ")
    pairs = F.transform(F.filter(F.split(folded, "\n"), lambda x: x.rlike(r"^\s*[\w-]+:\s*\S")), lambda x: F.struct(F.regexp_extract(x, r"^\s*([\w-]+):", 1), F.regexp_replace(F.regexp_extract(x, r":\s*(.*?)\s*$", 1), r"^[\"']|[\"']$", "")))
    first = F.array_distinct(F.transform(pairs, lambda p: p["col1"]))
    unique = F.transform(first, lambda k: F.element_at(F.filter(pairs, lambda p: p["col1"] == k), 1))
    return raw.select("path", F.map_from_entries(unique).alias("front"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\s*", "").alias("body"))


def put_vectors(df: DataFrame, path: str, width: int) -> None:
    """Rebuilds a vector collection (id, embedding); a vector of another width is an error."""
    checked = df.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vector width is not {width}"))))
    checked.write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new ones winning by key; write the result to another path than old's."""
    tagged = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_v")))
    return tagged.withColumn("_r", rank).where("_r = 1").drop("_v", "_r")
