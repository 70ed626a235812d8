"""Nested documents, skill files, closest names, retry policies, source order and tools against plain loops or DuckDB."""

from __future__ import annotations

import hashlib
import json
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import registry, tools
from quillspark.operators import retries
from quillspark.operators.closest import _met_by_remains, closest
from quillspark.operators.markdown import bullets, first_heading, front_matter, section, sections, use_when
from quillspark.operators.nested import bug_reports, flatten_text, unwrapped
from quillspark.plans import skills, toolbox
from quillspark.sources.adapters import CASES, on_duckdb
from quillspark.sources.ordered import read_in_order, tail
from tests.oracle import connect, same_rows

SMALL = "/root/testdata/sf0.001"


def one_column(spark, values, name="text"):
    return spark.createDataFrame(list(enumerate(values)), f"id long, {name} string")


# nested documents


def plain_text(node):
    if isinstance(node, list):
        return "".join(map(plain_text, node))
    if not isinstance(node, dict):
        return ""
    own = node["text"] if node.get("type") == "text" and isinstance(node.get("text"), str) else ""
    kids = node.get("content", [])
    return own + (plain_text(kids) if isinstance(kids, list) else "")


def random_node(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return {"type": rng.choice(["text", "text", "hardBreak"]), "text": rng.choice(["a", "b\n", '"q"', "é ", ""])}
    kids = [random_node(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([{"content": kids, "type": "p"}, {"type": "text", "text": "own", "content": kids}, kids, {"type": "p", "content": "no list"}, {"type": "p"}, 7, None])


def test_nested_documents_flatten_depth_first(spark):
    rng = random.Random(4)
    nodes = [random_node(rng, 6) for _ in range(150)]
    deep = {"type": "text", "text": "end"}
    for i in range(40):
        deep = {"type": "panel", "content": [{"type": "text", "text": str(i)}, deep]}
    texts = [json.dumps(n) for n in [*nodes, deep, {}, [], "x", None]]
    broken = ["", "{", '{"type":"text"', "not json", None]
    got = {r.id: r.flat for r in flatten_text(one_column(spark, [*texts, *broken]).withColumn("_x", F.lit(1)), "text").collect()}
    for i, n in enumerate([*nodes, deep, {}, [], "x", None]):
        assert got[i] == plain_text(n), texts[i]
    assert all(got[len(texts) + i] is None for i in range(len(broken)))
    assert flatten_text(one_column(spark, texts).limit(0), "text").count() == 0


ENVELOPES = [
    ('[{"a":1},{"a":2}]', [1, 2]),
    ('{"logs":[{"a":3}],"first":[{"a":9}]}', [3]),
    ('{"first":[{"a":9}],"logs":[{"a":3}]}', [3]),
    ('{"items":[{"a":4}],"logs":"[1]"}', [4]),
    ('{"s":"[5]","o":{"a":[1]},"n":null,"zz":[{"a":5}],"aa":[{"a":6}]}', [5]),
    ('{"b":[{"a":1}],"10":[{"a":2}],"9":[{"a":3}]}', [3]),
    ('{"logs":[]}', []),
    ('{"x":1}', None),
    ("{}", None),
    ('"text"', None),
    ("[1,", None),
    ("", None),
    (None, None),
]


def test_envelopes(spark):
    found = one_column(spark, [e for e, _ in ENVELOPES]).select("id", unwrapped(F.col("text"), "logs", "items").alias("rows"))
    got = {r.id: r.a for r in found.select("id", F.expr("transform(rows, x -> try_variant_get(x, '$.a', 'int'))").alias("a")).collect()}
    assert [got[i] for i in range(len(ENVELOPES))] == [w for _, w in ENVELOPES]


def test_bug_reports(spark):
    answer = lambda content: json.dumps({"choices": [{"message": {"content": content}}]})
    full = {"summary": " Title ", "severity": "Minor", "component": "UI", "environment": "Linux", "visualDetails": "red", "expectedBehavior": "green", "actualBehavior": "blue", "stepsToReproduce": ["go", 'click "x"'], "errorLogs": "boom"}
    rows = [answer(json.dumps(full)), answer(json.dumps({"summary": "", "stepsToReproduce": "none"})), answer(""), answer("{oops"), "{}", "no json", None]
    got = {r.id: r for r in bug_reports(one_column(spark, rows, "answer"), "answer").collect()}
    assert (got[0].summary, got[0].severity, got[0].component, got[0].steps) == ("Title", "Minor", "UI", ["go", 'click "x"'])
    nodes = json.loads(got[0].description)
    assert list(nodes) == ["version", "type", "content"] and nodes["content"][0] == {"type": "heading", "attrs": {"level": 1}, "content": [{"type": "text", "text": "Title"}]} and nodes["content"][1] == {"type": "rule"}
    assert plain_text(nodes) == 'TitleEnvironmentLinuxVisual detailsredSteps to reproduce1. go2. click "x"Expected behaviorgreenActual behaviorblueError logsboom'
    assert (got[1].summary, got[1].severity, got[1].component, got[1].steps) == ("Bug reported from screenshot", "Major", None, [])
    assert "Not provided." in plain_text(json.loads(got[1].description))
    assert [got[i].problem for i in range(7)] == [None, None, "empty answer", "not valid JSON", "empty answer", "empty answer", "empty answer"]
    assert got[3].description is None and got[3].severity is None


# skill files


def looped_front_matter(text):
    """A line at a time."""
    whole = re.match(r"^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?(.*)$", text, re.S)
    if not whole:
        return {}, {}, text
    scalars, maps, key, held = {}, {}, None, []
    bare = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v

    def close():
        if key is None:
            return
        first, more = held[0], held[1:]
        scalars.pop(key, None)
        maps.pop(key, None)
        said = [x.strip() for x in more if x.strip()]
        if first in (">", ">-", ">+"):
            scalars[key] = " ".join(said)
        elif first in ("|", "|-", "|+"):
            scalars[key] = "\n".join(said)
        elif first == "" and more:
            pairs = [re.match(r"\s+([A-Za-z_][\w-]*):\s*(.*)$", x) for x in more]
            maps[key] = {p[1]: bare(p[2].strip()) for p in pairs if p}
        else:
            scalars[key] = bare(first)

    for line in re.split(r"\r\n|\n", whole[1]):
        if line.strip() and not line[0].isspace():
            close()
            at = re.match(r"([A-Za-z_][\w-]*):(.*)$", line)
            key, held = (at[1], [at[2].strip()]) if at else (None, [])
        elif key is not None:
            held.append(line)
    close()
    return scalars, maps, whole[2]


def test_front_matter_equals_a_loop(spark):
    rng = random.Random(9)
    lines = ["name: x", 'title: "quoted"', "title: 'q'", "d: >-", "d: |", "d: >", "meta:", "  a: 1", '  b: "two"', "  # no", "  text goes on", "", "   ", "# comment", "stray words", "a-b_c: v: w", "9x: no", "e:", "q: '", 'w: "a\'', "  a: again", "\tt: tab"]
    texts = []
    for _ in range(300):
        end = rng.choice(["\n", "\n", "\r\n"])
        block = end.join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))
        texts.append(f"---{end}{block}{end}---{rng.choice([end, '', '  ' + end])}{rng.choice(['body', '# H' + end + '---' + end, ''])}")
    texts += ["no front", "", "---\n---\n", "--- \na: 1\n---", "---\na: 1", "x\n---\na: 1\n---\n", "---\na: 1\n---\nb\n---\nc"]
    scalars, maps, body = front_matter(F.col("text"))
    for r in one_column(spark, texts).select("text", scalars.alias("s"), maps.alias("m"), body.alias("b")).collect():
        assert (r.s, r.m, r.b) == looped_front_matter(r.text), r.text


def test_sections_and_bullets(spark):
    body = "intro\n# Title one \n# Second\n## When to use\n- first \n* second\nplain\n   -   third\n### deep\n## Other  \ntext\n\n##nothing\n## When to use\n- later\n"
    frame = one_column(spark, [body, "", "## When to use", "a\n## X y\r\nz"])
    c = F.col("text")
    got = {r.id: r for r in frame.select("id", use_when(c).alias("u"), section(c, "Other").alias("o"), section(c, "None").alias("n"), first_heading(c).alias("h"), sections(c).alias("s"), bullets(c).alias("b")).collect()}
    assert got[0].u == ["first", "second", "third"] and got[0].o == "text\n\n##nothing" and got[0].n == "" and got[0].h == "Title one"
    assert [s.heading for s in got[0].s] == ["When to use", "Other", "When to use"] and got[0].s[2].text == "- later"
    assert got[0].b == ["first", "second", "third", "later"] and got[1].u == [] and got[2].u == [] and got[1].h == ""
    assert [tuple(s) for s in got[3].s] == [("X y", "z")]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_closest_names_equal_all_pairs(spark, edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(0, 9)))
    names, asked = {word() for _ in range(250)} | {"aaaaaaaaaa", "abababab", "common-1", "common-2", "common-33"}, {word() for _ in range(25)} | {"common-3", "bbbbbbbbbb", "abababa", ""}
    got = closest(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), spark.createDataFrame([(a,) for a in [*asked, None]], "asked string"), edits=edits).collect()
    near = lambda a: sorted((edit_distance(a, n), n) for n in names)[:5]
    wanted = {(a, n, d, k + 1) for a in asked for k, (d, n) in enumerate(near(a)) if d <= edits}
    assert {tuple(r) for r in got} == wanted


@pytest.mark.parametrize("longest", [0, 4, 7])
def test_closest_names_on_both_sides_of_the_longest(spark, longest):
    rng = random.Random(longest)
    names, asked = ({"".join(rng.choice("abé") for _ in range(rng.randrange(0, 11))) for _ in range(n)} for n in (300, 60))
    got = closest(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(a,) for a in asked], "asked string"), longest=longest).collect()
    near = lambda a: sorted((edit_distance(a, n), n) for n in names)[:5]
    assert {tuple(r) for r in got} == {(a, n, d, k + 1) for a in asked for k, (d, n) in enumerate(near(a)) if d <= 2}


def test_names_that_meet_do_not_grow_with_the_names(spark):
    """Names far from each other: one that is asked for meets its own name only, however many others there are."""
    names = [hashlib.md5(str(i).encode()).hexdigest()[:16] for i in range(4000)]
    asked = spark.createDataFrame([(n[0] + "x" + n[1:-1],) for n in names[:40]], "name string")
    for n in (1000, 4000):
        met = _met_by_remains(spark.createDataFrame([(x,) for x in names[:n]], "name string"), asked, 2).distinct().collect()
        assert {(r.asked, r.name) for r in met} == {(x[0] + "x" + x[1:-1], x) for x in names[:40]}


# retry policies


def test_settings_and_ladders(spark):
    rows = [("a", 1, "retryAttempts", "4"), ("a", 2, "retryDelaysSeconds", "10, x,0, -5, 15"), ("a", 3, "retryAttempts", "5"), ("b", 1, "retryDelayMs", "2500"), ("c", 1, "note", "z"), ("d", 1, "retryCount", "1"), ("e", 1, "retryDelaysSeconds", "1,2,3,4,5,6"), ("f", 1, "retryAttempts", "soon"), ("g", 1, "retryAttempts", None), ("h", 1, "responseTimeThresholdMs", "700")]
    got = {r.scope: r for r in retries.pivot_settings(spark.createDataFrame(rows, "scope string, pos long, k string, v string")).collect()}
    assert {k: list(r.delays) for k, r in got.items()} == {"a": [10, 15, 15, 15], "b": [3, 3], "c": [20, 30], "d": [], "e": [1, 2], "f": [20, 30], "g": [20, 30], "h": [20, 30]}
    assert got["h"].threshold_ms == 700 and got["a"].threshold_ms == 3000 and got["a"].attempts == 5 and got["a"].interval_min == 5
    steps = spark.createDataFrame([([20, 30],), ([],)], "d array<int>").select(retries.ladder(F.col("d")).alias("l")).collect()
    assert [(s.scheduled, s.retried, s.cursor) for s in steps[0].l] == [(1, 20, 21), (22, 51, 52)] and steps[1].l == []


def test_attempts_stop_at_the_recovery(spark):
    start = "timestamp'2024-01-01 00:00:00'"
    rows = spark.sql(f"SELECT * FROM (SELECT stack(4, 'never', NULL, 'first', 21, 'second', 30, 'late', 4000) AS (incident_id, s)) LATERAL VIEW explode(array(array(20, 30))) d AS delays").withColumn("started", F.expr(start)).withColumn("recovered", F.expr(f"{start} + make_dt_interval(0, 0, 0, s)"))
    got: dict = {}
    for r in retries.retry_history(rows).orderBy("incident_id", "pos").collect():
        got.setdefault(r.incident_id, []).append((r.attempt, r.outcome, r.delay_s, r.off_ms))
    assert got["first"] == [(1, "failed", None, 0), (2, "scheduled", 20, 1000), (2, "succeeded", None, 20000), (1, "info", None, 21000)]
    assert got["second"][-2:] == [(3, "succeeded", None, 51000), (1, "info", None, 30000)] and got["second"][2] == (2, "failed", None, 20000)
    assert got["never"][-2:] == [(3, "failed", None, 51000), (1, "info", None, 52000)] and got["late"][-1] == (1, "info", None, 4_000_000)
    events = {(r.pos, r.kind, r.off_ms) for r in retries.timeline(rows.where("incident_id = 'first'")).collect()}
    assert events == {(1, "failure", 0), (2, "schedule", 1000), (3, "retry", 20000), (4, "schedule", 22000), (5, "retry", 51000), (6, "incident", 52000), (7, "recovery", 21000)}
    kpis = {r.outcome: (r.n, r.mean_delay_s) for r in retries.retry_kpis(retries.retry_history(rows)).collect()}
    assert kpis["scheduled"] == (7, round(170 / 7, 6)) and kpis["info"] == (4, None)


def test_tail_is_by_source_order(spark, tmp_path):
    for i in (2, 0, 1):
        spark.createDataFrame([(i, j) for j in (5, 3, 9)], "f int, x int").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    rows = read_in_order(spark, str(tmp_path / "p*"))
    assert sorted((r.f, r.x) for r in tail(rows, 4).collect()) == [(1, 9), (2, 3), (2, 5), (2, 9)]
    assert tail(rows, 0).count() == 0 and tail(rows, 99).count() == 9


# tools


@pytest.fixture(scope="module")
def catalogue(spark):
    return toolbox.tools(spark, SMALL)


def cases(sql):
    return f"WITH {on_duckdb(CASES)} {sql}"


SCORE = "100 * priority_rank + 10 * status_rank"
TOOLS = {
    "modules": (lambda t: t.modules(), "SELECT module, count(*) AS n FROM cases GROUP BY module"),
    "search": (lambda t: t.search(priorities=["High", "Low"], devices=["tablet"], statuses=[], limit=7, offset=3).rows, f"SELECT {', '.join(tools.COMPACT)} FROM cases WHERE priority IN ('High', 'Low') AND device = 'tablet' ORDER BY key_num LIMIT 7 OFFSET 3"),
    "search_fields": (lambda t: t.search(keyword="TC-1", search_fields=["issue_key"], full=True, limit=200).rows.select("issue_key"), "SELECT issue_key FROM cases WHERE contains(lower(issue_key), 'tc-1') ORDER BY key_num LIMIT 200"),
    "by_ids": (lambda t: t.by_ids([" tc-3", "TC-7", "tc-3", "TC-0x"])[0].select("pos", "issue_key"), "SELECT pos, issue_key FROM (VALUES (0, 'TC-3'), (1, 'TC-7'), (2, 'TC-3')) AS v(pos, k) JOIN cases ON issue_key = k"),
    "variants": (lambda t: t.variants("TC-7").select("issue_key"), "SELECT b.issue_key FROM cases a JOIN cases b USING (design_key) WHERE a.issue_key = 'TC-7' AND b.issue_key <> 'TC-7'"),
    "count": (lambda t: t.count("test_type", min_priority="Medium", exclude_statuses=["Deprecated"]), "SELECT test_type, count(*) AS n FROM cases WHERE priority_rank >= 2 AND status <> 'Deprecated' GROUP BY test_type"),
    "count_all": (lambda t: t.count(), "SELECT count(*) AS n FROM cases"),
    "stats": (lambda t: t.stats(["status", "device"]), "SELECT status, device, count(*) AS n FROM cases GROUP BY ALL"),
    "priority_breakdown": (lambda t: t.priority_breakdown("BUILDING"), "SELECT module, count(*) FILTER (priority = 'Highest') AS highest, count(*) FILTER (priority = 'High') AS high, count(*) FILTER (priority = 'Medium') AS medium, count(*) FILTER (priority = 'Low') AS low, count(*) AS total FROM cases WHERE module = 'BUILDING' GROUP BY module"),
    "matrix": (lambda t: t.coverage_matrix(["BUILDING"]).select("module", "API", "Security"), "SELECT module, count(*) FILTER (test_type = 'API') AS \"API\", count(*) FILTER (test_type = 'Security') AS \"Security\" FROM cases WHERE module = 'BUILDING' GROUP BY module"),
    "top": (lambda t: t.top_for_module("BUILDING", 5).select("issue_key", "score"), f"SELECT issue_key, {SCORE} AS score FROM cases WHERE module = 'BUILDING' AND status <> 'Deprecated' ORDER BY score DESC, key_num LIMIT 5"),
    "smoke": (lambda t: t.smoke_suite(2), f"SELECT module, row_number() OVER (PARTITION BY module ORDER BY {SCORE} DESC, key_num) AS rnk, issue_key, {SCORE} AS score FROM cases WHERE priority = 'Highest' AND status IN ('Ready', 'Automated') QUALIFY rnk <= 2"),
}


@pytest.mark.parametrize("name", sorted(TOOLS))
def test_tool_equals_sql(catalogue, name):
    call, sql = TOOLS[name]
    same_rows(call(catalogue), connect(SMALL), cases(sql))


def test_tool_parameters(catalogue):
    with pytest.raises(tools.ToolError, match="valid: .*BUILDING"):
        catalogue.query(module="building")
    for call in (lambda: catalogue.query(priorities=["Urgent"]), lambda: catalogue.query(min_priority="x"), lambda: catalogue.search(limit=-1), lambda: catalogue.search(sort_by="size"), lambda: catalogue.query(keyword="a", search_fields=["nope"]), lambda: catalogue.count("summary"), lambda: catalogue.case("TC-none"), lambda: catalogue.filter_values("key")):
        with pytest.raises(tools.ToolError):
            call()
    assert tools.clamp(None) == 25 and tools.clamp(900) == 200 and tools.clamp(0) == 0
    page = catalogue.search(limit=0, offset=-5)
    assert page.rows.count() == 0 and page.offset == 0 and page.has_more
    assert catalogue.by_ids([])[1] == [] and catalogue.by_ids(["x"])[1] == ["X"]
    plan = catalogue.query(module="BUILDING", keyword="'); DROP TABLE x; --")
    assert plan.count() == 0
    assert set(catalogue.filter_values("status")["status"]) == set(tools.STATUS_RANK)


def test_snapshot_needs_one_source(spark):
    bad = lambda: spark.read.parquet("/nowhere/at/all")
    rows = {r.source: (r.ok, r.rows) for r in toolbox.snapshot(spark, {"a": lambda: spark.range(5), "b": bad, "c": lambda: spark.range(3).select(F.raise_error(F.lit("x")))}).collect()}
    assert rows == {"a": (True, 5), "b": (False, 0), "c": (False, 0)}
    with pytest.raises(RuntimeError, match="no source"):
        toolbox.snapshot(spark, {"b": bad})


# the data source


def test_skill_folders_as_a_source(spark, tmp_path):
    from quillspark.sources.skillsource import register  # noqa: PLC0415

    texts = {"web/cypress/SKILL.md": "---\nname: cypress\n---\n# Cypress\n## When to use\n- flaky é\n", "web/cypress/ref/a.txt": "a", "web/cypress/b.txt": "b", "api/SKILL.md": "---\nname: api\n---\nbody", "api/other.md": "x", "empty/none.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    register(spark)
    found = spark.read.format("skillfolder").load(str(tmp_path))
    got = {r.pack: (r.folder, r.text, r.extra_files) for r in found.collect()}
    assert got == {"web": ("cypress", texts["web/cypress/SKILL.md"], ["b.txt", "ref/a.txt"]), "api": ("", texts["api/SKILL.md"], ["other.md"])}
    scalars, _, body = front_matter(F.col("text"))
    assert {(r.n, tuple(r.u)) for r in found.select(scalars["name"].alias("n"), use_when(body).alias("u")).collect()} == {("cypress", ("flaky é",)), ("api", ())}
    one = found.where("pack = 'web'")
    assert one.rdd.getNumPartitions() == 1 and found.rdd.getNumPartitions() == 3 and [r.folder for r in one.collect()] == ["cypress"]
    assert found.where("pack in ('api', 'none')").rdd.getNumPartitions() == 1 and found.where("pack = 'none'").count() == 0
    assert found.where("pack = 'web' and folder = 'x'").count() == 0


def test_case_exports(spark, catalogue, tmp_path):
    from quillspark.sources.files import CASE_COLUMNS, export_cases, export_skills, read_cases  # noqa: PLC0415

    hits = catalogue.query(module="BUILDING").orderBy("key_num")
    back = read_cases(spark, export_cases(hits, str(tmp_path), "../cases.csv", limit=5))
    assert back.columns == list(CASE_COLUMNS) and back.count() == 5 and {r.Component for r in back.collect()} == {"BUILDING"}
    odd = hits.limit(2).withColumn("summary", F.lit("a | b"))
    lines = [r.value for r in spark.read.text(export_cases(odd, str(tmp_path), "cases.md", "md", title="BUILDING")).collect()]
    assert lines[0] == "# Test cases — BUILDING" and lines[4].startswith("| Issue Key | Module |") and len(lines) == 8 and lines[6].endswith("| a \\| b |")
    with pytest.raises(ValueError, match="valid"):
        export_cases(hits, str(tmp_path), "x", "xml")
    files = spark.createDataFrame([("web", "b", "# B"), ("web", "a", "# A"), ("api", "", "# C")], "pack string, folder string, text string")
    told = spark.read.text(export_skills(files, str(tmp_path), "skills"), wholetext=True)
    assert {r.pack: r.value for r in told.collect()} == {"web": "<!-- web/a -->\n# A\n<!-- web/b -->\n# B\n", "api": "<!-- api -->\n# C\n"}
    assert spark.read.json(export_skills(files, str(tmp_path), "rows", "json")).count() == 3


# skills over tables of one's own


def documents(spark, folder, rows):
    """A folder with these documents (doc_id, text, lang, source), without labels; and DuckDB over it."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return str(folder), con


ODD = [(1, "", "en", "src1"), (2, "###\n!!! \n--", "fr", "src1"), (3, "one line", None, None), (4, "a\n\n** \nb\nc", "en", None), (101, "a worthless license\nfind \"quoted thing\" tion", "en", "src1"), (101, "license License zzzz", "fr", "src1"), (7, "ering src7", "de", "src7"), (8, "the des des of tion", None, None)]


@pytest.mark.parametrize("name", ["s3_front_matter", "s3_sections", "s3_suggest"])
def test_skill_files_of_texts_without_a_plain_line(spark, tmp_path, name):
    folder, con = documents(spark, tmp_path, [r for i, r in enumerate(ODD) if i != 5])
    same_rows(registry.queries()[name](spark, folder), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["s3_search", "s3_search_all"])
def test_skill_search_of_odd_names_moves_no_texts(spark, tmp_path, name):
    folder, con = documents(spark, tmp_path, ODD)
    found = registry.queries()[name](spark, folder)
    same_rows(found, con, registry.oracle_sql()[name])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert moved and not any(re.search(r"\b(text|description|descr|body)#", x) for x in moved)


def test_related_skills_of_odd_names_meet_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skills, "ASKED_AT_ONCE", 2)
    monkeypatch.setattr(skills, "ROWS_AT_ONCE", 7)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 9)) + " x" * (i % 300), "en", None if i % 11 == 0 else f"src{i % 3}") for i in range(90, 460, 5)]
    folder, con = documents(spark, tmp_path, [*ODD, *rows, (500, None, "en", "src1"), (600, " ".join(f"v{i}" for i in range(700)), "en", "src2"), (601, " ".join(f"v{i}" for i in range(699)), "en", "src1")])
    found = registry.queries()["s3_related"](spark, folder)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    same_rows(found, con, registry.oracle_sql()["s3_related"])


def test_related_skills_cut_texts_once_and_give_out_the_nearest_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skills, "ASKED_AT_ONCE", 2)
    rows = [(i, " ".join(f"{'xyz'[i % 3]}{(i * j) % 37}" for j in range(20)) + " caf\u00e9 \u212a c++ c#", "en", f"src{i % 2}") for i in range(1000, 1900)]
    folder, con = documents(spark, tmp_path, rows)
    found = registry.queries()["s3_related"](spark, folder)
    assert "documents.parquet" not in found._jdf.queryExecution().executedPlan().toString()
    same_rows(found, con, registry.oracle_sql()["s3_related"])

    ids = lambda *words: pa.array([np.array(w, np.int32).tobytes() for w in words], pa.binary())
    sent = pa.table({"name": ["a", "b"], "pack": ["p", None], "n": pa.array([2, 3], pa.int32()), "ids": ids([0, 1], [1, 2, 3])})
    names = [f"n{i:04}" for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(["p", "q"] * 1500), pa.array([2] * 3000, pa.int32()), ids(*[[1, i % 4] if i % 4 != 1 else [1] for i in range(3000)])], names=["name", "pack", "n", "ids"])
    (got,) = skills._nearest(type("Sent", (), {"value": sent}), 4)(iter([batch] * 2))
    exact = {"a": [(1500000, "n%04d" % i) for i in range(0, 3000, 4)], "b": [(666667, "n%04d" % i) for i in range(3000) if i % 4 > 1]}
    for own in "ab":
        best = sorted(sorted(exact[own] * 2, key=lambda x: (-x[0], x[1]))[:8])
        assert sorted((round(r["score"] * 1e6), r["other"]) for r in got.to_pylist() if r["name"] == own) == best


def test_related_skills_with_several_labels_move_no_texts(spark, tmp_path, monkeypatch):
    folder, con = documents(spark, tmp_path, [(i, " ".join(f"w{(i * j) % 37}" for j in range(20)), "en", f"src{i % 2}") for i in range(80, 300)])
    labels = [(i, i % 2, 0) for i in range(5000)] + [(100, 1, 1), (101, 0, 0), (101, 1, 0), (None, 1, 1), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    plans, real = [], skills.written
    monkeypatch.setattr(skills, "written", lambda df: plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")) or real(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        same_rows(registry.queries()["s3_related"](spark, folder), con, registry.oracle_sql()["s3_related"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", "".join(plans))
    assert moved and not any(re.search(r"\b(text|description|t)#", x) for x in moved)


def test_words_of_texts_cut_in_slices(monkeypatch):
    monkeypatch.setattr(skills, "TEXT_BYTES", 9)
    texts = ["ab", "", "cd e", None, "--", "\u00e9f\u00e9g", "a+ #1", "", "long words in one text"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"]).slice(1)
    got = [[] for _ in range(batch.num_rows)]
    begun = 0
    for part, held, row in skills._cut(batch, 0):
        for word, i in zip(held.to_pylist(), row.tolist(), strict=True):
            got[begun + i].append(word)
        begun += part.num_rows
    assert begun == batch.num_rows and got == [[w for w in re.split(skills.WORDS, t or "") if w] for t in texts[1:]]
