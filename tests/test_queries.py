import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.operators import chunking, ranking
from quillspark.operators.chunking import chunk_documents, clean_glyphs, normalise_space, pack, reflow
from quillspark.operators.wordcounts import counted_rows, with_totals
from quillspark.plans import retrieval
from quillspark.sources import files
from quillspark.sources.scratch import written
from tests.oracle import connect, same_rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    same_rows(registry.queries()[name](spark, SMALL), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_agree_with_themselves(spark, name):
    once, again = ([str(r) for r in registry.queries()[name](spark, SMALL).collect()] for _ in range(2))
    assert once and sorted(once) == sorted(again)


@pytest.fixture(scope="module")
def lists(spark):
    """Two rankings with many ties, a third of all rows under one item, and items that only one of them has."""
    rng = random.Random(3)
    keyword = [(i % 3 if i % 2 else 0, d, float(rng.randint(0, 400))) for i in range(2) for d in range(700)] + [(7, d, 1.0) for d in range(5)]
    keyword = list({(i, d): (i, d, x) for i, d, x in keyword}.values())
    vector = [(i, d, rng.randint(0, 50) / 50) for i in (0, 9) for d in range(300, 900)]
    return [spark.createDataFrame(x, "item_id long, doc_id long, score double") for x in (keyword, vector)]


def brute_ranks(rows):
    out, seen = {}, {}
    for item, doc, _ in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        seen[item] = seen.get(item, 0) + 1
        out[item, doc] = seen[item]
    return out


def test_counted_ranks_equal_sorted_ones(spark, lists):
    ranks = brute_ranks([tuple(r) for r in lists[0].collect()])
    wanted = [k for k in ranks if k[1] % 37 == 0]
    got = ranking.counted_ranks(lists[0], spark.createDataFrame(wanted, "item_id long, doc_id long")).collect()
    assert {(r.item_id, r.doc_id): r.rnk for r in got} == {k: ranks[k] for k in wanted}


@pytest.mark.parametrize("k", [1, 3, 10])
def test_fusion_of_heads_equals_fusion_of_all(lists, k):
    a, b = (brute_ranks([tuple(r) for r in x.collect()]) for x in lists)
    fused = {}
    for key in a.keys() | b.keys():
        score = math.floor((1 / (60 + a[key] if key in a else math.inf) + 1 / (60 + b[key] if key in b else math.inf)) * 1e6 + 0.5) / 1e6
        fused.setdefault(key[0], []).append((-score, a.get(key, math.inf), b.get(key, math.inf), key[1]))
    wanted = {(i, x[3], n + 1) for i, rows in fused.items() for n, x in enumerate(sorted(rows)[:k])}
    assert {(r.item_id, r.doc_id, r.rnk) for r in ranking.fused_top(*lists, k).collect()} == wanted


@pytest.mark.parametrize("name", ["s1_hybrid_all", "s1_hybrid", "s1_rrf", "s1_three_modes"])
def test_fusion_writes_no_list_of_all_vectors(spark, tmp_path, monkeypatch, name):
    """Heads and counts are enough; vectors with many ties, a text without a hit, documents without a vector and the reverse."""
    rng, words = random.Random(4), [f"w{i}" for i in range(40)]
    tables = {
        "documents": ([(d, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for d in range(150, 600)], "doc_id long, text string"),
        "benchmark": ([(i, " ".join(rng.sample(words, 3))) for i in range(4)] + [(4, "nowhere"), (50, "w1 w2")], "item_id long, text string"),
        "embeddings": ([(v, [float(rng.randint(0, 1)) for _ in range(4)]) for v in range(700)], "vec_id long, embedding array<float>"),
    }
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    asked, real = [], retrieval.similarities
    monkeypatch.setattr(retrieval, "similarities", lambda spark, sf_dir, k=None, *more: asked.append(k) or real(spark, sf_dir, k, *more))
    monkeypatch.setattr(ranking, "ITEMS_AT_ONCE", 2)
    same_rows(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name])
    assert asked and None not in asked


def test_sorted_ranks_of_hot_groups(spark):
    rows = [(None if i % 3 == 0 else "abc"[i % 2], i * 7919 % 1000, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    order = [F.desc("x"), F.asc("id")]
    everywhere = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert [r.id for r in sorted(ranking.sorted_ranks(df, order).collect(), key=lambda r: r.rnk)] == [r[2] for r in everywhere]
    got = {r.id: r.rnk for r in ranking.sorted_ranks(df, order, group="g").collect()}
    for g in (None, "a", "b"):
        assert [got[r[2]] for r in everywhere if r[0] == g] == list(range(1, sum(r[0] == g for r in rows) + 1))
    assert ranking.sorted_ranks(df.limit(0), order).count() == 0


def test_blocks_answer_every_query_once(spark):
    data = spark.range(50)
    answer = lambda block: data.join(block, F.col("id") == F.col("q"))
    got = ranking.in_blocks(spark.range(40).withColumnRenamed("id", "q"), F.lit(8), answer, limit=64)
    assert sorted(r.q for r in got.collect()) == list(range(40))


def test_reflow_joins_lines_and_drops_page_marks(spark):
    text = "Intro\nThis line has more words than any heading, so it goes\non here.\nPage 3 of 9\n- one\n2) two\n\nLast"
    row = spark.createDataFrame([(text,)], "t string").select(reflow(F.col("t")).alias("p")).first()
    assert row.p == ["Intro", "This line has more words than any heading, so it goes on here.", "- one", "- two", "Last"]


def test_clean_and_normalise(spark):
    row = spark.createDataFrame([("ﬁne “x”\r\n  a \t b \n\n\n\nc",)], "t string").select(normalise_space(clean_glyphs(F.col("t"))).alias("t")).first()
    assert row.t == 'fine "x"\na b\n\nc'


def test_pack_overlaps_and_folds_the_runt(spark):
    parts = ["a" * 100, "b" * 100, "c" * 30]
    row = spark.createDataFrame([(parts,)], "p array<string>").select(pack(F.col("p"), 150, 20).alias("c")).first()
    assert [c.text for c in row.c] == ["a" * 100, "a" * 20 + "\n\n" + "b" * 100 + "\n\n" + "b" * 20 + "\n\n" + "c" * 30] or len(row.c) == 2
    with pytest.raises(ValueError):
        pack(F.col("p"), 100, 10)


def test_chunks_stay_within_bounds(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert chunk_documents(docs).agg(F.max(F.col("chars") - F.col("overlap_chars"))).first()[0] <= 800 + 120


def brute_reflow(text):
    done, cur, prev = [], "", ""
    for raw in text.split("\n"):
        line = raw.strip(" ")
        if not line:
            done, cur, prev = done + [cur] * bool(cur), "", ""
        elif re.search(chunking.PAGE_NOISE, line, re.ASCII):
            prev = ""
        else:
            bullet = re.search(chunking.BULLET, raw, re.ASCII)
            ended = prev and (re.search(chunking.TERMINAL, prev) or (len(prev) <= 60 and len(re.split(r"\s+", prev, flags=re.ASCII)) <= 9))
            shown = re.sub(chunking.BULLET, "- ", line, flags=re.ASCII) if bullet else line
            if not cur or bullet or (ended and re.match(r"\S", raw, re.ASCII)):
                done, cur = done + [cur] * bool(cur), shown
            else:
                cur += " " + line
            prev = line
    return done + [cur] * bool(cur)


def brute_chunks(text, size=800, overlap=150):
    units = []
    for p in brute_reflow(text):
        if len(p) <= size:
            units.append(p)
            continue
        cur, pattern = "", rf"(?s)\s*(.{{1,{size}}}$|.{{{size // 2},{size - 1}}}(?= )|.{{1,{size}}})"
        for piece in (x.strip(" ") for sentence in re.split(r"(?<=[.!?])\s+", p, flags=re.ASCII) for x in re.findall(pattern, sentence.strip(" "), re.ASCII)):
            if piece and cur and len(cur) + 1 + len(piece) <= size:
                cur += " " + piece
            elif piece:
                units, cur = units + [cur] * bool(cur), piece
        units += [cur] * bool(cur)
    packs, used = [], 0
    for u in units:
        if packs and used + len(u) + 2 <= size:
            packs[-1].append(u)
            used += len(u) + 2
        else:
            used = len(u) + 2 * bool(packs)  # the separator counts though the unit opens a chunk
            packs.append([u])
    chunks = []
    for own in packs:
        before = chunks[-1][0] if chunks else ""
        tail = before[-overlap:] if len(before) > overlap else ""
        if 0 <= tail.find(" ") < 40:
            tail = tail[tail.find(" ") + 1 :]
        body = "\n\n".join(own)
        chunks.append((f"{tail}\n\n{body}" if tail else body, len(tail) + 2 if tail else 0, len(own)))
    if len(chunks) > 1 and len(chunks[-1][0]) < 120:
        (a, o, n), (b, _, m) = chunks[-2:]
        chunks[-2:] = [(f"{a}\n\n{b}", o, n + m)]
    return chunks


def test_chunks_equal_brute_force(spark):
    """The fold inside the JVM against a plain loop, over whole texts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", clean_glyphs(F.coalesce("text", F.lit(""))).alias("text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got: dict = {}
    for r in chunk_documents(docs).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.overlap_chars, r.paragraphs))
    assert got == {i: c for i, t in texts.items() if (c := brute_chunks(t))}
    flowed = docs.select("doc_id", reflow(F.col("text")).alias("p")).collect()
    assert all(r.p == brute_reflow(texts[r.doc_id]) for r in flowed)


def test_chunk_offsets_point_into_the_text(spark):
    paras = [f"Paragraph {i} says {'word ' * (30 + 11 * i)}at its end." for i in range(9)] + ["Paragraph 1 says it again."]
    rows = chunk_documents(spark.createDataFrame([(1, "\n\n".join(paras))], "doc_id long, text string"), 300, 60, offsets=True).orderBy("idx").collect()
    whole = "\n\n".join(" ".join(p.split()) for p in paras)
    assert len(rows) > 4 and rows[0].char_start == 0 and rows[-1].char_end == len(whole)
    for a, b in zip(rows, rows[1:]):
        assert a.char_end <= b.char_start <= a.char_end + 2
        if b is not rows[-1]:  # into the last one a runt is folded, overlap and all
            assert whole[b.char_start : b.char_end].split() == b.text[b.overlap_chars :].split()


def test_case_files(spark, tmp_path):
    head = ",".join(files.CASE_COLUMNS)
    good = tmp_path / "good.csv"
    good.write_text("﻿" + head + "\nTest, TC-1 ,S,D,High,C,L,API,P,1. a | 2. b,E,B,V,Ready\n", encoding="utf-8")
    row = files.read_cases(spark, str(good)).select("`Issue Key`", files.steps_of().alias("steps")).first()
    assert row["Issue Key"] == "TC-1" and row.steps == ["a", "b"]
    (tmp_path / "bad.csv").write_text("Summary\nx\n")
    with pytest.raises(ValueError, match="columns missing"):
        files.read_cases(spark, str(tmp_path / "bad.csv"))


@pytest.mark.parametrize("text", ['[{"id":"1","status":"odd"}]', '{"jobs":[{"id":"1","status":"odd"}]}'])
def test_jobs_from_json(spark, tmp_path, text):
    (tmp_path / "j.json").write_text(text)
    assert [(r.id, r.status) for r in files.read_jobs(spark, str(tmp_path / "j.json")).collect()] == [("1", "wishlist")]


def test_markdown_export_and_vectors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "SKILL.md").write_text("---\nname: demo\ndescription: >\n  first\n  second\nmetadata:\n  pack: x\n---\n# Demo\nBody")
    row = files.read_markdown(spark, str(tmp_path)).first()
    assert row.front == {"name": "demo", "description": "first second", "pack": "x"} and row.body.startswith("# Demo")
    df = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id long, name string")
    out = files.export(df, str(tmp_path), "../x y", "csv", 3)
    assert spark.read.option("header", True).csv(out).count() == 3 and out.endswith("/_x_y")
    files.put_vectors(spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>"), f"{tmp_path}/v", 2)
    assert spark.read.parquet(f"{tmp_path}/v").count() == 1
    merged = files.upsert(df, spark.createDataFrame([(1, "new"), (9, "nine")], "id long, name string"), "id")
    assert {r.id: r.name for r in merged.collect()}[1] == "new" and merged.count() == 6


def test_optional_tables_envelopes_and_domains(spark, tmp_path):
    assert files.read_or_empty(spark, f"{tmp_path}/none.csv", "a string, b int").columns == ["a", "b"]
    (tmp_path / "there.csv").write_text("a,b\nx,1\n")
    assert files.read_or_empty(spark, f"{tmp_path}/there.csv", "a string, b int").first().b == 1
    texts = [('[{"id":"1"},{"id":"2"}]',), ('{"rows":[{"id":"3"}]}',), ('{"data":[{"id":"4"}],"rows":[{"id":"5"}]}',), ("odd",), (None,)]
    got = files.unwrap(spark.createDataFrame(texts, "t string"), "t", ("data", "rows"), "struct<id:string>")
    assert sorted(r.id for r in got.collect()) == ["1", "2", "3", "4"]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "id long, name string")
    assert files.checked_values(df, "name", ["a"]) == ["a"]
    with pytest.raises(ValueError, match="known: a, b"):
        files.checked_values(df, "name", ["a", "c"])
    assert [r.id for r in files.delete_keys(df, df.where("id = 2"), "id").collect()] == [1]


def test_siblings_of_skill_files(spark, tmp_path):
    for path in ("a/SKILL.md", "a/x.txt", "a/deep/y.txt", "b/SKILL.md", "z.txt"):
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text("x")
    got = {r.path.rsplit("/", 2)[1]: r.extra_files for r in files.siblings(spark, str(tmp_path)).collect()}
    assert got == {"a": ["deep/y.txt", "x.txt"], "b": []}


@pytest.mark.parametrize("name", ["s1_chunks", "s1_chunk_offsets", "s1_chunk_summary"])
def test_chunks_are_cut_once(spark, name):
    """No filter asks for the chunks' number before they are exploded, which would cut each text again."""
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan()
    assert not re.search(r"Filter .*aggregate\(", plan.toString())


@pytest.mark.parametrize("name", ["s1_bm25_terms", "s1_bm25_breakdown", "s1_context_pack"])
def test_what_a_word_adds_is_not_shuffled(spark, name):
    """Scores are added up where a document's words are: no row of query, document and word, and no text, is moved."""
    found = registry.queries()[name](spark, SMALL)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (\w+)", plan)
    assert moved and not [x for x, how in moved if how == "hashpartitioning" and (re.search(r"item_id#.*tok#|\bw#", x) or "text#" in x)]


def test_log_fields_are_taken_out_of_the_row_once(spark):
    plan = registry.queries()["s4_entity_logs"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("element_at(row") < 80


@pytest.mark.parametrize("name", ["s1_tf_df", "s1_missing_terms"])
def test_words_are_counted_where_a_document_is(spark, name):
    found = registry.queries()[name](spark, SMALL)
    assert not re.search(r"Exchange hashpartitioning\((tok#\d+, )?doc_id#", found._jdf.queryExecution().executedPlan().toString())
    same_rows(found, connect(SMALL), registry.oracle_sql()[name])


@pytest.mark.parametrize("frequent", [0, 1, 3, 100])
def test_word_counts_equal_plain_ones(spark, frequent):
    rows = [(1, list("abab")), (2, list("ba")), (2, list("bc")), (None, ["a", ""]), (None, ["", ""]), (3, []), (4, None), (5, list("aaad"))]
    counts, df = Counter((k, w) for k, words in rows for w in words or []), Counter()
    df.update(w for _, w in counts)
    for given in (rows, rows[:2]):
        wanted = counts if given is rows else Counter((k, w) for k, words in given for w in words)
        total = df if given is rows else Counter(w for _, w in wanted)
        found = with_totals(written(counted_rows(spark.createDataFrame(given, "k long, t array<string>"), "k", "t")), frequent)
        assert Counter((r.k, r.tok, r.tf, r.df) for r in found.collect()) == Counter((k, w, n, total[w]) for (k, w), n in wanted.items())


@pytest.mark.parametrize("name", ["s4_entity_services", "s4_entity_summary"])
def test_service_fields_are_taken_out_of_the_row_once(spark, name):
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("element_at(row") < 80
