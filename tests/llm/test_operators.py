"""Every operator against a brute-force version or SQL, and on nulls, empty texts, repeats, ties and empty tables."""

from __future__ import annotations

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat, components, decontam, langid, licenses, linededup, mixing, quality, registry, simhash, substrings, urlrank
from tests.oracle import connect, same_rows

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id at all here"), (4, "x " * 3000), (5, "\x00 zero \U0001f600 byte " * 9), (6, "a\n\n\nb\n" * 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use themselves."""
    frame = spark.createDataFrame(ODD, "doc_id long, text string")
    return frame.select("*", *[F.lit("s").alias(c) for c in ("source", "lang", "size", "id", "words", "html", "h", "key")], F.lit(1).cast("long").alias("n_chars"))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_equals_its_sql(spark, name):
    same_rows(registry.queries()[name](spark, SMALL), connect(SMALL), registry.oracle_sql()[name])


def brute_fingerprint(text: str | None) -> int:
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict) -> dict:
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("pieces", [3, 4, 5, 6])
def test_simhash(spark, docs, pieces):
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    got = simhash.near_duplicates(docs, pieces=pieces).collect()
    assert {r.id: r.fp & (1 << 64) - 1 for r in got} == prints
    assert {r.id: r.component_id for r in got} == brute_components(prints)


def test_simhash_links_every_near_fingerprint(spark):
    import random  # noqa: PLC0415

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    got = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    group = {r.fp & (1 << 64) - 1: r.component for r in got}
    own = brute_components({x: x for x in near})
    for x in near:
        for y in near:
            assert (own[x] == own[y]) == (x == y or group.get(x, x) == group.get(y, y))


def test_signature_variants_are_not_broadcast(spark, monkeypatch):
    """Variants exploded out of a small file are many times its size, which Spark does not see."""
    plans, real, writes = [], simhash.connected_components, simhash.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "connected_components", lambda links, **kw: plans.append(plan(links)) or real(links, **kw))
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(plan(df)) or writes(df))
    simhash.link_fingerprints(writes(spark.range(300).select(F.xxhash64("id").alias("fp"))), pieces=3)
    texts = writes(spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g h "), F.col("id")).alias("text")))
    simhash.similar_documents(texts)
    met = [line for p in plans for line in p.splitlines() if re.search(r"Join .*NOT \(ca#", line)]
    assert len(met) >= 2 and all("SortMergeJoin" in x for x in met)


def brute_similar(texts: dict) -> dict:
    """Smallest id reachable over pairs of a Jaccard similarity of 0.8, near by bits, with an anchor and its segment but for one bit in common."""
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    prints = {i: [int(x) for x in simhash.wide_fingerprint(simhash.shingle_set(t))] for i, t in texts.items()}
    least = {i: simhash.anchors(simhash.shingle_set(t)).tolist() for i, t in texts.items()}
    bits, own = simhash.SEGMENT, simhash.PER_WORD
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            other = [x ^ y for x, y in zip(prints[i], prints[j], strict=True)]
            alike = sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike and sum(x.bit_count() for x in other) <= simhash.WIDE_DISTANCE and any(least[i][k] == least[j][k] and (other[k // own] >> bits * (k % own) & (1 << bits) - 1).bit_count() <= 1 for k in range(len(least[i]))):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_similar_documents(spark, docs):
    """Links equal brute force; copies with one word in 60 or so changed are caught, other texts are left alone."""
    import random  # noqa: PLC0415

    rng = random.Random(3)
    texts = {r.doc_id: r.text for r in docs.limit(120).collect()}
    for i in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        texts[1000 + 2 * i] = " ".join(words)
        for j in rng.sample(range(200), 3):
            words[j] = "changed"
        texts[1001 + 2 * i] = " ".join(words)
    got = {r.id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_similar({i: (t or "").encode() for i, t in texts.items()})
    assert sum(got[1001 + 2 * i] == 1000 + 2 * i for i in range(60)) >= 55
    assert len({got[1000 + 2 * i] for i in range(60)}) == 60
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 101)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert components.connected_components(links.limit(0)).count() == 0


def test_substrings(spark, docs, odd):
    for frame in (docs, odd.where("doc_id is not null")):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(frame).collect()]
        assert sorted(got) == sorted(substrings.brute_force(rows))
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [True, False])
def test_substrings_around_a_common_passage(spark, docs, monkeypatch, hot):
    """A passage in a third of all texts, its surroundings all different, by either way."""
    if hot:
        monkeypatch.setattr(substrings, "SAMPLE", 1)
        monkeypatch.setattr(substrings, "HOT", 5)
        monkeypatch.setattr(substrings, "HOT_SHARE", 0)
    passage = "This very common passage of more than fifty bytes stands in a third of all documents. " * 2
    rows = [(r.doc_id, (f"{r.doc_id}{passage}{r.doc_id % 7}" + (r.text or "")) if r.doc_id % 3 == 0 else r.text) for r in docs.collect()]
    rows += [(1000 + i, passage + "x" * i) for i in range(8)] + [(2000, passage[:60]), (2001, passage[7:56]), (None, passage[3:99])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    if hot:
        assert len(substrings._hot_anchors(substrings._source(frame, "doc_id", "text"), 500)) > 3
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(frame).collect()]
    wanted = substrings.brute_force([(1 << 62 if i is None else i, t) for i, t in rows])
    assert sorted(got, key=str) == sorted([(None if i == 1 << 62 else i, *rest) for i, *rest in wanted], key=str)


def brute_lines(rows, k=8, least=10):
    lines = [(i, n, x.strip(" ")) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= least]
    forms = sorted({x for *_, x in lines})
    root = list(range(len(forms)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(forms)):
        for j in range(i):
            if min(len(forms[i]), len(forms[j])) >= 0.5 * max(len(forms[i]), len(forms[j])) and linededup.jaccard(forms[i], forms[j], k) >= 0.8:
                root[find(i)] = find(j)
    first: dict = {}
    for i, n, x in lines:
        key = find(forms.index(x))
        first[key] = min(first.get(key, (i, n)), (i, n))
    return {(i, n) for i, n, x in lines if first[find(forms.index(x))] != (i, n)}


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the very big bear"
    texts = [base, base + "s", "y" * 9 + "\n" + base.replace("quick", "quack"), "something else entirely is written here\n" + base, None, "", "short\nshort", base + "\nunique line of a document number six"]
    rows = list(enumerate(texts)) + [(20 + i, base[:60] + f" variant {i} " + base[60:]) for i in range(15)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    lost = brute_lines(rows)
    got = {(r.id, x.line_no) for r in linededup.removed_lines(frame).collect() for x in r.removed}
    assert got == lost
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(frame).collect()}
    for i, t in rows:
        assert kept[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in lost))


def test_line_dedup_finds_short_lines(spark, tmp_path):
    """Exact repeats of lines shorter than a shingle go; blank ones stay."""
    texts = ["}\n\n\t\n这是一个句子。\neight ch", "}\n\n\t\n}\n这是一个句子。", "eight ch\nother", "\u3000\n\u3000"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in linededup.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: "", 1: "0,3,4", 2: "0", 3: ""}


def test_language_id_on_held_out(spark, docs):
    found = langid.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 40").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_prototypes_count_copies_once(spark, docs):
    labelled = docs.select("text", "lang")
    copies = labelled.where("lang = 'de'").limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    (names, once), (again, many) = langid.train(labelled, "text", "lang"), langid.train(labelled.unionByName(copies), "text", "lang")
    assert names == again and (once == many).all()


def test_language_sample_is_not_thinned_by_copies(spark):
    texts = spark.range(60).select(F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    copies = spark.range(200_000).select(F.lit("zzz qqq").alias("text"), F.lit("en").alias("lang"))
    few = texts.unionByName(copies.limit(1))
    (_, once), (_, many) = langid.train(few, "text", "lang"), langid.train(texts.unionByName(copies), "text", "lang")
    assert once.shape == many.shape and (once == many).all()


def test_letters_have_vectors_of_their_own(monkeypatch):
    """e acute and k, n tilde and s, sharp s and a once had the same; a full cache changes nothing."""
    encoder = langid.Encoder()
    for x, y in ("ék", "ñs", "ßa"):
        assert abs(float(encoder.encode(x * 3) @ encoder.encode(y * 3))) < 0.5
    texts = ["first words here", "zweiter Satz für später", "这是一个句子", "first words here"]
    wanted = [encoder.encode(t) for t in texts]
    monkeypatch.setattr(langid, "CACHE", 20)
    monkeypatch.setattr(langid, "BLOCK", 8)
    small = langid.Encoder()
    assert all((small.encode(t) == w).all() for t, w in zip(texts, wanted, strict=True))


def test_decontamination_finds_short_items_in_long_texts(spark):
    item = " ".join(f"word{i}" for i in range(20))
    changed = item.replace("word10", "other")
    long = " ".join(f"filler{i} text{i}" for i in range(20000))
    docs = spark.createDataFrame([(1, long + " " + item.upper() + ". " + long), (2, long), (3, None), (4, changed), (5, "word1 word2"), (5, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "word1 word2"), (11, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()}
    assert got == {(1, 7), (1, 11), (5, 7), (5, 11), (5, 10)}
    assert decontam.find_contamination(docs.limit(0), items).count() == 0
    assert decontam.find_contamination(docs, items.limit(0)).count() == 0


def test_decontamination_finds_items_of_few_words(spark):
    """Items of 5 to 8 words, and one that repeats itself, each in a long text of its own."""
    items = [(i, " ".join(f"item{i}word{j}" for j in range(5 + i % 4))) for i in range(200)] + [(200, "one two three four five six " * 9)]
    docs = [(i, " ".join([f"before{i}x{j}" for j in range(300)] + [text] + [f"after{i}x{j}" for j in range(300)])) for i, text in items]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(*frames).collect()}
    assert got == {(i, i) for i, _ in items}


def test_license_scan(spark, odd):
    text = "See the MIT license. Licensed under the Apache License, Version 2.0! GNU General Public License and mit license"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under a CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r.id: r for r in licenses.scan(docs).collect()}
    assert [p.at for p in got[1].places] == [2, 7, 13, 17] and got[1].n_words == 19  # 2.0 is two words
    assert got[3].method_labels == ["cc-by-nc"] and got[2].n_words == 0
    assert "cc-by-nc" in got[4].method_labels
    assert licenses.scan(odd).count() == len(ODD)


def test_quality_rules(spark, odd):
    text = " ".join(["a b c"] * 20 + [f"w{i}" for i in range(60)])
    row = quality.counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 120 and row.n_repeat_words == 60
    assert quality.judge(odd).count() == len(ODD) and not any(r.kept for r in quality.judge(odd).where("n_words < 50").collect())
    every = list(quality.RULES)
    a, b = (quality.cascade(quality.RULES, o) for o in (every, every[::-1]))
    assert quality.counts(odd).where(a != b).count() == 0


def test_mixing(spark, docs, odd):
    rows = mixing.mix(docs).collect()
    by_source: dict = {}
    for r in rows:
        got = by_source.setdefault(r.source, [r.target, 0, 0])
        got[1] += r.taken
        got[2] = max(got[2], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken - target) <= largest for target, taken, largest in by_source.values())
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["https://a.example.org/es/x", "http://Example.ORG/en/12?q", "http://x.com/fr/1", "http://x.com/de/#f", None, "no scheme", "http://good.net/a", "http://bad.net/a", "s://org"]
    pages = spark.createDataFrame([(i, u, '<a href="http://y.com/de/1">' if u and "bad" in u else '<a href="/x">') for i, u in enumerate([*urls, "http://y.com/de/2"])], "page_id long, url string, html string")
    got = {r.page_id: r for r in urlrank.judge_urls(pages).collect()}
    assert [got[i].rule for i in range(4)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
    assert [got[i].verdict for i in range(4)] == ["block", "block", "allow", "block"]
    assert (got[1].host, got[1].path) == ("example.org", "/en/12") and (got[4].host, got[5].path) == ("", "")
    assert got[6].verdict == "allow" and got[7].verdict == "block" and got[8].verdict == "allow" and got[8].rule is None
    assert urlrank.judge_urls(pages.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\0 <s>[INST] \\2]"), (1, 1, "assistant", "</s>[/REPLY] \\1"), (2, 0, "tool [x]", "t"), (2, None, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = {r.conv_id: r for r in chat.format_conversations(turns).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1].back] == [("user", rows[0][3]), ("assistant", rows[1][3])] and out[1].valid
    assert [tuple(t) for t in out[2].back] == [("", ""), ("tool [x]", "t")] and not out[2].valid
    assert out[3].n_turns == 2 and not out[3].valid
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_stages_take_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SMALL)
        got.collect()
        if name != "mixing":
            assert got.columns == odd.columns
        assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_stages_drop_rows_not_ids(spark):
    """Of rows that share an id, or have none, only the contaminated or duplicate one goes."""
    item = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect() if r.text and len(r.text.split()) > 8)
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(None, item), (None, a), (1, item), (1, b), (2, c), (2, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontam.stage(spark, frame, SMALL).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (1, b), (2, c), (2, c)], key=str)
    rows = [(5, a), (5, b), (5, b), (6, b), (3, c), (5, c), (None, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    got = [(r.doc_id, r.text) for r in simhash.stage(spark, frame, SMALL).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (5, b), (3, c), (None, a)], key=str)


def test_pipeline_is_repeatable_and_keeps_one_of_each_group(spark, docs):
    once, again = (sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) for _ in range(2))
    assert once == again and len(once) == len(set(once))
    deduped = simhash.stage(spark, docs, SMALL)
    own = brute_similar({r.doc_id: (r.text or "").encode() for r in docs.collect()})
    assert sorted(r.doc_id for r in deduped.collect()) == sorted(set(own.values()))


def test_lines_of_rows_that_share_an_id(spark, tmp_path):
    """Rows without an id, or with the same one, lose only lines of their own."""
    line = "a line that several documents have in common, long enough to compare"
    texts = [(None, line), (None, "first\n" + line + "\nthird " + line[:40]), (7, line + "\nown words of this row"), (7, "head\n" + line), (8, line)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.removed) for r in linededup.op7_line_dedup(spark, str(tmp_path)).collect())
    kept = [g for g in got if g[2] == 0]
    assert len(kept) == 1 and kept[0][0] == "None"  # one copy of the line stays, with a row that has no id
    assert {g[1]: g[3] for g in got if g[0] == "7"} == {2: "0"} or sorted(g[3] for g in got if g[0] == "7") == ["0", "1"]
    assert all(g[2] == len(list(filter(None, g[3].split(",")))) and all(int(x) < g[1] for x in filter(None, g[3].split(","))) for g in got)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    left = [r.text for r in linededup.dedup_lines(frame).collect()]
    assert sum(t.split("\n").count(line) for t in left) == 1


def test_mixing_of_a_source_without_ids(spark):
    rows = [(None, f"word{i} " * 100, "a") for i in range(40)] + [(i, "x " * 100, "b") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copies": F.lit("s"), "taken": F.lit("t"), "_digest": F.lit("u")})
    got = mixing.mix(frame).where("source = 'a'").agg(F.sum("taken"), F.max("target")).first()
    assert abs(got[0] - got[1]) <= 100 and got[0] > 0
    staged = mixing.stage(spark, frame, SMALL)
    assert sorted(staged.columns) == sorted(frame.columns) and staged.where("copies > 0").count() == staged.count()


def test_repeats_in_texts_beyond_packed_positions(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * j * j) % 23}" for j in range(10 + 9 * i))) for i in range(12)] + [(99, "a b c a b c a b c"), (98, "a")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    usual = {r.doc_id: r.n_repeat_words for r in quality.counts(frame).collect()}
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    assert {r.doc_id: r.n_repeat_words for r in quality.counts(frame).collect()} == usual and usual[99] == 9


def brute_spans(text):
    """(label, first, last, score) of the spans that win, by plain loops over every diagonal."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, k, spans = cut(text), licenses.K, []
    places: dict = {}
    for i in range(len(words) - k + 1):
        places.setdefault(tuple(words[i : i + k]), []).append(i)
    for t, (label, notice) in enumerate(licenses.TEMPLATES):
        own = cut(notice)
        hits = [(pos - at, at, pos) for at in range(len(own) - k + 1) for pos in places.get(tuple(own[at : at + k]), ())]
        for d in {h[0] for h in hits}:
            near = [h for h in hits if d <= h[0] <= d + max(len(own) // licenses.SLACK, licenses.LEAST_SLACK)]
            ats = {h[1] for h in near}
            score = len({a + j for a in ats for j in range(k)}) / len(own)
            if score >= licenses.COVER:
                spans.append((len(ats) / (len(own) - k + 1), len(own), -t, d, label, score, min(h[2] for h in near), max(h[2] for h in near) + k - 1))
    best: dict = {}
    for s in spans:
        for w in range(s[6], s[7] + 1):
            best[w] = max(best.get(w, s), s)
    own = {s: sum(b == s for b in best.values()) for s in spans}
    return {(s[4], s[6], s[7], round(s[5], 9)) for s in spans if 2 * own[s] >= s[7] - s[6] + 1}


PROBES = {
    "Licensed under CC BY-SA 4.0.": {"cc-by-sa"},
    "Licensed under CC BY-NC-SA 4.0.": {"cc-by-nc-sa"},
    "Licensed under CC BY-NC 4.0. and more. Licensed under CC BY 4.0.": {"cc-by-nc", "cc-by"},
    " x y z ".join(" ".join(licenses.TEMPLATES[1][1].split()[i : i + 3]) for i in range(0, 18, 3)): set(),
    licenses.TEMPLATES[19][1].replace("Permission", "(c) 2020 A. Author\n\n Permission").replace("persons", "people"): {"mit"},
    licenses.TEMPLATES[24][1]: {"lgpl"},
    licenses.TEMPLATES[23][1] + " And. " + licenses.TEMPLATES[21][1]: {"gpl", "bsd"},
    "Permission is hereby granted, free of charge, to any person": set(),
}


def test_license_labels_are_true(spark):
    texts = list(PROBES)
    half = licenses.TEMPLATES[1][1].split()
    rows = [*enumerate(texts), (None, " ".join(half[:9])), (None, " ".join(half[9:])), (None, texts[0]), (0, "a text that shares the id of another"), (50, None), (51, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("s"), "template": F.lit(1), "score": F.lit("x")})
    got = [(r.id, r.n_words, set(r.method_labels)) for r in licenses.scan(frame).collect()]
    wanted = [(i, t, PROBES.get(t, set())) for i, t in rows]
    assert sorted((str(i), sorted(x)) for i, _, x in got) == sorted((str(i), sorted(x)) for i, _, x in wanted)


def test_license_spans_equal_brute_force(spark, docs):
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(PROBES)], "doc_id long, text string"))
    got: dict = {}
    for r in licenses.notice_spans(some).collect():
        got.setdefault(r.id, set()).add((r.label, r.first_word, r.last_word, round(r.score, 9)))
    wanted = {r.doc_id: s for r in some.collect() if (s := brute_spans(r.text))}
    assert got == wanted and len(wanted) > 5


def test_recall_of_similar_documents(spark):
    """Of pairs whose similarity is a little over 0.8, nearly all are linked; texts that share a passage only are not."""
    import random  # noqa: PLC0415

    rng, rows, alike = random.Random(11), [], []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows.append((2 * i, " ".join(words)))
        for _ in range(8):  # about forty shingles of 396 change
            words[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(words)))
        a, b = ({*zip(*(t.split()[k:] for k in range(5)), strict=False)} for _, t in rows[-2:])
        alike.append(len(a & b) / len(a | b))
    passage = " ".join(f"p{k}" for k in range(120))
    rows += [(10_000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(200))) for i in range(200)]
    got = {r.id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    over = [i for i, x in enumerate(alike) if x >= 0.8]
    assert len(over) > 100 and min(alike[i] for i in over) < 0.82
    assert sum(got[2 * i] == got[2 * i + 1] for i in over) >= 0.95 * len(over)
    assert not any(got[2 * i] == got[2 * i + 1] for i, x in enumerate(alike) if x < 0.8)
    assert all(got[10_000 + i] == 10_000 + i for i in range(200))


def test_language_stage_leaves_other_columns_alone(spark, docs):
    """Columns with the names of the prediction's own stay what they were."""
    frame = docs.limit(40).withColumns({"score": F.lit("s"), "lang_pred": F.lit("p"), "_judged": F.lit("j"), "row": F.lit("r")}).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = langid.stage(spark, frame, SMALL)
    assert got.columns == frame.columns
    rows = got.collect()
    assert rows and all((r.score, r.lang_pred, r._judged, r.row) == ("s", "p", "j", "r") and r.lang for r in rows)
