"""Hard negatives, personal data and resampling against brute force, and on nulls, odd rows, ties and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives, pii, registry, resample

CLASHES = ("row", "block", "place", "weight", "kind", "spans", "seen", "q", "score", "rank", "_text", "_none", "n", "bucket")


def clashing(frame):
    """The frame with further columns whose names the operators use themselves."""
    return frame.select("*", *[F.lit("s").alias(c) for c in CLASHES if c not in frame.columns])


# hard negatives


def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def mined(frame, **how):
    rows = negatives.prepare(frame, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0)
    return sorted(map(tuple, negatives.hard_negatives(rows, **how).collect()), key=repr)


def brute_negatives(rows, k=5):
    known = []
    for vec_id, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.append((vec_id, [max(-(1 << 20), min(1 << 20, math.floor(256 * x))) for x in v], label))
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    last = lambda i: (i is None, i or 0)
    found = []
    for i, (anchor, v, label) in enumerate(known):
        if anchor is None or anchor % 10:
            continue
        scored = [(product(v, w), other, its) for j, (other, w, its) in enumerate(known) if j != i]
        order = sorted(scored, key=lambda s: (-s[0], last(s[1])))
        for p, positive, _ in [s for s in order if s[2] == label][:k]:
            fits = [s for s in order if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:k]
            found += [(anchor, positive, r + 1, n, p, s) for r, (s, n, _) in enumerate(fits)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("at_once", [(4096, 512), (7, 3)])
def test_hard_negatives(spark, monkeypatch, at_once):
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", at_once[0])
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", at_once[1])
    rng = random.Random(3)
    centre = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(3)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in centre[rng.randrange(3)]], rng.randrange(3)) for i in range(120)]
    rows += [(200 + i, rows[20][1], i % 3) for i in range(9)]  # ties
    rows += [(None, rows[20][1], 1), (None, rows[20][1], 2), (20, rows[20][1], 1)]  # no id, and an anchor's id again
    rows += [(300, None, 1), (301, [1.0] * 12, None), (310, [float("nan")] * 12, 1), (302, [float("inf")] + [0.0] * 11, 1), (303, [None] * 12, 1)]
    rows += [(320, [0.0] * 12, 2), (330, [1e9] * 12, 1), (340, [-1e9] * 12, 0), (350, [0.5] * 3, 1), (360, [], 2)]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)


def test_anchors_in_many_blocks_and_empty_tables(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(1, 1) for _ in range(6)], i % 2) for i in range(80)]
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 60)
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(1, None, None)])) == []


def test_products_drop_pairs_early_and_exactly():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-200, 200, (40, 16)), rng.integers(-200, 200, (300, 16))
    exact = q @ x.T
    least = int(np.quantile(exact, 0.97))
    asked = []

    def keep(i, j, low, high):
        asked.append(np.size(low))
        return high >= least

    i, j, score = negatives.products(q, x, keep)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == set(zip(*(k.tolist() for k in np.nonzero(exact >= least)), strict=True))
    assert (score == exact[i, j]).all()
    assert asked[-1] < asked[0] / 10  # most pairs were gone before the last plane


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(d) for d in digits[::-1]]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0
            fine = {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if fine[name]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_entities_equal_plain_patterns():
    rng = random.Random(1)
    pieces = ["a", "b.", "@", "@x.y", "_", "%", "1", "23", "255", "256", ".", "-", " ", "+", "(", ")", "4462312345", "4111 1111 1111 1111", "é"]
    for _ in range(30_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "+" * 300_000, "@" * 300_000, "a@" * 100_000, "1-" * 200_000, "(at)" * 50_000])
def test_long_texts_stay_linear(text):
    began = time.process_time()
    spans = pii.base_spans(text)
    list(pii._unknown(text, []))
    assert time.process_time() - began < 5
    assert len(spans) == (50_000 if text.startswith("1.") else 0)


def written_mail(user):
    return f"{user}(at)example(dot)org"


def corpus():
    rows = []
    for i in range(14):
        rows.append(f"please write to us at {'abcdefghijklmn'[i]}{i}@mail.example.com today")
        rows.append(f"the server answers on {10 + i}.0.{i}.7 since noon")
        rows.append(f"dial our number +1 (555) 010-{1000 + i} before noon")
    rows.append(f"please write to us at {written_mail('hidden')} today")  # no address by its pattern
    rows.append("dial our number 555 010 7788 before noon")  # no plus
    rows.append(f"a stray mention of {written_mail('hidden')} elsewhere")  # the same instance in another place
    rows.append("order 555 010 9911 left the yard")  # a number that no trusted pattern extracts
    rows.append("the build 20240101 has 123456789 lines")
    return rows


def test_contexts_of_seeds_find_what_the_patterns_miss(spark):
    rows = corpus()
    frame = clashing(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    got = {r.id: [(pii.KINDS[s.kind], rows[r.id][s.start : s.end]) for s in r.all_spans] for r in pii.find_private(frame).collect()}
    base = {i: [(pii.KINDS[k], t[s:e]) for k, s, e in brute_base(t)] for i, t in enumerate(rows)}
    learnt = {i: [x for x in got[i] if x not in base[i]] for i in got}
    n = len(rows)
    assert learnt == {i: [] for i in range(n - 5)} | {n - 5: [("email", written_mail("hidden"))], n - 4: [("phone", "555 010 7788")], n - 3: [("email", written_mail("hidden"))], n - 2: [], n - 1: []}
    assert all(set(base[i]) <= set(got[i]) for i in got)


def brute_trusted(edges, kinds):
    total, shares = len(kinds), Counter(kinds.values())
    by = {}
    for pattern, name in edges:
        by.setdefault(pattern, []).append(kinds[name])
    tested = max(1, sum(sum(k is not None for k in ks) > 1 for ks in by.values()))
    found = {}
    for pattern, ks in by.items():
        sure, n = sum(k is not None for k in ks), len(ks)
        for k in range(4):
            f, q = ks.count(k), shares.get(k, 0) / total
            if sure > 1 and f > 1 and q < 1 and f / n > q:
                p = f / n
                evidence = n * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0))
                trust = f / (sure + (n - sure) / 2 + 1)
                if trust >= pii.CONFIDENCE and evidence >= math.log(tested / pii.CHANCE):
                    found[pattern, k] = round(trust, 9)
    return found


def test_trusted_patterns_equal_brute_force(spark):
    rng = random.Random(2)
    kinds = {f"i{n}": rng.choice([0, 0, 1, 2, 3, None]) for n in range(300)}
    edges = {(f"p{(kinds[name] or 0) if rng.random() < 0.7 else rng.randrange(12)}", name) for name in kinds for _ in range(2)}
    known = spark.createDataFrame(list(kinds.items()), "instance string, kind int")
    got = pii.trusted_patterns(spark.createDataFrame(sorted(edges), "pattern string, instance string"), known)
    assert {(r.pattern, r.kind): round(r.trust, 9) for r in got.collect()} == brute_trusted(edges, kinds)
    assert brute_trusted(edges, kinds)


def test_personal_data_query_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in registry.queries()["op12_pii"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        spans, row = brute_base(d.text or ""), got[d.doc_id]
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == n for k, _, _ in spans) for n in range(4)]
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(row.spans.split(","))


def test_personal_data_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x@y.zz"), (3, "x@y.zz"), (None, "no id a@b.cc"), (None, None), (4, "\x00 \U0001f600 q@w.ee")]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.id), [tuple(s) for s in r.all_spans]) for r in pii.find_private(frame).collect())
    assert got == sorted([("1", []), ("2", []), ("3", [(0, 0, 6)]), ("3", [(0, 0, 6)]), ("None", [(0, 6, 12)]), ("None", []), ("4", [(0, 4, 10)])])
    assert pii.find_private(frame.where("false")).count() == 0


# resampling


def brute_resample(docs, target, percent=5, least=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = word.findall((text or "").translate(lower))
        return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))

    own, wanted = [features(t) for _, t in docs], [features(t)[1] for t in target]
    s, t = sum((c for _, c in own), Counter()), sum(wanted, Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    rows = []
    for (doc_id, _), (n, c) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append([doc_id, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: percent * sum(r[4] for r in rows) // 100]
    return sorted((tuple(r[:4]) for r in rows), key=repr), [(r[0], r[3]) for r in drawn]


def test_resample_on_odd_rows_and_small_blocks(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "BETA", "gamma3", "d", "é", "x" * 70, "中文"]) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(60)))) for i in range(90)]
    docs += [(5, docs[7][1]), (5, docs[7][1]), (None, docs[8][1]), (None, None), (91, None), (92, ""), (93, "..."), (94, "word " * 4000), (95, "y" * 3000), (96, "\x00\U0001f600 a")]
    target = [docs[3][1], None, "", "alpha gamma3 alpha"]
    frame = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    wanted = clashing(spark.createDataFrame([(t,) for t in target], "text string"))
    rows, drawn = brute_resample(docs, target, percent=40)
    for block in (resample.BLOCK_BYTES, 500):
        monkeypatch.setattr(resample, "OPEN_BLOCKS", 2)
        got = resample.resample(frame, wanted, percent=40, block_bytes=block).collect()
        assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == rows
        assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn


def test_resample_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert resample.resample(empty, some).count() == 0
    row = resample.resample(some, empty).first()
    assert (row.n_features, row["rank"]) == (3, None)


def test_checksums_of_long_words_and_row_ends():
    texts = ["a b", "", "c", "z" * 64 + " " + "z" * 65 + " q", "  A-Z1  ", "é" * 40 + " x"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    runs, rows = resample.feature_checksums(np.frombuffer(b"".join(raw), np.uint8), bounds)
    got = Counter()
    for k, run in enumerate(runs):
        for i in range(len(run)):
            if rows[i] == rows[i + k]:
                got[int(rows[i]), int(run[i])] += 1
    wanted = Counter()
    for row, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        for k in (1, 2, 3):
            for i in range(len(words) - k + 1):
                wanted[row, zlib.crc32(" ".join(words[i : i + k]).encode())] += 1
    assert got == wanted


def test_packed_values_come_back():
    rng = np.random.default_rng(0)
    values = np.concatenate((np.arange(300), rng.integers(0, 1 << 40, 50)))
    data, begins = resample.packed(values)
    back, at = resample.unpacked(data)
    assert (back == values).all() and (at == begins).all()
    assert len(resample.packed(np.zeros(0, np.int64))[0]) == 0 and len(resample.unpacked(np.zeros(0, np.uint8))[0]) == 0
