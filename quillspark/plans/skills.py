"""Skill index: field-weighted search, line search, related skills, filters, look-ups, statistics, integrity.

A document is a skill: its whole text is description and body, its first line the title, quoted parts are triggers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators.ranking import sorted_ranks
from quillspark.plans.shared import concat_list, distinct, each, filtered, length_of
from quillspark.sources.adapters import on_duckdb, on_spark
from quillspark.sources.scratch import written
from quillspark.sources.tables import table

#: Words that carry no signal in skill search.
STOP_WORDS = tuple(
    """a an the and or of for to in on with without my me i we you your this that these
    those is are be been being do does did doing can could should would will shall may might
    how what which who when where why please give me show find get need want help about
    into from at by as it its""".split()
)
#: Weights of skill search by field.
WEIGHTS = {"name_exact": 120, "name_normalised": 110, "name_phrase": 60, "name_token": 45, "pack": 55, "phase": 22, "description": 18, "trigger": 28, "title": 8, "body": 3}
EXTRA_NAME, RARE, RARE_BONUS, RARE_MISS, DESCRIPTION_CAP, BODY_CAP = 0.25, 2.5, 120, 0.5, 4, 6

#: What is asked: by name, by name with a blank for the dash, by words, with a repeated word, with stop words only.
ASKED = "(VALUES (1, 'src7 that en ering'), (2, 'find worthless fr des'), (3, 'zzzz the tion'), (4, 'src1-101'), (5, 'SRC1 101'), (6, 'license License'), (7, 'the of')) AS v(qid, q)"
WORDS = "[^a-z0-9+#]+"


def skills(s: bool) -> str:
    """CTE of the documents as skills."""
    times = "{{3,120}}" if s else "{3,120}"
    quoted = f"""regexp_extract_all(text, '"([^"]{times})"', 1)"""
    return f"""skills AS (SELECT source || '-' || cast(d.doc_id AS varchar(20)) AS name, d.doc_id AS id, source AS pack, lang AS phase, text AS description, text AS body,
    {concat_list(quoted, ' ', s)} AS triggers, split_part(text, chr(10), 1) AS title, coalesce(l.quality, 0) AS quality
    FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id)"""


def words(text: str, s: bool) -> str:
    """The lower-cased words of SQL text, as an array; signs + and # belong to words."""
    split = f"split(lower({text}), '{WORDS}')" if s else f"string_split_regex(lower({text}), '{WORDS}')"
    return filtered(split, "x <> ''", s)


def _search(s: bool) -> str:
    """E-17, E-18, E-19: each query word against each skill by field, weighted by a clamped idf.

    Rounding is half-even, a repeated word counts again, and a word that no skill has is rare as well.
    """
    w = WEIGHTS
    # Spark meets each skill with the query words and their idf at once, so that texts are not shuffled, and tells the
    # rare words of a group by their bits, so that a group is a row of numbers before the shuffle
    bit = "CASE WHEN k < 64 THEN shiftleft(1L, k) ELSE raise_error('a query has more than 64 different words') END"
    terms = f"""
    t AS (SELECT qid, tok, f, {bit} AS bit FROM (SELECT qid, tok, f, cast(dense_rank() OVER (PARTITION BY qid ORDER BY tok) - 1 AS int) AS k FROM qt JOIN idf ON word = tok) k),""" if s else ""
    hint, met = ("/*+ BROADCAST(t) */ ", "t.tok, f, bit, {} FROM low CROSS JOIN t") if s else ("", "qt.tok, f, {} FROM low CROSS JOIN qt JOIN idf ON word = qt.tok")
    different = (lambda when: f"bit_count(bit_or(CASE WHEN {when} THEN bit ELSE 0L END))") if s else (lambda when: f"count(DISTINCT CASE WHEN {when} THEN tok END)")
    rnd = (lambda x: f"bround({x})") if s else (lambda x: f"round_even({x}, 0)")
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    told, content = words("q", s), filtered(words("q", s), f"x NOT IN ({stop})", s)
    often = lambda field: f"cast(floor((length({field}) - length(replace({field}, tok, ''))) / length(tok)) AS int)"
    has = lambda field: f"CASE WHEN position(tok IN {field}) > 0 THEN 1 ELSE 0 END"
    alike = filtered("name_words", "x = tok OR (length(tok) >= 4 AND length(x) >= 4 AND (position(x IN tok) = 1 OR position(tok IN x) = 1))", s)
    fields = f"""CASE WHEN {length_of(alike, s)} > 0 THEN 1 ELSE 0 END AS named, {has('pack')} AS in_pack, {has('phase')} AS in_phase, {has('triggers')} AS in_triggers, {has('title')} AS in_title,
        least({often('descr')}, {DESCRIPTION_CAP}) AS in_descr, least({often('body')}, {BODY_CAP}) AS in_body"""
    all_words = words("name || ' ' || title || ' ' || description || ' ' || coalesce(pack, '') || ' ' || coalesce(phase, '') || ' ' || body", s)
    held, asked_for = distinct(all_words, s), f"array_intersect({all_words}, (SELECT collect_set(tok) FROM qt))"
    return f"""WITH {skills(s)}, asked AS (SELECT qid, lower(trim(q)) AS phrase, CASE WHEN {length_of(content, s)} > 0 THEN {content} ELSE {told} END AS toks FROM {ASKED}),
    qt AS (SELECT qid, {each('toks', s)} AS tok FROM asked), n AS (SELECT count(*) AS n FROM skills),
    low AS (SELECT name, lower(name) AS lname, {words('name', s)} AS name_words, lower(coalesce(pack, '')) AS pack, lower(coalesce(phase, '')) AS phase, lower(description) AS descr, lower(triggers) AS triggers, lower(title) AS title, lower(body) AS body FROM skills),
    had AS (SELECT name, {f'explode_outer({asked_for})' if s else each(held, s)} AS tok FROM skills),
    df AS (SELECT tok, count(*) AS df FROM had WHERE tok IN (SELECT tok FROM qt) GROUP BY tok),
    idf AS (SELECT t.tok AS word, least(3.0, greatest(0.25, 1 + ln((n + 1.0) / (coalesce(df, 0) + 1.0)))) AS f FROM (SELECT DISTINCT tok FROM qt) t LEFT JOIN df ON df.tok = t.tok CROSS JOIN n),{terms}
    met AS (SELECT {hint}qid, name, {met.format(fields)}),
    part AS (SELECT *, {rnd(f"{w['pack']} * f")} * in_pack + {rnd(f"{w['phase']} * f")} * in_phase + {rnd(f"{w['description']} * f")} * in_descr + {rnd(f"{w['trigger']} * f")} * in_triggers
        + {rnd(f"{w['title']} * f")} * in_title + {rnd(f"{w['body']} * f")} * in_body AS plain, named + in_pack + in_phase + in_triggers + in_title + in_descr + in_body > 0 AS hit FROM met),
    total AS (SELECT qid, name, sum(plain) AS plain, max(named * f) AS best, sum({rnd(f"{w['name_token']} * f * {EXTRA_NAME}")} * named) AS extras, {different(f'f >= {RARE} AND hit')} AS rare_hits,
        {different(f'f >= {RARE}')} AS rare, count(CASE WHEN hit THEN 1 END) AS hits FROM part GROUP BY qid, name),
    phrased AS (SELECT total.*, CASE WHEN lower(name) = phrase THEN {w['name_exact']} WHEN replace(lower(name), '-', ' ') = replace(phrase, '-', ' ') THEN {w['name_normalised']} WHEN position(phrase IN lower(name)) > 0 THEN {w['name_phrase']} ELSE 0 END AS whole FROM total JOIN asked ON asked.qid = total.qid),
    summed AS (SELECT *, plain + whole + CASE WHEN best > 0 THEN {rnd(f"{w['name_token']} * best")} - {rnd(f"{w['name_token']} * best * {EXTRA_NAME}")} + extras ELSE 0 END AS base FROM phrased WHERE hits > 0 OR whole >= {w['name_normalised']}),
    scored AS (SELECT qid, name, cast(CASE WHEN rare = 0 THEN base WHEN whole >= {w['name_normalised']} THEN base + {RARE_BONUS} * rare WHEN rare_hits > 0 THEN base + {RARE_BONUS} * rare_hits ELSE {rnd(f'base * {RARE_MISS}')} END AS double) AS score FROM summed)
    SELECT qid, name, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name{' NULLS LAST' if s else ''}) AS rnk FROM scored) x WHERE rnk <= 10"""


def _grep(s: bool) -> str:
    """E-20: lines that hold any of the words: how many, where the first stands, and the first five."""
    needle = "lower({0}) LIKE '%worthless%' OR lower({0}) LIKE '%license%'"
    if s:
        hits = f"filter(transform(split(text, '\\n'), (x, i) -> struct(i + 1 AS no, x AS line)), p -> {needle.format('p.line')})"
        shown = "array_join(transform(slice(hits, 1, 5), p -> cast(p.no AS string) || ':' || substr(trim(p.line), 1, 300)), '|')"
        return f"SELECT doc_id, size(hits) AS hit_count, hits[0].no AS first_line, {shown} AS shown FROM (SELECT doc_id, {hits} AS hits FROM {{documents}}) h WHERE size(hits) > 0"
    hits = f"list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {{'no': i, 'line': x}}), lambda p: {needle.format('p.line')})"
    shown = "array_to_string(list_transform(hits[1:5], lambda p: p.no || ':' || substr(trim(p.line), 1, 300)), '|')"
    return f"SELECT doc_id, len(hits) AS hit_count, hits[1].no AS first_line, {shown} AS shown FROM (SELECT doc_id, {hits} AS hits FROM {{documents}}) h WHERE len(hits) > 0"


def _validate(s: bool) -> str:
    """D-27: every violation of every skill."""
    headings = "regexp_extract_all(lower(body), '(?m)^##[ \\t]+(.+)$', 1)" if not s else "regexp_extract_all(lower(body), r'(?m)^##[ \\t]+(.+)$', 1)"
    regex = "regexp_like" if s else "regexp_matches"
    raw = "r" if s else ""
    process = filtered(headings, "x LIKE 'workflow%' OR x LIKE 'process%' OR x LIKE 'procedure%' OR x LIKE 'steps%' OR x LIKE 'how to use%'", s)
    checks = [
        "CASE WHEN coalesce(description, '') = '' THEN 'missing field: description' WHEN length(description) < 40 THEN 'description is short' END",
        "CASE WHEN pack IS NULL AND phase IS NULL THEN 'neither pack nor phase' END",
        "CASE WHEN named > 1 THEN 'duplicate name' END",
        *[f"CASE WHEN NOT {regex}(body, {raw}'(?m)^##[ \\t]+{h}\\b') THEN 'missing section: {h}' END" for h in ("When to use", "Workflow")],
        f"CASE WHEN {length_of(headings, s)} > 0 AND {length_of(process, s)} = 0 THEN 'no process section' END",
    ]
    issues = ("array({})" if s else "[{}]").format(", ".join(checks))
    return f"""WITH {skills(s)}, times AS (SELECT name AS key, count(*) AS named FROM skills GROUP BY name)
    SELECT name, {each(filtered(issues, 'x IS NOT NULL', s), s)} AS problem FROM skills JOIN times ON key = name"""


def _texts(s: bool) -> dict[str, str]:
    w = f"WITH {skills(s)}"
    names = "sort_array(collect_list(name))" if s else "list_sort(list(name))"
    return {
        "s3_search": _search(s),
        "s3_grep": _grep(s),
        "s3_stats": f"{w} SELECT pack, phase, count(*) AS n, min(name) AS least_name, count(CASE WHEN length(description) < 40 THEN 1 END) AS short_descriptions FROM skills GROUP BY pack, phase",  # D-28
        "s3_names": f"{w} SELECT pack, {length_of(names, s)} AS n, md5({concat_list(names, ',', s)}) AS names_md5 FROM skills GROUP BY pack",  # D-28: sorted name lists
        "s3_validate": _validate(s),
        # B-10, B-11: filter by pack and phase, whatever the case; look-up by name, else by folder
        "s3_filter": f"{w} SELECT name, pack, phase FROM skills WHERE lower(coalesce(pack, '')) = lower('SRC3') AND lower(coalesce(phase, '')) = 'en'",
        "s3_lookup": f"{w}, asked AS (SELECT * FROM (VALUES ('src1-101'), ('src3/103'), ('nothing')) AS v(k)) SELECT k, name, how FROM (SELECT k, name, CASE WHEN name = k THEN 'name' ELSE 'folder' END AS how, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN name = k THEN 0 ELSE 1 END, name) AS rn FROM asked JOIN skills ON name = k OR pack || '/' || cast(id AS varchar(20)) = k) x WHERE rn = 1",
        # C-27: first sentence, title, triggers
        "s3_cards": f"{w} SELECT name, title, {_sentence(s)} AS first_sentence, triggers FROM skills",
        # E-22: phases with the number that leads their folder, 99 where there is none
        "s3_phases": f"{w}, f AS (SELECT CASE WHEN quality = 1 THEN cast(id % 7 AS varchar(20)) || '_' || phase ELSE phase END AS folder FROM skills) SELECT folder, coalesce(cast(nullif(regexp_extract(folder, '^([0-9]+)', 1), '') AS int), 99) AS pos, count(*) AS n FROM f GROUP BY folder",
    }


def _sentence(s: bool) -> str:
    """What stands before the first white space that follows a sentence's end, else all."""
    if s:
        return "split(trim(description), r'(?<=[.!?])[ \\t\\n\\r\\f]', 2)[0]"
    return "regexp_replace(trim(description), '(?s)^(.*?[.!?])[ \\t\\n\\r\\f].*$', '\\1')"


def _related_sql() -> str:
    """DuckDB SQL: all pairs of a skill asked for and any other."""
    tokens = distinct(words("name || ' ' || description", False), False)
    both = "len(list_intersect(a.t, b.t))"
    score = f"0.5 * CASE WHEN a.pack = b.pack THEN 1 ELSE 0 END + coalesce({both} * 1.0::DOUBLE / nullif(len(a.t) + len(b.t) - {both}, 0), 0)"
    return f"""WITH {skills(False)}, t AS (SELECT id, name, pack, {tokens} AS t FROM skills),
    p AS (SELECT a.name, b.name AS other, CASE WHEN a.pack = b.pack THEN 1 ELSE 0 END AS same, floor(({score}) * 1e6 + 0.5) / 1e6 AS score FROM t a JOIN t b ON a.name <> b.name WHERE a.id % 100 = 0)
    SELECT name, other, same, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, same DESC, other) AS rnk FROM p) x WHERE rnk <= 8"""


#: Rows a task reads at a time, skills asked for at a time (the latter bounds a task's memory), and hits of each.
ROWS_AT_ONCE, ASKED_AT_ONCE, NEAREST = 256, 1024, 8
#: A word that fewer of a block's skills have is a short list of them, any other a row of ones and zeros.
LISTED = 16


def _related(spark, sf_dir):
    """E-21: to every skill whose id is divisible by 100, the eight nearest of all others by category and shared words.

    Every pair is counted. Texts are cut into words once: words that a skill asked for has are numbered, and the others
    only add to a skill's number of words. A task gets a block of the skills asked for as a table of words by skills; the
    rows of a skill's own words are added up, which counts what it shares with all of the block at once. Of all its pairs
    a task gives out the eight nearest of each skill asked for.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    several = written(labels.join(labels.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_semi"))  # others add no row to a skill's, so texts need not meet them
    cut = f"WITH {skills(True)} SELECT id % 100 = 0 AS asked, name, pack, phase, lower(name || ' ' || description) AS t FROM skills"
    known = spark.sql(cut, documents=table(spark, sf_dir, "documents"), labels=several).where("name IS NOT NULL")
    vocabulary = known.where("asked").select("t").mapInArrow(_different, "word string").distinct().toArrow()["word"].combine_chunks()
    numbered = written(known.mapInArrow(_numbered(spark.sparkContext.broadcast(vocabulary)), "asked boolean, name string, pack string, phase string, n int, ids binary"))
    asked = written(sorted_ranks(numbered.where("asked").drop("asked"), [F.asc("phase"), F.asc("name")]))  # skills of one language share words
    found = None
    for begin in range(0, max(1, asked.count()), ASKED_AT_ONCE):
        own = asked.where((F.col("rnk") > begin) & (F.col("rnk") <= begin + ASKED_AT_ONCE)).select("name", "pack", "n", "ids")
        sent = spark.sparkContext.broadcast(own.toArrow())  # ASKED_AT_ONCE skills
        part = numbered.select("name", "pack", "n", "ids").mapInArrow(_nearest(sent, len(vocabulary)), "name string, other string, same int, score double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("same"), "other")
    return found.withColumn("rnk", F.row_number().over(best)).where(f"rnk <= {NEAREST}")


#: Bytes that words are made of, as in WORDS, and bytes of text that a task cuts at a time.
_INSIDE = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789+#"))
TEXT_BYTES = 16 << 20


def _cut(batch, column):
    """Slices of a batch of about TEXT_BYTES, each with the words of its lower-cased texts and the row of each word."""
    texts = batch.column(column).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + TEXT_BYTES, "right")) - 1)
        own = bounds[begin : end + 1] - bounds[begin]
        raw = np.frombuffer(data, np.uint8)[bounds[begin] : bounds[end]] if own[-1] else np.zeros(0, np.uint8)
        inside = _INSIDE[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = own[(own > 0) & (own < own[-1])]  # no word runs from one text into the next
        first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        ends = np.concatenate(([0], np.cumsum(last + 1 - first))).astype(np.int32)
        yield batch.slice(begin, end - begin), pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(raw[inside])), np.searchsorted(own, first, "right") - 1
        begin = end


def _different(batches):
    """The different words of texts, once or more each."""
    for batch in batches:
        for _, held, _ in _cut(batch, 0):
            yield pa.RecordBatch.from_arrays([pc.unique(held)], names=["word"])


def _numbered(sent):
    """n (how many different words) and ids (numbers of those in the vocabulary, as 32-bit integers) in place of t."""

    def run(batches):
        for batch in batches:
            for part, held, row in _cut(batch, 4):
                held = held.dictionary_encode()
                code = held.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = np.sort(row * max(1, len(held.dictionary)) + code)
                row, code = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(1, len(held.dictionary)))
                ids = pc.fill_null(pc.index_in(held.dictionary, value_set=sent.value), -1).to_numpy(zero_copy_only=False)[code]
                ends = np.cumsum(np.bincount(row[ids >= 0], minlength=part.num_rows))
                bounds, ids = np.concatenate(([0], 4 * ends)).astype(np.int32), ids[ids >= 0].astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                n = pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], n, packed], names=["asked", "name", "pack", "phase", "n", "ids"])

    return run


def _ids(column):
    """The numbers in a binary column of 32-bit integers, and where each row's begin and end."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].copy().view(np.int32) if data is not None else np.zeros(0, np.int32)
    return flat, (bounds - bounds[0]) // 4


class _Shared:
    """How many words rows share with each skill of a block."""

    def __init__(self, ids, bounds, size):
        self.q = len(bounds) - 1
        owner = np.repeat(np.arange(self.q), np.diff(bounds))
        own, place = np.unique(ids, return_inverse=True)
        often = np.bincount(place, minlength=len(own)) >= LISTED
        self.dense, self.known = int(often.sum()), len(own)
        number = np.empty(len(own), np.int32)
        number[often], number[~often] = np.arange(self.dense), np.arange(self.dense, self.known)
        self.number = np.full(size, self.known, np.int32)  # the last: words that nobody of the block has
        self.number[own] = number
        at = number[place]
        self.has = np.zeros((self.dense, self.q), np.uint8)
        self.has[at[at < self.dense], owner[at < self.dense]] = 1
        listed, who = at[at >= self.dense] - self.dense, owner[at >= self.dense]
        who = who[np.argsort(listed, kind="stable")]
        self.many, self.who = np.bincount(listed, minlength=self.known - self.dense), who
        self.begin = np.cumsum(self.many) - self.many

    def rows(self, flat, bounds):
        """A row for each row: what it shares with every skill of the block."""
        at, row = self.number[flat], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        listed = (at >= self.dense) & (at < self.known)
        word = at[listed] - self.dense
        many = self.many[word]
        one = np.arange(many.sum()) + np.repeat(self.begin[word] - np.cumsum(many) + many, many)
        both = np.bincount(np.repeat(row[listed], many) * self.q + self.who[one], minlength=(len(bounds) - 1) * self.q)
        both = both.astype(np.float32).reshape(-1, self.q)
        dense = at < self.dense
        ends = np.concatenate(([0], np.cumsum(dense)))[bounds].tolist()
        dense = at[dense]
        for i in range(len(bounds) - 1):
            for c in range(ends[i], ends[i + 1], 255):  # 255 ones fit a byte
                both[i] += np.add.reduce(self.has[dense[c : min(c + 255, ends[i + 1])]], axis=0, dtype=np.uint8)
        return both


class _Best:
    """The nearest rows so far of each skill of a block, by score, category and name."""

    def __init__(self, names, packs, sizes):
        self.names, self.sizes = names, sizes
        self.codes = {p: i for i, p in enumerate(dict.fromkeys(p for p in packs if p is not None))}
        self.packs = np.array([self.codes.get(p, -2) for p in packs], np.int64)
        self.j, self.key, self.other = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], names.type)
        self.least, self.bars = np.full(len(sizes), -1e9), {}  # millionths that a further row needs
        self.more = []

    def bar(self, code):
        """a, b so that a row of the category and n words is no nearer to a skill if it shares less than a * n + b words with it."""
        if code not in self.bars:
            x = np.maximum((self.least - 1) / 1e6 - 0.5 * (self.packs == code), -0.5)
            a = x / (1 + x)
            a = (a - np.abs(a) * 1e-5).astype(np.float32)  # more than what floats of 32 bits lose
            self.bars[code] = a, a * self.sizes.astype(np.float32)
        return self.bars[code]

    def add(self, j, both, n, code, other):
        """Takes rows (skill of the block, words shared, own words, category, name) and cuts to the nearest now and then."""
        same, union = self.packs[j] == code, n + self.sizes[j] - both
        share = np.divide(both * 1.0, union, out=np.zeros(len(j)), where=union != 0)
        key = 2 * np.floor((0.5 * same + share) * 1e6 + 0.5).astype(np.int64) + same
        differs = pc.not_equal(other, self.names.take(pa.array(j))).to_numpy(zero_copy_only=False)
        self.more.append((j[differs], key[differs], other.filter(pa.array(differs))))
        if sum(len(x[0]) for x in self.more) >= NEAREST * len(self.sizes):
            self.cut()

    def cut(self):
        j, key, other = zip((self.j, self.key, self.other), *self.more, strict=True)
        j, key, other, self.more = np.concatenate(j), np.concatenate(key), pa.concat_arrays(other), []
        order = np.lexsort((-key, j))
        begin = np.searchsorted(j[order], j)  # of each row's skill in that order
        last = np.minimum(begin + NEAREST, np.searchsorted(j[order], j, "right")) - 1
        kept = np.flatnonzero(key >= key[order][last])
        found = pa.table({"j": j[kept], "key": key[kept], "other": other.take(pa.array(kept))})
        kept = kept[pc.sort_indices(found, sort_keys=[("j", "ascending"), ("key", "descending"), ("other", "ascending")]).to_numpy()]
        kept = kept[np.arange(len(kept)) - np.searchsorted(j[kept], j[kept]) < NEAREST]
        self.j, self.key, self.other = j[kept], key[kept], other.take(pa.array(kept))
        full = np.flatnonzero(np.bincount(self.j, minlength=len(self.sizes)) >= NEAREST)
        self.least[full] = self.key[np.searchsorted(self.j, full, "right") - 1] // 2
        self.bars = {}

    def batch(self):
        self.cut()
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.j)), self.other, pa.array((self.key % 2).astype(np.int32)), pa.array(self.key // 2 / 1e6)], names=["name", "other", "same", "score"])


def _nearest(sent, size):
    """The nearest of all rows of a task to the skills sent, whose words have numbers below size."""

    def answer(batches):
        block = sent.value.combine_chunks()
        if not block.num_rows:
            return
        name, pack, n, ids = (block[c].chunk(0) for c in ("name", "pack", "n", "ids"))
        shared, best = _Shared(*_ids(ids), size), _Best(name, pack.to_pylist(), n.to_numpy().astype(np.int64))
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                codes = np.array([best.codes.get(p, -1) for p in batch.column(1).to_pylist()], np.int64)
                n, found = batch.column(2).to_numpy().astype(np.int64), []
                both = shared.rows(*_ids(batch.column(3)))
                for code in np.unique(codes).tolist():
                    rows = np.flatnonzero(codes == code)
                    a, b = best.bar(code)
                    i, j = np.nonzero(both[rows] >= a * n[rows, None].astype(np.float32) + b)
                    found.append((rows[i], j))
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(i):
                    best.add(j, both[i, j].astype(np.int64), n[i], codes[i], batch.column(0).take(pa.array(i)))
        yield best.batch()

    return answer


_SPARK, _DUCK = _texts(True), _texts(False)
QUERIES = {name: (lambda spark, sf_dir, sql=sql: on_spark(spark, sf_dir, sql)) for name, sql in _SPARK.items()} | {"s3_related": _related}
ORACLES = {name: on_duckdb(sql) for name, sql in _DUCK.items()} | {"s3_related": on_duckdb(_related_sql())}
