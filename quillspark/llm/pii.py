"""Personal data by bootstrapped contextual extraction.

One pass over the texts finds the base entities (fixed patterns with their checks), which are the seeds, and further
identifier-like strings, of which nothing is known yet. Each of these instances has lexical patterns: the two pieces of
text before it, and the pieces next to it on either side. Spark then works on the graph of patterns and instances, in
rounds: a pattern is trusted for a kind if the instances it extracts are of that kind more often than chance would
give over all patterns, and an unknown instance takes the kind for which the trusted patterns that extract it, and its
own shape, speak. What was learnt seeds the next round. At the end every occurrence of a learnt instance is a span.

Trust in a pattern with F distinct instances of a kind, O of other kinds and U unknown ones is F / (F + O + U / 2 + 1),
at least CONFIDENCE; and patterns tested times exp(-n KL(F / n, share of the kind among all instances)) is CHANCE at
most, so a larger corpus asks for more support instead of finding more by accident. Instances count once however often
they are repeated. Trust of several patterns adds up as 1 - product(1 - trust), at least ENOUGH.

Null and empty texts have no spans. Offsets count code points. Rows that share an id, or have none, are rows of their
own. An empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import broadcast_if_small, materialize, table

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
CONFIDENCE, ENOUGH, CHANCE, ROUNDS = 0.6, 0.75, 0.05, 4

#: The characters before an address's @, and what follows it.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits, with three dotted ones after it if there are; a run is read once, so the work stays linear.
_DOTTED = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What may be an identifier: seven digits or more, or a token with a digit or an "at" in it.
_NUMBER = re.compile(r"[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")
_SIGN = re.compile(r"[0-9@]|[(\[]at[)\]]")
_DIGIT = re.compile(r"[0-9]")
_BLANK = re.compile(r"[\x00-\x20]")
_EDGES = ".,;:!?\"'<>*#&$%()[]{}"
#: Code points of context, and of a token, that are looked at.
CONTEXT, TOKEN = 80, 64
#: What an unknown instance looks like: digits only, an address, a dotted or colon-separated number, anything else.
NUMBER, ADDRESS, DOTTED, OTHER = 0, 1, 2, 3

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, left to right: from each @ with a domain, as far back as the part before it goes."""
    free = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free:
            low = max(free, start - TOKEN)
            rest = len(text[low:start].rstrip(_LOCAL))
            start = low + rest
            if rest:
                break
        if start < at:
            free = m.end()
            yield start, free


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base entities, by kind, then start."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _DOTTED.finditer(text):
        if m.group(1) is not None and all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def _unknown(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like stretches outside of taken (sorted)."""
    spans = [(m.start(), m.end()) for m in _NUMBER.finditer(text) if m.end() - m.start() <= TOKEN]
    end = 0
    for m in _SIGN.finditer(text):
        if m.start() < end:
            continue
        low = max(end, m.start() - TOKEN)
        before = text[low : m.start()]
        low += max((b.end() for b in _BLANK.finditer(before)), default=0)
        blank = _BLANK.search(text, m.start())
        high = blank.start() if blank else len(text)
        end = high
        token = text[low:high]
        cut = max(token.rfind("="), token.rfind(":") if token.count(":") == 1 else -1) + 1
        low, token = low + cut, token[cut:]
        core = token.strip(_EDGES)
        low += len(token) - len(token.lstrip(_EDGES))
        marked = "@" in core or "(at)" in core or "[at]" in core
        if 6 <= len(core) <= TOKEN and (marked or (len(_DIGIT.findall(core)) >= 2 and any(c.isalpha() or c in ".:" for c in core))):
            spans.append((low, low + len(core)))
    taken, at, last = sorted(taken), 0, 0
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= last and not (at < len(taken) and taken[at][0] < e):
            last = e
            yield s, e


def shape(token: str) -> int:
    """What an instance looks like, of NUMBER, ADDRESS, DOTTED, OTHER."""
    if "@" in token or "(at)" in token or "[at]" in token:
        return ADDRESS
    if not any(c.isalpha() for c in token):
        parts = re.split(r"[.:]", token)
        return DOTTED if len(parts) >= 4 and all(parts) and all(p.isdigit() for p in parts) else NUMBER
    return OTHER


def instance(token: str) -> str:
    """The name under which an instance's occurrences meet: digits only for numbers, else lower case."""
    token = token.lower()
    if shape(token) == NUMBER:
        return "".join(_DIGIT.findall(token))
    return token.replace("(at)", "@").replace("[at]", "@").replace("(dot)", ".").replace("[dot]", ".")


def contexts(text: str, start: int, end: int) -> tuple[str | None, str | None]:
    """The patterns of an occurrence: the two pieces before it; the piece before and the piece after it."""
    before = _DIGIT.sub("0", text[max(0, start - CONTEXT) : start].lower())
    pieces = before.split()
    if not pieces:
        return None, None
    joint = "" if before[-1:].isspace() else "+"
    after = _DIGIT.sub("0", text[end : end + CONTEXT // 2].lower())
    right = ("" if after[:1].isspace() else "+") + (after.split() or [""])[0]
    left = f"{pieces[-2]} {pieces[-1]}{joint} _" if len(pieces) > 1 else None
    return left, f"{pieces[-1]}{joint} _ {right}"


SCHEMA = "row long, id {kind}, spans array<struct<kind:int,start:int,end:int>>, seen array<struct<start:int,end:int,kind:int,shape:int,instance:string,patterns:array<string>>>"


def observations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), id, spans (base entities), seen (instances with kind, shape and patterns) of every row."""
    out = T.StructType.fromDDL(SCHEMA.format(kind=docs.schema[id_col].dataType.simpleString()))
    span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    seen_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("shape", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans, seen = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                found = [(s, e, kind) for kind, s, e in base]
                if _SIGN.search(text):
                    found += [(s, e, None) for s, e in _unknown(text, [(s, e) for _, s, e in base])]
                spans.append([{"kind": kind, "start": s, "end": e} for kind, s, e in base])
                seen.append([{"start": s, "end": e, "kind": kind, "shape": shape(text[s:e]), "instance": instance(text[s:e]), "patterns": [p for p in contexts(text, s, e) if p]} for s, e, kind in found])
            numbers = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0), pa.array(spans, span_type), pa.array(seen, seen_type)], names=out.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, out)


def _fits(kind: Column, form: Column) -> Column:
    """Whether an unknown instance of that shape may be of the kind."""
    return ((kind == 0) & (form == ADDRESS)) | ((kind == 1) & (form == DOTTED)) | (kind.isin(2, 3) & (form == NUMBER))


def trusted_patterns(edges: DataFrame, known: DataFrame, confidence: float = CONFIDENCE, chance: float = CHANCE) -> DataFrame:
    """pattern, kind, trust out of edges(pattern, instance) and known(instance, kind or null)."""
    shares = {r.kind: r.n for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    per_kind = [F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(KINDS))]
    counts = materialize(edges.join(known, "instance").groupBy("pattern").agg(F.count("*").alias("n"), F.count("kind").alias("sure"), *per_kind).where("sure > 1"))
    tested = max(1, counts.count())
    options = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("f"), F.lit(shares.get(k, 0) / max(1, total)).alias("q")) for k in range(len(KINDS))]))
    f, n, q, p = F.col("f"), F.col("n"), F.col("q"), F.col("f") / F.col("n")
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    evidence = n * (p * F.log(p / q) + rest)
    trust = f / (f + (F.col("sure") - f) + (n - F.col("sure")) / 2 + 1)
    rated = counts.select("pattern", "n", "sure", options.alias("o")).select("pattern", "n", "sure", "o.*").where((f > 1) & (q < 1) & (p > q))
    return rated.where((trust >= confidence) & (evidence >= F.log(F.lit(tested / chance)))).select("pattern", "kind", trust.alias("trust"))


def learn(observed: DataFrame, rounds: int = ROUNDS, enough: float = ENOUGH, **how) -> tuple[DataFrame, DataFrame]:
    """known(instance, kind, trust: 1 for seeds) and the last round's patterns, out of what observations returns, written."""
    seen = observed.select(F.explode("seen").alias("s")).select("s.*")
    edges = materialize(seen.select(F.explode("patterns").alias("pattern"), "instance").distinct())
    known = materialize(seen.groupBy("instance").agg(F.min("kind").alias("kind"), F.min("shape").alias("shape")).withColumn("trust", F.when(F.col("kind").isNotNull(), 1.0)))
    patterns = None
    for _ in range(rounds):
        patterns = materialize(trusted_patterns(edges, known.select("instance", "kind"), **how))
        open_ = known.where("kind is null").select("instance", "shape")
        met = edges.join(open_, "instance").join(broadcast_if_small(patterns), "pattern").where(_fits(F.col("kind"), F.col("shape")))
        votes = met.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("trust")).where(F.col("trust") >= enough)
        new = materialize(votes.groupBy("instance").agg(F.max(F.struct("trust", (-F.col("kind")).alias("minus"))).alias("v")).select("instance", (-F.col("v.minus")).alias("new"), F.col("v.trust").alias("sure")))
        if new.isEmpty():
            break
        known = materialize(known.join(new, "instance", "left").select("instance", F.coalesce("kind", "new").alias("kind"), "shape", F.coalesce("trust", "sure").alias("trust")))
    return known.where("kind is not null").select("instance", "kind", "trust"), patterns


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """row, id, spans (base), all_spans (base and learnt, by kind, then start) of every row of docs."""
    observed = materialize(observations(docs, id_col, text_col))
    known, _ = learn(observed, **how)
    unknown = observed.select("row", F.explode(F.filter("seen", lambda s: s["kind"].isNull())).alias("s")).select("row", "s.start", "s.end", "s.instance", "s.shape")
    met = unknown.join(known, "instance").where(_fits(F.col("kind"), F.col("shape")))
    learnt = met.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("learnt")).withColumnRenamed("row", "_row")
    joined = observed.select("row", "id", "spans").join(learnt, F.col("row") == F.col("_row"), "left")
    both = F.sort_array(F.concat("spans", F.coalesce("learnt", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return joined.select("row", "id", "spans", both.alias("all_spans"))


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of all documents."""
    found = find_private(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(spans_text("spans").cast("binary"), 256).alias("base_sha256"), spans_text("all_spans").alias("spans"))


QUERIES = {"op12_pii": op12_pii}
ORACLES: dict[str, str] = {}
