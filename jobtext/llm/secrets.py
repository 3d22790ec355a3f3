"""Secret scan: pattern spans, and spans that character Markov models tell from ordinary identifiers.

Two first-order models over the characters of identifier-like runs are trained
from samples that the patterns label: matched values are random strings, other
words are ordinary. What base spans leave of a run is a span of kind ``markov``
if its log-likelihood ratio favours the random model by a margin; if not, its
stretches that do are. All steps are SQL expressions; only
two tables of character-pair counts, bounded by the alphabet, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.llm.common import documents, row_name, staged

# Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Equal to the contract's patterns with their least lengths: both match whole maximal runs.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_VALUE = 6

#: Runs that the models judge, and the least length of a span.
LEAST_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
#: Words from which ordinary pairs are counted.
WORD = r"[A-Za-z0-9+/_=-]{4,}"
#: Documents (about) sampled for ordinary words; the values come from all documents.
TRAIN_DOCS = 2000
#: Weight, in pairs, of a model's single-character distribution in each of its rows, and the share
#: of the uniform in that: a random string may use any character, an ordinary word hardly.
BACKOFF, RANDOM_UNIFORM, ORDINARY_UNIFORM = 5.0, 0.5, 0.001
#: Least log-likelihood ratio, in nats, in all and per character.
MARGIN, PER_CHAR = 10.0, 0.5
#: Least ratio, beyond PER_CHAR each, of a stretch of a run: there are many in one, and rare
#: pairs of ordinary words reach 15 nats; 20 random characters have 25 or more.
STRETCH = 20.0
#: Ratio of a character like the two before it: repetition tells it, chance one of 64.
REPEAT = -4.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Places of a chunk of a running sum, code points of a part of a text.
_CHUNK, _PART = 256, 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once. A column of an earlier
    projection may be put in its place by the optimizer, into a lambda too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, largest: bool = False) -> Column:
    """An array: at each place the sum (or the largest, at least 0) of
    ``values`` before it, by way of those of chunks."""
    op = (lambda a, x: F.greatest(a, x)) if largest else (lambda a, x: a + x)
    fold = lambda c: F.aggregate(c, F.lit(0), op)
    chunk = lambda i: F.floor(i / _CHUNK).cast("int")
    numbers = lambda v: F.sequence(F.lit(0), chunk(F.size(v)))
    parts = lambda v: F.transform(numbers(v), lambda c: fold(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))))
    upto = lambda p, v, i: fold(F.array(fold(F.slice(p, F.lit(1), chunk(i))), fold(F.slice(v, chunk(i) * _CHUNK + 1, i % _CHUNK))))
    return _let(values, lambda v: _let(parts(v), lambda p: F.transform(v, lambda _, i: upto(p, v, i))))


def with_matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds the array ``out`` of (start, end, found) of the leftmost
    non-overlapping matches, in code points, end exclusive. The text between
    matches, by ``split``, and the matches themselves give the places."""
    some, none = F.rlike(text, F.lit(pattern)), F.array().cast("array<string>")
    df = df.withColumn("_found", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_between", F.when(F.size("_found") > 0, F.transform(F.split(text, pattern), lambda x: F.length(x))))

    def places(found: Column, between: Column) -> Column:
        before = running(F.transform(found, lambda m, i: F.length(m) + F.get(between, i)))
        span = lambda m, at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("found"))
        return _let(before, lambda b: F.transform(found, lambda m, i: span(m, F.get(b, i) + F.get(between, i))))

    spans = _let(F.col("_found"), lambda found: _let(F.col("_between"), lambda between: places(found, between)))
    return df.withColumn(out, spans).drop("_found", "_between")


def _between(parts: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text in parts of _PART: finding
    a place in a part takes the part's length, in the text the place's."""
    number = lambda i: F.floor(i / _PART).cast("int")
    first, last = number(start), number(end - 1)
    one = F.substr(F.get(parts, first), start % _PART + 1, end - start)
    more = F.concat(F.substr(F.get(parts, first), start % _PART + 1, F.lit(_PART)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""),
                    F.substr(F.get(parts, last), F.lit(1), (end - 1) % _PART + 1))
    return F.when(end <= start, F.lit("")).when(first == last, one).otherwise(more)


def _with_cover(rows: DataFrame, text: str, spans: str, out: str, cover: Column | None) -> DataFrame:
    """Adds the string ``out``: ``text`` with what each group of overlapping
    ``spans`` (sorted) covers replaced by ``cover``, or by as many blanks if
    that is None; ``text`` itself if ``spans`` is null or empty."""
    rows = rows.withColumn("_upto", running(F.transform(spans, lambda s: s.end), largest=True))

    def piece(s: Column, upto: Column, parts: Column) -> Column:
        before = _between(parts, upto, s.start)
        if cover is None:
            return F.concat(F.when(s.start > upto, before).otherwise(F.lit("")), F.repeat(F.lit(" "), s.end - F.greatest(s.start, upto)))
        return F.when(s.start >= upto, F.concat(before, cover)).otherwise(F.lit(""))

    rest = F.substr(text, F.array_max(F.transform(spans, lambda s: s.end)) + 1, F.length(text))
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))
    pieces = _let(F.col("_upto"), lambda upto: _let(parts, lambda p: F.transform(spans, lambda s, i: piece(s, F.get(upto, i), p))))
    covered = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))
    return rows.withColumn(out, covered).drop("_upto")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) to doc_id, id_key, text_key, the three arrays of base
    spans (assign, access, hex), ``base`` with all of them sorted, and the runs
    to judge, from which base spans are cut out; null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_name("doc_id", "text"), F.coalesce("text", F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        rows = with_matches(rows, "text", pattern, name)
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_extract(s.found, ASSIGN, 2)) >= LEAST_VALUE)
    rows = rows.withColumn("assign", long_enough)
    rows = rows.withColumn("base", F.sort_array(F.concat(*[_placed(k, rank, k) for rank, k in enumerate(("assign", "access", "hex"))])))
    rows = _with_cover(rows, "text", "base", "left_over", None)
    return with_matches(rows, "left_over", RUN, "runs").drop("text", "left_over")


def _pairs(words: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of character pairs (code points; 0 before the first) of (word, weight)."""
    steps = words.select("word", "weight", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    code = lambda at: F.ascii(F.substr("word", at, F.lit(1)))
    pairs = steps.select(F.when(F.col("i") > 0, code(F.col("i"))).otherwise(0).alias("a"), code(F.col("i") + 1).alias("b"), "weight")
    return {(r.a, r.b): r.n for r in pairs.groupBy("a", "b").agg(F.sum("weight").alias("n")).collect()}


def _log_model(counts: dict[tuple[int, int], int], uniform: float) -> dict[tuple[int, int], float]:
    codes = [ord(c) for c in ALPHABET]
    single = {b: sum(counts.get((a, b), 0) for a in [0, *codes]) for b in codes}
    total = max(1, sum(single.values()))
    single = {b: (1 - uniform) * n / total + uniform / len(codes) for b, n in single.items()}
    out = {}
    for a in [0, *codes]:
        row = sum(counts.get((a, b), 0) for b in codes) + BACKOFF
        out |= {(a, b): math.log((counts.get((a, b), 0) + BACKOFF * single[b]) / row) for b in codes}
    return out


def train(docs: DataFrame, spans: DataFrame) -> dict[tuple[int, int], float]:
    """Log ratio, random over ordinary, of each pair of characters.

    Random strings are the values that the patterns matched in all documents.
    Ordinary words are those that occur in two or more of about TRAIN_DOCS
    documents (picked by the digest of their text) after the matches are cut
    out: a random string does not recur. Without samples a model is uniform."""
    kinds = F.concat(F.transform("assign", lambda s: F.regexp_extract(s.found, ASSIGN, 2)), F.transform("access", lambda s: s.found), F.transform("hex", lambda s: s.found))
    values = spans.select(F.explode(kinds).alias("word"), F.lit(1).alias("weight"))
    every = max(1, docs.count() // TRAIN_DOCS)
    picked = docs.select("text", *row_name("doc_id", "text")).where(F.pmod("text_key", F.lit(every)) == 0)
    rest = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    found = picked.select("text_key", F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)))).alias("word"))
    words = found.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1").select("word", F.col("docs").alias("weight"))
    random, ordinary = _log_model(_pairs(values), RANDOM_UNIFORM), _log_model(_pairs(words), ORDINARY_UNIFORM)
    return {k: v - ordinary[k] for k, v in random.items()}


def _random(word: Column, table: Column) -> Column:
    """Places (start, end) in a run that the random model wins; ``table`` holds
    the log ratios of 128 x 128 pairs. The whole run if its sum has the margin;
    if not, the stretches that have STRETCH. One ends where the running sum of
    the ratios, less PER_CHAR each, is used up or STRETCH below its largest value,
    and reaches from its start to that value; pairs with a separator, which may
    just be rare, never speak for it. Both ends then move out to the next separator, for
    a secret's last characters may look ordinary."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    place = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    state = lambda i, s, start, best, end, found: F.struct(i.alias("i"), s.alias("s"), start.alias("start"), best.alias("best"), end.alias("end"), found.alias("found"))
    zero = state(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), none)
    upto = lambda a: F.when(a.best >= STRETCH, F.concat(a.found, F.array(place(a.start, a.end)))).otherwise(a.found)

    def step(a: Column, x: Column) -> Column:
        after = a.i + 1
        over = lambda s: (s <= 0) | (s < a.best - STRETCH)
        return _let(a.s + x - PER_CHAR, lambda s: F.when(over(s), state(after, F.lit(0.0), after, F.lit(0.0), after, upto(a)))
                    .when(s > a.best, state(after, s, a.start, s, after, a.found)).otherwise(state(after, s, a.start, a.best, a.end, a.found)))

    def widened(p: Column) -> Column:
        parts = lambda text: F.translate(text, "_=-", "///")
        left = F.substring_index(parts(F.substr(word, F.lit(1), p.start)), "/", -1)
        right = F.substring_index(parts(F.substr(word, p.end + 1, F.length(word))), "/", 1)
        return place(p.start - F.length(left), p.end + F.length(right))

    def joined(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        both = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(place(F.least(last.start, p.start), F.greatest(last.end, p.end))))
        return F.when(F.size(out) == 0, F.array(p)).when(last.end + 1 >= p.start, both).otherwise(F.concat(out, F.array(p)))

    def places(codes: Column, steps: Column) -> Column:
        whole = F.aggregate(steps, F.lit(0.0), lambda total, y: total + y) >= F.greatest(F.lit(MARGIN), PER_CHAR * F.size(steps))
        between = lambda j: at(codes, j, 0).isin(*map(ord, "/_=-")) | at(codes, j, 1).isin(*map(ord, "/_=-"))
        local = F.transform(steps, lambda y, j: F.when((y > 0) & between(j), F.lit(0.0)).otherwise(y))
        parts = F.transform(F.aggregate(local, zero, step, upto), widened)
        merged = F.filter(F.aggregate(parts, none, joined), lambda q: q.end - q.start >= LEAST_RUN)
        return F.when(whole, F.array(place(F.lit(0), F.size(steps)))).otherwise(merged)

    at = lambda codes, j, k: F.when(j >= k, F.get(codes, j - k)).otherwise(0)

    def ratios(codes: Column) -> Column:
        before = lambda j, k: at(codes, j, k)
        pair = lambda code, j: F.get(table, before(j, 1) * 128 + code)
        return F.transform(codes, lambda code, j: F.when((code == before(j, 1)) & (code == before(j, 2)), F.lit(REPEAT)).otherwise(pair(code, j)))

    return _let(F.transform(F.split(word, ""), lambda c: F.ascii(c)), lambda codes: _let(ratios(codes), lambda steps: places(codes, steps)))


def _placed(found: str | Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) to a row for each row: doc_id, id_key, text_key,
    n_assign, n_access, n_hex, n_markov and ``spans``: all spans (start, rank,
    end, kind) by start, then kind.

    Base spans stay as the patterns give them and may overlap; a model's span
    overlaps no base span. Null and empty texts have none; null ids and
    repeated rows are kept; other columns are ignored; empty in, empty out."""
    found = staged(base_spans(docs), "spans")
    model = train(docs, found)
    dense = [0.0] * (128 * 128)
    for (a, b), v in model.items():
        dense[a * 128 + b] = round(v, 6)
    table = F.split(F.lit(",".join(map(str, dense))), ",").cast("array<double>")
    markov = F.flatten(F.transform("runs", lambda r: F.transform(_random(r.found, table), lambda p: F.struct((r.start + p.start).alias("start"), (r.start + p.end).alias("end")))))
    rows = found.withColumn("markov", _placed(markov, 3, "markov"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")]
    return rows.select("doc_id", "id_key", "text_key", *counts, "base", F.sort_array(F.concat("base", "markov")).alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span's text replaced by ``mask``, overlapping spans
    by one; ``n_chars``, if there, is the new length. All rows stay."""
    spans = scan(docs).where(F.size("spans") > 0).select("id_key", "text_key", F.col("spans").alias("_spans")).dropDuplicates(["id_key", "text_key"])
    rows = docs.select(F.struct(*docs.columns).alias("_row")).select("_row", *row_name("_row.doc_id", "_row.text"))
    rows = rows.join(spans, ["id_key", "text_key"], "left")
    rows = _with_cover(rows.withColumn("_old", F.col("_row.text")), "_old", "_spans", "_text", F.lit(mask))
    out = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast("long")}
    return rows.select(*[out.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), "n_markov")
