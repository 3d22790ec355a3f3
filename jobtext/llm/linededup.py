"""Line dedup by an exact set-similarity join.

A line is the set of its five-word shingles (64-bit digests; a shorter line is
one shingle of all its words). Lines match at Jaccard 0.8 or more. A line is
removed if any earlier line of the corpus (by document, then line) matches it.

Equal sets are one member of the join; sets of fewer than LEAST tokens match
only equal ones. A first prefix filter, with the tokens in digest order, leaves
the sets that share a prefix token with another set; only their tokens are
counted, by a sketch of fixed size, and ordered by rarity. Prefix, positional
and length filters then act on classes (token, length, position) before any
pair is formed, and each pair is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.llm.common import BLANK_CLASS, ROW, WORD_CLASS, documents, member, row_name, staged

WORDS = 5
#: Similarity as a fraction.
NUM, DEN = 4, 5
#: Fewest tokens of a set that another one matches: 4 of 5 are the first to reach the similarity.
LEAST = NUM // (DEN - NUM)
#: Counters of the rarity sketch, a power of two; its size does not depend on the data.
SKETCH = 1 << 14
POS = ["none", *ROW, "line_no"]


def _tokens(line: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``toks``: the distinct shingle digests, in ascending order, of a line that has words."""
    step = lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, WORDS)])

    def add(df: DataFrame) -> DataFrame:
        df = df.withColumn("_words", F.filter(F.split(line, f"{BLANK_CLASS}+"), lambda w: w != ""))
        n = F.size("_words")
        # one type without nulls, so that the numbers are sorted as such
        all_of = F.when(n >= WORDS, F.transform(F.slice("_words", F.lit(1), n - (WORDS - 1)), step)).otherwise(F.array(F.xxhash64("_words")))
        return df.withColumn("toks", F.sort_array(F.array_distinct(all_of))).drop("_words")

    return add


def _prefix(n: Column) -> Column:
    """Length of the prefix in which two matching sets must meet: n - ceil(n * NUM / DEN) + 1."""
    return n - F.floor((n * NUM + (DEN - 1)) / DEN).cast("int") + 1


def lines_of(docs: DataFrame) -> DataFrame:
    """A row per line with a word: its place, the line's digest, its set's digest, size and first tokens in digest order."""
    # split before: a text beside its lines would be copied and hashed for each of them; outer, as
    # from a plain posexplode a test of the lines is inferred, pushed down and splits the text anew
    rows = docs.select(F.col("doc_id").isNull().alias("none"), *row_name("doc_id", "text"), F.split("text", "\n").alias("_lines"))
    rows = rows.select("none", *ROW, F.posexplode_outer("_lines").alias("line_no", "line"))
    # a test of the line, not of its tokens: the latter would be pushed down and compute them anew
    rows = rows.where(F.rlike("line", F.lit(WORD_CLASS))).transform(_tokens("line"))
    return rows.select(*POS, F.xxhash64("line").alias("line_key"), F.xxhash64("toks").alias("set_key"), F.size("toks").alias("n"), F.slice("toks", F.lit(1), _prefix(F.size("toks"))).alias("head"))


def _candidates(lines: DataFrame) -> DataFrame:
    """(place, set_key, line_key): distinct sets that share a prefix token with
    another set, a line of each, and their order by first occurrence."""
    heads = lines.where(F.col("n") >= LEAST).select("set_key", F.explode("head").alias("tok"))
    shared = heads.groupBy("tok").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("tok")
    shared = staged(shared, "shared")
    some = heads.where(member(shared, "tok")(F.col("tok"))).join(shared, "tok", "left_semi").select("set_key").distinct()
    firsts = lines.groupBy("set_key").agg(F.min(F.struct(*POS)).alias("first"), F.min("line_key").alias("line_key"))
    ordered = firsts.join(some, "set_key", "left_semi").orderBy("first", "set_key")
    return staged(ordered.select(F.monotonically_increasing_id().alias("place"), "set_key", "line_key"), "candidates")


def _sets(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(place, n, toks): the candidates' whole sets, tokens by rarity.

    Rarity is a token's count among the candidates, taken from a sketch of
    SKETCH counters: those of its counter's tokens together. A rank of the
    counter replaces the token's bits that name the counter, so a token stays
    one number and distinct tokens stay distinct."""
    every = docs.select(F.explode(F.split("text", "\n")).alias("line")).withColumn("line_key", F.xxhash64("line"))
    found = every.where(member(candidates, "line_key")(F.col("line_key"))).groupBy("line_key").agg(F.min("line").alias("line"))
    rows = staged(found.join(candidates.select("place", "line_key"), "line_key").transform(_tokens("line")).select("place", "toks"), "sets")
    rest = 64 - SKETCH.bit_length() + 1
    counter = lambda t: F.shiftrightunsigned(t, rest).cast("int")
    counts = rows.select(F.explode("toks").alias("t")).groupBy(counter(F.col("t")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    seen = {r.c: r.n for r in counts.collect()}
    rank = [0] * SKETCH
    for place, c in enumerate(sorted(range(SKETCH), key=lambda c: seen.get(c, 0))):
        rank[c] = place - SKETCH // 2
    ranks = F.split(F.lit(",".join(map(str, rank))), ",").cast("array<long>")
    low = (1 << rest) - 1
    recoded = F.transform("toks", lambda t: F.shiftleft(F.get(ranks, counter(t)), rest).bitwiseOR(t.bitwiseAND(low)))
    return rows.select("place", F.size("toks").alias("n"), F.sort_array(recoded).alias("toks"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (late, early) pairs the late ones whose pair reaches the similarity."""
    late = sets.select(F.col("place").alias("late"), F.col("toks").alias("x"))
    early = sets.select(F.col("place").alias("early"), F.col("toks").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(late, "late").join(early, "early").where(DEN * both >= NUM * (F.size("x") + F.size("y") - both))
    return staged(met.select("late").distinct(), "matched")


def _preceded(sets: DataFrame) -> DataFrame:
    """(place) of the sets that match a set with an earlier place.

    Classes (token, length, position) of prefix places are paired first:
    lengths within the similarity, and no more tokens missing before and after
    the meeting than it allows. A set is compared with the earliest member of
    all classes that its own may meet; without a match there, with the earliest
    of each of them; and without one again, with all their members."""
    keys = ["tok", "n", "i"]
    index = sets.select("place", "n", F.posexplode(F.slice("toks", F.lit(1), _prefix(F.col("n")))).alias("i", "tok"))
    shared = index.groupBy("tok").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("tok")
    index = staged(index.join(shared, "tok", "left_semi"), "index")
    classes = index.groupBy(*keys).agg(F.min("place").alias("head"))
    other = classes.select("tok", F.col("n").alias("m"), F.col("i").alias("j"), "head")
    overlap = F.floor((NUM * (F.col("n") + F.col("m")) + (NUM + DEN - 1)) / (NUM + DEN))
    meets = (DEN * F.col("m") >= NUM * F.col("n")) & (DEN * F.col("n") >= NUM * F.col("m"))
    meets = meets & (1 + F.least(F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1) >= overlap)
    allowed = staged(classes.drop("head").join(other, "tok").where(meets), "classes")
    heads = index.join(allowed, keys).where("head < place").select(F.col("place").alias("late"), F.col("head").alias("early"))
    heads = staged(heads.distinct(), "heads")
    one = _verified(heads.groupBy("late").agg(F.min("early").alias("early")), sets)
    each = _verified(heads.join(one, "late", "left_anti"), sets)
    sure = one.unionAll(each)
    left = index.join(sure, index["place"] == sure["late"], "left_anti").select(F.col("place").alias("late"), *keys)
    early = index.select("tok", F.col("n").alias("m"), F.col("i").alias("j"), F.col("place").alias("early"))
    pairs = left.join(allowed.drop("head"), keys).select("late", "tok", "m", "j").join(early, ["tok", "m", "j"]).where("early < late").select("late", "early").distinct()
    return sure.unionAll(_verified(pairs.join(heads, ["late", "early"], "left_anti"), sets)).select(F.col("late").alias("place"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) to (id_key, text_key, gone): per document with removed
    lines their numbers (from 0), ascending.

    Order is by doc_id (null last), text digest, line; rows equal in id and
    text are one document. Lines without words stay; null and empty texts have
    none to remove. Other columns are ignored; empty in, empty out."""
    lines = staged(lines_of(docs.select("doc_id", "text")), "lines")
    candidates = _candidates(lines)
    gone = _preceded(_sets(docs, candidates)).join(candidates, "place").select("set_key", F.lit(True).alias("gone"))
    firsts = lines.groupBy("set_key").agg(F.min(F.struct(*POS)).alias("first"))
    known = firsts.join(gone, "set_key", "left")
    out = lines.join(known, "set_key").where((F.struct(*POS) > F.col("first")) | F.col("gone"))
    return out.groupBy(*ROW).agg(F.sort_array(F.collect_set("line_no")).alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; ``n_chars``, if there, is the new
    length. All rows stay, a text may become empty; a null text stays null."""
    gone = removed_lines(docs).withColumnRenamed("gone", "_gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row")).select("_row", *row_name("_row.doc_id", "_row.text"))
    rows = rows.join(gone, ROW, "left")
    # numbers of removed lines as a flag per line, so that a line is tested in one step
    rows = rows.withColumn("_lines", F.split("_row.text", "\n"))
    rows = rows.withColumn("_out", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>"))))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform("_out", lambda i: F.get("_lines", i)), "\n"))
    rows = rows.withColumn("_text", text)
    out = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast("long")}
    return rows.select(*[out.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of lines, of removed lines, and their numbers."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_name("doc_id", "text"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    rows = own.join(removed_lines(docs), ROW, "left")
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))
