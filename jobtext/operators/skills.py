"""J3 — dictionary skill extraction.

The rule is "a spelling occurs in the lower-cased text and is not glued to
word characters on either side"; a skill is reported once, skills come out
in dictionary order.

Plan: a spelling made only of word characters occurs with that boundary
exactly when it equals one maximal run of word characters.  So the text is
split into word runs once, and all such spellings are looked up together by
one hash-set intersection (``array_intersect``) against the dictionary.  Only
the few spellings with spaces or punctuation (``c++``, ``node.js``,
``rest api`` …) remain regex searches.  Everything is a per-row projection:
no explode, no shuffle, the dictionary travels as literals inside the plan
(its size is fixed by the dictionary, not by the data).

A dictionary that is a table, of any length, is joined instead: text and
spellings are cut into tokens (word runs, other characters one by one), a
spelling is looked up by its first token and compared token by token, so the
plan does not grow with it (``extract_skills_by_table``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.text import NOT_WORD, WORD, bounded, word_runs
from jobtext.session import materialize

_ALL_WORD = re.compile(r"^[^\W]+$", re.UNICODE)


def _is_word_only(variant: str) -> bool:
    return bool(_ALL_WORD.match(variant))


def _lookup(hits: Column, low: Column, dictionary: dict[str, list[str]]) -> Column:
    """Skill names (dictionary order) from the word-run hit set and phrase regexes."""
    found = []
    for name, variants in dictionary.items():
        conds = []
        for v in variants:
            if _is_word_only(v):
                conds.append(F.array_contains(hits, F.lit(v)))
            else:  # cheap substring test first; the boundary regex only runs on candidates
                conds.append(low.contains(F.lit(v)) & low.rlike(bounded(v)))
        cond = conds[0]
        for c in conds[1:]:
            cond = cond | c
        found.append(F.when(cond, F.lit(name)))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def extract_skills(df: DataFrame, text_col: str = "text", out_col: str = "skills",
                   dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``out_col`` = skills found in ``text_col``.

    Staged projections: the lower-cased text and the hit set are separate
    columns, so the optimizer keeps each computed once per row (it does not
    inline a non-trivial expression into several consumers).
    """
    dictionary = dictionary or tx.SKILLS_DICTIONARY
    word_variants = sorted({v for vs in dictionary.values() for v in vs if _is_word_only(v)})
    low, hits = "_skills_low", "_skills_hits"
    out = df.withColumn(low, F.lower(F.col(text_col)))
    out = out.withColumn(hits, F.array_intersect(word_runs(F.col(low)), F.array(*[F.lit(v) for v in word_variants])))
    out = out.withColumn(out_col, _lookup(F.col(hits), F.col(low), dictionary))
    return out.drop(low, hits)


#: Spellings that are broadcast at most: some 100 MB.
MAX_SPELLINGS = 1_000_000


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+|(?s){NOT_WORD}"), F.lit(0))


def _wordless(token: Column) -> Column:
    return ~F.rlike(token, F.lit(f"^{WORD}"))


def extract_skills_by_table(df: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "skills") -> DataFrame:
    """(id, skills) by a dictionary table (name, spelling); skills are sorted by
    name. The rule is that of ``extract_skills``; spellings are lower-case.

    A spelling that begins (ends) with a word character begins (ends) with a
    whole word run when its tokens are equal; one that does not must not follow
    (precede) a word run. Up to MAX_SPELLINGS the dictionary goes to every task
    and positions without a spelling end there; beyond, positions are shuffled
    by their token with the few tokens that follow. Null texts have no skills;
    empty spellings match nothing; ids name rows."""
    toks = _tokens(F.col("spelling"))
    words = dictionary.where("spelling <> ''").distinct().select("name", "spelling", toks.alias("_t"))
    words = materialize(words.select("name", "spelling", F.get("_t", F.lit(0)).alias("_first"), F.size("_t").alias("_n"), _wordless(F.get("_t", F.lit(0))).alias("_open"),
                                     _wordless(F.get("_t", F.size("_t") - 1)).alias("_end")))
    small = words.limit(MAX_SPELLINGS + 1).count() <= MAX_SPELLINGS
    longest = words.agg(F.max("_n")).first()[0] or 1
    rows = df.select(F.col(id_col).alias("_id"), _tokens(F.lower(F.col(text_col))).alias("_toks"))
    rows = rows.select("_id", "_toks", F.posexplode("_toks").alias("_i", "_tok"))
    before, window = F.get("_toks", F.col("_i") - 1), F.slice("_toks", F.col("_i") + 1, F.lit(longest + 1))
    if small:
        found = rows.join(F.broadcast(words), F.col("_tok") == F.col("_first")).withColumn("_before", before).withColumn("_window", window)
    else:
        found = rows.select("_id", "_tok", before.alias("_before"), window.alias("_window")).join(words.hint("merge"), F.col("_tok") == F.col("_first"))
    same = F.array_join(F.slice("_window", F.lit(1), F.col("_n")), "") == F.col("spelling")
    after = F.get("_window", F.col("_n"))
    apart = (~F.col("_open") | F.col("_before").isNull() | _wordless(F.col("_before"))) & (~F.col("_end") | after.isNull() | _wordless(after))
    names = found.where(same & apart).select("_id", "name").distinct().groupBy("_id").agg(F.sort_array(F.collect_list("name")).alias(out_col))
    return df.select(F.col(id_col)).join(names, F.col(id_col).eqNullSafe(F.col("_id")), "left").select(id_col, F.coalesce(out_col, F.array().cast("array<string>")).alias(out_col))
