"""Text scalars as native Spark columns (no Python per row).

Word and space classes are spelled out as Unicode properties so that the
JVM regex engine agrees with Python's Unicode ``\\w`` / ``\\s`` on Latin,
Greek and Cyrillic text; the same class strings are valid RE2, which keeps
the DuckDB oracle in step.
"""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from jobtext import taxonomy as tx

# Word character and whitespace character classes (bodies, without brackets).
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}"
WORD = f"[{WORD_CHARS}]"
NOT_WORD = f"[^{WORD_CHARS}]"
SPACE_RUN = f"[{SPACE_CHARS}]+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The characters of SPACE_CHARS, listed: control whitespace plus every code
# point of the Unicode separator categories (Zs, Zl, Zp) — the \\p{Z} class.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" + "".join(
    chr(c) for c in range(0x3001) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp"))


def strip_unicode(col: Column | str) -> Column:
    """Strip leading/trailing whitespace of any Unicode kind (a two-sided trim
    over the whitespace set: work only at the ends, not a scan of the text)."""
    return F.trim(_c(col), F.lit(WHITESPACE))


def collapse_spaces(col: Column | str) -> Column:
    """Whitespace runs -> one space, then strip."""
    return F.trim(F.regexp_replace(_c(col), SPACE_RUN, " "))


def clean_text(col: Column | str) -> Column:
    """lower; anything but word, space, + # . / \\ - becomes a space; collapse; strip."""
    lowered = F.lower(_c(col))
    kept = F.regexp_replace(lowered, f"[^{WORD_CHARS}{SPACE_CHARS}+#./\\\\-]", " ")
    return collapse_spaces(kept)


def training_text(col: Column | str) -> Column:
    """the trainer only lower-cases."""
    return F.lower(_c(col))


def tokens(col: Column | str, min_len: int = 2) -> Column:
    """M1 tokens: runs of at least ``min_len`` word characters, in text order."""
    return F.regexp_extract_all(_c(col), F.lit(f"{WORD}{{{min_len},}}"), 0)


def word_runs(col: Column | str) -> Column:
    """All maximal runs of word characters (skill lookup tokens)."""
    return F.regexp_extract_all(_c(col), F.lit(f"{WORD}+"), 0)


def bounded(literal: str) -> str:
    """regex for ``literal`` not glued to word characters on either side."""
    return f"(?<!{WORD})\\Q{literal}\\E(?!{WORD})"


def normalize_title(col: Column | str) -> Column:
    """null -> '', whitespace collapsed, stripped, lower-cased."""
    return F.lower(collapse_spaces(F.coalesce(_c(col), F.lit(""))))


_AT_LEAST = r"(?iu)at least[" + SPACE_CHARS + r"]+([0-9]+)[" + SPACE_CHARS + r"]*year"
_RANGE = r"(?iu)([0-9]+)[" + SPACE_CHARS + r"]*to[" + SPACE_CHARS + r"]*([0-9]+)[" + SPACE_CHARS + r"]*years?"


def parse_min_years(col: Column | str) -> Column:
    """'at least N year' -> N, else 'N to M year(s)' -> N, else null (double)."""
    c = _c(col)
    first = F.regexp_extract(c, _AT_LEAST, 1)
    second = F.regexp_extract(c, _RANGE, 1)
    pick = F.when(first != "", first).when(second != "", second)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")).otherwise(pick.cast("double"))


def bucket_by_years(years: Column | str) -> Column:
    """< 1 intern, <= 2 junior, <= 5 middle, else senior (null stays null)."""
    y = _c(years)
    return (
        F.when(y.isNull(), F.lit(None).cast("string"))
        .when(y < 1, "intern")
        .when(y <= 2, "junior")
        .when(y <= 5, "middle")
        .otherwise("senior")
    )


def title_override(title: Column | str) -> Column:
    """first title-word rule that matches, else null."""
    t = F.coalesce(_c(title), F.lit(""))
    out = F.lit(None).cast("string")
    for word, level in reversed(tx.TITLE_LEVEL_RULES):
        out = F.when(t.rlike("(?iu)" + bounded(word)), F.lit(level)).otherwise(out)
    return out


def detect_level(title: Column | str, experience: Column | str) -> Column:
    """title override, else bucket of the minimum years, else 'middle'."""
    return F.coalesce(title_override(title), bucket_by_years(parse_min_years(experience)), F.lit("middle"))


def is_level_fallback(title: Column | str, experience: Column | str) -> Column:
    return title_override(title).isNull() & parse_min_years(experience).isNull()


# one token of a list literal: a plainly quoted string, a bracket or comma, a
# run of other characters, or a quote without its end; blanks between are passed over
_TOKEN = r"""'[^'\\\n\r]*+'|"[^"\\\n\r]*+"|[\[\],]|[^'"\[\], \t]++|['"]"""


@F.pandas_udf(ArrayType(StringType()))
def _literal_items(values: pd.Series) -> pd.Series:
    """Items of any other list literal, as text, None left out; null if it is none."""
    def items(v):
        try:
            got = ast.literal_eval(v) if v is not None else None
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None
        return [str(x) for x in got if x is not None] if isinstance(got, list) else None

    return values.map(items, na_action="ignore").astype(object).where(values.notna(), None)


def _plain_items(tokens: Column) -> Column:
    """Quoted items of the tokens of a list literal, null if they are none:
    a bracket, items (quoted strings or None) at every second place with commas
    between them and perhaps one at the end, a bracket."""
    n = F.size(tokens)
    quoted = lambda t: (F.length(t) > 1) & F.substring(t, 1, 1).isin("'", '"')
    inner = F.slice(tokens, F.lit(2), F.greatest(n - 2, F.lit(0)))
    wrong = F.filter(inner, lambda t, i: F.when(i % 2 == 0, ~(quoted(t) | (t == "None"))).otherwise(t != ","))
    closed = (n > 1) & (F.get(tokens, F.lit(0)) == "[") & (F.get(tokens, n - 1) == "]")
    items = F.transform(F.filter(inner, quoted), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    return F.when(closed & (F.size(wrong) == 0), items)


def parse_list_literal(col: Column | str) -> Column:
    """a list literal such as "['A', 'B']" -> array of its non-null items;
    anything that is not a list literal -> null. The usual spelling, of any
    number of items, is cut into tokens by a flat pattern and its grammar is
    checked by the tokens' places, in one pass and without a stack; only other
    values that begin like a list go, in Arrow batches, to an exact parser."""
    c = _c(col)
    listed = F.when(c.rlike(r"^[ \t]*\["), c)
    # a lambda over one element names the tokens, so they are made once
    plain = F.get(F.transform(F.array(F.regexp_extract_all(listed, F.lit(_TOKEN), F.lit(0))), _plain_items), F.lit(0))
    return F.coalesce(plain, _literal_items(F.when(plain.isNull(), listed)))


def clean_value(col: Column | str) -> Column:
    """F16: null -> ''; a list literal is joined by ', '; literal and real
    newlines become spaces; whitespace collapsed; stripped."""
    c = _c(col).cast("string")
    text = F.coalesce(F.array_join(parse_list_literal(c), ", "), c)
    text = F.regexp_replace(F.regexp_replace(text, r"\\n", " "), "\n", " ")
    return F.coalesce(collapse_spaces(text), F.lit(""))


def assemble_text(columns: list[Column | str]) -> Column:
    """cleaned non-empty parts joined by a single space."""
    parts = [F.nullif(clean_value(c), F.lit("")) for c in columns]
    return F.concat_ws(" ", *parts)


def fingerprint(text: Column | str, version: Column | str) -> Column:
    """sha-256 hex of 'version:strip(lower(text))'; a str version is a literal."""
    v = F.lit(version) if isinstance(version, str) else version
    return F.sha2(F.concat(v, F.lit(":"), strip_unicode(F.lower(_c(text)))), 256)


def is_uuid(col: Column | str) -> Column:
    """accepts the usual UUID spellings (hyphens optional, braces, urn:uuid:)."""
    c = _c(col)
    core = F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^\{+|\}+$", "")
    core = F.regexp_replace(core, "-", "")
    return F.coalesce(core.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))
