"""Arrow functions for what no built-in expresses: Unicode normal forms, sequence similarity, character entities."""

from __future__ import annotations

import difflib
import html
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """Compatibility forms composed (NFKC), case folded; null stays null."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


@pandas_udf(StringType())
def ascii_only(values: pd.Series) -> pd.Series:
    """What is left in ASCII of the decomposed form (NFKD); null stays null."""
    return values.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")


@pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """Character entities read; null stays null."""
    return values.map(html.unescape, na_action="ignore")


def surface_key(c: Column | str) -> Column:
    """Key under which spellings of a term fall together: Latin and Greek letters, digits and plus signs, the rest blanks."""
    own = F.coalesce(folded(c), F.lit(""))
    return F.trim(F.regexp_replace(own, "[^0-9a-zα-ω+]+", " "))


def plain_text(c: Column | str) -> Column:
    """Without entities and tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(unescaped(c), F.lit("")), "<[^>]+>", ""), r"(?U)\s+", " "))


#: The project of what has none, and slugs that no project may have.
DEFAULT_PROJECT, RESERVED = "default", ("all", "global", "none")


def slug(c: Column | str) -> Column:
    """The slug of a project's name: the default where the name is blank, a hash of it where nothing is left of it in ASCII,
    null where it is reserved."""
    raw = F.trim(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    kept = F.substring(F.btrim(F.regexp_replace(F.lower(ascii_only(raw)), "[^a-z0-9]+", "-"), F.lit("-")), 1, 64)
    named = F.when(raw == "", DEFAULT_PROJECT).when(kept == "", F.concat(F.lit("project-"), F.substring(F.sha1(raw), 1, 10))).otherwise(kept)
    return F.when(~named.isin(*RESERVED), named)


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-blocks similarity of two keys; 0 where one is empty."""
    out, memo = [], {}
    for x, y in zip(a, b, strict=True):
        if not x or not y:
            out.append(0.0)
            continue
        if (x, y) not in memo:
            memo[x, y] = 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
        out.append(memo[x, y])
    return pd.Series(out)


def _token_set(x: str | None, y: str | None) -> float:
    s, t = set((x or "").split()), set((y or "").split())
    if not s or not t:
        return 0.0
    both, left, right = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
    one_side, other = f"{both} {left}".strip(), f"{both} {right}".strip()
    pairs = [(one_side, other)] + ([(both, one_side), (both, other)] if both else [])
    return max(difflib.SequenceMatcher(None, p, q).ratio() for p, q in pairs)


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two sets of words in percent, whatever their order and repetition."""
    return pd.Series([100.0 * _token_set(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two keys the greater of block similarity and .65 token-set and .35 plain similarity; 0 where one is empty."""
    memo: dict[tuple[str, str], float] = {}

    def one(x: str | None, y: str | None) -> float:
        if not x or not y:
            return 0.0
        if (x, y) not in memo:
            ratio = difflib.SequenceMatcher(None, x, y).ratio()
            memo[x, y] = max(ratio, 0.65 * _token_set(x, y) + 0.35 * ratio)
        return memo[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@pandas_udf(StringType())
def stable_json(values: pd.Series) -> pd.Series:
    """JSON texts with sorted keys and no blanks, so that equal values have equal texts; null where a text is no JSON."""

    def one(v: str) -> str | None:
        try:
            return json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return values.map(one, na_action="ignore")


def json_hash(c: Column | str) -> Column:
    return F.sha2(stable_json(c), 256)
