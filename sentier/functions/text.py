"""Scalar text expressions (F1-F11, F20, F23). All built-in, codegen'd."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentier import constants as K

# --- fixed values: Latin-1 letters and their NFKD base letters (53 pairs); the
# usual texts need no more, other letters are decomposed in full.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
UNACCENTED = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank(c) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def capitalize_first(c) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def place_address(a1, a2, postal, commune) -> Column:
    """four parts joined by spaces, whitespace runs collapsed, trimmed."""
    joined = F.concat_ws(" ", _blank(a1), _blank(a2), _blank(postal), _blank(commune))
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def restaurant_address(a1, a2, postal, commune) -> Column:
    """same parts, joined by single spaces, no collapsing."""
    return F.concat_ws(" ", _blank(a1), _blank(a2), _blank(postal), _blank(commune))


def strip_ws(c) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def first_photo(photo, placeholder: str = K.NO_PHOTO) -> Column:
    """F3 (catalogue pages): first ``' ## '`` item, stripped, cut at the first
    space; kept only if it starts with http:// or https://."""
    p = _c(photo)
    first = F.split_part(strip_ws(F.split_part(p, F.lit(" ## "), F.lit(1))), F.lit(" "), F.lit(1))
    ok = p.isNotNull() & (p != "") & first.rlike("^https?://")
    return F.when(ok, first).otherwise(F.lit(placeholder))


def first_photo_raw(photo, placeholder: str = K.NO_PHOTO) -> Column:
    """F3 (recommendations): first ``' ## '`` item as is, placeholder if null."""
    p = _c(photo)
    return F.when(p.isNull(), F.lit(placeholder)).otherwise(F.split_part(p, F.lit(" ## "), F.lit(1)))


def split_list(c, sep: str = " ## ") -> Column:
    """a separated list as ``array<string>``; null gives []."""
    c = _c(c)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(
        F.split(c, F.lit(_regex_quote(sep))))


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in s)


def feature_text(*cols) -> Column:
    """columns joined by one space; nulls are skipped (the app printed
    'nan' for them; we drop it deliberately)."""
    return F.concat_ws(" ", *[_c(c).cast("string") for c in cols])


def _base_letters(form: str, marks):
    """Arrow UDF: decompose, then drop the characters that ``marks`` names."""
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else "".join(
            ch for ch in unicodedata.normalize(form, t) if not marks(ch)))
    return run


_nfkd = _base_letters("NFKD", lambda ch: unicodedata.combining(ch) != 0)
_nfd = _base_letters("NFD", lambda ch: "\u0300" <= ch <= "\u036f")


def _stripped(c, rest) -> Column:
    """Base letters. Only texts with characters beyond ASCII and the table go
    to Python."""
    plain = F.translate(_c(c), ACCENTED, UNACCENTED)
    return F.when(plain.rlike(r"[^\x00-\x7F]"), rest(_c(c))).otherwise(plain)


def theme_key(c) -> Column:
    """F8: NFKD key of a theme name: spaces to '_', drop '/()', drop accents."""
    return F.regexp_replace(F.regexp_replace(_stripped(c, _nfkd), " ", "_"), r"[/()]", "")


def slug(c) -> Column:
    """accents stripped (NFD), non-alphanumerics dropped, whitespace runs to
    '_', lower case."""
    s = F.regexp_replace(_stripped(c, _nfd), r"[^a-zA-Z0-9\s]", "")
    return F.lower(F.regexp_replace(s, r"\s+", "_"))


def teaser_chars(c, n: int = K.TEASER_CHARS) -> Column:
    """First ``n`` characters + '...' (Jinja truncate filter shape)."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def teaser_words(c, n: int = K.TEASER_WORDS) -> Column:
    """First ``n`` space-separated words + '...' when longer."""
    words = F.split(_c(c), " ")
    return F.when(F.size(words) > n,
                  F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("..."))).otherwise(_c(c))


def name_matches(name, query: str, regex: bool = True) -> Column:
    """Case-insensitive contains, nulls false. ``regex=True`` treats the
    query as a regular expression like the app; otherwise a literal."""
    n = _c(name)
    if regex:
        hit = n.rlike("(?iu)" + query)
    else:
        hit = F.lower(n).contains(query.lower())
    return F.coalesce(hit, F.lit(False))


def _without_nan(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(dt, T.StructType):
        inner = F.struct(*[_without_nan(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
        return F.when(c.isNotNull(), inner) if dt.fields else c
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _without_nan(x, dt.elementType))
    return c


def json_clean(df: DataFrame, cols: list[str]) -> Column:
    """a record as JSON with null and NaN fields left out, at any depth."""
    fields = [_without_nan(F.col(c), df.schema[c].dataType).alias(c) for c in cols]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
