"""Scalar text functions as column expressions; pandas UDFs only where Spark has no equivalent."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_ALNUM = r"[^\p{L}\p{N}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_name(x: Column | str) -> Column:
    """Letters and digits lower-cased, all else a single space; accents stay."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(col(x), NOT_ALNUM, " ")), " +", " "))


def to_key(x: Column | str) -> Column:
    """``normalize_name`` without spaces."""
    return F.replace(normalize_name(x), F.lit(" "), F.lit(""))


def _fold(s: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(flat.casefold().split())


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility form without marks, case-folded, white space collapsed."""
    return s.map(_fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


#: Generic words of franchise names, without accents (fixed values).
FRANCHISE_WORDS = (
    "collection", "universe", "franchise", "saga",
    "trilogy", "duology", "tetralogy", "quadrilogy", "pentalogy", "hexalogy", "heptalogy",
    "film", "films", "movie", "movies", "series", "cinematic",
    "univers", "trilogie", "duologie", "tetralogie", "quadrilogie",
    "pentalogie", "hexalogie", "heptalogie", "serie", "cinematographique",
)


def strip_words(normalized: Column | str, words: tuple[str, ...] = FRANCHISE_WORDS) -> Column:
    """Drop whole words, accents aside, from a normalised name, unless nothing would be left."""
    parts = F.split(col(normalized), " ")
    kept = F.array_join(F.filter(parts, lambda w: ~F.translate(w, "éèêâàùôî", "eeeaauoi").isin(*words)), " ")
    return F.when(kept == "", col(normalized)).otherwise(kept)


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def sql_quoted(x: Column | str) -> Column:
    return F.replace(col(x), F.lit("'"), F.lit("''"))


def normalize_question(x: Column | str) -> Column:
    """Trimmed, typographic apostrophes made plain, runs of spaces one space."""
    return F.trim(F.regexp_replace(F.translate(col(x), "’‘ʼ`", "''''"), " {2,}", " "))


def collapse_descriptor(x: Column | str, words: tuple[str, ...] = ("collection", "saga", "universe", "franchise", "trilogy")) -> Column:
    """A descriptor said twice at the end is said once; singular and plural count as the same word."""
    out = col(x)
    for w in words:
        stem = w[:-1] + "(?:y|ies)" if w.endswith("y") else w + "s?"
        out = F.regexp_replace(out, rf"(?i)\b({stem})(?:\s+{stem})+\s*$", "$1")
    return out


def singularize(x: Column | str) -> Column:
    """The last word's ``ies`` becomes ``y``, a last ``s`` goes unless it is ``ss``."""
    c = col(x)
    return F.when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y")).when(c.rlike("[^s]s$"), F.regexp_replace(c, "s$", "")).otherwise(c)


def version_key(x: Column | str) -> Column:
    """1.1.9 becomes 001.001.009, so that versions sort as text."""
    return F.array_join(F.transform(F.split(col(x), r"\."), lambda p: F.lpad(p, 3, "0")), ".")


def compare_versions(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1."""
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def days_ago(n: int, today: Column | None = None) -> Column:
    """The date ``n`` days before ``today``."""
    return F.date_sub(F.current_date() if today is None else today, n)


def tolerant_json(x: Column | str, schema: str) -> Column:
    """A JSON object by its schema: fences and text around the outermost braces are dropped, what can't be read is null."""
    inner = F.regexp_extract(col(x), r"(?s)(\{.*\})", 1)
    return F.when(inner != "", F.from_json(inner, schema, {"mode": "PERMISSIVE"}))


def duration_text(seconds: Column | str) -> Column:
    """Seconds as ``2 days, 3 hours, 4 minutes, 5 seconds``; zero parts are left out."""
    s = col(seconds).cast("long")
    parts = [(F.floor(s / 86400), "day"), (F.floor(s % 86400 / 3600), "hour"), (F.floor(s % 3600 / 60), "minute"), (s % 60, "second")]
    said = [F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + unit), F.when(n > 1, "s").otherwise(""))) for n, unit in parts]
    return F.when(s == 0, "0 seconds").otherwise(F.concat_ws(", ", *said))


#: Families of scripts in the order in which they are tried, with their blocks (fixed values).
SCRIPTS = {
    "Hangul": ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)),
    "Japanese": ((0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF)),
    "Chinese": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF)),
    "Cyrillic": ((0x0400, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Greek": ((0x0370, 0x03FF),),
    "Armenian": ((0x0530, 0x058F),),
    "Georgian": ((0x10A0, 0x10FF), (0x2D00, 0x2D2F)),
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)),
    "Hebrew": ((0x0590, 0x05FF),),
    "Devanagari": ((0x0900, 0x097F),),
    "Bengali": ((0x0980, 0x09FF),),
    "Tamil": ((0x0B80, 0x0BFF),),
    "Telugu": ((0x0C00, 0x0C7F),),
    "Kannada": ((0x0C80, 0x0CFF),),
    "Malayalam": ((0x0D00, 0x0D7F),),
    "Sinhala": ((0x0D80, 0x0DFF),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Khmer": ((0x1780, 0x17FF),),
    "Ethiopic": ((0x1200, 0x137F), (0x1380, 0x139F)),
}


def script(x: Column | str) -> Column:
    """The first family that occurs; ``Latin`` for other text, '' for blank or null text."""
    c = col(x)
    out = F.when(c.isNull() | (F.trim(c) == ""), "")
    for name, blocks in SCRIPTS.items():
        chars = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in blocks)
        out = out.when(c.rlike(f"[{chars}]"), name)
    return out.otherwise("Latin")


def video_urls(site: Column | str, key: Column | str) -> tuple[Column, Column, Column]:
    """Watch, embed and thumbnail addresses of a video on a known site."""
    s, k = F.lower(col(site)), col(key)
    watch = F.when(s == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), k)).when(s == "vimeo", F.concat(F.lit("https://vimeo.com/"), k))
    embed = F.when(s == "youtube", F.concat(F.lit("https://www.youtube.com/embed/"), k)).when(s == "vimeo", F.concat(F.lit("https://player.vimeo.com/video/"), k))
    thumb = F.when(s == "youtube", F.concat(F.lit("https://img.youtube.com/vi/"), k, F.lit("/hqdefault.jpg")))
    return watch, embed, thumb


def localized(base: Column | str, french: Column | str, lang: str) -> Column:
    """The French text if French is asked for and it isn't blank."""
    if lang != "fr":
        return col(base)
    return F.coalesce(F.when(F.trim(col(french)) != "", col(french)), col(base))
