"""Text functions as Column builders: cleaning, script detection, transliteration, tokens.

Only Unicode composition needs Python, since Spark has no function for it; an
Arrow function does it, and only for texts that are not plain ASCII.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values -----------------------------------------------------------------
# White space as Unicode has it, for classes in Java expressions.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WS}]", c))
ZERO_WIDTH = r"[\u200b-\u200f\ufeff]"
# Letters of Russian that Uzbek writing does without.
RU_MARKERS = "ЩщЫыЪъЭэ"
# Letter pairs that mark Uzbek in Latin letters.
UZ_LATIN_MARKERS = ("oʻ", "gʻ", "sh", "ch", "Oʻ", "Gʻ", "Sh", "Ch")
# Uzbek Cyrillic to Latin, letters that become two.
CYRL_DOUBLE = {"Ш": "Sh", "ш": "sh", "Ч": "Ch", "ч": "ch", "Ю": "Yu", "ю": "yu", "Я": "Ya", "я": "ya", "Ё": "Yo", "ё": "yo", "Ў": "Oʻ", "ў": "oʻ", "Ғ": "Gʻ", "ғ": "gʻ"}
# Uzbek Cyrillic to Latin, letter by letter; the soft sign vanishes.
CYRL_SINGLE = ("ҲҳҚқАаБбВвГгДдЕеЖжЗзИиЙйКкЛлМмНнОоПпРрСсТтУуФфХхЦцЪъЫыЭэЬь", "HhQqAaBbVvGgDdEeJjZzIiYyKkLlMmNnOoPpRrSsTtUuFfXxSsʼʼIiEe")
# Texts that are composed at a time.
ROWS = 64
TOKEN = r"[\p{L}\p{N}_ʻ']+"
# ------------------------------------------------------------------------------


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    # Python holds some texts of a batch at a time.
    done = [pa.array([t and unicodedata.normalize("NFC", t) for t in text.slice(a, ROWS).to_pylist()], pa.string()) for a in range(0, len(text), ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def compose(text: Column) -> Column:
    """Unicode NFC."""
    # A function's argument is computed for all rows, so plain ASCII is kept from it here.
    other = text.rlike(r"[^\x00-\x7f]")
    return F.when(other, _composed(F.when(other, text))).otherwise(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """The cleaning that follows composition: invisible marks, split words, spaces, blank lines, ends."""
    for pattern, by in ((ZERO_WIDTH, ""), (f"-[{WS}]*\n[{WS}]*", ""), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def clean_whitespace(text: Column) -> Column:
    return squeeze(compose(text))


def detect_script(text: Column, sample: int = 500) -> Column:
    """uz-latn, uz-cyrl, ru, en or mixed, judged by the first characters."""
    head = F.substring(text, 1, sample)
    cyrillic, latin, russian = (F.regexp_count(head, F.lit(p)) for p in ("[Ѐ-ӿ]", "[A-z]", f"[{RU_MARKERS}]"))
    marked = head.rlike("|".join(UZ_LATIN_MARKERS))
    return (
        F.when((cyrillic == 0) & (latin > 0), F.when(marked, "uz-latn").otherwise("en"))
        .when((latin == 0) & (cyrillic > 0), F.when(russian > 0.02 * cyrillic, "ru").otherwise("uz-cyrl"))
        .otherwise("mixed")
    )


def to_latin(text: Column) -> Column:
    """Uzbek Cyrillic letters in Latin; other characters stay."""
    for letter, two in CYRL_DOUBLE.items():
        text = F.replace(text, F.lit(letter), F.lit(two))
    return F.translate(text, *CYRL_SINGLE)


def normalize(text: Column, latin: bool = True) -> Column:
    """A struct of the cleaned text and its language hint; Uzbek Cyrillic becomes Latin unless told not to."""

    def hinted(clean: Column) -> Column:
        return F.struct(clean.alias("text"), detect_script(clean).alias("hint"))

    def turned(s: Column) -> Column:
        turn = (s["hint"] == "uz-cyrl") & F.lit(latin)
        return F.struct(F.when(turn, to_latin(s["text"])).otherwise(s["text"]).alias("text"), F.when(turn, "uz-latn").otherwise(s["hint"]).alias("hint"))

    # Each step of one element, so that what it gives is computed once.
    return F.transform(F.transform(F.array(clean_whitespace(text)), hinted), turned)[0]


def tokens(text: Column) -> Column:
    """Lower-cased words; apostrophes stay inside."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def preview(text: Column, n: int) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))
