"""Column functions on text: white space, blocks, words, trigrams, fingerprints. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 white-space code points of Unicode text matching, and the character ranges of CJK scripts.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
TOKEN = rf"[\p{{L}}\p{{N}}_{CJK}]+"


def nfkc(text: Column) -> Column:
    """NFKC form, by the ICU library that Spark comes with; no text leaves the JVM."""
    return F.when(text.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def blocks_raw(text: Column) -> Column:
    """Text between line breaks or runs of white space, trimmed, without empty ones."""
    parts = F.split(text, rf"\n+|[{WS}]{{2,}}")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, f"^[{WS}]+|[{WS}]+$", "")), lambda p: p != "")


def blocks(text: Column) -> Column:
    """Normalised blocks: lower case, white space collapsed; repeated blocks and their order stay."""
    return F.transform(blocks_raw(text), lambda p: collapse(F.lower(p)))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def word_count(clean: Column) -> Column:
    """Words of a text whose white space is collapsed."""
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def _characters(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, f"[{WS}]+", ""), ""), lambda c: c != "")


def _windows(text: Column, n: int, join) -> Column:
    """Runs of n characters; the characters are worked out n times, not once a run."""
    first = _characters(text)
    out = first
    for k in range(1, n):
        out = F.zip_with(out, F.slice(_characters(text), k + 1, F.length(text) + 1), join)
    return F.array_distinct(F.filter(out, lambda g: g.isNotNull()))


def trigrams(text: Column) -> Column:
    """The set of runs of three characters once white space is out; case stays."""
    return _windows(text, 3, lambda a, b: F.concat(a, b))


def trigram_codes(text: Column) -> Column:
    """The set of trigrams, each as one number of 63 bits (21 for each code point), so that sets compare fast."""
    codes = F.transform(_characters(text), lambda c: F.ascii(c).cast("bigint"))

    def grams(own: Column) -> Column:
        after = [F.slice(own, k, F.size(own)) for k in (2, 3)]
        pairs = F.zip_with(own, after[0], lambda a, b: F.shiftleft(a, 21).bitwiseOR(b))
        return F.zip_with(pairs, after[1], lambda a, b: F.shiftleft(a, 21).bitwiseOR(b))

    once = F.get(F.transform(F.array(codes), grams), F.lit(0))  # the characters are worked out once
    return F.array_distinct(F.filter(once, lambda g: g.isNotNull()))


def hashes(values: Column) -> Column:
    """64-bit hash of each element; repeated elements stay."""
    return F.transform(values, lambda v: F.xxhash64(v))


def markdown_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
