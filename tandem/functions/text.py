"""Text expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.fixed_values import PUNCTUATION, STRIP_CHARACTERS, WORD_MARK


def strip(col: Column) -> Column:
    """Python's ``str.strip()``: Spark's ``trim`` alone removes only spaces."""
    return F.btrim(col, F.lit(STRIP_CHARACTERS))


def count_in_set(col: Column, charset: str | Column) -> Column:
    """How many characters of ``col`` belong to ``charset``."""
    chars = charset if isinstance(charset, Column) else F.lit(charset)
    return F.length(col) - F.length(F.call_function("translate", col, chars, F.lit("")))


def count_punct(col: Column, charset: str = PUNCTUATION) -> Column:
    return count_in_set(col, charset)


def characters(col: Column) -> Column:
    """Array of single characters; empty text gives an empty array."""
    return F.filter(F.split(col, ""), lambda ch: ch != "")


def words(col: Column) -> Column:
    """Space-separated words without empty entries."""
    return F.filter(F.split(col, " "), lambda w: w != "")


def word_pieces(col: Column) -> Column:
    """Word-level pieces: each word carries the word mark."""
    return F.transform(words(col), lambda w: F.concat(F.lit(WORD_MARK), w))


def char_pieces(col: Column) -> Column:
    """Character-level pieces: the word mark opens each word and stands alone."""
    marked = F.array_join(word_pieces(col), "")
    return characters(marked)


def decode_pieces(pieces: Column) -> Column:
    """Pieces back to text."""
    return F.ltrim(F.replace(F.array_join(pieces, ""), F.lit(WORD_MARK), F.lit(" ")))


def strip_lang_tag(col: Column) -> Column:
    """Remove the first ``__xx__ `` of a line, wherever it stands."""
    return F.regexp_replace(col, r"^(.*?)__[a-zA-Z_]*__ ", "$1")


def lang_tag(lang: Column) -> Column:
    return F.concat(F.lit("__"), lang, F.lit("__"))


def to_base2(score: Column) -> Column:
    """Natural-log score to base 2."""
    return score / F.log(F.lit(2.0))


def round2(col: Column) -> Column:
    """Python's ``round(x, 2)``: the nearest hundredth of the exact binary value, ties to even.

    ``x*200`` is compared with an odd integer without rounding error by splitting
    ``x`` into two halves whose products with 200 are exact.
    """
    x = col.cast("double")
    big = x * 134217729.0
    high = big - (big - x)
    low = x - high
    base = F.floor(x * 100.0).cast("double")
    # floor(x*100) may be off by one through the rounding of x*100
    base = base + F.when((high * 100.0 - (base + 1.0)) + low * 100.0 >= 0, 1.0).when(
        (high * 100.0 - base) + low * 100.0 < 0, -1.0
    ).otherwise(0.0)
    excess = (high * 200.0 - (base * 2.0 + 1.0)) + low * 200.0
    up = (excess > 0) | ((excess == 0) & (F.pmod(base, F.lit(2.0)) == 1.0))
    return F.when(up, base + 1.0).otherwise(base) / 100.0


# Detokenisation rules, applied in order. Each entry: language codes (None = all), pattern, replacement.
_SPACE_BEFORE = r" +([,.?!:;\\%}\])]+)(?= |$)"
_ENTITIES = [("&bar;", "|"), ("&#124;", "|"), ("&lt;", "<"), ("&gt;", ">"), ("&bra;", "["), ("&ket;", "]"),
             ("&quot;", '"'), ("&apos;", "'"), ("&#91;", "["), ("&#93;", "]"), ("&amp;", "&")]
_ELISION = ["fr", "it", "ga", "ca"]
_CJK = "ᄀ-ᇿ⺀-꓏ꡀ-꡿가-힯豈-﫿︰-﹏･-ￜ"


def detokenize(col: Column, lang: Column) -> Column:
    """Undo word tokenisation with ordered rules per language group.

    Joined hyphens and escaped characters are restored, closing punctuation and
    brackets attach to the left (French keeps a space before ``? ! : ; %``),
    opening ones and currency signs to the right, English contractions and
    Romance elisions lose their gap, straight quotes attach inwards in pairs, and
    ideographs lose the spaces between them except in Korean.
    """
    out = F.replace(col, F.lit(" @-@ "), F.lit("-"))
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.when(lang == "ko", out).otherwise(
        F.regexp_replace(out, f"([{_CJK}]) (?=[{_CJK}])", "$1")
    )
    french = F.regexp_replace(out, r" +([,.}\])]+)(?= |$)", "$1")
    out = F.when(lang == "fr", french).otherwise(F.regexp_replace(out, _SPACE_BEFORE, "$1"))
    out = F.regexp_replace(out, r"(^| )([\p{Sc}(\[{¿¡]+) +", "$1$2")
    out = F.when(lang == "en", F.regexp_replace(out, r" +('\p{L})", "$1")).otherwise(out)
    out = F.when(lang.isin(_ELISION), F.regexp_replace(out, r"(\p{L}') +(?=\p{L})", "$1")).otherwise(out)
    out = F.regexp_replace(out, r'(^| )" +([^"]*[^" ]) +"(?=[ ,.?!:;)\]}]|$)', '$1"$2"')
    return F.trim(F.regexp_replace(out, " +", " "))
