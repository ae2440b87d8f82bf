"""Line-first cleaning, in DataFrame expressions only.

Each line that has a word meets three rules: punctuation (some sentence mark), navigation (few separators or
decoration marks per word) and boilerplate (no stock phrase).  Lines that fail go; a document goes when the lines
that stay hold less than MIN_LEFT of its text.  The base measures (dup lines, repeated 5-word windows) are exact
up to 64-bit hashes of windows of one text.

Null text counts as no text: zero words, base_failed; `clean` drops it, as it does a text without words.  Empty tables give
empty results; other columns are ignored by `measure`, whatever their names, and `clean` keeps them.  Each row is worked
on alone, so no key or copy group is ever gathered, repeated rows get equal results, and a null doc_id stays null.  Very
long texts cost their length, times its logarithm where windows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_LEFT = 0.5
SEPARATORS_PER_WORD = 0.2
MARKS_PER_WORD = 0.75
SHOUTS_PER_WORD = 0.3
#: Stock phrases of pages that aren't prose, in lower case.
PHRASES = ("all rights reserved", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "terms of use", "terms of service", "click here", "sign in", "log in", "subscribe to", "licensed under", "copyright (c)", "share on", "read more")
PHRASES += ("tous droits réservés", "politique de confidentialité", "mentions légales", "lire la suite", "se connecter")
PHRASES += ("alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "weiterlesen", "jetzt anmelden")
PHRASES += ("todos los derechos reservados", "política de privacidad", "aviso legal", "leer más", "iniciar sesión")

_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _left(text: Column, keep: str) -> Column:
    """How many characters of the class there are."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in text order."""

    def starts(pairs: Column) -> Column:
        twin = lambda p, k: ((k > 0) & (pairs[F.greatest(k - 1, F.lit(0))]["h"] == p["h"])) | (
            (k < F.size(pairs) - 1) & (pairs[F.least(k + 1, F.size(pairs) - 1)]["h"] == p["h"])
        )
        return F.sort_array(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

    def spread(at: Column) -> Column:
        step = lambda x, k: F.when(k == F.size(at) - 1, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), at[F.least(k + 1, F.size(at) - 1)] - x)
        )
        return F.aggregate(F.transform(at, step), F.lit(0), lambda acc, x: acc + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(pairs, lambda p: let(starts(p), spread))


def repeat_words(words: Column) -> Column:
    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
        found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(found)

    return let(words, of)


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line."""
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    punctuated = line.rlike(r"[.!?…。！？]")
    navigation = _left(line, r"|»›•·") >= F.greatest(F.lit(2.0), n_words * SEPARATORS_PER_WORD)
    decorated = _left(line, r"#*$%&<>=_~^") >= F.greatest(F.lit(3.0), n_words * MARKS_PER_WORD)
    shouted = _left(line, r"!") >= F.greatest(F.lit(4.0), n_words * SHOUTS_PER_WORD)
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in PHRASES:
        boilerplate = boilerplate | F.contains(low, F.lit(phrase))
    return punctuated & ~navigation & ~decorated & ~shouted & ~boilerplate


def share_left(lines: Column) -> Column:
    """Share of the text in lines that pass."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + F.length(x))
    return let(lines, lambda ls: F.when(F.size(ls) == 0, F.lit(0.0)).otherwise(total(F.filter(ls, line_passes)) / total(ls)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        (F.length(text) - spaces).cast("long").alias("word_chars"),
        _left(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        let(lines_of(text), lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), share_left(ls).alias("left"))).alias("l"),
    )
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("w.n_words"))
    return out.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("l.left") >= MIN_LEFT)).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """Documents with failing lines removed, without those that lose too much; all columns stay."""
    lines = lines_of(F.coalesce(F.col("text"), F.lit("")))
    kept = docs.where(share_left(lines) >= MIN_LEFT)
    return kept.withColumn("text", F.array_join(F.filter(lines, line_passes), "\n"))
