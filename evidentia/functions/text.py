"""Text helpers as native Column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters Python's str.isspace() accepts, i.e. what a
# bare str.strip() removes.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove all leading / trailing whitespace (P5).
    Spark ``trim`` removes spaces only; ``btrim`` over Python's whitespace set
    is exact and needs no regex."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def first_line(c: Column) -> Column:
    """Text before the first newline (``text.split('\\n', 1)[0]``)."""
    return F.regexp_extract(c, r"^([^\n]*)", 1)


def nullif_empty(c: Column) -> Column:
    """A regexp without a match gives '' - turn it into NULL."""
    return F.when(c != "", c)


def word_count(c: Column) -> Column:
    """M8: number of whitespace-separated words (``len(s.split())``)."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def join_bullets(bullets: Column) -> Column:
    """Bullets joined by one space; a missing list gives ''."""
    return F.coalesce(F.array_join(bullets, " "), F.lit(""))


def split_bullet_string(c: Column) -> Column:
    """Bullets stored as one string: split on '--', strip, drop empties."""
    return F.filter(F.transform(F.split(c, "--"), strip_ws), lambda x: x != "")


# M7 readability --------------------------------------------------------------
# Flesch-Kincaid grade = 0.39 * words/sentences
#                                      + 11.8 * syllables/words - 15.59
FK_SENTENCE_WEIGHT = 0.39
FK_SYLLABLE_WEIGHT = 11.8
FK_CONSTANT = 15.59


def syllables(word: Column) -> Column:
    """Vowel groups (a e i o u y) of the lower-cased letters, minus a silent
    final 'e' when the word has more than one group; at least 1 for a word
    with letters, 0 without letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = F.when(w.endswith("e") & (groups > 1), 1).otherwise(0)
    return F.when(w == "", F.lit(0)).otherwise(F.greatest(groups - silent, F.lit(1)))


_CONSONANT = "[b-df-hj-np-tv-xz]"


def fk_grade(text: Column) -> Column:
    """Flesch-Kincaid grade of a text; NULL when it has no words.
    Sentences = runs of . ! ? (at least 1); syllables as ``syllables`` per
    whitespace-separated word.

    Computed on the whole text with native regex counts (no per-word lambda):
    with words reduced to their letters, the syllable total is
    vowel groups - words with a silent final e + words with letters but no
    vowel group (each such word counts 1). Words with a silent e are those that end
    in e, less those whose only vowel group that e belongs to. Each pattern starts at
    a word's first letter or is one letter long, and takes a run of letters whole, so
    the time is in proportion to the text."""
    n_words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    n_sent = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    letters = F.regexp_replace(F.lower(text), r"(?U)[^a-z\s]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    one_group = F.regexp_count(letters, F.lit(f"(?<![a-z]){_CONSONANT}*+[aeiouy]++(?<=e)(?![a-z])"))
    silent = F.regexp_count(letters, F.lit("e(?![a-z])")) - one_group
    no_vowel = F.regexp_count(letters, F.lit(f"(?<![a-z]){_CONSONANT}++(?![a-z])"))
    n_syl = groups - silent + no_vowel
    grade = (FK_SENTENCE_WEIGHT * (n_words / n_sent) + FK_SYLLABLE_WEIGHT * (n_syl / n_words)
             - FK_CONSTANT)
    return F.when(n_words > 0, grade)


def bullets_fk(bullets: Column) -> Column:
    """Bullets -> ARRAY<STRUCT<sentence, fk_grade>>."""
    return F.transform(bullets, lambda b: F.struct(b.alias("sentence"), fk_grade(b).alias("fk_grade")))
