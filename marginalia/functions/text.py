"""Text expressions of the cleaning and validation stage (TX01-TX46); all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters replaced one for one, by the empty string, and by several characters.
ONE_FOR_ONE = ("\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u00a0", "'''\"\"\"-- ")
OFFLINE_ONE_FOR_ONE = (ONE_FOR_ONE[0] + "\u00ab\u00bb\u2212", ONE_FOR_ONE[1] + '""-')
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
#: Unicode's space separators (Zs): what SQL's trim takes off; Spark's own takes off U+0020 only.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Forms of an e-mail address, a phone number, a social security number and a card number.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(\+?1?\s?)?(\(?\d{3}\)?[\s.\-]?)(\d{3}[\s.\-]?\d{4})"
SSN = r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"
CARD = r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"
#: Rude words counted by the profanity ratio.
PROFANITY = ("damn", "hell", "crap", "ass", "bastard", "bitch", "shit", "fuck", "piss", "dick", "cock", "cunt", "whore", "slut", "fag", "retard")
#: Signs of prompt injection.
INJECTION = (
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context|rules?)",
    r"disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context|rules?)",
    r"forget\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context|rules?)",
    r"do\s+not\s+follow\s+(the\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?)",
    r"new\s+instructions?\s*:",
    r"your\s+(new\s+)?(instructions?|objective|goal|task|purpose|role)\s+(is|are)\s*:",
    r"you\s+are\s+now\s+[a-z]",
    r"act\s+as\s+(a\s+|an\s+)?[a-z]",
    r"pretend\s+(you\s+are|to\s+be)\s+[a-z]",
    r"(developer|jailbreak|unrestricted|dan)\s+mode",
    r"\bDAN\b",
    r"(^|\n)\s*system\s*:",
    r"(^|\n)\s*###\s*(instruction|system|prompt)",
    r"<\|im_start\|>",
    r"\[INST\]",
    r"(^|\n)\s*(USER|ASSISTANT|HUMAN|AI)\s*:",
)
INJECTION_PATTERN = "(?im)" + "|".join(INJECTION)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def folded(x: Column) -> Column:
    """Letters lowered one for one, whatever stands beside them (no final sigma, no dot of its own for İ), spaces of any kind off both ends."""
    return F.trim(F.lower(F.translate(x, "Σİ", "σi")), F.lit(SPACES))


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))


def word_count(x: Column) -> Column:
    """0 for empty and blank texts, null for null."""
    return F.size(words(x))


def slug(x: Column) -> Column:
    """Lower-case identifier of a name; null and empty give 'unknown'."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), r"['\-]", ""), "[^a-z0-9]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", "unknown").otherwise(s)


def short_md5(x: Column, n: int = 8) -> Column:
    return F.substring(F.md5(x), 1, n)


def repaired(x: Column) -> Column:
    """Latin-1 read of UTF-8 put right where the bytes are valid UTF-8 (TX07)."""
    return F.when(x.rlike(r"^[\x00-\xFF]*$"), F.coalesce(F.try_validate_utf8(F.encode(x, "ISO-8859-1").cast("string")), x)).otherwise(x)


def plain_signs(x: Column, offline: bool = False) -> Column:
    a, b = OFFLINE_ONE_FOR_ONE if offline else ONE_FOR_ONE
    return F.replace(F.translate(F.translate(x, ZERO_WIDTH, ""), a, b), F.lit("…"), F.lit("..."))


def without_emails(x: Column) -> Column:
    return F.regexp_replace(x, rf"\b{EMAIL}\b", "[EMAIL REMOVED]")


def even_space(x: Column) -> Column:
    x = F.regexp_replace(F.replace(F.replace(F.replace(x, F.lit("\t"), F.lit(" ")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), " {2,}", " ")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def cleaned(x: Column, offline: bool = False) -> Column:
    """The stages in the order that results depend on: encoding, signs, addresses, white space."""
    return even_space(without_emails(plain_signs(repaired(x), offline)))


def sentences(x: Column) -> Column:
    """Pieces of at least 3 characters between ends of sentences and lines; the whole text if none is left."""
    parts = F.filter(F.split(x, r"(?<=[.!?])\s+|\n+"), lambda s: F.length(strip(s)) >= 3)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(x))


def syllables(x: Column) -> Column:
    """Vowel groups of a text's words, without a silent final e; at least one a word."""
    return F.aggregate(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)), F.lit(0), lambda n, w: n + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.rlike("[^aeiouy]e$"), 1).otherwise(0)))


def reading_ease(x: Column) -> Column:
    """Flesch's formula with counted vowel groups, in 0..100; 0 for a text without words."""
    n = word_count(x)
    score = F.lit(206.835) - F.lit(1.015) * n / F.size(sentences(x)) - F.lit(84.6) * syllables(x) / n
    return F.when(n > 0, F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)


def letter_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}]+", ""))


def vowel_count(x: Column) -> Column:
    low = F.lower(x)
    return F.length(low) - F.length(F.translate(low, "aeiou", ""))


def gibberish(letters: Column, vowels: Column) -> Column:
    """Whether the share of vowels among ten letters or more is too small or too large for words."""
    share = F.try_divide(vowels.cast("double"), letters.cast("double"))
    return (letters >= 10) & ((share < 0.15) | (share > 0.6))


def caps_ratio(x: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(x, r"[^\p{Lu}]+", "")).cast("double"), letter_count(x).cast("double"))


def punctuation_ratio(x: Column) -> Column:
    """Characters that are neither letters, marks, numbers, underscore nor white space, of all."""
    return F.try_divide(F.regexp_count(x, F.lit(r"[^\p{L}\p{M}\p{N}_\s]")).cast("double"), F.length(x).cast("double"))


def latin_words(x: Column) -> Column:
    """Words of the letters a-z only: a word with any other letter is none."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$"))


def profanity_ratio(x: Column) -> Column:
    """Share of rude words among a text's words of the letters a-z, to four places; 0 without any."""
    return rude_share(latin_words(x))


def rude_share(w: Column) -> Column:
    return F.rint(F.size(F.filter(w, lambda t: t.isin(*PROFANITY))) / F.greatest(F.size(w), F.lit(1)) * 1e4) / 1e4


def top_share(w: Column) -> Column:
    """Share of the most frequent of some words: the longest run among them in order; null without any."""
    state = lambda last, run, most: F.struct(last.alias("last"), run.alias("run"), most.alias("most"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(t.eqNullSafe(a["last"]), a["run"] + 1).otherwise(F.lit(1))
        return state(t, run, F.greatest(a["most"], run))

    return F.aggregate(F.array_sort(w), state(F.lit(None).cast("string"), F.lit(0), F.lit(0)), step, lambda a: F.try_divide(a["most"].cast("double"), F.size(w).cast("double")))


def top_word_share(x: Column) -> Column:
    return top_share(latin_words(x))


def has_phone(x: Column) -> Column:
    return F.exists(F.regexp_extract_all(x, F.lit(PHONE), F.lit(0)), lambda m: F.length(F.regexp_replace(m, r"\D", "")) >= 10)


def pii_types(x: Column) -> Column:
    return F.array_compact(F.array(F.when(x.rlike(rf"\b{EMAIL}\b"), "email"), F.when(has_phone(x), "phone_number"), F.when(x.rlike(SSN), "ssn"), F.when(x.rlike(CARD), "credit_card")))


def natural_name(x: Column) -> Column:
    """'Last, First' as 'First Last'."""
    return strip(F.regexp_replace(x, r"^([^,]*),\s*(.*)$", "$2 $1"))


def trailing_number(x: Column) -> Column:
    """The number after the last underscore; 0 if there is none."""
    return F.coalesce(F.element_at(F.split(x, "_"), -1).try_cast("int"), F.lit(0))


def whole_number(x: Column) -> Column:
    """int(float(x)) of dirty text; 0 where it is none."""
    return F.coalesce(x.try_cast("double").try_cast("int"), F.lit(0))


def paragraphs(x: Column, longer_than: int) -> Column:
    """The paragraphs of more than so many characters, parted by blank lines."""
    return F.filter(F.split(x, r"\n\n+"), lambda p: F.length(p) > longer_than)


def issue_texts(words: Column, chars: Column, min_words: int, max_words: int, min_chars: int) -> Column:
    """A text's issues with their numbers: too short or too long, and, apart from it, too few characters."""
    n, c = words.cast("string"), chars.cast("string")
    length = F.when(words < min_words, F.concat(F.lit("too_short: "), n, F.lit(f" words (min {min_words})"))).when(words > max_words, F.concat(F.lit("too_long: "), n, F.lit(f" words (max {max_words})")))
    return F.array_compact(F.array(length, F.when(chars < min_chars, F.concat(F.lit("too_few_chars: "), c))))
