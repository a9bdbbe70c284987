"""Queries of the text stage: ids, cleaning, measures, validation, issues, gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions import text as X
from marginalia.functions.once import evaluated
from marginalia.functions.rounding import clamp, half_even
from marginalia.operators.dedup import latest
from marginalia.plans.registry import query, with_once
from marginalia.tables import dealt, table

NOTES = with_once("notes")
#: Limits of the validation and issue stages.
MIN_WORDS, MAX_WORDS, MIN_CHARS, THRESHOLD, CAPS, PUNCT, RUN, TOP_WORD, PROFANE = 10, 600, 50, 0.5, 0.5, 0.1, 4, 0.3, 0.3


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpretations, each once."""
    return latest(table(spark, sf_dir, "interpretations"), ["interpretation_id"], "ingested_at")


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "interpretations").select("interpretation_id", "ingested_at", F.col("interpretation").alias("text")))


def each_once(measured: DataFrame) -> DataFrame:
    """One row per note of what was worked out per delivery: the texts themselves are never shuffled."""
    return latest(measured, ["interpretation_id"], "ingested_at").drop("ingested_at")


@query("tx01_slugs", "SELECT DISTINCT author, CASE WHEN coalesce(author, '') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(author), '[''\\-]', '', 'g'), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') END AS slug FROM books")
def tx01_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX01."""
    return table(spark, sf_dir, "books").select("author", X.slug(F.col("author")).alias("slug")).distinct()


@query(
    "tx02_ids",
    f"""{NOTES} SELECT interpretation_id, concat('note_', substr(md5(concat(user_id, coalesce(passage_id, ''), substr(coalesce(interpretation, ''), 1, 100))), 1, 8)) AS note_key,
    concat('user_', substr(md5(user_id), 1, 8)) AS user_key FROM notes""",
)
def tx02_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX02, TX03: deterministic ids."""
    c = F.col
    return notes(spark, sf_dir).select(
        "interpretation_id",
        F.concat(F.lit("note_"), X.short_md5(F.concat("user_id", F.coalesce("passage_id", F.lit("")), F.substring(F.coalesce("interpretation", F.lit("")), 1, 100)))).alias("note_key"),
        F.concat(F.lit("user_"), X.short_md5(c("user_id"))).alias("user_key"),
    )


@query("tx04_passage_keys", f"{NOTES} SELECT interpretation_id, substr(sha256(concat(coalesce(book_id, ''), '|', trim(lower(substr(passage, 1, 200))))), 1, 32) AS passage_key FROM notes")
def tx04_passage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX04: the passage is cut before it is lowered and trimmed. A null passage counts as empty."""
    key = F.sha2(F.concat(F.coalesce("book_id", F.lit("")), F.lit("|"), F.coalesce(X.folded(F.substring("passage", 1, 200)), F.lit(""))), 256)
    return notes(spark, sf_dir).select("interpretation_id", F.substring(key, 1, 32).alias("passage_key"))


@query("tx05_run_ids", "SELECT run_id, concat('run_', substr(md5(concat_ws('|', least(user_a, user_b), greatest(user_a, user_b), book_id, passage_id)), 1, 16)) AS pair_run, concat(least(user_a, user_b), '__', greatest(user_a, user_b)) AS pair_key FROM compat_runs")
def tx05_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX06, TX43: ids of unordered pairs."""
    a, b = F.least("user_a", "user_b"), F.greatest("user_a", "user_b")
    return table(spark, sf_dir, "compat_runs").select("run_id", F.concat(F.lit("run_"), X.short_md5(F.concat_ws("|", a, b, "book_id", "passage_id"), 16)).alias("pair_run"), F.concat_ws("__", a, b).alias("pair_key"))


_REPAIR_SQL = r"CASE WHEN regexp_full_match({0}, '[\x{{00}}-\x{{FF}}]*') THEN coalesce(TRY(decode(unhex(array_to_string(list_transform(string_split({0}, ''), lambda c: printf('%02x', unicode(c))), '')))), {0}) ELSE {0} END"
_REPAIRED = _REPAIR_SQL.format("interpretation")


@query("tx07_latin1_repair", f"{NOTES}, r AS (SELECT interpretation_id, interpretation, {_REPAIRED} AS fixed FROM notes WHERE interpretation <> '') SELECT interpretation_id, fixed FROM r WHERE fixed <> interpretation")
def tx07_latin1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX07: rows that the latin-1 round trip changes."""
    t = raw_texts(spark, sf_dir).filter(F.col("text").rlike(r"[^\x00-\x7F]")).withColumn("fixed", X.repaired(F.col("text")))
    return each_once(t.filter(F.col("text") != F.col("fixed")).select("interpretation_id", "ingested_at", "fixed"))


_CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(translate(translate(interpretation, chr(8203)||chr(8204)||chr(8205)||chr(65279), ''), '‘’‚“”„–—'||chr(160), '''''''"""+'"""'+r"""-- '), '…', '...'), '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[EMAIL REMOVED]', 'g'), chr(9), ' '), chr(13)||chr(10), chr(10)), chr(13), chr(10)), ' {2,}', ' ', 'g'), chr(10)||'{3,}', chr(10)||chr(10), 'g'), ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"""


@query("tx08_clean", f"{NOTES} SELECT interpretation_id, {_CLEAN_SQL} AS cleaned FROM notes WHERE interpretation IS NOT NULL")
def tx08_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX08, TX10, TX11, TX37: signs, e-mail addresses and white space."""
    t = raw_texts(spark, sf_dir).filter(F.col("text").isNotNull())
    return each_once(t.select("interpretation_id", "ingested_at", X.even_space(X.without_emails(X.plain_signs(F.col("text")))).alias("cleaned")))


@query("tx09_nfc", f"{NOTES} SELECT interpretation_id, length(nfc_normalize(interpretation)) AS nfc_length, md5(nfc_normalize(interpretation)) AS nfc_md5 FROM notes WHERE NOT regexp_full_match(interpretation, '[\\x00-\\x7F]*')")
def tx09_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX09, UF06: canonical composition of the texts that aren't ASCII."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    t = raw_texts(spark, sf_dir).filter(F.col("text").rlike(r"[^\x00-\x7F]")).withColumn("n", nfc("text"))
    return each_once(t.select("interpretation_id", "ingested_at", F.length("n").cast("long").alias("nfc_length"), F.md5("n").alias("nfc_md5")))


_PARTS = r"list_filter(string_split(regexp_replace(regexp_replace(interpretation, '([.!?])\s+', '\1'||chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')) >= 3)"


@query(
    "tx12_measures",
    rf"""{NOTES}, m AS (SELECT interpretation_id, interpretation, len(regexp_extract_all(interpretation, '\S+')) AS wc, greatest(len({_PARTS}), 1) AS sc FROM notes WHERE regexp_matches(interpretation, '\S'))
    SELECT interpretation_id, CAST(wc AS INTEGER) AS word_count, CAST(length(replace(replace(interpretation, ' ', ''), chr(10), '')) AS INTEGER) AS char_count, CAST(sc AS INTEGER) AS sentence_count,
    round_even(CAST(length(regexp_replace(interpretation, '[^a-zA-Z]', '', 'g')) AS DOUBLE) / wc, 2) AS avg_word_length, round_even(CAST(wc AS DOUBLE) / sc, 2) AS avg_sentence_length FROM m""",
)
def tx12_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX12-TX14, TX26, TX27."""
    x = F.col("text")
    t = raw_texts(spark, sf_dir).filter(x.rlike(r"\S")).withColumn("wc", X.word_count(x)).withColumn("sc", F.size(X.sentences(x)))
    return each_once(t.select("interpretation_id", "ingested_at", F.col("wc").alias("word_count"), F.length(F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))).alias("char_count"), F.col("sc").alias("sentence_count"), half_even(F.length(F.regexp_replace(x, "[^a-zA-Z]", "")) / F.col("wc"), 2).alias("avg_word_length"), half_even(F.col("wc") / F.col("sc"), 2).alias("avg_sentence_length")))


def validated(t: DataFrame, language: Column | None = None) -> DataFrame:
    """(…, word_count, issues, quality_score, is_valid) of `text` (TX15-TX19); without `language` any text counts as English."""
    x = F.coalesce("text", F.lit(""))
    t = evaluated(t, word_count=F.regexp_count(x, F.lit(r"\S+")), __c=F.length(F.replace(x, F.lit(" "), F.lit(""))), __l=X.letter_count(x), __v=X.vowel_count(x))
    n, chars, letters, vowels = (F.col(c) for c in ("word_count", "__c", "__l", "__v"))
    empty = n == 0
    short, long_, few = n < MIN_WORDS, n > MAX_WORDS, chars < MIN_CHARS
    foreign = (F.length(x) >= 20) & (language != "en") if language is not None else F.lit(False)
    odd = F.coalesce(X.gibberish(letters, vowels), F.lit(False))
    score = F.lit(1.0) - F.when(short | long_, 0.3).otherwise(0.0) - F.when(foreign, 0.4).otherwise(0.0) - F.when(odd, 0.5).otherwise(0.0) - F.when(few, 0.1).otherwise(0.0)
    score = F.when(empty, 0.0).otherwise(half_even(clamp(score, 0.0, 1.0), 4))
    issues = F.when(empty, F.array(F.lit("empty_text"))).otherwise(F.array_compact(F.array(F.when(short, "too_short"), F.when(long_, "too_long"), F.when(few, "too_few_chars"), F.when(foreign, "wrong_language"), F.when(odd, "gibberish_detected"))))
    return evaluated(t, issues=issues, quality_score=score).drop("__c", "__l", "__v").withColumn("is_valid", (F.size("issues") == 0) & (F.col("quality_score") >= THRESHOLD))


@query(
    "tx16_validation",
    rf"""{NOTES}, m AS (SELECT interpretation_id, coalesce(interpretation, '') AS x FROM notes), f AS (SELECT interpretation_id, len(regexp_extract_all(x, '\S+')) AS wc, length(replace(x, ' ', '')) AS ch,
    len(regexp_extract_all(x, '\p{{L}}')) AS letters, len(regexp_extract_all(lower(x), '[aeiou]')) AS vowels FROM m),
    g AS (SELECT *, wc = 0 AS e, wc < 10 AS s, wc > 600 AS l, ch < 50 AS c, letters >= 10 AND (CAST(vowels AS DOUBLE) / letters < 0.15 OR CAST(vowels AS DOUBLE) / letters > 0.6) AS o FROM f)
    SELECT interpretation_id, CAST(wc AS INTEGER) AS word_count, CASE WHEN e THEN 'empty_text' ELSE concat_ws(',', CASE WHEN s THEN 'too_short' END, CASE WHEN l THEN 'too_long' END, CASE WHEN c THEN 'too_few_chars' END, CASE WHEN o THEN 'gibberish_detected' END) END AS issues,
    CASE WHEN e THEN CAST(0 AS DOUBLE) ELSE round_even(CAST(1 AS DOUBLE) - CASE WHEN s OR l THEN CAST(0.3 AS DOUBLE) ELSE 0 END - CASE WHEN o THEN CAST(0.5 AS DOUBLE) ELSE 0 END - CASE WHEN c THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 4) END AS quality_score,
    NOT (e OR s OR l OR c OR o) AS is_valid FROM g""",
)
def tx16_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX16-TX19, TX45, FLT10 without the language check (TX15 is in tx15_language)."""
    return each_once(validated(raw_texts(spark, sf_dir)).select("interpretation_id", "ingested_at", "word_count", F.array_join("issues", ",").alias("issues"), "quality_score", "is_valid"))


#: Very frequent words by language, for the validation stage's language guess.
FREQUENT = {"en": "the and of to is in that it was for", "de": "der die und ich nicht das ist mit ein zu", "fr": "le la les et je est une pas que qui", "es": "el la que de y los una no es por", "pt": "o a que de e não uma os em com", "nl": "de het een en ik van niet dat is op"}


def guessed_language(x: Column) -> Column:
    """Language with the most of its frequent words; ties by the order of FREQUENT; 'en' below 20 characters, 'unknown' without any."""
    own = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+"), F.lit(0)))
    counts = [F.size(F.array_intersect(own, F.array(*map(F.lit, w.split())))) for w in FREQUENT.values()]
    most = F.greatest(*counts)
    guess = F.coalesce(*(F.when((c == most) & (most > 0), F.lit(k)) for k, c in zip(FREQUENT, counts)), F.lit("unknown"))
    return F.when(F.length(x) < 20, "en").otherwise(guess)


_WORDS = r"list_distinct(regexp_extract_all(lower(interpretation), '\p{L}+'))"
_HITS = ", ".join(f"len(list_intersect({_WORDS}, string_split('{w}', ' '))) AS {k}" for k, w in FREQUENT.items())
_CASES = " ".join(f"WHEN {k} = m AND m > 0 THEN '{k}'" for k in FREQUENT)


@query("tx15_language", f"{NOTES}, h AS (SELECT interpretation_id, interpretation, {_HITS} FROM notes WHERE interpretation IS NOT NULL), g AS (SELECT *, greatest({', '.join(FREQUENT)}) AS m FROM h) SELECT interpretation_id, CASE WHEN length(interpretation) < 20 THEN 'en' {_CASES} ELSE 'unknown' END AS language FROM g")
def tx15_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX15, UF04: the stage's plain guess (the trained model is a separate package)."""
    return each_once(raw_texts(spark, sf_dir).filter(F.col("text").isNotNull()).select("interpretation_id", "ingested_at", guessed_language(F.col("text")).alias("language")))


@query(
    "tx20_issues",
    rf"""{NOTES}, m AS (SELECT interpretation_id, coalesce(interpretation, '') AS x FROM notes), f AS (SELECT interpretation_id, x, list_filter(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+'), lambda q: regexp_full_match(q, '[a-z]+')) AS w FROM m)
    SELECT interpretation_id, regexp_matches(x, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b') AS has_email, regexp_matches(x, '\b\d{{3}}[-\s]\d{{2}}[-\s]\d{{4}}\b') AS has_ssn,
    regexp_matches(x, '\b\d{{4}}[\s\-]?\d{{4}}[\s\-]?\d{{4}}[\s\-]?\d{{4}}\b') AS has_card, len(list_filter(regexp_extract_all(x, '(\+?1?\s?)?(\(?\d{{3}}\)?[\s.\-]?)(\d{{3}}[\s.\-]?\d{{4}})'), lambda m: length(regexp_replace(m, '\D', '', 'g')) >= 10)) > 0 AS has_phone,
    round_even(CAST(len(list_filter(w, lambda t: t IN ({', '.join(repr(p) for p in X.PROFANITY)}))) AS DOUBLE) / greatest(len(w), 1), 4) AS profanity_ratio,
    coalesce(CAST(len(regexp_extract_all(x, '\p{{Lu}}')) AS DOUBLE) / nullif(len(regexp_extract_all(x, '\p{{L}}')), 0) > 0.5, false) AS many_caps,
    coalesce(CAST(len(regexp_extract_all(x, '[^\p{{L}}\p{{M}}\p{{N}}_\s]')) AS DOUBLE) / nullif(length(x), 0) > 0.1, false) AS many_signs FROM f""",
)
def tx20_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX20-TX23, FLT11-FLT13."""
    x = F.coalesce("text", F.lit(""))
    none = lambda c: F.coalesce(c, F.lit(False))
    return each_once(raw_texts(spark, sf_dir).select("interpretation_id", "ingested_at", x.rlike(rf"\b{X.EMAIL}\b").alias("has_email"), x.rlike(X.SSN).alias("has_ssn"), x.rlike(X.CARD).alias("has_card"), X.has_phone(x).alias("has_phone"), X.profanity_ratio(x).alias("profanity_ratio"), none(X.caps_ratio(x) > CAPS).alias("many_caps"), none(X.punctuation_ratio(x) > PUNCT).alias("many_signs")))


_LETTERS = rf"list_filter(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+'), lambda q: regexp_full_match(q, '[a-z]+'))"


@query(
    "tx24_repeats",
    rf"""{NOTES}, m AS (SELECT interpretation_id, coalesce(interpretation, '') AS x FROM notes), f AS (SELECT interpretation_id, x, {_LETTERS} AS w FROM m), u AS (SELECT interpretation_id, unnest(w) AS t FROM f), c AS (SELECT interpretation_id, max(n) AS most, sum(n) AS n FROM (SELECT interpretation_id, t, count(*) AS n FROM u GROUP BY 1, 2) q GROUP BY 1),
    k AS (SELECT interpretation_id, unnest(string_split(x, '')) AS ch, generate_subscripts(string_split(x, ''), 1) AS i FROM f WHERE x <> ''), r AS (SELECT DISTINCT interpretation_id FROM (SELECT interpretation_id, ch, i - row_number() OVER (PARTITION BY interpretation_id, ch ORDER BY i) AS g FROM k WHERE ch <> chr(10) AND ch <> chr(13) AND ch <> chr(133) AND ch <> chr(8232) AND ch <> chr(8233)) z GROUP BY interpretation_id, ch, g HAVING count(*) >= {RUN})
    SELECT f.interpretation_id, r.interpretation_id IS NOT NULL AS repetitive_chars, coalesce(CAST(most AS DOUBLE) / n > {TOP_WORD}, false) AS repetitive_words FROM f LEFT JOIN c ON f.interpretation_id = c.interpretation_id LEFT JOIN r ON f.interpretation_id = r.interpretation_id""",
)
def tx24_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX24, TX25: runs of one character, and the share of the most frequent word."""
    x = F.coalesce("text", F.lit(""))
    t = evaluated(raw_texts(spark, sf_dir).select("interpretation_id", "ingested_at", x.alias("x")), w=X.latin_words(F.col("x")))
    return each_once(t.select("interpretation_id", "ingested_at", F.col("x").rlike(rf"(.)\1{{{RUN - 1},}}").alias("repetitive_chars"), F.coalesce(X.top_share(F.col("w")) > TOP_WORD, F.lit(False)).alias("repetitive_words")))


_SYLLABLES = "list_sum(list_transform(regexp_extract_all(lower(interpretation), '[a-z]+'), lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN regexp_matches(w, '[^aeiouy]e$') THEN 1 ELSE 0 END)))"


@query("tx28_reading_ease", rf"{NOTES}, m AS (SELECT interpretation_id, len(regexp_extract_all(interpretation, '\S+')) AS wc, greatest(len({_PARTS}), 1) AS sc, coalesce({_SYLLABLES}, 0) AS sy FROM notes WHERE regexp_matches(interpretation, '\S')) SELECT interpretation_id, round_even(least(greatest(CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * wc / sc - CAST(84.6 AS DOUBLE) * sy / wc, 0), 100), 2) AS readability_score FROM m")
def tx28_reading_ease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX28, UF05."""
    return each_once(raw_texts(spark, sf_dir).filter(F.col("text").rlike(r"\S")).select("interpretation_id", "ingested_at", half_even(X.reading_ease(F.col("text")), 2).alias("readability_score")))


_INJECTION_SQL = X.INJECTION_PATTERN.replace("'", "''")


@query("flt09_injection", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_INJECTION_SQL}')")
def flt09_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT09: documents that try to steer a model."""
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(X.INJECTION_PATTERN)).select("doc_id")


def outcomes(t: DataFrame) -> DataFrame:
    """First failing gate of each text, in the order of the stage; the cleaned text is worked out once for all gates."""
    x = F.col("text")
    t = evaluated(t.withColumnRenamed("text", "__raw"), text=X.cleaned(F.coalesce("__raw", F.lit("")))).drop("__raw")
    gate = F.when(x.rlike(X.INJECTION_PATTERN), "rejected_injection").when(~F.col("is_valid"), "rejected_invalid").when(F.size(X.pii_types(x)) > 0, "rejected_pii").when(X.profanity_ratio(x) >= PROFANE, "rejected_profanity").when(F.coalesce(X.caps_ratio(x) > CAPS, F.lit(False)), "rejected_spam")
    return validated(t).withColumn("outcome", F.coalesce(gate, F.lit("accepted")))


_CLEANED = _CLEAN_SQL.replace("interpretation", "raw")
_ACCEPTED = rf"""r AS (SELECT interpretation_id, coalesce({_REPAIRED}, '') AS raw FROM notes), k AS (SELECT interpretation_id, {_CLEANED} AS x FROM r), c AS (SELECT *, len(regexp_extract_all(x, '\S+')) AS wc, length(replace(x, ' ', '')) AS ch, len(regexp_extract_all(x, '\p{{L}}')) AS letters, len(regexp_extract_all(lower(x), '[aeiou]')) AS vowels, {_LETTERS} AS w FROM k),
    v AS (SELECT *, wc BETWEEN 10 AND 600 AND ch >= 50 AND NOT (letters >= 10 AND (CAST(vowels AS DOUBLE) / letters < 0.15 OR CAST(vowels AS DOUBLE) / letters > 0.6)) AS is_valid FROM c),
    o AS (SELECT interpretation_id, CASE WHEN regexp_matches(x, '{_INJECTION_SQL}') THEN 'rejected_injection' WHEN NOT is_valid THEN 'rejected_invalid' WHEN regexp_matches(x, '\b{X.EMAIL}\b') OR regexp_matches(x, '{X.SSN}') OR regexp_matches(x, '{X.CARD}') OR len(list_filter(regexp_extract_all(x, '{X.PHONE}'), lambda m: length(regexp_replace(m, '\D', '', 'g')) >= 10)) > 0 THEN 'rejected_pii'
    WHEN CAST(len(list_filter(w, lambda t: t IN ({', '.join(repr(p) for p in X.PROFANITY)}))) AS DOUBLE) / greatest(len(w), 1) >= {PROFANE} THEN 'rejected_profanity' WHEN coalesce(CAST(len(regexp_extract_all(x, '\p{{Lu}}')) AS DOUBLE) / nullif(letters, 0) > {CAPS}, false) THEN 'rejected_spam' ELSE 'accepted' END AS outcome FROM v)"""


@query("flt14_outcomes", f"{NOTES}, {_ACCEPTED} SELECT outcome, count(*) AS n FROM o GROUP BY 1")
def flt14_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10-FLT14: how many texts end at which gate."""
    return each_once(outcomes(raw_texts(spark, sf_dir)).select("interpretation_id", "ingested_at", "outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("tx29_author_names", "SELECT book_id, trim(regexp_replace(author, '^([^,]*),\\s*(.*)$', '\\2 \\1')) AS author_name, CASE WHEN title = upper(title) THEN 'capitals' ELSE 'mixed' END AS title_case FROM books")
def tx29_author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX29: names in natural order, and how the title is written."""
    return table(spark, sf_dir, "books").select("book_id", X.natural_name(F.col("author")).alias("author_name"), F.when(F.col("title") == F.upper("title"), "capitals").otherwise("mixed").alias("title_case"))


@query("tx30_trailing_number", "SELECT comparison_id, coalesce(TRY_CAST(string_split(session_id, '_')[-1] AS INTEGER), 0) AS session_no, coalesce(CAST(TRY_CAST(trim(winner_run_id) AS DOUBLE) AS BIGINT), 0) AS winner FROM comparisons")
def tx30_trailing_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX30, TX32: numbers out of dirty text."""
    return table(spark, sf_dir, "comparisons").select("comparison_id", X.trailing_number(F.col("session_id")).alias("session_no"), F.coalesce(F.trim("winner_run_id").try_cast("double").cast("long"), F.lit(0)).alias("winner"))


@query("tx35_book_pages", f"SELECT page_id, CAST(len(list_filter(string_split(content, chr(10)||chr(10)), lambda p: length(p) > 60)) AS INTEGER) AS paragraphs FROM book_pages")
def tx35_book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX35: paragraphs that are long enough, of each page."""
    return table(spark, sf_dir, "book_pages").select("page_id", F.size(F.filter(F.split("content", "\n\n"), lambda p: F.length(p) > 60)).alias("paragraphs"))


@query("tx36_html_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents WHERE regexp_matches(text, '<[a-z]+[^>]*>')")
def tx36_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX36: text of the documents that hold markup."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "<[^>]*>", " "), "&nbsp;", " "), r"\s+", " ")
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("<[a-z]+[^>]*>")).select("doc_id", F.trim(x).alias("plain"))


@query("tx44_compact_counts", "SELECT book_id, count(*) AS n, CASE WHEN count(*) >= 1000 THEN concat(CAST(count(*) // 1000 AS VARCHAR), '.', CAST((count(*) % 1000) // 100 AS VARCHAR), 'k') ELSE CAST(count(*) AS VARCHAR) END AS shown FROM documents GROUP BY book_id")
def tx44_compact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX44: counts as they are shown; cut, not rounded."""
    n = F.col("n")
    shown = F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.floor((n % 1000) / 100).cast("string"), F.lit("k"))).otherwise(n.cast("string"))
    return table(spark, sf_dir, "documents").groupBy("book_id").agg(F.count("*").alias("n")).withColumn("shown", shown)
