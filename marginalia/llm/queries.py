"""The pN_ queries over the project's tables, and SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions.rounding import half_even
from marginalia.llm import bpe, lookalikes, packing, pieces, ranking
from marginalia.llm.abuse import CATEGORIES, AbuseModel
from marginalia.llm.fields import BIO, DOCUMENT, INTERPRETATION, KEYS, PAGE, PASSAGE, WHISPER, beyond_ascii, built, fields, map_texts, pairs, record_keys, remembered, sample_texts, words_of
from marginalia.llm.garbled import Repairer
from marginalia.llm.languages import Labeller, LanguageModel, label_of, word_rows
from marginalia.llm.pii_seeds import plain_samples
from marginalia.llm.private import Lists, Names, Redactor
from marginalia.llm.quality import NAMES, ProseModel
from marginalia.tables import table

#: From this score on a text counts for a category.
ABUSE_FROM = 0.45
#: Distinct first or last names of users (8 bytes each) up to which they are sent to the tasks; more are an error, as none may be left out.
SENT_NAMES = 20_000_000


def _lexicon(spark: SparkSession, sf_dir: str) -> set[str]:
    """Words of the fixed sample tables, which hold clean text."""
    return words_of(table(spark, sf_dir, "lang_samples"), "text") | words_of(table(spark, sf_dir, "common_words"), "word")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, fld, rec_id, n_garbled, restored) of every field with garbled stretches.

    A record delivered twice gives one row. Null, empty and ASCII texts without
    entities can't be garbled and aren't sent to Python.
    """
    lexicon = _lexicon(spark, sf_dir)

    def make():
        repair = remembered(Repairer(lexicon).repair)

        def do(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [(i, r[1], r[0]) for i, t in enumerate(b.column(3).to_pylist()) if (r := repair(t))[1]]
            return pa.RecordBatch.from_arrays([*record_keys(b, [i for i, _, _ in found]), pa.array([n for _, n, _ in found], pa.int32()), pa.array([t for _, _, t in found], pa.string())], names=["tbl", "fld", "rec_id", "n_garbled", "restored"])

        return do

    suspect = fields(spark, sf_dir, (INTERPRETATION, DOCUMENT, PASSAGE, PAGE)).filter(beyond_ascii(F.col("text")) | F.col("text").rlike("&#?[A-Za-z0-9]"))
    return map_texts(suspect, make, f"{KEYS}, n_garbled int, restored string").dropDuplicates(["tbl", "fld", "rec_id"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select("tbl", "fld", "rec_id")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, fld, rec_id, kinds, form) of every field whose one form differs in how it is made, but for garbled fields."""
    lexicon = _lexicon(spark, sf_dir)

    def make():
        spans = Repairer(lexicon).spans

        def one(text: str) -> tuple[str, str] | None:
            kinds = lookalikes.kinds(text)
            return (",".join(sorted(kinds)), lookalikes.readable(text)) if kinds and not spans(text) else None

        look = remembered(one)

        def do(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [(i, *r) for i, t in enumerate(b.column(3).to_pylist()) if (r := look(t))]
            return pa.RecordBatch.from_arrays([*record_keys(b, [i for i, _, _ in found]), pa.array([x for _, x, _ in found], pa.string()), pa.array([t for _, _, t in found], pa.string())], names=["tbl", "fld", "rec_id", "kinds", "form"])

        return do

    suspect = fields(spark, sf_dir, (INTERPRETATION, DOCUMENT, PASSAGE)).filter(beyond_ascii(F.col("text")))
    return map_texts(suspect, make, f"{KEYS}, kinds string, form string").dropDuplicates(["tbl", "fld", "rec_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_forms(spark, sf_dir).select("tbl", "fld", "rec_id")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_key, n_rows, n_spellings, form) of the texts of all three fields, grouped by equal skeleton.

    Equal texts are counted before the skeleton is made, so a passage quoted by a
    third of all rows is one row here.
    """

    def make():
        def do(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(0).to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([lookalikes.skeleton(t) for t in texts], pa.string()), pa.array([lookalikes.readable(t) for t in texts], pa.string()), b.column(1)], names=["skeleton", "form", "n"])

        return do

    texts = fields(spark, sf_dir, (INTERPRETATION, DOCUMENT, PASSAGE)).filter(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("n"))
    made = map_texts(texts, make, "skeleton string, form string, n long")
    return made.groupBy(F.md5("skeleton").alias("group_key")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"), F.min("form").alias("form"))


def _prose_model(spark: SparkSession, sf_dir: str) -> ProseModel:
    """Trained on the driver from the fixed sample tables; `sample_rows` of the operator bounds them."""
    good = sample_texts(table(spark, sf_dir, "lang_samples"), "sample_id", "text") + sample_texts(table(spark, sf_dir, "reviewed_texts"), "review_id", "text")
    return built(ProseModel, good or [t for _, t in plain_samples()], sample_texts(table(spark, sf_dir, "common_words"), "word", "word"))


def _names(users: DataFrame, column: str) -> Names:
    """All words of a column of names, as hashes: 8 bytes each, of at most SENT_NAMES distinct ones."""
    words = users.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select(F.xxhash64("w").alias("h")).distinct()
    if (n := words.count()) > SENT_NAMES:
        raise ValueError(f"{n} distinct names in {column}, more than {SENT_NAMES}")
    return Names(words.toPandas()["h"].to_numpy())


def _redactor(spark: SparkSession, sf_dir: str) -> Redactor:
    """The field with the project's lists of names: characters and authors, from fixed tables, and all names of users."""
    books = table(spark, sf_dir, "books").select(F.regexp_replace("author", r"^([^,]*),\s*(.*)$", "$2 $1").alias("name"))
    cast = {r[0] for r in table(spark, sf_dir, "book_cast").select(F.col("cast_name").alias("name")).unionByName(books).filter(F.col("name").isNotNull()).distinct().collect()}
    users = table(spark, sf_dir, "users")
    return Redactor(Lists(cast, _names(users, "first_name"), _names(users, "last_name"), words_of(table(spark, sf_dir, "common_words"), "word")))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, fld, rec_id, kinds, redacted) of every field with private data; a record delivered twice has equal rows.

    Null, empty and blank texts hold none.
    """
    sent = spark.sparkContext.broadcast(_redactor(spark, sf_dir))

    def make():
        redactor = sent.value

        def do(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(3).to_pylist()
            found = [(i, sorted({k for _, _, k in s}), redactor.redact(t, s)) for i, (t, s) in enumerate(zip(texts, redactor.spans(texts))) if s]
            return pa.RecordBatch.from_arrays([*record_keys(b, [i for i, _, _ in found]), pa.array([k for _, k, _ in found], pa.list_(pa.string())), pa.array([t for _, _, t in found], pa.string())], names=["tbl", "fld", "rec_id", "kinds", "redacted"])

        return do

    return map_texts(fields(spark, sf_dir, (INTERPRETATION, DOCUMENT, WHISPER, BIO)), make, f"{KEYS}, kinds array<string>, redacted string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_redacted(spark, sf_dir).select("tbl", "fld", "rec_id", F.explode("kinds").alias("pii_kind")).distinct()


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, n_votes, n_wins, strength, odds, place) of every run; ties in strength go by run_id.

    The place is the count of runs before it, found over ranges of the strength, so that no task sorts all runs.
    """
    runs = table(spark, sf_dir, "compat_runs")
    votes = ranking.valid_votes(table(spark, sf_dir, "comparisons"), runs)
    out = ranking.ranked(ranking.strengths(votes, runs.select(F.col("run_id").alias("item")).dropna().distinct()))
    return ranking.placed(out, F.desc("strength"), F.asc("item")).withColumnRenamed("item", "run_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "compat_runs")
    votes = ranking.valid_votes(table(spark, sf_dir, "comparisons"), runs)
    out = ranking.ranked(ranking.strengths(votes, runs.select(F.col("run_id").alias("item")).dropna().distinct()))
    return out.filter(F.col("odds") >= 5).select(F.col("item").alias("run_id"))


def _language_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    samples = pairs(table(spark, sf_dir, "lang_samples"), "sample_id", "lang", "text")
    words = pairs(table(spark, sf_dir, "common_words"), "word_no", "lang", "word")
    english = [("en", t) for t in sample_texts(table(spark, sf_dir, "reviewed_texts"), "review_id", "text")]
    rows = (samples or plain_samples()) + english + word_rows(words)
    return built(LanguageModel, [t for _, t in rows], [lang for lang, _ in rows])


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, fld, rec_id, stretch_no, first_char, end_char, true_lang, confidence) of every record's stretches, each in one language.

    Null, empty and blank texts have none. A short or unsure sentence belongs to the
    stretch it stands in. Repeated records have repeated stretches.
    """
    sent = spark.sparkContext.broadcast(_language_model(spark, sf_dir))

    def make():
        labeller = Labeller(sent.value)

        def do(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [(i, k, *s) for i, r in enumerate(labeller.stretches([t if t and not t.isspace() else "" for t in b.column(3).to_pylist()])) for k, s in enumerate(r)]
            cols = list(zip(*found)) or [[]] * 7
            return pa.RecordBatch.from_arrays([*record_keys(b, cols[0]), *(pa.array(cols[k], pa.int32()) for k in (1, 2, 3)), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.float64())], names=["tbl", "fld", "rec_id", "stretch_no", "first_char", "end_char", "true_lang", "confidence"])

        return do

    return map_texts(fields(spark, sf_dir, (INTERPRETATION, DOCUMENT)), make, f"{KEYS}, stretch_no int, first_char int, end_char int, true_lang string, confidence double")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrongly labelled and mixed records; only those are put to the prose model, as texts that are no prose are no cases."""
    sent = spark.sparkContext.broadcast((_language_model(spark, sf_dir), _prose_model(spark, sf_dir)))

    def make():
        model, prose = sent.value
        labeller = Labeller(model)

        def do(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t if t and not t.isspace() else "" for t in b.column(3).to_pylist()]
            cases = []
            for i, (label, r) in enumerate(zip(b.column(4).to_pylist(), labeller.stretches(texts))):
                langs = sorted({s[2] for s in r})
                if langs and (len(langs) > 1 or label_of(label) != langs[0]):
                    cases.append((i, langs))
            if cases:
                p = prose.score([texts[i] for i, _ in cases])[1]
                cases = [c for c, x in zip(cases, p) if x >= 0.5]
            rows = [(i, lang) for i, langs in cases for lang in langs]
            return pa.RecordBatch.from_arrays([*record_keys(b, [i for i, _ in rows]), pa.array([lang for _, lang in rows], pa.string())], names=["tbl", "fld", "rec_id", "true_lang"])

        return do

    labelled = fields(spark, sf_dir, (INTERPRETATION, DOCUMENT), {"label": "lang"}).filter(F.col("text").isNotNull())
    return map_texts(labelled, make, f"{KEYS}, true_lang string").distinct()


def p6_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every record, its calibrated probability of being natural prose, and the verdict.

    Null, empty and blank texts have zeros, no probability and no verdict. A record
    delivered twice has equal rows; p6_found has it once.
    """
    sent = spark.sparkContext.broadcast(_prose_model(spark, sf_dir))
    shown = NAMES[:5]

    def make():
        model = sent.value

        def do(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(3).to_pylist()
            x, p = model.score(texts)
            blank = x[:, 0] == 0
            return pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(x[:, 0].astype("int32")), *(pa.array(x[:, k]) for k in range(1, 5)), pa.array(p, mask=blank), pa.array(p >= 0.5, mask=blank)], names=["tbl", "fld", "rec_id", *shown, "prose_probability", "is_prose"])

        return do

    return map_texts(fields(spark, sf_dir, (INTERPRETATION, DOCUMENT)), make, f"{KEYS}, n_words int, {', '.join(f'{n} double' for n in shown[1:])}, prose_probability double, is_prose boolean")


def p6_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five figures of every record, once, to six places; the part of p6_stats that SQL can say."""
    own = p6_stats(spark, sf_dir).dropDuplicates(["tbl", "fld", "rec_id"])
    return own.select("tbl", "fld", "rec_id", F.col("n_words").cast("long").alias("n_words"), *(half_even(F.col(n), 6).alias(n) for n in NAMES[1:5]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_stats(spark, sf_dir).filter(~F.col("is_prose")).select("tbl", "fld", "rec_id").distinct()


def _abuse_scores(spark: SparkSession, sf_dir: str, which: tuple, extra: dict[str, str] | None = None) -> DataFrame:
    reviewed = pairs(table(spark, sf_dir, "reviewed_texts"), "review_id", "text", "category")
    # texts of fixed tables that are plain by what they are: samples of languages and the books' first passages
    plain = sample_texts(table(spark, sf_dir, "lang_samples"), "sample_id", "text") + sample_texts(table(spark, sf_dir, "books"), "book_id", "opening_passage")
    model = built(AbuseModel, reviewed, plain)
    names = ["tbl", "fld", "rec_id", *(extra or {})]
    sent = spark.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def do(b: pa.RecordBatch) -> pa.RecordBatch:
            p = model.score(b.column(3).to_pylist())
            return pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(p[:, k]) for k in range(len(CATEGORIES)))], names=[*names, *CATEGORIES])

        return do

    return map_texts(fields(spark, sf_dir, which, extra), make, ", ".join([KEYS, *(f"{n} string" for n in extra or {}), *(f"{c} double" for c in CATEGORIES)]))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text of three kinds; null, empty and blank texts have 0. Repeated records have equal rows."""
    return _abuse_scores(spark, sf_dir, (INTERPRETATION, DOCUMENT, WHISPER))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*(F.when(F.col(c) >= ABUSE_FROM, F.lit(c)) for c in CATEGORIES)))
    return p7_scores(spark, sf_dir).filter(F.greatest(*CATEGORIES) >= ABUSE_FROM).select("tbl", "fld", "rec_id", kinds.alias("category")).filter(F.col("category").isNotNull()).distinct()


def p7_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_texts, and per category the share of its texts) over all documents; a null source is a source."""
    scores = _abuse_scores(spark, sf_dir, (DOCUMENT,), {"source": "source"})
    return scores.groupBy("source").agg(F.count("*").alias("n_texts"), *(F.avg((F.col(c) >= ABUSE_FROM).cast("double")).alias(f"{c}_rate") for c in CATEGORIES))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf_dir, "documents"))


def p9_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pool the containers it needs at the least, those of best fit alone, and those it has."""
    return packing.pool_report(p9_containers(spark, sf_dir))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text above the limit has at least two pieces: its second is the one that tells."""
    return p10_pieces(spark, sf_dir).filter(F.col("piece_no") == 1).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_forms, p2_groups, p3_found, p3_redacted, p4_found, p4_ranking, p5_found, p5_stretches, p6_found, p6_figures, p6_stats, p7_found, p7_scores, p7_source_rates, p8_ids, p9_containers, p9_pools, p10_pieces, p10_found)}


_SPACES = r"\x00\s\x0B\x1C-\x1F\x{85}\p{Z}"
_LETTERS = r"\p{L}\p{Mn}\p{Mc}"
_P6_SQL = rf"""WITH r AS (SELECT DISTINCT 'interpretations' AS tbl, 'interpretation' AS fld, interpretation_id AS rec_id, interpretation AS raw FROM interpretations UNION SELECT 'documents', 'text', CAST(doc_id AS VARCHAR), text FROM documents),
x AS (SELECT tbl, fld, rec_id, regexp_replace(coalesce(raw, ''), '[\x{{10000}}-\x{{10FFFF}}]', chr(65533), 'g') AS t FROM r), c AS (SELECT list(lower(word)) AS common FROM common_words WHERE word IS NOT NULL),
f AS (SELECT tbl, fld, rec_id, len(regexp_extract_all(t, '[^{_SPACES}]+')) AS words, length(regexp_replace(t, '[{_SPACES}]+', '', 'g')) AS solid, length(regexp_replace(t, '[{_SPACES}{_LETTERS}\p{{N}}.,;:!?''"()\-‘’“”„…–—«»¿¡]+', '', 'g')) AS signs,
list_filter(string_split_regex(t, '[\n\r\x0B\x0C\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda q: regexp_matches(q, '[^{_SPACES}]')) AS lines, regexp_extract_all(lower(t), '[{_LETTERS}]+(?:[''’][{_LETTERS}]+)*') AS w, common FROM x, c)
SELECT tbl, fld, rec_id, words AS n_words, round_even(CAST(solid AS DOUBLE) / greatest(words, 1), 6) AS mean_word_length, round_even(CAST(signs AS DOUBLE) / greatest(solid, 1), 6) AS symbol_share,
round_even(CAST(len(list_filter(lines, lambda q: regexp_matches(regexp_replace(q, '[{_SPACES}]+$', ''), '(?:[.!?…][\x22''”’»)\]]?|:)$'))) AS DOUBLE) / greatest(len(lines), 1), 6) AS punctuated_line_share, round_even(CAST(len(list_filter(w, lambda q: list_contains(common, q))) AS DOUBLE) / greatest(len(w), 1), 6) AS common_word_share FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"p6_figures": _P6_SQL}
