"""Reader pairs, claims of texts and scores of pairs (JN12-JN23, UF01-UF03, AG21, AG33)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.once import evaluated
from marginalia.functions.rounding import clamp, half_even, largest_of, to_hundred
from marginalia.functions.text import sentences, words
from marginalia.operators.dedup import latest

CLAIM = "array<struct<id:string,claim:string,weight:double,emotional_mode:string>>"
#: Emotional modes of a claim.
MODES = ("philosophical", "prosecutorial", "empathetic", "observational", "aesthetic", "self_referential")
#: Weight of an unmatched claim that isn't known, its share when it doesn't diverge; parts of the confidence and its bounds.
UNKNOWN_WEIGHT, QUIET = 0.10, 0.3
DEPTH, COVERAGE, DOMINANCE, LEAST_CONFIDENCE, MOST_CONFIDENCE = 0.30, 0.40, 0.30, 0.20, 0.95
#: The answers to five questions that speak for agreement in thought and in feeling.
THINK_AGREES, FEEL_AGREES = (True, True, True, False, True), (True, True, True, True, True)
#: What a scorer gives for a pair: matched claims with the shares of agreement, and the claims left on either side.
MATCHED = "array<struct<weight_a:double,weight_b:double,think_r:double,think_c:double,feel_r:double,feel_c:double>>"
LEFT = "array<struct<id:string,divergence:boolean>>"
ANSWERS = "struct<matched_pairs:array<struct<a_id:string,b_id:string,weight_a:double,weight_b:double,think_q:array<boolean>,feel_q:array<boolean>>>,unmatched_a:array<string>,unmatched_b:array<string>>"


def on_passages(notes: DataFrame) -> DataFrame:
    return notes.select("book_id", "passage_id", "user_id").dropna().distinct()


def pair_counts(notes: DataFrame) -> DataFrame:
    """(book_id, passages, pairs): n(n-1)/2 summed over the passages; no pair is formed."""
    per = on_passages(notes).groupBy("book_id", "passage_id").agg(F.count("*").alias("n"))
    return per.groupBy("book_id").agg(F.count("*").alias("passages"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("pairs"))


def partner_counts(notes: DataFrame) -> DataFrame:
    """(book_id, passage_id, user_id, n_partners): how many other readers each reader of a passage can be paired with; the pairs aren't formed."""
    d = on_passages(notes)
    n = d.groupBy("book_id", "passage_id").agg(F.count("*").alias("n"))
    return d.join(n, ["book_id", "passage_id"]).select("book_id", "passage_id", "user_id", (F.col("n") - 1).alias("n_partners"))


def open_partners(notes: DataFrame, runs: DataFrame) -> DataFrame:
    """(book_id, passage_id, user_id, n_open): the partners of a reader that have no run with them on the book yet."""
    d = on_passages(notes)
    pair = runs.select("book_id", F.least("user_a", "user_b").alias("a"), F.greatest("user_a", "user_b").alias("b")).dropna().filter("a <> b").distinct()
    done = pair.select("book_id", F.inline(F.array(F.struct(F.col("a").alias("user_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("user_id"), F.col("a").alias("other")))))
    scored = d.join(done, ["book_id", "user_id"]).join(d.withColumnRenamed("user_id", "other"), ["book_id", "passage_id", "other"], "left_semi").groupBy("book_id", "passage_id", "user_id").agg(F.count("*").alias("done"))
    return partner_counts(notes).join(scored, ["book_id", "passage_id", "user_id"], "left").select("book_id", "passage_id", "user_id", (F.col("n_partners") - F.coalesce("done", F.lit(0))).alias("n_open"))


def first_readers(notes: DataFrame) -> DataFrame:
    """(book_id, passage_id, anchor): the first reader of each passage, ties by the id."""
    live = notes.filter(F.col("book_id").isNotNull() & F.col("passage_id").isNotNull() & F.col("user_id").isNotNull())
    return live.groupBy("book_id", "passage_id").agg(F.min(F.struct(F.col("created_at").isNull().alias("n"), "created_at", "user_id"))["user_id"].alias("anchor"))


def anchor_pairs(notes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(book_id, passage_id, user_a, user_b) with user_a < user_b: each anchor (book_id, passage_id, anchor) with every other reader of its passage."""
    d = on_passages(notes).join(anchors, ["book_id", "passage_id"]).filter("user_id <> anchor")
    return d.select("book_id", "passage_id", F.least("user_id", "anchor").alias("user_a"), F.greatest("user_id", "anchor").alias("user_b")).distinct()


def split_claims(df: DataFrame, text_col: str = "interpretation", splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """`df` with `subclaims`; blank and null texts have none.

    Without `splitter`, which may be a pandas UDF that calls a model, sentences are the
    claims, with weights by their words, at least a tenth, of sum 1. Each step is a column
    of its own, so that nothing is worked out twice within the lambdas.
    """
    live = F.col(text_col).rlike(r"\S")
    if splitter is not None:
        return df.withColumn("subclaims", F.when(live, splitter(F.col(text_col))).otherwise(F.array().cast(CLAIM)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mode = lambda s: F.element_at(F.array(*map(F.lit, MODES)), (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % len(MODES) + 1).cast("int"))
    df = evaluated(df, __s=F.when(live, sentences(F.col(text_col))).otherwise(F.array().cast("array<string>")))
    df = evaluated(df, __n=F.transform("__s", lambda s: F.greatest(F.size(words(s)), F.lit(1)).cast("double")))
    df = evaluated(df, __t=total("__n"))
    df = evaluated(df, __w=F.transform("__n", lambda n: F.greatest(n / F.col("__t"), F.lit(0.1))))
    df = evaluated(df, __z=total("__w"))
    claims = F.transform("__s", lambda s, i: F.struct(F.concat(F.lit("c"), (i + 1).cast("string")).alias("id"), s.alias("claim"), (F.get("__w", i) / F.col("__z")).alias("weight"), mode(s).alias("emotional_mode")))
    return evaluated(df, subclaims=claims).drop("__s", "__n", "__t", "__w", "__z")


def cached_split(notes: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(user_id, book_id, passage_id, n_claims, from_cache): latest text per slot; the splitter sees only slots that the cache lacks."""
    slots = ["user_id", "book_id", "passage_id"]
    live = notes.filter(F.col("book_id").isNotNull() & F.col("passage_id").isNotNull() & F.col("interpretation").rlike(r"\S"))
    if cache is not None:
        live = live.join(cache, slots, "left_anti")
    # texts are split where they lie; the claims' number is what is shuffled
    split = split_claims(live.select(*slots, "interpretation_id", "created_at", "interpretation")).select(*slots, "interpretation_id", "created_at", F.size("subclaims").alias("n_claims"))
    missed = latest(split, slots, "created_at", ["interpretation_id"]).select(*slots, "n_claims", F.lit(False).alias("from_cache"))
    if cache is None:
        return missed
    return cache.join(notes.select(*slots).dropna().distinct(), slots, "left_semi").select(*slots, "n_claims", F.lit(True).alias("from_cache")).unionByName(missed)


def claim_stats(claims: Column) -> dict[str, Column]:
    """Number, entropy, least and largest weight, kinds and most frequent mode of a text's claims; ties of modes go to the least."""
    w = F.transform(claims, lambda x: x["weight"])
    modes = F.array_sort(F.transform(claims, lambda x: x["emotional_mode"]))
    kinds = F.array_distinct(modes)
    often = F.transform(kinds, lambda m: F.struct((-F.size(F.filter(modes, lambda k: k == m))).alias("n"), m.alias("m")))
    return {
        "n_claims": F.size(claims),
        "entropy": half_even(F.aggregate(w, F.lit(0.0), lambda a, x: F.when(x > 0, a - x * F.log2(x)).otherwise(a)), 4),
        "least_weight": half_even(F.coalesce(F.array_min(w), F.lit(0.0)), 4),
        "largest_weight": half_even(F.coalesce(F.array_max(w), F.lit(0.0)), 4),
        "modes": F.array_join(kinds, ", "),
        "modal_mode": F.coalesce(F.array_min(often)["m"], F.lit("none")),
    }


def agreement(answers: Column, agrees: Sequence[bool]) -> Column:
    """Share of five answers that speak for agreement; an answer that is missing doesn't."""
    hits = F.aggregate(F.zip_with(F.slice(answers, 1, 5), F.array(*map(F.lit, agrees)), lambda q, w: F.coalesce((q == w).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return hits.cast("double") / 5


def scoring_of(answers: Column) -> tuple[Column, Column, Column]:
    """(matched, unmatched_a, unmatched_b) out of a scorer's JSON, see ANSWERS; its lists of claims left over hold ids or objects with an id."""
    s = F.from_json(answers, ANSWERS)

    def one(m: Column) -> Column:
        t, f = agreement(m["think_q"], THINK_AGREES), agreement(m["feel_q"], FEEL_AGREES)
        return F.struct(m["weight_a"].alias("weight_a"), m["weight_b"].alias("weight_b"), t.alias("think_r"), (1 - t).alias("think_c"), f.alias("feel_r"), (1 - f).alias("feel_c"))

    left = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(F.coalesce(F.get_json_object(x, "$.id"), x).alias("id"), (F.get_json_object(x, "$.divergence") == "true").alias("divergence"))), F.array().cast(LEFT))
    return F.coalesce(F.transform(s["matched_pairs"], one), F.array().cast(MATCHED)), left(s["unmatched_a"]), left(s["unmatched_b"])


def aggregate_scores(pairs: DataFrame, keys: Sequence[str], offline: bool = False) -> DataFrame:
    """(keys…, think_*, feel_*, dominants, match_count, confidence) of scored pairs.

    `pairs` has claims_a, claims_b (id and weight), wc_a, wc_b and what a scorer gives:
    matched, unmatched_a, unmatched_b. Matched claims count with the smaller of their
    weights; those left over go to divergence: a third if they don't contradict
    anything, whole in the offline form. An id that isn't among the claims weighs a
    tenth. Pairs of no weight at all have no row. Agreement, contradiction and
    divergence sum to 100.
    """
    def weight_in(claims: str, key: Column) -> Column:
        return F.coalesce(F.get(F.filter(claims, lambda x: x["id"] == key), F.lit(-1) + F.size(F.filter(claims, lambda x: x["id"] == key)))["weight"], F.lit(UNKNOWN_WEIGHT))

    share = lambda u: F.lit(1.0) if offline else F.when(u["divergence"], 1.0).otherwise(QUIET)
    total = lambda c, f, z=None: F.aggregate(c, F.lit(0.0) if z is None else z, lambda s, x: s + f(x))
    d = evaluated(pairs, __m=F.transform("matched", lambda x: F.struct(F.least(x["weight_a"], x["weight_b"]).alias("w"), x["think_r"].alias("tr"), x["think_c"].alias("tc"), x["feel_r"].alias("fr"), x["feel_c"].alias("fc"))), __na=F.size("claims_a"), __nb=F.size("claims_b"), __ua=F.transform("unmatched_a", lambda u: share(u) * weight_in("claims_a", u["id"])), __ub=F.transform("unmatched_b", lambda u: share(u) * weight_in("claims_b", u["id"])))
    d = evaluated(d, __d=total("__ub", lambda x: x, total("__ua", lambda x: x)), __n=F.size("__m"), **{f"__{k}": total("__m", lambda x, k=k: x["w"] * x[k]) for k in ("tr", "tc", "fr", "fc")}, __mw=total("__m", lambda x: x["w"]))
    # the order of summation is the matched claims', then those left on a, then on b
    d = evaluated(d, __w=total("__ub", lambda x: x, total("__ua", lambda x: x, F.col("__mw")))).filter("__w <> 0")
    pct = lambda c: F.col(c) / F.col("__w") * 100
    names = ("think_r", "think_c", "think_d", "feel_r", "feel_c", "feel_d")
    d = evaluated(d.drop(*(n for n in names if n in d.columns)), **dict(zip(names, (*to_hundred(pct("__tr"), pct("__tc"), pct("__d")), *to_hundred(pct("__fr"), pct("__fc"), pct("__d"))))))
    most = lambda a, b: F.greatest(a, b).cast("double")
    depth = F.coalesce(F.try_divide(F.least("wc_a", "wc_b").cast("double"), most("wc_a", "wc_b")), F.lit(0.0))
    coverage = F.coalesce(F.try_divide(F.col("__n").cast("double"), most("__na", "__nb")), F.lit(0.0))
    top = lambda p: F.greatest(*(f"{p}_{k}" for k in "rcd"))
    conf = clamp(half_even(DEPTH * depth + COVERAGE * coverage + DOMINANCE * (top("think") + top("feel")) / 200, 2), LEAST_CONFIDENCE, MOST_CONFIDENCE)
    dom = lambda p: largest_of(*(F.col(f"{p}_{k}") for k in "rcd")).alias(f"dominant_{p}")
    return d.select(*keys, *names, dom("think"), dom("feel"), F.col("__n").alias("match_count"), conf.alias("confidence"))


def _bagged(x: Column) -> Column:
    return F.struct(x["id"].alias("id"), x["weight"].alias("weight"), F.array_distinct(F.regexp_extract_all(F.lower(x["claim"]), F.lit(r"\p{L}+"), F.lit(0))).alias("bag"), F.size(words(x["claim"])).alias("wc"))


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """The default scorer: claims (id, weight, bag of words) match one to one by their place; thought agrees as far as they share words, feeling as far as they don't."""
    def one(x: Column) -> Column:
        a, b = x["claims_a"], x["claims_b"]
        q = F.coalesce(F.try_divide(F.size(F.array_intersect(a["bag"], b["bag"])).cast("double"), F.size(F.array_union(a["bag"], b["bag"])).cast("double")), F.lit(0.0))
        t = F.least(F.lit(1.0), 2 * q)
        return F.struct(a["weight"].alias("weight_a"), b["weight"].alias("weight_b"), t.alias("think_r"), (1 - t).alias("think_c"), (1 - q).alias("feel_r"), q.alias("feel_c"))

    d = evaluated(pairs, __k=F.least(F.size("claims_a"), F.size("claims_b")))
    rest = lambda c: F.transform(F.slice(c, F.col("__k") + 1, F.greatest(F.size(c), F.lit(1))), lambda x: F.struct(x["id"].alias("id"), F.lit(False).alias("divergence")))
    return evaluated(d, matched=F.transform(F.slice(F.arrays_zip("claims_a", "claims_b"), 1, F.col("__k")), one), unmatched_a=rest("claims_a"), unmatched_b=rest("claims_b")).drop("__k")


def score_pairs(runs: DataFrame, notes: DataFrame, splitter: Callable[[Column], Column] | None = None, scorer: Callable[[DataFrame], DataFrame] = overlap_scorer, offline: bool = False) -> DataFrame:
    """(run_id, think_*, feel_*, dominants, match_count, confidence) of the runs (run_id, user_a, user_b, book_id, passage_id) whose readers both wrote on the passage.

    `splitter` makes claims of a text, `scorer` adds matched, unmatched_a and unmatched_b
    to rows of claims_a and claims_b; either may be an Arrow function that calls a model.
    """
    slots = ["user_id", "book_id", "passage_id"]
    live = notes.filter(F.col("book_id").isNotNull() & F.col("passage_id").isNotNull() & F.col("interpretation").rlike(r"\S"))
    split = split_claims(live.select(*slots, "interpretation_id", "created_at", "interpretation"), splitter=splitter).select(*slots, "interpretation_id", "created_at", "subclaims")
    split = evaluated(split, claims=F.transform("subclaims", _bagged)).drop("subclaims")
    newest = latest(split, slots, "created_at", ["interpretation_id"])
    side = lambda s: newest.select(F.col("user_id").alias(f"user_{s}"), "book_id", "passage_id", F.col("claims").alias(f"claims_{s}"), F.aggregate("claims", F.lit(0), lambda n, x: n + x["wc"]).alias(f"wc_{s}"))
    both = runs.select("run_id", "user_a", "user_b", "book_id", "passage_id").join(side("a"), ["user_a", "book_id", "passage_id"]).join(side("b"), ["user_b", "book_id", "passage_id"])
    return aggregate_scores(scorer(both.filter((F.size("claims_a") > 0) & (F.size("claims_b") > 0))), ["run_id"], offline)
