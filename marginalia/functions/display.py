"""Expressions for what readers are shown, and for names made from other names (TX31-TX42)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

#: The smallest share of a strong and of a moderate lead, the gap below which two shares count as even, the share below which even ones are split.
STRONG, MODERATE, EVEN, SPLIT_BELOW = 0.60, 0.40, 0.15, 0.40
#: Words for how strongly a share shows, by label: (from this per cent on, word), the first that fits.
QUALIFIERS = {"resonate": ((60, "highly"), (40, ""), (0, "somewhat")), "contradict": ((50, "strongly"), (30, ""), (0, "a little")), "diverge": ((50, "broadly"), (20.000001, ""), (0, "less"))}
#: Words in a log message that tell its task, tried in this order.
TASK_WORDS = {
    "Data Acquisition": ("acquire", "acquisition", "load data", "download", "data/raw"),
    "Bias Detection": ("bias", "demographic", "gender", "age"),
    "Preprocessing": ("preprocessing", "preprocess", "process_books", "data/processed"),
    "Schema Stats": ("schema", "statistics", "stats"),
    "Validation": ("validation", "validate"),
    "Upload": ("upload", "uploading"),
    "Notification": ("notify", "notification", "email", "pipeline complete"),
}


def mapped(x: Column, names: Mapping[str, str]) -> Column:
    """The name that stands for another one; a name outside the map, and null, stay."""
    if not names:
        return x
    return F.coalesce(F.create_map(*(F.lit(v) for kv in names.items() for v in kv))[x], x)


def capitalised(x: Column) -> Column:
    """A text wholly in capitals with only its first letter large; any other stays."""
    return F.when((x == F.upper(x)) & (x != F.lower(x)), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))).otherwise(x)


def safe_name(x: Column, prefix: str = "staging_", longest: int = 1024) -> Column:
    """A run's id as a name of letters, digits and underscores."""
    return F.substring(F.concat(F.lit(prefix), F.translate(x, "-:+.T", "_____")), 1, longest)


def task_name(message: Column, words: Mapping[str, Sequence[str]] = TASK_WORDS) -> Column:
    """What stands in brackets at a message's start, else the first task one of whose words it holds, else 'General'."""
    low = F.lower(message)
    found = F.lit("General")
    for task, of in reversed(words.items()):
        found = F.when(F.greatest(*(F.contains(low, F.lit(w)) for w in of), F.lit(False)), task).otherwise(found)
    return F.when(message.rlike(r"^\[[^\]]+\]"), F.regexp_extract(message, r"^\[([^\]]+)\]", 1)).otherwise(found)


def band(r: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """(strength, key) of three parts: strong, moderate, weak or split, and R, C or D for the largest, the first on a tie; null without any."""
    total = r + c + d
    share = [F.try_divide(x.cast("double"), total.cast("double")) for x in (r, c, d)]
    most = F.greatest(*share)
    second = F.element_at(F.sort_array(F.array(*share)), 2)
    strength = F.when(most.isNull(), None).when((most - second < EVEN) & (most < SPLIT_BELOW), "split").when(most >= STRONG, "strong").when(most >= MODERATE, "moderate").otherwise("weak")
    return strength, F.when(most.isNull(), None).when(share[0] == most, "R").when(share[1] == most, "C").otherwise("D")


def overlap_label(n: Column) -> Column:
    return F.when(n >= 8, "high overlap").when(n >= 4, "solid overlap").otherwise("some overlap")


def bars(r: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Three parts as per cent of their sum; null where it is 0."""
    total = (r + c + d).cast("double")
    return tuple(F.try_divide(x.cast("double"), total) * 100 for x in (r, c, d))


def qualifier(label: str, pct: Column) -> Column:
    """The word for how strongly a share of this label shows; empty for a middling one."""
    out = F.lit(None).cast("string")
    for least, word in reversed(QUALIFIERS[label]):
        out = F.when(pct >= least, word).otherwise(out)
    return out


def progress(n: Column) -> Column:
    """How far a reader's picture has come, by the number of texts."""
    return F.when(n <= 3, "starting").when(n <= 6, "shaping").otherwise("settled")
