"""Clinical and placental tables: recodes, indicators, bins, one-hot columns and derived outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand-ins for missing answers.
PLACEHOLDERS = ("n/a", "na", "unknown", "declined", "unspecified", "not applicable", "missing", "nan", "none", "null")
#: Codes of placental findings; a table need not have all of them.
PLACENTAL_CODES = {
    "distal_villous_hypoplasia": {"yes": 1},
    "accelerated_villous_maturation": {"yes": 1},
    "increased_syncytial_knots": {"yes": 1},
    "delayed_villous_maturation": {"yes": 1},
    "increased_perivillous_fibrin_deposition": {"yes": 1},
    "chorangiosis": {"yes": 1},
    "segmental_avascular_villi": {"yes,_small": 1, "yes/i": 2, "yes,_large": 3},
    "maternal_inflammatory_response_stage": {"s1/g1": 1, "s2/g1": 2, "s3/g1": 3},
    "villitis_of_unknown_etiology": {"yes/l": 1, "yes,_lg,_focal": 1, "yes/h": 2, "yes,_hg,_focal": 2},
    "decidual_arteriopathy": {"yes": 1, "yes_(thrombosed)": 1, "yes,_roll": 1},
}
#: What says that a birth was early by itself, and what race answers are told by.
SPTB_WORD, LABOR_BY_ITSELF = "sptb", ("spontaneous", "prom", "0")
RACE_WORDS = {"race_white": "white", "race_black": "black|african|africian", "race_asian": "asian|korean"}
#: An ethnicity that denies, and one that affirms.
DENIES, AFFIRMS = "^(not|non|no)", "hispanic|latin"
#: Bins as (upper edge, whether the edge belongs below it, label); the last label has no edge.
BINS = {
    "maternal_age": ((24, True, "18-24"), (29, True, "25-29"), (34, True, "30-34"), (39, True, "35-39"), (None, None, "40+")),
    "bmi": ((18.5, False, "Underweight"), (25, False, "Normal"), (30, False, "Overweight"), (40, False, "Obese"), (None, None, "Severely Obese")),
    "gest_age_del": ((34, False, "<34"), (37, False, "34-36.9"), (40, False, "37-39.9"), (None, None, "40+")),
    "birthweight": ((2500, False, "<2500"), (3000, False, "2500-2999"), (3500, False, "3000-3499"), (None, None, "3500+")),
    "apgar": ((3, True, "0-3"), (6, True, "4-6"), (None, None, "7-10")),
}


def lowered(df: DataFrame, keep: list[str]) -> DataFrame:
    """Trim and lower all text but the columns to keep."""
    return df.select(*(F.lower(F.trim(f.name)).alias(f.name) if f.dataType.simpleString() == "string" and f.name not in keep else F.col(f.name) for f in df.schema.fields))


def unmasked(c: Column, words: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """Null for blanks and stand-ins."""
    return F.when(~F.coalesce(F.lower(F.trim(c)).isin("", *words), F.lit(True)), c)


def binned(c: Column, edges: tuple) -> Column:
    """Label of a number; null for null and NaN."""
    v = c.cast("double")
    out = F.when(v.isNull() | F.isnan(v), None)
    for edge, closed, label in edges[:-1]:
        out = out.when(v <= edge if closed else v < edge, label)
    return out.otherwise(edges[-1][2])


def counted_bin(c: Column, none: str, few: str, upto: int, many: str) -> Column:
    """Three labels for a count: none, one to upto, all else."""
    return F.when(c.isNull(), None).when(c == 0, none).when((c >= 1) & (c <= upto), few).otherwise(many)


def cut_right(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Bins open on the left and closed on the right; null outside the first edge."""
    out = F.when(c.isNull() | (c <= edges[0]), None)
    for upper, label in zip(edges[1:], labels, strict=True):
        out = out.when(c <= upper, label)
    return out


def coded(c: Column, codes: dict[str, int]) -> Column:
    """Code of a finding; 0 where nothing listed is found."""
    out = F.lit(None).cast("int")
    for word, code in codes.items():
        out = F.when(c == word, code).otherwise(out)
    return F.coalesce(out, F.lit(0))


def spontaneous_preterm(group: Column, subgroup: Column, labor: Column, weeks: Column) -> Column:
    """1 if a group says so, or labor began by itself before 37 weeks."""
    said = F.coalesce(F.lower(group).contains(SPTB_WORD), F.lit(False)) | F.coalesce(F.lower(subgroup).contains(SPTB_WORD), F.lit(False))
    early = F.coalesce(F.lower(labor).isin(*LABOR_BY_ITSELF) & (weeks < 37) & ~F.isnan(weeks), F.lit(False))
    return (said | early).cast("int")


def smoking_code(c: Column) -> Column:
    """1 for yes, 0 for all else."""
    return F.coalesce((F.lower(F.trim(c)) == "yes").cast("int"), F.lit(0))


def race_flags(c: Column) -> dict[str, Column]:
    """Flags by words in the answer; null counts as none."""
    r = F.lower(F.trim(c))
    return {name: F.coalesce(r.rlike(words).cast("int"), F.lit(0)) for name, words in RACE_WORDS.items()}


def hispanic_flag(c: Column) -> Column:
    """1, 0 or null for unknown answers; an answer that denies counts as 0."""
    e = F.lower(F.trim(c))
    return F.when(e.isNull() | e.isin("", *PLACEHOLDERS), None).when(e.rlike(DENIES), 0).when(e.rlike(AFFIRMS), 1).otherwise(0)


def pooled(group: Column) -> Column:
    """Control or Complication; null counts as Complication."""
    return F.when(group == "Control", "Control").otherwise("Complication")


def dummies(df: DataFrame, keys: list[str], category: str, levels: list[str]) -> DataFrame:
    """One 0/1 column per level."""
    return df.select(*keys, *(F.coalesce((F.col(category) == v).cast("int"), F.lit(0)).alias(f"{category}_{i}") for i, v in enumerate(levels)))
