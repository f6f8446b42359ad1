"""Annotation of features: metadata in two dialects, names to compounds to pathways, labels and marks for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The annotation columns whose matches are counted.
ANNOTATION_COLUMNS = (
    "Annot. Source: Predicted Compositions",
    "Annot. Source: mzCloud Search",
    "Annot. Source: mzVault Search",
    "Annot. Source: Metabolika Search",
    "Annot. Source: ChemSpider Search",
    "Annot. Source: MassList Search",
)
#: What an annotation column may say, by the count it goes to.
MATCHES = {"annotation_source_matches": "Full match", "annotation_not_top_hit": "Not the top hit", "annotation_partial_matches": "Partial match"}
#: Names that are none, in lower case.
NO_NAMES = ("", "not named", "nan")
#: Short names of gene-set libraries.
LIBRARIES = {
    "GO_Biological_Process_2025": "GO:BP",
    "GO_Molecular_Function_2025": "GO:MF",
    "GO_Cellular_Component_2025": "GO:CC",
    "KEGG_2026": "KEGG",
    "Reactome_Pathways_2024": "Reactome",
}
#: Prefixes of pathway terms.
TERM_PREFIXES = ("REACTOME_", "KEGG_", "WP_")
#: Marks of significance by the q value they lie under.
STARS = ((0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*"))
#: Required columns of a list of modifications.
MODIFICATION_COLUMNS = ("Type", "Name", "Delta_m/z", "Description")


def _text(df: DataFrame, name: str) -> Column:
    """A column as text without nulls, empty if the table lacks it."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _number(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string").try_cast("double") if name in df.columns else F.lit(None).cast("double")


def feature_metadata(df: DataFrame, key: str, polarity: str) -> DataFrame:
    """Feature tables of two dialects in one form.

    A table with LipidID and no Name is of the lipid dialect: the compound name loses its adduct if the row has one, and
    there are no match counts. Absent columns give empty text, null numbers or zero counts.
    """
    lipid = "LipidID" in df.columns and "Name" not in df.columns
    name = _text(df, "LipidID" if lipid else "Name")
    group = F.when(_text(df, "AdductIon") != "", F.regexp_replace(name, "([+-].+)$", "")).otherwise(name) if lipid else name
    counts = {out: sum((F.coalesce((F.col(f"`{c}`") == says).cast("int"), F.lit(0)) for c in ANNOTATION_COLUMNS if c in df.columns), F.lit(0)) if not lipid else F.lit(0) for out, says in MATCHES.items()}
    mz, rt, formula = ("CalcMz", "BaseRt", "IonFormula") if lipid else ("m/z", "RT [min]", "Formula")
    return df.select(
        F.col(key).cast("string").alias("feature"), name.alias("annotation_name"), group.alias("compound_group_name"), _text(df, formula).alias("formula"), _number(df, mz).alias("mz"), _number(df, rt).alias("rt"),
        *(c.cast("int").alias(k) for k, c in counts.items()), (~F.lower(name).isin(*NO_NAMES)).alias("is_named"), F.lit(polarity).alias("polarity"))


def required(df: DataFrame, columns: tuple[str, ...] = MODIFICATION_COLUMNS) -> DataFrame:
    """The named columns in this order; a table that lacks one is refused."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*(F.col(f"`{c}`") for c in columns))


def stars(q: Column) -> Column:
    """Marks of significance; none for larger or missing q."""
    out = F.lit("")
    for under, mark in reversed(STARS):
        out = F.when(q < under, mark).otherwise(out)
    return out


def term_label(term: Column, most: int = 55) -> Column:
    """A pathway term for reports: without its last bracket, prefixes turned into title case, cut to a length."""
    t = F.regexp_replace(term, r"^(.*) \(.*$", "$1")
    for prefix in TERM_PREFIXES:
        t = F.when(t.startswith(prefix), F.initcap(F.replace(F.substring(t, len(prefix) + 1, 10_000), F.lit("_"), F.lit(" ")))).otherwise(t)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def library_name(library: Column) -> Column:
    out = library
    for long, short in LIBRARIES.items():
        out = F.when(library == long, short).otherwise(out)
    return out


def looked_up(names: DataFrame, name: str, listed: DataFrame, simplify) -> DataFrame:
    """name, id: the first id that the list gives for each distinct name, else for its simplified form; null without any.

    listed: ``listed_name, id, rank``. The list takes the place of a remote lookup with a cache: a name is asked once.
    """
    first = listed.groupBy(F.lower("listed_name").alias("_n")).agg(F.min_by("id", F.struct("rank", "id")).alias("id"))
    asked = names.where(F.col(name).isNotNull()).select(name).distinct()
    a, b = first.withColumnsRenamed({"_n": "_n1", "id": "_id1"}), first.withColumnsRenamed({"_n": "_n2", "id": "_id2"})
    return asked.join(a, F.lower(name) == F.col("_n1"), "left").join(b, F.lower(simplify(F.col(name))) == F.col("_n2"), "left").select(name, F.coalesce("_id1", "_id2").alias("id"))


def significant(results: DataFrame, q: float = 0.05, log2fc: float | None = None) -> DataFrame:
    """Tested rows under q; with log2fc also of at least this change. Excluded rows are none."""
    hit = (F.col("q_value") < q) & ~F.coalesce("excluded", F.lit(False))
    return results.where(hit if log2fc is None else hit & (F.abs("log2fc") >= log2fc))
