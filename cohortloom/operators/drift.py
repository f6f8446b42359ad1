"""Schemas that drift between files (problem 2).

Method: each file gets a fingerprint of its fields and types; along a series the fingerprints are numbered as schema
versions. Where the fingerprint changes, explicit migration steps are derived: rename, default (added), drop (removed)
and cast (type changed). A rename is proved by values: records that a file repeats from the one before are found by
keys that stand for one record on either side, and a field that went and a field that came are one if their values in
those records agree. Every line is then routed through the renames of its own series, from its own file on, and
through the casts of the table's columns; what cannot be cast is recorded beside the line.

Lines are parsed once. All comparing of files is done on one row per file; of lines only hashes are shuffled, a number
of them in proportion to the fields.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut

SERIES = ["export_name", "site_code"]
#: Share of the repeated records in which a renamed field's values must agree.
AGREE = 0.8
#: What the key of all kept fields counts among the keys that speak for a pair of records, and the least they must give.
NAMED_KEY, LEAST_KEYS = 4, 2
#: Share of the values of the smaller record that two records without the same named key must have in common.
COMMON = 0.5
#: The most field names that one table is built from.
MOST_FIELDS = 5000


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with their payload as a map of variants; null where the payload is no JSON object."""
    return lines.withColumn("m", F.from_json("payload", "map<string,variant>"))


def _kind(schema: Column) -> Column:
    return (F.when(schema == "VOID", None).when(schema == "STRING", "text").when(schema == "BOOLEAN", "boolean")
            .when(schema.startswith("OBJECT") | schema.startswith("ARRAY"), "object").otherwise("number"))


def _text(value: Column) -> Column:
    """A value as text; of an object its ``value`` if it has one."""
    inner = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$.value", "string"))
    return F.coalesce(inner, value.cast("string"))


UNIT_NUMBER = r"^\s*[+-]?[0-9][0-9,]*([.][0-9]+)?\s*[A-Za-z/%]*\s*$"
CODE_NUMBER = r"^[A-Za-z][A-Za-z0-9]*[-_ ]+0*([0-9]{1,15})$"


def as_number(text: Column) -> Column:
    """A number that may carry thousands separators and a unit."""
    return F.when(text.rlike(UNIT_NUMBER), F.regexp_extract(F.regexp_replace(text, ",", ""), r"([+-]?[0-9]+([.][0-9]+)?)", 1).try_cast("double"))


def as_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "y", "checked"), True).when(t.isin("false", "no", "n", "unchecked"), False)


def token(text: Column) -> Column:
    """One number for all ways to write down a value: by its number, its truth value, or its letters and digits."""
    n = F.coalesce(as_number(text), F.regexp_extract(text, CODE_NUMBER, 1).try_cast("double"))
    b = as_boolean(text)
    plain = F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    return F.when(n.isNotNull(), F.xxhash64(F.lit("#"), n)).when(b.isNotNull(), F.xxhash64(F.lit("?"), b)).when(plain != "", F.xxhash64(plain))


def read_cells(lines: DataFrame) -> DataFrame:
    """All lines with their cells ``(field, kind, token)``, parsed once. Of a name given twice the first counts."""
    value = lambda k: F.try_element_at(F.col("m"), k)
    typed = F.transform(F.array_distinct(F.map_keys("m")), lambda k: F.struct(k.alias("field"), _kind(F.schema_of_variant(value(k))).alias("kind"), _text(value(k)).alias("text")))
    cells = F.transform("c", lambda c: F.struct(c["field"].alias("field"), c["kind"].alias("kind"), F.when(c["kind"].isNotNull(), token(c["text"])).alias("token")))
    return cut(parsed(lines).select(*SERIES, "file_name", "exported_at", typed.alias("c")).select(*SERIES, "file_name", "exported_at", cells.alias("cells")))


def files_of(read: DataFrame) -> DataFrame:
    """One row per file in its series: seq, lines, schema (fields with the type of most non-null values, ties: first by
    name), fingerprint, version and the schema before."""
    flat = read.select(*SERIES, "file_name", "exported_at", F.posexplode_outer("cells").alias("at", "c")).groupBy(*SERIES, "file_name", F.col("c.field").alias("field")).agg(
        F.min("exported_at").alias("exported_at"), F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("n_lines"), F.count("c").alias("n"),
        *(F.count_if(F.col("c.kind") == k).alias(k) for k in ("boolean", "number", "object", "text")))
    ranked = F.array_sort(F.array_compact(F.array(*(F.when(F.col(k) > 0, F.struct((-F.col(k)).alias("n"), F.lit(k).alias("kind"))) for k in ("boolean", "number", "object", "text")))))
    field = F.struct("field", F.get(ranked, F.lit(0))["kind"].alias("kind"))
    f = flat.groupBy(*SERIES, "file_name").agg(F.min("exported_at").alias("exported_at"), F.sum("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), field))).alias("schema"))
    w = Window.partitionBy(*SERIES).orderBy(F.col("exported_at").asc_nulls_first(), "file_name")
    prints = F.transform("schema", lambda x: F.concat_ws(":", x["field"], F.coalesce(x["kind"], F.lit("none"))))
    f = f.withColumn("fingerprint", F.when(F.size("schema") > 0, F.sha2(F.array_join(prints, "|"), 256)).otherwise(""))
    f = f.withColumn("seq", F.row_number().over(w)).withColumn("before", F.lag("schema").over(w)).withColumn("_new", F.when(F.lag("fingerprint").over(w).eqNullSafe(F.col("fingerprint")), 0).otherwise(1))
    return f.withColumn("version", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def versions(lines: DataFrame) -> DataFrame:
    """Each file with its schema fingerprint and version: the number of changes of fingerprint so far in its series."""
    return files_of(read_cells(lines)).select(*SERIES, "file_name", "exported_at", "n_lines", "seq", "fingerprint", "version")


def _safe(df: DataFrame, extra: list[str]) -> DataFrame:
    """Keys renamed with a leading underscore, for null-safe joins."""
    return df.withColumnsRenamed({c: f"_{c}" for c in SERIES + extra})


def _on(cols: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).eqNullSafe(F.col(prefix + c))
    return out


def _steps(files: DataFrame) -> DataFrame:
    """The migration steps of each file whose fingerprint differs from the one before: fields gone, come and kept."""
    names = lambda c: F.transform(c, lambda x: x["field"])
    after, before = names(F.col("schema")), names(F.col("before"))
    w = Window.partitionBy(*SERIES).orderBy("seq")
    s = files.withColumn("_was", F.lag("fingerprint").over(w)).withColumn("moved", F.col("before").isNotNull() & (F.col("_was") != F.col("fingerprint")))
    return s.select(*SERIES, F.xxhash64(*SERIES).alias("sid"), "file_name", "seq", "moved", "schema", "before", F.when(F.col("moved"), F.array_except(before, after)).alias("gone"),
                    F.when(F.col("moved"), F.array_except(after, before)).alias("come"), F.when(F.col("moved"), F.array_sort(F.array_intersect(before, after))).alias("kept"))


def renames(read: DataFrame, steps: DataFrame) -> DataFrame:
    """Proved renames: series, seq of the later file, old and new field, records compared and in agreement.

    Records are compared where the scarcer of the two fields has a value.
    """
    open_ = F.col("moved") & (F.size("gone") > 0) & (F.size("come") > 0)
    w = Window.partitionBy(*SERIES).orderBy("seq")
    role = lambda seq, side, wanted, kept: F.struct(seq.alias("seq"), F.lit(side).alias("side"), wanted.alias("wanted"), kept.alias("kept"))
    c = F.col
    # a line takes part in the boundary before its file and in the one after it
    roles = steps.withColumn("_open", open_).withColumns({f"_{k}": F.lead(k).over(w) for k in ("gone", "kept", "seq")} | {"_next": F.coalesce(F.lead("_open").over(w), F.lit(False))}).select(
        *(c(k).alias(f"_{k}") for k in SERIES), c("file_name").alias("_file_name"), "sid",
        F.array_compact(F.array(F.when(c("_open"), role(c("seq"), 1, c("come"), c("kept"))), F.when(c("_next"), role(c("_seq"), 0, c("_gone"), c("_kept"))))).alias("roles")).where(F.size("roles") > 0)
    at = read.where("cells is not null").join(roles, _on(SERIES + ["file_name"], "_")).select("sid", F.explode("roles").alias("r"), "cells").select("sid", "r.*", "cells")
    value = lambda f: F.get(F.filter("cells", lambda x: x["field"] == f), F.lit(0))["token"]
    tokens = F.array_distinct(F.array_compact(F.transform("cells", lambda x: x["token"])))
    named = F.when(F.size("kept") > 0, F.xxhash64(F.lit("kept"), F.transform("kept", value)))
    keys = F.concat(F.array_compact(F.array(F.struct(named.alias("k"), F.lit(NAMED_KEY).alias("says")))), F.transform(tokens, lambda t: F.struct(t.alias("k"), F.lit(1).alias("says"))))
    # equal lines of a file are one record, named by the hash of its cells
    rec = F.xxhash64(F.transform("cells", lambda x: F.struct(x["field"], x["token"])))
    once = cut(at.select("sid", "seq", "side", rec.alias("rec"), F.transform("wanted", value).alias("w"), keys.alias("keys")))
    told = once.select("sid", "seq", "side", "rec", F.explode("keys").alias("k")).select("sid", "seq", "side", "rec", "k.*").where("k is not null")
    of = lambda s: F.when(c("side") == s, c("rec"))
    # every value is a key; only keys that stand for one record on either side pair records, so nothing is multiplied out
    single = told.groupBy("sid", "seq", "k", "says").agg(F.min(of(0)).alias("r0"), F.max(of(0)).alias("m0"), F.min(of(1)).alias("r1"), F.max(of(1)).alias("m1")).where("r0 = m0 and r1 = m1")
    votes = single.groupBy("sid", "seq", "r0", "r1").agg(F.sum("says").alias("says"), (F.max("says") == NAMED_KEY).alias("named")).where(c("says") >= LEAST_KEYS)
    pairs = votes.groupBy("sid", "seq", "r1").agg(F.max(F.struct("says", "r0", "named")).alias("b")).groupBy("sid", "seq", c("b.r0").alias("r0")).agg(F.max(F.struct(c("b.says").alias("says"), "r1", c("b.named").alias("named"))).alias("b")).select("sid", "seq", "r0", c("b.r1").alias("r1"), c("b.named").alias("named"))
    side = lambda s: once.where(c("side") == s).groupBy("sid", "seq", c("rec").alias(f"r{s}")).agg(F.first("w").alias(f"w{s}"), F.first("keys.k").alias(f"k{s}"))
    # a value or two may be the same by chance
    common = F.size(F.array_intersect("k0", "k1")) >= COMMON * F.least(F.size("k0"), F.size("k1"))
    both = pairs.join(side(0), ["sid", "seq", "r0"]).join(side(1), ["sid", "seq", "r1"]).where(c("named") | common)
    # one row per field with a value (other side -1) and one per two fields that agree, counted map-side
    there = lambda a, old: F.array_compact(F.transform(F.col(a), lambda t, i: F.when(t.isNotNull(), F.struct((i if old else F.lit(-1)).alias("o"), (F.lit(-1) if old else i).alias("n")))))
    equal = F.flatten(F.transform("w0", lambda t, i: F.array_compact(F.transform("w1", lambda u, j: F.when(t == u, F.struct(i.alias("o"), j.alias("n")))))))
    counts = both.select("sid", "seq", F.explode(F.concat(there("w0", True), there("w1", False), equal)).alias("x")).groupBy("sid", "seq", "x.o", "x.n").agg(F.count(F.lit(1)).alias("c"))
    agree = counts.where("o >= 0 and n >= 0").select("sid", "seq", "o", "n", c("c").alias("n_agree"))
    olds, news = counts.where("n < 0").select("sid", "seq", "o", c("c").alias("c0")), counts.where("o < 0").select("sid", "seq", "n", c("c").alias("c1"))
    seen = agree.join(olds, ["sid", "seq", "o"]).join(news, ["sid", "seq", "n"]).join(steps.select(*SERIES, "sid", "seq", "gone", "come"), ["sid", "seq"]).select(
        *SERIES, "seq", F.get("gone", c("o")).alias("old_field"), F.get("come", c("n")).alias("new_field"), F.least("c0", "c1").alias("n_compared"), "n_agree")
    plain = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    likeness = -F.levenshtein(plain(c("old_field")), plain(c("new_field")))
    good = seen.where(c("n_agree") >= AGREE * c("n_compared")).withColumn("rank", F.struct("n_agree", likeness, "old_field", "new_field"))
    best = lambda f: F.row_number().over(Window.partitionBy(*SERIES, "seq", f).orderBy(F.desc("rank"))) == 1
    return good.withColumn("a", best("old_field")).withColumn("b", best("new_field")).where("a and b").select(*SERIES, "seq", "old_field", "new_field", "n_compared", "n_agree")


def _migrations(read: DataFrame) -> DataFrame:
    """Files with their steps, the proved renames gathered beside them; one row per file."""
    steps = cut(_steps(files_of(read)))
    moved = renames(read, steps).groupBy(*SERIES, "seq").agg(F.collect_list(F.struct("old_field", "new_field", "n_compared", "n_agree")).alias("renamed"))
    return steps.join(_safe(moved, ["seq"]), _on(SERIES + ["seq"], "_"), "left").select(*steps.columns, "renamed")


def _changes(migrations: DataFrame) -> DataFrame:
    c = F.col
    kind = lambda schema, f: F.get(F.filter(schema, lambda x: x["field"] == f), F.lit(0))["kind"]
    none, text = F.lit(None).cast("long"), F.lit("")
    one = lambda what, old, new, a, b, n=none, k=none: F.struct(F.lit(what).alias("change_kind"), old.alias("old_field"), new.alias("new_field"), a.cast("string").alias("old_type"), b.cast("string").alias("new_type"), n.alias("n_compared"), k.alias("n_agree"))
    ren = F.coalesce("renamed", F.array().cast("array<struct<old_field:string,new_field:string,n_compared:bigint,n_agree:bigint>>"))
    x = migrations.where("moved").withColumn("renamed", ren)
    old_of, new_of = F.transform("renamed", lambda r: r["old_field"]), F.transform("renamed", lambda r: r["new_field"])
    added = F.transform(F.array_except("come", new_of), lambda f: one("added", text, f, F.lit(None), kind("schema", f)))
    removed = F.transform(F.array_except("gone", old_of), lambda f: one("removed", f, text, kind("before", f), F.lit(None)))
    renamed = F.transform("renamed", lambda r: one("renamed", r["old_field"], r["new_field"], kind("before", r["old_field"]), kind("schema", r["new_field"]), r["n_compared"], r["n_agree"]))
    cast_kept = F.transform("kept", lambda f: one("type_changed", f, f, kind("before", f), kind("schema", f)))
    cast_moved = F.transform("renamed", lambda r: one("type_changed", r["old_field"], r["new_field"], kind("before", r["old_field"]), kind("schema", r["new_field"]), r["n_compared"], r["n_agree"]))
    casts = F.filter(F.concat(cast_kept, cast_moved), lambda s: s["old_type"].isNotNull() & s["new_type"].isNotNull() & (s["old_type"] != s["new_type"]))
    return x.select(*SERIES, "file_name", "seq", F.explode(F.concat(added, removed, renamed, casts)).alias("s")).select(*SERIES, "file_name", "seq", c("s.*"))


def changes(lines: DataFrame) -> DataFrame:
    """Every change of a file against the file before it in its series.

    ``change_kind`` is added, removed, renamed or type_changed. Field order, the way a text is written and words in a
    field of numbers are no change; a field without any value has no type. Lines that hold no JSON object, null
    payloads included, have no fields; the first file of a series has no change. Null names of exports, sites and
    files are values like others.
    """
    return _changes(_migrations(read_cells(lines)))


# ---- one table


def plain_name(name: str) -> str:
    """A field name as a column name: words in lower case, joined by underscores."""
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_") or "field"


def pooled_names(names: dict[str, int], moved: list[tuple[str, str]], together: set[tuple[str, str]]) -> dict[str, str]:
    """Field name -> column, over all series.

    Names that differ in case and punctuation only, and names that some series renamed into one another, share a
    column, unless any names of the two groups ever stand in one file (``together``): those mean different things.
    Renames seen in more series come first in ``moved``.
    """
    plain = {n: plain_name(n) for n in names}
    group: dict[str, set[str]] = {n: {n} for n in names}
    apart = together | {(b, a) for a, b in together}

    def unite(a: str, b: str) -> None:
        ga, gb = group[a], group[b]
        if ga is gb or any((x, y) in apart for x in ga for y in gb):
            return
        ga |= gb
        for n in gb:
            group[n] = ga

    first: dict[str, str] = {}
    for n in sorted(names):
        unite(first.setdefault(plain[n].replace("_", ""), n), n)
    for a, b in moved:
        if a in names and b in names:
            unite(a, b)
    taken: set[str] = set()
    out: dict[str, str] = {}
    for members in sorted({id(g): sorted(g) for g in group.values()}.values()):
        weight: dict[str, int] = {}
        for n in members:
            weight[plain[n]] = weight.get(plain[n], 0) + names[n]
        base = max(sorted(weight), key=lambda p: weight[p])
        name, k = base, 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        out |= {n: name for n in members}
    return out


def routes(migrations: DataFrame) -> DataFrame:
    """Per file: field -> the name it has in the end, after the renames of the series' later files, chained."""
    w = Window.partitionBy(*SERIES).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    # a series' renames are steps of its schema, not rows: each file sees those after it, in order
    ahead = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("renamed") > 0, F.struct("seq", "renamed"))).over(w)), lambda x: x["renamed"]))
    final = lambda f: F.aggregate("ahead", f, lambda at, r: F.when(at == r["old_field"], r["new_field"]).otherwise(at))
    return migrations.withColumn("ahead", ahead).select(*SERIES, "file_name", F.transform("schema", lambda x: F.struct(x["field"].alias("field"), final(x["field"]).alias("final"))).alias("route"))


def one_table(lines: DataFrame) -> DataFrame:
    """All lines with the same typed fields, and the schema version they came in.

    Each file's fields take the names that the chained renames of its own series give them; over series, names are
    pooled only if they never stand in one file. A column becomes number, boolean, date or text by how most of its
    values over all files can be read; an absent field takes null as default, a value that cannot be read becomes null
    and its column is listed in ``failed_casts``, and codes written as bare numbers in some files get their form from
    the others. Should two fields of one line meet in a column after all, the first by name is kept and the column is
    listed in ``clashes``. ``readable`` is false for lines without a JSON object; they stay as rows. Repeated lines stay
    repeated. Names of the own columns are kept apart from equal field names by a trailing _field.
    """
    read = read_cells(lines)
    migrations = cut(_migrations(read))
    route = cut(routes(migrations))
    finals = route.select(F.explode(F.array_distinct(F.transform("route", lambda x: x["final"]))).alias("f"), F.array_distinct(F.transform("route", lambda x: x["final"])).alias("with"))
    known = finals.groupBy("f").agg(F.count(F.lit(1)).alias("n")).limit(MOST_FIELDS + 1).collect()
    if len(known) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} field names: no table can hold them")
    names = {r["f"]: r["n"] for r in known}
    # both lists are pairs of the names above
    moved = [(r["old_field"], r["new_field"]) for r in migrations.select(F.explode("renamed").alias("r")).select("r.*").groupBy("old_field", "new_field").count().orderBy(F.desc("count"), "old_field", "new_field").collect()]
    together = {(r["f"], r["g"]) for r in finals.select("f", F.explode("with").alias("g")).where("f < g").distinct().collect()}
    to = pooled_names(names, moved, together)
    own = {"raw_id", "export_name", "site_code", "file_name", "line_no", "schema_version", "readable", "failed_casts", "clashes"}
    spark = lines.sparkSession
    column = F.broadcast(spark.createDataFrame(sorted(to.items()), "_final string, _column string"))  # at most MOST_FIELDS
    by_file = route.select(*SERIES, "file_name", F.explode("route").alias("x")).join(column, F.col("x.final") == F.col("_final")).groupBy(*SERIES, "file_name").agg(
        F.map_from_entries(F.collect_list(F.struct("x.field", "_column"))).alias("to"))
    v = files_of(read).select(*SERIES, "file_name", F.col("version").alias("schema_version"))
    files = v.join(_safe(by_file, ["file_name"]), _on(SERIES + ["file_name"], "_"), "left").select(*v.columns, "to")
    rows = parsed(lines).join(_safe(files, ["file_name"]), _on(SERIES + ["file_name"], "_"), "left")
    placed = F.array_sort(F.transform(F.array_distinct(F.map_keys("m")), lambda k: F.struct(F.try_element_at("to", k).alias("c"), k.alias("f"))))
    filled = F.filter(placed, lambda p: p["c"].isNotNull() & (F.schema_of_variant(F.try_element_at(F.col("m"), p["f"])) != "VOID"))
    rows = rows.withColumn("p", filled)
    first = F.filter("p", lambda p, i: (i == 0) | (F.get("p", i - 1)["c"] != p["c"]))
    texts = F.map_from_entries(F.transform(first, lambda p: F.struct(p["c"], _text(F.try_element_at(F.col("m"), p["f"])))))
    clashes = F.array_distinct(F.transform(F.filter("p", lambda p, i: (i > 0) & (F.get("p", i - 1)["c"] == p["c"])), lambda p: p["c"]))
    rows = cut(rows.select("raw_id", *SERIES, "file_name", "line_no", "schema_version", F.col("m").isNotNull().alias("readable"), texts.alias("t"), clashes.alias("clashes")))
    x = F.col("x")
    code = F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9]*-)[0-9]{7}$", 1)
    facts = {r["column"]: r for r in rows.select(F.explode("t").alias("column", "x")).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(as_number(x).isNotNull()).alias("number"), F.count_if(as_boolean(x).isNotNull()).alias("boolean"),
        F.count_if(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).alias("date"), F.count_if(code != "").alias("code"), F.max(code).alias("prefix")).collect()}
    out, failed = [], []
    for name in sorted(set(to.values())):
        text, r = F.try_element_at("t", F.lit(name)), facts.get(name)
        value = text
        if r and r["code"] >= 0.3 * r["n"]:
            value = F.when(text.rlike("^[0-9]{1,7}$"), F.concat(F.lit(r["prefix"]), F.lpad(text, 7, "0"))).otherwise(text)
        elif r and r["date"] >= 0.8 * r["n"]:
            value = text.try_cast("date")
        elif r and r["boolean"] >= 0.8 * r["n"]:
            value = as_boolean(text)
        elif r and r["number"] >= 0.8 * r["n"]:
            value = as_number(text)
        shown = name + "_field" if name in own else name
        out.append(value.alias(shown))
        if value is not text:
            failed.append(F.when(text.isNotNull() & value.isNull(), F.lit(shown)))
    return rows.select("raw_id", *SERIES, "file_name", "line_no", "schema_version", "readable", *out,
                       (F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")).alias("failed_casts"), F.coalesce("clashes", F.array().cast("array<string>")).alias("clashes"))
