"""Mapping free-entered values to a canonical list (problem 6).

Method: BK-trees over the reference entries under the Levenshtein metric. The triangle inequality prunes the search,
which returns every entry within the threshold; of these the nearest by the Damerau metric wins (a swap of neighbours
is one slip of the hand). Reference entries are the canonical values, the clauses of their meaning, and a vocabulary of
general terms. An entry that is none of them as a whole is taken apart: each of its words is looked up in a tree over
the words of the vocabulary, and the value wins whose words explain most letters, if that is more than half. Words that
are shortened, without vowels, or initials of a value count too. Only distinct entries are matched; a reference too
long to broadcast is cut into shards by value, whose winners merge by the same rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reference entries that are broadcast; beyond it they are sharded.
BROADCAST_ENTRIES = 50_000
UNMATCHED = "unmatched"

#: General terms for canonical values, in lower case: the groups that the public federal standard on race
#: and ethnicity names, everyday synonyms, and abbreviations in use in clinical records.
VOCABULARY = {
    "race": {
        "White": ("white", "caucasian", "european", "american", "middle eastern", "north african"),
        "Black or African American": ("black", "blk", "african", "afro", "american", "african american"),
        "Asian": ("asian", "american", "east", "south", "southeast", "asian indian", "chinese", "filipino", "filipina", "indian", "japanese", "korean", "vietnamese"),
        "American Indian or Alaska Native": ("american indian", "native american", "alaska native", "first nations"),
        "Native Hawaiian or Pacific Islander": ("native hawaiian", "hawaiian", "pacific islander", "samoan", "guamanian", "chamorro", "tongan"),
        "Multiracial": ("mixed", "mixed race", "biracial", "multiracial", "more than one race", "two or more races"),
        "Declined": ("declined", "refused", "prefer not to answer", "prefer not to say", "did not want to answer"),
        "Unknown": ("unknown", "not known", "not asked", "not recorded", "not reported", "unspecified", "na", "n a", "?"),
    },
    "ethnicity": {
        "Hispanic or Latino": ("hispanic", "hisp", "hispana", "latino", "latina", "latinx", "chicana", "mexican", "mexican american", "cuban", "puerto rican"),
        "Not Hispanic or Latino": ("not hispanic", "non hispanic", "non hisp", "not hisp", "not latino", "non latino", "neither hispanic nor latino", "no", "latina"),
        "Declined": ("declined", "refused", "prefer not to answer", "prefer not to say", "did not want to answer"),
        "Unknown": ("unknown", "not known", "not asked", "not recorded", "not reported", "unspecified", "na", "n a", "?"),
    },
    "smoking": {
        "Never": ("never", "no", "never smoker", "never smoked", "non smoker", "nonsmoker", "lifelong", "denies", "denies smoking"),
        "Quit": ("quit", "stopped", "gave up", "former", "former smoker", "ex smoker", "past smoker", "before", "quit smoking", "stopped smoking"),
        "Yes": ("yes", "current", "still", "current smoker", "smoker", "smokes", "smoking", "pack", "packs", "ppd", "cigarette", "cigarettes", "cig", "cigs"),
        "Unknown": ("unknown", "not known", "not asked", "not recorded", "not reported", "unspecified", "na", "n a", "?"),
    },
    "status": {
        "Delivered": ("delivered", "delivery", "birth", "born", "study", "site", "here"),
        "Delivered off site": ("off site", "elsewhere", "outside", "other hospital", "delivery", "birth", "born"),
        "Active": ("active", "enrolled", "ongoing", "still pregnant", "currently"),
        "Withdrawn": ("withdrawn", "withdrew", "w d", "dropped out", "consent"),
        "Lost to follow up": ("lost", "ltfu", "lost to follow up", "cannot be reached", "no contact", "unable to contact"),
        "Pregnancy loss": ("miscarriage", "stillbirth", "demise", "fetal demise", "iufd", "sab", "loss"),
        "Screen failure": ("screen failure", "failed", "ineligible", "not eligible"),
    },
}
#: Words that say nothing about which value is meant: articles, time, number and how it was recorded.
NEUTRAL = frozenset((
    "a", "the", "of", "in", "at", "on", "per", "from", "since", "ago", "last", "this", "year", "years", "month", "months", "week", "weeks", "day", "days",
    "half", "one", "two", "has", "was", "is", "she", "patient", "pt", "and", "with", "self", "report", "reported", "chart", "record",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"))
#: Words left out of initials and of the clauses of a meaning.
SMALL = frozenset(("a", "an", "any", "or", "and", "of", "in", "to", "the"))
#: A shortened word has at most this part of the whole one.
SHORTENED = 0.6
#: What a meaning says of a value that stands for several others at once.
SEVERAL = "more than one"


def plain(text: str) -> str:
    """Lower case, words and numbers only, single blanks; question marks stay where they stand alone."""
    words = re.sub(r"[^0-9a-z?]+", " ", text.lower()).split()
    return " ".join(x for x in ("?" if set(w) == {"?"} else w.replace("?", "") for w in words) if x)


def telling(text: str) -> list[str]:
    """The words of a plain text that may tell a value: no numbers, no neutral words."""
    return [w for w in text.split() if w not in NEUTRAL and not any(c.isdigit() for c in w)]


def readings_of(text: str) -> list[str]:
    """The entry in plain form, and its telling words alone where they are fewer."""
    full = plain(text)
    short = " ".join(telling(full))
    return [x for x in dict.fromkeys((full, short)) if x]


def skeleton(word: str) -> str:
    """The first letter and the consonants after it."""
    return word[:1] + re.sub("[aeiou]", "", word[1:])


def initials(value: str) -> set[str]:
    """First letters of the words of a value, with and without small words, and of its alternatives."""
    parts = [value, *re.split(r"\bor\b", value)]
    out = set()
    for part in parts:
        words = plain(part).split()
        out |= {"".join(w[0] for w in words), "".join(w[0] for w in words if w not in SMALL)}
    return {x for x in out if len(x) > 1}


def clauses(meaning: str | None) -> list[str]:
    """The clauses of a meaning, at commas and or."""
    return [c for c in (plain(x) for x in re.split(r",|\bor\b", meaning or "")) if len(c.split()) > 1]


def levenshtein(a: str, b: str) -> int:
    """Edit distance, by bit-parallel columns."""
    if not a or not b:
        return max(len(a), len(b))
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    top, full = 1 << (len(a) - 1), (1 << len(a)) - 1
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return score


def damerau(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, edits between the two allowed: a metric."""
    big, last = len(a) + len(b), {}
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, ca in enumerate(a, 1):
        seen = 0
        for j, cb in enumerate(b, 1):
            k, l = last.get(cb, 0), seen
            same = ca == cb
            if same:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[ca] = i
    return d[-1][-1]


class BKTree:
    """Entries under a metric; ``within`` returns every entry at most a radius away."""

    def __init__(self, words: list[str]) -> None:
        self.words: list[str] = []
        self.children: list[dict[int, int]] = []
        for w in words:
            self._add(w)

    def _add(self, word: str) -> None:
        at = 0
        while self.words:
            d = levenshtein(word, self.words[at])
            if d == 0:
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.words)
                break
            at = self.children[at][d]
        self.words.append(word)
        self.children.append({})

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        out, stack = [], [0] if self.words else []
        while stack:
            at = stack.pop()
            d = levenshtein(word, self.words[at])
            if d <= radius:
                out.append((d, self.words[at]))
            stack += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return out


def slips(length: int) -> int:
    """Slips of the hand allowed in an entry of this many characters: short codes must be exact."""
    return 0 if length <= 3 else 1 if length <= 5 else 2


class Field:
    """What is known of one field's values (or of those of one shard): trees over whole entries and over words."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.entries: dict[str, set[str]] = {}
        self.words: dict[str, set[str]] = {}
        self.letters: dict[str, set[str]] = {}
        self.several: set[str] = set()
        self.terms: dict[str, list[set[str]]] = {}
        self.own: dict[str, list[str]] = {}
        for entry, kind, value in sorted(set(rows)):
            if kind == "several":
                self.several.add(value)
                continue
            self.entries.setdefault(plain(entry), set()).add(value)
            if kind == "clause":
                continue
            said = [w for w in plain(entry).split() if w not in SMALL and w not in NEUTRAL]
            self.terms.setdefault(value, []).append(set(said))
            for w in said:
                self.words.setdefault(w, set()).add(value)
            if kind == "value":
                self.own[value] = [w for w in plain(entry).split() if w not in SMALL]
                for x in initials(entry):
                    self.letters.setdefault(x, set()).add(value)
                if len(plain(entry).split()) == 1:
                    self.letters.setdefault(plain(entry)[:1], set()).add(value)
        self.firsts: dict[str, list[tuple[list[str], set[str]]]] = {}
        for e, values in self.entries.items():
            if " " in e:
                self.firsts.setdefault("".join(w[0] for w in e.split()), []).append((e.split(), values))
        self.tree, self.word_tree = BKTree(list(self.entries)), BKTree(list(self.words))
        self.starts: dict[str, set[str]] = {}
        self.skeletons: dict[str, set[str]] = {}
        for w in self.words:
            for n in range(3, int(SHORTENED * len(w)) + 1):
                self.starts.setdefault(w[:n], set()).add(w)
            self.skeletons.setdefault(skeleton(w), set()).add(w)
        self.skeleton_tree = BKTree(list(self.skeletons))
        #: A longer word is like no vocabulary word: lengths differ by more than the slips allowed.
        self.reach = max(map(len, self.words), default=0) + 2

    def like(self, word: str) -> set[str]:
        """Vocabulary words that a word of an entry may stand for: misspelt, shortened, or without vowels."""
        if len(word) > self.reach:
            return set()
        out = {w for d, w in self.word_tree.within(word, 2 * slips(len(word))) if d == 0 or damerau(word, w) <= min(slips(len(word)), slips(len(w)))}
        if len(word) >= 3:
            out |= self.starts.get(word, set())
        if len(word) >= 3 and skeleton(word) == word:
            for _, k in self.skeleton_tree.within(word, 0 if len(word) == 3 else 1):
                out |= self.skeletons[k]
        return out

    def apart(self, words: list[str]) -> list[str]:
        """The words, with one that is no vocabulary word cut in two where both parts are: a blank was left out."""
        out: list[str] = []
        for w in words:
            cuts = [] if len(w) < 6 or self.like(w) else [k for k in range(max(3, len(w) - self.reach), min(len(w) - 3, self.reach) + 1) if self.like(w[:k]) and self.like(w[k:])]
            best = min(cuts, key=lambda k: ((w[:k] not in self.words) + (w[k:] not in self.words), k), default=0)
            out += [w[:best], w[best:]] if best else [w]
        return out

    def candidates(self, text: str) -> list[tuple[int, int, int, int, str, int, int]]:
        """(stage, distance, then, last, value, which words, letters) of whole entries within reach (stage 0: by remarks
        left out, then the longest), initials and shortened phrases (1), values that explain some words (2: first those
        with a term of just these words, then those with fewest words of their own not said), and values that stand for
        several others (3)."""
        out = []
        for depth, word in enumerate(readings_of(text)):
            for d, entry in self.tree.within(word, 2 * slips(len(word))):
                true = damerau(word, entry) if d else 0
                if d == 0 or true <= min(slips(len(word)), slips(len(entry))):
                    out += [(0, true, depth, -len(entry), v, 0, 0) for v in self.entries[entry]]
        words = telling(plain(text)) or plain(text).split()
        out += [(1, 0, 0, 0, v, 0, 0) for v in self.letters.get("".join(words), ())]
        for full in map(str.split, readings_of(text)):
            if len(full) > 1 and sum(map(len, full)) >= 4:  # every word shortened, down to a letter
                out += [(1, 0, 0, 0, v, 0, 0) for e, values in self.firsts.get("".join(w[0] for w in full), ()) if all(a.startswith(b) for a, b in zip(e, full, strict=True)) for v in values]
        words = self.apart(telling(plain(text)))
        total = sum(map(len, words))
        masks: dict[str, int] = {}
        found: dict[str, set[str]] = {}
        for i, w in enumerate(words):
            for known in self.like(w):
                for v in self.words[known]:
                    masks[v] = masks.get(v, 0) | 1 << i
                    found.setdefault(v, set()).add(known)
        for v, mask in masks.items():
            open_ = total - sum(len(w) for i, w in enumerate(words) if mask >> i & 1)
            whole = any(len(t) == mask.bit_count() and t <= found[v] for t in self.terms[v])
            out.append((2, open_, -int(whole), sum(w not in found[v] for w in self.own.get(v, [])), v, mask, total))
        return out + [(3, 0, 0, 0, v, 0, total) for v in self.several]


def decide(candidates: list[tuple[int, int, int, int, str, int, int]]) -> tuple[str | None, int | None, int]:
    """(canonical value, distance, candidates within reach) of all shards' candidates.

    Whole entries go first, the nearest, then the longest, then by name. Initials and words decide only where one
    value is ahead of all others; words must explain more than half of the letters. Where two values share out the
    words, each with a term of its own, the value that stands for several is meant, if the field has one.
    """
    ranked = sorted(candidates)
    near = [c for c in ranked if c[0] == 0]
    if near:
        return near[0][4], near[0][1], len(near)
    letters = {c[4] for c in ranked if c[0] == 1}
    if len(letters) == 1:
        return letters.pop(), 0, 1
    worded = [c for c in ranked if c[0] == 2]
    if worded:
        best, total = worded[0], worded[0][6]
        several = [c for c in ranked if c[0] == 3]
        for other in worded[1:] if several and best[2] else ():
            if other[2] and not best[5] & other[5] and 2 * (best[1] + other[1] - total) < total:
                return several[0][4], best[1] + other[1] - total, len(worded)
        if 2 * best[1] < total and sum(c[:4] == best[:4] for c in worded) == 1:
            return best[4], best[1], len(worded)
    return None, None, len(worded)


CANDIDATE = "stage int, distance int, then int, last int, value string, mask string, letters int"
MATCHED = "field_name string, entry string, canonical_value string, distance int, n_within int"


def _fields(rows: list[tuple[str, str, str, str]]) -> dict[str, Field]:
    by: dict[str, list[tuple[str, str, str]]] = {}
    for field, entry, kind, value in rows:
        by.setdefault(field, []).append((entry, kind, value))
    return {f: Field(x) for f, x in by.items()}


def _matched(fields: list[str], entries: list[str], found: list[tuple[str | None, int | None, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(fields, pa.string()), pa.array(entries, pa.string()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())],
        ["field_name", "entry", "canonical_value", "distance", "n_within"])


def reference(canonical: DataFrame, vocabulary: dict[str, dict[str, tuple[str, ...]]] = VOCABULARY) -> DataFrame:
    """field_name, entry, kind, canonical_value: values, clauses of their meaning, terms of the vocabulary, and a mark
    for values whose meaning is several others."""
    spark = canonical.sparkSession
    listed = canonical.where("field_name is not null and canonical_value is not null")
    own = listed.select("field_name", F.col("canonical_value").alias("entry"), F.lit("value").alias("kind"), "canonical_value").distinct()
    if "meaning" in canonical.columns:
        split = F.udf(clauses, "array<string>")  # one call per canonical value
        own = own.unionByName(listed.select("field_name", F.explode(split("meaning")).alias("entry"), F.lit("clause").alias("kind"), "canonical_value").distinct())
        own = own.unionByName(listed.where(F.lower("meaning").contains(SEVERAL)).select("field_name", F.lit("").alias("entry"), F.lit("several").alias("kind"), "canonical_value").distinct())
    more = spark.createDataFrame([(f, a, "term", v) for f, values in vocabulary.items() for v, names in values.items() for a in names], "field_name string, entry string, kind string, canonical_value string")
    # the vocabulary is a fixed list
    return own.unionByName(F.broadcast(more).join(listed.select("field_name", "canonical_value").distinct(), ["field_name", "canonical_value"], "left_semi"))


def match_distinct(entries: DataFrame, ref: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Each distinct (field_name, entry) with its nearest reference; nulls where nothing is within the threshold."""
    rows = ref.limit(broadcast_entries + 1).collect()
    cols = ("field_name", "entry", "kind", "canonical_value")
    if len(rows) <= broadcast_entries:
        known = _fields([tuple(r[c] for c in cols) for r in rows])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fields, texts = b.column("field_name").to_pylist(), b.column("entry").to_pylist()
                yield _matched(fields, texts, [decide(known[f].candidates(t)) if f in known else (None, None, 0) for f, t in zip(fields, texts, strict=True)])

        return entries.mapInArrow(whole, MATCHED)
    # all that is known of a value lies in one shard, so that a shard's candidates are final
    shards = -(-ref.count() // broadcast_entries)
    pieces = ref.withColumn("shard", F.pmod(F.xxhash64("field_name", "canonical_value"), F.lit(shards)))
    asked = entries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(64)))
    spread = pieces.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    schema = pa.schema([("field_name", pa.string()), ("entry", pa.string()), ("stage", pa.int32()), ("distance", pa.int32()), ("then", pa.int32()), ("last", pa.int32()), ("value", pa.string()), ("mask", pa.string()), ("letters", pa.int32())])

    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        known = _fields(list(zip(*(right.column(c).to_pylist() for c in cols), strict=True))) if left.num_rows else {}
        out = [(f, t, *c[:5], f"{c[5]:x}", c[6]) for f, t in zip(left.column("field_name").to_pylist(), left.column("entry").to_pylist(), strict=True) if f in known for c in known[f].candidates(t)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    found = asked.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(shard, f"field_name string, entry string, {CANDIDATE}")
    # an entry has at most a few candidates per value near it; masks, one bit per word, travel as text
    merged = found.groupBy("field_name", "entry").agg(F.collect_list(F.struct("stage", "distance", "then", "last", "value", "mask", "letters")).alias("c"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decide([(*x[:5], int(x[5], 16), x[6]) for x in (tuple(y.values()) for y in c)]) for c in b.column("c").to_pylist()]
            yield _matched(b.column("field_name").to_pylist(), b.column("entry").to_pylist(), got)

    return merged.mapInArrow(merge, MATCHED)


def map_values(df: DataFrame, row_id: str, fields: list[str], canonical: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """One row per non-blank cell: ``row_id, field_name, entry, canonical_value, distance, n_within, exact``.

    ``exact`` marks entries spelled just like a canonical value of their field. What lies within no entry's threshold
    is ``unmatched``. Null and blank cells give no row; repeated entries are matched once and reported for every row;
    a field without canonical values is unmatched throughout.
    """
    cells = df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("entry")) for f in fields))).alias("c")).select("row_id", "c.*").where(
        F.col("entry").isNotNull() & (F.regexp_replace("entry", r"\s+", "") != ""))
    found = match_distinct(cells.select("field_name", "entry").distinct(), reference(canonical), broadcast_entries)
    spelled = F.broadcast(canonical.select("field_name", F.col("canonical_value").alias("entry"), F.lit(True).alias("exact")).distinct())
    return cells.join(found, ["field_name", "entry"], "left").join(spelled, ["field_name", "entry"], "left").select(
        "row_id", "field_name", "entry", F.when(F.col("exact"), F.col("entry")).otherwise(F.coalesce("canonical_value", F.lit(UNMATCHED))).alias("canonical_value"),
        F.when(F.col("exact"), 0).otherwise(F.col("distance")).alias("distance"), F.coalesce("n_within", F.lit(0)).alias("n_within"), F.coalesce("exact", F.lit(False)).alias("exact"))


def value_report(mapped: DataFrame) -> DataFrame:
    """Per field and canonical value: cells, distinct entries and how many were not spelled exactly."""
    return mapped.groupBy("field_name", "canonical_value").agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct("entry").alias("n_entries"), F.sum((~F.col("exact")).cast("long")).alias("n_mapped"))
