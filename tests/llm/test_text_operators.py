"""Problems 6, 8, 9 and 10 against brute force and round trips."""

import itertools
import random

import numpy as np
import pytest

from cohortloom.llm import canonical, mixing, packing, splitting
from cohortloom.llm.tokens import encoder, with_tokens

# ---- problem 6


def slow_edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_metrics_and_tree_against_brute_force():
    rng = random.Random(0)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(120)]
    for a, b in itertools.product(words[:40], words[40:80]):
        assert canonical.levenshtein(a, b) == slow_edit(a, b)
        assert canonical.damerau(a, b) <= canonical.levenshtein(a, b) <= 2 * canonical.damerau(a, b)
    for a, b, c in zip(words[:40], words[40:80], words[80:], strict=True):
        assert canonical.damerau(a, c) <= canonical.damerau(a, b) + canonical.damerau(b, c)
    tree = canonical.BKTree(words)
    for w in words[:20]:
        for r in range(4):
            assert sorted(tree.within(w, r)) == sorted((slow_edit(w, x), x) for x in set(words) if slow_edit(w, x) <= r)


CANON = [("race", "White", ""), ("race", "Asian", ""), ("race", "Black or African American", ""), ("race", "Unknown", "")]


def mapped(spark, values, **how):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, race string")
    return {r["row_id"]: r for r in canonical.map_values(df, "row_id", ["race"], spark.createDataFrame(CANON, "field_name string, canonical_value string, meaning string"), **how).collect()}


@pytest.mark.parametrize("how", [{}, {"broadcast_entries": 10}])
def test_values_typed_by_hand(spark, how):
    v = ["White", "white ", "Wihte", "caucasian per chart", "- Black or Afrcan American.", "zebra", None, "  ", "asian (self)", "? per chart", "W", "x" * 5000, "White"]
    got = mapped(spark, v, **how)
    assert {k: r["canonical_value"] for k, r in got.items()} == {0: "White", 1: "White", 2: "White", 3: "White", 4: "Black or African American", 5: "unmatched", 8: "Asian", 9: "Unknown", 10: "White", 11: "unmatched", 12: "White"}
    assert {k for k, r in got.items() if r["exact"]} == {0, 12}


def test_entries_that_no_list_holds(spark):
    """Terms with numbers, time, remarks and slips around them, blanks left out, and two values at once."""
    canon = [("smoking", "Never", "has never smoked"), ("smoking", "Quit", "smoked before, not now"), ("smoking", "Yes", "smokes now"), ("race", "White", ""), ("race", "Black or African American", ""), ("race", "Multiracial", "more than one of the above named"), ("race", "American Indian or Alaska Native", "")]
    asked = {"smoking": {"quit 2010": "Quit", "1 pack day": "Yes", "gave up in may": "Quit", "ex-smoker since 2 yrs": "Quit", "latex allergy": "unmatched", "form 34/7": "unmatched", "smokes now": "Yes", "nvr": "Never"},
             "race": {"black/white": "Multiracial", "whte and blakc": "Multiracial", "amer indian": "American Indian or Alaska Native", "af am": "Black or African American", "BlackAmerican": "Black or African American", "40 weeks": "unmatched", "W": "White"}}
    ref = spark.createDataFrame(canon, "field_name string, canonical_value string, meaning string")
    for field, values in asked.items():
        df = spark.createDataFrame(list(enumerate(values)), f"row_id long, {field} string")
        for how in ({}, {"broadcast_entries": 10}):
            got = canonical.map_values(df, "row_id", [field], ref, **how).collect()
            assert {r["entry"]: r["canonical_value"] for r in got} == values, how


@pytest.mark.parametrize("how", [{}, {"broadcast_entries": 10}])
def test_every_word_of_a_long_entry_counts(spark, how):
    """What tells the value comes after eighty words that tell nothing; one of them is very long."""
    got = mapped(spark, ["zzq " * 80 + "asian " * 80, "zzq " * 80 + "asian " * 20, "q" * 20_000 + " asian"], **how)
    assert [got[i]["canonical_value"] for i in range(3)] == ["Asian", "unmatched", "unmatched"]


def test_no_values(spark):
    assert mapped(spark, []) == {} and mapped(spark, [None, ""]) == {}


# ---- problem 8


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        s, v, cap = rng.integers(2, 9, 4), rng.random(4), int(rng.integers(8, 20))
        most = rng.integers(0, 8, 4)
        conf = packing.best_configuration(s, v, most, cap)
        assert sum(int(s[j]) * a for j, a in conf.items()) <= cap and all(a <= most[j] for j, a in conf.items())
        best = max(float(np.dot(c, v)) for c in itertools.product(range(cap // 2 + 1), repeat=4) if np.dot(c, s) <= cap and (c <= most).all())
        assert sum(v[j] * a for j, a in conf.items()) == pytest.approx(best)


@pytest.mark.parametrize("n", [60, 600, 20000])
def test_program_decides_at_every_size(n):
    """Most containers are configurations of the program, also where there are only a few, and few stay open."""
    rng = np.random.default_rng(n)
    sizes, counts = np.unique(packing.size_class(np.clip(rng.lognormal(6, 1, n).astype(int), 1, 8192), 8192), return_counts=True)
    program, plan = packing.fractions(sizes, counts, 8192, packing.ROUNDS), packing.solve(sizes, counts, 8192)
    used = np.zeros(len(sizes), int)
    for conf, times in plan:
        assert times > 0 and sum(int(sizes[j]) * a for j, a in conf.items()) <= 8192
        for j, a in conf.items():
            used[j] += a * times
    assert (used == counts).all()
    bound, total = (sizes * counts).sum() / 8192, sum(t for _, t in plan)
    assert total <= 1.005 * bound + 1
    assert sum(t for conf, t in plan if tuple(sorted(conf.items())) in program) >= 0.5 * bound


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_packing_is_whole_and_tight(spark, n):
    rng = np.random.default_rng(n)
    size = np.minimum(rng.lognormal(3.5, 1.2, n).astype(int), 2500)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(size)] + [(n, None), (n + 1, 0)], "doc_id long, n long")
    p = packing.pack(df, "doc_id", "n", capacity=1000, rounds=20).toPandas()
    assert p.groupby("doc_id").n_tokens.sum().to_dict() == {i: int(x) for i, x in enumerate(size) if x > 0}
    assert p.groupby("container_id").n_tokens.sum().max() <= 1000
    assert set(p[p.was_cut].doc_id) == {i for i, x in enumerate(size) if x > 1000} and p.groupby("doc_id").size().max() <= 3
    k = p.container_id.nunique()
    assert sorted(p.container_id.unique()) == list(range(k))
    if n == 5000:
        assert k <= 1.02 * -(-int(size.sum()) // 1000)
    for _, g in p.sort_values("offset").groupby("container_id"):
        assert list(g.offset) == [0, *np.cumsum(g.n_tokens)[:-1]]


def test_packing_hot_size_and_nothing(spark):
    same = spark.range(3000).selectExpr("id as doc_id", "333 as n")
    p = packing.pack(same, "doc_id", "n", capacity=1000, rounds=10)
    assert p.select("container_id").distinct().count() == 1000 and p.count() == 3000
    assert packing.pack(same.limit(0), "doc_id", "n").count() == 0


# ---- problem 9


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")


TARGETS = "source string, target_share double, max_repeats int"


def test_mixture_reaches_targets_within_caps(spark):
    rng = random.Random(1)
    rows = [(i, rng.choices("abc", (70, 25, 5))[0], rng.choice(["en", "es"]), rng.choice("xyz"), rng.randrange(20, 300)) for i in range(4000)] + [(9000, None, "en", "x", 50), (9001, "zz", "en", "x", 50), (9002, "a", "en", "x", 0)]
    t = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 3)], TARGETS)
    mixture, report = mixing.mix(sized(spark, rows), t)
    m, r = mixture.toPandas(), report.toPandas().set_index("source")
    assert m.doc_id.is_unique and not set(m.doc_id) & {9000, 9001, 9002}
    for s, share, cap in (("a", 4 / 9, 2), ("b", 3 / 9, 2), ("c", 2 / 9, 4)):
        assert r.actual_share[s] == pytest.approx(share, abs=0.003) and m[m.source == s].copies.max() <= cap
    assert r.actual_share["none"] == 0 and r.actual_share.sum() == pytest.approx(1)


def test_raking_keeps_other_marginals():
    cells = [(s, l, t, 100 * (1 + i)) for i, (s, l, t) in enumerate(itertools.product("ab", ("en", "es"), ("x", "y")))]
    w, _, size = mixing.rake(cells, {"a": (0.5, 9), "b": (0.5, 9)}, total=1000.0)
    n = {c[:3]: c[3] for c in cells}
    got = lambda k, v: sum(w[c] * n[c] for c in w if c[k] == v) / size
    assert got(0, "a") == pytest.approx(0.5) and got(1, "en") == pytest.approx(sum(n[c] for c in n if c[1] == "en") / sum(n.values()), abs=0.01)


def test_mixture_of_nothing(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    mixture, report = mixing.mix(sized(spark, []), t)
    assert mixture.count() == 0 and [r["actual_share"] for r in report.collect()] == [0.0]


def test_topics_go_across_languages(spark):
    """Two subjects in two languages with words of their own: documents of one subject and language share a topic, and
    a subject's topics are not those of the other."""
    rng = random.Random(2)
    subject = {"a": ["placenta", "villi", "chorion", "membrane", "lesion", "weight"], "b": ["steps", "sleep", "battery", "tracker", "sync", "watch"]}
    common = {"en": ["the", "and", "was", "with"], "es": ["los", "con", "fue", "una"]}
    rows = []
    for i in range(240):
        k, lang = "ab"[i % 2], ("en", "es")[i // 2 % 2]
        rows.append((i, k, lang, " ".join(rng.choice(subject[k] + 2 * common[lang]) for _ in range(80))))
    rows += [(1000, "a", "en", None), (1001, None, None, "")]
    got = mixing.sized(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")).collect()
    of = {k: {r["topic"] for r in got if r["source"] == k and r["n_tokens"]} for k in "ab"}
    assert not of["a"] & of["b"] and {r["topic"] for r in got if not r["n_tokens"]} == {"none"}
    assert any({r["lang"] for r in got if r["topic"] == t} == {"en", "es"} for t in of["a"] | of["b"])
    assert mixing.sized(spark.createDataFrame([], "doc_id long, source string, lang string, text string")).count() == 0


# ---- problem 10

TEXTS = [
    "One sentence here. And another one! A third?\n" * 40 + "\n" + "Para two is short.\n\n" * 30,
    "no breaks at all " * 400,
    "x" * 9000,
    "äöüß" * 900,
    "😀🤰" * 400,
    "a. " * 1500 + "\r\n\r\n" + "tail",
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("limit, overlap", [(100, 16), (64, 0), (300, 40)])
def test_pieces_round_trip(text, limit, overlap):
    enc, _ = encoder()
    raw, pieces, at = text.encode(), splitting.split_text(text, limit, overlap), 0
    assert pieces
    for k, (p, n, rep, lo, kind) in enumerate(pieces):
        b = p.encode()
        assert raw[lo : lo + len(b)] == b and n <= limit and len(enc.encode_ordinary(p)) <= limit
        assert (rep == 0 and lo == 0) if k == 0 else (overlap <= rep <= overlap + 3 and lo <= at)
        assert kind == "end" if k == len(pieces) - 1 else kind in splitting.KINDS
        at = lo + len(b)
    assert at == len(raw)


def test_natural_boundaries_come_first():
    kinds = [p[4] for p in splitting.split_text(TEXTS[0], 100, 16)]
    assert kinds[-1] == "end" and set(kinds[:-1]) <= {"paragraph", "line", "sentence"}


def test_merging_is_greedy_by_weakest_boundary():
    ends, level = np.array([2, 4, 6, 8]), np.array([0, 2, 0, 3, 0, 2, 0, 4], np.int8)
    assert splitting.merge(ends, level, 4, 0) == [4, 8]
    assert splitting.merge(ends, level, 3, 0) == [2, 4, 6, 8]
    assert splitting.merge(ends, level, 8, 0) == [8]


def test_split_table(spark):
    df = spark.createDataFrame([(1, "short", 1), (2, None, 2), (3, "", 3), (4, TEXTS[1], 4), (5, TEXTS[1], 5)], "doc_id long, text string, piece_no int")
    p = splitting.split(df, "doc_id", "text", 200, 20).toPandas()
    assert set(p.doc_id) == {4, 5} and list(p[p.doc_id == 4].piece) == list(p[p.doc_id == 5].piece)
    with pytest.raises(ValueError):
        splitting.split(df, "doc_id", "text", 100, 60)


def test_token_counts(spark):
    enc, _ = encoder()
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "z" * 200000)], "id long, text string")
    assert {r["id"]: r["n_tokens"] for r in with_tokens(df, "text").collect()} == {1: 3, 2: 0, 3: 0, 4: len(enc.encode_ordinary("z" * 200000))}
