"""Mixing sources to target weights (problem 9).

Method: iterative proportional fitting. Token weights of the cells source x language x topic are raked to the source
shares asked for and to the corpus' own language and topic shares, none above the source's cap on repeats; the source
step comes last and is exact. Documents are then drawn by calibrated probabilities: each is taken the whole part of
its cell's weight, and once more if its hash falls under the fraction times a factor, which is set per source so that
the drawn tokens meet the target within one document.

Topics are found, not listed: spherical k-means over all documents. A document is the vector of its hashed tokens, less
the mean of its language, so that topics go across languages. Means, spreads and the sums of every round are added up
by Spark; only they reach the driver, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.tokens import RANKS, encoder
from cohortloom.session import cut

ROUNDS = 60
#: Documents per bucket of the draw, by expectation.
BUCKET_DOCUMENTS = 20_000
#: Topics, numbers a document's tokens are hashed to, the most rounds of fitting, and the gain in mean likeness below
#: which they end.
TOPICS, DIMENSIONS, TOPIC_ROUNDS, TOPIC_GAIN = 8, 128, 12, 2e-3
#: Language codes in use for one language, by their two-letter code.
LANGUAGES = {"en": ("en", "eng", "english"), "es": ("es", "spa", "spanish"), "fr": ("fr", "fra", "fre", "french"), "de": ("de", "ger", "deu", "german"), "pt": ("pt", "por", "portuguese")}


def term_vector(ids: list[int]) -> np.ndarray:
    """Logarithm of the counts of a document's tokens, each hashed to a place and a sign, in unit length."""
    if not ids:
        return np.zeros(DIMENSIONS, np.float32)
    kinds, n = np.unique(np.asarray(ids, np.uint64), return_counts=True)
    with np.errstate(over="ignore"):
        h = (kinds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    sign = np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    v = np.bincount((h % np.uint64(DIMENSIONS)).astype(int), sign * np.log1p(n), DIMENSIONS)
    return (v / max(float(np.sqrt((v * v).sum())), 1e-9)).astype(np.float32)


def source_name(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")
    return F.when(s != "", s)


def language(c: Column) -> Column:
    l = F.lower(F.trim(c))
    out = F.lit("und")
    for code, names in LANGUAGES.items():
        out = F.when(l.isin(*names), code).otherwise(out)
    return F.when(l.isNull(), "und").otherwise(out)


def _measured(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and term vector of every document; one pass over the texts."""
    x = docs.select("doc_id", source_name(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(path)
        for b in batches:
            ids = [enc.encode_ordinary(t) for t in b.column("text").to_pylist()]
            vectors = [term_vector(i).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([len(i) for i in ids], pa.int64()), pa.array(vectors, pa.binary())],
                                             ["doc_id", "source", "lang", "n_tokens", "terms"])

    return x.mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, n_tokens long, terms binary")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("terms").to_pylist()), np.float32).reshape(b.num_rows, DIMENSIONS).astype(float)


def _added_up(df: DataFrame, statistics) -> np.ndarray:
    """The sum over all rows of an array that statistics makes of a batch; every task sends one array."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = statistics(b)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "v"])

    rows = df.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


class Topics:
    """Mean of each language, and a direction per topic; fitted on all documents with a text."""

    def __init__(self, measured: DataFrame) -> None:
        languages = {l: k for k, l in enumerate((*LANGUAGES, "und"))}
        need, d = measured.where("n_tokens > 0").select("lang", "terms"), DIMENSIONS

        def sums(b: pa.RecordBatch) -> np.ndarray:
            x, at = _matrix(b), np.array([languages[l] for l in b.column("lang").to_pylist()])
            per = np.zeros((len(languages), d + 1))
            np.add.at(per, at, np.column_stack([x, np.ones(len(x))]))
            return per.ravel()

        got = _added_up(need, sums)
        per = got.reshape(len(languages), d + 1) if len(got) else np.zeros((len(languages), d + 1))
        self.languages, self.mean, self.centre = languages, per[:, :d] / np.maximum(per[:, d:], 1), np.zeros((0, d))
        if not per[:, d].sum():
            return
        # the first directions are those of the largest spread, either way
        spread = _added_up(need, lambda b: (lambda y: (y.T @ y).ravel())(self.rest(b))).reshape(d, d)
        axes = np.linalg.eigh(spread)[1][:, ::-1][:, : TOPICS // 2].T
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        self.centre, before = np.vstack([axes, -axes]), -1.0
        for _ in range(TOPIC_ROUNDS):
            centre = self.centre

            def moved(b: pa.RecordBatch, centre: np.ndarray = centre) -> np.ndarray:
                y = self.rest(b)
                like = y @ centre.T
                at = like.argmax(axis=1)
                per = np.zeros((len(centre), d))
                np.add.at(per, at, y)
                return np.concatenate([per.ravel(), [like.max(axis=1).sum(), len(y)]])

            s = _added_up(need, moved)
            per = s[:-2].reshape(len(centre), d)
            size = np.sqrt((per * per).sum(axis=1, keepdims=True))
            self.centre = np.where(size > 1e-9, per / np.maximum(size, 1e-9), centre)
            likeness = s[-2] / s[-1]
            if likeness - before < TOPIC_GAIN:
                break
            before = likeness

    def rest(self, b: pa.RecordBatch) -> np.ndarray:
        """Vectors less the mean of their language, in unit length."""
        y = _matrix(b) - self.mean[[self.languages[l] for l in b.column("lang").to_pylist()]]
        return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-9)

    def of(self, b: pa.RecordBatch) -> list[str]:
        """The topic of each document; ``none`` without tokens."""
        if not len(self.centre):
            return ["none"] * b.num_rows
        at = (self.rest(b) @ self.centre.T).argmax(axis=1)
        return [f"topic {k}" if n else "none" for k, n in zip(at, b.column("n_tokens").to_pylist(), strict=True)]


def sized(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every document. Null and empty texts have no tokens and no topic."""
    measured = cut(_measured(docs, path))  # read by every round of the topics' fit
    topics = Topics(measured)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(topics.of(b), pa.string()), b.column("n_tokens")], ["doc_id", "source", "lang", "topic", "n_tokens"])

    return measured.mapInArrow(name, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, topic string, n_tokens long")


def rake(cells: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict[tuple[str, str, str], float], dict[str, float], float]:
    """Copies per cell, the share each source can have, and the mixture's size in tokens.

    A source without tokens cannot have its share; the others then keep their proportions. Without a total the
    largest one is taken at which every other source reaches its share within its cap.
    """
    mass: dict[str, float] = {}
    for s, _, _, n in cells:
        mass[s] = mass.get(s, 0) + n
    live = {s: w for s, (w, cap) in targets.items() if mass.get(s, 0) > 0 and w > 0 and cap > 0}
    if not live:
        return {}, {}, 0.0
    share = {s: w / sum(live.values()) for s, w in live.items()}
    size = min(targets[s][1] * mass[s] / share[s] for s in live) if total is None else float(total)
    kept = [c for c in cells if c[0] in live and c[3] > 0]
    n = np.array([c[3] for c in kept], float)
    cap = np.array([targets[c[0]][1] for c in kept], float)
    whole = sum(c[3] for c in cells)

    def marginal(k: int) -> list[tuple[np.ndarray, float]]:
        values = sorted({c[k] for c in kept})
        return [(np.array([c[k] == v for c in kept]), size * sum(c[3] for c in cells if c[k] == v) / whole) for v in values]

    def scaled(w: np.ndarray, at: np.ndarray, goal: float) -> None:
        """Scale to the goal; cells at their cap stay there and the others take their part."""
        for _ in range(20):
            now = float((w * n)[at].sum())
            if now <= 0 or abs(now - goal) <= 1e-9 * max(goal, 1):
                return
            free = at & (w < cap - 1e-12) if goal > now else at
            movable = float((w * n)[free].sum())
            if movable <= 0:
                return
            w[free] = np.minimum(w[free] * max(0.0, (movable + goal - now) / movable), cap[free])

    w = np.minimum(1.0, cap)
    sources = [(np.array([c[0] == s for c in kept]), min(size * share[s], targets[s][1] * mass[s])) for s in live]
    others = marginal(1), marginal(2)
    for _ in range(ROUNDS):
        for group in (*others, sources):
            for at, goal in group:
                scaled(w, at, goal)
    return {c[:3]: float(x) for c, x in zip(kept, w, strict=True)}, share, size


def _draw(docs: DataFrame, goal: DataFrame, most: float, buckets: int) -> DataFrame:
    """One more copy of documents in order of their turn and key, as long as the source's tokens stay within its goal.

    Only documents of at most ``most`` times the lacking tokens are looked at. Sums run over buckets of the key first.
    """
    lacking = docs.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("have")).join(F.broadcast(goal), "source").select("source", (F.col("goal") - F.col("have")).alias("lack"))
    x = docs.join(F.broadcast(lacking), "source", "left").withColumn("_b", F.when(~F.col("drawn") & F.col("key").isNotNull() & (F.col("n_tokens") <= most * F.col("lack")), F.col("turn") * buckets + F.floor(F.col("key") / (F.col("key") + 1) * buckets)))
    before = x.where("_b is not null").groupBy("source", "_b").agg(F.sum("n_tokens").alias("t")).select("source", "_b", (F.sum("t").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("before"))
    more = x.where("_b is not null").join(before, ["source", "_b"]).where(F.col("before") < F.col("lack")).withColumn(
        "cum", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "_b").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("cum") <= F.col("lack")).select("doc_id", F.lit(1).alias("more"))
    return cut(docs.join(more, "doc_id", "left").select("doc_id", "source", "lang", "topic", "n_tokens", "turn", "key", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"), (F.col("drawn") | F.col("more").isNotNull()).alias("drawn")))


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). The mixture has one row per document taken, with its number of copies.

    sizes: as ``sized`` gives them. targets: ``source, target_share, max_repeats``, a short list. Documents without a
    source or with one not listed, and empty ones, are not taken; the report has a row for every listed source, also
    for those without documents.
    """
    spark = sizes.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").groupBy(
        source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}
    names = spark.createDataFrame([(s, *v) for s, v in wanted.items()], "source string, target_share double, max_repeats int")
    kept = cut(sizes.join(F.broadcast(names), "source").where("n_tokens > 0").select("doc_id", "source", "lang", "topic", "n_tokens"))
    # sources x languages x topics, all three bounded
    cells = [(r["source"], r["lang"], r["topic"], r["n"]) for r in kept.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")).orderBy("source", "lang", "topic").collect()]
    weight, share, size = rake(cells, wanted, total)
    rows = [(*k, int(np.floor(w + 1e-9)), float(max(0.0, w - np.floor(w + 1e-9)))) for k, w in weight.items()]
    cell = spark.createDataFrame(rows, "source string, lang string, topic string, base int, part double")
    x = kept.join(F.broadcast(cell), ["source", "lang", "topic"])
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(2**40)) + 0.5) / float(2**40)
    # by hash over fraction; documents that their cell's weight does not call for come after all others
    x = x.join(F.broadcast(names.select("source", "max_repeats")), "source").withColumns({
        "turn": F.when(F.col("part") > 1e-9, 0).otherwise(1), "key": F.when(F.col("part") > 1e-9, u / F.col("part")).when(F.col("base") < F.col("max_repeats"), u)})
    goal = spark.createDataFrame([(s, float(min(size * share[s], wanted[s][1] * sum(c[3] for c in cells if c[0] == s)))) for s in share], "source string, goal double")
    taken = cut(x.select("doc_id", "source", "lang", "topic", "n_tokens", "turn", "key", F.col("base").alias("copies"), F.lit(False).alias("drawn")))
    buckets = max(64, kept.count() // BUCKET_DOCUMENTS)
    for most in (1.0, 0.25, 0.25, 0.25):  # later passes fill what the last, too large document left open
        taken = _draw(taken, goal, most, buckets)
    taken = taken.where("copies > 0")
    mixture = taken.select("doc_id", "source", "lang", "topic", "n_tokens", "copies")
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("copies").cast("long").alias("n_uses"), F.max("copies").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"))
    reach = spark.createDataFrame([(s, float(v)) for s, v in share.items()], "source string, reachable_share double")
    report = names.join(reach, "source", "left").join(got, "source", "left")
    all_tokens = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per listed source
    report = report.select(
        "source", "target_share", "max_repeats", F.coalesce("reachable_share", F.lit(0.0)).alias("reachable_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_uses", "most_uses", "n_tokens")),
        F.coalesce(F.col("n_tokens") / all_tokens, F.lit(0.0)).alias("actual_share"))
    return mixture, report
