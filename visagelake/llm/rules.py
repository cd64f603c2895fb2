"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Counts of whole texts become a vector: logarithms and square roots of rates, drawn towards the rate of all rows by
PRIOR words so that short texts do not stand out by chance. For every language and source the minimum-covariance-
determinant estimate is sought in two steps. Concentration from many starts on a sample of each group (START_ROWS
expected rows) gives the subset with the least determinant; from there, concentration over all rows goes on until the
determinant stays. A step over all rows is two aggregations, whatever the size of a group; group members never meet
in one task. The covariance gets only the variance that counting alone gives the rates of rare events, so a statistic
that is zero in most rows has a finite scale; no scale is set by hand. A row is rejected beyond the 0.9999 point of the
F distribution that distances from such an estimate have for the group's size (Hardin and Rocke, 2005).
Groups too small for an estimate of their own are judged by that of a pool: their language, else their source, else all
rows.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visagelake.operators import tables
from visagelake.llm._arrow import slices

SYMBOLS = "#*$%&|<>"
TOGETHER = 2_000_000  # bytes of text handled together
SPACES = " \t\n\v\f\r"
WINDOW = 5
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")
#: The vector, and which of its parts are rates of rare events (square roots of a count over words).
VECTOR = ("length", "word_length", "symbols", "lines", "repeats", "capitals")
RARE = (0.0, 0.0, 1.0, 1.0, 1.0, 0.0)
#: Words by which every text's rates are drawn towards those of all rows; words that a repeated window brings at least.
PRIOR, REPEAT_UNIT = 50.0, 10.0
#: Standard normal point of the rejected tail, 0.0001.
TAIL = 3.719
#: Groups up to which estimates are broadcast (44 numbers each); more are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: Rows of a group that are expected in the sample for the starts, and the number of starts.
START_ROWS, STARTS = 400, 12
#: Distances are compared in steps of this share of their size; the rows of the last step count in part.
STEP = 0.001
#: A determinant stays if its logarithm changes by less.
SAME = 1e-3


def repeated_words(words: list[bytes]) -> int:
    """Words inside of five-word windows that occur twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64) + np.uint64(1)
    size = len(ids) - WINDOW + 1
    key = sum(ids[k : k + size] * MIX[k] for k in range(WINDOW))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(size, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:size] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """Counts of a whole text, as in STATISTICS."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    doubled = 0
    for line in raw.split(b"\n"):
        if line in seen:
            doubled += bool(line.strip())
        else:
            seen.add(line)
    b = np.frombuffer(raw, dtype=np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        doubled,
        repeated_words(words),
        int(((b >= 65) & (b <= 90)).sum()),
    )


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, statistics) of all rows; a null text has no words."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 3, TOGETHER)):
            rows = [statistics(t or "") for t in batch.column(3).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "lang", "source", *STATISTICS])

    text = lambda c: F.col(c).cast("string")
    source = docs.select("doc_id", text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    made = source.mapInArrow(batches, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{s} bigint" for s in STATISTICS))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return made.withColumns({"base_failed": failed, "group": F.to_json(F.struct("lang", "source"))})


def with_vector(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Rows with their vector, and the variances that counting gives its parts; both rest on totals over all rows."""
    total = rows.where(~F.col("base_failed")).agg(
        F.sum("n_words").alias("words"), F.sum("word_chars").alias("chars"), F.sum("n_capitals").alias("capitals"), F.avg(1 / (4 * (F.col("n_words") + PRIOR))).alias("spread")
    ).first()  # one row
    chars = (total.chars or 0) / max(total.words or 0, 1)
    capitals = (total.capitals or 0) / max(total.chars or 0, 1)
    words, letters = F.col("n_words") + PRIOR, F.col("word_chars") + PRIOR * chars
    vector = {
        "length": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.log(F.greatest(letters / words, F.lit(1e-9))),
        "symbols": F.sqrt(F.col("n_symbols") / words),
        "lines": F.sqrt(F.col("n_dup_lines") / words),
        "repeats": F.sqrt(F.col("n_repeat_words") / REPEAT_UNIT / words),
        "capitals": F.sqrt((F.col("n_capitals") + PRIOR * chars * capitals) / F.greatest(letters, F.lit(1e-9))),
    }
    return rows.withColumns(vector), np.array(RARE) * (total.spread or 0.0)


def chi_squared(x: float, half: int) -> float:
    """Lower tail of chi-squared with 2 * half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def quantile(share: float, half: int) -> float:
    """Point below which a share of chi-squared with 2 * half degrees of freedom lies, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_squared(mid, half) < share else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest share of normal rows that of all."""
    half = len(VECTOR) // 2
    return share / chi_squared(quantile(share, half), half + 1) if share < 1 else 1.0


def cutoff(n: float, share: float) -> float:
    """0.9999 point of squared distances from the estimate of n rows: that of F with Hardin and Rocke's degrees of freedom."""
    p, half, a = len(VECTOR), len(VECTOR) // 2, 1 - share
    q, c = quantile(share, half), consistency(share)
    c2, c3 = -chi_squared(q, half + 1) / 2, -chi_squared(q, half + 2) / 2
    b1 = c * (c3 - 3 * c3) / share
    b2 = 0.5 + c / share * (c3 - q / p * (c2 + share / 2))
    v1 = share * b1 * b1 * (a * (c * q / p - 1) ** 2 - 1) - 2 * c3 * c * c * (3 * (b1 - p * b2) ** 2 + (p + 2) * b2 * (2 * b1 - p * b2))
    v2 = n * (b1 * (b1 - p * b2) * share) ** 2 * c * c
    m = 2 / (c * c * v1 / v2) * math.exp(0.725 - 0.00663 * p - 0.078 * math.log(n))
    m = max(m, p + 4.0)
    x, y, z = 2 / (9 * p), 2 / (9 * (m - p + 1)), TAIL  # Paulson's normal form of F, solved for its cube root
    u, w = (1 - y) ** 2 - z * z * y, (1 - x) * (1 - y)
    root = (w + math.sqrt(w * w - u * ((1 - x) ** 2 - z * z * x))) / u if u > 0 else 4.0
    return root**3 * p * m / (m - p + 1)


def scatter(mean: np.ndarray, second: np.ndarray, share: float, least: np.ndarray) -> np.ndarray:
    """Covariance of a subset from its mean and mean products, made consistent, with the variances of counting."""
    return consistency(share) * (second - np.outer(mean, mean)) + np.diag(least)


def distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def concentrate(x: np.ndarray, share: float, least: np.ndarray, starts: int = STARTS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the subset with the least determinant that concentration reaches from several starts: the
    medians with the mean deviations, and small random subsets drawn with a fixed seed."""
    n, p = x.shape
    h = max(share * n, min(n, p + 1))
    w = np.minimum(1.0, h - np.arange(math.ceil(h)))
    draw, best = np.random.default_rng(11), None
    for start in range(starts):
        if start:
            some = x[draw.choice(n, min(n, p + 4), replace=False)]
            d = distances(x, some.mean(axis=0), np.cov(some.T, bias=True) + np.diag(least + 1e-9)) if len(some) > 1 else np.zeros(n)
        else:
            middle = np.median(x, axis=0)
            d = ((x - middle) ** 2 / (np.square(np.abs(x - middle).mean(axis=0)) + least + 1e-9)).sum(axis=1)
        last = math.inf
        for _ in range(60):
            near = x[np.argsort(d, kind="stable")[: len(w)]]
            mean = w @ near / h
            cov = scatter(mean, (near.T * w) @ near / h, share, least)
            size = np.linalg.slogdet(cov)[1]
            if not size < last - 1e-12:
                break
            last, kept = size, (mean, cov)
            d = distances(x, mean, cov)
        if best is None or last < best[0]:
            best = (last, kept)
    return best[1]


def estimate_row(group: str, n: float, mean: np.ndarray, cov: np.ndarray, share: float) -> dict:
    return {"group": group, "n": float(n), "centre": mean.tolist(), "inverse": np.linalg.inv(cov).ravel().tolist(), "size": float(np.linalg.slogdet(cov)[1]), "cutoff": cutoff(max(n, 8.0), share)}


ESTIMATE = "group string, n double, centre array<double>, inverse array<double>, size double, cutoff double"


def distance(centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of the vector columns."""
    p = len(VECTOR)
    d = [F.col(c) - centre[i] for i, c in enumerate(VECTOR)]
    return sum(d[i] * sum(inverse[i * p + j] * d[j] for j in range(p)) for i in range(p))


def first_estimates(rows: DataFrame, share: float, least: np.ndarray) -> DataFrame:
    """Estimates of ESTIMATE from a sample of every group, START_ROWS rows expected; the whole of smaller groups."""

    def start(part: pd.DataFrame) -> pd.DataFrame:
        x = part[list(VECTOR)].to_numpy(dtype=np.float64)
        order = np.lexsort(x.T[::-1])
        mean, cov = concentrate(x[order], share, least)
        return pd.DataFrame([estimate_row(part["group"].iloc[0], part["rows"].iloc[0], mean, cov, share)])

    sizes = tables.small(tables.save(rows.groupBy("group").agg(F.count("*").alias("rows")), "sizes"), BROADCAST_GROUPS)
    place = F.pmod(F.xxhash64(*VECTOR), F.lit(1 << 30)) / (1 << 30)  # vectors are distinct
    drawn = rows.join(sizes, "group").where(place * F.col("rows") < START_ROWS)
    return drawn.select("group", "rows", *VECTOR).groupBy("group").applyInPandas(start, ESTIMATE)


def stepped(rows: DataFrame, now: DataFrame, share: float, least: np.ndarray) -> DataFrame:
    """The estimates after a concentration step over all rows of the groups in now."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(VECTOR)
        for batch in found:
            out = []
            for group, n, weight, sums, products in zip(batch["group"], batch["m"], batch["weight"], batch["sums"], batch["products"], strict=True):
                mean, second = np.asarray(sums) / weight, np.zeros((p, p))
                second[np.triu_indices(p)] = np.asarray(products) / weight
                second += np.triu(second, 1).T
                out.append(estimate_row(group, n, mean, scatter(mean, second, share, least), share))
            yield pd.DataFrame(out, columns=["group", "n", "centre", "inverse", "size", "cutoff"])

    step = F.ceil(F.log1p(F.greatest(distance(F.col("centre"), F.col("inverse")), F.lit(0.0))) / STEP)
    near = rows.join(tables.small(now.select("group", "centre", "inverse"), BROADCAST_GROUPS), "group").withColumn("step", step)
    counts = near.groupBy("group", "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("group")
    ranked = counts.withColumns({"k": F.sum("n").over(w.orderBy("step")), "m": F.sum("n").over(w)})
    limits = ranked.where(F.col("k") >= share * F.col("m")).groupBy("group").agg(F.min(F.struct("step", "n", "k", "m")).alias("last"))
    part = 1 - (F.col("last.k") - share * F.col("last.m")) / F.col("last.n")  # of the rows of the last step
    limits = limits.select("group", F.col("last.step").alias("most"), part.alias("part"), F.col("last.m").alias("m"))
    limits = tables.small(tables.save(limits, "limits"), BROADCAST_GROUPS)
    weighed = near.join(limits, "group").where(F.col("step") <= F.col("most")).withColumn("w", F.when(F.col("step") < F.col("most"), 1.0).otherwise(F.col("part")))
    names = list(VECTOR)
    sums = weighed.groupBy("group").agg(
        F.first("m").alias("m"),
        F.sum("w").alias("weight"),
        F.array(*(F.sum(F.col("w") * F.col(c)) for c in names)).alias("sums"),
        F.array(*(F.sum(F.col("w") * F.col(names[i]) * F.col(names[j])) for i in range(len(names)) for j in range(i, len(names)))).alias("products"),
    )
    return sums.mapInPandas(batches, ESTIMATE)


def estimate(rows: DataFrame, share: float, steps: int, least: np.ndarray) -> DataFrame:
    """(group, centre, inverse, cutoff) for every group of rows: steps until no determinant gets smaller, so many at most."""
    done = []
    now = tables.save(first_estimates(rows, share, least), "starts")
    for _ in range(steps):
        after = stepped(rows, now, share, least).join(tables.small(now.select("group", F.col("size").alias("before")), BROADCAST_GROUPS), "group")
        after = tables.save(after.withColumn("open", F.col("size") < F.col("before") - SAME), "scatter")
        done.append(after.where(~F.col("open")).select(*now.columns))
        now = after.where("open").select(*now.columns)
        if now.isEmpty():
            break
    out = now
    for some in done:
        out = out.unionByName(some)
    return out.select("group", "centre", "inverse", "cutoff")


def pools(rows: DataFrame, least_rows: int) -> DataFrame:
    """(group, judge, members) for every group: the key of the estimate that judges it, and the keys of those it feeds.

    A group with least_rows good rows judges itself. Others are judged by their language, else by their source, if that
    has so many good rows, else by all rows, however few. Keys of pools begin with their kind, those of groups with "{".
    """
    n = F.count_if(~F.col("base_failed")).alias("n")
    sizes = tables.save(rows.groupBy("group", "lang", "source").agg(n), "sizes")
    sizes = sizes.withColumns({c: F.concat(F.lit(f"{c} "), F.to_json(F.struct(c))) for c in ("lang", "source")})
    for c in ("lang", "source"):
        sizes = sizes.join(sizes.groupBy(c).agg(F.sum("n").alias(f"{c}_n")), c)
    enough = lambda c: F.col(c) >= least_rows
    judge = F.when(enough("n"), F.col("group")).when(enough("lang_n"), F.col("lang")).when(enough("source_n"), F.col("source")).otherwise(F.lit("all"))
    chosen = tables.save(sizes.select("group", "lang", "source", judge.alias("judge")), "judges")
    needed = chosen.select("judge").distinct()
    fed = chosen.select("group", F.explode(F.array("group", "lang", "source", F.lit("all"))).alias("judge")).join(needed, "judge", "left_semi")
    members = fed.groupBy("group").agg(F.collect_list("judge").alias("members"))  # four keys at most
    return tables.save(chosen.select("group", "judge").join(members, "group", "left"), "pools")


def judge(docs: DataFrame, share: float = 0.75, steps: int = 20, least_rows: int = 40) -> DataFrame:
    """Base statistics and verdict of all rows.

    Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance,
    pooled_distance), one row per input row; other columns are not carried. A null or empty text has no words and fails
    the base rules. Null languages and sources form groups of their own. Estimates come from rows that pass the base
    rules, equal vectors of a group counting once, so that masses of copies do not shrink the scatter; distance is null in
    groups with fewer than least_rows such rows, and pooled_distance, by the estimate of pools(), decides there. Both are
    null only if no row passes the base rules. Repeated rows are judged alike.
    """
    rows, spread = with_vector(tables.save(counted(docs), "statistics"))
    groups = tables.small(pools(rows, least_rows), BROADCAST_GROUPS)
    passed = rows.where(~F.col("base_failed")).join(groups.select("group", "members"), "group").select(F.explode("members").alias("group"), *VECTOR)
    passed = tables.save(passed.distinct(), "vectors")
    scales = passed.agg(*(F.coalesce(F.var_pop(c), F.lit(0.0)).alias(c) for c in VECTOR)).first()  # one row
    least = spread + 1e-6 * np.array(list(scales)) + 1e-12
    models = tables.small(estimate(passed, share, steps, least).withColumnRenamed("group", "judge"), BROADCAST_GROUPS)
    judged = rows.join(groups.select("group", "judge"), "group").join(models, "judge", "left").withColumn("found", distance(F.col("centre"), F.col("inverse")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("found") <= F.col("cutoff"), F.lit(True))
    own = F.col("judge") == F.col("group")
    return judged.select("doc_id", *STATISTICS[:5], "base_failed", kept.alias("kept"), F.when(own, F.col("found")).alias("distance"), F.when(~own, F.col("found")).alias("pooled_distance"))
