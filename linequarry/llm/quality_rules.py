"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each document gets counts over its whole text, and from them a vector of DIMENSIONS
transformed statistics, kept as integers (thousandths), so that sums are exact and no
result depends on the order of rows. For each language and source the estimate has STARTS starts: the
medians and quartiles, and the means and covariances of some ELEMENTS documents each, chosen by
a hash of their vectors, of which one at least is likely to be free of outliers. Each start takes FIRST concentration
steps: the SUBSET of documents nearest by Mahalanobis distance gives the next mean and covariance. The
start whose subset then has the least determinant goes on, until no determinant changes by
FALL of it (at most STEPS steps). Medians and the
distance that bounds a subset are read off histograms (at most some hundred bins a group),
so a group of any size is pre-aggregated before its shuffle and never meets in one task.
A document is rejected beyond the chi-square quantile CUTOFF.

All of it is DataFrame expressions: split, higher-order functions, aggregates, joins.

Defined cases: a null text has no words. Documents that fail the base rules (too few words,
or more than half of them in repeated 3-word windows) are not kept and don't enter the
estimates. A null language or source is a group of its own. With pooled, as the query has it, a
group of fewer than LEAST fitting documents is judged by the estimate of its whole language,
and where that has fewer too, by that of all documents, however few, so that every fitting document
has a distance and a verdict; without it such a group has no estimate, its distance is
null and its documents are kept. FLOORS are added to the standard deviations, so constant statistics and repeated rows give no singular
matrix. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linequarry.llm.common import SPACE, table, text_or_empty, written, written_alone

DIMENSIONS, SUBSET, STARTS, ELEMENTS, FIRST, STEPS, LEAST, CUTOFF = 4, 0.75, 4, 6, 2, 4, 20, 0.99999
MIN_WORDS, WINDOW = 50, 3
#: Least standard deviations, in thousandths: of log words, log mean length, log symbol rate, repeat rate.
FLOORS = (250, 60, 250, 60)
GROUP = ["lang", "source"]
#: What an estimate is made of. level 0: a language and source, 1: a language, 2: all; what doesn't tell is null.
POOL = ["level", *GROUP]
EACH = [*POOL, "start"]
FALL = 0.01


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each row."""
    words = F.filter(F.split(text_or_empty(), SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Arrays that lambdas look into are columns of their own: inlined, they would be built again for each element.
    df = docs.select("doc_id", *GROUP, words.alias("words"), lines.alias("lines"), F.regexp_count(text_or_empty(), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    n = F.size("words")
    df = df.select("doc_id", *GROUP, "n_symbols", "words", n.cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    at = lambda i, k: F.get(F.col("words"), i + k)
    hashes = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("hashes", hashes).drop("words")
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pairs = F.when(some, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("pairs", pairs).drop("hashes")
    near = lambda j: F.get(F.col("pairs"), j)["h"]
    twice = F.filter("pairs", lambda p, j: F.coalesce((p["h"] == near(j - 1)) & (j > 0), F.lit(False)) | F.coalesce(p["h"] == near(j + 1), F.lit(False)))
    df = df.withColumn("places", F.sort_array(F.transform(twice, lambda p: p["i"]))).drop("pairs")
    # A window covers up to WINDOW words, less those that the next repeated window begins with.
    gaps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long")
    return df.select("doc_id", *GROUP, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics, in whole thousandths."""
    n, c = F.greatest("n_words", F.lit(1)), F.col
    parts = [F.log1p(c("n_words")), F.log1p(c("word_chars") / n), F.log1p(100 * c("n_symbols") / n), c("n_repeat_words") / n]
    return [F.round(1000 * p).cast("long").alias(f"x{i}") for i, p in enumerate(parts)]


def chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def per_group(df: DataFrame, values: DataFrame, how: str = "inner", keys: list[str] = POOL) -> DataFrame:
    """Joined on the keys, nulls equal; Spark broadcasts values only where their size allows."""
    values = values.select(*[F.col(g).alias(f"__{g}") for g in keys], *[c for c in values.columns if c not in keys])
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in keys]
    return df.join(values, on, how).drop(*[f"__{g}" for g in keys])


def placed(rows: DataFrame, pooled: bool) -> DataFrame:
    """For each language and source the pool that judges it (null: none), and the pools that its fitting documents enter."""
    sizes = written(rows.groupBy(*GROUP).agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")), "sizes")
    own, few = F.col("n") >= LEAST, F.col("n") < LEAST
    pool = lambda level, *group: F.struct(F.lit(level).alias("level"), *[c.alias(g) for g, c in zip(GROUP, group, strict=True)])
    kinds = [sizes.schema[g].dataType for g in GROUP]
    no = [F.lit(None).cast(k) for k in kinds]
    groups = pool(0, F.col("lang"), F.col("source"))
    if not pooled:
        return sizes.select(*GROUP, F.when(own, groups).alias("judge"), F.when(own, F.array(groups)).otherwise(F.array().cast(f"array<struct<level:int,lang:{kinds[0].simpleString()},source:{kinds[1].simpleString()}>>")).alias("pools"))
    languages = sizes.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.bool_or(few).alias("asked"))
    wide, asked = F.col("of_lang") >= LEAST, F.col("asked")
    everyone = F.lit(bool(languages.where(asked & ~wide).head(1)))
    language, everything = pool(1, F.col("lang"), no[1]), pool(2, *no)
    pools = F.filter(F.array(F.when(own, groups), F.when(asked & wide, language), F.when(everyone, everything)), lambda p: p.isNotNull())
    return per_group(sizes, languages, keys=["lang"]).select(*GROUP, F.when(own, groups).when(wide, language).otherwise(everything).alias("judge"), pools.alias("pools"))


def quantiles(bins: DataFrame, keys: list[str], parts: dict[str, float]) -> DataFrame:
    """The least bin that holds each part of its group's rows. bins: keys, bin, n."""
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    grown = bins.withColumn("up_to", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return grown.groupBy(*keys).agg(*[F.min(F.when(F.col("up_to") >= F.ceil(F.col("all") * p), F.col("bin"))).alias(k) for k, p in parts.items()], F.max("all").alias("n"))


def start(rows: DataFrame) -> DataFrame:
    """Medians, and quartile distances as the diagonal of the factor."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") / 10).alias("bin")) for i in range(DIMENSIONS)])).alias("v")
    bins = rows.select(*POOL, parts).groupBy(*POOL, F.col("v.i").alias("i"), F.col("v.bin").alias("bin")).agg(F.count("*").alias("n"))
    q = quantiles(bins, [*POOL, "i"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    of = lambda i, c: F.max(F.when(F.col("i") == i, c))
    sd = F.sqrt(F.pow((F.col("q3") - F.col("q1")) * 10 / 1.349, 2) + F.pow(F.element_at(F.array(*map(F.lit, FLOORS)), F.col("i") + 1), 2))
    wide = q.groupBy(*POOL).agg(F.max("n").alias("n"), *[of(i, F.col("q2") * 10.0 + 5).alias(f"m{i}") for i in range(DIMENSIONS)], *[of(i, sd).alias(f"l{i}{i}") for i in range(DIMENSIONS)])
    return wide.select("*", F.lit(0).alias("start"), *[F.lit(0.0).alias(f"l{i}{j}") for i in range(DIMENSIONS) for j in range(i)])


def elements(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The other starts: estimates from some ELEMENTS documents of each pool. sizes: POOL, n."""
    xs = [F.col(f"x{i}") for i in range(DIMENSIONS)]
    all_ = 1 << 32
    near = [F.pmod(F.xxhash64(F.lit(k), *xs), F.lit(all_)) * F.col("n") < ELEMENTS * all_ for k in range(1, STARTS)]
    picked = F.filter(F.array(*[F.when(test, k + 1) for k, test in enumerate(near)]), lambda k: k.isNotNull())
    return moments(per_group(rows, sizes).select(*POOL, *xs, F.explode(picked).alias("start")), 1.0)


def with_distance(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """rows with d2, the squared distance, by forward substitution with the factor of the covariance."""
    df = per_group(rows, params.drop("n"), how)
    for i in range(DIMENSIONS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMENSIONS)), F.col("z0") * F.col("z0"))
    return df.withColumn("d2", d2).drop(*params.drop("n", *EACH).columns, *[f"z{i}" for i in range(DIMENSIONS)])


def moments(held: DataFrame, scale: float) -> DataFrame:
    """Mean and factored covariance of each pool's and start's rows."""
    x = lambda i: F.col(f"x{i}")
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
    sums = held.groupBy(*EACH).agg(F.count("*").alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in range(DIMENSIONS)], *[F.sum(x(i) * x(j)).alias(f"s{i}{j}") for i, j in pairs])
    df = sums.select(*EACH, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMENSIONS)], *[f"s{i}{j}" for i, j in pairs])
    for i, j in pairs:  # Cholesky, row by row
        v = scale * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
        v = v + float(FLOORS[i] ** 2) if i == j else v
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 / 4.0))) if i == j else v / F.col(f"l{j}{j}"))
    return df.drop(*[f"s{i}{j}" for i, j in pairs])


def concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance (factored) of the nearest SUBSET of each pool, from each start."""
    near = with_distance(rows, params).withColumn("bin", F.floor(16 * F.log2(1 + 16 * F.col("d2"))))
    bound = quantiles(near.groupBy(*EACH, "bin").agg(F.count("*").alias("n")), EACH, {"bound": SUBSET})
    held = per_group(near, bound.drop("n"), keys=EACH).where("bin <= bound")
    return moments(held, SUBSET / chi2_cdf(chi2_quantile(SUBSET, DIMENSIONS), DIMENSIONS + 2))


def log_determinant() -> Column:
    return sum((2 * F.log(f"l{i}{i}") for i in range(1, DIMENSIONS)), 2 * F.log("l00"))


def least(params: DataFrame) -> DataFrame:
    """Of each pool the start of the least determinant, the first of equals."""
    names = [c for c in params.columns if c not in POOL]
    best = params.groupBy(*POOL).agg(F.min_by(F.struct(*names), F.struct(F.round(log_determinant(), 9), "start")).alias("p"))
    return best.select(*POOL, "p.*")


def estimated(rows: DataFrame) -> DataFrame:
    """The estimate of each pool. rows: POOL and the vector."""
    first = written(start(rows), "estimate")
    params = first.unionByName(elements(rows, first.select(*POOL, "n")))
    for _ in range(FIRST):
        params = written(concentrate(rows, params), "estimate")
    params = written(least(params), "estimate")
    for _ in range(STEPS):
        fresh = written(concentrate(rows, params), "estimate")
        fall = per_group(fresh.select(*POOL, log_determinant().alias("now")), params.select(*POOL, log_determinant().alias("before"))).agg(F.max(F.abs(F.col("before") - F.col("now")))).head()[0]
        params = fresh
        if (fall or 0) < FALL:
            break
    return params.drop("start")


def quality(docs: DataFrame, cutoff: float = CUTOFF, pooled: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and distance (Mahalanobis, null without an estimate)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(counts(docs).select("*", failed.alias("base_failed"), *vector()), "counts")
    places = written_alone(lambda: placed(rows, pooled), "places")
    xs = [f"x{i}" for i in range(DIMENSIONS)]
    fitting = per_group(rows.where("NOT base_failed").select(*GROUP, *xs), places.select(*GROUP, "pools"), keys=GROUP)
    fitting = fitting.select(F.explode("pools").alias("pool"), *xs).select("pool.*", *xs)
    # The fitting vectors and the steps' estimates go once the last estimate is a table of its own.
    params = written_alone(lambda: estimated(written(fitting, "fitting")), "params")
    rows = per_group(rows, places.select(*GROUP, "judge"), keys=GROUP).drop(*GROUP).select("*", "judge.*").drop("judge")
    judged = with_distance(rows, params, "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(cutoff, DIMENSIONS), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.sqrt("d2").alias("distance"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), pooled=True)
