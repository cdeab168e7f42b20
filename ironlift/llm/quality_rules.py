"""Document statistics, plain rules on them, and robust multivariate outliers per language and source. DataFrame functions only.

The second part is the minimum covariance determinant: from a start by medians, concentration steps keep the
three quarters of a group's rows that lie nearest to the mean and covariance of the last such subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

#: Rules of the base: fewest words, and the largest share in percent of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a group's rows in the subset of least determinant, and the number of concentration steps.
SHARE, STEPS = 0.75, 3
#: A row is rejected beyond this squared distance, distances being scaled so that a group's median is that of chi-square with 4 degrees of freedom.
CUTOFF, MEDIAN_CHI2 = 45.0, 3.3567
#: The least scale: the floors below make distances small in groups that hardly vary, and those are not blown up again.
LEAST_SCALE = 0.5
#: Standard deviations added to each statistic's own: statistics that hardly vary in a group, and length, do not reject by themselves.
FLOORS = (1.0, 0.06, 0.25, 0.25)
#: A group with fewer rows is judged by the estimates of its language, a language with fewer by those of all rows.
LEAST_ROWS = 40

_SPACE = " \t\n\x0b\f\r"
_X = ("x1", "x2", "x3", "x4")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `stats`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Words are what lies between spaces, tabs and line ends. All of it stays inside a row: no text is exploded, and very
    long ones are taken whole. Null and empty texts have no words; repeated rows each have their own; an empty table
    gives an empty one; a column of docs named stats stays, and the new one gets underscores.
    """
    (stats,) = fresh(docs, "stats")
    t = "t__"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__"), F.coalesce(F.col(text), F.lit("")).alias(t))  # in one struct, docs' names clash with none of ours
    rows = rows.withColumn("trimmed__", F.trim(F.col(t), F.lit(_SPACE)))
    rows = rows.withColumn("words__", F.when(F.col("trimmed__") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed__", r"[\x20\x09-\x0D]+")))
    rows = rows.withColumn("lines__", F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != ""))
    n = F.size("words__")
    rows = rows.withColumn("windows__", F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice("words__", 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get("words__", i + 1), F.get("words__", i + 2)))))
    again = F.size(F.array_distinct("windows__")) < F.size("windows__")
    rows = rows.withColumn("placed__", F.when(again, F.sort_array(F.transform("windows__", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # in hash order, a window found more than once has an equal neighbour
    rows = rows.withColumn("found__", F.transform(F.filter("placed__", lambda x, k: (x["h"] == F.get("placed__", k + 1)["h"]).eqNullSafe(True) | (x["h"] == F.get("placed__", k - 1)["h"]).eqNullSafe(True)), lambda x: x["i"]))
    repeated = F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("found__", lambda p: F.array(p, p + 1, p + 2))))), F.lit(0))
    rows = rows.withColumn("repeated__", F.when(F.col("found__").isNull(), 0).otherwise(repeated))
    long = lambda c, name: c.cast("long").alias(name)
    failed = (n < LEAST_WORDS) | (100 * F.col("repeated__").cast("long") > MOST_REPEATED * n)
    out = F.struct(
        long(n, "n_words"), long(F.length(F.translate(t, _SPACE, "")), "word_chars"), long(F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")), "n_symbols"),
        long(F.size("lines__") - F.size(F.array_distinct("lines__")), "n_dup_lines"), long(F.col("repeated__"), "n_repeat_words"), failed.alias("base_failed"))
    return rows.select("row__.*", out.alias(stats))


def transformed(stats: str = "stats") -> list[Column]:
    """The vector of a row: log words, log mean word length, and inverse hyperbolic sines of symbols and repetition per word."""
    s, n = F.col(stats), F.greatest(F.col(stats)["n_words"], F.lit(1))
    return [F.log(n.cast("double")), F.log(F.greatest(s["word_chars"], F.lit(1)) / n), F.asinh(10 * s["n_symbols"] / n), F.asinh(5 * s["n_repeat_words"] / n)]


def _root(stats: DataFrame) -> DataFrame:
    """The lower triangular root l11..l44 of each row's covariance c11..c44, floors added."""
    out = stats
    for i in range(1, 5):
        for j in range(1, i + 1):
            rest = F.col(f"c{i}{j}") + (FLOORS[i - 1] ** 2 if i == j else 0)
            for k in range(1, j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return out


def _of_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with what their group has; a group's rows are dealt by their salts, its one row is copied for each of these."""
    copied = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("splits__") - 1)).alias("salt__"))
    return rows.join(copied.drop("splits__"), ["group__", "salt__"])


def _distance(out: DataFrame) -> DataFrame:
    """Rows with their group's m1..m4 and l11..l44 -> with the squared Mahalanobis distance d to its mean; null where the group has none."""
    for i in range(1, 5):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(1, i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return out.withColumn("d", sum((F.col(f"y{i}") ** 2 for i in range(2, 5)), F.col("y1") ** 2))


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group__").agg(F.max("splits__").alias("splits__"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(_X, 1)], *[F.covar_pop(_X[i - 1], _X[j - 1]).alias(f"c{i}{j}") for i in range(1, 5) for j in range(1, i + 1)])


def judge(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant: rows (group__, salt__, splits__, x1..x4) -> group__, m1..m4, l11..l44, scale.

    Medians come from mergeable sketches and moments from partial sums, and joins are dealt by group and salt, so a
    group with most of all rows is never in one task.
    """
    splits = F.max("splits__").alias("splits__")
    middle = rows.groupBy("group__").agg(splits, *[F.percentile_approx(x, 0.5, 10_000).alias(f"p{i}") for i, x in enumerate(_X, 1)])
    middle = saved(middle, "medians")
    off = _of_group(rows, middle)
    spread = off.groupBy("group__").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"p{i}")), 0.5, 10_000).alias(f"s{i}") for i, x in enumerate(_X, 1)])
    start = middle.join(spread, "group__")
    root = saved(start.select("group__", "splits__", *[F.col(f"p{i}").alias(f"m{i}") for i in range(1, 5)], *[(F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + FLOORS[i - 1] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(1, 5) for j in range(1, i + 1)]), "mcd")
    for _ in range(STEPS):
        far = _distance(_of_group(rows, root)).where("d is not null").select("group__", "salt__", "splits__", *_X, "d")
        edge = saved(far.groupBy("group__").agg(F.percentile_approx("d", SHARE, 10_000).alias("edge__"), splits), "mcd-edge")
        root = saved(_root(_moments(_of_group(far, edge).where("d <= edge__"))).select(root.columns), "mcd")
    scale = _distance(_of_group(rows, root)).where("d is not null").groupBy("group__").agg(F.greatest(F.percentile_approx("d", 0.5, 10_000) / MEDIAN_CHI2, F.lit(LEAST_SCALE)).alias("scale"))
    return saved(root.drop("splits__").join(scale, "group__"), "mcd-scale")


def _judges(passing: DataFrame) -> DataFrame:
    """passing (lang__, group__, x1..x4) -> group__, judge__ (whose estimates judge the group: its own, its language's or those of all rows), seen__ (all estimates that its rows enter).

    Each of these says into how many salts its rows are dealt, in proportion to them: one, and as many more in all as there are shuffle partitions.
    """
    groups = passing.groupBy("lang__", "group__").agg(F.count("*").alias("n__"))
    langs = groups.groupBy("lang__").agg(F.sum("n__").alias("of_lang__"), F.min("n__").alias("least__"))
    known = groups.join(langs, "lang__")
    least_lang, of_all_rows = langs.agg(F.coalesce(F.min("of_lang__"), F.lit(0)), F.coalesce(F.sum("of_lang__"), F.lit(1))).first()  # two numbers
    partitions = int(passing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda name, rows: F.struct(name.alias("group"), F.ceil(rows * (partitions / of_all_rows)).cast("int").alias("splits"))
    own, of_lang, of_all = F.concat(F.lit("group"), "group__"), F.concat(F.lit("lang"), "lang__"), F.lit("all")
    fits, lang_fits = F.col("n__") >= LEAST_ROWS, F.col("of_lang__") >= LEAST_ROWS
    judge_ = F.when(fits, own).when(lang_fits, of_lang).otherwise(of_all)
    # coarser estimates are made only where some group is judged by them, and from all rows that they cover; those of all rows have no least number
    lang_needed = lang_fits & (F.col("least__") < LEAST_ROWS)
    all_needed = F.lit(least_lang < LEAST_ROWS)
    seen = F.array_compact(F.array(F.when(fits, dealt(own, F.col("n__"))), F.when(lang_needed, dealt(of_lang, F.col("of_lang__"))), F.when(all_needed, dealt(of_all, F.lit(of_all_rows)))))
    return saved(known.select("group__", judge_.alias("judge__"), seen.alias("seen__")), "judges")


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs, text left out, with `stats` and `kept`: false if the base failed or the row is an outlier of its language and source.

    Groups with fewer than LEAST_ROWS passing rows are judged by the estimates of their language, and languages with
    fewer by those of all rows, however few. The estimates see every row that passes the base. Null languages and sources are groups of their own; null
    and empty texts have no words and fail the base; repeated rows count as often as they occur; equal distances are
    judged alike; an empty table gives an empty one; columns of docs stay, whatever their names.
    """
    stats, kept = fresh(docs, "stats", "kept")
    language = F.coalesce(F.col(lang), F.lit("\0"))
    group = F.concat(language, F.lit("\x1f"), F.coalesce(F.col(source), F.lit("\0")))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row__")
    rows = saved(statistics(docs, text).select(rest, F.col(stats).alias("stats"), language.alias("lang__"), group.alias("group__"), *[x.alias(n) for n, x in zip(_X, transformed(stats))]), "statistics")
    passing = rows.where(~F.col("stats")["base_failed"]).select("lang__", "group__", *_X)
    judges = _judges(passing)
    seen = passing.join(judges, "group__").select(F.explode("seen__").alias("seen__"), *_X).select(F.col("seen__.group").alias("group__"), F.col("seen__.splits").alias("splits__"), *_X)
    seen = saved(seen.withColumn("salt__", F.pmod(F.monotonically_increasing_id(), F.col("splits__")).cast("int")), "seen")
    rows = rows.join(judges.select("group__", "judge__"), "group__", "left").drop("group__").withColumnRenamed("judge__", "group__")
    out = _distance(rows.join(judge(seen), "group__", "left"))
    verdict = ~F.col("stats")["base_failed"] & F.coalesce(F.col("d") <= CUTOFF * F.col("scale"), F.lit(True))
    return out.select("row__.*", F.col("stats").alias(stats), verdict.alias(kept))
