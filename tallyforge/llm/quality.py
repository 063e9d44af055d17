"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Each text gives the contract's counts and from them a vector of four transformed statistics, as whole thousandths, so that all
sums over documents are exact and do not depend on their order: log of words, log of the mean word length, and the
inverse hyperbolic sines of symbols and of repeated words per 100 words. Per language and source the minimum covariance
determinant is sought by concentration steps: from three starts (medians with half-widths about the median, shortest
halves, medians with interquartile ranges) means and covariances of the `share` of documents with the smallest
distances are taken again and again until the determinant falls no more, and the start with the least one counts. A last
fit takes all documents that the half-sample fit doesn't reject, so that junk of up to about 40 % of a group neither
moves the centre nor widens the spread. A document whose squared Mahalanobis distance (scaled to the median of the
documents fitted) passes `limit`, a quantile of chi-squared, is rejected; base rules reject on their own.

The statistics are written once to the shared folder; every step reads that narrow table and sums it by (group, bin of
distance), so that a group of any size is summed map-side and only a few hundred rows a group are shuffled. Groups of fewer
than `least` documents are pooled by language, pools that are still smaller with each other; only where fewer than `fewest`
documents are left in that last pool is there no fit, and nothing beyond the base rules is rejected there.

Null and empty texts have no words and fail the base rule; null lang and source form groups of their own. Equal rows
each give a row. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, stored, white_words

STATS = ("x0", "x1", "x2", "x3")
#: Smallest spread of each statistic, in thousandths: most texts have no symbols and no repeats, so that a spread measured
#: there says nothing; below these a statistic counts as constant but for noise.
FLOOR = (100, 100, 700, 700)
#: The median of chi-squared with four degrees of freedom.
CHI2_MEDIAN = 3.3567
#: Its 0.999 quantile.
CHI2_LIMIT = 18.467
#: The starts read values at so many even steps of each statistic's distribution (a multiple of 4).
GRID = 40
#: Centre and Cholesky factor of a fit.
PARAMS = [*(f"m{k}" for k in range(4)), *(f"l{k}{i}" for k in range(4) for i in range(k + 1))]


def repeated_words(words: Column, run: int = 3) -> Column:
    """How many words stand in a run of `run` words that occurs twice or more in the text.

    Hashes of the runs, with their places in the low bits, are sorted; equal neighbours give the places of repeated runs,
    and those, sorted, the number of words they cover. The places take as few bits as the text's length needs.
    """
    def covered(places: Column) -> Column:
        gap = F.transform(places, lambda p, k: F.least(F.lit(run).cast("bigint"), F.coalesce(F.get(places, k + 1) - p, F.lit(run).cast("bigint"))))
        return F.aggregate(gap, F.lit(0).cast("bigint"), lambda a, b: a + b)

    def repeats(h: Column) -> Column:
        bits = F.ceil(F.log2(F.size(h) + F.lit(1.0))).cast("int")
        return let(F.pow(F.lit(2.0), bits).cast("bigint") - 1, lambda low: let(F.bitwise_not(low), lambda high: of_sorted(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("bigint")))), low, high)))

    def of_sorted(packed: Column, low: Column, high: Column) -> Column:
        def of(s: Column) -> Column:
            later = F.filter(s, lambda x, k: x.bitwiseXOR(F.get(s, k - 1)).bitwiseAND(high) == 0)
            earlier = F.filter(s, lambda x, k: x.bitwiseXOR(F.get(s, k + 1)).bitwiseAND(high) == 0)
            return let(F.sort_array(F.transform(F.array_union(later, earlier), lambda x: x.bitwiseAND(low))), covered)

        return let(packed, of)

    none = F.lit(0).cast("bigint")
    hashes = let(words, lambda w: F.when(F.size(w) > run, F.transform(F.sequence(F.lit(0), F.size(w) - run), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(run))))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(none))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, grp_lang, grp_source and the contract's counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per = let(white_words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.char_length(F.array_join(w, "")).cast("bigint").alias("chars"), repeated_words(w).alias("rep")))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    rows = docs.select("doc_id", F.col("lang").alias("grp_lang"), F.col("source").alias("grp_source"), per.alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), dup.alias("n_dup_lines"))
    return rows.select("doc_id", "grp_lang", "grp_source", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.rep").alias("n_repeat_words"))


def statistics(rows: DataFrame) -> DataFrame:
    """rows with base_failed and the vector of transformed statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (F.log1p("n_words"), F.log1p(F.col("word_chars") / n), F.asinh(100 * F.col("n_symbols") / n), F.asinh(100 * F.col("n_repeat_words") / n))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumns({"base_failed": base, **{x: F.round(1000 * v).cast("bigint") for x, v in zip(STATS, values, strict=True)}})


def sent(groups: DataFrame, most: int = 50_000) -> DataFrame:
    """A stored table with a row per group, to be broadcast if it has at most `most` rows; else joined by key."""
    return F.broadcast(groups) if groups.count() <= most else groups


def grouped(rows: DataFrame, least: int) -> DataFrame:
    """rows with grp: g: and language and source, p: and the language where the group is pooled, r: for the last pool."""
    sizes = rows.groupBy("grp_lang", "grp_source").agg(F.count("*").alias("rows"))
    small = sizes.where(F.col("rows") < least)
    pools = small.groupBy(F.col("grp_lang").alias("pool_lang")).agg((F.sum("rows") < least).alias("rest"))
    small = small.join(pools, F.col("grp_lang").eqNullSafe(F.col("pool_lang"))).select(F.col("grp_lang").alias("l"), F.col("grp_source").alias("s"), F.lit(True).alias("pooled"), "rest")
    joined = rows.join(sent(stored(small, "small")), F.col("grp_lang").eqNullSafe(F.col("l")) & F.col("grp_source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    name = F.when(F.col("rest"), F.lit("r:")).when(F.col("pooled"), F.concat(F.lit("p:"), F.to_json(F.struct("grp_lang")))).otherwise(F.concat(F.lit("g:"), F.to_json(F.struct("grp_lang", "grp_source"))))
    return joined.withColumn("grp", name).drop("pooled", "rest", "grp_lang", "grp_source")


def starts(rows: DataFrame) -> DataFrame:
    """grp, start, n_rows and a centre and diagonal factor for each group and start, from exact quantiles."""
    long = rows.select("grp", F.posexplode(F.array(*STATS)).alias("k", "v")).groupBy("grp", "k", "v").agg(F.count("*").alias("c"))
    by = Window.partitionBy("grp", "k")
    long = long.withColumns({"below": F.sum("c").over(by.orderBy("v")), "all": F.sum("c").over(by)})
    at = [F.min(F.when(F.col("below") * GRID >= q * F.col("all"), F.col("v"))) for q in range(GRID + 1)]
    each = long.groupBy("grp", "k").agg(F.array(*at).alias("at"), F.max("all").alias("n_rows"))
    half, mid = GRID // 2, F.get("at", F.lit(GRID // 2))
    wide = lambda of: F.array_min(F.array(*(of(F.get("at", F.lit(j)), F.get("at", F.lit(j + half)), F.get("at", F.lit(j + half // 2))) for j in range(half + 1))))
    about = wide(lambda lo, hi, _: F.greatest(hi - mid, mid - lo)) * 1.4826
    shortest = wide(lambda lo, hi, centre: F.struct((hi - lo).alias("width"), centre.alias("centre")))
    quartiles = (F.get("at", F.lit(3 * GRID // 4)) - F.get("at", F.lit(GRID // 4))) / 1.349
    ways = [(mid, about), (shortest["centre"], shortest["width"] / 1.349), (mid, quartiles)]
    floor = F.element_at(F.array(*(F.lit(float(f)) for f in FLOOR)), F.col("k") + 1)
    way = F.array(*(F.struct(F.lit(i).alias("start"), m.cast("double").alias("mid"), F.greatest(w.cast("double"), floor).alias("spread")) for i, (m, w) in enumerate(ways)))
    each = each.select("grp", "k", "n_rows", F.inline(way))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return each.groupBy("grp", "start").agg(F.max("n_rows").alias("n_rows"), *(pick(k, "mid").alias(f"m{k}") for k in range(4)), *((pick(k, "spread") if i == k else F.lit(0.0)).alias(f"l{k}{i}") for k in range(4) for i in range(k + 1)))


def distance(centre: str = "m", factor: str = "l") -> Column:
    """The squared Mahalanobis distance of a row joined with its group's centre and Cholesky factor."""
    ys: list[Column] = []
    for k in range(4):
        rest = sum((F.col(f"{factor}{k}{i}") * ys[i] for i in range(k)), F.lit(0.0))
        ys.append((F.col(f"x{k}") - F.col(f"{centre}{k}") - rest) / F.col(f"{factor}{k}{k}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def binned(d: Column) -> Column:
    """Bins of distance, 32 to a doubling."""
    return F.floor(F.log2(1 + d) * 32).cast("int")


def sums() -> dict[str, Column]:
    """n_in, and the sums that a mean and a covariance need."""
    one = {"n_in": F.lit(1).cast("bigint")} | {f"s{k}": F.col(f"x{k}") for k in range(4)}
    return one | {f"q{k}{i}": F.col(f"x{k}") * F.col(f"x{i}") for k in range(4) for i in range(k + 1)}


def fitted(own: DataFrame) -> DataFrame:
    """own, which has sums(), with centre, Cholesky factor and logdet of the covariance (floors added)."""
    n = F.col("n_in").cast("double")
    own = own.withColumns({f"m{k}": F.col(f"s{k}") / n for k in range(4)})
    cov = {(k, i): F.col(f"q{k}{i}") / n - F.col(f"m{k}") * F.col(f"m{i}") + (float(FLOOR[k]) ** 2 if k == i else 0.0) for k in range(4) for i in range(k + 1)}
    for k in range(4):
        for i in range(k + 1):
            part = cov[k, i] - sum((F.col(f"l{k}{j}") * F.col(f"l{i}{j}") for j in range(i)), F.lit(0.0))
            own = own.withColumn(f"l{k}{i}", F.sqrt(F.greatest(part, F.lit(1.0))) if k == i else part / F.col(f"l{i}{i}"))
    return own.withColumn("logdet", 2 * sum((F.log(f"l{k}{k}") for k in range(1, 4)), F.log("l00"))).drop(*sums())


def concentrated(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """grp, start and the next fit: of the bins of smallest distance that hold `share` of each group."""
    bins = rows.join(sent(params).select("grp", "start", *PARAMS), "grp").withColumn("bin", binned(distance()))
    bins = bins.groupBy("grp", "start", "bin").agg(*(F.sum(v).alias(k) for k, v in sums().items()))
    by = Window.partitionBy("grp", "start")
    bins = bins.withColumns({"below": F.sum("n_in").over(by.orderBy("bin")), "all": F.sum("n_in").over(by)})
    inside = bins.where(F.col("below") - F.col("n_in") < share * F.col("all"))
    return fitted(inside.groupBy("grp", "start").agg(*(F.sum(k).alias(k) for k in sums())))


def scaled(rows: DataFrame, params: DataFrame, limit: float | None = None) -> DataFrame:
    """params with scale: the median squared distance over its normal value, at least 1.

    With limit, the median is that of rows whose distance by params' own earlier fit (p_m0.., p_l00.., p_scale) keeps within it.
    """
    joined = rows.join(sent(params), "grp")
    joined = joined if limit is None else joined.where(distance("p_m", "p_l") <= limit * F.col("p_scale"))
    bins = joined.groupBy("grp", binned(distance()).alias("bin")).agg(F.count("*").alias("c"))
    by = Window.partitionBy("grp")
    bins = bins.withColumns({"below": F.sum("c").over(by.orderBy("bin")), "all": F.sum("c").over(by)})
    half = bins.where(F.col("below") >= 0.5 * F.col("all")).groupBy("grp").agg(F.min("bin").alias("half_bin"))
    scale = F.greatest((F.pow(F.lit(2.0), (F.col("half_bin") + 1) / 32) - 1) / CHI2_MEDIAN, F.lit(1.0))
    return stored(params.join(half.select("grp", scale.alias("scale")), "grp"), "mcd")


def mcd(rows: DataFrame, share: float = 0.5, limit: float = CHI2_LIMIT) -> DataFrame:
    """grp, n_rows, centre m0..m3, Cholesky factor l00..l33 and scale of the last fit.

    Every step lowers the determinant of the groups and starts that are still moving by a thousandth at least, and the
    floors bound it from below, so the loop ends.
    """
    params = stored(starts(rows).withColumns({"logdet": F.lit(float("inf")), "moving": F.lit(True)}), "mcd")
    while not params.where("moving").isEmpty():
        new = concentrated(rows, params.where("moving").drop("moving"), share).select("grp", "start", *(F.col(c).alias(f"new_{c}") for c in (*PARAMS, "logdet")))
        falls = F.coalesce(F.col("new_logdet") < F.col("logdet") - 0.001, F.lit(False))
        own = [F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in (*PARAMS, "logdet")]
        params = stored(params.join(new, ["grp", "start"], "left").select("grp", "start", "n_rows", *own, falls.alias("moving")), "mcd")
    best = params.groupBy("grp").agg(F.min(F.struct("logdet", "start", "n_rows", *PARAMS)).alias("b")).select("grp", "b.n_rows", *(f"b.{c}" for c in PARAMS))
    half = scaled(rows, stored(best, "mcd"))
    # the last fit, by all rows that the half-sample fit doesn't reject
    inside = rows.join(sent(half), "grp").where(distance() <= limit * F.col("scale"))
    last = fitted(inside.groupBy("grp").agg(*(F.sum(v).alias(k) for k, v in sums().items()))).select("grp", *PARAMS)
    before = half.select("grp", "n_rows", *(F.col(c).alias(f"p_{c}") for c in (*PARAMS, "scale")))
    return scaled(rows, stored(before.join(last, "grp"), "mcd"), limit)


def outliers(docs: DataFrame, *, limit: float = CHI2_LIMIT, least: int = 50, fewest: int = 10, share: float = 0.5) -> DataFrame:
    """The contract's rows, with grp and distance (squared, scaled to the group) beside them."""
    rows = stored(statistics(counts(docs)), "quality")
    rows = stored(grouped(rows, least), "quality")
    params = mcd(rows, share, limit)
    joined = rows.join(sent(params).select("grp", "n_rows", "scale", *PARAMS), "grp", "left").withColumn("distance", F.when(F.col("n_rows") >= fewest, distance() / F.col("scale")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "grp", "distance")
