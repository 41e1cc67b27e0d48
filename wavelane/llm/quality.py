"""Quality rules: base limits and robust multivariate outliers, in DataFrame operations only.

Every text gets counts (words, word characters, symbols, repeated lines, repeated three-word windows).
A text fails the base rules outright; what passes is judged among its own kind. For each language and source
the transformed statistics of the passing texts get a minimum-covariance-determinant estimate: from a
start at median and median deviation, concentration steps keep the ``core`` share of rows nearest to the
current centre and re-estimate mean and covariance from them, until the determinant stops falling or ``MAX_STEPS`` are made;
any step's estimate is a valid one, later ones are only narrower. A text is rejected where its
Mahalanobis distance, scaled so that the median distance is that of a normal sample, exceeds ``cutoff``.

No row of a group meets the others: steps are sums per group, and quantiles come from counts
per narrow bin, both combined before any shuffle, so a group with a third of all rows costs what its
counts cost. Estimates form a table with a row per group; it is joined, not collected.

Defined results: a null text has no words; null or missing language and source count as empty ones;
groups under ``GROUP_ROWS`` rows are pooled by language and then altogether, and where even the pool is
smaller its rows pass on the base rules alone; ties at the edge of the core are all in it; spread that is
nil gets the floor of its statistic, so that equal rows are no outliers; repeated rows count as often as they come; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelane.functions.joins import BROADCAST_ROWS, lookup_join
from wavelane.llm.common import staged
from wavelane.session import cut_lineage

STATS = "_stats"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

MIN_WORDS = 50
REPEAT_PERCENT = 50
# Rows below which a group has no estimate of its own.
GROUP_ROWS = 50
# Share of rows that the estimate is made from.
CORE = 0.75
MAX_STEPS = 12
# A log determinant that falls by less has come to rest.
TOLERANCE = 1e-2
# Chi-square with five degrees of freedom: its median, and a cut-off well beyond its quantile at 1 - 1e-6.
MEDIAN_5 = 4.351
CUTOFF = 40.0

# Transformed statistics and the least spread each of them is taken to have. Most texts repeat nothing, so the floors of the
# last two are their scale: small enough that either can pass the cut-off alone (lines from 5.7 in 100 words, windows from 23
# in 100 words), large enough for phrases said twice.
FEATURES = {
    "size": ("log1p(n_words)", 0.3),
    "word_size": ("ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.1),
    "symbols": ("log1p(100 * n_symbols / greatest(word_chars, 1))", 0.3),
    "lines": ("log1p(100 * n_dup_lines / greatest(n_words, 1))", 0.3),
    "repeats": ("log1p(100 * n_repeat_words / greatest(n_words, 1))", 0.5),
}
_X = [f"_x{k}" for k in range(len(FEATURES))]
_GROUP = ["_lang", "_source"]

BLANK = r"[\x20\x09-\x0D]+"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the struct column ``_stats`` with the counts of every whole text."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(*kept, text.alias("_text"), F.array_remove(F.split(text, BLANK), "").alias("_words"))
    # A window's hash with its position in the lower bits: sorting brings equal windows together.
    step = step.select(
        *kept,
        "_text",
        "_words",
        F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.bin(F.size("_words").cast("bigint"))).alias("_low"),
    )
    step = step.withColumn(
        "_windows",
        F.expr(
            "sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> "
            "shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _low) | i))"
        ),
    )
    step = step.withColumn(
        "_repeated",
        F.expr(
            "filter(_windows, (x, k) -> shiftright(x, _low) = shiftright(get(_windows, k + 1), _low) "
            "or shiftright(x, _low) = shiftright(get(_windows, k - 1), _low))"
        ),
    )
    covered = F.expr(
        "size(array_distinct(flatten(transform(_repeated, x -> sequence(x & (shiftleft(1L, _low) - 1), "
        "(x & (shiftleft(1L, _low) - 1)) + 2)))))"
    )
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered,
    }
    # Filters on the counts stop at a generator: pushed further down they would take the text apart once per word.
    stats = F.struct(*[c.cast("bigint").alias(n) for n, c in counts.items()])
    return step.select(*kept, F.explode(F.array(stats)).alias(STATS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )


def _kinds(docs: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(g)
        for c, g in ((lang_col, "_lang"), (source_col, "_source"))
    ]


def _quantile_bin(rows: DataFrame, keys: Sequence[str], value: Column, share: float) -> DataFrame:
    """(keys, edge): the smallest bin number that ``share`` of a group's rows reach."""
    bins = rows.select(*keys, value.alias("_bin")).groupBy(*keys, "_bin").count()
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    seen = bins.withColumn("_seen", F.sum("count").over(upto)).withColumn(
        "_all", F.sum("count").over(Window.partitionBy(*keys))
    )
    return seen.filter(F.col("_seen") >= share * F.col("_all")).groupBy(*keys).agg(F.min("_bin").alias("edge"))


def _medians(rows: DataFrame, values: list[Column], width: float) -> DataFrame:
    """Median of every value per group, to a bin's width: (group, _m array)."""
    long = rows.select(*_GROUP, F.posexplode(F.array(*values)).alias("_at", "_v"))
    edges = _quantile_bin(long, [*_GROUP, "_at"], F.floor(F.col("_v") / width), 0.5)
    listed = F.sort_array(F.collect_list(F.struct("_at", "edge")))
    return edges.groupBy(*_GROUP).agg(F.transform(listed, lambda e: (e["edge"] + 0.5) * width).alias("_m"))


def _distance_bin(d: Column) -> Column:
    """Squared distances in bins of two per cent."""
    return F.floor(F.log(d + 1e-9) * 50)


def _squared_distance(params: str = "_p") -> Column:
    """Squared length of the deviation from the centre after the triangular whitening."""
    total, at = F.lit(0.0), 0
    for i in range(len(_X)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(params)["w"][at] * (F.col(_X[j]) - F.col(params)["m"][j])
            at += 1
        total = total + z * z
    return total


def _whitened(moments: DataFrame) -> DataFrame:
    """(group, _p struct of m, w, ldet) from per-group means and covariances ``m``, ``c``.

    With the covariance as L L^T the whitening is the inverse of L; both come row by row.
    """
    d = len(_X)
    cell = {(i, j): i * (i + 1) // 2 + j for i in range(d) for j in range(i + 1)}
    floors = [f for _, f in FEATURES.values()]
    out = moments
    for i in range(d):
        for j in range(i + 1):
            c = F.col("c")[cell[i, j]] + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    for j in range(d):
        for i in range(j, d):
            if i == j:
                w = 1 / F.col(f"l{i}{i}")
            else:
                w = F.lit(0.0)
                for k in range(j, i):
                    w = w - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                w = w / F.col(f"l{i}{i}")
            out = out.withColumn(f"w{i}{j}", w)
    ldet = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, d)), F.log(F.col("l00")))
    rows = F.array(*[F.col(f"w{i}{j}") for i in range(d) for j in range(i + 1)])
    return out.select(*_GROUP, F.struct("m", rows.alias("w"), ldet.alias("ldet")).alias("_p"))


def _moments(rows: DataFrame) -> DataFrame:
    d = len(_X)
    pairs = [F.covar_pop(_X[i], _X[j]) for i in range(d) for j in range(i + 1)]
    return rows.groupBy(*_GROUP).agg(
        F.array(*[F.avg(x) for x in _X]).alias("m"), F.array(*pairs).alias("c")
    )


def _start(rows: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Centre and whitening from medians and median deviations."""
    middle = _medians(rows, [F.col(x) for x in _X], 0.01)
    near = rows.join(small(middle), _GROUP)
    spread = _medians(near, [F.abs(F.col(x) - F.col("_m")[k]) for k, x in enumerate(_X)], 0.01)
    both = middle.join(spread.withColumnRenamed("_m", "_s"), _GROUP)
    d = len(_X)
    scaled = [
        F.pow(1.4826 * F.col("_s")[i], F.lit(2.0)) if i == j else F.lit(0.0) for i in range(d) for j in range(i + 1)
    ]
    return _whitened(both.select(*_GROUP, F.col("_m").alias("m"), F.array(*scaled).alias("c")))


def fit(stats: DataFrame) -> DataFrame:
    """(lang, source, group, estimate): for every kind of text the estimate that judges it.

    ``stats`` has ``_lang``, ``_source`` and the counts; every row counts, those that fail the base rules excepted.
    """
    passing = stats.filter(~base_failed())
    sizes = passing.groupBy(*_GROUP).count()
    # Too small a group joins the pool of its language, too small a pool the one of all.
    by_source = sizes.withColumn("_g", F.when(F.col("count") >= GROUP_ROWS, F.col("_source")))
    pool = F.sum(F.when(F.col("_g").isNull(), F.col("count"))).over(Window.partitionBy("_lang"))
    placed = by_source.withColumn("_pool", pool).select(
        *_GROUP,
        F.when(F.col("_g").isNotNull() | (F.col("_pool") >= GROUP_ROWS), F.concat(F.lit("="), "_lang"))
        .otherwise("*")
        .alias("_to_lang"),
        F.when(F.col("_g").isNotNull(), F.concat(F.lit("="), "_g")).otherwise("*").alias("_to_source"),
    )
    placed = cut_lineage(placed)
    values = [F.expr(f).alias(x) for (f, _), x in zip(FEATURES.values(), _X)]
    rows = lookup_join(passing.select(*_GROUP, *values), placed, _GROUP, "inner").select(
        F.col("_to_lang").alias("_lang"), F.col("_to_source").alias("_source"), *_X
    )
    rows = staged(rows, "quality-rows")
    # A row per group and step: broadcast while the groups are few, joined beyond.
    few = placed.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)

    def measured(params: DataFrame) -> DataFrame:
        return rows.join(small(params), _GROUP).withColumn("_bin", _distance_bin(_squared_distance()))

    params = cut_lineage(_start(rows, small))
    for step in range(MAX_STEPS):
        far = measured(params)
        edge = _quantile_bin(far, _GROUP, F.col("_bin"), CORE)
        core = far.join(small(edge), _GROUP).filter(F.col("_bin") <= F.col("edge"))
        better = _whitened(_moments(core)).join(small(params.withColumnRenamed("_p", "_old")), _GROUP)
        both = cut_lineage(better)
        params = both.select(*_GROUP, "_p")
        # The start is no step: its determinant is compared with none.
        if step and both.filter(F.col("_old.ldet") - F.col("_p.ldet") > TOLERANCE).isEmpty():
            break
    middle = _quantile_bin(measured(params), _GROUP, F.col("_bin"), 0.5)
    # The core is narrower than its group; where floors make it wider, distances stay as they are.
    scale = F.greatest(F.exp((F.col("edge") + 0.5) / 50) / MEDIAN_5, F.lit(1.0))
    sized = rows.groupBy(*_GROUP).count().filter(F.col("count") >= GROUP_ROWS).select(*_GROUP)
    judged = params.join(middle, _GROUP).join(sized, _GROUP).select(*_GROUP, "_p", scale.alias("_scale"))
    named = judged.select(F.col("_lang").alias("_to_lang"), F.col("_source").alias("_to_source"), "_p", "_scale")
    return cut_lineage(placed.join(named, ["_to_lang", "_to_source"], "left").select(*_GROUP, "_p", "_scale"))


def judge(stats: DataFrame, estimates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Add base_failed, distance (squared, scaled; null without an estimate) and kept."""
    values = [F.expr(f).alias(x) for (f, _), x in zip(FEATURES.values(), _X)]
    joined = lookup_join(stats.select("*", *values), estimates, _GROUP)
    distance = F.when(~base_failed(), _squared_distance() / F.col("_scale"))
    return joined.withColumn("base_failed", base_failed()).withColumn("distance", distance).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    ).drop(*_X, "_p", "_scale")


def flat_statistics(
    docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(id, _lang, _source, the counts), a row per document."""
    own = [F.col(id_col).alias("id")] if id_col else []
    narrow = docs.select(*own, F.col(text_col).alias("_t"), *_kinds(docs, lang_col, source_col))
    counted = with_statistics(narrow, "_t")
    return counted.select(*(["id"] if id_col else []), *_GROUP, *[F.col(f"{STATS}.{c}") for c in COUNTS])


def verdicts(docs: DataFrame, id_col: str = "doc_id", cutoff: float = CUTOFF, **columns: str) -> DataFrame:
    """(id, counts, base_failed, distance, kept) of every document."""
    stats = staged(flat_statistics(docs, id_col, **columns), "quality")
    return judge(stats, fit(stats), cutoff).drop(*_GROUP)


def keep_good(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF
) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Rows are written once with their counts, which the estimates and the verdicts both read; rows that share an id are judged
    one by one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = with_statistics(docs.select(whole, F.col(text_col).alias("_t"), *_kinds(docs, lang_col, source_col)), "_t")
    flat = staged(rows.select("_row", *_GROUP, *[F.col(f"{STATS}.{c}") for c in COUNTS]), "quality")
    return judge(flat, fit(flat.drop("_row")), cutoff).filter("kept").select("_row.*")
