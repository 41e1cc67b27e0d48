"""Line dedup over content-defined chunks of lines, in DataFrame operations only.

Lines that hold a word are hashed, and a rolling hash over ``WINDOW`` neighbours decides after which of them a chunk ends; of
neighbouring boundaries the first one counts, so chunks inside a text have two lines at least, and an inserted or deleted
line moves the boundaries beside it and no others. A chunk of several lines met before, in the order of (id, line), is removed.

Chunks catch the bulk of what repeats, but not the edges of a passage nor one that is shorter than a chunk. So pairs of neighbouring
lines are units as well, where they are not inside a chunk that goes anyway: the first place of a pair never is.
Together they remove exactly the lines of every pair that stands earlier in the corpus, that is every repeat of two or more
lines in full. Lines without words between two removed ones of a unit go with them and decide nothing.

Hashes are counted first, without texts. Only units whose hash repeats are fetched, compared byte by
byte through grouping by text, and listed per document; a text passes through a shuffle twice.
Counts are combined before shuffles, and a unit that a third of all documents share is one row on the other side of
its join, which AQE can split.

Defined results: a null text counts as an empty one and stays null; an empty text is one line without words; rows with
a null id neither count nor change; rows that share an id are told apart by position and hash, so
equal ones have the same fate; a single line that repeats between different neighbours stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import staged

WINDOW = 2
# About one line in so many ends a chunk.
CHUNK_LINES = 4
FACTOR = 1_000_003

UNIT = ("at", "size", "hash")


def _with_lines(df: DataFrame, text: Column) -> DataFrame:
    """Add _lines, and _worded with (at, line) of every line that holds a word."""
    out = df.withColumn("_lines", F.split(text, "\n"))
    numbered = F.transform("_lines", lambda s, i: F.struct(i.alias("at"), s.alias("line")))
    return out.withColumn("_worded", F.filter(numbered, lambda c: c["line"].rlike(r"[^\x20\x09-\x0D]")))


def _units(df: DataFrame) -> DataFrame:
    """Add _chunks with (at, size, hash) and _pairs with (at, size, hash, chunk): places among the lines with words.

    ``chunk`` is the place of the chunk a pair is inside of, if it is inside of one.
    """
    out = df.withColumn("_hash", F.transform("_worded", lambda c: F.xxhash64(c["line"])))
    rolled = "coalesce(get(_hash, i - 1), 0L)"
    for k in range(WINDOW - 2, -1, -1):
        rolled = f"(({rolled}) & 4294967295L) * {FACTOR}L + (coalesce(get(_hash, i - {k}), 0L) & 4294967295L)"
    out = out.withColumn("_ends", F.expr(f"transform(_hash, (h, i) -> pmod({rolled}, {CHUNK_LINES}L) = 0)"))
    # Places after which a chunk begins.
    begins = "filter(sequence(1, size(_hash) - 1), i -> get(_ends, i - 1) and not coalesce(get(_ends, i - 2), false))"
    some = "size(_hash) > 1"
    out = out.withColumn("_begins", F.expr(f"if({some}, array_prepend({begins}, 0), array())"))
    size = "coalesce(get(_begins, k + 1), size(_hash)) - s"
    chunks = f"transform(_begins, (s, k) -> struct(s as at, {size} as size, xxhash64(slice(_hash, s + 1, {size})) as hash))"
    out = out.withColumn("_chunks", F.expr(f"filter({chunks}, c -> c.size > 1)"))
    pair = "xxhash64(slice(_hash, i + 1, 2)) as hash"
    inside = f"transform(sequence(c.at, c.at + c.size - 2), i -> struct(i as at, 2 as size, {pair}, c.at as chunk))"
    across = f"transform(filter(_begins, b -> b > 0), b -> b - 1), i -> struct(i as at, 2 as size, {pair}, cast(null as int) as chunk)"
    pairs = f"concat(flatten(transform(_chunks, c -> {inside})), transform({across}))"
    return out.withColumn("_pairs", F.expr(pairs)).drop("_ends", "_begins", "_hash")


def _unit_text(unit: Column) -> Column:
    return F.array_join(F.slice("_worded", unit["at"] + 1, unit["size"])["line"], "\n")


def _unit_hash(unit: Column) -> Column:
    lines = F.slice("_worded", unit["at"] + 1, unit["size"])
    return F.xxhash64(F.transform(lines, lambda c: F.xxhash64(c["line"])))


def _repeated(places: DataFrame) -> DataFrame:
    """Places whose hash stands elsewhere too, and whether they are ``later`` than the first of them."""
    first = places.groupBy("hash").agg(F.min(F.struct("id", "at")).alias("first"), F.count("id").alias("n"))
    return places.join(first.filter(F.col("n") > 1).drop("n"), "hash").select(
        "id", *UNIT, (F.struct("id", "at") > F.col("first")).alias("later")
    )


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cuts): per document the (at, size, hash) of every unit that stands earlier in the corpus too.

    ``at`` counts the lines that hold a word.
    """
    texts = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    scanned = _units(_with_lines(texts, F.col("text")))
    units = F.concat(
        F.transform("_chunks", lambda c: F.struct(*[c[n].alias(n) for n in UNIT], F.lit(None).cast("int").alias("chunk"), F.lit(True).alias("whole"))),
        F.transform("_pairs", lambda c: F.struct(*[c[n].alias(n) for n in (*UNIT, "chunk")], F.lit(False).alias("whole"))),
    )
    places = staged(scanned.select("id", F.inline(units)), "line-units")
    chunks = staged(_repeated(places.filter("whole").select("id", *UNIT)), "line-chunks")
    # A pair inside a chunk that goes is not needed: its first place is elsewhere.
    going = chunks.filter("later").select("id", F.col("at").alias("chunk")).distinct()
    pairs = places.filter(~F.col("whole")).join(going, ["id", "chunk"], "left_anti").select("id", *UNIT)
    listed = chunks.drop("later").unionByName(_repeated(pairs).drop("later"))
    wanted = listed.groupBy("id").agg(F.collect_set(F.struct(*UNIT)).alias("_wanted"))
    # Bytes decide: the texts behind repeated hashes are grouped as they are.
    fetched = _with_lines(texts.join(wanted, "id"), F.col("text"))
    with_text = F.transform(
        F.filter("_wanted", lambda c: _unit_hash(c) == c["hash"]),
        lambda c: F.struct(*[c[n].alias(n) for n in UNIT], _unit_text(c).alias("unit")),
    )
    found = staged(fetched.select("id", F.inline(with_text)), "line-candidates")
    firsts = found.groupBy("hash", "unit").agg(F.min(F.struct("id", "at")).alias("first"), F.count("id").alias("n"))
    firsts = firsts.filter(F.col("n") > 1).drop("n")
    later = found.join(firsts, ["hash", "unit"]).filter(F.struct("id", "at") > F.col("first"))
    return later.groupBy("id").agg(F.collect_set(F.struct(*UNIT)).alias("cuts"))


def _cut(docs: DataFrame, cuts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``docs`` with _lines, _gone: the removed line numbers, and _kept: the remaining text."""
    cuts = cuts.select(F.col("id").alias("_id"), F.col("cuts").alias("_listed"))
    joined = docs.join(cuts, F.col(f"`{id_col}`") == F.col("_id"), "left")
    out = _with_lines(joined, F.coalesce(text, F.lit("")))
    listed = F.coalesce("_listed", F.expr("cast(array() as array<struct<at: int, size: int, hash: bigint>>)"))
    out = out.withColumn("_cuts", F.filter(listed, lambda c: _unit_hash(c) == c["hash"]))
    # From the first to the last line with words of a unit.
    span = "sequence(get(_worded, c.at).at, get(_worded, c.at + c.size - 1).at)"
    out = out.withColumn("_gone", F.array_sort(F.array_distinct(F.expr(f"flatten(transform(_cuts, c -> {span}))"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    return out.withColumn("_kept", F.when(F.size("_cuts") > 0, kept).otherwise(text)).drop("_id", "_listed", "_worded")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, n_spans, text): lines, removed lines and stretches of them, and the remaining text."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = _cut(narrow, repeated_units(docs, id_col, text_col), "id", F.col("text"))
    spans = F.expr("size(filter(_gone, (x, k) -> k = 0 or x > get(_gone, k - 1) + 1))")
    return cut.select(
        "id",
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size("_gone").cast("bigint").alias("n_removed"),
        spans.cast("bigint").alias("n_spans"),
        F.col("_kept").alias("text"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines cut out of the texts; all rows and columns stay."""
    whole = docs.select(
        F.col(id_col).alias("_key"),
        F.col(text_col).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"),
    )
    cut = _cut(whole, repeated_units(docs, id_col, text_col), "_key", F.col("_text"))
    return cut.select(
        *[(F.col("_kept") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns]
    )


# What chunks and pairs remove together, by the rule alone: lines of pairs that stand earlier.
REPORT_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
    FROM documents
), worded AS (
    SELECT doc_id, i, line, lead(line) OVER w AS after, lead(i) OVER w AS next_i
    FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
    SELECT doc_id, i, next_i FROM worded WHERE next_i IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, next_i)) AS i FROM later
), marked AS (
    SELECT l.*, g.i IS NOT NULL AS gone FROM lines l LEFT JOIN gone g USING (doc_id, i)
), edges AS (
    SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM marked
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM edges GROUP BY doc_id
"""
