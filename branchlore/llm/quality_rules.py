"""Quality rules with thresholds that follow each language and source.

Every text is measured where it lies.  The measures of a (language, source) group go into a
sketch of its distribution: values are kept to six significant bits and counted, so a sketch has
a bounded number of buckets, any quantile is off by less than a 32nd of its value, and sketches
merge by adding counts, whatever the order.  Groups too small to judge by themselves use the
merged sketch of their language, or of all texts.  A text fails where a measure is far outside
its group's middle half, beyond a tolerance that keeps groups of like texts from rejecting
slight differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchlore.llm.common import free_names, kept_columns, row_key, space_words, whole
from branchlore.staging import stage

SHINGLE = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
SYMBOLS = "[#*$%&|<>]"
SIGNIFICANT_BITS = 6
LEAST_TEXTS = 50  # a smaller group takes the thresholds of its language, then of all
FENCE = 3  # times the middle half's width beyond its ends
SPREAD = 32  # parts that a hot group's rows are joined in
KEY = "quality_rules_row_key"

# Measure: (numerator, denominator, scale, tolerance above, tolerance below or None for no lower end)
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, 200, None),
    "repeats": ("n_repeat_words", "n_words", 1000, 200, None),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 500, None),
    "word_chars": ("word_chars", "n_words", 1000, 4000, 2000),
}


def _let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that the text has twice or more."""
    n_windows = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))
    hashes = F.transform(
        F.slice(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), 1, n_windows),
        lambda s: F.xxhash64(s["w"], *[F.get(words, s["i"] + k) for k in range(1, SHINGLE)]),
    )

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = _let(
            ordered,
            lambda o: F.filter(
                o, lambda s, k: (F.get(o, k - 1)["h"] == s["h"]) | (F.get(o, k + 1)["h"] == s["h"])
            ),
        )
        places = F.sort_array(F.transform(repeated, lambda s: s["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-SHINGLE).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(SHINGLE), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(n_windows < 2, 0).otherwise(some).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Counts of every text: ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines``, ``n_repeat_words``."""
    rows = kept_columns(docs, "doc_id", "text", "lang", "source")
    texts = rows.select("doc_id", "lang", "source", row_key(rows, "doc_id", "text").alias(KEY), whole("text").alias("text"))
    split = texts.withColumns(
        {
            "words": space_words(F.col("text")),
            "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")),
        }
    )
    return split.select(
        "doc_id",
        "lang",
        "source",
        KEY,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measure_value(name: str) -> Column:
    """The measure as a whole number; 0 for a text without words."""
    top, bottom, scale, *_ = MEASURES[name]
    return F.when(F.col(bottom) > 0, F.floor(F.col(top) * scale / F.greatest(bottom, F.lit(1)))).otherwise(0).cast("long")


def sketch(counts: DataFrame) -> DataFrame:
    """Mergeable sketches: ``lang``, ``source``, ``measure``, ``bucket`` (its least value), ``n``.

    Texts that the base rules reject are not counted.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), measure_value(m).alias("value")) for m in MEASURES]))
    rows = counts.where(~base_failed()).select("lang", "source", values.alias("m")).select("lang", "source", "m.*")
    dropped = F.greatest(F.length(F.bin("value")) - SIGNIFICANT_BITS, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, dropped), dropped)")
    rows = rows.withColumn("dropped", dropped).select("lang", "source", "measure", bucket.alias("bucket"))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """Quarter, half and three quarter values of the sketches merged by ``keys``, and their count ``of``."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket"))
    ranked = merged.withColumns({"upto": upto, "of": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("of") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("of").alias("of"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3")
    )


def thresholds(sketches: DataFrame) -> DataFrame:
    """Per (``lang``, ``source``) the lowest and highest value each measure may have: ``low_m`` and ``high_m``."""
    levels = [("q_own", ("lang", "source")), ("q_lang", ("lang",)), ("q_all", ())]
    rows = sketches.select("lang", "source").distinct().select(
        "*", F.explode(F.array(*map(F.lit, MEASURES))).alias("measure")
    )
    for level, keys in levels:
        q = quantiles(sketches, *keys).select(
            *[F.col(k).alias(f"_{k}") for k in keys],
            F.col("measure").alias("_m"),
            F.struct("of", "q1", "q2", "q3").alias(level),
        )
        same = F.col("measure") == F.col("_m")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(q, same, "left").select(*rows.columns, level)
    use = F.when(F.col("q_own.of") >= LEAST_TEXTS, F.col("q_own")).when(F.col("q_lang.of") >= LEAST_TEXTS, F.col("q_lang"))
    use = use.otherwise(F.col("q_all"))
    rows = rows.withColumn("use", use)
    width = F.col("use.q3") - F.col("use.q1")
    bounds = []
    for name, (_, _, _, above, below) in MEASURES.items():
        high = F.greatest(F.col("use.q3") + FENCE * width, F.col("use.q2") + above)
        low = F.least(F.col("use.q1") - FENCE * width, F.col("use.q2") - below) if below else F.lit(-1).cast("long")
        mine = F.col("measure") == name
        bounds += [F.max(F.when(mine, low)).alias(f"low_{name}"), F.max(F.when(mine, high)).alias(f"high_{name}")]
    return rows.groupBy("lang", "source").agg(*bounds)


def judged(docs: DataFrame) -> DataFrame:
    """The counts with ``base_failed``, ``kept`` and the row key."""
    counts = stage(measured(docs), "quality-counts")
    bounds = thresholds(stage(sketch(counts), "quality-sketches"))
    # a group may hold most rows: its rows meet copies of its thresholds in several parts
    bounds = bounds.select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        *[c for c in bounds.columns if c not in ("lang", "source")],
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"),
    )
    rows = counts.withColumn("_part", F.pmod(F.col(KEY), F.lit(SPREAD)).cast("int"))
    same = (
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
        & (rows["_part"] == bounds["_part"])
    )
    fits = F.lit(True)
    for name in MEASURES:
        value = measure_value(name)
        fits = fits & (value <= F.col(f"high_{name}")) & (value >= F.col(f"low_{name}"))
    joined = rows.join(bounds, same, "left")
    return joined.select(*counts.columns, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(fits, F.lit(True))).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """Per document row the counts, ``base_failed`` and ``kept``.

    Missing and empty texts have counts of 0 and fail; null languages and sources are groups of
    their own; repeated rows stay, each with its result and its weight in the sketches; an empty
    table gives none; other columns are not looked at.
    """
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    A row is judged by its own text, language and source: of rows with one id and text, those of
    a group that rejects them go and the others stay.  Missing and empty texts go; equal rows have
    one verdict; a text of any length is judged whole; an empty table gives none; columns of any
    name stay as they are.
    """
    key, lang, source = free_names(docs, KEY, "quality_rules_lang", "quality_rules_source")
    bad = judged(docs).where("NOT kept").select(F.col(KEY).alias(key), F.col("lang").alias(lang), F.col("source").alias(source)).distinct()
    rows = docs.withColumn(key, row_key(docs, "doc_id", "text"))
    same = (rows[key] == bad[key]) & rows["lang"].eqNullSafe(bad[lang]) & rows["source"].eqNullSafe(bad[source])
    return rows.join(bad, same, "left_anti").select(*docs.columns)
