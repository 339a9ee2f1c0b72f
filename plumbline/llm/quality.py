"""Quality rules whose thresholds follow the data, per language and source.

Per document a handful of counts are taken inside the row. Ratios of them, in whole
thousandths, go into quantile sketches: histograms whose bins keep six significant bits
of the value (relative error 1/32, at most about 2,000 bins whatever the input). Two
sketches merge by adding counts, so they combine on the map side, a hot source costs a
few hundred rows, and the result does not depend on the order of merging. Fences are
taken from the quartiles of the (language, source) sketch; a group with too few
documents uses its language's merged sketch, and if that is small as well, that of all.
The fences are joined back and documents beyond them fall out.

Only DataFrame functions are used. The counts are staged once, narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.cutting import stage

#: White space that separates words, and symbols that are counted.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A group with fewer documents than this borrows the thresholds of its language, then of all.
MIN_GROUP = 200
#: A fence lies so many interquartile ranges beyond the quartile.
REACH = 3
#: Ratios in thousandths: numerator, denominator, least interquartile range, whether too little counts too.
RATIOS = {
    "word_length": ("word_chars", "n_words", 1000, True),
    "symbols": ("n_symbols", "n_words", 200, False),
    "dup_lines": ("n_dup_lines", "n_lines", 100, False),
    "repeats": ("n_repeat_words", "n_words", 60, False),
}
_SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Word, symbol, line and repetition counts of every row; a null text has none of anything."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
        F.array_remove(F.split(body, _SPACE_CLASS + "+"), "").alias("words"),
        F.length(F.translate(body, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"),
    )
    size = F.size("words")
    counted = words.select(
        "doc_id",
        "lang",
        "source",
        size.cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            size >= 3,
            F.transform(
                F.slice("words", 1, F.greatest(size - 2, F.lit(0))),
                lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
            ),
        ).alias("windows"),
    )
    # most texts repeat no window; only the others are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    found = counted.withColumn("ordered", ordered)

    def equal(x: Column, k: Column) -> Column:
        return F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))

    twice = F.filter("ordered", lambda x, k: equal(x, k + 1) | (equal(x, F.greatest(k - 1, F.lit(0))) & (k > 0)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return found.withColumn(
        "n_repeat_words", F.when(F.col("ordered").isNull(), 0).otherwise(F.size(covered)).cast("bigint")
    ).drop("windows", "ordered")


def with_base_verdict(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def thousandths(ratio: str) -> Column:
    """The ratio in whole thousandths, exactly; 0 if there is nothing to divide by."""
    top, bottom, _, _ = RATIOS[ratio]
    return F.coalesce(F.expr(f"(1000 * {top}) div nullif({bottom}, 0)"), F.lit(0)).cast("bigint")


def sketch_bin(value: Column) -> Column:
    """The value with all but its six leading binary digits set to zero."""
    extra = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, extra), extra)


def sketches(counts: DataFrame) -> DataFrame:
    """Bin counts by ``level`` (2: language and source, 1: language, 0: all), group, ratio."""
    values = F.array(*[F.struct(F.lit(r).alias("ratio"), sketch_bin(thousandths(r)).alias("bin")) for r in RATIOS])
    bins = (
        counts.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(values).alias("v"))
        .groupBy("lang", "source", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    none = F.lit(None).cast("string")
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
    levels = F.array(level(2, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(0, none, none))
    merged = bins.select(F.explode(levels).alias("g"), "v", "n").groupBy("g", "v").agg(F.sum("n").alias("n"))
    return merged.select("g.level", "g.lang", "g.source", "v.ratio", "v.bin", "n")


def fences(bins: DataFrame) -> DataFrame:
    """``level``, ``lang``, ``source``, ``docs`` and a (low, high) fence per ratio, in thousandths."""
    group = ["level", "lang", "source", "ratio"]
    up_to = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("upto", F.sum("n").over(up_to)).withColumn("docs", F.sum("n").over(Window.partitionBy(*group)))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bin")))
    quartiles = ranked.groupBy(*group).agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("docs").alias("docs"))
    out = []
    for ratio, (_, _, least, both) in RATIOS.items():
        wide = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        own = F.col("ratio") == ratio
        low = F.col("q1") - wide if both else F.lit(0).cast("bigint")
        out += [F.max(F.when(own, low)).alias(f"{ratio}_low"), F.max(F.when(own, F.col("q3") + wide)).alias(f"{ratio}_high")]
    return quartiles.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *out)


def group_fences(bins: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The fences that hold for each language and source: its own, its language's, or those of all."""
    made = stage(fences(bins), "fences")
    names = [f"{r}_{side}" for r in RATIOS for side in ("low", "high")]
    own = made.where("level = 2")
    by_lang = made.where("level = 1").select(F.col("lang").alias("l_lang"), F.col("docs").alias("l_docs"), *[F.col(n).alias(f"l_{n}") for n in names])
    of_all = made.where("level = 0").select(F.lit(2).alias("a_level"), *[F.col(n).alias(f"a_{n}") for n in names])
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang"))).join(of_all, F.col("level") == F.col("a_level"))
    pick = lambda n: F.when(F.col("docs") >= min_group, F.col(n)).when(F.col("l_docs") >= min_group, F.col(f"l_{n}")).otherwise(F.col(f"a_{n}"))
    return joined.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[pick(n).alias(n) for n in names])


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP
) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every row.

    A row is kept if it passes the base rules and each ratio lies within the fences of
    its group. Rows of null language or source are a group like any other. A null or
    empty text fails the base. Repeated rows are judged (and counted in the sketches)
    each; an empty table gives an empty result; other columns are left aside.
    """
    counts = stage(with_base_verdict(base_counts(docs, doc_id, text, lang, source)), "quality")
    limits = group_fences(sketches(counts), min_group)
    within = F.lit(True)
    for ratio in RATIOS:
        within = within & thousandths(ratio).between(F.col(f"{ratio}_low"), F.col(f"{ratio}_high"))
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return counts.join(limits, same, "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"),
    )


def oracle(min_group: int = MIN_GROUP) -> str:
    """The same over ``documents`` in DuckDB."""
    space, symbols = "[\\x20\\x09-\\x0D]", "[#*$%&|<>]"
    value = lambda r: f"CASE WHEN {RATIOS[r][1]} = 0 THEN 0 ELSE (1000 * {RATIOS[r][0]}) // {RATIOS[r][1]} END"
    parts = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {value(r)} AS v FROM b WHERE NOT base_failed" for r in RATIOS)
    sides = []
    for r, (_, _, least, both) in RATIOS.items():
        wide = f"{REACH} * greatest(q3 - q1, {least})"
        sides.append(f"max(CASE WHEN ratio = '{r}' THEN {f'q1 - {wide}' if both else '0'} END) AS {r}_low")
        sides.append(f"max(CASE WHEN ratio = '{r}' THEN q3 + {wide} END) AS {r}_high")
    names = [f"{r}_{side}" for r in RATIOS for side in ("low", "high")]
    picked = ", ".join(
        f"CASE WHEN o.docs >= {min_group} THEN o.{n} WHEN l.docs >= {min_group} THEN l.{n} ELSE a.{n} END AS {n}" for n in names
    )
    inside = " AND ".join(f"{value(r)} BETWEEN {r}_low AND {r}_high" for r in RATIOS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM p),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS k FROM t WHERE c > 1) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '{space}+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '{symbols}', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
v AS ({parts}),
s AS (SELECT lang, source, ratio, ((v >> greatest(length(bin(v)) - 6, 0)::INT) << greatest(length(bin(v)) - 6, 0)::INT)::BIGINT AS bin FROM v),
g AS (SELECT 2 AS level, * FROM s UNION ALL SELECT 1, lang, NULL, ratio, bin FROM s UNION ALL SELECT 0, NULL, NULL, ratio, bin FROM s),
q AS (SELECT level, lang, source, ratio, count(*) AS docs,
        list_sort(list(bin))[((count(*) + 3) // 4)::INT] AS q1, list_sort(list(bin))[((3 * count(*) + 3) // 4)::INT] AS q3
        FROM g GROUP BY level, lang, source, ratio),
f AS (SELECT level, lang, source, max(docs) AS docs, {", ".join(sides)} FROM q GROUP BY level, lang, source),
e AS (SELECT o.lang, o.source, {picked} FROM f o JOIN f l ON l.level = 1 AND o.lang IS NOT DISTINCT FROM l.lang
        JOIN f a ON a.level = 0 WHERE o.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({inside}, false) AS kept
FROM b LEFT JOIN e ON b.lang IS NOT DISTINCT FROM e.lang AND b.source IS NOT DISTINCT FROM e.source"""
