"""How filters interact: what each removes after any others, in every order.

Every filter has one table with the ids of the rows that fail it. Left-semi joins with it
find the rows that it fails at all; the rows that survive a set of filters are found by
left-anti joins, each set from the set with one filter less. As the order of earlier filters does
not matter, n filters need 2**n survivor relations, whatever the number of orders. All
tables are dealt and sorted by id once, so none of these joins moves a row, and every
relation is counted by part with map-side sums. What a filter removes after a prefix is
what the prefix leaves less what both leave, for all rows and for labelled ones; what else
it fails is redundant; unique failures and shares over all orders follow.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.cutting import scratch_path, stage, staging
from plumbline.plans.skew import lookup_join

#: Rows of the id tables in a task, as long as the session's shuffle partitions allow.
ROWS_PER_TASK = 1 << 16
#: A text with more copies is split over tasks where copies meet its first id.
CROWD = 20_000
#: Tasks that add up the counts of a relation.
COUNT_TASKS = 4
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = "#$%&*|"
COPY = "E"

_ID = ["id", "text_hash"]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")


def text_rules(text: Column, words: Column) -> dict[str, Column]:
    """When a text fails: too few words, too few distinct words, too many capitals, a symbol."""
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike("[" + SYMBOLS + "]"),
    }


def copies(judged: DataFrame) -> DataFrame:
    """The ids of rows whose text a row of smaller doc_id has as well."""
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = firsts.where("first < last").select(F.col("digest").alias("of"), "first")
    met = lookup_join(judged.select(*_ID, "doc_id", "digest"), shared, "digest", "of", limit=CROWD, spread=_ID)
    return met.where("doc_id > first").select(*_ID)


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, *_ID).sortWithinPartitions(*_ID).persist()


def relations(members: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """``part``, ``relation``, ``n``, ``good``, ``toxic`` of each relation that has rows.

    ``-AC`` holds the rows that survive the filters A and C (``-`` all rows), ``+A`` those that A fails.
    Names of filters are single characters; in a set they are in ascending order. Sets are
    visited depth first, so at most one relation per filter is held at a time.
    """
    spark = members.sparkSession
    place = scratch_path(spark, "relations")
    written: list[str] = []

    def record(name: str, rows: DataFrame) -> None:
        counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
        written.append(f"{place}/{len(written)}")
        # a handful of sums per part and task is all that is shuffled
        counts.withColumn("relation", F.lit(name)).coalesce(COUNT_TASKS).write.parquet(written[-1])

    def visit(name: str, alive: DataFrame, later: list[str]) -> None:
        record(name, alive)
        for k, f in enumerate(later):
            left = alive.join(failing[f].hint("merge"), _ID, "left_anti")
            if later[k + 1 :]:
                left = left.persist()
            visit(name + f, left, later[k + 1 :])
            left.unpersist()

    visit("-", members, sorted(failing))
    for name, ids in failing.items():
        record(f"+{name}", members.join(ids.hint("merge"), _ID, "left_semi"))
    return spark.read.parquet(*written)


def orders_report(counts: DataFrame, names: str) -> DataFrame:
    """Every part, order of the filters and step, from the counts of :func:`relations`."""
    names = "".join(sorted(names))
    entry = F.struct("relation", F.struct("n", "good", "toxic").alias("counts"))
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("found"))  # at most 2**n + n entries each
    own = F.col("own")

    def survivors(letters: Column, what: str = "n") -> Column:
        ordered = F.array_join(F.array_sort(F.split(letters, "")), "")
        return F.coalesce(F.try_element_at("found", F.concat(F.lit("-"), ordered))[what], F.lit(0))

    def removed(before: Column, what: str = "n") -> Column:
        return (survivors(before, what) - survivors(F.concat(before, own), what)).cast("bigint")

    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    steps = steps.withColumn("own", F.substring("filter_order", F.col("step"), F.lit(1)))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    fails = F.coalesce(F.try_element_at("found", F.concat(F.lit("+"), own))["n"], F.lit(0))
    return steps.select(
        "part",
        "filter_order",
        "step",
        "own",
        survivors(F.concat(before, own)).cast("bigint").alias("kept"),
        removed(before).alias("removed"),
        (fails - removed(before)).cast("bigint").alias("redundant"),
        removed(F.replace(F.lit(names), own, F.lit(""))).alias("unique_fails"),
        removed(before, "good").alias("good_lost"),
        removed(before, "toxic").alias("toxic_lost"),
    ).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    Filters A to D are :func:`text_rules`; E fails a row if a row with a smaller id has the
    same text. A null text is an empty one, so empty texts are copies of one another; a
    null id has no smaller one and is none. A null language is the part of the empty name.
    Repeated rows count each; a row is good or toxic if any row of ``labels`` with its id
    says so. An empty table gives no part and so no rows; other columns are left aside.
    """
    spark = docs.sparkSession
    rules = text_rules(F.col("body"), F.col("words"))
    with staging(spark):
        part = F.coalesce(F.col(lang).cast("string"), F.lit(""))
        read = docs.select(F.col(doc_id).alias("doc_id"), part.alias("part"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        read = read.withColumn("words", words_of(F.col("body")))
        # rows that agree in both keys fail alike: they agree in doc_id and, but for a collision of hashes within it, in text
        judged = stage(
            read.select(
                "doc_id",
                "part",
                F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
                F.xxhash64(F.col("doc_id").isNull(), "body").alias("text_hash"),
                F.unhex(F.md5("body")).alias("digest"),
                *[fails.alias(f"fails_{name}") for name, fails in rules.items()],
            ),
            "judged",
        )
        tables = {name: judged.where(f"fails_{name}").select(*_ID) for name in rules} | {COPY: copies(judged)}
        marks = labels.groupBy(F.col("doc_id").alias("of")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
        members = judged.join(marks, F.col("doc_id") == F.col("of"), "left").select(*_ID, "part", "good", "toxic")
        tasks = min(-(-judged.count() // ROWS_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))) or 1
        members = _dealt(stage(members, "members"), tasks)
        failing = {name: _dealt(stage(ids.distinct(), f"failing-{name}"), tasks) for name, ids in tables.items()}
        counts = relations(members, failing)
        for dealt in (members, *failing.values()):
            dealt.unpersist()
        return stage(orders_report(counts, "".join(sorted(failing))), "audit", outer=True)


def oracle() -> str:
    """The same over ``documents`` and ``labels`` in DuckDB."""
    names = "ABCDE"
    letters = ", ".join(f"(SELECT unnest(string_split('{' '.join(names)}', ' ')) AS l) {n.lower()}" for n in names)
    different = " AND ".join(f"{a.lower()}.l <> {b.lower()}.l" for a, b in combinations(names, 2))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
m AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
      || CASE WHEN 100 * (length(w.text) - length(translate(w.text, '{_CAPITALS}', ''))) > {MAX_CAPITALS_PERCENT} * length(w.text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(w.text, '[{SYMBOLS}]') THEN 'D' ELSE '' END
      || CASE WHEN coalesce(w.doc_id > m.first, false) THEN 'E' ELSE '' END AS fails
    FROM w JOIN m ON w.text = m.text LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM {letters} WHERE {different}),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
    FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, own,
      sum(n) FILTER (translate(fails, before || own, '') = fails) AS kept,
      sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') = fails) AS removed,
      sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') <> fails) AS redundant,
      sum(n) FILTER (fails = own) AS unique_fails,
      sum(good) FILTER (contains(fails, own) AND translate(fails, before, '') = fails) AS good_lost,
      sum(toxic) FILTER (contains(fails, own) AND translate(fails, before, '') = fails) AS toxic_lost
    FROM g, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
    (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
