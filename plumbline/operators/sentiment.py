"""Lexicon sentiment of texts.

Texts become an index of their lexicon hits: id, position, word and valence, staged once.
A hit carries its neighbourhood (three words back, two ahead) only where a word that can
change a sentiment is in reach, so no ordering is needed afterwards. The rules look at
those hits alone; all others count as they are. Hits are summed per text before the only
shuffle. No text is ever gathered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import valence as v
from plumbline.functions.scoring import stronger_side
from plumbline.plans.cutting import cut, stage
from plumbline.plans.skew import GROUP_LIMIT, heavy_among, if_any, lookup_join

MAX_BROADCAST_LEXICON = 1_000_000

_STEADY = 9  # sums are rounded here, so that the order of rows does not show


def lexicon_sentiment(
    texts: DataFrame,
    id_col: str,
    text_col: str,
    lexicon: DataFrame,
    max_broadcast: int = MAX_BROADCAST_LEXICON,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """[id_col, neg, neu, pos, compound, pos_or_neg] for every text.

    ``lexicon`` is [token, valence] with lower-case tokens; of a token listed more than
    once the lowest valence counts. Up to
    ``max_broadcast`` of them are broadcast. Of a larger lexicon that is what is known of
    the most frequent words, and only the others are shuffled, heavy ones salted. A null
    text counts as empty.
    """
    valence = F.min(F.col("valence").cast("double")).alias("_valence")
    lexicon = stage(lexicon.groupBy(F.col("token").alias("_token")).agg(valence), "tokens")
    if lexicon.count() <= max_broadcast:
        frequent, heavy, whole = lexicon, None, True
    else:
        frequent, heavy = _frequent(texts, text_col, lexicon, max_broadcast, group_limit)
        whole = False

    def known(rows: DataFrame, word: str, found: str) -> DataFrame:
        """``found`` as the broadcast table has it, and ``_rare`` where that does not list the word."""
        table = frequent.select("_token", F.col("_valence").alias(found), F.lit(True).alias("_listed"))
        met = rows.join(F.broadcast(table), F.col(word) == F.col("_token"), "left")
        rare = F.lit(False) if whole else F.col(word).isNotNull() & F.col("_listed").isNull()
        return met.withColumn("_rare", rare).drop("_token", "_listed")

    def sought(rows: DataFrame, word: str, found: str) -> DataFrame:
        """The same with ``found`` looked up for rare words as well."""
        if whole:
            return rows.drop("_rare")
        common = rows.where(~F.col("_rare")).drop("_rare")
        rare = rows.where("_rare").drop("_rare", found)
        table = lexicon.withColumnRenamed("_valence", found)
        return common.unionByName(lookup_join(rare, table, word, "_token", "left", spread=[id_col, "_at"], heavy=heavy))

    words = _words_in_context(texts, id_col, text_col)
    modifier = v.is_modifier(F.col("_word"), F.col("_after_1"))
    # every text keeps its header row (no word), so texts without a hit survive
    hit = F.col("_word").isNull() | (F.col("_base").isNotNull() & ~modifier)
    kept = F.when(F.col("_in_reach") | F.col("_rare"), F.col("_word"))
    hits = known(words, "_word", "_base").where(F.col("_rare") | hit)
    if whole:
        hits = stage(hits.withColumn("_word", kept).drop("_rare"), "hits")
        plain, changed = hits.where(~F.col("_in_reach")), hits.where("_in_reach")
    else:
        hits = stage(hits.withColumns({"_word": kept, "_header": F.col("_word").isNull()}), "hits")
        hit = F.col("_header") | (F.col("_base").isNotNull() & F.coalesce(~modifier, F.lit(True)))
        hits = sought(hits, "_word", "_base").where(hit).drop("_header")
        plain = hits.where(~F.col("_in_reach"))
        changed = stage(hits.where("_in_reach"), "reached")
    for k in (1, 2, 3):
        changed = known(changed, f"_before_{k}", f"_known_{k}")
        changed = sought(changed if whole else stage(changed, "known"), f"_before_{k}", f"_known_{k}")
    columns = [id_col, "_size", "_emphasis", "_value"]
    weighed = _weighed(plain.withColumn("_value", _shouted_base())).select(*columns)
    return _per_text(weighed.unionByName(_weighed(_with_rules(changed)).select(*columns)), id_col)


def _frequent(
    texts: DataFrame, text_col: str, lexicon: DataFrame, most: int, group_limit: int
) -> tuple[DataFrame, DataFrame | None]:
    """[_token, _valence] of up to ``most`` words of the texts that occur most often, and the heavy ones of the others.

    A word without a valence is listed with null. Words are counted once, and those from the
    lowest power of two on that not more than ``most`` words reach are taken.
    """
    tokens = texts.select(F.explode(F.transform(v.words(F.coalesce(text_col, F.lit(""))), F.lower)).alias("_token"))
    counts = stage(tokens.groupBy("_token").agg(F.count(F.lit(1)).alias("_rows")), "counts")
    power = F.floor(F.log2("_rows")).cast("int")
    sizes = {row[0]: row[1] for row in counts.groupBy(power).count().collect()}  # 63 rows at most
    least, taken = max(sizes, default=0) + 1, 0
    while least and taken + sizes.get(least - 1, 0) <= most:
        least -= 1
        taken += sizes.get(least, 0)
    frequent = counts.where(power >= least).drop("_rows").join(lexicon, "_token", "left")
    # a word precedes others at most as often as it occurs, so one count serves all lookups
    heavy = if_any(cut(heavy_among(counts.where(power < least), "_token", "_rows", group_limit))) if 1 << least > group_limit else None
    return stage(frequent, "frequent"), heavy


def _words_in_context(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw, lower, signal = F.col("_tokens"), F.col("_lower"), F.col("_signals")
    near = [f"_raw_before_{k}" for k in (1, 2, 3)] + [f"_before_{k}" for k in (1, 2, 3)] + [f"_after_{k}" for k in (1, 2)]

    def word(token, at):
        in_reach = [F.get(signal, at + k) for k in range(-3, 3)]
        around = [F.get(raw, at - k) for k in (1, 2, 3)] + [F.get(lower, at - k) for k in (1, 2, 3)] + [F.get(lower, at + k) for k in (1, 2)]
        return F.struct(
            at.alias("_at"),
            token.alias("_word"),
            (F.col("_mixed") & v.is_upper(F.get(raw, at))).alias("_shouted"),
            F.when(F.coalesce(*[F.when(c, c) for c in in_reach], F.lit(False)), F.struct(*[c.alias(n) for c, n in zip(around, near)])).alias("_near"),
        )  # a null struct where no rule can apply

    texts_only = texts.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    prepared = texts_only.select(id_col, v.words(F.col("_text")).alias("_tokens"), v.emphasis(F.col("_text")).alias("_emphasis"))
    facts = (
        prepared.withColumns({"_lower": F.transform(raw, F.lower), "_mixed": v.mixed_capitals(raw)})
        .withColumn("_signals", F.transform(lower, v.signals))
        .select(
            id_col,
            "_emphasis",
            "_mixed",
            F.size(raw).alias("_size"),
            (F.array_position(lower, "but") - 1).alias("_but"),
            F.transform(lower, word).alias("_words"),
        )
    )
    header = F.array(F.lit(None).cast(facts.schema["_words"].dataType.elementType))
    return facts.withColumn("_entry", F.explode(F.concat(header, "_words"))).select(
        id_col, "_emphasis", "_size", "_mixed", "_but", "_entry._at", "_entry._word", "_entry._shouted",
        F.col("_entry._near").isNotNull().alias("_in_reach"), *[f"_entry._near.{n}" for n in near],
    )


def _shouted_base() -> Column:
    base = F.col("_base")
    return base + F.when(F.col("_shouted"), v.capital_shift(base)).otherwise(0.0)


def _with_rules(words: DataFrame) -> DataFrame:
    """``_value`` of the words that have something in reach."""
    c = F.col
    before = [c(f"_before_{k}") for k in (1, 2, 3)]
    after = [c("_after_1"), c("_after_2")]
    words = words.withColumn("_value", _shouted_base())
    for k in (1, 2, 3):
        # a word that has a sentiment itself is never a modifier of the next one
        applies = c(f"_before_{k}").isNotNull() & c(f"_known_{k}").isNull()
        boosted = c("_value") + v.boost_from(c(f"_raw_before_{k}"), c("_value"), c("_mixed"), k)
        words = words.withColumn("_boosted", boosted).withColumn("_turned", v.turn(c("_boosted"), before, k))
        changed = c("_turned") if k < 3 else v.idiom(c("_turned"), c("_word"), before, after)
        words = words.withColumn("_value", F.when(applies, changed).otherwise(c("_value"))).drop("_boosted", "_turned")
    least = (c("_before_1") == "least") & c("_known_1").isNull() & (
        c("_before_2").isNull() | ~c("_before_2").isin("at", "very")
    )
    return words.withColumn("_value", F.when(least, c("_value") * F.lit(v.NEGATION)).otherwise(c("_value")))


def _weighed(words: DataFrame) -> DataFrame:
    """What comes after a "but" counts more than what comes before."""
    c = F.col
    weight = (
        F.when((c("_but") < 0) | (c("_at") == c("_but")), 1.0)
        .when(c("_at") < c("_but"), v.BEFORE_BUT)
        .otherwise(v.AFTER_BUT)
    )
    return words.withColumn("_value", c("_value") * weight)


def _per_text(words: DataFrame, id_col: str) -> DataFrame:
    c = F.col
    value = c("_value")
    sums = words.groupBy(id_col).agg(
        F.max("_size").alias("size"),
        F.max("_emphasis").alias("emphasis"),
        F.round(F.coalesce(F.sum(value), F.lit(0.0)), _STEADY).alias("total"),
        F.round(F.coalesce(F.sum(F.when(value > 0, value + 1)), F.lit(0.0)), _STEADY).alias("praise"),
        F.round(F.coalesce(F.sum(F.when(value < 0, 1 - value)), F.lit(0.0)), _STEADY).alias("blame"),
        F.count_if(value != 0).alias("charged"),
    )
    extra = c("emphasis")
    sums = sums.select(
        id_col,
        "size",
        (c("total") + F.when(c("total") > 0, extra).when(c("total") < 0, -extra).otherwise(0.0)).alias("total"),
        (c("praise") + F.when(c("praise") > c("blame"), extra).otherwise(0.0)).alias("praise"),
        (c("blame") + F.when(c("blame") > c("praise"), extra).otherwise(0.0)).alias("blame"),
        (c("size") - c("charged")).alias("plain"),
    )
    whole = c("praise") + c("blame") + c("plain")

    def share(part):
        return F.when(c("size") == 0, 0.0).otherwise(F.round(F.try_divide(c(part), whole), 3))

    return sums.select(
        id_col,
        share("blame").alias("neg"),
        share("plain").alias("neu"),
        share("praise").alias("pos"),
        F.round(v.compound(c("total")), 4).alias("compound"),
    ).withColumn("pos_or_neg", stronger_side(c("pos"), c("neg")))
