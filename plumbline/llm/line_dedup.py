"""Line deduplication across documents, exact and within one edit, with DataFrame functions.

Lines are compared in a plain form (ASCII letters in lower case, runs of white space as
one space). Equal lines are one distinct line, placed at its earliest occurrence; that
aggregation combines on the map side, so a line that fills a third of the table is cheap.

Distinct lines within one edit of each other are found by a deletion-neighbourhood join.
Emitting every line with each of its characters deleted would cost the square of its
length, so the neighbourhood is emitted in two nested steps, both without loss:

* a line within one edit of another shares its first or its last half with it; lines
  that share no half drop out (four keys a line);
* the others are cut into blocks. The edit lies in one block, and all around it is
  equal. Under each key of surroundings that several lines share, the block is emitted
  with each of its characters deleted. Equal variants join; the edit distance of the two
  blocks is verified; and of two lines that close the earlier one stays.

Variants carry the place of the deletion. Lines that agree in variant and place differ
in one character there, so the earliest of a group is close to each other member and no
pairs are listed: a group costs one row per member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import text_key
from plumbline.plans.cutting import stage, staging

#: What the plain form maps to lower case and to spaces.
UPPER, LOWER, SPACES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\t\n\x0b\f\r"
#: Shorter lines match only if equal: one edit makes most short words another word.
MIN_NEAR = 20
#: Characters in a block; longer lines get the square root of their length, if that is more.
BLOCK = 32
#: Names of copied texts that are broadcast, after counting; more are joined.
BROADCAST_ROWS = 1_000_000


def plain(line: Column) -> Column:
    """The form in which lines are compared; empty for a line of white space."""
    folded = F.translate(line, UPPER + SPACES, LOWER + " " * len(SPACES))
    return F.trim(F.when(F.contains(folded, F.lit("  ")), F.regexp_replace(folded, " +", " ")).otherwise(folded))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" " + SPACES)) == ""


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_key(F.col(doc_id), F.col(text)).alias("key"), F.posexplode(F.split(text, "\n")).alias("no", "line")
    )
    return rows.where(~_blank(F.col("line"))).select("doc_id", "key", "no", plain(F.col("line")).alias("plain"))


def _halves() -> Column:
    """Keys of the halves; N is the length of the longer line of a pair that could share it."""
    n = F.length("plain")
    keys = []
    for longer in (n, n + 1):
        half = F.floor(longer / 2).cast("int")
        keys.append(F.xxhash64(longer, F.lit(0), F.substring(F.col("plain"), F.lit(1), half)))
        keys.append(F.xxhash64(longer, F.lit(1), F.right(F.col("plain"), half)))
    return F.when(n >= MIN_NEAR, F.array(*keys))


def distinct_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``line`` (a 128-bit name), its earliest place ``at``, and its half keys."""
    lines = _lines(docs, doc_id, text)
    name = F.struct(F.xxhash64("plain").alias("a"), F.xxhash64(F.lit("line"), F.col("plain")).alias("b"))
    first = F.struct("doc_id", "key", "no", _halves().alias("halves"))
    found = lines.select(name.alias("line"), first.alias("first")).groupBy("line").agg(F.min("first").alias("first"))
    return found.select(
        "line", F.struct("first.doc_id", "first.key", "first.no").alias("at"), F.col("first.halves").alias("halves")
    )


def near_lines(distinct: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Those of the ``distinct`` lines that are one edit away from an earlier one, by ``line``."""
    keys = distinct.select("line", "at", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    chosen = keys.join(shared, "half", "left_semi").select("line", "at").distinct()
    wanted = chosen.groupBy("at.doc_id", "at.key").agg(F.collect_list(F.struct("at.no", "line", "at")).alias("wanted"))
    texts = docs.select(F.col(doc_id).alias("own_id"), text_key(F.col(doc_id), F.col(text)).alias("own_key"), F.col(text).alias("text"))
    # repeated rows of a document would give the same line again
    met = texts.join(wanted, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    split = met.select(F.split("text", "\n").alias("lines"), "wanted").select(F.explode("wanted").alias("w"), F.get("lines", F.col("w.no")).alias("raw"))
    near = stage(split.select("w.line", "w.at", plain(F.col("raw")).alias("plain")).distinct(), "near")
    return _one_edit(near)


def _one_edit(near: DataFrame) -> DataFrame:
    n = F.length("plain")
    sized = near.select("line", "at", "plain", n.alias("n"), F.explode(F.array(n, n + 1)).alias("longer"))
    width = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.col("longer"))).cast("int"))
    sized = sized.withColumn("width", width).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("longer") - 1) / F.col("width")).cast("int"))))
    before = F.col("block") * F.col("width")
    after = F.greatest(F.lit(0), F.col("longer") - before - F.col("width"))
    around = F.struct(
        F.xxhash64("longer", "block", F.substring(F.col("plain"), F.lit(1), before)).alias("left"),
        F.xxhash64("longer", "block", F.right(F.col("plain"), after)).alias("right"),
    )
    inside = F.substring(F.col("plain"), before + 1, F.col("n") - before - after)
    blocks = sized.select("line", "at", around.alias("around"), inside.alias("inside"), (F.col("n") == F.col("longer")).alias("is_longer"))
    shared = blocks.groupBy("around").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("around")
    kept = blocks.join(shared, "around", "left_semi")
    size = F.length("inside")
    deleted = F.transform(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
        lambda i: F.struct(i.alias("place"), F.concat(F.substring(F.col("inside"), F.lit(1), i), F.substring(F.col("inside"), i + 2, size)).alias("rest")),
    )
    itself = F.array(F.struct(F.lit(-1).alias("place"), F.col("inside").alias("rest")))
    variants = kept.select(
        "line", "at", "inside", "is_longer", "around", F.explode(F.when(F.col("is_longer"), deleted).otherwise(itself)).alias("v")
    ).select("line", "at", "inside", "is_longer", F.col("v.place").alias("place"), F.xxhash64("around.left", "around.right", "v.rest").alias("variant"))
    first = F.struct("at", "inside")
    same_place = Window.partitionBy("variant", "place")
    same_rest = Window.partitionBy("variant")
    partners = variants.withColumn("swap", F.min(F.when(F.col("is_longer"), first)).over(same_place)).withColumns(
        {
            "short": F.min(F.when(~F.col("is_longer"), first)).over(same_rest),
            "long": F.min(F.when(F.col("is_longer"), first)).over(same_rest),
        }
    )

    def earlier(partner: str) -> Column:
        close = F.levenshtein(F.col("inside"), F.col(f"{partner}.inside")) <= 1
        return F.coalesce((F.col(f"{partner}.at") < F.col("at")) & close, F.lit(False))

    removed = F.when(F.col("is_longer"), earlier("swap") | earlier("short")).otherwise(earlier("long"))
    return partners.where(removed).select("line").distinct()


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``key``, ``kept``: the numbers of the lines that stay, by document."""
    with staging(docs.sparkSession):
        distinct = stage(distinct_lines(docs, doc_id, text), "lines")
        stays = distinct.join(near_lines(distinct, docs, doc_id, text), "line", "left_anti")
        kept = stays.groupBy(F.col("at.doc_id").alias("k_id"), F.col("at.key").alias("k_key")).agg(F.collect_list("at.no").alias("kept"))
        return stage(kept, "kept", outer=True)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that equal, or nearly equal, an earlier line.

    Earlier means a smaller document id, then (for ids that repeat) a smaller hash of id
    and text, then a smaller line number. Null ids come first. Lines of white space stay,
    a null text stays null, and a document may end up with an empty text. Whole rows that
    repeat are one document and change alike. Lines of any length take part; every column
    of ``docs`` stays as it is but for the text. An empty table gives an empty one.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(doc_id).alias("own_id"), text_key(F.col(doc_id), F.col(text)).alias("own_key"))
    same = (F.col("own_key") == F.col("k_key")) & F.col("own_id").eqNullSafe(F.col("k_id"))
    lined = rows.join(kept_lines(docs, doc_id, text), same, "left").select(
        "row", F.split(F.col("row").getField(text), "\n").alias("lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept")
    )
    numbers = F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0)))
    blank = F.filter(numbers, lambda i: _blank(F.get("lines", i)))
    chosen = lined.withColumn("chosen", F.array_intersect(numbers, F.array_union(F.col("kept"), blank)))
    new = F.when(F.col("lines").isNotNull(), F.array_join(F.transform("chosen", lambda i: F.get("lines", i)), "\n"))
    return chosen.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns])


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose whole text is that of an earlier document.

    Earlier is as in :func:`dedup_lines`, which would cut all lines of such a row and
    leaves all others the same lines with and without it. Null texts and texts of white
    space stay; whole rows that repeat stay or go alike. Texts are told apart by 128 bits.
    """
    name = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), F.col(text)).alias("b"))
    place = F.struct(F.col(doc_id).alias("id"), text_key(F.col(doc_id), F.col(text)).alias("key"))
    named = docs.where(~_blank(F.col(text))).select(name.alias("name"), place.alias("place"))
    spread = named.groupBy("name").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    copied = stage(spread.where("first < last").select(F.col("name").alias("c_name"), F.col("first").alias("c_first")), "copied")
    small = copied.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("own_name"), place.alias("own_place"))
    met = rows.join(F.broadcast(copied) if small else copied, F.col("own_name") == F.col("c_name"), "left")
    stays = met.where(F.col("c_first").isNull() | (F.col("own_place") == F.col("c_first")))
    return stays.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_left``, ``kept_sha256`` (of the text that is left; a null text counts as empty)."""
    n_lines = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("bigint")
    after = dedup_lines(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), n_lines.alias("n_lines")))
    left = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return after.select("doc_id", "n_lines", F.coalesce(left, F.col("n_lines")).cast("bigint").alias("n_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle() -> str:
    """The same over ``documents`` in DuckDB, pair by pair."""
    norm = f"trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
p AS (SELECT *, {norm} AS plain FROM l),
d AS (SELECT plain, min((doc_id, no)) AS pos, length(plain) AS n FROM p WHERE plain <> '' GROUP BY plain),
h AS (SELECT *, 0 AS side, left(plain, longer // 2) AS half FROM (SELECT *, unnest([n, n + 1]) AS longer FROM d WHERE n >= {MIN_NEAR})
      UNION ALL
      SELECT *, 1, right(plain, longer // 2) FROM (SELECT *, unnest([n, n + 1]) AS longer FROM d WHERE n >= {MIN_NEAR})),
c AS (SELECT DISTINCT a.plain AS a, b.plain AS b, a.n AS an, b.n AS bn FROM h a JOIN h b
      ON a.half = b.half AND a.side = b.side AND a.longer = b.longer AND a.pos < b.pos AND a.longer IN (a.n, b.n) AND b.longer = greatest(a.n, b.n)),
x AS (SELECT DISTINCT b FROM c WHERE CASE
      WHEN an = bn THEN len(list_filter(range(1, an + 1), lambda i: a[i] <> b[i])) = 1
      WHEN an < bn THEN len(list_filter(range(0, bn), lambda i: left(a, i) = left(b, i) AND right(a, bn - 1 - i) = right(b, bn - 1 - i))) > 0
      ELSE len(list_filter(range(0, an), lambda i: left(a, i) = left(b, i) AND right(a, an - 1 - i) = right(b, an - 1 - i))) > 0 END),
k AS (SELECT pos FROM d WHERE plain NOT IN (SELECT b FROM x)),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text, count(*) AS n_left FROM p
      WHERE plain = '' OR (doc_id, no) IN (SELECT pos FROM k) GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(string_split(t.text, chr(10))), 1)::BIGINT AS n_lines,
       CASE WHEN t.text IS NULL THEN 1 WHEN coalesce(s.text, '') = '' THEN 0 ELSE s.n_left END::BIGINT AS n_left,
       sha256(coalesce(s.text, '')) AS kept_sha256
FROM documents t LEFT JOIN s USING (doc_id)"""
