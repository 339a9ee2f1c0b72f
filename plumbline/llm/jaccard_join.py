"""Near-duplicate documents: a set-similarity join with adaptive multi-match prefixes.

A document is its set of hashed five-word shingles. Equal sets are one class, found by a
hash of the set; the join works on classes.

All sets are sorted by one global order, rarest shingle first. Two sets of similarity t
that share enough must share at least k of their first ``n - ceil(t n) + k`` shingles
(their k-prefixes), for every k. A longer prefix costs index rows but lets one demand
more shared shingles before anything is verified. Each document picks its own k by
estimated cost: the number of documents that its prefix shingles lead to, divided by k,
against the rows of the prefix. Only one that leads to very many takes a k above
``PLAIN_MOST``, so that members of a large group are told apart by counting, without a
row for each pair of them.

What a pair must share follows from both sizes: similar sets share at least
``a = ceil(t (n1 + n2) / (1 + t))`` shingles. The i-th of them lies among the first
``n - a + i`` of either set, so at least ``a`` less the longer of the two rests after the
prefixes are in both prefixes. That is never less than the smaller k.

Frequencies come from a sketch of all documents: counters of a fixed number, summed over
tasks. It only sets the order and the choice of k; no pair depends on its accuracy.

Shingles in one prefix only are dropped before any pair is made. In a posting list with
more than ``CROWD`` members, all members are first held against two leaders; members
that the verified links to leaders connect need no pairs among them, so none are made.
Members of a list that is still long then try the few partners they share most with, and
what that connects makes no pairs either: a group is joined by some links for each member,
not by all there are. All other pairs of the list are counted, in memory by class, and each
that shares enough is verified on the full sets. Components of the verified links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import flat_bytes, fresh, ranges, slices, text_key, texts_of
from plumbline.llm.decontamination import Words
from plumbline.operators.components import connected_components
from plumbline.plans.cutting import stage, staging

WORDS = 5
#: Similarity of linked documents, as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: A posting list with more members goes through leaders first.
CROWD = 32
#: Partners that a member of a list with more than ``LONG`` members the leader does not reach tries before all others.
NEAREST, LONG = 4, 64
#: Members of a posting list that are packed into one row.
PART = 1000
#: Classes that meet their posting lists together, so that a list is sent once for all of them.
BLOCK = 128
#: Lists of numbers up to this length are broadcast (8 bytes each), longer ones are joined.
BROADCAST_ROWS = 2_000_000
#: Shingles per counter of the sketch, and the bounds of its size.
PER_COUNTER, LEAST_BITS, MOST_BITS = 128, 16, 24
BLOCKS = 64
#: Cost of verifying a candidate, in index rows.
VERIFY_COST = 20.0
CHOICES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024], np.int64)
#: Choices above this are for sets that still lead to more than ``HOT`` candidates by estimate.
PLAIN_MOST, HOT = 32, 128

#: A-Z to a-z and white space to spaces; all else stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text in ascending order, the text of each, sizes, and a hash of each set."""
    words = Words(texts, FOLD)
    n_words = words.stops - words.firsts
    found, owner = [], []
    for size in range(1, WORDS + 1):
        rows = np.flatnonzero(n_words == size if size < WORDS else n_words >= WORDS)
        if len(rows):
            counts = n_words[rows] - size + 1
            found.append(words.windows(size)[ranges(words.firsts[rows], counts)] + np.uint64(size))
            owner.append(np.repeat(rows, counts))
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    doc = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    if len(values):
        first = np.concatenate([[True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])])
        values, doc = values[first], doc[first]
    sizes = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    mixed ^= mixed >> np.uint64(28)
    names = np.zeros(len(texts), np.uint64)
    some = sizes > 0
    if some.any():
        names[some] = np.add.reduceat(mixed * (mixed | np.uint64(1)), (np.cumsum(sizes) - sizes)[some])
    return values, doc, sizes, names.astype(np.int64)


def _classes(keyed: DataFrame) -> DataFrame:
    """``id``, ``key``, ``cid`` (the class; null for an empty set) and ``n`` of every row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, sizes, names = shingles(texts_of(batch, "text"))
            arrays = [batch.column("id"), batch.column("key"), pa.array(names, pa.int64(), mask=sizes == 0), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "cid", "n"])

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(name, f"id {kind}, key bigint, cid bigint, n bigint")


def _frequencies(keyed: DataFrame, total: int) -> np.ndarray:
    """Counters, by the low bits of a shingle's hash, of how many sets hold it (an upper estimate)."""
    bits = min(max(int(np.ceil(np.log2(max(total, 1) / PER_COUNTER + 1))), LEAST_BITS), MOST_BITS)
    width = (1 << bits) // BLOCKS

    def blocks(counters: np.ndarray) -> pa.RecordBatch:
        filled = [b for b in range(BLOCKS) if counters[b * width : (b + 1) * width].any()]
        parts = [counters[b * width : (b + 1) * width].astype("<u4").tobytes() for b in filled]
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = np.zeros(1 << bits, np.int64), set()
        for batch in slices(batches, "text"):
            values, doc, _, names = shingles(texts_of(batch, "text"))
            new = _unseen(names, seen)
            counters += np.bincount((values[new[doc]] & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        yield blocks(counters)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                before = sums.get(block, np.zeros(width, np.int64))
                sums[block] = np.minimum(before + np.frombuffer(part, "<u4"), np.iinfo(np.uint32).max)
        names, parts = list(sums), [x.astype("<u4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    parts = keyed.select("text").mapInArrow(count, schema).repartition(16, "block").mapInArrow(add, schema)
    out = np.zeros(1 << bits, np.uint32)
    for block, part in parts.collect():  # at most 2 ** MOST_BITS counters
        out[block * width : (block + 1) * width] = np.frombuffer(part, "<u4")
    return out


def _unseen(names: np.ndarray, seen: set) -> np.ndarray:
    """Which sets a task meets for the first time; copies in one task then cost nothing more."""
    new = np.zeros(len(names), bool)
    for i, name in enumerate(names.tolist()):
        if name not in seen:
            seen.add(name)
            new[i] = True
    return new


def prefix_lengths(excess: np.ndarray) -> tuple[int, int]:
    """(k, prefix length) of least estimated cost for a set whose shingles, rarest first,
    lead to ``excess`` other documents each."""
    n = len(excess)
    needed = -(-NUMERATOR * n // DENOMINATOR)
    choices = CHOICES[CHOICES <= needed]
    lengths = n - needed + choices
    candidates = np.cumsum(excess)[lengths - 1] / choices
    cost = candidates * VERIFY_COST + lengths
    plain = int((choices <= PLAIN_MOST).sum())
    best = int(cost[:plain].argmin())
    if candidates[best] > HOT:
        best = int(cost.argmin())
    return int(choices[best]), int(lengths[best])


def _prefixes(keyed: DataFrame, shared: Broadcast, noise: float) -> DataFrame:
    """``cid``, ``n``, ``k``, ``tokens``: the prefix of each distinct set (once a task)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = shared.value, set()
        low = np.uint64(len(counters) - 1)
        for batch in slices(batches, "text"):
            values, doc, sizes, names = shingles(texts_of(batch, "text"))
            count = counters[(values & low).astype(np.int64)]
            order = np.lexsort((values, count, doc))
            values, excess = values[order], np.maximum(count[order] - noise, 0.0)
            starts = np.cumsum(sizes) - sizes
            rows = np.flatnonzero(_unseen(names, seen) & (sizes > 0))
            k, length = np.ones(len(rows), np.int64), np.ones(len(rows), np.int64)
            for i, row in enumerate(rows):
                k[i], length[i] = prefix_lengths(excess[starts[row] : starts[row] + sizes[row]])
            tokens = pa.array(values[ranges(starts[rows], length)].astype(np.int64), pa.int64())
            ends = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
            arrays = [*(pa.array(a, pa.int64()) for a in (names[rows], sizes[rows], k)), pa.ListArray.from_arrays(ends, tokens)]
            yield pa.RecordBatch.from_arrays(arrays, ["cid", "n", "k", "tokens"])

    return keyed.select("text").mapInArrow(emit, "cid bigint, n bigint, k bigint, tokens array<bigint>")


def _only(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The ``rows`` whose ``column`` is among ``wanted``, broadcast if that was counted and is short."""
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(wanted) if small else wanted, column, "left_semi")


def _postings(keyed: DataFrame, total: int) -> DataFrame:
    """``token``, ``cid``, ``n``, ``k`` of all prefix shingles that more than one class has, staged."""
    counters = _frequencies(keyed, total)
    mean = float(counters.mean())
    shared = keyed.sparkSession.sparkContext.broadcast(counters)
    with staging(keyed.sparkSession):
        prefixes = stage(_prefixes(keyed, shared, mean + 4.0 * np.sqrt(mean) + 1.0), "prefixes")
        rows = prefixes.select("cid", "n", "k", F.explode("tokens").alias("token"))
        # a shingle of one class has one name for it: other than count(distinct), this combines on the map side
        spread = rows.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high"))
        common = stage(spread.where("low < high").select("token"), "tokens")
        return stage(_only(rows, common, "token").distinct(), "postings", outer=True)


def _fits(a: Column, b: Column) -> Column:
    """Two sizes between which the similarity is possible at all."""
    return (DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b))


def _must_share(n: Column, k: Column, other_n: Column, other_k: Column) -> Column:
    """Shingles that the prefixes of two sets must share if the sets are similar enough."""
    both = NUMERATOR + DENOMINATOR
    overlap = F.floor((NUMERATOR * (n + other_n) + (both - 1)) / F.lit(both))
    slack = [F.floor((NUMERATOR * size + (DENOMINATOR - 1)) / F.lit(DENOMINATOR)) - own for size, own in ((n, k), (other_n, other_k))]
    return F.greatest(overlap - F.greatest(*slack), F.least(k, other_k)).cast("bigint")


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share as many prefix shingles as they must (``k``)."""
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("k").alias("k"))
    return met.where("met >= k").select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, repeats: bool) -> DataFrame:
    """Those of the staged pairs of classes whose sets are similar enough, staged.

    ``repeats`` tells whether rows of ``keyed`` share a key; if none do, a class gives one
    set as it is, and the sets are not shuffled to see to that.
    """
    with staging(keyed.sparkSession):
        return stage(_similar(pairs, classes, keyed, repeats), "links", outer=True)


def _similar(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, repeats: bool) -> DataFrame:
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    keys = stage(classes.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min("key").alias("key")).select("key"), "keys")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, _, sizes, names = shingles(texts_of(batch, "text"))
            # 48 bits tell the shingles of two documents apart
            short = np.ascontiguousarray((values >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
            ends = 6 * np.cumsum(sizes)
            sets = [short[end - 6 * size : end] for end, size in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["cid", "members"])

    chosen = _only(keyed, keys, "key").select("text").mapInArrow(emit, "cid bigint, members binary")
    sets = stage(chosen.dropDuplicates(["cid"]) if repeats else chosen, "sets")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wide(members: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            raw, offsets = flat_bytes(members)
            out = np.zeros((len(raw) // 6, 8), np.uint8)
            out[:, :6] = raw.reshape(-1, 6)
            return out.view("<u8").reshape(-1), np.diff(offsets) // 6

        for batch in slices(batches, "x", 1_000_000):
            x, nx = wide(batch.column("x"))
            y, ny = wide(batch.column("y"))
            row = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
            both = np.concatenate([x, y])
            order = np.lexsort((both, row))
            both, row = both[order], row[order]
            same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
            met = np.bincount(row[1:][same], minlength=len(nx))
            keep = pa.array(DENOMINATOR * met >= NUMERATOR * (nx + ny - met))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    first = pairs.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a")
    second = first.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b")
    return second.select("a", "b", "x", "y").mapInArrow(judge, "a bigint, b bigint")


def _groups(links: DataFrame) -> DataFrame:
    """``cid``, ``component`` of the linked classes."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = connected_components(ends, links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("id").alias("cid"), "component")


def similar_classes(keyed: DataFrame, classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between classes that connect all that are similar enough."""
    spark = keyed.sparkSession
    total = classes.agg(F.sum("n")).first()[0] or 0
    repeats = not classes.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty()
    member = lambda salt: F.min(F.struct(F.xxhash64("cid", F.lit(salt)).alias("h"), "cid", "n", "k"))
    with staging(spark):  # what a phase staged goes as soon as its result is written
        postings = _postings(keyed, total)
        lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("members"), member(1).alias("l1"), member(2).alias("l2"))
        # staged, here and below: two tables meet in exchanges of their own, which Spark splits where a key is hot
        lists = stage(lists, "lists")
        led = stage(postings.join(lists, "token").select(
            "token", "cid", "n", "k", (F.col("members") > crowd).alias("crowded"), "l1", "l2"
        ), "led", outer=True)
    star = led.where("crowded").select("cid", "n", "k", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("l"))
    star = star.where((F.col("cid") != F.col("l.cid")) & _fits(F.col("n"), F.col("l.n")))
    star = star.select(F.least("cid", "l.cid").alias("a"), F.greatest("cid", "l.cid").alias("b"), _must_share(F.col("n"), F.col("k"), F.col("l.n"), F.col("l.k")).alias("k"))
    links = _verified(stage(_enough(star), "pairs"), classes, keyed, repeats)
    tried, known = links, _labelled(led, links)
    with staging(spark):
        apart = known.where("not leading").groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > LONG)
        long = stage(apart.select("token"), "long")
        crowded = not long.isEmpty()
        nearest = stage(_partners(_only(known, long, "token"), sized=True, nearest=NEAREST), "pairs", outer=True) if crowded else None
    if crowded and not nearest.isEmpty():
        tried = links.union(nearest)
        links = links.union(_verified(nearest, classes, keyed, repeats))
        known = _labelled(led, links)
    with staging(spark):
        pairs = stage(_partners(known, sized=True).join(tried, ["a", "b"], "left_anti"), "pairs", outer=True)
    return links.union(_verified(pairs, classes, keyed, repeats))


def _labelled(led: DataFrame, links: DataFrame) -> DataFrame:
    """``token``, ``cid``, ``n``, ``k``, ``label``, ``leading``, staged: classes that the links connect carry one label."""
    labels = stage(_groups(links), "labels")
    own, lead = (labels.select(F.col("cid").alias(f"{c}_cid"), F.col("component").alias(f"{c}_label")) for c in ("own", "lead"))
    known = led.join(own, F.col("cid") == F.col("own_cid"), "left").join(lead, F.col("l1.cid") == F.col("lead_cid"), "left")
    label = F.coalesce("own_label", "cid")
    return stage(known.select("token", "cid", "n", "k", label.alias("label"), (label == F.coalesce("lead_label", "l1.cid")).alias("leading")), "known")


def _partners(known: DataFrame, sized: bool = False, nearest: int = 0) -> DataFrame:
    """Pairs (a, b) of different labels that share enough prefix shingles.

    With ``nearest``, only some of them: for each class that many, at most, from each part of
    the members, of those that share enough in the lists it meets itself, the most first.

    Enough is the smaller k, or with ``sized``, which takes the shingles of a class to be the
    prefix of its k, what sets of the two sizes must share.

    A class that is not connected with a list's leader meets the list packed, in parts of
    about ``PART`` members by a hash of the member, so that its lists are counted together
    in memory. Classes with the same longest list do so in blocks of about ``BLOCK``, to which
    every list is sent once. Of the lists a pair shares, either class sees those in which it is not
    leading itself. The class with the smaller id counts all that it sees, the other one
    those that only it sees, and the two counts are added. A count becomes a row only if
    the pair can reach what it must share: the lists a class does not see are at most those
    that it leads, and at most those its partner meets as not leading. Members stand by label
    in a list, so those of a class's own label are left out as a whole.
    """
    open_lists = known.where("not leading").select("token").distinct()
    active = known.join(open_lists, "token", "left_semi")
    active = stage(active.select("token", "cid", "n", "k", "label", "leading"), "active")
    counts = active.groupBy("cid").agg(F.count_if("leading").alias("led"), F.count_if(~F.col("leading")).alias("unled"))
    # in one number: k, whether the class leads here, and how many lists it does not lead
    info = F.col("k") + (1 << 16) * F.col("leading").cast("int") + (1 << 17) * F.col("unled")
    active = active.join(counts, "cid").select("token", "cid", "n", "k", "label", "leading", "led", info.alias("info"))
    active = stage(active, "counted")
    lengths = active.groupBy("token").agg(F.count(F.lit(1)).alias("members"))
    longest = lengths.agg(F.max("members")).first()[0] or 0
    part = F.pmod(F.xxhash64("cid", F.lit("part")), F.lit(-(-longest // PART) or 1))
    packed = active.groupBy("token", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("label", "cid", "info", "n"))).alias("members"))
    # a label that is the class's own is not written
    labels = F.transform("members", lambda m: F.nullif(m["label"], m["cid"])).alias("labels")
    packed = stage(packed.select("token", "part", labels, *[F.col(f"members.{c}").alias(f"{c}s") for c in ("cid", "info", "n")]), "packed")
    rest = active.where("not leading").join(lengths, "token").groupBy(F.col("cid").alias("x")).agg(
        *[F.first(c).alias(f"x_{c}") for c in ("n", "k", "led", "label")],  # the same in all rows of a class
        F.max(F.struct("members", "token")).getField("token").alias("home"), F.collect_list("token").alias("tokens"),
    )
    rest = stage(rest, "rest")
    homes = rest.groupBy("home").agg(F.count(F.lit(1)).alias("rows"))
    block = F.pmod(F.xxhash64("x", F.lit("block")), F.ceil(F.col("rows") / F.lit(BLOCK))).alias("block")
    rest = stage(rest.join(homes, "home").select("home", block, *[c for c in rest.columns if c != "home"]), "blocks")
    sent = rest.select("home", "block", F.explode("tokens").alias("token")).distinct().join(packed, "token")
    sent = stage(sent.select("home", "block", "part", "token", "labels", "cids", "infos", "ns"), "sent")
    met = sent.select("home", "block", "part").distinct().join(rest, ["home", "block"])
    both = met.unionByName(sent, allowMissingColumns=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, tuple[np.ndarray, ...]] = {}
        key: tuple | None = None

        def partners(x: int, x_n: int, x_k: int, x_led: int, x_label: int, tokens: list[int]) -> pa.RecordBatch | None:
            held = []
            for labels, *columns in (lists[token] for token in tokens if token in lists):
                first, last = (int(labels.searchsorted(x_label, side)) for side in ("left", "right"))
                held += [[c[at] for c in columns] for at in (slice(first), slice(last, None))]
            if not held:
                return None
            cids, infos, ns = (np.concatenate(arrays) for arrays in zip(*held))
            found, first, at = np.unique(cids, return_index=True, return_inverse=True)
            info, n = infos[first], ns[first]
            met = np.bincount(at, minlength=len(found))
            only = np.bincount(at[(infos >> 16) & 1 == 1], minlength=len(found))
            k = info & 0xFFFF
            least = np.minimum(k, x_k)
            if sized:
                overlap = -(-NUMERATOR * (n + x_n) // (NUMERATOR + DENOMINATOR))
                slack, x_slack = -(-NUMERATOR * n // DENOMINATOR) - k, -(-NUMERATOR * x_n // DENOMINATOR) - x_k
                least = np.maximum(least, overlap - np.maximum(slack, x_slack))
            unseen = np.minimum(x_led, (info >> 17) - (met - only))
            own = np.where((x < found) | (nearest > 0), met, only)
            fits = DENOMINATOR * np.minimum(n, x_n) >= NUMERATOR * np.maximum(n, x_n)
            keep = np.flatnonzero((met + (0 if nearest else unseen) >= least) & (own > 0) & fits)
            if nearest:
                keep = keep[np.argsort((least - met)[keep], kind="stable")[:nearest]]
            found, own, least = found[keep], own[keep], least[keep]
            arrays = [np.minimum(found, x), np.maximum(found, x), own, least]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["a", "b", "met", "k"])

        for batch in batches:
            columns = [batch.column(c) for c in ("labels", "cids", "infos", "ns")]
            places = zip(*(batch.column(c).to_pylist() for c in ("home", "block", "part")))
            rows = zip(*(batch.column(c).to_pylist() for c in ("token", "x", "x_n", "x_k", "x_led", "x_label")))
            for i, (place, (token, *own)) in enumerate(zip(places, rows)):
                if place != key:
                    lists, key = {}, place
                if token is not None:  # the lists of a block come before its classes
                    labels, *rest = (column[i].values for column in columns)
                    lists[token] = tuple(c.to_numpy(zero_copy_only=False) for c in (pc.coalesce(labels, rest[0]), *rest))
                    continue
                out = partners(*own, batch.column("tokens")[i].values.to_numpy(zero_copy_only=False).tolist())
                if out is not None and out.num_rows:
                    yield out

    place = ["home", "block", "part"]
    met = both.repartition(*place).sortWithinPartitions(*place, F.col("token").isNull()).mapInArrow(count, "a bigint, b bigint, met bigint, k bigint")
    return met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("k").alias("k")).where("met >= k").select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``key`` (of id and text), ``n_shingles`` and ``component_id`` of every row.

    The component is named after its smallest id. A null or empty text has no shingles
    and is alone; a text of fewer than five words is one shingle; equal texts share a
    component, as do repeated rows. Texts are read whole. An empty table gives an empty
    result; other columns are left aside. Shingles and sets are told apart by 64-bit
    hashes, and by 48 bits within a pair.
    """
    keyed = docs.select(F.col(doc_id).alias("id"), text_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    classes = stage(_classes(keyed), "classes")
    named = classes.where("cid is not null")
    with staging(docs.sparkSession):
        links = similar_classes(keyed.select("key", "text"), named, crowd)
        groups = stage(_groups(links), "groups", outer=True)
    smallest = named.groupBy("cid").agg(F.min("id").alias("low"))
    of_group = smallest.join(groups, "cid").groupBy("component").agg(F.min("low").alias("low"))
    lows = groups.join(of_group, "component").select("cid", F.col("low").alias("group_low"))
    names = stage(smallest.join(lows, "cid", "left").select("cid", F.coalesce("group_low", "low").alias("component_id")), "names")
    out = named.join(names, "cid").select(F.col("id").alias("doc_id"), "key", F.col("n").alias("n_shingles"), "component_id")
    alone = classes.where("cid is null").select(F.col("id").alias("doc_id"), "key", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(alone)


def keep_first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that are alone or come first in their group.

    First is the smallest id, then (for ids that repeat) the smallest hash of id and
    text; a row that repeats as a whole is kept once. Rows without shingles all stay.
    """
    own_id, own_key = fresh(docs, "own_id", "own_key")
    groups = stage(near_duplicates(docs, doc_id, text), "near")
    linked = groups.where("n_shingles > 0")
    leading = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    alone = groups.where("n_shingles = 0").select("doc_id", "key").distinct()
    keep = stage(leading.union(alone).toDF("f_id", "f_key"), "first")
    again = linked.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").toDF("f_id", "f_key", "rows")
    same = (F.col(own_key) == F.col("f_key")) & F.col(own_id).eqNullSafe(F.col("f_id"))
    rows = docs.withColumns({own_id: F.col(doc_id), own_key: text_key(F.col(doc_id), F.col(text))})
    kept = rows.join(keep, same, "left_semi")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([own_id, own_key]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """The same over ``documents`` in DuckDB, from exact sets of words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < {WORDS} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i : i + {WORDS - 1}], ' ')) END) AS shingle
      FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""
