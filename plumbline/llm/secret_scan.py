"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of
ANDs that every match satisfies. The index has one posting per trigram and document, for
the trigrams that the rules ask for. Postings are intersected per conjunct; documents
that satisfy a conjunct are the rule's candidates, and only there its expression runs.
A rule without a mandatory trigram (such as a run of hex digits) scans all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as code, _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import ascii_lower, text_key

#: Strings tracked at once, and conjuncts of a query; beyond them the query gets weaker, never wrong.
MOST_STRINGS, MOST_CONJUNCTS = 32, 64

Query = frozenset  # of conjuncts, each a frozenset of trigrams; an empty conjunct is always true
ALWAYS: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """``group`` of each match must have ``least`` characters, else the match is dropped."""

    kind: str
    regex: str
    base: bool = False
    group: int = 0
    least: int = 0


#: The base kinds come first; spans that start together are listed in this order.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", True, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


# -- trigram queries ------------------------------------------------------------------


def _both(a: Query, b: Query) -> Query:
    made = frozenset(x | y for x, y in product(a, b))
    return made if len(made) <= MOST_CONJUNCTS else min(a, b, key=lambda q: (q == ALWAYS, len(q)))


def _holding(strings: set[str]) -> Query:
    """Any of the strings occurs, as far as trigrams tell."""
    made = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    return ALWAYS if frozenset() in made else made


def _characters(members) -> set[str] | None:
    found: set[str] = set()
    for kind, value in members:
        if kind is code.LITERAL:
            found.add(chr(value).lower())
        elif kind is code.RANGE and value[1] - value[0] < MOST_STRINGS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_STRINGS else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """All strings that the nodes match, if they are few; and a query that any match satisfies."""
    whole, query, run = True, ALWAYS, {""}

    def broken() -> None:
        nonlocal whole, query, run
        whole, query, run = False, _both(query, _holding(run)), {""}

    for kind, value in nodes:
        strings: set[str] | None = None
        inner = ALWAYS
        if kind is code.LITERAL:
            strings = {chr(value).lower()}
        elif kind is code.IN:
            strings = _characters(value)
        elif kind is code.SUBPATTERN:
            strings, inner = _walk(value[-1])
        elif kind is code.BRANCH:
            parts = [_walk(branch) for branch in value[1]]
            inner = frozenset().union(*(q for _, q in parts))
            inner = ALWAYS if frozenset() in inner else inner
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
        elif kind in (code.MAX_REPEAT, code.MIN_REPEAT):
            low, high, sub = value
            part, inner = _walk(sub)
            inner = inner if low else ALWAYS
            if part is not None and (low, high) == (0, 1):
                strings = part | {""}
            elif part is not None and low and low == high and len(part) ** low <= MOST_STRINGS:
                strings = {"".join(x) for x in product(part, repeat=low)}
        elif kind is code.AT:
            continue
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        elif strings is not None:
            broken()
            run = set(strings)
        else:
            broken()
            query = _both(query, inner)
    return (run if whole else None), _both(query, _holding(run))


def trigram_query(regex: str) -> Query:
    """An OR of ANDs of trigrams, in lower case, that holds wherever the regex matches."""
    query = _walk(parser.parse(regex))[1]
    return frozenset(c for c in query if not any(other < c for other in query))


# -- index, candidates, spans ---------------------------------------------------------


def trigram_index(docs: DataFrame, key: Column, text: Column, trigrams: list[str]) -> DataFrame:
    """``trigram``, ``key``: one posting for each of ``trigrams`` that a text holds in any case."""
    folded = docs.select(key.alias("key"), ascii_lower(text).alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``key``, ``kinds``: the rules whose query a document satisfies.

    The terms are as many as the rules have trigrams, so they are broadcast.
    """
    terms = [
        F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("conjunct"), F.lit(t).alias("trigram"), F.lit(len(conjunct)).alias("needs"))
        for kind, query in queries.items()
        for k, conjunct in enumerate(sorted(map(sorted, query)))
        for t in conjunct
    ]
    asked = index.sparkSession.range(1).select(F.inline(F.array(*terms)))
    met = (
        index.join(F.broadcast(asked), "trigram")
        .groupBy("key", "kind", "conjunct", "needs")
        .agg(F.size(F.collect_set("trigram")).alias("met"))
        .where("met = needs")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, number: int, text: Column) -> Column:
    """The rule's matches as (start, rank of the kind, end), in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found
    sizes = F.zip_with(found, judged, lambda m, g: F.struct(F.length(m).alias("all"), F.length(g).alias("judged")))
    # what stands before each match, then the match: their lengths add up to its place
    steps = F.zip_with(F.split(text, rule.regex, -1), sizes, lambda before, m: F.struct(F.length(before).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("spans"))

    def add(state: Column, step: Column) -> Column:
        first = state["at"] + step["gap"]
        last = first + step["m"]["all"]
        span = F.array(F.struct(first.alias("start"), F.lit(number).alias("rank"), last.alias("end")))
        good = F.coalesce(step["m"]["judged"] >= rule.least, F.lit(False))
        return F.struct(
            F.coalesce(last, first).alias("at"), F.when(good, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    return F.aggregate(steps, start, add)["spans"]


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, a count per base rule, ``base_sha256`` and ``spans`` of every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then in the
    order of ``rules``; those of different kinds may overlap. A null text has none.
    Repeated rows are scanned each; other columns are left aside; an empty table gives an
    empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    key = text_key(F.col("doc_id"), F.col("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) != ALWAYS}
    keyed = rows.withColumn("key", key)
    if queries:
        trigrams = sorted({t for q in queries.values() for c in q for t in c})
        chosen = candidates(trigram_index(rows, key, F.col("text"), trigrams), queries)
        keyed = keyed.join(chosen, "key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    spans = [
        F.when(F.array_contains("kinds", rule.kind) if rule.kind in queries else F.lit(True), _spans(rule, k, F.col("text")))
        for k, rule in enumerate(rules)
    ]
    found = keyed.select("doc_id", *[F.coalesce(s, none).alias(f"s{k}") for k, s in enumerate(spans)])
    base = [k for k, r in enumerate(rules) if r.base]
    together = lambda ks: F.concat(none, *[F.col(f"s{k}") for k in ks])
    return found.select(
        "doc_id",
        *[F.size(f"s{k}").cast("bigint").alias(f"n_{rules[k].kind}") for k in base],
        F.sha2(_joined(together(base), rules), 256).alias("base_sha256"),
        _joined(together(range(len(rules))), rules).alias("spans"),
    )
