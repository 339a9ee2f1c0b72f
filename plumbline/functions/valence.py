"""Rules of the VADER sentiment model (Hutto and Gilbert, ICWSM 2014) as Columns.

The lexicon itself is a table the caller supplies; only the rule constants and the
closed word classes the rules name are here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Rule constants of the published model.
BOOST = 0.293
DAMPEN = -0.293
CAPITALS = 0.733
NEGATION = -0.74
NEVER_NEAR = 1.5
NEVER_FAR = 1.25
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
DISTANCE = {1: 1.0, 2: 0.95, 3: 0.9}
EXCLAMATION = 0.292
MAX_EXCLAMATIONS = 4
QUESTION = 0.18
MANY_QUESTIONS = 0.96
NORMALISER = 15.0

# Punctuation that is stripped from one end of a word.
STRIPPED = [".", "!", "?", ",", ";", ":", "-", "'", '"', "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?"]

# Words that turn a sentiment around.
NEGATIONS = [
    "ain't", "aint", "aren't", "arent", "can't", "cannot", "cant", "couldn't", "couldnt", "daren't",
    "darent", "despite", "didn't", "didnt", "doesn't", "doesnt", "don't", "dont", "hadn't", "hadnt",
    "hasn't", "hasnt", "haven't", "havent", "isn't", "isnt", "mightn't", "mightnt", "mustn't", "mustnt",
    "needn't", "neednt", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtn't", "oughtnt", "rarely", "seldom", "shan't", "shant", "shouldn't", "shouldnt", "uh-uh",
    "uhuh", "wasn't", "wasnt", "weren't", "werent", "without", "won't", "wont", "wouldn't", "wouldnt",
]

# Words that strengthen or weaken the sentiment after them.
BOOSTERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "effing",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "flippin",
    "flipping", "frickin", "fricking", "friggin", "frigging", "fucking", "fully", "greatly", "hella",
    "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously",
    "uber", "unbelievably", "unusually", "utterly", "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "just enough", "kind of", "kind-of", "kinda", "kindof", "less",
    "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat", "sort of",
    "sort-of", "sorta", "sortof",
]

# Phrases with a sentiment of their own.
IDIOMS = {
    "bad ass": 1.5,
    "cut the mustard": 2.0,
    "hand to mouth": -2.0,
    "kiss of death": -1.5,
    "the bomb": 3.0,
    "the shit": 3.0,
    "yeah right": -2.0,
}

#: Words one of which is in reach whenever a rule can change a word's sentiment: single
#: words as they are, phrases by their longest part.
SIGNALS = sorted({max(phrase.split(), key=len) for phrase in [*BOOSTERS, *DAMPENERS, *NEGATIONS, *IDIOMS, "so", "this", "least"]})

_PUNCTUATION = r"\p{Punct}"


def words(text: Column) -> Column:
    """Tokens of two or more characters, one punctuation mark stripped from a plain word's end."""
    marks = "|".join("".join("\\" + ch for ch in mark) for mark in sorted(STRIPPED, key=len, reverse=True))
    plain = rf"([^{_PUNCTUATION}\s]{{2,}})"
    one_sided = rf"^(?:(?:{marks}){plain}|{plain}(?:{marks}))$"
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: F.length(t) > 1)
    return F.transform(tokens, lambda t: F.regexp_replace(t, one_sided, "$1$2"))


def is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def mixed_capitals(tokens: Column) -> Column:
    """Whether some but not all tokens are written in capitals."""
    capitals = F.size(F.filter(tokens, is_upper))
    return (capitals > 0) & (capitals < F.size(tokens))


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add."""
    exclamations = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return F.least(exclamations, F.lit(MAX_EXCLAMATIONS)) * F.lit(EXCLAMATION) + (
        F.when(questions <= 1, 0.0).when(questions <= 3, questions * F.lit(QUESTION)).otherwise(MANY_QUESTIONS)
    )


def is_modifier(word: Column, following: Column) -> Column:
    """Boosters and dampeners carry no sentiment themselves."""
    return word.isin(BOOSTERS + DAMPENERS) | ((word == "kind") & F.coalesce(following == "of", F.lit(False)))


def signals(word: Column) -> Column:
    """Whether a lower-case word can change the sentiment of its neighbours."""
    return word.isin(SIGNALS) | word.contains("n't")


def negates(word: Column) -> Column:
    return word.isin(NEGATIONS) | word.contains("n't")


def capital_shift(value: Column) -> Column:
    return F.when(value > 0, CAPITALS).otherwise(-CAPITALS)


def boost_from(raw: Column, value: Column, capitals_matter: Column, distance: int) -> Column:
    """What the word ``distance`` places before adds to ``value``."""
    word = F.lower(raw)
    size = F.when(word.isin(BOOSTERS), BOOST).when(word.isin(DAMPENERS), DAMPEN)
    signed = F.when(value < 0, -size).otherwise(size)
    shouted = F.when(capitals_matter & is_upper(raw), capital_shift(value)).otherwise(0.0)
    return F.coalesce((signed + shouted) * F.lit(DISTANCE[distance]), F.lit(0.0))


def turn(value: Column, before: list[Column], distance: int) -> Column:
    """``value`` after looking for a negation ``distance`` places before.

    ``before`` holds the lower-cased words 1, 2 and 3 places before. "never so" and
    "never this" strengthen instead; three places away a bare "so" or "this" next to
    the word has that effect too, as in the published implementation.
    """
    word = before[distance - 1]
    negated = F.when(negates(word), value * F.lit(NEGATION)).otherwise(value)
    if distance == 1:
        return negated
    degree = [w.isin("so", "this") for w in before]
    if distance == 2:
        return F.when((word == "never") & degree[0], value * F.lit(NEVER_NEAR)).otherwise(negated)
    strengthened = ((word == "never") & degree[1]) | degree[0]
    return F.when(strengthened, value * F.lit(NEVER_FAR)).otherwise(negated)


def idiom(value: Column, word: Column, before: list[Column], after: list[Column]) -> Column:
    """Value of an idiom the word is part of, less the effect of a two-word dampener before it."""
    one, two, three = before
    phrases = [
        F.concat_ws(" ", after_0, *rest)
        for after_0, *rest in ([one, word], [two, one, word], [two, one], [three, two, one], [three, two])
    ]
    ahead = [F.concat(word, F.lit(" "), after[0]), F.concat(word, F.lit(" "), after[0], F.lit(" "), after[1])]

    def look_up(phrase: Column) -> Column:
        found = F.lit(None).cast("double")
        for text, worth in IDIOMS.items():
            found = F.when(phrase == text, worth).otherwise(found)
        return found

    behind = F.coalesce(*[look_up(p) for p in phrases])
    settled = F.coalesce(*[look_up(p) for p in reversed(ahead)], behind, value)
    dampened = phrases[4].isin(DAMPENERS) | phrases[2].isin(DAMPENERS)
    # every phrase looked at holds the word itself or the one two places before
    parts = sorted({part for phrase in [*IDIOMS, *DAMPENERS] for part in phrase.split()})
    possible = word.isin(parts) | two.isin(parts)
    return F.when(possible, settled + F.when(dampened, DAMPEN).otherwise(0.0)).otherwise(value)


def compound(total: Column) -> Column:
    """Sum of sentiments squeezed into [-1, 1]."""
    return F.greatest(F.least(total / F.sqrt(total * total + F.lit(NORMALISER)), F.lit(1.0)), F.lit(-1.0))
