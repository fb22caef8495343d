"""Quality gates of lines, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueline.functions import lexicon as L
from cueline.functions.text import for_stock_phrases, matches, strip
from cueline.params import DEFAULT, Params

STATUSES = ["passed", "rejected_blacklist", "rejected_wordcount", "rejected_quality"]


def basic_invalid(c: Column) -> Column:
    """Empty, digits only, no letter or digit, all in brackets, music, or at most one letter."""
    t = strip(F.coalesce(c, F.lit("")))
    found = [matches(t, p) for p in (L.DIGITS, L.NO_LETTERS, L.BRACKETED, L.STAGE, L.MUSIC)]
    out = (t == "") | ~matches(t, "[a-zA-Z][^a-zA-Z]*[a-zA-Z]")
    for x in found:
        out = out | x
    return out


def stock_phrase(c: Column) -> Column:
    return F.coalesce(for_stock_phrases(c).isin(*sorted(L.STOCK_PHRASES)), F.lit(False))


def self_introduction(c: Column) -> Column:
    t = strip(c)
    return matches(t, L.INTRO_NAME) | matches(t, L.INTRO_GREETING)


def hanging(t: Column, pattern: str) -> Column:
    """A condition at the start and no main clause behind a comma."""
    comma = F.instr(t, ",") - 1
    return matches(t, pattern) & ~((comma > 0) & (comma < F.length(t) - 2))


def autonomy(c: Column) -> Column:
    """How far a line stands by itself: 1 less 0.6 at most what points elsewhere."""
    t = strip(F.coalesce(c, F.lit("")))
    off = [(matches(t, L.TRUNCATED), 0.30), (matches(t, L.CONTINUES), 0.25), (hanging(t, L.CONDITION), 0.20), (matches(t, L.POINTS_BACK), 0.15), (matches(t, L.LEANS), 0.15)]
    total = F.lit(0.0)
    for found, much in off:
        total = total + F.when(found, much).otherwise(0.0)
    return F.when(t == "", 0.6).otherwise(F.round(F.greatest(F.lit(0.6), 1.0 - total), 4))


def _occurrences(text: Column, may: Column, pattern: str) -> Column:
    """How often the pattern occurs, looked for only where it may."""
    return F.when(may, F.regexp_count(text, F.lit(pattern))).otherwise(0)


def spoken_score(c: Column) -> Column:
    """How much a line is like speech, times its autonomy: short forms, content words, phrasal verbs and idioms, kind of sentence.

    The lists of phrases are patterns of many branches. A line is split once into runs of letters, and a pattern runs only over lines with
    a run that all its matches need.
    """
    text = F.coalesce(c, F.lit(""))
    t, low = strip(text), F.lower(text)
    words = F.regexp_extract_all(low, F.lit("([a-z']+)"), F.lit(1))
    runs = F.split(low, "[^a-z]+")
    has = lambda some: F.arrays_overlap(runs, F.array(*[F.lit(w) for w in sorted(some)]))
    shouted = F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(F.length(t), F.lit(1)) > 0.5
    content = lambda found: F.size(F.filter(found, lambda w: ~w.isin(*sorted(L.FUNCTION_WORDS)) & (F.length(w) > 1)))
    spoken = _occurrences(text, F.contains(low, F.lit("'")) | has(w for w in L.SPOKEN_FORMS if "'" not in w), L.any_of(L.SPOKEN_FORMS))
    verbs = _occurrences(text, has({v.split()[0] for v in L.PHRASAL_VERBS}), L.any_of(L.PHRASAL_VERBS))
    # an idiom's last word is a run of its own unless any character may stand before it
    open_ = [p.rsplit("}", 1)[1] for p in L.IDIOMS if "}" in p and " " not in p.rsplit("}", 1)[1]]
    idiom = has({p.split()[-1] for p in L.IDIOMS if "}" not in p or " " in p.rsplit("}", 1)[1]})
    for end in open_:
        idiom = idiom | F.contains(low, F.lit(end.lower()))
    idioms = _occurrences(text, idiom, L.any_of(L.IDIOMS))
    add = lambda found, much: F.when(found, much).otherwise(0.0)

    def score(n: Column, content: Column) -> Column:
        short = F.least(spoken / F.greatest(n / 5, F.lit(1.0)), F.lit(1.0))
        dense = F.least((content / F.greatest(n, F.lit(1))) / 0.55, F.lit(1.0))
        native = F.least((verbs + idioms * 1.5) / F.greatest(n / 8, F.lit(1.0)), F.lit(1.0))
        sentence = 0.5 + add(F.endswith(t, F.lit("?")) | matches(t, L.QUESTION), 0.2) + add(matches(text, L.NEGATION), 0.15) + add(matches(text, L.IF_CLAUSE), 0.10) + add(matches(text, L.SUBCLAUSE), 0.05) - add(n <= 2, 0.30)
        sentence = F.greatest(F.lit(0.0), F.least(sentence, F.lit(1.0)))
        return F.when(n == 0, 0.0).otherwise(F.round((short * 0.30 + dense * 0.25 + native * 0.25 + sentence * 0.20) * autonomy(text), 4))

    # the words are found once and counted once: each lambda names what its formula uses several times
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), content(w).alias("content")))
    return F.when(matches(text, L.GARBAGE) | shouted, 0.0).otherwise(F.element_at(F.transform(counted, lambda k: score(k["n"], k["content"])), 1))


def early_status(text: Column, words: Column, params: Params = DEFAULT) -> Column:
    """The status of a line that fails before it is scored, else null."""
    return F.when(basic_invalid(text) | stock_phrase(text) | self_introduction(text), "rejected_blacklist").when((words < params.min_words) | (words > params.max_words), "rejected_wordcount")


def stored_score(score: Column) -> Column:
    """Scores of 0 are kept as null."""
    return F.when(score > 0, score)


def retired_labels(text: Column, score: Column) -> Column:
    """Labels of a retired line, in order; `unclassified` if there is none."""
    t = strip(F.coalesce(text, F.lit("")))
    label = lambda k: F.when(hanging(t, L.RETIRED[k]) if k == "hanging_conditional" else matches(t, L.RETIRED[k]), k)
    names = list(L.RETIRED)
    first = F.array_compact(F.array(*[label(k) for k in names[:7]]))
    second = F.array_compact(F.concat(first, F.array(F.when(F.size(first) == 0, label("pronoun_dependent")), label("format_garbage"))))
    third = F.array_compact(F.concat(second, F.array(F.when((F.size(second) == 0) & (F.coalesce(score, F.lit(0.0)) < 0.35), "low_authenticity"))))
    return F.when(F.size(third) == 0, F.array(F.lit("unclassified"))).otherwise(third)
