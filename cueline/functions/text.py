"""Text and time functions as columns: everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueline.functions import lexicon as L


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs; null text counts as empty."""
    return F.coalesce(F.regexp_like(c, F.lit(pattern)), F.lit(False))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for empty and null text."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def clock_seconds(c: Column) -> Column:
    """Seconds of H:M:S, M:S or S, with a comma or a point before the fraction; null if it is none of these."""
    t = F.split(F.replace(strip(c), F.lit(","), F.lit(".")), ":")
    part = lambda k: F.try_element_at(t, F.lit(k)).try_cast("double")
    return F.when(F.size(t) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(t) == 2, part(1) * 60 + part(2)).when(F.size(t) == 1, part(1))


def cue_ms(c: Column) -> Column:
    """Milliseconds of H:M:S.f or M:S.f, three digits of the fraction; 0 if it is neither."""
    clean = F.replace(strip(c), F.lit(","), F.lit("."))
    t = F.split(clean, ":")
    n = F.size(t)
    part = lambda k: F.try_element_at(t, k).try_cast("long")
    last = F.split(F.element_at(t, -1), r"\.", 2)
    whole = F.element_at(last, 1).try_cast("long")
    fraction = F.coalesce(F.try_element_at(last, F.lit(2)), F.lit(""))
    ms = F.when(fraction == "", F.lit(0)).otherwise(F.rpad(F.substring(fraction, 1, 3), 3, "0").try_cast("long"))
    hours = F.when(n == 3, part(F.lit(1))).otherwise(F.lit(0))
    minutes = F.when(n == 3, part(F.lit(2))).otherwise(part(F.lit(1)))
    return F.coalesce(F.when(n.isin(2, 3), hours * 3600000 + minutes * 60000 + whole * 1000 + ms), F.lit(0)).cast("long")


def ms_clock(c: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    unit = lambda divisor, modulus: F.floor(c / divisor) % modulus if modulus else F.floor(c / divisor)
    return F.format_string("%02d:%02d:%02d,%03d", unit(3600000, 0), unit(60000, 60), unit(1000, 60), c % 1000)


def han_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(L.HAN)), F.lit(0))


def latin_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit("[a-zA-Z]")), F.lit(0))


def is_chinese(c: Column) -> Column:
    """Han characters there, and more than a fifth of all that is no blank or at least as many as letters."""
    zh, en, total = han_count(c), latin_count(c), F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.coalesce((total > 0) & (zh > 0) & ((zh / F.greatest(total, F.lit(1)) > 0.2) | (zh >= en)), F.lit(False))


def is_english(c: Column) -> Column:
    return (latin_count(c) > 0) & (han_count(c) == 0)


def bilingual(lines: Column) -> Column:
    """Struct of en and zh from an array of lines: each goes to one side; mixed ones are cut at bars, and what then fits neither side goes."""
    parts = F.filter(F.transform(lines, strip), lambda x: x != "")
    labelled = F.flatten(
        F.transform(
            parts,
            lambda x: F.when(is_chinese(x), F.array(F.struct(F.lit("zh").alias("k"), x.alias("t"))))
            .when(is_english(x), F.array(F.struct(F.lit("en").alias("k"), x.alias("t"))))
            .when(
                F.regexp_like(x, F.lit("[|｜]")),
                F.filter(F.transform(F.split(x, "[|｜]"), lambda y: F.struct(F.when(is_chinese(strip(y)), "zh").when(is_english(strip(y)), "en").otherwise("").alias("k"), strip(y).alias("t"))), lambda y: y["k"] != ""),
            )
            .otherwise(F.array(F.struct(F.lit("en").alias("k"), x.alias("t")))),
        )
    )
    side = lambda k: F.trim(F.array_join(F.transform(F.filter(labelled, lambda y: y["k"] == k), lambda y: y["t"]), " "))
    return F.struct(side("en").alias("en"), side("zh").alias("zh"))


def for_duplicates(c: Column) -> Column:
    """Lower case, short forms written out, no punctuation, single blanks."""
    plain, short = [r for r in L.REWRITES if "'" not in r[0]], [r for r in L.REWRITES if "'" in r[0]]
    spell = lambda t, rewrites: reduce(lambda x, r: F.regexp_replace(x, rf"\b{r[0]}\b", r[1]), rewrites, t)
    lower = F.lower(c)  # most texts have nothing to write out, and one look tells
    spelled = F.when(F.regexp_like(lower, F.lit(L.any_of([r[0] for r in plain]))), spell(lower, plain)).otherwise(lower)
    spelled = F.when(F.contains(spelled, F.lit("'")), spell(spelled, short)).otherwise(spelled)
    return squeeze(F.regexp_replace(spelled, r"[^\pL\pN\pM_\s]", " "))


def for_stock_phrases(c: Column) -> Column:
    """Lower case without ASCII punctuation: short forms close up."""
    return squeeze(F.translate(F.lower(c), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ""))


def for_alignment(c: Column) -> Column:
    """As for duplicates, with notes and fillers left out; null is empty."""
    spoken = reduce(lambda t, p: F.regexp_replace(t, p, " "), L.NOTES, F.coalesce(c, F.lit("")))
    return squeeze(reduce(lambda t, p: F.regexp_replace(t, p, " "), L.FILLERS, for_duplicates(spoken)))


def for_diagnosis(c: Column) -> Column:
    """Lower case, apostrophes kept."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^\pL\pN_\s']", " "))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def length_ratio(a: Column, b: Column) -> Column:
    """Fewer words over more words; 0 if one has none."""
    x, y = word_count(a), word_count(b)
    return F.when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y, F.lit(1)))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table after the other."""
    xs, ys = F.split(a, ""), F.split(b, "")
    zero = F.transform(ys, lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        start = F.struct(F.lit(0).alias("diagonal"), F.lit(0).alias("left"), F.array().cast("array<int>").alias("out"))
        paired = F.arrays_zip(ys.alias("y"), before.alias("up"))

        def step(s: Column, p: Column) -> Column:
            here = F.when(p["y"] == x, s["diagonal"] + 1).otherwise(F.greatest(s["left"], p["up"]))
            return F.struct(p["up"].alias("diagonal"), here.alias("left"), F.concat(s["out"], F.array(here)).alias("out"))

        return F.aggregate(paired, start, step, lambda s: s["out"])

    return F.aggregate(xs, zero, row, lambda r: F.element_at(r, -1))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * common subsequence / both lengths; 1 for two empty texts."""
    n, m = F.length(a), F.length(b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(2.0 * common_subsequence(a, b) / F.greatest(n + m, F.lit(1)))


def node_code(show: Column, episode: Column, seconds: Column) -> Column:
    """SLUG-EPISODE-milliseconds."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.upper(show), "[^A-Z0-9]+", "-"), "^-+|-+$", ""), 1, 20)
    ep = F.substring(F.regexp_replace(F.upper(F.coalesce(episode, F.lit(""))), "[^A-Z0-9]", ""), 1, 8)
    return F.concat_ws("-", slug, F.when(ep != "", ep), F.format_string("%08d", F.bround(seconds * 1000).cast("long")))


def clip_code(show: Column, episode: Column, key: Column) -> Column:
    """CLP-sh-ep-six hex digits; the digits come from a key, so the same clip keeps its code."""
    two = lambda c, empty: F.substring(F.upper(F.when(F.coalesce(c, F.lit("")) == "", empty).otherwise(c)), 1, 2)
    return F.concat_ws("-", F.lit("CLP"), two(show, "XX"), two(episode, "00"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 6)))


def contains_text(c: Column, needle: Column) -> Column:
    """Contains without regard to ASCII case; needles are plain text, so % and _ stand for themselves."""
    lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.contains(lower(c), lower(needle)), F.lit(False))


def escape_like(c: Column) -> Column:
    """A text as LIKE pattern that matches only itself, with backslash as the escape."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def talk_slug(url: Column) -> Column:
    """The slug of a talk's address; null if it is not one."""
    return F.nullif(F.regexp_extract(F.parse_url(F.trim(url), F.lit("PATH")), "^/talks/([^/?#]+)", 1), F.lit(""))


def slug_title(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "[_-]", " "))


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\pL\pN_\-]", "_"), 1, 50)


def numbered_lines(output: Column, fallback: Column) -> Column:
    """Lines of a numbered answer without their numbers, cut or filled from fallback to its length."""
    lines = F.filter(F.transform(F.split(output, "\\R"), lambda x: F.regexp_replace(strip(x), r"^\d+[.、：:]\s*", "")), lambda x: x != "")
    n = F.size(fallback)
    filled = F.concat(lines, F.when(F.size(lines) < n, F.slice(fallback, F.size(lines) + 1, n)).otherwise(F.array().cast("array<string>")))
    return F.slice(filled, 1, F.greatest(n, F.lit(0)))


def overlaps(start: Column, end: Column, ranges: Column) -> Column:
    """Whether [start, end) meets one of an array of (s, e)."""
    return F.exists(ranges, lambda r: ~((end <= r["s"]) | (start >= r["e"])))
