"""What goes to a tagger or a translator in blocks of lines, and what comes back: blocks, attempts, parsing by position, fallbacks; and queries, asked once a text.

The service is a function that is given as an argument; it may fail, answer too little, or answer something else. A task that Spark runs again asks
again, so answers are stored once they are there.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import lexicon as L
from cueline.functions.ranking import rule_tags
from cueline.functions.text import numbered_lines, strip
from cueline.operators.vectors import encode
from cueline.workers import let_workers_import, stored

if TYPE_CHECKING:
    import pandas as pd

#: Takes the texts of a block and those before it; gives the answer as text.
Service = Callable[[list[str], list[str]], str]
#: Where a tagger may put its list, in the order in which it is looked for.
WRAPPERS = ("results", "data", "items", "tags")


def in_blocks(lines: DataFrame, keys: list[str], order: list[str], size: int, look_back: int = 0) -> DataFrame:
    """keys, block (from 0), lines: array of (place, line_id, text, word_count), before: the last `look_back` texts of the block before.

    lines: keys, order, line_id, text, word_count. Blocks overlap by lines that are sent to two of them, not by following the blocks in order. Null texts
    count as empty.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = lines.select(*keys, *[c for c in order if c not in keys], "line_id", F.coalesce("text", F.lit("")).alias("text"), F.col("word_count").cast("long").alias("word_count")).withColumn("place", place)
    home = F.floor(F.col("place") / size)
    last = F.col("place") % size >= size - look_back
    dealt = rows.withColumn("block", F.explode(F.when(last, F.array(home, home + 1)).otherwise(F.array(home)))).withColumn("own", F.col("block") == home)
    row = F.struct("place", "line_id", "text", "word_count")
    blocks = dealt.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.when(F.col("own"), row))).alias("lines"), F.array_sort(F.collect_list(F.when(~F.col("own"), row))).alias("halo"))
    # the lines that only look on to a block that does not exist make none
    return blocks.where(F.size("lines") > 0).select(*keys, "block", "lines", F.transform("halo", lambda h: h["text"]).alias("before"))


def answered(blocks: DataFrame, services: dict[str, Service], attempts: int = 4, pause: Callable[[int, Exception], float] | None = None) -> DataFrame:
    """Blocks with service (its name) and answer, null if all attempts failed. Blocks take the services in turn.

    pause: seconds to wait after a failed attempt (from 0); by default one, and after error 429 two to the power of the attempt. A task holds one
    batch of blocks.
    """
    let_workers_import(blocks.sparkSession)
    names = list(services)

    def wait(attempt: int, error: Exception) -> float:
        return 2**attempt if "429" in str(error) else 1

    def ask(name: str, texts: list[str], before: list[str]) -> str | None:
        for attempt in range(attempts):
            try:
                return services[name](texts, before)
            except Exception as e:  # whatever a service raises, its block falls back
                if attempt + 1 < attempts:
                    time.sleep((pause or wait)(attempt, e))
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["answer"] = [ask(s, list(t), list(b)) for s, t, b in zip(batch["service"], batch["texts"], batch["before"], strict=True)]
            yield batch.drop(columns=["texts"])

    turn = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.col("block"), F.lit(len(names))) + 1).cast("int"))
    asked = blocks.withColumn("service", turn).withColumn("texts", F.transform("lines", lambda x: x["text"]))
    out = asked.drop("texts").withColumn("answer", F.lit(None).cast("string")).schema
    return stored(asked.mapInPandas(run, out), "answers")


def tags_by_position(answer: Column) -> Column:
    """An array of variants, one for each line, from a tagger's answer: a list, or one inside an object; null if there is none."""
    as_list = lambda v, path="$": F.try_variant_get(v, path, "array<variant>")
    whole = F.try_parse_json(answer)
    fields = F.from_json(answer, "map<string,string>")
    first = F.try_parse_json(F.get(F.map_values(fields), 0))  # the first as it is written
    empty = F.when(F.size(fields) == 0, F.array().cast("array<variant>"))
    return F.coalesce(as_list(whole), *[as_list(whole, f"$.{w}") for w in WRAPPERS], F.when(whole.isNotNull(), F.coalesce(as_list(first), empty)))


def tag_of(item: Column, service: Column, words: Column) -> Column:
    """Tags of a line from its item: what is out of range becomes the default; an item that is no object gives rule tags."""
    text = lambda k: F.try_variant_get(item, f"$.{k}", "string")
    one_of = lambda k, values, default: F.when(text(k).isin(*values), text(k)).otherwise(default).alias(k)
    listed = F.coalesce(F.try_variant_get(item, "$.keywords", "array<string>"), F.array().cast("array<string>"))
    keywords = F.filter(F.slice(listed, 1, 5), lambda x: x.isNotNull() & (x != ""))
    made = F.struct(one_of("scene", L.SCENES, "daily"), one_of("emotion", L.EMOTIONS, "neutral"), one_of("difficulty", L.DIFFICULTIES, "intermediate"), keywords.alias("keywords"), one_of("speech_act", L.SPEECH_ACTS, "neutral_statement"), service.alias("tag_source"), F.lit(False).alias("needs_translation"))
    return F.when(F.try_variant_get(item, "$", "map<string,variant>").isNotNull(), made).otherwise(rule_tags(words))


def tag_lines(lines: DataFrame, keys: list[str], order: list[str], services: dict[str, Service], size: int = 10, attempts: int = 4, pause: Callable[[int, Exception], float] | None = None) -> DataFrame:
    """line_id and the tags of each line, by services that take `size` lines at a time.

    A list that is too short leaves its last lines with the defaults; an answer without a list, or none at all, leaves the block with rule tags. Without
    services all lines get these.
    """
    blocks = in_blocks(lines, keys, order, size)
    replies = answered(blocks, services, attempts, pause) if services else blocks.withColumns({"service": F.lit("rule"), "answer": F.lit(None).cast("string")})
    rows = replies.withColumn("items", tags_by_position(F.col("answer"))).select("service", "items", F.posexplode("lines").alias("at", "line"))
    item = F.coalesce(F.get("items", F.col("at")), F.when(F.col("at") >= F.size("items"), F.parse_json(F.lit("{}"))))
    return rows.withColumn("item", item).withColumn("t", tag_of(F.col("item"), F.col("service"), F.col("line.word_count"))).select("line.line_id", "t.*")


def service_counts(tagged: DataFrame) -> DataFrame:
    """How many lines each service has tagged, and how many the rule."""
    return tagged.groupBy("tag_source").agg(F.count(F.lit(1)).alias("n"))


def translate_lines(lines: DataFrame, keys: list[str], order: list[str], service: Service, size: int = 40, look_back: int = 3, attempts: int = 1, pause: Callable[[int, Exception], float] | None = None) -> DataFrame:
    """line_id and zh_text of each line, by a service that takes `size` lines and the `look_back` before them, and answers in numbered lines.

    Lines that an answer lacks, and all of a block without one, keep their own text.
    """
    replies = answered(in_blocks(lines, keys, order, size, look_back), {"translator": service}, attempts, pause)
    texts = F.transform("lines", lambda x: x["text"])
    said = replies.withColumn("said", numbered_lines(F.coalesce("answer", F.lit("")), texts))
    return said.select(F.posexplode("lines").alias("at", "line"), "said").select("line.line_id", F.get("said", F.col("at")).alias("zh_text"))


#: Takes a query; gives an answer, or None.
Ask = Callable[[str], str | None]
#: How many phrasings of a query count, and how long its description may be.
PHRASINGS, DESCRIPTION = 3, 120


def expand_queries(queries: DataFrame, translate: Ask | None = None, expand: Ask | None = None) -> DataFrame:
    """Queries with expanded_zh (what to look for in Chinese) and candidate_en (at most three English phrasings).

    translate: an English text; expand: JSON with these two fields. Each text is asked for once, however many queries have it. A description that is missing
    becomes the query itself, phrasings that are missing the translation, or none if there is none. A service that raises counts as one that has
    no answer; an answer that is no JSON object leaves the translation alone. Null text counts as empty. queries: text.
    """
    let_workers_import(queries.sparkSession)

    def ask(service: Ask | None, text: str) -> str | None:
        try:
            return None if service is None else service(text)
        except Exception:  # a query without an answer is searched as it is
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["translated"] = [ask(translate, x) for x in batch["text__"]]
            batch["said"] = [ask(expand, x) for x in batch["text__"]]
            yield batch

    text = F.coalesce("text", F.lit(""))
    replies = stored(queries.select(text.alias("text__")).distinct().mapInPandas(run, "text__ string, translated string, said string"), "replies")
    english = F.btrim(F.btrim(strip(F.col("translated")), F.lit('"')), F.lit("'"))
    fallback = F.when(english != "", F.array(english)).otherwise(F.array().cast("array<string>"))
    whole = F.try_parse_json("said")
    given = lambda path, kind: F.try_variant_get(whole, path, kind)
    wide = F.substring(strip(F.coalesce(F.nullif(given("$.expanded_zh", "string"), F.lit("")), F.col("text__"))), 1, DESCRIPTION)
    listed = F.filter(F.coalesce(given("$.candidate_en", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    phrasings = F.slice(F.transform(listed, strip), 1, PHRASINGS)
    said = given("$", "map<string,variant>").isNotNull()
    parsed = replies.select(
        "text__",
        F.when(said & (wide != ""), wide).otherwise(F.col("text__")).alias("expanded_zh"),
        F.when(said & (F.size(phrasings) > 0), phrasings).otherwise(fallback).alias("candidate_en"),
    )
    return queries.withColumn("text__", text).join(parsed, "text__").drop("text__")


def encode_queries(expanded: DataFrame, model, dim: int) -> DataFrame:
    """Expanded queries with embedding (of the description) and candidates (vectors of the phrasings, in order), as semantic_search takes them.

    expanded: query_id, each once, expanded_zh, candidate_en.
    """
    tried = encode(expanded.select("query_id", F.posexplode("candidate_en").alias("at", "phrasing")), model, dim, "phrasing")
    vectors = tried.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "embedding"))).alias("found__"))
    none = F.array().cast("array<array<float>>")
    return encode(expanded, model, dim, "expanded_zh").join(vectors, "query_id", "left").withColumn("candidates", F.coalesce(F.transform("found__", lambda x: x["embedding"]), none)).drop("found__")
