"""Targets by repeated resharing, seats by the highest quotient, and what documents give."""

import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cueline.llm.source_mixing import apportion, mix_sources, repeat_by_mix, source_targets


def targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 7, 100, 1000, 50_000]) for s in ["a", "B", "é", "\U0001f600", "￮", "src10", "src2", None]}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = targets(sizes)
    assert {s: round(r.target, 6) for s, r in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_seats(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for group in range(12):
        votes = {p: rng.choice([0, 0, 1, 3, 50, 10_000]) + rng.randrange(20) * (group % 2) for p in range(rng.randrange(1, 9))}
        seats = rng.choice([0, 1, 2, 7, 40, 500]) if any(votes.values()) else 0
        won = Counter()
        for _ in range(seats):
            won[max(votes, key=lambda p: (votes[p] / (2 * won[p] + 1), -won[p], -p))] += 1
        rows += [(group, p, float(v), seats) for p, v in votes.items()]
        want |= {(group, p): won[p] for p in votes}
    got = {(r.g, r.p): r.quota for r in apportion(spark.createDataFrame(rows, "g int, p int, v double, seats long"), ["g"], ["p"], "v", "seats").collect()}
    for g in range(12):
        assert sum(n for (x, _), n in got.items() if x == g) == sum(n for (x, _), n in want.items() if x == g)
    assert got == want


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(200)), rng.choice(["hot", "hot", "hot", "b", "c", "d", None]), "k") for i in range(600)]
    rows += [(700, None, "b", "k"), (701, "", None, "k"), (702, "x\x0by\x1cz \n", "tiny", "k"), (None, "a b c", "c", "k"), (5, rows[5][1], rows[5][2], "k"), (703, "w " * 50_000, "hot", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    for block, shard in ((512, 1 << 17), (1, 1 << 17), (20, 1000)):
        out = mix_sources(df, block=block, shard_words=shard)
        assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
        source = {r[0]: r[2] for r in rows}
        taken, size, target = defaultdict(int), defaultdict(int), {}
        for r in got:
            taken[source[r.doc_id]] += r.taken
            size[source[r.doc_id]] += r.size
            target[source[r.doc_id]] = r.target
        total = sum(size.values())
        assert {s: round(t, 5) for s, t in target.items()} == {s: round(t, 5) for s, t in targets(size).items()}
        slack = block * (2 + 3 * total / shard)
        assert all(abs(taken[s] - target[s]) <= slack for s in target)
        assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(5), block=block, shard_words=shard).collect()))
    assert mix_sources(df.limit(0)).count() == 0
    repeated = repeat_by_mix(df)
    assert repeated.columns == df.columns and max(Counter(r.doc_id for r in repeated.collect() if r.doc_id != 5).values()) <= 3
    assert mix_sources(df.withColumn("text", F.lit(""))).agg(F.sum("taken")).first()[0] == 0


def test_blocks_are_picked(spark):
    """Within a source, documents differ in what is taken of them: blocks are taken or not, and reruns with another seed take others."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randrange(50, 300)), "ab"[i % 4 != 0]) for i in range(800)], "doc_id long, text string, source string")
    got = {r.doc_id: r.taken / r.size for r in mix_sources(docs).collect() if r.doc_id % 4}
    whole = [x for x in got.values() if x in (0, 1, 2, 3)]
    assert len(whole) > 0.3 * len(got) and len(set(whole)) == 2
    other = {r.doc_id: r.taken / r.size for r in mix_sources(docs, seed=70).collect() if r.doc_id % 4}
    assert sum(got[k] != other[k] for k in got) > 0.3 * len(got)


def test_whole_documents(spark):
    """Per source the words of the repeated rows come near its target; names of columns are free, and rows without an id count."""
    rng = random.Random(9)
    rows = [(None if i % 9 == 0 else i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 300))), "abcd"[min(3, rng.randrange(9))], i, str(i), 1.5 * i) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, shard_key string, share double").repartition(5)
    out = repeat_by_mix(docs)
    assert out.columns == docs.columns
    words, size, times = Counter(), Counter(), Counter()
    known = {r[3]: r for r in rows}
    for r in out.collect():
        assert tuple(r) == known[r.copies]
        words[r.source] += len(r.text.split())
        times[r.copies] += 1
    for r in rows:
        size[r[2]] += len(r[1].split())
    assert max(times.values()) <= 3
    for s, t in targets(dict(size)).items():
        assert abs(words[s] - t) < 0.02 * t + 512, (s, words[s], t)
    assert sorted(map(str, out.collect())) == sorted(map(str, repeat_by_mix(docs.repartition(3)).collect()))


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_source_mixing", "op3_warc_round_trip"])
def test_queries_with_sql(spark, name):
    """The registered queries give the rows of their SQL."""
    from cueline.llm import registry

    folder = os.environ.get("CUELINE_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.exists(folder):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, folder).toArrow(), c.sql(registry.ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(str([f"{r[k]:.9g}" if isinstance(r[k], float) else r[k] for k in names]) for r in t.to_pylist())
    assert rows(got) == rows(want)
