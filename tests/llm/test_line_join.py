import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.llm import line_join
from offerloom.llm.arrow import stored
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    """Every line with a word, against every earlier one."""
    lines = []
    for i, text, *_ in rows:
        if i is not None and text is not None:
            lines += [((i, k), frozenset(WORD.findall(line))) for k, line in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[1]]
    gone = set()
    for place, own in lines:
        if any(p < place and 100 * len(own & s) >= 80 * len(own | s) for p, s in lines):
            gone.add(place)
    return gone


def table_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é😀"]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    rows = [r for r in ODD if r[0] != 5] + [(5, "日本語 テスト  😀 don't  we'll go")]
    for k in range(80):
        own = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                rng.shuffle(words)
            own.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((rng.randrange(10**6) + 100, "\n".join(own)))
    rows += [(10**7 + k, "the same line again and again\n" * 3) for k in range(40)]
    # Short lines: equal sets, and four words inside five.
    rows += [(50, "read more\nx\n\n \nby a b"), (51, "more  read\nX\nx"), (52, "a by b by\na b c d a b"), (53, "d c\tb a\nd c b\na b c d e")]
    return rows


def test_removed_lines(docs):
    rows = table_rows(1)
    want = brute(rows)
    assert {(51, 0), (52, 0), (53, 0), (53, 2)} <= want and not {(50, 2), (51, 1), (53, 1)} & want
    got = line_join.removed_lines(docs(rows).repartition(3)).collect()
    assert {(r.doc_id, r.line_no) for r in got} == want
    assert len(got) == len(set(got))


def test_long_lines(docs):
    """Lines of more than 64 words, which are told apart by 256 bits, at similarities about 0.8."""
    rng = random.Random(4)
    rows = []
    for k in range(60):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.choice([50, 66, 90, 150, 300]))]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            other = [f"v{rng.randrange(400)}" if rng.random() < 0.06 * c else w for w in words]
            rows.append((10 * k + c, " ".join(other[: len(other) - rng.randrange(8)])))
    want = brute(rows)
    assert 40 < len(want) < 170
    got = line_join.removed_lines(docs(rows).repartition(3)).collect()
    assert {(r.doc_id, r.line_no) for r in got} == want
    lines = line_join.lines_of(docs(rows), "doc_id", "text")
    sets = stored(line_join.line_sets(lines, line_join.word_ranks(lines)).withColumn("asks", F.lit(True)), "sets")
    assert line_join.asked_pairs(sets).count() < 400


def test_texts_without_the_lines(spark, docs):
    rows = table_rows(3)
    gone = brute(rows)
    table = docs(rows)
    got = line_join.dedup_lines(table)
    assert got.columns == table.columns
    want = []
    for i, text, *_ in rows:
        if text is not None and any(p[0] == i for p in gone):
            text = "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in gone)
        want.append((i, text))
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted(want, key=str)
    assert line_join.dedup_lines(docs([])).count() == 0
    stage = corpus_pipeline.lines(spark, docs([(1, "read more\nx"), (2, "x\ny\nmore read")]), "").collect()
    assert sorted((r.doc_id, r.text) for r in stage) == [(1, "read more\nx"), (2, "y")]


def test_columns_of_any_name(spark):
    names = ["l_gone", "l_doc", "l_places", "row", "id", "lines", "gone", "gone_id", "places", "left", "h1", "line"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in names)])
    rows = [(1, "one two three\nkeep", *names), (2, "three two one\nmore of it", *names)]
    got = line_join.dedup_lines(spark.createDataFrame(rows, schema))
    assert got.schema.names == schema.names
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], (2, "more of it", *names)]


def test_no_python_in_the_plan(docs):
    plan = line_join.dedup_lines(docs(ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def dense(n):
    """Lines that share 20 of 22 words, so that all of them match."""
    shared = " ".join(f"s{k}" for k in range(20))
    return [(k, f"a{k} b{k} {shared}") for k in range(n)]


def test_a_dense_group_is_not_listed_pair_by_pair(docs):
    rows = dense(1000)
    lines = line_join.lines_of(docs(rows), "doc_id", "text")
    sets = line_join.line_sets(lines, line_join.word_ranks(lines)).cache()
    pairs = line_join.leader_pairs(sets).cache()
    assert pairs.count() < 20_000
    first = line_join.matched(pairs, lines)
    asking = sets.join(first.withColumn("asks", F.lit(False)), ["doc_id", "line_no"], "left").na.fill(True, ["asks"])
    assert line_join.asked_pairs(asking).count() + pairs.count() < 20_000
    got = line_join.removed_lines(docs(rows)).collect()
    assert {r.doc_id for r in got} == set(range(1, 1000))


def test_both_sides_of_the_join_are_one_exchange(spark, docs):
    lines = line_join.lines_of(docs(dense(50)), "doc_id", "text")
    sets = stored(line_join.line_sets(lines, [0] * (1 << 16)).withColumn("asks", F.col("doc_id") > 3), "sets")
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = line_join.asked_pairs(sets)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "SortMergeJoin" in plan and "ReusedExchange" in plan


def test_pairs_are_tested_in_compiled_code(spark, docs):
    """Both tests of pairs are inside generated code, in methods that the JVM compiles (up to 8,000 bytes)."""
    lines = line_join.lines_of(docs(dense(50)), "doc_id", "text")
    sets = stored(line_join.line_sets(lines, [0] * (1 << 16)).withColumn("asks", F.lit(True)), "sets")
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for pairs, node in ((line_join.leader_pairs(sets), "Generate explode"), (line_join.asked_pairs(sets), "SortMergeJoin")):
            plan = pairs._jdf.queryExecution().executedPlan()
            assert re.search(rf"\*\(\d+\) {node}", plan.toString())
            code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
            assert all(int(size) < 8000 for size in re.findall(r"maxMethodCodeSize:(\d+)", code))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_asking_lines_are_not_stored_again(spark, docs, monkeypatch):
    """The sets are written once; what asks goes from them to the join, whose sides are one exchange."""
    names = []
    monkeypatch.setattr(line_join, "stored", lambda df, name: names.append(name) or stored(df, name))
    rows = dense(30) + [(100, "read more\nx"), (101, "x\ny")]
    got = line_join.removed_lines(docs(rows)).collect()
    assert {(r.doc_id, r.line_no) for r in got} == brute(rows)
    assert [name for name in names if "asking" in name] == [] and names.count("line-sets") == 1


def test_copies_are_one_before_they_are_shuffled(docs):
    """Each line with 200 copies in every one of 4 tasks leaves at most one row a task, below the exchange."""
    lines = line_join.lines_of(docs([(k, "this line is found everywhere") for k in range(800)]).repartition(4), "doc_id", "text")
    plan = line_join.line_sets(lines, [0] * (1 << 16))._jdf.queryExecution().executedPlan().toString()
    exchange = re.search(r"Exchange hashpartitioning\(h1", plan).start()
    assert "partial_min(place" in plan[exchange:] and "partial_count(1)" in plan[exchange:]


def test_a_pair_is_listed_only_where_its_first_shared_word_leaves_enough(spark):
    schema = "doc_id long, line_no int, n int, bits long, wide array<long>, asks boolean, prefix array<int>"
    rows = [
        (1, 0, 20, 0, None, True, [1, 2, 3, 4, 9]), (2, 0, 20, 0, None, True, [5, 6, 7, 8, 9]),  # 16 words left, 18 are needed
        (3, 0, 20, 0, None, True, [21, 22, 30, 31, 32]), (4, 0, 20, 0, None, True, [23, 24, 30, 31, 32]),  # 18 left
    ]
    pairs = line_join.asked_pairs(spark.createDataFrame(rows, schema)).collect()
    assert [(row["later"]["doc_id"], row["earlier"]["doc_id"]) for row in pairs] == [(4, 3)]
