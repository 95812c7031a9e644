from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lacewing.llm import mixing


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 300) == [50, 100, 150]
    # the third is capped at 3 * 10; the other 180 are shared 1 : 2
    assert mixing.targets([100, 100, 10], [1, 2, 3], 210) == pytest.approx([60, 120, 30])
    assert mixing.targets([0, 50], [1, 2], 50) == [0, 50]
    assert sum(mixing.targets([5, 7, 11, 13], [1, 2, 3, 1], 36)) == pytest.approx(36)


def test_mix_meets_targets_and_reruns_agree(spark, messy):
    taken, known = mixing.mix(messy, documents_per_slice=7)
    rows = taken.select("doc_id", "source", "size", "epoch", "finish", "position").collect()
    again, _ = mixing.mix(messy.repartition(3), documents_per_slice=11)
    key = lambda r: (r.position, r.epoch, str(r.source), str(r.doc_id))
    assert sorted(map(key, rows)) == sorted(map(key, again.select(*taken.columns).collect()))
    goal = {r.source: r.target for r in known.select("source", "target").distinct().collect()}
    got, largest = defaultdict(int), known.agg(F.max("size")).first()[0]
    for r in rows:
        got[r.source] += r.size
    total = known.agg(F.sum("size")).first()[0]
    assert sum(got.values()) <= total
    for s, g in goal.items():
        assert abs(got[s] - g) <= 2 * largest
    ordered = sorted((r for r in rows if r.size), key=lambda r: r.position)
    assert [r.finish for r in ordered] == sorted(r.finish for r in ordered)
    assert [r.position for r in ordered] == [sum(x.size for x in ordered[:i]) for i in range(len(ordered))]
    counts = defaultdict(list)
    for r in rows:
        counts[r.doc_id, r.source, r.size].append(r.epoch)
    copies = {(r.doc_id, r.source, r.size): r["count"] for r in known.groupBy("doc_id", "source", "size").count().collect()}
    assert all(set(e) <= {0, 1, 2} and max(map(e.count, e)) <= copies[k] for k, e in counts.items())


def test_wordless_sources_come_first_and_are_put_in_no_order(spark):
    """Half of all rows have no words, repeated ids and null ids among them."""
    rows = [(None if i % 3 == 0 else i % 50, [None, "", " \t"][i % 3], ["w", None][i % 2]) for i in range(300)]
    rows += [(i, "x " * (i % 7 + 1), ["a", "b"][i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, known = mixing.mix(docs, documents_per_slice=10)
    got = taken.select("source", "size", "position", "epoch").collect()
    wordless = [r for r in got if r.source in ("w", None)]
    assert len(wordless) == 900 and all(r.position == r.size == 0 for r in wordless)
    assert known.where("source_size = 0").select("target").distinct().collect()[0][0] == 0
    others = sorted(r.position for r in got if r.source in ("a", "b"))
    assert others[0] == 0 and len(set(others)) == len(others)


def test_weights_by_code_point_null_last(spark):
    rows = [(1, "b b", "b"), (2, "a", None), (3, "a a a", "B"), (4, None, "é"), (5, "x y", "b")]
    sized = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.n_words(F.col("text")))
    assert [r[:3] for r in mixing.source_totals(sized)] == [("B", 3, 1), ("b", 4, 2), ("é", 0, 1), (None, 1, 1)]


def test_empty_table(nothing):
    taken, known = mixing.mix(nothing)
    assert taken.count() == 0 and known.count() == 0


@pytest.mark.parametrize("copies", [1, 3, 7])
def test_stage_takes_copies_as_often_as_the_mix(spark, tmp_path, copies):
    from collections import Counter

    from lacewing.llm import pipeline_stages as stages

    rows = [(i // copies, f"text {i // copies} " * (i // copies % 5 + 1), None, ["a", "b", None][i // copies % 3], i) for i in range(40 * copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken, _ = mixing.mix(docs, weights=stages.powers, most_epochs=3)
    want = Counter(r.doc_id for r in taken.select("doc_id").collect())
    out = stages.mix_sources(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == want
    most, least = defaultdict(int), defaultdict(int)
    for k, n in Counter((r.doc_id, r.n_chars) for r in out).items():
        most[k[0]] = max(most[k[0]], n)
        least[k[0]] += 1
    assert all(most[i] <= -(-want[i] // copies) for i in want)
