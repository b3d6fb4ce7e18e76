"""Journal cards, facts and staged imports."""

from pyspark.sql import functions as F

from paperloom.operators import memory
from paperloom.plans import journals
from paperloom.sources import staged


def test_cards_probe_again_with_what_a_profile_brings(spark):
    asked = spark.createDataFrame([(1, "1234-5678", None, None), (2, None, "old name", None), (3, None, "Fake", None), (4, None, None, None)], "id int, issn string, name string, url string")
    metrics = spark.createDataFrame([("A Journal", "12345678", None, 3.5, "q1"), ("New Name", None, "99999999", 1.0, "N/A")], "journal_name string, issn string, eissn string, jif double, jif_quartile string")
    parts = spark.createDataFrame([("New Name", "99999999", None, 2)], "journal_name string, issn string, eissn string, major_quartile int")
    profiles = spark.createDataFrame([("Old Name", "9999-9999", None)], "journal_name string, issn string, eissn string")
    lists = spark.createDataFrame([("FAKE", None, None)], "name string, url string, abbr string")
    none = spark.createDataFrame([], "name string, url string")
    got = {r.id: tuple(r)[1:] for r in journals.cards(asked, metrics, parts, profiles, lists, none, none).collect()}
    assert got == {1: ("A Journal", 3.5, "Q1", None, None), 2: ("New Name", 1.0, None, 2, None), 3: ("Fake", None, None, None, "exact"), 4: (None, None, None, None, None)}


def test_facts_expire(spark):
    facts = spark.sql("select 1 id, 'likes graphs' content, timestamp'2024-01-01' updated_at, timestamp'2024-02-01' expires_at union all select 2, 'graphs and trees', timestamp'2024-01-02', null")
    at = F.lit("2024-03-01").cast("timestamp")
    assert [r.id for r in memory.recall(facts, at, ["graphs", "trees"]).collect()] == [2]
    new = facts.filter("id = 2").withColumn("content", F.lit("other"))
    assert memory.recall(memory.remember(facts, new), at, ["graphs"]).count() == 0
    assert memory.forget(facts, facts.filter("id = 1")).count() == 1


def test_staged_import_isolates_failures(spark, tmp_path):
    good = spark.createDataFrame([(2024, "a")], "year int, v string")

    def broken():
        raise OSError("unreachable")

    stages = [staged.Stage("a", lambda: good, f"{tmp_path}/a", 2024), staged.Stage("b", broken, f"{tmp_path}/b"), staged.Stage("c", lambda: good.filter("false"), f"{tmp_path}/c")]
    first = {r.name: (r.state, r.rows, r.error) for r in staged.run(spark, stages).collect()}
    assert first == {"a": ("imported", 1, None), "b": ("failed", None, "unreachable"), "c": ("failed", None, "the source is empty")}
    assert {r.name: r.state for r in staged.run(spark, stages).collect()} == {"a": "held", "b": "failed", "c": "failed"}
