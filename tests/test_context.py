from factloom.context import classify
from pyspark.sql import functions as F


def test_classification(spark):
    rows = spark.createDataFrame([("1", "do not touch"), ("2", "because of it"), ("3", "nothing"), ("4", None), ("5", "do not, because")], "fact_id string, body string")
    made = classify.candidates(rows, ["body"])
    assert '"body":null' in made.where("fact_id = '4'").first()["candidate"]
    backend = classify.KeywordBackend((("warning", ("do not",)), ("rationale", ("because",))))
    got = {r.fact_id: r.category for r in classify.classified(made, backend, ("warning", "rationale")).collect()}
    assert got == {"1": "warning", "2": "rationale", "3": "uncertain", "4": "uncertain", "5": "uncertain"}
    none = classify.classified(rows.select("fact_id", F.lit(None).cast("string").alias("candidate")), backend, ("warning",))
    assert {r.category for r in none.collect()} == {"uncertain"}


def test_decisions(spark):
    rows = [("1", "a", "yes"), ("1", "b", "yes"), ("2", "a", "yes"), ("2", "b", "unknown"), ("3", "a", "no"), ("3", "b", "no"), ("4", "a", "yes")]
    answers = spark.createDataFrame(rows, "fact_id string, criterion string, answer string")
    table = classify.Assessment(("a", "b"), (("both", (("a", "yes"), ("b", "yes"))),), "neither")
    assert {r.fact_id: r.category for r in table.decide(answers).collect()} == {"1": "both", "2": "uncertain", "3": "neither"}
