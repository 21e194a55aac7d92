import json

from wayfold.sources import output


def test_formats(spark):
    hits = spark.createDataFrame([(1, 2, "B", 9.0, 47.0, 1.0), (1, 1, "A", 9.5, 47.1, 3.0), (2, 1, "C", 0.0, 0.0, 0.0)], "qid long, rank int, name string, lon double, lat double, score double")
    got = {r.qid: json.loads(r.body) for r in output.feature_collections(hits, ["name"]).collect()}
    assert [f["properties"] for f in got[1]["features"]] == [{"name": "A", "confidence": 0.75}, {"name": "B", "confidence": 0.5}]
    assert got[1]["features"][0]["geometry"] == {"type": "Point", "coordinates": [9.5, 47.1]}
    env = {r.qid: json.loads(r.body) for r in output.envelopes(hits, ["name", "score"]).collect()}
    assert env[1] == {"results": [{"name": "A", "score": 3.0}, {"name": "B", "score": 1.0}]}
    assert [json.loads(r.value)["name"] for r in output.ndjson(hits, ["name"]).collect()] == ["A", "B", "C"]
