from vigil.operators import dash as D


def test_the_items_of_a_brief_are_joined_once(spark):
    rows = [(f"e{k}", "phishing" if k % 3 else "", "finance", ["high", "low", None][k % 3], ["t1", "t2"][:k % 3], k % 4) for k in range(30)]
    items = spark.createDataFrame(rows, "event_id string, incident_type string, sector string, severity_label string, mitre_tactics array<string>, n_iocs long")
    other = spark.createDataFrame([(f"e{k}", k) for k in range(30)], "event_id string, x long")
    iocs = spark.createDataFrame([(f"e{k}", f"v{k % 7}") for k in range(40)], "source_event_id string, normalized_value string")
    camps = spark.createDataFrame([("c1",)], "campaign_id string")
    out = D.brief(items.join(other, "event_id"), camps, iocs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # with the indicators
    got = {r.title: r.detail for r in out.collect()}
    assert got["Indicators of Compromise"].startswith("Approximately 7 ") and "10 high, 0 medium, 10 low, and 10 informational" in got["Severity distribution"]
