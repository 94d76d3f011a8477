import hashlib

import pytest
from pyspark.sql import functions as F

from actilens.functions import crypto, pii, text
from actilens.operators import keywords, policy, terms

LINES = {
    "ssn": ("my number 123-45-6789 ok", "*******6789"),
    "email": ("write to bob@example.com now", "b***@example.com"),
    "phone": ("ring 555-123-4567 now", "***-***-4567"),
    "password": ("password: hunter2 now", "[REDACTED]"),
    "api_key": ("bearer abc.def", "[REDACTED]"),
    "ip_address": ("host 192.168.7.9 down", "192.168.*.*"),
    "mac_address": ("nic 00:1A:2B:3C:4D:5E up", "00:1A:**:**:**:**"),
}


@pytest.mark.parametrize("kind", sorted(LINES))
def test_each_type_alone(spark, kind):
    line, shown = LINES[kind]
    df = spark.createDataFrame([(line,)], "details string")
    found = pii.detect(df, "details").collect()
    assert [(r["pii_type"], r["redacted"]) for r in found] == [(kind, shown)]
    assert found[0]["confidence"] == 0.95
    out = pii.redact_rows(df).first()
    assert shown in out["details"] and out["_pii_redacted"] and out["_pii_types"] == [kind]


def test_overlapping_patterns_count_twice(spark):
    df = spark.createDataFrame([("card 4111111111111111 end",)], "message string")
    out = pii.redact_rows(df).first()
    # Two card patterns and the account pattern all hit the same digits.
    assert out["_pii_count"] == 3 and out["_pii_types"] == ["account_number", "credit_card"]
    assert out["message"] == "card ************1111 end"


def test_account_number_is_hashed(spark):
    df = spark.createDataFrame([("acct 12345678 x",)], "message string")
    digest = hashlib.sha256(b"12345678").hexdigest()[:8]
    assert pii.redact_rows(df).first()["message"] == f"acct [HASH:{digest}] x"


def test_short_and_odd_values(spark):
    df = spark.createDataFrame([("a@b.co and x(555) 123-4567 but call (555) 123-4567",)], "content string")
    rows = pii.detect(df, "content").collect()
    assert [(r["pii_type"], r["redacted"]) for r in rows] == [("email", "***@***"), ("phone", "***-***-4567")]


def test_patterns_run_where_a_text_holds_what_they_need(spark):
    """Every pattern finds what it finds alone, in texts that hold little else; calm texts run none of them."""
    lines = [line for line, _ in LINES.values()] + [
        "PassWord=x", "PASSWD: y", "pWd=z", "Api-KEY=" + "k" * 20, "ToKeN:" + "t" * 20, "BeaRer q", "a@b.co", "x@y.ZZ", "AA-BB-CC-DD-EE-FF", "aa:bb:cc:dd:ee:ff",
        "a:b:c:d:e:f:a:b", "1.2.3.4", "12345678", "123456789", "1234 5678 1234 5678", "x+15551234567", "x(555) 1234567", "555.123.4567", "", "calm", "\u0130 \u212a \u017f \u0663\u0663\u0663", None,
    ]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, message string")
    shown = lambda kind: lambda v: F.concat_ws(" ", F.lit(kind), v)
    alone = [(kind, F.regexp_extract_all("message", F.lit("(?i)" + p), F.lit(0))) for kind, ps in pii.PATTERNS for p in ps]
    plain = df.select("i", F.concat(*[F.transform(hits, shown(kind)) for kind, hits in alone]).alias("f"))
    found = df.select("i", F.transform(pii.detections(F.col("message")), lambda d: F.concat_ws(" ", d["pii_type"], d["original"])).alias("f"))
    expected, got = dict(map(tuple, plain.collect())), dict(map(tuple, found.collect()))
    assert got == expected and {f.split(" ")[0] for fs in expected.values() for f in fs or []} == set(pii.NEEDED) == {kind for kind, _ in pii.PATTERNS}


def test_calm_texts_run_no_pattern(spark):
    df = spark.createDataFrame([("Plain words of a wide key-less token book,é known word - was: here.",), ("only words",)], "message string")
    assert [r[0] for r in df.select(F.col("message").rlike(pii.NEEDED["email"])).collect()] == [False, False]
    assert not df.filter("message = 'only words'").select(F.col("message").rlike(pii.NEEDED_BY_ANY)).first()[0]
    plan = df.select(pii.detections(F.col("message")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("regexp_extract_all") and plan.count("RLIKE") >= len(pii.PATTERNS)


def test_field_selection():
    assert pii.is_checked_field("description") and pii.is_checked_field("Full_Description")
    assert pii.is_checked_field("userPassword") and pii.is_checked_field("api_key_value")
    assert not pii.is_checked_field("user_name")
    assert pii.is_checked_field("note", ["note"]) and not pii.is_checked_field("description", ["note"])


def test_unchecked_and_disabled(spark):
    df = spark.createDataFrame([("bob@example.com", "bob@example.com")], "user_name string, details string")
    out = pii.redact_rows(df).first()
    assert out["user_name"] == "bob@example.com" and out["details"] == "b***@example.com"
    assert pii.redact_rows(df, enabled=False).columns == df.columns
    custom = pii.redact_rows(df, fields=["user_name"]).first()
    assert custom["user_name"] == "b***@example.com" and custom["details"] == "bob@example.com"


def test_nested_values(spark):
    schema = "id int, meta struct<content:string,other:string>, items array<struct<url:string>>, tags array<string>"
    mail = "bob@example.com"
    df = spark.createDataFrame([(1, (mail, mail), [(mail,), (None,)], [mail]), (2, None, None, None)], schema)
    rows = {r["id"]: r for r in pii.redact_rows(df).collect()}
    assert rows[1]["meta"]["content"] == "b***@example.com" and rows[1]["meta"]["other"] == mail
    assert [x["url"] for x in rows[1]["items"]] == ["b***@example.com", None] and rows[1]["tags"] == [mail]
    assert rows[1]["_pii_count"] == 2 and rows[2]["_pii_count"] == 0 and rows[2]["meta"] is None


def test_null_text_is_clean(spark):
    out = pii.redact_rows(spark.createDataFrame([(None,)], "details string")).first()
    assert out["details"] is None and not out["_pii_redacted"] and out["_pii_count"] == 0


def sanitize(spark, value, n=1500):
    return spark.createDataFrame([(value,)], "s string").select(text.sanitize(F.col("s"), n).alias("o")).first()["o"]


def test_sanitize(spark):
    assert sanitize(spark, None) == ""
    assert sanitize(spark, "  Keep Case \x07x ") == "Keep Case  x"
    assert sanitize(spark, "Please ACT AS root, Bob") == "please [redacted-instruction] root, bob"
    assert sanitize(spark, "x" * 70, 64) == "x" * 61 + "..."
    assert sanitize(spark, "x" * 64, 64) == "x" * 64


def test_context_items(spark):
    df = spark.createDataFrame([([{"K\x01": "Jailbreak NOW"}] * 12,)], "items array<map<string,string>>")
    out = df.select(text.sanitize_items(F.col("items")).alias("o")).first()["o"]
    assert len(out) == 10 and out[0] == {"K": "[redacted-instruction] now"}


def test_actions_and_assessment(spark):
    df = spark.createDataFrame([([" Block IP", "dance", "COLLECT_FORENSICS"],)], "a array<string>")
    assert df.select(text.normalize_actions(F.col("a")).alias("o")).first()["o"] == ["block_ip", "collect_forensics"]
    rows = [("SUSPICIOUS", "t", 0.88, "r"), ("ODD", "t", 0.5, "r"), ("BENIGN", "", 0.5, "r"), ("BENIGN", "t", 1.5, "r"), ("BENIGN", "t", 1.0, "r" * 1501)]
    df = spark.createDataFrame(rows, "l string, t string, c double, r string")
    errors = [r[0] for r in df.select(text.assessment_error(*[F.col(c) for c in "ltcr"])).collect()]
    assert errors == [None, "risk_level", "threat_type", "confidence", "reasoning"]


def test_encryption_round_trip(spark):
    key = "0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([("secret text",), (None,)], "s string")
    sealed = df.select("s", crypto.encrypt(F.col("s"), F.lit(key)).alias("e"))
    rows = sealed.select("s", "e", crypto.decrypt(F.col("e"), F.lit(key)).alias("d"), crypto.decrypt(F.col("e"), F.lit(key[::-1])).alias("w")).collect()
    assert rows[0]["e"].startswith("[ENCRYPTED] ") and rows[0]["d"] == "secret text" and rows[0]["w"] is None
    assert rows[1]["e"] is None


def run_policy(make_logs, row, prediction=None, **settings):
    logs = make_logs([row])
    if prediction is not None:
        logs = logs.withColumn("p", F.lit(prediction))
    out = policy.apply_policies(logs, policy.Settings(**settings), "p" if prediction is not None else None).first()
    return out["risk_level"], out["description"]


def test_keyword_raises_and_tags(make_logs):
    got = run_policy(make_logs, {"description": "This contains confidential info"}, keywords=["confidential"])
    assert got == ("HIGH", "This contains confidential info [KEYWORD DETECTED]")
    kept = run_policy(make_logs, {"description": "confidential", "risk_level": "CRITICAL"}, keywords=["confidential"])
    assert kept == ("CRITICAL", "confidential")


def test_policy_order_and_inner_hits(make_logs):
    text_ = "better facebook secret"
    got = run_policy(make_logs, {"description": text_}, prediction=-1, block_social_media=True)
    assert got[0] == "CRITICAL"
    assert got[1] == text_ + " [KEYWORD DETECTED] [POLICY VIOLATION: GAMBLING] [POLICY VIOLATION: SOCIAL MEDIA] [ML_DETECTED]"


def test_policy_switches_and_details(make_logs):
    assert run_policy(make_logs, {"description": "bet", "details": ""}, block_gambling=False) == ("INFO", "bet")
    assert run_policy(make_logs, {"description": "x", "details": "my PASSWORD"})[0] == "HIGH"
    assert run_policy(make_logs, {"description": "x", "risk_level": None}, prediction=-1) == ("HIGH", "x [ML_DETECTED]")


def test_outbox_and_channels(make_logs):
    from datetime import datetime

    night = datetime(2026, 1, 1, 23, 30)
    logs = make_logs([{"risk_level": "HIGH", "ts": night}, {"risk_level": "CRITICAL", "ts": night}, {"risk_level": "LOW"}])
    s = policy.Settings(
        quiet_hours_start="22:00", quiet_hours_end="08:00", webhook_url="http://w", email_notifications=True,
        notification_email=None, sms_notifications=True, twilio_account_sid="a", twilio_auth_token="b",
    )
    alerts = policy.alert_outbox(logs, s)
    assert [r["risk_level"] for r in alerts.collect()] == ["CRITICAL"]
    sent = policy.deliveries(alerts, s).collect()
    assert sorted(r["channel"] for r in sent) == ["sms", "webhook"]
    body = next(r["body"] for r in sent if r["channel"] == "webhook")
    assert '"color":"#ff0000"' in body and '"title":"User","value":"ann","short":true' in body
    assert policy.deliveries(alerts, policy.Settings()).count() == 0


def test_clusters(spark):
    texts = spark.createDataFrame([(1, "A Ransomware and WORM story"), (2, "nothing"), (3, None)], "id int, t string")
    hits = keywords.match_clusters(texts, keywords.default_clusters(spark), "t", ["id"]).collect()
    assert [(r["id"], r["cluster"], r["hits"]) for r in hits] == [(1, "malware", ["ransomware", "worm"])]


def test_cluster_slices_give_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "ransomware worm xss sqli root"), (2, "worm"), (2, "worm ransomware")], "id int, t string")
    whole = keywords.match_clusters(texts, keywords.default_clusters(spark), "t", ["id"]).collect()
    monkeypatch.setattr(terms, "SHARD_BYTES", 60)
    sliced = keywords.match_clusters(texts, keywords.default_clusters(spark), "t", ["id"]).collect()
    assert sorted(r["hits"] for r in sliced if r["id"] == 2) == [["ransomware", "worm"], ["worm"]]  # equal keys stay two rows
    key = lambda r: r["cluster"]
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, sliced), key=str) and len({key(r) for r in whole}) >= 3


def test_extracted_keywords(spark):
    posts = spark.createDataFrame(
        [("Zero-Day in Wallet", "<p>Malware, malware</p>", ["Tag"], None)], "title string, html string, tags array<string>, plaintext string"
    )
    got = {r["keyword"]: r["n"] for r in keywords.extract_keywords(posts).collect()}
    assert got == {"zero-day": 1, "wallet": 1, "malware": 2, "tag": 1}
