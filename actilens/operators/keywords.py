"""Keyword clusters: matching, inventory, updates and extraction from posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actilens.operators.terms import with_terms

# Default clusters and extraction patterns.
DEFAULT_CLUSTERS = {
    "malware": [
        "ransomware", "malware", "spyware", "trojan", "worm", "virus", "backdoor", "rootkit", "keylogger",
        "stealer", "adware", "cryptominer",
    ],
    "phishing": [
        "phishing", "spear phishing", "whaling", "vishing", "smishing", "email spoofing", "domain spoofing",
        "credential harvesting",
    ],
    "web_attacks": [
        "sql injection", "sqli", "xss", "cross-site scripting", "csrf", "ssrf", "path traversal", "lfi", "rfi",
        "deserialization",
    ],
    "network_attacks": [
        "ddos", "dos", "syn flood", "ping of death", "mitm", "arp spoofing", "dns poisoning", "port scanning",
        "reconnaissance",
    ],
    "privilege_escalation": [
        "privilege escalation", "vertical escalation", "horizontal escalation", "root", "sudo", "passwd", "shadow",
        "etc/passwd",
    ],
    "data_exfiltration": [
        "data exfiltration", "data breach", "data leak", "upload", "download", "file transfer", "external ip", "c2",
        "command and control",
    ],
    "insider_threat": [
        "insider", "malicious insider", "privilege abuse", "data theft", "sabotage", "fraud", "unauthorized access",
    ],
    "emerging_threats": [
        "ai attack", "deepfake", "prompt injection", "llm jailbreak", "supply chain", "log4shell", "spring4shell",
        "zero-day",
    ],
}
TERM_PATTERNS = [
    r"\b(phishing|malware|ransomware|spyware|trojan|worm|virus)\b",
    r"\b(breach|leak|exploit|vulnerability|CVE|zero-day)\b",
    r"\b(injection|SQLi|XSS|csrf|ssrf|buffer overflow)\b",
    r"\b(ddos|botnet|ddos|amplification)\b",
    r"\b(cryptocurrency|crypto|wallet|mining|monero)\b",
    r"\b(credential|password|token|authentication|authorization)\b",
    r"\b(backdoor|rootkit|keylogger|stealer)\b",
    r"\b(mitigation|prevention|detection|response)\b",
    r"\b(security|cyber|threat|attack|defense)\b",
    r"\b(apt|advanced persistent threat|insider)\b",
]
COMBINED_PATTERN = "(?i)" + "|".join(TERM_PATTERNS)


def default_clusters(spark) -> DataFrame:
    rows = [(name, word, "manual") for name, words in DEFAULT_CLUSTERS.items() for word in words]
    return spark.createDataFrame(rows, "cluster string, keyword string, source string")


def match_clusters(texts: DataFrame, clusters: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """(row, cluster, sorted hits) for clusters with at least one keyword inside the text.

    A text goes past an automaton of all keywords once (``terms``), whatever their number; rows keep apart, so equal ``keep`` values
    stay two rows.
    """
    entries = clusters.select(F.col("cluster").alias("label"), F.lower("keyword").alias("term"))
    lowered = texts.select(*keep, F.lower(F.coalesce(column, F.lit(""))).alias("_text"))
    found = F.transform("_hits", lambda e: F.struct(e["label"].alias("cluster"), e["term"].alias("keyword")))
    marked = with_terms(lowered, "_text", entries, "_hits").select(*keep, found.alias("_hits"))
    names = F.array_distinct(F.transform("_hits", lambda e: e["cluster"]))
    mine = lambda name: F.transform(F.filter("_hits", lambda e: e["cluster"].eqNullSafe(name)), lambda e: e["keyword"])
    grouped = F.transform(names, lambda name: F.struct(name.alias("cluster"), F.array_sort(mine(name)).alias("hits")))
    return marked.select(*keep, F.explode(grouped).alias("m")).select(*keep, "m.cluster", "m.hits")


def inventory(clusters: DataFrame) -> DataFrame:
    """Sorted keyword list, size and source per cluster."""
    return clusters.groupBy("cluster").agg(
        F.array_sort(F.collect_set("keyword")).alias("keywords"),
        F.count_distinct("keyword").alias("n"),
        F.max("source").alias("source"),
    )


def all_keywords(clusters: DataFrame) -> DataFrame:
    return clusters.select("keyword").distinct()


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(COMBINED_PATTERN), F.lit(0))


def extract_keywords(posts: DataFrame) -> DataFrame:
    """Security terms in titles and bodies plus tag names, lower-cased and counted.

    ``posts`` may have ``title``, ``html``, ``plaintext`` and ``tags`` (array of strings).
    """
    has = set(posts.columns)
    body = F.concat(
        F.coalesce("html", F.lit("")) if "html" in has else F.lit(""),
        F.lit(" "),
        F.coalesce("plaintext", F.lit("")) if "plaintext" in has else F.lit(""),
    )
    found = [_terms(body)]
    if "title" in has:
        found.insert(0, F.coalesce(_terms(F.col("title")), F.array().cast("array<string>")))
    if "tags" in has:
        found.append(F.coalesce("tags", F.array().cast("array<string>")))
    return (
        posts.select(F.explode(F.concat(*found)).alias("keyword"))
        .groupBy(F.lower("keyword").alias("keyword"))
        .agg(F.count("*").alias("n"))
    )


def merge_extracted(clusters: DataFrame, keywords: DataFrame, cluster: str = "emerging_threats", source: str = "ghost") -> DataFrame:
    """Set union of new keywords into one cluster, whose source changes with it."""
    target = F.col("cluster") == cluster
    others = clusters.filter(~target)
    merged = clusters.filter(target).select("keyword").union(keywords.select("keyword")).distinct()
    return others.unionByName(merged.select(F.lit(cluster).alias("cluster"), "keyword", F.lit(source).alias("source")))


def replace_cluster(clusters: DataFrame, name: str, keywords: Sequence[str], source: str = "manual") -> DataFrame:
    """Add a cluster or replace the one of that name."""
    rows = [(name, k, source) for k in sorted({k.lower() for k in keywords})]
    new = clusters.sparkSession.createDataFrame(rows, "cluster string, keyword string, source string")
    return clusters.join(F.broadcast(new.select("cluster").distinct()), "cluster", "left_anti").unionByName(new)
