"""Content-policy chain over incoming logs and the alert outbox."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actilens.functions.risk import is_severe
from actilens.functions.text import alert_colour, alert_text, contains_any
from actilens.functions.timefns import in_quiet_hours

# Policy term lists and tags.
GAMBLING_TERMS = ["casino", "bet", "poker", "gambling", "lottery"]
SOCIAL_TERMS = ["facebook", "twitter", "instagram", "tiktok", "linkedin"]
KEYWORD_TAG = " [KEYWORD DETECTED]"
GAMBLING_TAG = " [POLICY VIOLATION: GAMBLING]"
SOCIAL_TAG = " [POLICY VIOLATION: SOCIAL MEDIA]"
ANOMALY_TAG = " [ML_DETECTED]"


@dataclass(frozen=True)
class Settings:
    """Policy switches and notification routing."""

    alert_on_keywords: bool = True
    block_gambling: bool = True
    block_social_media: bool = False
    keywords: list[str] = field(default_factory=lambda: ["password", "confidential", "secret", "key"])
    webhook_url: str | None = None
    email_notifications: bool = False
    notification_email: str | None = None
    sms_notifications: bool = False
    twilio_account_sid: str | None = None
    twilio_auth_token: str | None = None
    twilio_to_number: str | None = None
    quiet_hours_start: str | None = None
    quiet_hours_end: str | None = None


def apply_policies(logs: DataFrame, settings: Settings, prediction: str | None = None) -> DataFrame:
    """Raise risk and append tags: keywords, gambling, social media, then the anomaly flag.

    Terms are looked up in the text as it arrived, so a tag added by one step never triggers another.
    ``prediction`` names a column holding -1 for anomalies.
    """
    description, details = F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("details", F.lit("")))

    def mentions(terms: list[str]) -> Column:
        return contains_any(description, terms) | contains_any(details, terms)

    level, text = F.col("risk_level"), F.col("description")
    marks = {}
    if settings.alert_on_keywords:
        marks["_keyword"] = mentions([k.lower() for k in settings.keywords])
    if settings.block_gambling:
        marks["_gambling"] = mentions(GAMBLING_TERMS)
    if settings.block_social_media:
        marks["_social"] = mentions(SOCIAL_TERMS)
    out = logs.withColumns(marks) if marks else logs

    def step(df: DataFrame, tagged: Column, new_level: Column, tag: str) -> DataFrame:
        return df.withColumns(
            {
                "risk_level": F.when(tagged, new_level).otherwise(level),
                "description": F.when(tagged, F.concat(text, F.lit(tag))).otherwise(text),
            }
        )

    unless_critical = F.when(F.coalesce(level, F.lit("")) == "CRITICAL", level).otherwise("HIGH")
    if settings.alert_on_keywords:
        calm = ~F.coalesce(is_severe(level), F.lit(False))
        out = step(out, F.col("_keyword") & calm, F.lit("HIGH"), KEYWORD_TAG)
    if settings.block_gambling:
        out = step(out, F.col("_gambling"), F.lit("CRITICAL"), GAMBLING_TAG)
    if settings.block_social_media:
        out = step(out, F.col("_social"), unless_critical, SOCIAL_TAG)
    if prediction:
        out = step(out, F.coalesce(F.col(prediction) == -1, F.lit(False)), unless_critical, ANOMALY_TAG)
    return out.drop(*marks)


def alert_outbox(logs: DataFrame, settings: Settings) -> DataFrame:
    """HIGH and CRITICAL rows as alerts; in quiet hours only CRITICAL ones."""
    level = F.col("risk_level")
    quiet = in_quiet_hours(F.col("ts"), settings.quiet_hours_start, settings.quiet_hours_end)
    return logs.filter(is_severe(level) & (~quiet | (level == "CRITICAL"))).select(
        "id", "ts", "user_name", "ip_address", "risk_level", "activity_type", "details",
        alert_text(level, F.col("activity_type"), F.col("description")).alias("message"),
        alert_colour(level).alias("colour"),
    )


def channels(settings: Settings) -> list[tuple[str, str]]:
    """(channel, destination) pairs that are switched on and addressed."""
    out = []
    if settings.webhook_url:
        out.append(("webhook", settings.webhook_url))
    if settings.email_notifications and settings.notification_email:
        out.append(("email", settings.notification_email))
    if settings.sms_notifications and settings.twilio_account_sid and settings.twilio_auth_token:
        out.append(("sms", settings.twilio_to_number or ""))
    return out


def deliveries(alerts: DataFrame, settings: Settings, sender: str = "Alert Service") -> DataFrame:
    """One row per alert and channel. Webhooks carry the nested JSON payload, the others the text."""
    active = channels(settings)
    struct = "array<struct<channel:string,destination:string>>"
    options = F.array(
        *[F.struct(F.lit(c).alias("channel"), F.lit(d).alias("destination")) for c, d in active]
    ).cast(struct)
    show = lambda c: F.coalesce(F.col(c), F.lit("None"))
    item = lambda title, value, short: F.struct(
        F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short")
    )
    payload = F.to_json(
        F.struct(
            F.col("message").alias("text"),
            F.lit(sender).alias("username"),
            F.lit(":shield:").alias("icon_emoji"),
            F.array(
                F.struct(
                    F.col("colour").alias("color"),
                    F.array(
                        item("User", F.col("user_name"), True),
                        item("IP", F.col("ip_address"), True),
                        item("Details", F.col("details"), None),
                    ).alias("fields"),
                )
            ).alias("attachments"),
        )
    )
    body = (
        F.when(F.col("c.channel") == "webhook", payload)
        .when(F.col("c.channel") == "email", F.concat(F.lit("Alert - "), show("risk_level"), F.lit("\n"), F.col("message")))
        .otherwise(F.col("message"))
    )
    return alerts.select("*", F.explode(options).alias("c")).select(
        "id", "ts", "risk_level", "c.channel", "c.destination", body.alias("body")
    )
