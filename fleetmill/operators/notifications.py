"""Who is told what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions import texts, times
from fleetmill.operators import streaks

EMAIL = "email"
TOPIC = "sns"
INVALID = "invalid"

CLEANUP_FAILED = "cleanup_failed"


def route(owner: Column, default_emails: list[str]) -> tuple[Column, Column]:
    """(medium, recipients) for an owner. No owner means mail to the default list."""
    medium = (
        F.when(owner.isNull(), EMAIL)
        .when(texts.is_email(owner), EMAIL)
        .when(texts.is_topic(owner), TOPIC)
        .otherwise(INVALID)
    )
    recipients = F.coalesce(owner, F.lit(",".join(default_emails)))
    return medium, F.when(medium != INVALID, recipients)


def route_notifications(
    events: DataFrame, pipelines: DataFrame, default_emails: list[str]
) -> DataFrame:
    """Events with pipeline name, owner, medium and recipients.

    An owner that is neither a mail address nor a topic, or a pipeline that is not in the table,
    makes the event ``invalid``: it has no recipient and is kept, so that it can be seen.
    """
    owners = pipelines.select(
        F.col("id").alias("pipeline_id"),
        F.col("name").alias("pipeline_name"),
        "owner",
        F.lit(True).alias("_known"),
    )
    medium, recipients = route(F.col("owner"), default_emails)
    known = F.col("_known").isNotNull()
    return (
        events.join(owners, "pipeline_id", "left")
        .withColumns(
            {
                "medium": F.when(known, medium).otherwise(INVALID),
                "recipients": F.when(known, recipients),
            }
        )
        .drop("_known")
    )


def notification_messages(
    routed: DataFrame, prefix: str, service: str, max_failures: int = streaks.MAX_FAILURES
) -> DataFrame:
    """Subject and body of each routed event; topics take both in one text.

    ``routed`` has ``event``, ``failure_number``, ``pipeline_name``, ``log`` and ``medium``.
    """
    name, log = F.col("pipeline_name"), F.coalesce("log", F.lit(""))
    # The wording of the messages.
    subject = (
        F.when(
            F.col("event") == streaks.FAILED,
            F.format_string(
                f"[ACTION NEEDED] ({prefix}) Pipeline %s failed to schedule (%d/{max_failures})",
                name,
                F.col("failure_number"),
            ),
        )
        .when(
            F.col("event") == streaks.DEACTIVATED,
            F.format_string(
                f"[ACTION NEEDED] ({prefix}) Pipeline %s has been deactivated "
                "due to scheduling failure",
                name,
            ),
        )
        .when(
            F.col("event") == CLEANUP_FAILED,
            F.format_string(
                f"[{service} Cleanup Failure] ({prefix}) cleanup activity failed for %s", name
            ),
        )
    )
    warning = (
        "It will be deactivated after the number of schedule failures reach "
        f"{max_failures}\n\n"
    )
    body = F.when(F.col("event") == streaks.FAILED, F.concat(F.lit(warning), log)).otherwise(log)
    told = routed.withColumns({"subject": subject, "body": body}).where(
        F.col("subject").isNotNull()
    )
    topic_text = F.concat(F.col("subject"), F.lit(" - "), F.col("body"))
    return told.withColumn("topic_text", F.when(F.col("medium") == TOPIC, topic_text))


def submission_messages(outcomes: DataFrame) -> DataFrame:
    """What is said about each accepted submission, dry runs included."""
    subject = F.col("pipeline_object")
    # The wording of the messages.
    text = (
        F.when(
            F.col("outcome") == "updated",
            F.concat(
                subject,
                F.lit(" Schedule updated...next run "),
                times.format_local(F.col("next_run_time")),
            ),
        )
        .when(
            F.col("outcome") == "jar_updated",
            F.concat(subject, F.lit(" Jar updated to version "), F.col("jar")),
        )
        .when(F.col("outcome") == "enabled", F.concat(subject, F.lit(" Enabled.")))
        .when(F.col("outcome") == "disabled", F.concat(subject, F.lit(" Disabled.")))
        .when(
            F.col("outcome") == "inserted",
            F.concat(
                subject,
                F.lit(" Scheduled. Next Run - "),
                times.format_local(F.col("next_run_time")),
            ),
        )
    )
    return outcomes.withColumn("message", F.concat(F.lit("Pipeline "), text)).where(
        F.col("message").isNotNull()
    )


def chat_payloads(
    messages: DataFrame,
    lines: list[str],
    username: str | None,
    channel: str | None,
    icon_emoji: str | None = None,
) -> DataFrame:
    """``payload``, a JSON object per message; what is not given is left out of it.

    ``lines`` follow the message, one line each.
    """
    text = F.array_join(F.array(F.col("message"), *[F.lit(line) for line in lines]), "\n")
    fields = F.struct(
        F.lit(icon_emoji).cast("string").alias("icon_emoji"),
        F.lit(channel).cast("string").alias("channel"),
        F.lit(username).cast("string").alias("username"),
        text.alias("text"),
    )
    return messages.withColumn("payload", F.to_json(fields, {"ignoreNullFields": "true"}))
