"""Checks over a log of file fetches; nothing is fetched or resolved here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions import urls as U


def screen_urls(fetches: DataFrame, url: str = "url") -> DataFrame:
    return fetches.withColumn("url_error", U.url_problem(F.col(url)))


def public_addresses(resolutions: DataFrame, key: str) -> DataFrame:
    """Verdict per key over its resolved addresses: no address or any that is not
    globally reachable refuses it. resolutions: key, address (NULL = none found)."""
    judged = resolutions.withColumn("_global", U.is_global(F.col("address")))
    checked = judged.groupBy(key).agg(
        F.count("address").alias("addresses"), F.bool_and("_global").alias("_all_global")
    )
    return checked.select(
        key,
        "addresses",
        F.when(F.col("addresses") == 0, F.lit("file_url host did not resolve"))
        .when(~F.col("_all_global"), F.lit("file_url host resolves to a private or reserved address"))
        .alias("address_error"),
    )


def sniff_types(fetches: DataFrame) -> DataFrame:
    """Adds mime_type and mime_error. fetches: url, content_type, content."""
    typed = fetches.withColumn("mime_type", U.media_type(F.col("content_type"), F.col("url"), F.col("content")))
    return typed.withColumn(
        "mime_error",
        F.when(
            ~F.col("mime_type").isin(*K.ACCEPTED_MIME_TYPES),
            F.concat(F.lit("unsupported file content type: "), F.col("mime_type")),
        ),
    )


def upstream_status(status: Column) -> Column:
    """Status to answer with when the upstream answered with an error."""
    return F.when(status == 404, 404).when(status.between(400, 499), 400).otherwise(502)


def fetch_status(fetches: DataFrame) -> DataFrame:
    """Adds answer_status and detail. outcome is http, timeout, invalid_url or network."""
    outcome, status = F.col("outcome"), F.col("status")
    failed = (outcome == "http") & ~status.between(200, 299)
    return fetches.select(
        "*",
        F.when(outcome == "timeout", 504)
        .when(outcome == "invalid_url", 400)
        .when(outcome == "network", 502)
        .when(failed, upstream_status(status))
        .otherwise(200)
        .alias("answer_status"),
        F.when(outcome == "timeout", F.lit("file download timed out"))
        .when(outcome == "invalid_url", F.lit("invalid file_url"))
        .when(outcome == "network", F.lit("failed to download file"))
        .when(failed, F.concat(F.lit("failed to download file: upstream returned "), status.cast("string")))
        .alias("detail"),
    )


def size_caps(
    fetches: DataFrame,
    max_bytes: int = K.MAX_FILE_BYTES,
    max_pages: int = K.MAX_PDF_PAGES,
    max_redirects: int = K.MAX_REDIRECTS,
) -> DataFrame:
    """Adds cap_status and cap_error. fetches: redirects, redirect_location (NULL when
    a redirect named none), content_length (text), body_bytes, n_pages."""
    length = F.col("content_length")
    declared = length.try_cast("bigint")
    unreadable = (F.coalesce(length, F.lit("")) != "") & declared.isNull()
    too_long = F.coalesce(declared > max_bytes, F.lit(False)) | F.coalesce(F.col("body_bytes") > max_bytes, F.lit(False))
    rules = [
        (F.col("redirects") > max_redirects, 400, "too many redirects while downloading file"),
        ((F.col("redirects") > 0) & F.col("redirect_location").isNull(), 502, "upstream redirect missing location"),
        (unreadable, 400, "invalid content-length"),
        (too_long, 413, "file exceeds MAX_FILE_BYTES"),
        (F.coalesce(F.col("n_pages") > max_pages, F.lit(False)), 413, "PDF exceeds MAX_PDF_PAGES"),
    ]
    status, error = F, F
    for broken, code, text in rules:
        status, error = status.when(broken, F.lit(code)), error.when(broken, F.lit(text))
    return fetches.select("*", status.alias("cap_status"), error.alias("cap_error"))
