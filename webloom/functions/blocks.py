"""Block / CAPTCHA / rate-limit page classification (P5-P9) and fetch-outcome retry class (P10).

Each pattern list becomes one case-insensitive alternation, so a page is scanned once per list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.common import let

from webloom.functions.common import col as _c

# Detection patterns (regular expressions, matched case-insensitively).
CAPTCHA_PATTERNS = [
    r"g-recaptcha", r"google\.com/recaptcha", r"grecaptcha",
    r"hcaptcha", r"h-captcha",
    r"cf-browser-verification", r"cf-im-under-attack", r"cf-captcha", r"Checking your browser",
    r"Please wait while we check your browser", r"__cf_bm", r"cf_chl_jschl_tk",
    r"awswaf", r"captcha-aws",
    r"captcha", r"CAPTCHA", r"Enter the characters", r"Security check", r"Verification required",
    r"Are you a robot", r"Please verify you are human",
]
BLOCK_PATTERNS = [
    r"rate limit", r"Rate limit", r"too many requests", r"Too Many Requests", r"access denied",
    r"Access Denied", r"blocked", r"Blocked", r"403 Forbidden", r"Forbidden", r"Your IP has been banned",
    r"IP blocked", r"automated request", r"suspicious activity", r"unusual traffic", r"Unusual traffic",
]
BLOCK_TITLES = [
    "Access Denied", "Forbidden", "Blocked", "Rate Limited", "Security Check", "CAPTCHA", "Just a moment",
    "Checking your browser",
]
RATE_LIMIT_PATTERNS = [r"rate limit", r"too many requests", r"try again later", r"retry after"]
# Retry policy status lists.
GIVEUP_STATUSES = [400, 401, 403, 404, 405]
RETRY_STATUSES = [429, 503, 504, 502, 500]
BATCH_RETRY_STATUSES = [408, 429, 500, 502, 503, 504]


def _any(patterns) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def is_captcha(html) -> Column:
    """P5."""
    return F.coalesce(_c(html).rlike(_any(CAPTCHA_PATTERNS)), F.lit(False))


def is_block_text(html) -> Column:
    """P6."""
    return F.coalesce(_c(html).rlike(_any(BLOCK_PATTERNS)), F.lit(False))


def is_block_title(title) -> Column:
    """lower(title) contains any block phrase."""
    t = F.lower(F.coalesce(_c(title), F.lit("")))
    return reduce(lambda a, b: a | b, [F.instr(t, p.lower()) > 0 for p in BLOCK_TITLES])


def is_rate_limited(status, html) -> Column:
    """Status 429 or a rate-limit phrase in the content."""
    return (F.coalesce(_c(status), F.lit(200)) == 429) | F.coalesce(_c(html).rlike(_any(RATE_LIMIT_PATTERNS)), F.lit(False))


def classify_block(status, html) -> Column:
    """struct(is_captcha, is_blocked, is_rate_limited, requires_action, type, confidence).

    Same precedence as the rule: status first, then captcha and block text (high), then the
    rate-limit check overwrites confidence to medium unless the status is 429."""
    s, h = _c(status), F.coalesce(_c(html), F.lit(""))
    forbidden, too_many = F.coalesce(s.isin(403, 503), F.lit(False)), F.coalesce(s == 429, F.lit(False))

    def verdict(v):  # each pattern list is searched once
        cap, text, rate = v["cap"], v["text"], v["rate"]
        blocked, limited = forbidden | text, too_many | rate
        by_status = F.when(forbidden, "medium").when(too_many, "high").otherwise("low")
        conf = F.when(rate, F.when(too_many, "high").otherwise("medium")).when(cap | text, "high").otherwise(by_status)
        kind = F.when(cap, "captcha").when(limited, "rate_limited").when(blocked, "blocked").otherwise("none")
        return F.struct(cap.alias("is_captcha"), blocked.alias("is_blocked"), limited.alias("is_rate_limited"),
                        (cap | blocked | limited).alias("requires_action"), kind.alias("type"), conf.alias("confidence"))
    return let(F.struct(is_captcha(h).alias("cap"), is_block_text(h).alias("text"), is_rate_limited(s, h).alias("rate")), verdict)


def is_retryable(status, error_type=None, retry_on=("TimeoutError", "ConnectionError"),
                 retry_statuses=RETRY_STATUSES, giveup_statuses=GIVEUP_STATUSES) -> Column:
    """P10: give-up list -> no; retry list -> yes; >=500 yes; >=400 no; else retry iff an exception
    of a listed type was raised."""
    s = _c(status)
    exc = F.lit(False) if error_type is None else F.coalesce(_c(error_type).isin(*retry_on), F.lit(False))
    return (F.when(s.isin(*giveup_statuses), False).when(s.isin(*retry_statuses), True)
            .when(s >= 500, True).when(s >= 400, False).otherwise(exc))
