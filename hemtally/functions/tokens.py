"""``domain:id`` tokens of a cluster file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how the token list of a cluster file has to start.
TOKEN_PREFIX_PATTERN = r"^(\d+|idfa|aaid):"


def token_domain(token: Column) -> Column:
    """Text before the first colon: the whole token if it has none, empty if it starts with one."""
    return F.substring_index(token, ":", 1)


def has_token_prefix(tokens: Column) -> Column:
    """Whether a token list starts with a numeric or mobile domain; NULL does not."""
    return F.coalesce(tokens.rlike(TOKEN_PREFIX_PATTERN), F.lit(False))
