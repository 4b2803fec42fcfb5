"""Column expressions shared by the operators. All of them stay inside Spark's own functions."""

from hemtally.functions.dates import as_day, as_snapshot, days_before, on_days
from hemtally.functions.hashes import hash_type, is_linked_id, is_maid_domain
from hemtally.functions.text import html_escape
from hemtally.functions.tokens import has_token_prefix, token_domain

__all__ = [
    "as_day",
    "as_snapshot",
    "days_before",
    "has_token_prefix",
    "hash_type",
    "html_escape",
    "is_linked_id",
    "is_maid_domain",
    "on_days",
    "token_domain",
]
