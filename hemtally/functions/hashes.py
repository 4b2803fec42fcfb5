"""Recognising hashed emails and device identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a hash, a linked identifier and a mobile domain look like in the input data.
MD5_PATTERN = "^[a-f0-9]{32}$"
SHA1_PATTERN = "^[a-f0-9]{40}$"
SHA2_PATTERN = "^[a-f0-9]{64}$"
LINKED_PATTERN = "^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"
MAID_DOMAINS = ("aaid", "idfa")


def hash_type(value: Column) -> Column:
    """``md5``, ``sh1`` or ``sh2`` for lowercase hex of that length; anything else, NULL too, is ``invalid``."""
    return (
        F.when(value.rlike(MD5_PATTERN), "md5")
        .when(value.rlike(SHA1_PATTERN), "sh1")
        .when(value.rlike(SHA2_PATTERN), "sh2")
        .otherwise("invalid")
    )


def is_linked_id(identifier: Column) -> Column:
    return identifier.rlike(LINKED_PATTERN)


def is_maid_domain(domain: Column, maid_domains: tuple[str, ...] = MAID_DOMAINS) -> Column:
    return domain.isin(*maid_domains)
