"""Text for messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The HTML entities, ampersand first so that it does not hit the others' output.
HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def html_escape(value: Column) -> Column:
    text = value.cast("string")
    return reduce(lambda done, pair: F.replace(done, F.lit(pair[0]), F.lit(pair[1])), HTML_ENTITIES, text)
