"""JSON inside model answers, and canonical JSON for hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skemata.functions.text import strip

# The shapes of an answer that holds JSON.
FENCED = r"(?s)```(?:json)?\s*\n?(\{.*?\})\n?\s*```"
BRACED = r"(?s)(\{.*\})"


def answer_json(text: Column) -> Column:
    """JSON text in an answer: fenced block, else the outermost braces that parse."""
    fenced = F.nullif(F.regexp_extract(text, FENCED, 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, BRACED, 1), F.lit(""))
    whole = strip(text)
    return F.coalesce(
        fenced,
        F.when(F.try_parse_json(braced).isNotNull(), braced),
        F.when(
            whole.startswith("{") & whole.endswith("}") & F.try_parse_json(whole).isNotNull(),
            whole,
        ),
    )


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys and explicit nulls, so equal content hashes alike."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def content_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)
