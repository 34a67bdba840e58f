"""Model answers: find the JSON in raw text, parse it strictly, repair what fails."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SUMMARY_SCHEMA = "index INT, summary STRING, layerHint STRING, keySymbols ARRAY<STRING>"
NARRATION_SCHEMA = "title STRING, intent STRING, narrative STRING, reviewNotes ARRAY<STRING>"
SYNTHESIS_SCHEMA = "title STRING, overview STRING, cohortOps ARRAY<STRING>"
COHORT_SCHEMA = (
    "title STRING, layer STRING, intent STRING, narrative STRING, files ARRAY<INT>, "
    "fileSummaries ARRAY<STRING>, reviewNotes ARRAY<STRING>, dependsOn ARRAY<INT>"
)
ANALYSIS_SCHEMA = f"title STRING, overview STRING, cohorts ARRAY<STRUCT<{COHORT_SCHEMA.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>>"
CORRUPT = "_corrupt"
FENCE = "```"

# A quote closes a string literal if JSON punctuation or the end follows; other quotes inside
# belong to the text.
PART = re.compile(r'\\.|[^"\\]+|"', re.S)
CLOSING = re.compile(r'"\s*(?:[,}\]:]|\Z)')
INSIDE = re.compile(r'\\.|[\n\r\t"]', re.S)
# What raw characters inside a string literal become.
REPLACEMENTS = {"\n": "\\n", "\r": "", "\t": "\\t", '"': '\\"'}


def literal_end(text: str, start: int, open_ended: set[int]) -> int | None:
    """Place of the quote that closes the literal opened at ``start``.

    ``open_ended`` holds inner quotes from which the rest of the text is known to have none, so
    a text is walked through once however many quotes it has.
    """
    inner, at = [], start + 1
    while part := PART.match(text, at):
        if part.group() == '"':
            if CLOSING.match(text, at):
                return at
            if at in open_ended:
                break
            inner.append(at)
        at = part.end()
    open_ended.update(inner)
    return None


def repair_text(text: str) -> str:
    """Escape raw control characters and inner quotes of string literals."""
    pieces, at, open_ended = [], 0, set()
    while (start := text.find('"', at)) >= 0:
        pieces.append(text[at:start])
        end = None if start in open_ended else literal_end(text, start, open_ended)
        if end is None:
            pieces.append('"')
            at = start + 1
            continue
        body = INSIDE.sub(lambda m: REPLACEMENTS.get(m.group(), m.group()), text[start + 1:end])
        pieces.append(f'"{body}"')
        at = end + 1
    return "".join(pieces) + text[at:]


@F.pandas_udf(StringType())
def repair(texts: pd.Series) -> pd.Series:
    return texts.map(repair_text, na_action="ignore")


def fenced_text(raw: Column) -> Column:
    """Text of the first complete fenced block, else the whole text."""
    after = F.substring(raw, F.instr(raw, FENCE) + 3, F.length(raw))
    newline = F.instr(after, "\n")
    rest = F.when(newline > 0, F.substring(after, newline + 1, F.length(after))).otherwise(after)
    fenced = (F.instr(raw, FENCE) > 0) & (F.instr(rest, FENCE) > 0)
    return F.when(fenced, F.substring_index(rest, FENCE, 1)).otherwise(raw)


def outermost_json(text: Column) -> Column:
    """From the first opening brace or bracket to the last matching one; null without any."""
    brace, bracket = F.instr(text, "{"), F.instr(text, "[")
    is_array = (bracket > 0) & ((brace == 0) | (bracket < brace))
    start = F.when(is_array, bracket).otherwise(brace)

    def last(char: str) -> Column:
        at = F.instr(F.reverse(text), char)
        return F.when(at > 0, F.length(text) - at + 1).otherwise(0)

    end = F.when(is_array, last("]")).otherwise(last("}"))
    return F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))


def strict_json(text: Column, schema: str) -> Column:
    """Parsed struct with a ``_corrupt`` field that is set when the text is not valid."""
    options = {"columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    return F.from_json(text, f"{schema}, {CORRUPT} STRING", options)


def read_responses(responses: DataFrame) -> DataFrame:
    """Add ``candidate``: the JSON text of each raw answer."""
    return (
        responses.withColumn("_text", fenced_text(F.col("raw")))
        .withColumn("candidate", outermost_json(F.col("_text"))).drop("_text")
    )


def repair_responses(candidates: DataFrame, schema: str) -> DataFrame:
    """Add ``answer`` (null when unusable) and ``status``: ok, repaired or failed.

    Python sees only the answers that failed the strict parse; all others reach it as null.
    """
    first = strict_json(F.col("candidate"), schema)
    tried = candidates.withColumn("_first", first)
    ok = F.col("candidate").isNotNull() & F.col("_first")[CORRUPT].isNull()
    tried = tried.withColumn("_ok", ok).withColumn(
        "_fixed", repair(F.when(~F.col("_ok"), F.col("candidate")))
    )
    tried = tried.withColumn("_second", strict_json(F.col("_fixed"), schema))
    fixed = F.col("_fixed").isNotNull() & F.col("_second")[CORRUPT].isNull()
    status = F.when(F.col("_ok"), "ok").when(fixed, "repaired").otherwise("failed")
    answer = F.when(F.col("_ok"), F.col("_first").dropFields(CORRUPT)).when(
        fixed, F.col("_second").dropFields(CORRUPT)
    )
    # The generator keeps later filters on status or answer above the parses; pushed below
    # them they would repeat every parse.
    outcome = F.array(F.struct(status.alias("status"), answer.alias("answer")))
    return tried.select(*candidates.columns, F.inline_outer(outcome))
