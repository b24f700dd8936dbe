"""Report lines that can't be loaded: the reason for each, and the rows that can."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cairnframe.functions.exec import once
from cairnframe.functions.jsontext import with_strict

#: The columns of a checksum report.
COLUMNS = ("Bucket", "Key", "VersionId", "TaskStatus", "ErrorCode", "HTTPStatusCode", "ResultMessage")
FIELDS = [f"f{i}" for i in range(len(COLUMNS))]
_SCHEMA = ", ".join(f"{f} string" for f in FIELDS)
#: A record's own end never ends a line for the reader, so that line breaks inside quotes stay as they are.
_READER = {
    "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreLeadingWhiteSpace": "true", "escape": '"', "emptyValue": "", "nullValue": "\u0000",
    "maxCharsPerColumn": "-1", "lineSep": "\u0001", "multiLine": "true",
}
#: Columns that the reader may meet; records with more commas are counted by pattern.
MOST_COLUMNS = 20_000

# possessive, so that matching needs no stack however long a field is
_FIELD = r'[ \t]*+("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_RECORD = rf"\A{_FIELD}(?:,{_FIELD})*+\z"


def without_end(raw: Column) -> Column:
    """A record without its own line end; NULL is an empty record."""
    return F.rtrim(F.coalesce(raw, F.lit("")), F.lit("\r\n"))


def sound_quotes(record: Column) -> Column:
    """Whether the quoting of a record follows RFC 4180, blanks before a field aside."""
    return record.rlike(_RECORD)


def split_record(record: Column) -> Column:
    """The fields of a soundly quoted record, unquoted, without the blanks before them."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit("," + _FIELD), F.lit(1))
    return F.transform(fields, lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _refuse(name: str) -> None:
    raise ValueError(name)


def strict_object(text: str | None) -> bool:
    """Whether text is one JSON object by RFC 8259 (no NaN or Infinity, nothing after it).

    Nesting beyond the parser's depth is judged by a scan without recursion.
    """
    if text is None or not text.lstrip(" \t\n\r").startswith("{"):
        return False
    try:
        json.loads(text, parse_constant=_refuse, parse_int=str, parse_float=str)
    except ValueError:
        return False
    except RecursionError:
        return _strict_deep(text)
    return True


_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)


def _strict_deep(text: str) -> bool:
    """A stack machine over the tokens; want: value, key, colon, comma or end."""
    at, stack, want, empty = 0, [], "value", False
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at, end)
        if m is None:
            return False
        at, mark, string = m.end(), m[1], m[2] is not None
        if mark in ("}", "]"):
            if not stack or stack.pop() != {"}": "{", "]": "["}[mark] or not (want == "comma" or empty):
                return False
            want, empty = "comma", False
            continue
        if mark in ("{", "["):
            if want != "value":
                return False
            stack.append(mark)
            want, empty = ("key" if mark == "{" else "value"), True
            continue
        if mark == ",":
            if want != "comma" or not stack:
                return False
            want = "key" if stack[-1] == "{" else "value"
        elif mark == ":":
            if want != "colon":
                return False
            want = "value"
        elif want == "key":
            if not string:
                return False
            want = "colon"
        elif want == "value":
            want = "comma"
        else:
            return False
        empty = False
    return want == "comma" and not stack


@F.pandas_udf(BooleanType())
def _strict(texts: pd.Series) -> pd.Series:
    return texts.map(strict_object, na_action="ignore")


def judged(lines: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, reason, f0 .. f6) of the records in column raw, row by row, as read_lines has it; for streams too."""
    rows = once(lines, *keep, without_end(F.col("raw")).alias("r"))
    commas = F.length("r") - F.length(F.replace("r", F.lit(","), F.lit("")))
    # the reader takes any control character before a field for a blank
    odd = (F.col("r").rlike(r"[\x00-\x08\x0a-\x1f]") & F.col("r").rlike(r"(?:\A|,)[ \t]*+[\x00-\x08\x0a-\x1f]")) | (commas > MOST_COLUMNS)
    rows = once(rows, *keep, "r", sound_quotes(F.col("r")).alias("sound"), odd.alias("odd"))
    read = F.from_csv(F.when(F.col("sound") & ~F.col("odd"), F.col("r")), _SCHEMA + ", broken string", _READER)
    by_pattern = F.when(F.col("sound") & F.col("odd"), split_record(F.col("r")))
    rows = once(rows, *keep, "r", "sound", "odd", read.alias("p"), by_pattern.alias("q"))
    whole = F.when(F.col("odd"), F.size("q") == len(COLUMNS)).otherwise(F.col("p.broken").isNull() & (F.col("r") != ""))
    whole = F.coalesce(F.col("sound") & whole, F.lit(False))
    field = lambda i: F.coalesce(F.when(F.col("odd"), F.get("q", F.lit(i))).otherwise(F.col(f"p.f{i}")), F.lit(""))
    rows = rows.withColumn("whole", whole)
    rows = once(rows, *keep, "sound", "whole", *(F.when(F.col("whole"), field(i)).alias(f) for i, f in enumerate(FIELDS)))
    head = F.lit(True)
    for i in (0, 1, 6):
        head &= F.lower(FIELDS[i]) == COLUMNS[i].lower()
    status = F.lower("f3")
    rows = rows.withColumn("reason", F.when(~F.col("sound"), "quoting").when(~F.col("whole"), "column_count").when(head, "header").when(~status.isin("succeeded", "failed"), "task_status"))
    rows = rows.withColumn("__json", F.when(F.col("reason").isNull() & (status == "succeeded"), F.col("f6")))
    rows = with_strict(rows, F.col("__json"), "__m")
    rows = once(rows, *keep, *FIELDS, "reason", "__json", (F.col("__json").isNotNull() & F.col("__m").isNull()).alias("doubt"))
    # what the JVM's parser refuses is looked at again: it also refuses repeated names and deep nesting
    refused = ~_strict(F.when(F.col("doubt"), F.col("__json")))
    return rows.select(*keep, F.when(F.col("doubt") & refused, "result_message").otherwise(F.col("reason")).alias("reason"), *FIELDS)


def read_lines(lines: DataFrame) -> DataFrame:
    """(report_id, line_no, reason, f0 .. f6): every delivered record read, or the first reason why not.

    Records are read permissively in the JVM under the explicit schema of seven strings, keeping corrupt text, and
    classified there in one pass: quoting by the pattern of RFC 4180, then column count (what the reader found corrupt),
    then TaskStatus, then ResultMessage by a strict parser of JSON. Python sees only messages which that refuses.
    reason is NULL for sound rows and `header` for header records (first, second and last name, in any case).
    NULL or empty raw is a record of one empty field. Records repeated under one (report_id, line_no) count once;
    differing ones each keep a row. The fields of records with broken quoting or another number of columns are NULL.
    """
    keep = ["report_id", "line_no"]
    return judged(lines.select(*keep, "raw").distinct(), keep)


def failed_lines(lines: DataFrame) -> DataFrame:
    """(report_id, line_no, reason) of the records that are neither sound nor headers."""
    found = read_lines(lines).where(F.col("reason").isNotNull() & (F.col("reason") != "header"))
    return found.select("report_id", "line_no", "reason").distinct()
