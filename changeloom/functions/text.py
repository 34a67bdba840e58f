"""Text functions: byte limits, diff text pieces, spans, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.settings import CUT_NOTE, DESCRIPTION_CUT_NOTE, NEUTRAL, STATIC_MARKERS

# Unicode white space, as a character class body for Java patterns.
UNICODE_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_CHAR = r"[\p{L}\p{Nd}_]"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{UNICODE_SPACE}]+", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, f"[{UNICODE_SPACE}]+", "") == "", F.lit(True))


def utf8_truncate(text: Column, limit: Column) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes that ends on a character."""
    raw = F.encode(text, "UTF-8")
    zero = F.lit(0)
    limit = F.greatest(limit.cast("int"), zero)

    def byte(at: Column) -> Column:
        return F.hex(F.substring(raw, at + 1, F.lit(1)))

    # The byte after the cut must start a character; at most three steps back are needed.
    continuation = r"^[89AB]"
    back = (
        F.when(~byte(limit).rlike(continuation), 0)
        .when(~byte(limit - 1).rlike(continuation), 1)
        .when(~byte(limit - 2).rlike(continuation), 2)
        .otherwise(3)
    )
    cut = F.greatest(limit - back, zero)
    short = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).when(limit == 0, "").otherwise(short)


def ellipsis_field(label: Column | str, text: Column, limit: Column) -> Column:
    """``label`` + text on one line within ``limit`` bytes, ended by '...' when cut."""
    label = F.lit(label) if isinstance(label, str) else label
    flat = F.translate(text, "\r\n", "  ")
    room = limit - F.octet_length(label)
    tail = F.when(room < 4, utf8_truncate(flat, room)).otherwise(
        F.concat(utf8_truncate(flat, room - 3), F.lit("..."))
    )
    body = F.when(F.octet_length(flat) <= room, flat).otherwise(tail)
    return F.when(room <= 0, "").otherwise(F.concat(label, body))


def ellipsis_block(text: Column, limit: Column) -> Column:
    """Text within ``limit`` bytes, ended by '...' and a newline when cut."""
    return (
        F.when(limit <= 0, "")
        .when(F.octet_length(text) <= limit, text)
        .when(limit < 4, utf8_truncate(text, limit))
        .otherwise(F.concat(utf8_truncate(text, limit - 4), F.lit("...\n")))
    )


def byte_prefix(text: Column, limit: Column) -> Column:
    """First ``limit`` bytes; a character cut in half is dropped, as text must stay valid."""
    return utf8_truncate(text, limit)


def cap_outside(text: Column, limit: Column) -> Column:
    """Cap the text; the truncation note comes on top of the cap."""
    cut = F.concat(byte_prefix(text, limit), F.lit(CUT_NOTE))
    return F.when((limit >= 0) & (F.octet_length(text) > limit), cut).otherwise(text)


def cap_inside(text: Column, limit: Column) -> Column:
    """Cap the text; the truncation note counts against the cap."""
    note = len(CUT_NOTE)
    cut = F.concat(byte_prefix(text, limit - note), F.lit(CUT_NOTE))
    return (
        F.when((limit < 0) | (F.octet_length(text) <= limit), text)
        .when(limit <= note, byte_prefix(text, limit))
        .otherwise(cut)
    )


def prompt_description(text: Column) -> Column:
    cut = F.concat(byte_prefix(text, F.lit(3000)), F.lit(DESCRIPTION_CUT_NOTE))
    return F.when(F.octet_length(text) > 3000, cut).otherwise(text)


def json_string(text: Column) -> Column:
    """A JSON string literal which is also safe inside markup."""
    row = F.to_json(F.struct(text.alias("s")))
    literal = F.substring(row, F.lit(6), F.length(row) - 6)
    # Characters written as escapes inside JSON strings.
    for char in ("<", ">", "&", chr(0x2028), chr(0x2029)):
        code = "\\u%04x" % ord(char)
        literal = F.replace(literal, F.lit(char), F.lit(code))
    return literal


def file_header(index: Column, path: Column, status: Column, adds: Column, dels: Column) -> Column:
    return F.format_string(
        "\n===== FILE %d: %s (%s, +%d/-%d) =====\n", index, json_string(path), status, adds, dels
    )


def line_prefix(kind: Column) -> Column:
    return F.when(kind == "a", "+").when(kind == "d", "-").otherwise(" ")


def neutralize(text: Column, nonce: Column) -> Column:
    """Replace delimiter markers in untrusted text, the run's own ones first."""
    for marker in (F.concat(F.lit("BEGIN_UNTRUSTED_"), nonce),
                   F.concat(F.lit("END_UNTRUSTED_"), nonce),
                   *[F.lit(m) for m in STATIC_MARKERS]):
        text = F.replace(text, marker, F.lit(NEUTRAL))
    return text


def change_nonce(change_id: Column) -> Column:
    """Delimiter nonce derived from the change, so that a retried task writes the same text."""
    return F.substring(F.sha2(change_id, 256), 1, 16)


def long_line(text: Column, threshold: int) -> Column:
    return (F.octet_length(text) > threshold) & (F.length(text) > threshold)


def one_decimal(size: Column, unit: int) -> Column:
    """``size / unit`` with one decimal, rounded by the quotient's exact binary value.

    Only a quotient written as x.x5 is in doubt: it lies a little above or below that
    decimal, or exactly on it, and then goes to the even digit. ``format_string`` would
    round the written form instead and turn 1.95 into 2.0.
    """
    step = unit // 10
    half = step // 2

    def tenths(s: Column) -> Column:
        quotient = s / F.lit(float(unit))
        down = F.floor(s / step)
        bits = ((quotient - F.floor(quotient)) * F.lit(2.0**52)).cast("bigint") * 20
        decimal = F.floor(s / half) % 20 * F.lit(2**52)
        up = (bits > decimal) | ((bits == decimal) & (down % 2 == 1))
        return F.when(s % step == half, down + up.cast("int")).otherwise(F.floor((s + half) / step))

    value = F.transform(F.array(size), tenths)[0]
    return F.transform(
        F.array(value), lambda v: F.concat_ws(".", F.floor(v / 10).cast("string"), (v % 10).cast("string"))
    )[0]


def size_label(size: Column) -> Column:
    """Decimal size with unit."""
    return (
        F.when(size < 1000, F.format_string("%d B", size))
        .when(size < 1_000_000, F.concat(one_decimal(size, 1000), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(size, 1_000_000), F.lit(" MB")))
    )


def delta_label(delta: Column) -> Column:
    return F.concat(F.when(delta < 0, "-").otherwise("+"), size_label(F.abs(delta)))


def common_prefix(left: Column, right: Column) -> Column:
    """Length of the common prefix in code points, by bisection over substrings.

    Each step compares two substrings, so a line of n characters costs a few scans of it
    instead of one array element per character.
    """
    bound = F.least(F.length(left), F.length(right))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(bound + 1)).cast("int"))

    def narrow(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high + 1, 1)
        span = middle - low
        same = F.substring(left, low + 1, span) == F.substring(right, low + 1, span)
        return F.when(
            same, F.struct(middle.alias("low"), high.alias("high"))
        ).otherwise(F.struct(low.alias("low"), F.greatest(middle - 1, low).alias("high")))

    start = F.struct(F.lit(0).alias("low"), bound.alias("high"))
    return F.aggregate(steps, start, narrow)["low"]


def changed_spans(pairs: DataFrame, old: str, new: str, threshold: int, similarity: float) -> DataFrame:
    """Pairs with a meaningful changed part: adds start, old_end and new_end of it.

    The lengths of the common prefix and suffix become columns first, so that each is
    computed once. Lines above ``threshold`` characters are skipped.
    """
    left, right = F.col(old), F.col(new)
    old_len, new_len = F.length(left), F.length(right)
    eligible = (left != right) & ~long_line(left, threshold) & ~long_line(right, threshold)
    rows = pairs.withColumn("_prefix", F.when(eligible, common_prefix(left, right)))
    prefix = F.col("_prefix")

    def rest(text: Column) -> Column:
        return F.reverse(F.substring(text, prefix + 1, F.length(text) - prefix))

    rows = rows.withColumn("_old_rest", rest(left)).withColumn("_new_rest", rest(right))
    rows = rows.withColumn("_suffix", common_prefix(F.col("_old_rest"), F.col("_new_rest")))
    suffix = F.col("_suffix")
    head = F.substring(left, F.lit(1), prefix)
    tail = F.substring(left, old_len - suffix + 1, suffix)

    def solid(text: Column) -> Column:
        return F.length(strip_space(text))

    rows = rows.withColumn("_common", solid(head) + solid(tail)).withColumn(
        "_shorter", F.least(solid(left), solid(right))
    )
    similar = (F.col("_shorter") == 0) | (F.col("_common") / F.col("_shorter") >= similarity)

    # Widen to whole words: step back over the word that ends the common prefix when a
    # word goes on behind it, and forward over the word that starts the common suffix.
    def word_at(text: Column, position: Column) -> Column:
        return F.substring(text, position, F.lit(1)).rlike(f"^{WORD_CHAR}")

    goes_on = word_at(left, prefix + 1) | word_at(right, prefix + 1)
    head_word = F.length(F.regexp_extract(head, f"({WORD_CHAR}*+)$", 1))
    rows = rows.withColumn("_start", prefix - F.when(goes_on, head_word).otherwise(0))
    old_last, new_last = old_len - suffix, new_len - suffix
    ends_in_word = ((old_last > F.col("_start")) & word_at(left, old_last)) | (
        (new_last > F.col("_start")) & word_at(right, new_last)
    )
    tail_word = F.length(F.regexp_extract(tail, f"^({WORD_CHAR}*+)", 1))
    rows = rows.withColumn("_shrink", F.when(ends_in_word, tail_word).otherwise(0))
    span = F.struct(
        F.col("_start").cast("int").alias("start"),
        (old_last + F.col("_shrink")).cast("int").alias("old_end"),
        (new_last + F.col("_shrink")).cast("int").alias("new_end"),
    )
    # The generator keeps the final null filter above the staged columns; pushed below them
    # it would repeat their expressions.
    found = F.array(F.when(F.col("_prefix").isNotNull() & similar, span))
    return rows.select(*pairs.columns, F.inline_outer(found)).where("start IS NOT NULL")
