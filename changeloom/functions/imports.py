"""Import statements, exported definitions and identifiers of added lines, per language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.paths import classify_language
from changeloom.functions.web import css_refs, html_refs
from changeloom.operators.windows import added_runs

FILE = ["change_id", "file_idx"]

# Statement forms per language.
GO_IMPORT = r'^\s*import\s+(?:[._A-Za-z][A-Za-z0-9_]*\s+)?["`]([^"`]+)["`]'
GO_SPEC = r'^\s*(?:[._A-Za-z][A-Za-z0-9_]*\s+)?["`]([^"`]+)["`]\s*(?://.*)?$'
PY_FROM = r"^\s*from\s+([.A-Za-z_][.A-Za-z0-9_]*)\s+import\s+"
PY_IMPORT = r"^\s*import\s+([^#]+)"
PY_MODULE = r"^[A-Za-z_][A-Za-z0-9_.]*$"
DOTTED = r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.(?:[A-Za-z_$][A-Za-z0-9_$]*|\*))*+"
JAVA_IMPORT = rf"^\s*import\s+(?:(static)\s+)?({DOTTED})\s*;\s*(?://.*)?$"
KOTLIN_IMPORT = (
    rf"^\s*import\s+({DOTTED})\s*(?:as\s+[A-Za-z_$][A-Za-z0-9_$]*)?\s*;?\s*(?://.*)?$"
)
# Every import of the line languages starts with one of these.
LINE_START = r"^\s*(?:(?:import|from)\s|[\"`]|[._A-Za-z][A-Za-z0-9_]*\s+[\"`])"
JS_STATEMENT = r"^\s*(?:import(?![A-Za-z0-9_])|export\s+(?:type\s+)?(?:\{|\*))"
JS_SIDE_EFFECT = r"""^\s*import\s*["']([^"']+)["']"""
JS_BARE = r"^\s*import\s*$"
JS_FROM_WORD = r"(?<![A-Za-z0-9_])from(?![A-Za-z0-9_])"
JS_FROM = rf"""(?<![A-Za-z0-9_])from\s*["']([^"']+)["']"""
JS_QUOTED = r"""^\s*["']([^"']+)["']"""
JS_REQUIRE = (
    r"""(?:^\s*|[=(:,]\s*|(?<![A-Za-z0-9_])return\s+)require\s*\(\s*["']([^"']+)["']\s*\)"""
)
JS_COMMENT_LINE = r"^\s*(?://|/\*|\*)"
DEFINITIONS = {
    "javascript": [
        r"^\s*export\s+(?:async\s+)?(?:function|const|class|type|interface)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
    ],
    "go": [r"^\s*(?:func|type)\s+([A-Z][A-Za-z0-9_]*)(?![A-Za-z0-9_])"],
    "python": [r"^(?:async\s+)?(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9_])"],
    "java": [
        r"^\s*(?:public\s+)?(?:(?:final|abstract|sealed)\s+)*+(?:class|interface|enum|record)\s+"
        r"([A-Za-z_$][A-Za-z0-9_$]*)(?:[^A-Za-z0-9_$]|$)"
    ],
    "kotlin": [
        r"^(?:class|interface|object)\s+([A-Za-z_$][A-Za-z0-9_$]*)(?:[^A-Za-z0-9_$]|$)",
        r"^fun\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(",
    ],
}
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
MIN_SYMBOL_BYTES = 4

# A JavaScript token that matters to comments: strings are consumed whole, block comments
# count only where nothing but blanks stands before them on their line.
JS_COMMENTS = (
    r"""(?s)("(?:\\[^\n]|[^"\\\n])*+"?+|'(?:\\[^\n]|[^'\\\n])*+'?+|`(?:\\.|[^`\\])*+`?+)"""
    r"""|//[^\n]*+|(?<=^|\n)(?:[ \t]*+/\*(?:[^*]|\*(?!/))*+(?:\*/)?+)++"""
)


def with_language(lines: DataFrame, files: DataFrame) -> DataFrame:
    tagged = files.select(*FILE, classify_language(F.col("path")).alias("language"), "path")
    return lines.join(tagged.where("language is not null"), FILE)


def line_specifiers(language: Column, text: Column) -> Column:
    """Array of import targets of one Go, Python, Java or Kotlin line."""

    def first(*patterns: str) -> Column:
        found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
        return F.array_compact(F.array(F.coalesce(*found)))

    listed = F.transform(
        F.split(F.regexp_extract(text, PY_IMPORT, 1), ","),
        lambda item: F.regexp_extract(item, r"^\s*(\S*)", 1),
    )
    python = F.when(text.rlike(PY_FROM), first(PY_FROM)).otherwise(
        F.filter(listed, lambda name: name.rlike(PY_MODULE))
    )
    dotted = F.when(language == "java", F.regexp_extract(text, JAVA_IMPORT, 2)).otherwise(
        F.regexp_extract(text, KOTLIN_IMPORT, 1)
    )
    static = (language == "java") & (F.regexp_extract(text, JAVA_IMPORT, 1) == "static")
    owner = F.when(static, F.regexp_extract(dotted, r"^(.*)\.[^.]*$", 1)).otherwise(dotted)
    jvm = F.array_compact(F.array(F.nullif(F.replace(owner, F.lit("."), F.lit("/")), F.lit(""))))
    return (
        F.when(language == "go", first(GO_IMPORT, GO_SPEC)).when(language == "python", python)
        .when(language.isin("java", "kotlin"), jvm).otherwise(F.array().cast("array<string>"))
    )


def import_refs_line(added: DataFrame) -> DataFrame:
    """(change_id, file_idx, specifier) of languages whose imports fit one line.

    Lines that no language takes for an import leave before the language of their file is looked up.
    """
    return added.where(F.col("language").isin("go", "python", "java", "kotlin") & F.col("text").rlike(LINE_START)).select(
        *FILE, F.explode(line_specifiers(F.col("language"), F.col("text"))).alias("specifier")
    )


def strip_js_comments(run: Column) -> Column:
    """Blank comments of a run of lines; strings stay, and so does trailing code."""
    return F.regexp_replace(run, JS_COMMENTS, "$1")


def import_refs_js(added: DataFrame) -> DataFrame:
    """JavaScript imports, also over several lines of one run of added lines.

    Runs are cleaned of comments as a whole. Then every line gets the number of the
    statement it belongs to; a statement starts at ``import`` or ``export {``, and the
    first line that completes or breaks it ends it. All windows run per run of lines; runs without a
    keyword leave before, and statements and ``require`` calls are found in one pass.
    """
    runs = added_runs(added.where("language = 'javascript'"))
    key = ["change_id", "file_idx", "hunk_idx", "run_idx"]
    joined = runs.groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line_idx", "text")))["text"], "\n").alias("run")
    )
    rows = joined.where(F.col("run").rlike("import|export|require")).select(
        *key, F.posexplode(F.split(strip_js_comments(F.col("run")), "\n")).alias("line_idx", "text")
    )
    rows = rows.where(~F.col("text").rlike(JS_COMMENT_LINE))
    text = F.col("text")
    required = F.regexp_extract_all("text", F.lit(JS_REQUIRE), F.lit(1))
    order = Window.partitionBy(*key).orderBy("line_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    starts = text.rlike(JS_STATEMENT)
    numbered = rows.withColumn("starts", starts).withColumn("required", required).withColumn(
        "statement", F.sum(F.col("starts").cast("int")).over(upto)
    ).where("statement > 0 OR size(required) > 0")
    inside = Window.partitionBy(*key, "statement").orderBy("line_idx")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)

    def count(char: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))

    opened = F.sum(count("{") - count("}")).over(so_far)
    # A keyword on an earlier line makes the statement wait for a quoted target.
    word = text.rlike(JS_FROM_WORD) & ~text.rlike(JS_FROM)
    waits = F.coalesce(F.max(word | text.rlike(JS_BARE) & F.col("starts")).over(earlier), F.lit(False))
    target = (
        F.when(F.col("starts") & text.rlike(JS_SIDE_EFFECT), F.regexp_extract("text", JS_SIDE_EFFECT, 1))
        .when(text.rlike(JS_FROM), F.regexp_extract("text", JS_FROM, 1))
        .when(waits & text.rlike(JS_QUOTED), F.regexp_extract("text", JS_QUOTED, 1))
    )
    closed = (F.col("starts") & (opened == 0) & ~text.rlike(JS_FROM_WORD) & ~text.rlike(JS_BARE)) | (
        ~F.col("starts") & (opened == 0) & text.contains("}") & ~text.rlike(JS_FROM_WORD) & ~waits
    )
    scanned = numbered.withColumn("target", target).withColumn("closed", closed).withColumn(
        "waits", waits
    )
    # After the braces closed, only a line that begins with ``from`` may go on.
    broken = F.coalesce(F.lag("closed").over(inside), F.lit(False)) & ~text.rlike(r"^\s*from(?![A-Za-z0-9_])")
    ended = text.contains(";") & F.col("target").isNull() & ~F.col("waits") & ~text.rlike(JS_FROM_WORD)
    scanned = scanned.withColumn("broken", broken).withColumn("ended", ended)
    dead = F.max("broken").over(so_far) | F.coalesce(
        F.max(F.col("ended") | F.col("target").isNotNull()).over(earlier), F.lit(False)
    )
    stated = F.when(F.expr("statement > 0 AND NOT dead AND target IS NOT NULL"), F.array("target"))
    found = F.concat("required", F.coalesce(stated, F.array().cast("array<string>")))
    return scanned.withColumn("dead", dead).select(*FILE, F.explode(found).alias("specifier"))


def import_refs_markup(added: DataFrame) -> DataFrame:
    """HTML and CSS references of each run of added lines."""
    runs = added_runs(added.where(F.col("language").isin("html", "css")), ["language"])
    key = ["change_id", "file_idx", "hunk_idx", "run_idx", "language"]
    joined = runs.groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line_idx", "text")))["text"], "\n").alias("run")
    )
    refs = F.when(F.col("language") == "html", html_refs(F.col("run"))).otherwise(css_refs(F.col("run")))
    return joined.select(*FILE, F.explode(refs).alias("specifier"))


def import_specifiers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct (change_id, file_idx, specifier) of every language."""
    tagged = with_language(lines, files)
    added = tagged.where("t = 'a'")
    return (
        import_refs_line(added).unionByName(import_refs_js(tagged)).unionByName(import_refs_markup(tagged))
        .distinct()
    )


def exported_symbol(language: Column, text: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, patterns in DEFINITIONS.items():
        found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])
        result = F.when(language == name, found).otherwise(result)
    return result


def exported_defs(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct (change_id, file_idx, symbol) of symbols exported by added lines."""
    added = with_language(lines.where("t = 'a'"), files)
    symbol = exported_symbol(F.col("language"), F.col("text"))
    return (
        added.select(*FILE, symbol.alias("symbol"))
        .where(F.octet_length("symbol") >= MIN_SYMBOL_BYTES).distinct()
    )


def identifier_tokens(lines: DataFrame, least: int = 1) -> DataFrame:
    """Distinct (change_id, file_idx, symbol) of identifiers on added lines of any file.

    Those of fewer than ``least`` bytes are left out before the shuffle.
    """
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({IDENTIFIER})"), F.lit(1)))
    found = F.filter(found, lambda token: F.octet_length(token) >= least)
    return lines.where("t = 'a'").select(*FILE, F.explode(found).alias("symbol")).distinct()


