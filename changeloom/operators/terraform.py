"""Terraform facts of added lines: definitions, references and module sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.paths import classify_language, directory, join_path, normalize_path
from changeloom.operators.links import all_edges
from changeloom.operators.windows import added_runs

RUN = ["change_id", "file_idx", "hunk_idx", "run_idx"]

# Block and reference forms. A block's form is the text between a line's start
# and its opening brace.
VARIABLE = r'^\s*variable\s+"([^"]+)"\s*$'
MODULE = r'^\s*module\s+"([^"]+)"\s*$'
LOCALS = r"^\s*locals\s*$"
RESOURCE = r'^\s*(resource|data)\s+"([^"]+)"\s+"([^"]+)"\s*$'
EDGE = r"(?:^|[^A-Za-z0-9_.-])"
NAME = r"([A-Za-z_][A-Za-z0-9_-]*)"
PLAIN_REFERENCES = (
    ("variable", rf"{EDGE}var\.{NAME}"),
    ("module", rf"{EDGE}module\.{NAME}\."),
    ("local", rf"{EDGE}local\.{NAME}"),
)
TYPED_REFERENCE = rf"{EDGE}{NAME}\.{NAME}"
DATA_REFERENCE = rf"{EDGE}data\.{NAME}\.{NAME}"
KEYWORDS = ("var", "local", "module", "data")
ASSIGNMENT = r"([A-Za-z_][A-Za-z0-9_-]*+)[ \t]*+=(?!=)"

STRING = r'"(?:\\[^\n]?+|[^"\\\n])*+"?+'
WORD_WITH_VALUE = rf'([A-Za-z_][A-Za-z0-9_-]*+)(?:\s*+=\s*+"([^"\n]++)")?+|{STRING}'
COMMENT = r"(?:#|//)[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
# Group 1 is the closing word, group 2 the body. The start must end its line.
HEREDOC = (
    r"<<-?+[ \t]*+([A-Za-z_][A-Za-z0-9_]*+)(?:[ \t]++|(?:#|//)[^\n]*+|/\*(?:[^*\n]|\*(?!/))*+\*/)*+(?=\n)"
    r"((?s:(?!\n[ \t]*+\1[ \t\r]*+(?:\n|\z)).)*+)(?:\n[ \t]*+\1[ \t\r]*+(?=\n|\z))?+"
)
PIECES = rf'{STRING}|{HEREDOC}|{COMMENT}|[^"<#/]++|[<#/]'
BLOCKS = rf'(?:{STRING}|[^{{}}"\n])++|[{{}}\n]'
TEMPLATE_LEVELS = 3


def template(level: int, stop: str, group: str = "(") -> str:
    """Pattern of a template with ``level`` levels of strings with templates inside.

    Its code is group 1, or no group with ``group`` "(?:". ``stop`` ends an unfinished
    template, as the text's end does.
    """
    inner = string_with_templates(level - 1, stop) if level else quoted("", stop)
    part = rf'[^{{}}"{stop}]|{inner}'
    braces = rf"\{{(?:{part}|\{{(?:{part})*+\}}?+)*+\}}?+"
    return rf"(?:(?<!\$)\$\{{|(?<!%)%\{{){group}(?:{part}|{braces})*+)\}}?+"


def string_with_templates(level: int, stop: str) -> str:
    """Pattern of a string that may hold templates, without groups."""
    return quoted(rf"\$\$\{{|%%\{{|{template(level, stop, '(?:')}|", stop)


def quoted(parts: str, stop: str) -> str:
    escaped = rf"\\[^{stop}]?+" if stop else r"\\(?s:.)?+"
    return rf'"(?:{escaped}|{parts}[^"\\{stop}])*+"?+'


def every(column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(
        F.regexp_extract_all(column, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")
    )


def code_runs(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Terraform runs: ``code`` without comments and heredocs, and the ``heredocs`` texts.

    One ordered alternation decides whether a comment, a string or a heredoc starts first.
    Comments keep their line breaks, so the line that follows one still starts a line.
    """
    terraform = files.where(classify_language(F.col("path")) == "terraform").select(
        "change_id", "file_idx", directory(normalize_path(F.col("path"))).alias("dir")
    )
    runs = added_runs(lines.join(terraform, ["change_id", "file_idx"]), ["dir"])
    text = runs.groupBy(*RUN, "dir").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line_idx", "text")))["text"], "\n").alias("run")
    )
    pieces = text.withColumn("pieces", every("run", PIECES, 0))

    def cleaned(piece: Column) -> Column:
        heredoc = piece.startswith("<<")
        comment = piece.startswith("#") & (piece != "#") | piece.startswith("//") | piece.startswith("/*")
        return F.when(heredoc | (piece == "#"), " ").when(comment, F.regexp_replace(piece, r"[^\n]++", " ")).otherwise(piece)

    return pieces.select(
        *RUN, "dir", F.array_join(F.transform("pieces", cleaned), "").alias("code"),
        F.array_join(
            F.transform(F.filter("pieces", lambda p: p.startswith("<<")), lambda p: F.regexp_extract(p, HEREDOC, 2)), "\n"
        ).alias("heredocs"),
    )


def outside_strings(text: Column) -> Column:
    """Code outside strings, and the code of templates of any string, three levels deep."""
    plain = F.regexp_replace(text, string_with_templates(TEMPLATE_LEVELS - 1, r"\n"), " ")
    return F.concat_ws("\n", plain, *template_code(text, r"\n"))


def template_code(text: Column, stop: str) -> list[Column]:
    """Code of the templates in a text, of the templates in their strings, and so on."""
    found = []
    for level in reversed(range(TEMPLATE_LEVELS)):
        text = F.array_join(every(text, template(level, stop)), "\n")
        code = F.regexp_replace(text, string_with_templates(level, stop), " ")
        found.append(F.regexp_replace(code, COMMENT, " "))
    return found


def blocks(runs: DataFrame) -> DataFrame:
    """Texts between braces and line ends, with the brace ``depth`` at each.

    ``head`` tells that a text starts a line and opens a brace. All windows share the run's
    partitioning.
    """
    rows = runs.select(*RUN, "dir", F.posexplode(every("code", BLOCKS, 0)).alias("at", "piece"))
    order = Window.partitionBy(*RUN).orderBy("at")
    step = F.when(F.col("piece") == "{", 1).when(F.col("piece") == "}", -1).otherwise(0)
    before = F.lag("piece").over(order)
    return rows.withColumn("head", (before.isNull() | (before == "\n")) & (F.lead("piece").over(order) == "{")).withColumn(
        "depth", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )


def inside_block(rows: DataFrame, opening: str, name: str) -> DataFrame:
    """Add ``name``: whether a text stands directly inside a block of that kind.

    A block ends with the first line after which the depth is below its inner depth.
    """
    opens = F.col("head") & F.col("piece").rlike(opening)
    order = Window.partitionBy(*RUN).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy(*RUN, "_block").orderBy("at")
    rows = rows.withColumn("_block", F.sum(opens.cast("int")).over(order)).withColumn(
        "_inner", F.first(F.col("depth") + 1).over(block)
    ).withColumn(
        "_lowest", F.min(F.when(F.col("piece") == "\n", F.col("depth"))).over(block.rowsBetween(Window.unboundedPreceding, -1))
    )
    open_still = (F.col("_block") > 0) & (F.col("_lowest").isNull() | (F.col("_lowest") >= F.col("_inner")))
    return rows.withColumn(name, open_still & (F.col("depth") == F.col("_inner"))).drop("_block", "_inner", "_lowest")


def fact(role: str, kind: Column, type_name: Column, name: Column) -> Column:
    return F.struct(
        F.lit(role).alias("role"), kind.alias("kind"), type_name.alias("type_name"), name.alias("name")
    )


def names(role: str, kind: str, found: Column) -> Column:
    return F.transform(found, lambda name: fact(role, F.lit(kind), F.lit(""), name))


def definitions() -> Column:
    """Definitions and module sources of one text between braces."""
    piece = F.col("piece")

    def head(kind: Column, pattern: str, group: int, type_group: int = 0) -> Column:
        type_name = F.regexp_extract(piece, pattern, type_group) if type_group else F.lit("")
        name = F.when(F.col("head"), F.regexp_extract(piece, pattern, group)).otherwise("")
        return F.array(fact("define", kind, type_name, name))

    def when(condition: str, found: Column) -> Column:
        return F.when(F.col(condition), found).otherwise(F.array().cast("array<string>"))

    words = F.arrays_zip(every(piece, WORD_WITH_VALUE, 1).alias("word"), every(piece, WORD_WITH_VALUE, 2).alias("value"))
    sources = F.transform(F.filter(words, lambda w: w["word"] == "source"), lambda w: w["value"])
    return F.concat(
        head(F.lit("variable"), VARIABLE, 1), head(F.lit("module"), MODULE, 1),
        head(F.regexp_extract(piece, RESOURCE, 1), RESOURCE, 3, 2),
        names("define", "local", when("in_locals", every(F.regexp_replace(piece, STRING, " "), ASSIGNMENT))),
        names("source", "module", when("in_module", sources)),
    )


def references() -> Column:
    """References in the column ``text``."""
    def pairs(kind: str, pattern: str) -> Column:
        return F.zip_with(
            every("text", pattern, 1), every("text", pattern, 2),
            lambda type_name, name: fact("refer", F.lit(kind), type_name, name),
        )

    resources = F.filter(pairs("resource", TYPED_REFERENCE), lambda f: ~f["type_name"].isin(*KEYWORDS))
    return F.concat(
        *[names("refer", kind, every("text", pattern)) for kind, pattern in PLAIN_REFERENCES],
        pairs("data", DATA_REFERENCE), resources,
    )


def tf_facts(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct (change_id, file_idx, dir, role, kind, type_name, name).

    Roles are ``define``, ``refer`` and ``source``; type_name is '' where there is none.
    References count outside strings and inside the templates of strings and heredocs.
    """
    runs = code_runs(files, lines)
    rows = inside_block(inside_block(blocks(runs), LOCALS, "in_locals"), MODULE, "in_module")
    # In a heredoc a template may reach over several lines.
    text = F.concat_ws("\n", outside_strings(F.col("code")), *template_code(F.col("heredocs"), ""))
    key = ["change_id", "file_idx", "dir"]
    return (
        rows.select(*key, F.inline(definitions()))
        .unionByName(runs.withColumn("text", text).select(*key, F.inline(references())))
        .where("name <> ''").distinct()
    )


def named_edges(all_facts: DataFrame) -> DataFrame:
    """(change_id, importer, imported): references to names defined once in their directory."""
    key = ["change_id", "dir", "kind", "type_name", "name"]
    owners = all_facts.where("role = 'define'").groupBy(*key).agg(
        F.min("file_idx").alias("imported"), F.max("file_idx").alias("last")
    ).where("imported = last").drop("last")
    references = all_facts.where("role = 'refer'").withColumnRenamed("file_idx", "importer")
    return references.join(owners, key).where("importer <> imported").select("change_id", "importer", "imported").distinct()


def module_links(files: DataFrame, all_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Module source directories as links: (change_id, node, importer) and (change_id, node, imported)."""
    node = F.concat_ws(" ", F.lit("terraform"), "dir").alias("node")
    targets = (
        all_facts.where("role = 'source'").where(F.col("name").rlike(r"^\.\.?/"))
        .withColumn("target", normalize_path(join_path(F.col("dir"), F.col("name"))))
        .where(~F.col("target").rlike(r"^\.\.(/|$)"))
        .select("change_id", F.col("file_idx").alias("importer"), F.col("target").alias("dir"))
    )
    terraform = files.where(classify_language(F.col("path")) == "terraform").select(
        "change_id", F.col("file_idx").alias("imported"), directory(normalize_path(F.col("path"))).alias("dir")
    )
    return targets.select("change_id", node, "importer").distinct(), terraform.select("change_id", node, "imported")


def tf_edges(files: DataFrame, all_facts: DataFrame) -> DataFrame:
    """References to names defined once in their directory, and module source directories."""
    return all_edges(named_edges(all_facts), module_links(files, all_facts))
