"""Resolve import targets to files of the same change, and build the dependency edges.

All indexes are keyed tables reduced to one row per key before they are joined, so a key
which many files share never multiplies the importers that ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.paths import (
    ALIAS_EXTENSIONS, base_name, classify_language, directory, extension,
    language_family, normalize_path, path_suffixes, platform_module, without_extension,
)
from changeloom.functions.imports import MIN_SYMBOL_BYTES, exported_defs, identifier_tokens, import_specifiers
from changeloom.operators.aggregate import unique_definitions
from changeloom.operators.links import all_edges, asked_members, expand_links  # noqa: F401
from changeloom.operators.terraform import module_links, named_edges, tf_facts
from changeloom.sources.shared import materialize

# Order in which the lookups of one target are tried.
EXACT, MODULE, PLATFORM, MODULE_STEM, SUFFIX, SUFFIX_STEM, ALIAS = range(1, 8)


def file_index(files: DataFrame) -> DataFrame:
    """Files with the names under which they can be found."""
    path = F.col("norm")
    return (
        files.select("change_id", "file_idx", "path")
        .withColumn("norm", normalize_path(F.col("path")))
        .withColumn("stem", without_extension(path))
        .withColumn("dir", directory(path))
        .withColumn("language", classify_language(F.col("path")))
        .withColumn("family", language_family(F.col("language")))
    )


def module_keys(index: DataFrame) -> DataFrame:
    """Distinct (change_id, key, file_idx, family): path, stem, and directory of index files."""
    names = F.array(F.col("norm"), F.col("stem"), F.when(base_name(F.col("stem")).isin("index", "__init__"), directory(F.col("stem"))))
    keys = F.array_distinct(F.filter(names, lambda k: k.isNotNull() & (k != "")))
    return index.select("change_id", F.explode(keys).alias("key"), "file_idx", "family")


def platform_keys(index: DataFrame) -> DataFrame:
    """Distinct (change_id, key, file_idx) of platform variants of JavaScript modules."""
    module = platform_module(F.col("stem"))
    folder = F.when(base_name(module) == "index", directory(module))
    keys = F.array_distinct(F.array_compact(F.array(module, folder)))
    return index.where("language = 'javascript'").select(
        "change_id", F.explode(keys).alias("key"), "file_idx"
    )


def key_stats(keys: DataFrame) -> DataFrame:
    """One row per key: number of files, one of them, and the same per language family."""
    per_family = keys.groupBy("change_id", "key", "family").agg(
        F.count("*").alias("n"), F.min("file_idx").alias("one")
    )
    return per_family.groupBy("change_id", "key").agg(
        F.sum("n").alias("n"), F.min("one").alias("one"),
        F.collect_list(F.struct("family", "n", "one")).alias("families"),
    )


def suffix_match(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """(change_id, query, key): the only key that ends in the query or that the query ends in.

    Both sides explode into component suffixes and meet in two equi joins; a query with two
    matching keys has no match.
    """
    names = keys.select("change_id", "key").distinct()
    ends = names.select("change_id", F.explode(path_suffixes(F.col("key"))).alias("query"), "key")
    longer = ends.groupBy("change_id", "query").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shorter = (
        queries.select("change_id", "query", F.explode(path_suffixes(F.col("query"))).alias("key"))
        .join(names, ["change_id", "key"])
        .groupBy("change_id", "query").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    )
    both = queries.join(longer, ["change_id", "query"]).unionByName(shorter)
    return (
        both.groupBy("change_id", "query").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low = high").select("change_id", "query", F.col("low").alias("key"))
    )


def python_target(folder: Column, specifier: Column) -> Column:
    """Module path of a Python import; null when its dots climb out of the tree."""
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    parts = F.split(folder, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(depth - dots + 1, F.lit(0))), "/")
    joined = F.when(base == "", rest).when(rest == "", base).otherwise(F.concat(base, F.lit("/"), rest))
    return F.when(dots == 0, rest).when(dots - 1 > depth, None).otherwise(joined)


def import_queries(files: DataFrame, specifiers: DataFrame) -> DataFrame:
    """Import targets of each file, brought to the form in which they are looked up."""
    importers = file_index(files).select(
        "change_id", "file_idx", "language", "family", F.col("dir").alias("folder"),
        F.lower(extension(F.col("path"))).isin(*ALIAS_EXTENSIONS).alias("alias_file"),
    )
    rows = specifiers.join(importers, ["change_id", "file_idx"])
    spec = F.col("specifier")
    bare = F.regexp_replace(spec, r"[?#].*$", "")
    markup = F.col("language").isin("html", "css")
    relative = F.when(F.col("language") == "javascript", bare.startswith(".")).otherwise(spec.startswith("."))
    near = markup | (F.col("language") == "javascript") & bare.startswith(".")
    target = (
        F.when(near, F.concat_ws("/", F.nullif("folder", F.lit("")), bare))
        .when(F.col("language") == "javascript", bare)
        .when(F.col("language") == "python", python_target(F.col("folder"), spec))
        .otherwise(spec)
    )
    rows = rows.withColumn("query", normalize_path(target)).withColumn("relative", relative)
    alias = (F.col("language") == "javascript") & F.col("alias_file")
    nameless = alias & ~F.col("relative") & ~F.col("query").contains("/")
    targets = (
        rows.withColumn("alias", alias)
        .where(F.col("query").isNotNull() & (F.col("query") != "") & ~F.col("query").rlike(r"^\.\.(/|$)") & ~nameless)
        .select("change_id", F.col("file_idx").alias("importer"), "language", "family", "specifier",
                "query", "relative", "alias")
    )
    return targets


def resolve_modules(files: DataFrame, queries: DataFrame) -> DataFrame:
    """(change_id, importer, imported, via) of all targets which name one file.

    Each target is looked up under several keys at once; the first lookup with an answer
    decides, even when its answer is ambiguous.
    """
    index = file_index(files)
    modules = module_keys(index)
    exact = key_stats(index.select("change_id", F.col("norm").alias("key"), "file_idx", "family"))
    by_module = key_stats(modules)
    platforms = platform_keys(index)
    whole = ~((F.col("language") == "go") | (F.col("family") == "jvm") & F.col("query").endswith("/*"))
    asked = queries.where(whole)
    query = F.col("query")
    stem = without_extension(query)
    headless = F.regexp_replace(stem, r"^[@~][^/]*/", "")
    explicit = extension(query) != ""
    markup = F.col("language").isin("html", "css")
    module = ~markup
    free = module & ~F.col("relative")

    def lookup(step: int, kind: str, key: Column, condition: Column) -> Column:
        return F.when(condition, F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), key.alias("key")))

    steps = F.array_compact(
        F.array(
            lookup(EXACT, "exact", query, markup | explicit),
            lookup(MODULE, "module", query, module),
            lookup(PLATFORM, "platform", query, module & ~explicit & (F.col("language") == "javascript")),
            lookup(MODULE_STEM, "module", stem, module & (stem != query)),
            lookup(SUFFIX, "suffix", query, free & explicit),
            lookup(SUFFIX_STEM, "suffix", stem, free),
            lookup(ALIAS, "suffix", headless, free & F.col("alias") & (headless != stem)),
        )
    )
    lookups = asked.withColumn("lookup", F.explode(steps)).select(
        "change_id", "importer", "family", "specifier", "lookup.step", "lookup.kind", "lookup.key"
    )
    suffix_queries = lookups.where("kind = 'suffix'").select("change_id", F.col("key").alias("query")).distinct()
    by_suffix = (
        suffix_match(modules, suffix_queries).join(by_module, ["change_id", "key"])
        .drop("key").withColumnRenamed("query", "key")
    )
    by_platform = platforms.select("change_id", "key").distinct().select(
        "change_id", "key", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("one"),
        F.array().cast(by_module.schema["families"].dataType).alias("families"),
    )
    answers = None
    for kind, stats in (("exact", exact), ("module", by_module), ("suffix", by_suffix), ("platform", by_platform)):
        tagged = stats.select("change_id", "key", F.lit(kind).alias("kind"), "n", "one", "families")
        answers = tagged if answers is None else answers.unionByName(tagged)
    own = F.filter("families", lambda f: f["family"] == F.col("family"))
    own_one = F.when(F.try_element_at(own, F.lit(1))["n"] == 1, F.try_element_at(own, F.lit(1))["one"])
    any_one = F.when(F.col("n") == 1, F.col("one"))
    result = F.when(F.col("step").isin(EXACT, SUFFIX), any_one).otherwise(own_one)
    hits = lookups.join(answers, ["change_id", "kind", "key"]).withColumn("result", result)
    hits = hits.where(~F.col("step").isin(SUFFIX_STEM, ALIAS) | F.col("result").isNotNull())
    first = hits.groupBy("change_id", "importer", "specifier").agg(
        F.min(F.struct("step", "result")).alias("best")
    )
    via = (
        F.when(F.col("best.step") <= MODULE_STEM, "exact").when(F.col("best.step") <= SUFFIX_STEM, "suffix")
        .otherwise("alias")
    )
    single = first.where("best.result IS NOT NULL").select(
        "change_id", "importer", F.col("best.result").alias("imported"), via.alias("via")
    )
    # Every platform variant counts, next to the generic file if there is one.
    variants = lookups.where(F.col("step") == PLATFORM).join(platforms, ["change_id", "key"]).select(
        "change_id", "importer", F.col("file_idx").alias("imported"), F.lit("platform").alias("via")
    )
    return single.unionByName(variants).where("importer <> imported").distinct()


def directory_links(files: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Package imports as a graph in two parts: (change_id, node, importer) and (change_id, node, imported).

    A node stands for a directory, or for all directories that end in a package name. It keeps
    importers and files apart, so both sides grow with their rows and not with their product. The
    nodes of one importer share no file.
    """
    index = file_index(files).where("dir <> ''")
    folders = index.select("change_id", F.col("dir").alias("key"), "file_idx", "family")
    go = queries.where("language = 'go'").select("change_id", "importer", "family", "query").distinct()
    wanted = go.select("change_id", "query").distinct()
    names = folders.select("change_id", "key").distinct()
    same = wanted.join(names.withColumn("query", F.col("key")), ["change_id", "query"])
    rest = wanted.join(same, ["change_id", "query"], "left_anti")
    matched = same.unionByName(suffix_match(folders, rest).select(same.columns))
    packages = go.join(matched, ["change_id", "query"]).select("change_id", "importer", "family", "key")
    stars = (
        queries.where("family = 'jvm' AND query LIKE '%/*'")
        .select("change_id", "importer", "family", F.regexp_replace("query", r"/\*$", "").alias("key")).distinct()
    )
    # What a shorter ending of the same importer covers needs no second node.
    shorter = stars.withColumn("longer", F.col("key")).select("change_id", "importer", "family", "longer", F.explode(path_suffixes(F.col("key"))).alias("key"))
    covered = shorter.where("key <> longer").join(stars, ["change_id", "importer", "family", "key"], "left_semi").select(
        "change_id", "importer", "family", F.col("longer").alias("key")
    )
    stars = stars.join(covered, ["change_id", "importer", "family", "key"], "left_anti")
    node = lambda kind: F.concat_ws(" ", F.lit(kind), "family", "key").alias("node")
    asks = packages.select("change_id", node("dir"), "importer").unionByName(stars.select("change_id", node("end"), "importer"))
    endings = folders.where("family = 'jvm'").select("change_id", F.explode(path_suffixes(F.col("key"))).alias("key"), "file_idx", "family")
    imported = F.col("file_idx").alias("imported")
    members = folders.select("change_id", node("dir"), imported).unionByName(endings.select("change_id", node("end"), imported))
    return asks.distinct(), members


def resolve_directory(files: DataFrame, queries: DataFrame) -> DataFrame:
    """Package imports: every file of the directory in the importer's language family."""
    return expand_links(directory_links(files, queries)).withColumn("via", F.lit("directory"))


def symbol_edges(definitions: DataFrame, tokens: DataFrame) -> DataFrame:
    """File that names a symbol → the only file of the change that exports it."""
    owners = unique_definitions(definitions).withColumnRenamed("file_idx", "imported")
    return (
        tokens.withColumnRenamed("file_idx", "importer").join(owners, ["change_id", "symbol"])
        .where("importer <> imported").select("change_id", "importer", "imported").distinct()
    )


def import_graph(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """(change_id, importer, imported) of single imports, Terraform names and symbols, and imports of whole directories as links."""
    # The targets feed several joins, so they are written once: the scan of the texts behind
    # them is not repeated, and the plan stays small.
    queries = materialize(import_queries(files, import_specifiers(files, lines)), "import-targets")
    edge = ["change_id", "importer", "imported"]
    symbols = symbol_edges(exported_defs(files, lines), identifier_tokens(lines, MIN_SYMBOL_BYTES))
    facts = materialize(tf_facts(files, lines), "terraform-facts")
    single = resolve_modules(files, queries).select(edge).unionByName(symbols).unionByName(named_edges(facts))
    packages, modules = directory_links(files, queries), module_links(files, facts)
    return single, tuple(x.unionByName(y) for x, y in zip(packages, modules))


def build_edges(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct (change_id, importer, imported) from imports, Terraform facts and symbols."""
    return all_edges(*import_graph(files, lines))
