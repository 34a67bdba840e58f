"""Other inputs: change metadata, attributes, blame, assets, catalog, snapshots, cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from changeloom.functions.paths import image_kind, repo_identity, safe_name
from changeloom.functions.text import delta_label, size_label
from changeloom.sources.shared import materialize
from changeloom.settings import DEFAULTS, SCHEMA_VERSION, Settings

PULL_REQUEST_SCHEMA = (
    "number INT, title STRING, body STRING, baseRefName STRING, headRefName STRING, "
    "baseRefOid STRING, headRefOid STRING, changedFiles INT, url STRING"
)
# The attribute that marks generated files and its positive values.
GENERATED_ATTRIBUTE = "linguist-generated"
GENERATED_VALUES = ("set", "true")


def change_meta(pull_requests: DataFrame) -> DataFrame:
    """Pull request records → ``changes`` rows."""
    return pull_requests.select(
        F.format_string("pr-%d", "number").alias("name"),
        F.format_string("PR #%d: %s", "number", "title").alias("title"),
        F.col("body").alias("description"),
        F.concat("baseRefName", F.lit(" ← "), "headRefName").alias("range"),
        "url",
        repo_identity(F.regexp_replace("url", r"/pull/\d+$", "")).alias("repo"),
    )


def read_change_meta(spark: SparkSession, path: str) -> DataFrame:
    return change_meta(spark.read.schema(PULL_REQUEST_SCHEMA).json(path))


def patch_meta(sections: DataFrame) -> DataFrame:
    """Patch files → ``changes`` rows: title and range are the file name."""
    base = F.regexp_extract("change_id", r"([^/]*)$", 1)
    return sections.select("change_id").distinct().select(
        "change_id", base.alias("title"), base.alias("range"),
        safe_name(F.regexp_replace(base, r"\.[^.]*$", "")).alias("name"),
    )


def generated_paths(attributes: DataFrame) -> DataFrame:
    """(change_id, path) of generated files."""
    hit = (F.col("attribute") == GENERATED_ATTRIBUTE) & F.lower("value").isin(*GENERATED_VALUES)
    return attributes.where(hit).select("change_id", "path").distinct()


def with_fallback(reviewed: DataFrame, worktree: DataFrame) -> DataFrame:
    """Attributes of the reviewed commit; a change without any takes the worktree's."""
    return reviewed.unionByName(
        worktree.join(reviewed.select("change_id").distinct(), "change_id", "left_anti")
    )


def attr_join(files: DataFrame, attributes: DataFrame) -> DataFrame:
    return files.join(generated_paths(attributes), ["change_id", "path"], "left_semi")


# Line marks of the blame porcelain format.
COMMIT_HEADER = r"(?md)^(?=[ \t]*[0-9a-f^]{8,}[ \t]+\S+[ \t]+\S+)"


def read_blame(reports: DataFrame) -> DataFrame:
    """(change_id, path, report) porcelain texts → one row per record, in record order."""
    record = F.col("record")

    def field(name: str) -> Column:
        found = F.regexp_extract_all(record, F.lit(f"(?md)^{name} (.*)$"), F.lit(1))
        return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))

    def stamp(name: str) -> Column:
        return F.coalesce(field(name).try_cast("bigint"), F.lit(0))

    return (
        reports.select(
            "change_id", "path", F.posexplode(F.split("report", COMMIT_HEADER)).alias("seq", "record")
        )
        .where(record.rlike(COMMIT_HEADER))
        .select(
            "change_id", "path", "seq",
            F.regexp_extract("record", r"^[ \t]*(\S+)", 1).alias("commit"),
            F.regexp_extract("record", r"^[ \t]*\S+[ \t]+\S+[ \t]+(\d+)", 1).try_cast("int").alias("line"),
            field("author").alias("author"),
            stamp("author-time").alias("author_ts"), field("author-tz").alias("author_tz"),
            stamp("committer-time").alias("committer_ts"), field("committer-tz").alias("committer_tz"),
        )
    )


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """(change_id, side, path, size) of ``<root>/change_id=<id>/side=<old|new>/<path>``.

    Only names and lengths are read, no contents. Folder names are percent-encoded as Spark
    writes partitions. Spark's file sources pass over files of no bytes: such a side is missing here.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    layout = r"^.*?/change_id=([^/]+)/side=(old|new)/(.+)$"
    change, side, path = (F.regexp_extract("path", layout, k) for k in (1, 2, 3))
    return found.where(F.col("path").rlike(layout)).select(
        F.url_decode(F.replace(change, F.lit("+"), F.lit("%2B"))).alias("change_id"), side.alias("side"),
        path.alias("path"), F.col("length").alias("size"),
    )


def size_story(path: Column, status: Column, old: Column, new: Column, settings: Settings) -> Column:
    """What is known about the two sides of a binary file."""
    kind = F.when(image_kind(path, settings.image_extensions), "Binary image").otherwise("Binary file")
    missing = (
        ((status == "added") & new.isNull())
        | ((status == "deleted") & old.isNull())
        | (~status.isin("added", "deleted") & (old.isNull() | new.isNull()))
    )
    story = (
        F.when(missing, "one or more sides unavailable")
        .when(old.isNull(), F.concat(F.lit("added "), size_label(new)))
        .when(new.isNull(), F.concat(F.lit("deleted "), size_label(old)))
        .otherwise(
            F.concat(size_label(old), F.lit(" → "), size_label(new), F.lit(" ("), delta_label(new - old), F.lit(")"))
        )
    )
    return F.concat(kind, F.lit(" · "), story)


def asset_inventory(
    files: DataFrame, old_side: DataFrame | None, new_side: DataFrame | None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Binary files with the sizes of both sides and a label.

    ``old_side`` and ``new_side`` are (change_id, path, size); added files have no old side
    and deleted files no new side. Without both (a patch alone) the label says that the content
    is not there.
    """
    if old_side is None and new_side is None:
        size = F.lit(None).cast("bigint")
        image = image_kind(F.col("path"), settings.image_extensions)
        kind = F.when(image, "Binary image").otherwise("Binary file")
        return files.where("binary").select(
            "change_id", "file_idx", "path", "status", image.alias("image"), size.alias("old_size"),
            size.alias("new_size"), F.concat(kind, F.lit(" · content not available from patch input.")).alias("label"),
        )
    empty = files.where(F.lit(False)).select("change_id", "path", F.lit(0).cast("bigint").alias("size"))
    old_side, new_side = (empty if side is None else side for side in (old_side, new_side))
    old = old_side.select("change_id", F.col("path").alias("old_path"), F.col("size").alias("old_size"))
    new = new_side.select("change_id", F.col("path").alias("new_path"), F.col("size").alias("new_size"))
    joined = files.where("binary").join(old, ["change_id", "old_path"], "left").join(
        new, ["change_id", "new_path"], "left"
    )
    old_size = F.when(F.col("status") != "added", F.col("old_size"))
    new_size = F.when(F.col("status") != "deleted", F.col("new_size"))
    return joined.select(
        "change_id", "file_idx", "path", "status",
        image_kind(F.col("path"), settings.image_extensions).alias("image"),
        old_size.alias("old_size"), new_size.alias("new_size"),
        size_story(F.col("path"), F.col("status"), old_size, new_size, settings).alias("label"),
    )


def catalog_scan(
    pull_requests: DataFrame, branches: DataFrame, commits: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Union of open pull requests, branches ahead of their base and the newest commits.

    Inputs: (number, title, updated_at), (name, base, ahead, committed_at, subject) and
    (hash, short_hash, committed_at, subject). ``sort_key`` orders a kind, newest first. The
    limit counts per repository where the inputs have such a column, and it is kept.
    """
    limit = settings.list_limit

    def first(frame: DataFrame, *order: Column) -> DataFrame:
        if "repository" not in frame.columns:
            return frame.orderBy(*order).limit(limit)
        place = F.row_number().over(Window.partitionBy("repository").orderBy(*order))
        return frame.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")

    def keys(frame: DataFrame) -> list[str]:
        return [c for c in frame.columns if c == "repository"]

    number = F.col("number").cast("string")
    prs = (
        first(pull_requests, F.desc("updated_at"), F.desc("number"))
        .select(
            *keys(pull_requests),
            F.lit("pr").alias("kind"),
            F.concat(F.lit("#"), number, F.lit("  "), "title").alias("label"),
            F.concat_ws(" ", number, "title").alias("search"),
            number.alias("ref"), F.col("updated_at").cast("long").alias("sort_key"),
        )
    )
    short_base = F.regexp_replace("base", "^origin/", "")
    ahead = branches.where((F.col("ahead") > 0) & (F.col("name") != short_base)).select(
        *keys(branches),
        F.lit("branch").alias("kind"),
        F.format_string("%s  (%d ahead)  %s", "name", "ahead", "subject").alias("label"),
        F.concat_ws(" ", "name", "subject").alias("search"),
        F.col("name").alias("ref"), F.col("committed_at").cast("long").alias("sort_key"),
    )
    newest = (
        first(commits, F.desc("committed_at"), F.desc("hash"))
        .select(
            *keys(commits),
            F.lit("commit").alias("kind"),
            F.concat_ws("  ", "short_hash", "subject").alias("label"),
            F.concat_ws(" ", "hash", "short_hash", "subject").alias("search"),
            F.col("hash").alias("ref"), F.col("committed_at").cast("long").alias("sort_key"),
        )
    )
    return prs.unionByName(ahead).unionByName(newest)


def catalog_search(catalog: DataFrame, query: str, settings: Settings = DEFAULTS) -> DataFrame:
    """First rows per kind, and repository if there is one, that contain the query, with the number of hidden ones.

    The row-number limit lets Spark keep only the first rows of each partition before the
    shuffle; the totals are combined on the map side.
    """
    needle = query.strip().lower()
    haystack = F.lower(F.concat_ws(" ", "search", "label"))
    hits = catalog.where(haystack.contains(needle)) if needle else catalog
    key = [c for c in ("repository", "kind") if c in catalog.columns]
    order = Window.partitionBy(*key).orderBy(F.desc("sort_key"), "ref")
    shown = hits.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= settings.section_limit
    )
    totals = hits.groupBy(*key).agg(F.count("*").alias("matches"))
    return shown.join(totals, key).select(
        *key, "position", "label", "ref",
        F.greatest(F.col("matches") - settings.section_limit, F.lit(0)).alias("hidden"),
    )


def snapshot_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change_id, path, digest) of two snapshots → changed files and exact renames.

    A rename is a content that was deleted exactly once and added exactly once in the
    change. Contents are counted before they are joined, so many copies of one content
    never meet each other.
    """
    key = ["change_id", "path"]
    both = old.withColumnRenamed("digest", "old_digest").join(
        new.withColumnRenamed("digest", "new_digest"), key, "full_outer"
    )
    status = (
        F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "deleted")
        .when(F.col("old_digest") != F.col("new_digest"), "modified")
    )
    changed = both.withColumn("status", status).where("status is not null")
    by_content = (
        changed.where("status <> 'modified'")
        .withColumn("digest", F.coalesce("old_digest", "new_digest"))
        .groupBy("change_id", "digest")
        .agg(
            F.count_if(F.col("status") == "deleted").alias("gone"),
            F.count_if(F.col("status") == "added").alias("come"),
            F.max(F.when(F.col("status") == "deleted", F.col("path"))).alias("from_path"),
            F.max(F.when(F.col("status") == "added", F.col("path"))).alias("to_path"),
        )
        .where("gone = 1 AND come = 1")
    )
    renamed = by_content.select(
        "change_id", F.col("to_path").alias("path"), F.col("from_path").alias("old_path"),
        F.lit("renamed").alias("status"), F.lit(100).alias("similarity"),
    )
    sides = by_content.select(
        "change_id", F.explode(F.array("from_path", "to_path")).alias("path")
    )
    plain = changed.join(sides, key, "left_anti").select(
        "change_id", "path", F.col("path").alias("old_path"), "status", F.lit(0).alias("similarity")
    )
    return plain.unionByName(renamed)


def similar_renames(gone: DataFrame, come: DataFrame, percent: int) -> DataFrame:
    """(change_id, old_path, path, similarity) of deleted and added files that share most lines.

    Inputs are the lines (change_id, path, text) of deleted and of added files. Similarity is the
    share, in whole per cent, of the larger file's bytes whose lines both files hold. Files meet only
    over their rarest lines: the lines beyond a file's prefix are too few bytes to reach the
    threshold without one of it, so lines that every file holds bring no files together. Of the
    pairs at the threshold the most similar come first, then by paths; each file is taken once.
    """
    key = ["change_id", "path"]
    sides = gone.select(*key, "text", F.lit(0).alias("side")).unionByName(come.select(*key, "text", F.lit(1).alias("side")))
    mark = F.xxhash64("text", F.lit(1)), F.xxhash64("text", F.lit(2))
    held = sides.groupBy(*key, "side", mark[0].alias("m"), mark[1].alias("m2"), F.octet_length("text").alias("bytes")).agg(F.count("*").alias("n"))
    held = materialize(held.withColumn("weight", F.col("n") * (F.col("bytes") + 1)), "rename-lines")
    line = ["change_id", "m", "m2", "bytes"]
    common = held.groupBy(*line).agg(F.count("*").alias("files"))
    rare = Window.partitionBy(*key, "side").orderBy("files", "m", "m2", "bytes")
    whole = Window.partitionBy(*key, "side")
    listed = held.join(common, line).withColumn("size", F.sum("weight").over(whole)).withColumn("upto", F.sum("weight").over(rare))
    prefix = listed.where(100 * (F.col("size") - F.col("upto") + F.col("weight")) >= percent * F.col("size"))
    end = lambda frame, side, path: frame.where(F.col("side") == side).select(*line, F.col("path").alias(path))
    pairs = end(prefix, 0, "old_path").join(end(prefix, 1, "new_path"), line).select("change_id", "old_path", "new_path").distinct()
    pairs = materialize(pairs, "rename-pairs")
    lines = lambda side, path, n: held.where(F.col("side") == side).select(*line, F.col("path").alias(path), F.col("n").alias(n))
    size = lambda side, path, name: held.where(F.col("side") == side).groupBy("change_id", F.col("path").alias(path)).agg(F.sum("weight").alias(name))
    shared = (
        pairs.join(lines(0, "old_path", "n_old"), ["change_id", "old_path"])
        .join(lines(1, "new_path", "n_new"), [*line, "new_path"])
        .groupBy("change_id", "old_path", "new_path").agg(F.sum(F.least("n_old", "n_new") * (F.col("bytes") + 1)).alias("shared"))
    )
    larger = F.greatest("old_size", "new_size")
    scored = (
        shared.join(size(0, "old_path", "old_size"), ["change_id", "old_path"]).join(size(1, "new_path", "new_size"), ["change_id", "new_path"])
        .where(100 * F.col("shared") >= percent * larger)
        .select("change_id", "old_path", "new_path", F.floor(100 * F.col("shared") / larger).cast("int").alias("similarity"))
    )
    return one_to_one(materialize(scored, "rename-scores")).withColumnRenamed("new_path", "path")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs in falling similarity, each file once: in a round a pair stays that is the first of both its files."""
    left, taken = pairs, None
    first = F.struct(-F.col("similarity"), "old_path", "new_path")
    while taken is None or not left.isEmpty():
        best = lambda path: left.groupBy("change_id", path).agg(F.min(first).alias(f"best_{path}"))
        judged = left.join(best("old_path"), ["change_id", "old_path"]).join(best("new_path"), ["change_id", "new_path"])
        chosen = materialize(judged.where(F.col("best_old_path") == F.col("best_new_path")).where(F.col("best_old_path") == first).select(pairs.columns), "renames")
        taken = chosen if taken is None else taken.unionByName(chosen)
        left = materialize(
            left.join(chosen.select("change_id", "old_path"), ["change_id", "old_path"], "left_anti")
            .join(chosen.select("change_id", "new_path"), ["change_id", "new_path"], "left_anti").select(pairs.columns), "rename-rest",
        )
    return taken


def match_remote(changes: DataFrame, remotes: DataFrame) -> DataFrame:
    """The remote of a change's repository: first with its identity, else the only one.

    ``changes`` is (change_id, repo, url), ``remotes`` (repo, pos, remote, url). A change
    without a match gets a null remote and an error text.
    """
    identified = remotes.withColumn("identity", F.lower(repo_identity(F.col("url"))))
    first = identified.groupBy("repo", "identity").agg(F.min_by("remote", "pos").alias("match"))
    only = remotes.groupBy("repo").agg(F.count("*").alias("n"), F.max("remote").alias("single"))
    target = F.lower(repo_identity(F.col("url")))
    remote = F.coalesce(
        F.when(F.col("identity") != "", F.col("match")), F.when(F.col("n") == 1, F.col("single"))
    )
    error = (
        F.when(remote.isNotNull(), None)
        .when(F.col("n").isNull(), "local repository has no git remotes")
        .otherwise(F.concat(F.lit("no git remote matches PR repository "), "identity"))
    )
    return (
        changes.withColumn("identity", target)
        .join(first, ["repo", "identity"], "left")
        .join(only, "repo", "left")
        .select("change_id", remote.alias("remote"), error.alias("error"))
    )


def cache_folder(key: Column) -> Column:
    """The store's folder of a key: its first two hexadecimal digits, ``other`` for any other key."""
    return F.coalesce(F.nullif(F.regexp_extract(key, "^[0-9a-f]{2}", 0), F.lit("")), F.lit("other"))


def append_cache(entries: DataFrame, root: str) -> None:
    """Append entries (key, ...) to the store, by folder and in key order within a file.

    Adaptive execution splits a folder with many entries over tasks and joins small ones.
    """
    placed = entries.withColumn("folder", cache_folder(F.col("key"))).hint("rebalance", "folder")
    placed.sortWithinPartitions("folder", "key").write.mode("append").partitionBy("folder").parquet(root)


def asked_entries(spark: SparkSession, root: str, schema: StructType, requests: DataFrame) -> DataFrame:
    """Stored entries of the keys in ``requests``; a store that does not exist yet has none.

    Only the folders of these keys are listed to the scan: at most 257 names come to the driver.
    Within them a semi join leaves the asked keys before any entry is aggregated.
    """
    folders = [row.folder for row in requests.select(cache_folder(F.col("key")).alias("folder")).distinct().collect()]
    try:
        store = spark.read.schema(StructType([*schema, StructField("folder", StringType())])).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    asked = requests.select("key").distinct()
    return store.where(F.col("folder").isin(folders)).drop("folder").join(asked, "key", "left_semi").select(schema.names)


def cache_lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests with the usable stored entry of their key, null when it must be computed.

    The store is reduced to the newest usable entry per key first, so that a key with many
    copies on both sides stays one match per request.
    """
    usable = entries.where((F.col("schema_version") == SCHEMA_VERSION) & F.col("staged").isNotNull())
    newest = usable.groupBy("key").agg(
        F.max(F.struct("mtime", "path", "staged")).alias("entry")
    )
    return requests.join(newest, "key", "left").select(
        requests["*"], F.col("entry.path").alias("entry_path"),
        F.col("entry.staged").alias("entry_staged"), F.col("entry").isNotNull().alias("cached"),
    )


def cache_prune(entries: DataFrame, max_entries: int, store: list[str] | None = None) -> DataFrame:
    """The newest entries of every store, later paths first among equals; 0 keeps everything.

    ``store`` names the columns that tell stores apart; without it the table is one store.
    """
    if max_entries == 0:
        return entries
    order = [F.desc("mtime"), F.desc("path")]
    if not store:
        return entries.orderBy(*order).limit(max_entries)
    place = F.row_number().over(Window.partitionBy(*store).orderBy(*order))
    return entries.withColumn("_place", place).where(F.col("_place") <= max_entries).drop("_place")
