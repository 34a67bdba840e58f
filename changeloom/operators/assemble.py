"""From accepted answers to one analysis document per change."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.operators.aggregate import FILE
from changeloom.operators.ranking import ordered_list, rank_rows
from changeloom.settings import DEFAULTS, GENERATOR, SCHEMA_VERSION, Settings
from changeloom.sources.shared import materialize

# Texts of the cohort for files that no answer placed.
LEFTOVER = {
    "title": "Other changes",
    "layer": "other",
    "intent": "Files the analysis did not assign to a cohort.",
    "narrative": "Review these unassigned files after the model-defined cohorts.",
    "summary": "No model summary was available for this file.",
}
OP_FIELDS = ("op", "into", "from", "cohort", "title")


def dedupe_notes(first: Column, second: Column) -> Column:
    """Ordered union of two lists, first occurrence wins."""
    return F.array_distinct(F.concat(first, second))


def leftover_files(files: DataFrame, assigned: DataFrame, bounded: bool = True) -> DataFrame:
    """Files in no cohort, as one more cohort behind the others."""
    rest = files.select(*FILE).join(assigned.select(*FILE), FILE, "left_anti")
    last = assigned.groupBy("change_id").agg((F.max("cohort_idx") + 1).alias("cohort_idx"))
    placed = rank_rows(rest, ["change_id"], ["file_idx"], "pos", bounded=bounded).join(last, "change_id", "left")
    return placed.select(
        "change_id", F.coalesce("cohort_idx", F.lit(0)).alias("cohort_idx"), "pos", "file_idx",
        F.lit(LEFTOVER["title"]).alias("title"), F.lit(LEFTOVER["layer"]).alias("layer"),
        F.lit(LEFTOVER["summary"]).alias("summary"),
    )


def remap_deps(deps: DataFrame, numbers: DataFrame) -> DataFrame:
    """Dependencies by new cohort numbers: earlier ones only, each once, in given order.

    ``deps`` is (change_id, old_idx, pos, old_dep), ``numbers`` (change_id, old_idx,
    cohort_idx).
    """
    target = numbers.select("change_id", F.col("old_idx").alias("old_dep"), F.col("cohort_idx").alias("dep_idx"))
    renamed = deps.join(numbers, ["change_id", "old_idx"]).join(target, ["change_id", "old_dep"])
    once = renamed.where("dep_idx < cohort_idx").groupBy("change_id", "cohort_idx", "dep_idx").agg(
        F.min("pos").alias("first")
    )
    return rank_rows(once, ["change_id", "cohort_idx"], ["first"], "rank").drop("first")


def flag_join(files: DataFrame, stubbed: DataFrame, mechanical: DataFrame) -> DataFrame:
    """Add the booleans stubbed and mechanical from index lists (change_id, file_idx)."""
    def mark(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*FILE).distinct().withColumn(name, F.lit(True))

    return (
        files.join(mark(stubbed, "stubbed"), FILE, "left").join(mark(mechanical, "mechanical"), FILE, "left")
        .fillna(False, ["stubbed", "mechanical"])
    )


def decode_ops(answers: DataFrame) -> DataFrame:
    """(change_id, ops JSON array) → one row per operation, with a reason when it is invalid."""
    items = answers.select(
        "change_id", F.posexplode(F.from_json("ops", "array<string>")).alias("op_idx", "item")
    ).withColumn("v", F.try_parse_json("item"))
    fields = F.from_json("item", "map<string,string>")
    unknown = F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(f) for f in OP_FIELDS])))

    def part(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "variant")

    def wrong(name: str, kind: str) -> Column:
        value = part(name)
        present = value.isNotNull() & ~F.is_variant_null(value)
        return present & (F.schema_of_variant(value) != kind)

    invalid = F.when(F.size(unknown) > 0, F.concat(F.lit('unknown field "'), unknown[0], F.lit('"')))
    for name in OP_FIELDS:
        kind = "STRING" if name in ("op", "title") else "BIGINT"
        invalid = invalid.when(wrong(name, kind), f"{name} has an invalid value")
    not_object = F.schema_of_variant("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT")
    number = lambda name: F.try_variant_get("v", f"$.{name}", "int")
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    return items.select(
        "change_id", "op_idx", text("op").alias("op"), number("into").alias("into"),
        number("from").alias("from"), number("cohort").alias("cohort"), text("title").alias("title"),
        F.when(not_object, "not an object").otherwise(invalid).alias("invalid"),
    )


def ops_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Outcome of the few operations of one change.

    ``kind`` is ``skip`` (reason), ``member`` (cohort, its root and place in it) or ``title``.
    """
    rows = rows.sort_values("op_idx")
    count = int(rows["cohorts"].iloc[0])
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    out: list[tuple] = []
    titles: dict[int, str] = {}

    def top(index: int) -> int:
        while index in root:
            index = root[index]
        return index

    def known(index) -> bool:
        return 0 <= index < count

    def refuse(row, reason: str) -> None:
        out.append(("skip", int(row.op_idx), None, None, reason))

    for row in rows.itertuples(index=False):
        into, source, cohort = row.into, row.source, row.cohort
        if row.op == "merge":
            if pd.isna(into) or pd.isna(source):
                refuse(row, "merge requires into and from indexes")
            elif not (known(into) and known(source)):
                refuse(row, "merge index is out of range")
            elif int(source) in root:
                refuse(row, f"from cohort {int(source)} was already merged")
            elif top(int(into)) == int(source):
                refuse(row, "merge resolves to the same cohort")
            else:
                keep, gone = top(int(into)), int(source)
                members.setdefault(keep, [keep]).extend(members.pop(gone, [gone]))
                root[gone] = keep
        elif row.op == "retitle":
            if pd.isna(cohort):
                refuse(row, "retitle requires a cohort index")
            elif not known(cohort):
                refuse(row, "retitle index is out of range")
            elif pd.isna(row.title) or not row.title.strip():
                refuse(row, "retitle title is empty")
            else:
                titles[top(int(cohort))] = row.title
        else:
            refuse(row, f'unknown operation "{row.op or ""}"')
    for keep, parts in members.items():
        out += [("member", int(part), keep, place, None) for place, part in enumerate(parts)]
    out += [("title", int(index), None, None, title) for index, title in titles.items() if index not in root]
    frame = pd.DataFrame(out, columns=["kind", "idx", "root", "place", "text"])
    frame.insert(0, "change_id", rows["change_id"].iloc[0])
    return frame.astype({"idx": "Int64", "root": "Int64", "place": "Int64"})


def cohort_ops(ops: DataFrame, counts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Outcome rows of merge and retitle operations; ``counts`` is (change_id, cohorts).

    Operations beyond the cap and undecodable ones are refused in Spark, so a group in
    Python holds at most the cap of operations, whatever the size of the change.
    """
    over = F.col("op_idx") >= settings.max_cohort_ops
    reason = F.when(over, f"operation cap is {settings.max_cohort_ops}").otherwise(F.col("invalid"))
    refused = ops.withColumn("text", reason).where("text IS NOT NULL").select(
        "change_id", F.lit("skip").alias("kind"), F.col("op_idx").cast("bigint").alias("idx"),
        F.lit(None).cast("bigint").alias("root"), F.lit(None).cast("bigint").alias("place"), "text",
    )
    usable = ops.where(~over & F.col("invalid").isNull()).withColumnRenamed("from", "source").drop("invalid")
    applied = usable.join(counts, "change_id").groupBy("change_id").applyInPandas(
        ops_group, "change_id string, kind string, idx bigint, root bigint, place bigint, text string"
    )
    return refused.unionByName(applied)


def apply_cohort_ops(cohort_files: DataFrame, narrations: DataFrame, outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cohort files and narrations after the operations, with dense new cohort numbers."""
    members = outcome.where("kind = 'member'").select(
        "change_id", F.col("idx").cast("int").alias("cohort_idx"), F.col("root").cast("int").alias("root"),
        F.col("place").cast("int").alias("place"),
    )
    titles = outcome.where("kind = 'title'").select(
        "change_id", F.col("idx").cast("int").alias("root"), F.col("text").alias("new_title")
    )
    key = ["change_id", "cohort_idx"]

    def rooted(frame: DataFrame) -> DataFrame:
        return frame.join(members, key, "left").withColumn("root", F.coalesce("root", "cohort_idx")).withColumn(
            "place", F.coalesce("place", F.lit(0))
        )

    told = rooted(narrations)
    every = F.flatten(ordered_list(["place"], "review_notes")["review_notes"])
    notes = F.when(F.count("*") > 1, F.array_distinct(every)).otherwise(every)
    own = lambda name: F.max(F.when(F.col("cohort_idx") == F.col("root"), F.col(name)))
    merged = told.groupBy("change_id", "root").agg(
        notes.alias("review_notes"), own("title").alias("title"), own("intent").alias("intent"),
        own("narrative").alias("narrative"), own("layer").alias("layer"), F.max("stubbed").alias("stubbed"),
    )
    merged = merged.join(titles, ["change_id", "root"], "left").withColumn(
        "title", F.coalesce("new_title", "title")
    ).drop("new_title")
    numbered = rank_rows(merged, ["change_id"], ["root"], "cohort_idx")
    numbers = numbered.select("change_id", "root", "cohort_idx")
    placed = rooted(cohort_files).drop("cohort_idx").join(numbers, ["change_id", "root"])
    files = rank_rows(
        placed.withColumnRenamed("pos", "old_pos"), key, ["place", "old_pos"], "pos"
    ).drop("place", "old_pos", "root")
    return files, numbered.drop("root")


def assemble_analysis(
    cohort_files: DataFrame, narrations: DataFrame, summaries: DataFrame, deps: DataFrame, whole: bool = True
) -> DataFrame:
    """(change_id, cohorts): nested cohorts with parallel file and summary lists.

    A cohort is bounded by its planned size, so its lists are short; a change's list holds
    its cohorts. Without ``whole`` there is one row per cohort, (change_id, cohort_idx, cohort).
    """
    texts = cohort_files.select("change_id", "cohort_idx", "pos", "file_idx").join(
        summaries.select(*FILE, "summary"), FILE, "left"
    ).withColumn("summary", F.coalesce("summary", F.lit("")))
    members = texts.groupBy("change_id", "cohort_idx").agg(
        ordered_list(["pos"], "file_idx", "summary").alias("m")
    )
    below = deps.groupBy("change_id", "cohort_idx").agg(ordered_list(["rank"], "dep_idx")["dep_idx"].alias("depends_on"))
    rows = (
        members.join(narrations, ["change_id", "cohort_idx"])
        .join(below, ["change_id", "cohort_idx"], "left")
        .select(
            "change_id", "cohort_idx",
            F.struct(
                "title", "layer", "intent", "narrative", F.col("m.file_idx").alias("files"),
                F.col("m.summary").alias("fileSummaries"),
                F.coalesce("review_notes", F.array().cast("array<string>")).alias("reviewNotes"),
                F.coalesce("depends_on", F.array().cast("array<int>")).alias("dependsOn"),
            ).alias("cohort"),
        )
    )
    return nested_cohorts(rows) if whole else rows


def nested_cohorts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("change_id").agg(ordered_list(["cohort_idx"], "cohort")["cohort"].alias("cohorts"))


def finished_analysis(
    analyses: DataFrame, heads: DataFrame, files: DataFrame, summaries: DataFrame, mechanical: DataFrame,
    stubbed_cohorts: DataFrame, whole: bool = True,
) -> DataFrame:
    """(change_id, analysis): cohorts with title, overview and the lists of where texts came from.

    ``heads`` is (change_id, title, overview), ``summaries`` (change_id, file_idx, key_symbols,
    stubbed), ``mechanical`` (change_id, file_idx), ``stubbed_cohorts`` (change_id, cohort_idx).
    Files are listed by path, then number; symbol lists stand in file order, one per file.
    Without ``whole``, ``analyses`` has one row per cohort, and the result is in parts: (change_id,
    part, idx, head, marks, cohort, stubbed) with one row per change, file and cohort.
    """
    marks = (
        files.select(*FILE, "path").join(summaries.select(*FILE, "key_symbols", "stubbed"), FILE, "left")
        .join(mechanical.select(*FILE, F.lit(True).alias("mechanical")), FILE, "left")
        .withColumn("symbols", F.coalesce("key_symbols", F.array().cast("array<string>")))
    )
    if whole:
        return nested_analysis(analyses, heads, marks, stubbed_cohorts)
    key = ["change_id", "cohort_idx"]
    cohorts = analyses.join(stubbed_cohorts.select(*key).distinct().withColumn("stubbed", F.lit(True)), key, "left")
    rows = (
        part_rows("head", heads, F.lit(None).cast("int"), F.struct("title", "overview").alias("head")),
        part_rows("marks", marks, F.col("file_idx"), F.struct("path", "stubbed", "mechanical", "symbols").alias("marks")),
        part_rows("cohort", cohorts, F.col("cohort_idx"), F.col("cohort"), F.coalesce("stubbed", F.lit(False)).alias("stubbed")),
    )
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)


def nested_analysis(analyses: DataFrame, heads: DataFrame, marks: DataFrame, stubbed_cohorts: DataFrame) -> DataFrame:
    def listed(flag: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("path", "file_idx"))))["file_idx"]

    lists = marks.groupBy("change_id").agg(
        listed("stubbed").alias("stubbedFiles"), listed("mechanical").alias("mechanicalFiles"),
        ordered_list(["file_idx"], "symbols")["symbols"].alias("fileKeySymbols"),
    )
    stubs = stubbed_cohorts.groupBy("change_id").agg(F.sort_array(F.collect_list("cohort_idx")).alias("stubs"))
    return analyses.join(heads, "change_id").join(lists, "change_id").join(stubs, "change_id", "left").select(
        "change_id",
        F.struct(
            "title", "overview", "cohorts", "stubbedFiles", "mechanicalFiles", "fileKeySymbols",
            F.coalesce("stubs", F.array().cast("array<int>")).alias("stubbedCohorts"),
        ).alias("analysis"),
    )


def part_rows(part: str, rows: DataFrame, idx: Column, *values: Column) -> DataFrame:
    return rows.select("change_id", F.lit(part).alias("part"), idx.cast("int").alias("idx"), *values)


def nested_files(files: DataFrame, hunks: DataFrame, lines: DataFrame, blame: DataFrame | None = None) -> DataFrame:
    """(change_id, file_idx, file): files with nested hunks and lines, and the hunks' authors.

    ``blame`` comes from ``blame_hunks``; without it no hunk has an author.
    """
    rows = lines.groupBy(*FILE, "hunk_idx").agg(
        F.transform(ordered_list(["line_idx"], "t", "old", "new", "text"), lambda x: x.dropFields("line_idx"))
        .alias("lines")
    )
    joined = hunks.join(rows, [*FILE, "hunk_idx"], "left")
    if blame is None:
        joined = joined.withColumn("blame", F.lit(None).cast("struct<author:string,date:string>"))
    else:
        authors = blame.select(*FILE, "hunk_idx", F.struct("author", "date").alias("blame"))
        joined = joined.join(authors, [*FILE, "hunk_idx"], "left")
    per_file = joined.groupBy(*FILE).agg(
        F.transform(ordered_list(["hunk_idx"], "header", "lines", "blame"), lambda x: x.dropFields("hunk_idx"))
        .alias("hunks")
    )
    empty = F.array().cast(per_file.schema["hunks"].dataType)
    return files.join(per_file, FILE, "left").select(
        *FILE,
        F.struct(
            "path", F.col("old_path").alias("oldPath"), F.col("new_path").alias("newPath"), "status", "binary",
            "similarity", F.col("mode_changed").alias("modeChanged"), "additions", "deletions",
            F.coalesce("hunks", empty).alias("hunks"),
        ).alias("file"),
    )


def source_of(changes: DataFrame) -> Column:
    place = F.col("repo_dir") if "repo_dir" in changes.columns else F.lit("")
    return F.struct("title", "description", "range", "url", "name", place.alias("repoDir")).alias("source")


def source_and_files(changes: DataFrame, file_rows: DataFrame) -> DataFrame:
    """(change_id, source, files): what a document says about the change itself.

    ``changes`` is (change_id, title, description, range, url, name) and may name a ``repo_dir``.
    """
    per_change = file_rows.groupBy("change_id").agg(ordered_list(["file_idx"], "file")["file"].alias("files"))
    return changes.select("change_id", source_of(changes)).join(per_change, "change_id")


def documents(
    changes: DataFrame, file_rows: DataFrame, analyses: DataFrame, staged: DataFrame, provider: str = "", model: str = "",
    whole: bool = True,
) -> DataFrame:
    """One nested document per change, ready for a JSON sink.

    ``file_rows`` comes from ``nested_files``, ``analyses`` from ``finished_analysis``, ``staged``
    is (change_id, staged); ``provider`` and ``model`` name who gave the answers. Without ``whole`` (here
    and in ``finished_analysis``) documents come in parts, so that no row holds more than one file or
    cohort: a ``head`` per change, and ``file``, ``marks`` and ``cohort`` rows numbered by ``idx``.
    """
    meta = F.struct(
        F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(GENERATOR).alias("generator"),
        F.lit(False).alias("cached"), "staged",
    ).alias("meta")
    version = F.lit(SCHEMA_VERSION).alias("schemaVersion")
    if whole:
        return source_and_files(changes, file_rows).join(analyses, "change_id").join(staged, "change_id").select(
            "change_id", version, "source", "files", "analysis", meta
        )
    told = analyses.where("part = 'head'").select("change_id", "head.title", "head.overview")
    heads = changes.select("change_id", source_of(changes)).join(told, "change_id").join(staged, "change_id")
    for rows in (file_rows, analyses.where("part = 'marks'"), analyses.where("part = 'cohort'")):
        heads = heads.join(rows.select("change_id").distinct(), "change_id", "left_semi")
    heads = materialize(heads.select("change_id", F.struct(version, "source", "title", "overview", meta).alias("head")), "document-heads")
    body = part_rows("file", file_rows, F.col("file_idx"), F.col("file")).unionByName(
        analyses.where("part <> 'head'").drop("head"), allowMissingColumns=True
    ).join(heads.select("change_id").distinct(), "change_id", "left_semi")
    return part_rows("head", heads, F.lit(None), F.col("head")).unionByName(body, allowMissingColumns=True)


# What the rows of each kind of part hold besides the change and their number.
PARTS = {"head": ["head"], "file": ["file"], "marks": ["marks"], "cohort": ["cohort", "stubbed"]}


def doc_sink(docs: DataFrame, path: str) -> None:
    """Append JSON lines: a line per document, or, of documents in parts, a folder for each kind and a line per part."""
    if "part" not in docs.columns:
        docs.write.mode("append").json(path)
        return
    for part, columns in PARTS.items():
        docs.where(F.col("part") == part).select("change_id", "idx", *columns).write.mode("append").json(f"{path}/part={part}")


def whole_documents(parts: DataFrame) -> DataFrame:
    """One nested document per change from its parts, for changes that fit a row."""
    def of(part: str, number: str) -> DataFrame:
        return parts.where(F.col("part") == part).withColumnRenamed("idx", number)

    heads, cohorts = of("head", "none").select("change_id", "head.*"), of("cohort", "cohort_idx")
    analyses = nested_analysis(
        nested_cohorts(cohorts), heads.select("change_id", "title", "overview"),
        of("marks", "file_idx").select("change_id", "file_idx", "marks.*"), cohorts.where("stubbed"),
    )
    files = of("file", "file_idx").groupBy("change_id").agg(ordered_list(["file_idx"], "file")["file"].alias("files"))
    return heads.join(files, "change_id").join(analyses, "change_id").select(
        "change_id", "schemaVersion", "source", "files", "analysis", "meta"
    )
