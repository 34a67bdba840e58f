"""The three ways through the engine: single pass, staged, and reuse of stored documents.

Every function takes and returns tables, so a caller may run the parts in separate jobs and
keep each table where the next job finds it. Model calls happen outside: a flow ends with
prompts and a later one starts with the answers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.operators import aggregate as A
from changeloom.operators import assemble as S
from changeloom.operators import graph as G
from changeloom.operators import prepare as P
from changeloom.operators import resolve as R
from changeloom.operators import triage as TG
from changeloom.operators import validate as V
from changeloom.operators import windows as W
from changeloom.settings import DEFAULTS, SCHEMA_VERSION, Settings
from changeloom.sources import patches, responses, tables
from changeloom.sources.shared import materialize

FILE = ["change_id", "file_idx"]


@dataclass(frozen=True)
class ChangeTables:
    """Parsed change sets."""

    changes: DataFrame
    files: DataFrame
    hunks: DataFrame
    lines: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class StagedPlan:
    """What is decided before any model call; the same plan is executed afterwards."""

    triaged: DataFrame
    cohort_files: DataFrame
    deps: DataFrame
    edges: DataFrame
    batches: DataFrame
    calls: DataFrame
    links: tuple[DataFrame, DataFrame]  # package imports, not expanded to edges


def parse(sections: DataFrame) -> ChangeTables:
    """Sections (change_id, file_idx, section) → tables; changes with errors are left out.

    The files' metadata is written first, as a narrow table that errors and files read.
    """
    heads = materialize(
        patches.parse_files(sections.select("change_id", "file_idx", "section", patches.header_text())), "file-heads"
    )
    errors = patches.header_errors(heads)
    bad = errors.select("change_id").distinct()
    good = sections.join(bad, "change_id", "left_anti")
    parsed = heads.join(bad, "change_id", "left_anti").drop("header", "header_ok")
    lines = materialize(patches.parse_lines(good), "lines")
    hunks = materialize(patches.parse_hunks(good), "hunks")
    numbers = hunks.groupBy(*FILE).agg(F.count("*").cast("int").alias("hunk_count"))
    files = (
        parsed.join(A.file_churn(lines), FILE, "left").join(numbers, FILE, "left")
        .fillna(0, ["additions", "deletions", "hunk_count"])
    )
    return ChangeTables(tables.patch_meta(parsed), materialize(files, "files"), hunks, lines, errors)


def decide(t: ChangeTables, settings: Settings = DEFAULTS) -> DataFrame:
    """Staged or single pass per change."""
    totals = A.input_bytes(t.files, t.lines, t.hunks)
    cohorts = W.plan_cohorts(t.files, settings.staging_max_files, bounded=False)
    return A.staging_decision(totals, cohorts, settings.stage_budget, P.frame_overhead(), settings)


def single_prompts(t: ChangeTables, decision: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Prompts of the changes that one call can hold."""
    one = decision.where("NOT staged").select("change_id")
    keep = lambda frame: frame.join(one, "change_id", "left_semi")
    return P.prompt_single(with_description(keep(t.changes)), keep(t.files), keep(t.lines), keep(t.hunks), settings.stage_budget, settings)


def moved(frame: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of cohorts under the cohorts' new numbers."""
    renamed = frame.join(order, ["change_id", "cohort_idx"]).drop("cohort_idx").withColumnRenamed("new_idx", "cohort_idx")
    return renamed.select(*frame.columns)


def written_graph(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """Edges and package imports, written once."""
    edges, links = R.import_graph(files, lines)
    asks = materialize(links[0], "package-imports")
    return materialize(edges.distinct(), "edges"), (asks, materialize(R.asked_members((asks, links[1]))[1], "package-files"))


def in_order(
    cohort_files: DataFrame, edges: DataFrame, links: tuple[DataFrame, DataFrame], settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Cohort files in reading order with ordered cohorts, and the dependencies, as the settings ask."""
    read, order, deps = order_of(cohort_files, edges, links, settings)
    return read if order is None else moved(read, order), deps


def order_of(
    cohort_files: DataFrame, edges: DataFrame, links: tuple[DataFrame, DataFrame], settings: Settings
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    read = G.reorder_cohort_files(cohort_files, edges, links) if settings.reading_order else cohort_files
    if settings.step_order:
        order, deps = G.stable_cohort_order(edges, read, settings, links)
    else:
        order, deps = None, G.cohort_deps(edges, read, settings, links)
    return read, order, deps if settings.cohort_dependencies else deps.where(F.lit(False))


def staged_plan(t: ChangeTables, attributes: DataFrame, settings: Settings = DEFAULTS) -> StagedPlan:
    """Triage, cohorts in reading order, their dependencies, and summary batches.

    Ranks take the way that never holds a whole change, whatever the sizes are.
    """
    triaged = materialize(TG.heuristic_flags(TG.triage(t.files, attributes), t.lines), "triaged")
    edges, links = written_graph(t.files, t.lines)
    planned = materialize(W.plan_cohorts(t.files, settings.staging_max_files, bounded=False), "cohorts")
    placed, deps = in_order(planned, edges, links, settings)
    placed = materialize(placed, "cohort-files")
    sizes = A.diff_bytes(t.lines, t.hunks)
    body = F.when(F.col("binary"), len(A.BINARY_TEXT)).otherwise(F.coalesce("diff_bytes", F.lit(0)))
    worthy = triaged.where("reason IS NULL").join(sizes, FILE, "left").withColumn("diff_bytes", body)
    sized = P.sized_files(worthy.drop("diff_bytes"), worthy.select(*FILE, "diff_bytes"), settings)
    content = max(settings.stage_budget - P.frame_overhead(), 0)
    batches = materialize(P.pack_batches(sized, content, settings.summary_batch_max_files, bounded=False), "batches")
    return StagedPlan(triaged, placed, deps, edges, batches, A.call_plan(batches, placed, settings), links)


def batch_prompts(t: ChangeTables, plan: StagedPlan, settings: Settings = DEFAULTS) -> DataFrame:
    files = t.files.join(plan.batches.select(*FILE), FILE, "left_semi")
    return P.prompt_batch(plan.batches, t.files, A.diff_text(t.lines, t.hunks, files, settings.file_diff_cap))


def batch_summaries(plan: StagedPlan, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries per file, and the violations behind stubs.

    ``answers`` is (change_id, batch_idx, attempt, raw). A batch takes its first valid
    attempt; without one all its files get stubs. Mechanical files have fixed summaries.
    """
    unit = ["change_id", "batch_idx"]
    many = f"items ARRAY<STRUCT<{responses.SUMMARY_SCHEMA.replace(' ', ': ').replace(',: ', ', ')}>>"
    wrapped = responses.read_responses(answers.where("attempt < 2")).withColumn(
        "candidate", F.concat(F.lit('{"items": '), "candidate", F.lit("}"))
    )
    parsed = materialize(responses.repair_responses(wrapped.drop("raw"), many), "batch-answers")
    tries = parsed.select(*unit, "attempt", (F.col("status") != "failed").alias("parsed"))
    returned = parsed.where("status <> 'failed'").select(
        *unit, "attempt", F.posexplode("answer.items").alias("position", "item")
    ).select(*unit, "attempt", "position", "item.*")
    requested = tries.where("parsed").join(plan.batches, unit).select(
        *unit, "attempt", F.col("file_idx").alias("index")
    )
    violations = V.validate_summaries(requested, returned, [*unit, "attempt"])
    accepted = V.accepted_attempts(tries, violations, unit)
    answered = returned.join(accepted, [*unit, "attempt"]).select(
        "change_id", F.col("index").alias("file_idx"), "summary", F.col("keySymbols").alias("key_symbols"),
        F.lit(False).alias("stubbed"),
    )
    none = F.array().cast("array<string>").alias("key_symbols")
    fixed = A.file_stub(plan.triaged)
    failed = V.stub_failed_batches(plan.batches, accepted, fixed).select(
        *FILE, "summary", none, F.lit(True).alias("stubbed")
    )
    mechanical = fixed.where("NOT stubbed").select(*FILE, "summary", none, "stubbed")
    return answered.unionByName(failed).unionByName(mechanical), violations


def accepted_answers(answers: DataFrame, unit: list[str], schema: str, rules) -> tuple[DataFrame, DataFrame]:
    """Decoded answers: of each unit the first of two attempts that broke no rule; and the violations.

    ``answers`` is ``unit`` + (attempt, raw); ``rules`` maps decoded answers to violations.
    """
    read = responses.read_responses(answers.where("attempt < 2")).drop("raw")
    parsed = materialize(responses.repair_responses(read, schema), "decoded-answers")
    tries = parsed.select(*unit, "attempt", (F.col("status") != "failed").alias("parsed"))
    decoded = parsed.where("status <> 'failed'").select(*unit, "attempt", "answer.*")
    violations = materialize(rules(decoded), "answer-violations")
    accepted = V.accepted_attempts(tries, violations, unit)
    return materialize(decoded.join(accepted, [*unit, "attempt"]).drop("attempt"), "accepted-answers"), violations


def file_counts(t: ChangeTables) -> DataFrame:
    return t.files.groupBy("change_id").agg(F.count("*").cast("int").alias("n"))


def single_analyses(t: ChangeTables, answers: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(change_id, analysis) of answers (change_id, attempt, raw) to single prompts, and violations.

    Each file stays in the first cohort that names it, files in none get a cohort of their own,
    dependencies follow the new numbers and files stand in reading order.
    """
    sizes, keys = file_counts(t), ["change_id", "attempt"]
    accepted, violations = accepted_answers(
        answers, ["change_id"], responses.ANALYSIS_SCHEMA,
        lambda d: V.validate_content(d, keys).unionByName(V.validate_claims(d, sizes, keys)),
    )
    none = F.array().cast("array<string>")
    cohorts = accepted.select("change_id", F.posexplode("cohorts").alias("old_idx", "c"))
    claims = cohorts.select("change_id", "old_idx", F.posexplode(F.arrays_zip("c.files", "c.fileSummaries")).alias("pos", "f")).select(
        "change_id", "old_idx", "pos", F.col("f.files").alias("file_idx"), F.col("f.fileSummaries").alias("summary")
    )
    texts = claims.groupBy("change_id", "old_idx", "file_idx").agg(F.min_by("summary", "pos").alias("summary"))
    kept = materialize(
        W.first_assignment(claims.withColumnRenamed("old_idx", "cohort_idx").drop("summary"), sizes, bounded=False)
        .join(texts, ["change_id", "old_idx", "file_idx"]), "first-claims",
    )
    files = t.files.join(accepted, "change_id", "left_semi")
    rest = materialize(S.leftover_files(files, kept, bounded=False), "leftover-files")
    own = ["change_id", "cohort_idx", "pos", "file_idx", "summary"]
    placed = kept.select(*own).unionByName(rest.select(*own))
    numbers = kept.select("change_id", "old_idx", "cohort_idx").distinct()
    told = cohorts.join(numbers, ["change_id", "old_idx"]).select(
        "change_id", "cohort_idx", "c.title", W.known_layer(F.col("c.layer")).alias("layer"), "c.intent", "c.narrative",
        F.coalesce("c.reviewNotes", none).alias("review_notes"),
    )
    others = rest.select("change_id", "cohort_idx", "title", "layer").distinct().select(
        "*", F.lit(S.LEFTOVER["intent"]).alias("intent"), F.lit(S.LEFTOVER["narrative"]).alias("narrative"), none.alias("review_notes"),
    )
    given = cohorts.select("change_id", "old_idx", F.posexplode("c.dependsOn").alias("pos", "old_dep"))
    if settings.reading_order:
        lines = t.lines.join(accepted, "change_id", "left_semi")
        placed = G.reorder_cohort_files(placed, *written_graph(files, lines))
    analyses = S.assemble_analysis(placed, told.unionByName(others), placed.select(*FILE, "summary"), S.remap_deps(given, numbers))
    nothing = files.where(F.lit(False)).select(*FILE, none.alias("key_symbols"), F.lit(False).alias("stubbed"), F.lit(0).alias("cohort_idx"))
    return S.finished_analysis(analyses, accepted.select("change_id", "title", "overview"), files, nothing, nothing, nothing), violations


def cohort_inputs(plan: StagedPlan, summaries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Input text per cohort for its narration: the digest of its files, between delimiters."""
    digests = A.cohort_digest(plan.cohort_files, plan.triaged, summaries, settings.stage_budget, settings)
    return digests.select("change_id", "cohort_idx", P.framed(F.col("digest"), F.col("change_id")).alias("prompt"))


def narrate(t: ChangeTables, plan: StagedPlan, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Narrations per cohort, and the violations behind stubs.

    ``answers`` is (change_id, cohort_idx, attempt, raw). A cohort without an accepted attempt is
    told by its counts and marked as a stub.
    """
    key = ["change_id", "cohort_idx"]
    accepted, violations = accepted_answers(
        answers, key, responses.NARRATION_SCHEMA, lambda d: V.validate_narration(d, [*key, "attempt"])
    )
    told = accepted.withColumnRenamed("reviewNotes", "review_notes").withColumn("stubbed", F.lit(False))
    stubs = A.cohort_stub(plan.cohort_files, t.files).join(told.select(*key), key, "left_anti").select(
        "*", F.array().cast("array<string>").alias("review_notes"), F.lit(True).alias("stubbed")
    )
    layers = plan.cohort_files.groupBy(*key).agg(F.first("layer").alias("layer"), F.count("*").alias("files"))
    return materialize(told.unionByName(stubs).join(layers, key), "narrations"), violations


def synthesis_inputs(t: ChangeTables, told: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Input text per change for the synthesis: every cohort has its fair share of the budget."""
    source = t.changes.join(told, "change_id", "left_semi")
    return P.fair_share(with_description(source), told, settings.stage_budget)


def refine(plan: StagedPlan, told: DataFrame, outcome: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cohort files, narrations and dependencies after the operations of the synthesis.

    Changes with an applied operation are ordered again; all others stay as they were planned.
    """
    done = outcome.where("kind <> 'skip'").select("change_id").distinct()
    hit = lambda frame: frame.join(done, "change_id", "left_semi")
    same = lambda frame: frame.join(done, "change_id", "left_anti")
    told = told.drop("files")
    files, renamed = S.apply_cohort_ops(hit(plan.cohort_files), hit(told), outcome)
    read, order, deps = order_of(materialize(files, "merged-cohorts"), hit(plan.edges), tuple(map(hit, plan.links)), settings)
    if order is not None:
        read, renamed = moved(read, order), moved(renamed, order)
    return same(plan.cohort_files).unionByName(read), same(told).unionByName(renamed), same(plan.deps).unionByName(deps)


def staged_analyses(
    t: ChangeTables, plan: StagedPlan, summaries: DataFrame, told: DataFrame, answers: DataFrame, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(change_id, analysis) of staged changes, violations, and outcomes of cohort operations.

    ``answers`` is (change_id, attempt, raw), the synthesis; a change without an accepted one has
    no analysis.
    """
    heads, violations = accepted_answers(
        answers, ["change_id"], "title STRING, overview STRING, cohortOps STRING",
        lambda d: V.validate_synthesis(d, ["change_id", "attempt"]),
    )
    asked = heads.where("cohortOps IS NOT NULL" if settings.cohort_operations else "false")
    counts = plan.cohort_files.groupBy("change_id").agg(F.countDistinct("cohort_idx").cast("int").alias("cohorts"))
    outcome = materialize(
        S.cohort_ops(S.decode_ops(asked.select("change_id", F.col("cohortOps").alias("ops"))), counts, settings), "cohort-operations"
    )
    cohort_files, told, deps = refine(plan, told, outcome, settings)
    told = materialize(told, "told")
    analyses = S.assemble_analysis(cohort_files, told, summaries, deps)
    finished = S.finished_analysis(
        analyses, heads.select("change_id", "title", "overview"), t.files, summaries,
        plan.triaged.where("reason IS NOT NULL"), told.where("stubbed"),
    )
    return finished, violations, outcome


def with_description(changes: DataFrame) -> DataFrame:
    return changes if "description" in changes.columns else changes.withColumn("description", F.lit(""))


def described(changes: DataFrame) -> DataFrame:
    return with_description(changes) if "url" in changes.columns else with_description(changes).withColumn("url", F.lit(None).cast("string"))


def finish(
    t: ChangeTables, analyses: DataFrame, staged: bool, blame: DataFrame | None = None, provider: str = "", model: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Documents of the analyses that keep every rule, and the violations of the others.

    ``blame`` is (change_id, path, line, ...) as ``read_blame`` gives it.
    """
    analyses = materialize(analyses, "analyses")
    errors = materialize(V.validate_finished(analyses, file_counts(t)), "analysis-errors")
    good = analyses.join(errors.select("change_id").distinct(), "change_id", "left_anti")
    authors = None if blame is None else A.blame_hunks(t.files, t.lines, blame)
    how = good.select("change_id", F.lit(staged).alias("staged"))
    rows = S.nested_files(t.files, t.hunks, t.lines, authors)
    return S.documents(described(t.changes), rows, good, how, provider, model), errors


def reuse(requests: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (change_id, key) split into those with a usable stored document and the rest."""
    looked = materialize(tables.cache_lookup(requests, store), "lookups")
    return looked.where("cached"), looked.where("NOT cached").select("change_id", "key")


def store_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows for the store of documents: (key, schemaVersion, analysis, meta, mtime), to be appended.

    ``keys`` is (change_id, key, mtime).
    """
    return docs.join(keys, "change_id").select("key", "schemaVersion", "analysis", F.col("meta").withField("cached", F.lit(False)).alias("meta"), "mtime")


def reused_documents(t: ChangeTables, requests: DataFrame, store: DataFrame, blame: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored documents with the change's own source and files, and the requests without one.

    ``requests`` is (change_id, key, staged). The newest entry of a key counts; it must have this
    schema version, be staged as asked and keep every rule for the change's files.
    """
    asked = store.join(requests.select("key").distinct(), "key", "left_semi")
    newest = asked.groupBy("key").agg(F.max_by(F.struct("schemaVersion", "analysis", "meta"), "mtime").alias("d")).select("key", "d.*")
    found = materialize(
        requests.join(newest, "key").where((F.col("schemaVersion") == SCHEMA_VERSION) & (F.col("meta.staged") == F.col("staged"))), "stored-documents"
    )
    errors = V.validate_finished(found.select("change_id", "analysis"), file_counts(t))
    good = materialize(found.join(errors.select("change_id").distinct(), "change_id", "left_anti"), "reused")
    authors = None if blame is None else A.blame_hunks(t.files, t.lines, blame)
    rows = S.nested_files(*(x.join(good, "change_id", "left_semi") for x in (t.files, t.hunks, t.lines)), authors)
    docs = S.source_and_files(described(t.changes), rows).join(good, "change_id").select(
        "change_id", "schemaVersion", "source", "files", "analysis", F.col("meta").withField("cached", F.lit(True)).alias("meta")
    )
    return docs, requests.join(good, "change_id", "left_anti")
