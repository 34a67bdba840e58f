"""A patch all the way: parse, plan, prompts, answers, document."""

import json

from changeloom.plans import flows
from changeloom.settings import Settings
from changeloom.sources import patches

PATCH = """diff --git a/src/app.ts b/src/app.ts
--- a/src/app.ts
+++ b/src/app.ts
@@ -1,1 +1,2 @@
-old
+import { zed } from "./zed"
+zed()
diff --git a/src/zed.ts b/src/zed.ts
new file mode 100644
--- /dev/null
+++ b/src/zed.ts
@@ -0,0 +1 @@
+export const zed = 1
diff --git a/pic.png b/pic.png
Binary files a/pic.png and b/pic.png differ
"""


def test_staged_flow(spark, tmp_path):
    (tmp_path / "change.patch").write_text(PATCH)
    t = flows.parse(patches.read_patches(spark, str(tmp_path)))
    settings = Settings(stage_budget=4000, summary_batch_max_files=1)
    assert [r.staged for r in flows.decide(t, settings).collect()] == [False]
    prompt = flows.single_prompts(t, flows.decide(t, settings), settings).first().prompt
    assert "FILES_CHANGED: 3" in prompt and '===== FILE 1: "src/zed.ts" (added, +1/-0) =====' in prompt

    none = spark.createDataFrame([], "change_id string, path string, attribute string, value string")
    plan = flows.staged_plan(t, none, settings)
    assert [(r.importer, r.imported) for r in plan.edges.collect()] == [(0, 1)]
    placed = plan.cohort_files.orderBy("cohort_idx", "pos").collect()
    assert [r.file_idx for r in placed] == [2, 1, 0]
    assert [(r.calls, r.needs_approval) for r in plan.calls.collect()] == [(5, False)]
    prompts = flows.batch_prompts(t, plan).orderBy("batch_idx").collect()
    assert len(prompts) == 2 and "+zed()" in prompts[0].prompt

    change = placed[0].change_id
    good = json.dumps([{"index": 0, "summary": "s0", "layerHint": "backend", "keySymbols": ["zed"]}])
    answers = spark.createDataFrame(
        [(change, 0, 0, "no json"), (change, 0, 1, f"```json\n{good}\n```"), (change, 1, 0, good), (change, 1, 1, "[]")],
        "change_id string, batch_idx int, attempt int, raw string",
    )
    summaries, violations = flows.batch_summaries(plan, answers)
    texts = {r.file_idx: (r.summary, r.stubbed) for r in summaries.collect()}
    assert texts[0] == ("s0", False)
    assert texts[1] == ("Change in src/zed.ts (added, +1/-0); no model summary was available.", True)
    assert texts[2] == ("pic.png: binary; model analysis was deliberately skipped.", False)
    assert {r.rule for r in violations.collect()} >= {"unrequested", "missing", "count"}

    digests = {r.cohort_idx: r.prompt for r in flows.cohort_inputs(plan, summaries, settings).collect()}
    assert "COHORT: " in digests[0] and 'KEY_SYMBOLS="zed" SUMMARY="s0"' in digests[1]
    good = json.dumps({"title": "Pictures", "intent": "i", "narrative": "n", "reviewNotes": ["look"]})
    told, _ = flows.narrate(t, plan, spark.createDataFrame(
        [(change, 0, 0, good), (change, 1, 0, "{}"), (change, 1, 1, good.replace("Pictures", " "))],
        "change_id string, cohort_idx int, attempt int, raw string"))
    assert [(r.cohort_idx, r.title, r.stubbed) for r in told.orderBy("cohort_idx").collect()] == [(0, "Pictures", False), (1, "src backend changes", True)]
    assert "COHORT[0]" in flows.synthesis_inputs(t, told, settings).first().text

    def document_of(ops):
        raw = json.dumps({"title": "T", "overview": "O", "cohortOps": ops})
        synthesis = spark.createDataFrame([(change, 0, "no"), (change, 1, raw)], "change_id string, attempt int, raw string")
        finished, _, outcome = flows.staged_analyses(t, plan, summaries, told, synthesis, settings)
        docs, errors = flows.finish(t, finished, True, provider="p", model="m")
        assert errors.count() == 0
        return docs, [(r.kind, r.text) for r in outcome.collect()]

    docs, outcome = document_of([])
    document = docs.first()
    assert outcome == [] and [c.files for c in document.analysis.cohorts] == [[2], [1, 0]]
    assert document.analysis.cohorts[1].fileSummaries[1] == "s0" and (document.meta.provider, document.meta.staged) == ("p", True)
    assert (document.analysis.stubbedFiles, document.analysis.mechanicalFiles, document.analysis.stubbedCohorts) == ([1], [2], [1])
    assert document.analysis.fileKeySymbols == [["zed"], [], []] and document.analysis.title == "T"
    assert len(document.files) == 3 and document.files[0].hunks[0].lines[1].text.startswith("import")

    merged, outcome = document_of([{"op": "merge", "into": 1, "from": 0}, {"op": "retitle", "cohort": 0, "title": "All"}, 7])
    analysis = merged.first().analysis
    assert sorted(k for k, _ in outcome) == ["member", "member", "skip", "title"]
    assert [(c.title, c.files, c.reviewNotes) for c in analysis.cohorts] == [("All", [1, 0, 2], ["look"])]
    assert analysis.stubbedCohorts == [0] and analysis.cohorts[0].fileSummaries[1] == "s0"

    keys = spark.createDataFrame([(change, "k1", 5)], "change_id string, key string, mtime int")
    store = flows.store_rows(docs, keys)
    for staged, hits in ((True, 1), (False, 0)):
        asked = spark.createDataFrame([(change, "k1", staged), ("gone", "k2", True)], "change_id string, key string, staged boolean")
        again, rest = flows.reused_documents(t, asked, store)
        assert again.count() == hits and rest.count() == 2 - hits
        if hits:
            assert again.first().meta.cached and again.first().analysis == document.analysis and again.first().files == document.files

    requests = spark.createDataFrame([(change, "k1"), ("other", "k2")], "change_id string, key string")
    store = spark.createDataFrame(
        [("k1", "a.json", 1, 6, True), ("k1", "b.json", 2, 5, True), ("k2", "c.json", 3, 6, None)],
        "key string, path string, mtime int, schema_version int, staged boolean",
    )
    hit, rest = flows.reuse(requests, store)
    assert [r.entry_path for r in hit.collect()] == ["a.json"] and [r.key for r in rest.collect()] == ["k2"]


def test_single_pass(spark, tmp_path):
    (tmp_path / "change.patch").write_text(PATCH)
    t = flows.parse(patches.read_patches(spark, str(tmp_path)))
    change = t.changes.first().change_id
    cohort = {"title": "C", "layer": "backend", "intent": "i", "narrative": "n", "reviewNotes": [], "dependsOn": []}
    answer = {"title": "T", "overview": "O", "cohorts": [
        {**cohort, "files": [0, 0], "fileSummaries": ["a", "again"]},
        {**cohort, "title": "empty", "files": [0], "fileSummaries": ["late"]},
        {**cohort, "title": "D", "layer": "odd", "files": [0, 1], "fileSummaries": ["late", "b"], "dependsOn": [2, 0, 1, 0]},
    ]}
    broken = {**answer, "cohorts": [{**cohort, "files": [9], "fileSummaries": []}]}
    answers = spark.createDataFrame([(change, 0, json.dumps(broken)), (change, 1, json.dumps(answer))], "change_id string, attempt int, raw string")
    analyses, violations = flows.single_analyses(t, answers)
    assert {r.rule for r in violations.collect()} == {"parallel", "range"}
    docs, errors = flows.finish(t, analyses, False)
    assert errors.count() == 0
    analysis = docs.first().analysis
    assert [(c.title, c.layer, c.files, c.fileSummaries, c.dependsOn) for c in analysis.cohorts] == [
        ("C", "backend", [0], ["a"], []), ("D", "other", [1], ["b"], [0]),
        ("Other changes", "other", [2], ["No model summary was available for this file."], []),
    ]
    assert (analysis.stubbedFiles, analysis.mechanicalFiles, analysis.fileKeySymbols, analysis.stubbedCohorts) == ([], [], [[], [], []], [])
