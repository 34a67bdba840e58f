"""Import scanners, Terraform facts and resolution by example."""

from pyspark.sql import functions as F

from changeloom.functions import imports as I
from changeloom.operators import resolve as R
from changeloom.operators import terraform as TR


def frames(spark, sources):
    """path → text of added lines ('-' starts a line that breaks the run)."""
    files = [("c", i, p) for i, p in enumerate(sources)]
    lines = []
    for i, text in enumerate(sources.values()):
        for k, line in enumerate(text.split("\n")):
            kind = "c" if line.startswith("-") else "a"
            lines.append(("c", i, 0, k, kind, 0 if kind == "a" else k + 1, k + 1, line))
    return (
        spark.createDataFrame(files, "change_id string, file_idx int, path string"),
        spark.createDataFrame(
            lines, "change_id string, file_idx int, hunk_idx int, line_idx int, t string, old int, new int, text string"
        ),
    )


def specifiers(spark, path, text):
    files, lines = frames(spark, {path: text})
    return sorted(r.specifier for r in I.import_specifiers(files, lines).collect())


def test_javascript(spark):
    cases = {
        'import a from "x"': ["x"],
        "import 'side';": ["side"],
        'import {\n  a,\n  b\n} from "multi";': ["multi"],
        'import {\n a\n}\nfrom "next-line"': ["next-line"],
        'import {\n a\n}\nconst x = 1; y from "no"': [],
        'import\n"bare";': ["bare"],
        'import x from\n  "wait"': ["wait"],
        'import x;\nfoo from "no"': [],
        'export * from "e1"\nexport { a } from "e2"\nexport const from = "no"': ["e1", "e2"],
        'const a = require("r1"), b = f(require(\'r2\'))\nxrequire("no")': ["r1", "r2"],
        '// import a from "no"\n/* import b from "no" */\n * import c from "no"': [],
        '/* one\n import a from "no"\n*/ import b from "yes"': ["yes"],
        'const u = "http://x"; import("no")\nimport a from "q" // "no"': ["q"],
        'import {\n- context breaks the run\n} from "no"': [],
    }
    for text, expected in cases.items():
        assert specifiers(spark, "src/a.ts", text) == expected, text


def test_line_languages(spark):
    assert specifiers(spark, "a.go", 'import "fmt"\nimport x "a/b"\nimport (\n\t"grouped/one"\n\t_ "grouped/two" // why\n)') == [
        "a/b", "fmt", "grouped/one", "grouped/two"]
    assert specifiers(spark, "a.py", "from ..pkg.mod import x\nimport os, a.b as c, 9x # y\n  from z import (q") == [
        "..pkg.mod", "a.b", "os", "z"]
    assert specifiers(spark, "A.java", "import a.b.C;\nimport static a.b.D.run;\nimport a.p.*; // all\nimport broken") == [
        "a/b/C", "a/b/D", "a/p/*"]
    assert specifiers(spark, "a.kt", "import a.b.C\nimport a.b.E as F;\nimport a.q.*") == ["a/b/C", "a/b/E", "a/q/*"]


def test_terraform_facts(spark):
    text = "\n".join([
        'variable "size" {', '  default = "a" # local.no', "}", "locals {", '  name = "x-${var.size}"', "  nested = {",
        "    inner = 1", "  }", "}", 'resource "box" "main" {', "  n = local.name", '  t = "$${var.no} var.no"',
        "  x = data.img.last.id /* module.no.y */", "}", 'module "net" {', '  source = "./sub"', "  a = module.other.out",
        "}", "locals { one = 1 }",
    ])
    files, lines = frames(spark, {"infra/main.tf": text})
    got = {(r.role, r.kind, r.type_name, r.name) for r in TR.tf_facts(files, lines).collect()}
    assert got == {
        ("define", "variable", "", "size"), ("define", "local", "", "name"), ("define", "local", "", "nested"),
        ("define", "resource", "box", "main"), ("define", "module", "", "net"), ("define", "local", "", "one"),
        ("source", "module", "", "./sub"), ("refer", "variable", "", "size"), ("refer", "local", "", "name"),
        ("refer", "data", "img", "last"), ("refer", "module", "", "other"),
    }


MASKED = [
    ('# see <<EOF\nvariable "abcd" {}\nx = var.other', {("define", "variable", "", "abcd"), ("refer", "variable", "", "other")}),
    ('x = "<<EOF"\nvariable "abcd" {}', {("define", "variable", "", "abcd")}),
    ('module "m" {\n  z = { source = "./no" }\n  source = "./yes"\n}', {("define", "module", "", "m"), ("source", "module", "", "./yes")}),
    ('module "m" { z = { source = "./no" }; source = "far/away" }', {("define", "module", "", "m"), ("source", "module", "", "far/away")}),
    ('module "m" {\n  note = "source = "\n}', {("define", "module", "", "m")}),
    ('locals { a = "app" b = { c = "x" } }\ny = local.c', {("define", "local", "", "a"), ("define", "local", "", "b"), ("refer", "local", "", "c")}),
    ('locals { on = var.flag == local.other }', {("define", "local", "", "on"), ("refer", "variable", "", "flag"), ("refer", "local", "", "other")}),
    ('/* two\nlines */\nvariable "mmmm" {}\nx = 1 /* a\n*/ variable "also" {\n}', {("define", "variable", "", "mmmm"), ("define", "variable", "", "also")}),
    ('v = "${f("${var.deep}")}"', {("refer", "variable", "", "deep")}),
    ('v = "${f("p-${g("q-${var.deeper}")}")} $${var.no} ${join("}", var.parts)}"', {("refer", "variable", "", "deeper"), ("refer", "variable", "", "parts")}),
    ('v = "${ /* a.b.c */ var.real }"', {("refer", "variable", "", "real")}),
    ('v = [<<EOT\na.b.id\n$${a.b.id}\n%{ if var.on }yes%{ endif }\n%%{ if var.off }\n${join("}",\n var.parts)}\nEOT\n]\nw = var.next',
     {("refer", "variable", "", "on"), ("refer", "variable", "", "parts"), ("refer", "variable", "", "next")}),
    ('v = <<-EOT # note\n  variable "no" {\n  EOT\nvariable "yes" {}', {("define", "variable", "", "yes")}),
    ('v = [var.a,var.b]', {("refer", "variable", "", "a"), ("refer", "variable", "", "b")}),
    ('v = "a.b" # c.d\nw = "${format("e.f")}" // g.h', set()),
]


def test_terraform_masking(spark):
    files, lines = frames(spark, {f"s{k}/main.tf": text for k, (text, _) in enumerate(MASKED)})
    got = {}
    for r in TR.tf_facts(files, lines).collect():
        got.setdefault(r.dir, set()).add((r.role, r.kind, r.type_name, r.name))
    assert [got.get(f"s{k}", set()) for k in range(len(MASKED))] == [expected for _, expected in MASKED]


def edges(spark, sources):
    files, lines = frames(spark, sources)
    paths = list(sources)
    return {(paths[r.importer], paths[r.imported]) for r in R.build_edges(files, lines).collect()}


def test_resolution_rules(spark):
    got = edges(spark, {
        "web/app/main.ts": 'import a from "./util"\nimport b from "../lib"\nimport c from "@/lib/deep/tool"\nimport d from "react"',
        "web/app/util.ts": "x", "web/app/util.ios.ts": "x", "web/lib/index.ts": "x", "web/lib/deep/tool.ts": "x",
        "pkg/one/a.py": "from .b import q\nfrom pkg.two.c import r\nfrom ....far import s", "pkg/one/b.py": "x",
        "pkg/two/c.py": "x", "same/two/c.py": "x",
        "svc/m.go": 'import "example.com/repo/svc/db"', "svc/db/x.go": "x", "svc/db/y.go": "x", "svc/db/n.md": "x",
        "j/src/org/acme/A.java": "import org.acme.util.*;\nimport org.acme.B;", "j/src/org/acme/util/U.kt": "x",
        "j/src/org/acme/B.java": "x", "site/p.html": '<img src="i/x.png?v=1">', "site/i/x.png": "x",
        "react.md": "x",
    })
    assert got == {
        ("web/app/main.ts", "web/app/util.ts"), ("web/app/main.ts", "web/app/util.ios.ts"),
        ("web/app/main.ts", "web/lib/index.ts"), ("web/app/main.ts", "web/lib/deep/tool.ts"),
        ("pkg/one/a.py", "pkg/one/b.py"), ("pkg/one/a.py", "pkg/two/c.py"),
        ("svc/m.go", "svc/db/x.go"), ("svc/m.go", "svc/db/y.go"),
        ("j/src/org/acme/A.java", "j/src/org/acme/util/U.kt"), ("j/src/org/acme/A.java", "j/src/org/acme/B.java"),
        ("site/p.html", "site/i/x.png"),
    }


def test_ambiguous_names_resolve_to_nothing(spark):
    assert edges(spark, {
        "a/x/tool.py": "q", "b/x/tool.py": "q", "m.py": "from x.tool import q\nimport other",
        "s1.go": "func Shared() {}", "s2.go": "func Shared() {}", "n.txt": "Shared(Alone)", "s3.go": "type Alone struct {",
    }) == {("n.txt", "s3.go")}


def test_terraform_edges(spark):
    got = edges(spark, {
        "env/main.tf": 'module "m" {\n  source = "../mod"\n}\nx = var.a', "env/vars.tf": 'variable "a" {}',
        "mod/a.tf": "z = var.a", "mod/b.tf": "x",
    })
    assert got == {("env/main.tf", "env/vars.tf"), ("env/main.tf", "mod/a.tf"), ("env/main.tf", "mod/b.tf")}


def test_long_code_lines(spark):
    big = "import " + "a." * 200_000 + "b;"
    files, lines = frames(spark, {"A.java": big, "b.tf": 'x = "' + "${a}" * 100_000 + '"', "c.ts": "/*" + "*" * 500_000})
    assert I.import_specifiers(files, lines).count() == 1
    assert TR.tf_facts(files, lines).select(F.count("*")).first()[0] >= 0


def test_scanners_read_each_line_once_and_keep_every_form(spark):
    """``require`` before any statement, and line imports behind blanks, stay; the lines are scanned once by the JavaScript scanner."""
    cases = {"a.ts": ('x\nvar a = require("r0")\nimport b from "s1"\nvar c = require("r1")', ["r0", "r1", "s1"]), "b.ts": ("plain\nwords", []),
             "c.go": ('\t"one"\n  x "two"\n\timport `three`\nword', ["one", "three", "two"]), "d.py": ("\tfrom\ta import b\n import\tc, d\nimports e", ["a", "c", "d"])}
    files, lines = frames(spark, {path: text for path, (text, _) in cases.items()})
    found = I.import_specifiers(files, lines).collect()
    for k, (_, expected) in enumerate(cases.values()):
        assert sorted(r.specifier for r in found if r.file_idx == k) == expected
    plan = I.import_refs_js(I.with_language(lines, files))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
