"""Path functions: normalisation, layers, languages, suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layer rules, tried in this order against the lower-cased path.
LAYER_RULES = (
    ("schema", r"migration|schema|\.sql$|models?/"),
    ("tests", r"test|spec|__tests__|\.test\.|\.spec\."),
    ("api", r"routes?|api|controller|endpoint|graphql|resolver"),
    ("ui", r"component|page|view|\.css|\.scss|\.html$|frontend|ui/|\.tsx$|\.jsx$|\.vue$"),
    ("config", r"\.(json|ya?ml|toml|ini|env|cfg)$|dockerfile|makefile|\.github/"),
    ("docs", r"\.(md|rst|txt)$|docs?/"),
)
DEFAULT_LAYER = "backend"

# File extensions per language.
LANGUAGE_EXTENSIONS = {
    "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts"),
    "go": (".go",),
    "python": (".py",),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "terraform": (".tf",),
    "html": (".html", ".htm"),
    "css": (".css",),
}
# Extensions whose importers may use bare aliases.
ALIAS_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")
# Platform infixes of module names.
PLATFORM_INFIX = r"^(.*)\.(ios|android|native|web)$"


def to_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def classify_layer(path: Column) -> Column:
    """Layer of a path: the first rule that matches anywhere in it."""
    text = F.lower(path)
    result = None
    for layer, pattern in LAYER_RULES:
        hit = text.rlike(pattern)
        result = F.when(hit, layer) if result is None else result.when(hit, layer)
    return result.otherwise(DEFAULT_LAYER)


def extension(path: Column) -> Column:
    """Last extension of the final path element, with its dot; '' when there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def classify_language(path: Column) -> Column:
    """Language by extension, null when unknown."""
    ext = F.lower(extension(path))
    result = None
    for language, extensions in LANGUAGE_EXTENSIONS.items():
        hit = ext.isin(*extensions)
        result = F.when(hit, language) if result is None else result.when(hit, language)
    return result


def language_family(language: Column) -> Column:
    """Languages which resolve into each other share a family (Java and Kotlin)."""
    return F.when(language.isin("java", "kotlin"), "jvm").otherwise(language)


def clean_path(path: Column) -> Column:
    """Resolve '.', '..' and empty parts; a rooted path cannot climb above its root."""
    rooted = path.startswith("/")

    def step(stack: Column, part: Column) -> Column:
        climbs = (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        return (
            F.when(part.isin("", ".") | ((part == "..") & rooted & (F.size(stack) == 0)), stack)
            .when((part == "..") & climbs, F.slice(stack, 1, F.size(stack) - 1))
            .otherwise(F.concat(stack, F.array(part)))
        )

    plain = ~path.rlike(r"(^|/)(\.{0,2})(/|$)")
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    walked = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(plain, path).otherwise(walked)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading './' and then '/', cleaned; '' stands for the root."""
    return clean_path(F.regexp_replace(F.regexp_replace(to_slashes(path), r"^\./", ""), "^/", ""))


def directory(path: Column) -> Column:
    """Directory of a normalised path, '' for a root file."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def join_path(folder: Column, rest: Column) -> Column:
    """Join and clean; a leading '..' in the result means it left the tree."""
    joined = F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))
    return clean_path(joined)


def path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")


def top_directory(path: Column) -> Column:
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, parts[0]).otherwise(".")


def path_suffixes(path: Column) -> Column:
    """Every non-empty suffix made of whole components."""
    parts = F.split(normalize_path(path), "/")
    count = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, count), "/")
    )
    return F.filter(suffixes, lambda s: s != "")


def platform_module(module: Column) -> Column:
    """Module name without its platform infix, null when it has none."""
    return F.nullif(F.regexp_extract(module, PLATFORM_INFIX, 1), F.lit(""))


def safe_name(name: Column) -> Column:
    dashed = F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "-")
    trimmed = F.regexp_replace(dashed, r"^[-.]+|[-.]+$", "")
    return F.when(trimmed == "", "review").otherwise(trimmed)


def repo_identity(remote: Column) -> Column:
    """host/owner/name of an scp-like or URL remote; '' when it has no such form."""
    raw = F.trim(remote)
    is_url = raw.contains("://")
    scp_host = F.regexp_extract(raw, r"^([^:]+):", 1)
    scp_host = F.regexp_extract(scp_host, r"([^@]*)$", 1)
    scp_path = F.regexp_extract(raw, r"^[^:]+:(.*)$", 1)
    url_host = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    url_path = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)

    def slug(path: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), r"^/+|/+$", "")
        return F.regexp_extract(cut, r"^([^/]+/[^/]+)", 1)

    host = F.lower(F.when(is_url, url_host).otherwise(scp_host))
    name = slug(F.when(is_url, url_path).otherwise(scp_path))
    return F.when((host == "") | (name == ""), "").otherwise(F.concat(host, F.lit("/"), name))


def image_kind(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(extension(path)).isin(*[e.lower() for e in extensions])


def image_mime(path: Column) -> Column:
    # Media types by extension, png otherwise.
    ext = F.lower(extension(path))
    return (
        F.when(ext.isin(".jpg", ".jpeg"), "image/jpeg")
        .when(ext == ".gif", "image/gif")
        .when(ext == ".webp", "image/webp")
        .when(ext == ".svg", "image/svg+xml")
        .otherwise("image/png")
    )
