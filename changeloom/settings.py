"""Settings and fixed enumerations shared by the operators."""

from __future__ import annotations

from dataclasses import asdict, dataclass

SCHEMA_VERSION = 6
GENERATOR = "changeloom"

# The layer names an analysis may use.
LAYERS = ("schema", "backend", "api", "ui", "tests", "config", "docs", "other")

# Markers removed from untrusted text and their replacement.
NEUTRAL = "[neutralized]"
STATIC_MARKERS = ("BEGIN_UNTRUSTED_CHANGE_DATA", "END_UNTRUSTED_CHANGE_DATA")

# Truncation notes.
CUT_NOTE = "\n... [truncated]\n"
DESCRIPTION_CUT_NOTE = "\n... [description truncated]"


@dataclass(frozen=True)
class Settings:
    """Limits of the computations; the defaults are the documented ones."""

    summary_batch_max_files: int = 25
    digest_max_files: int = 40
    digest_max_chars: int = 60_000
    file_diff_cap: int = 12_000
    staging_max_files: int = 150
    stage_budget: int = 160_000
    guard_call_threshold: int = 5
    max_cohort_ops: int = 12
    max_cohort_dependencies: int = 3
    fidelity_budget: int = 4_000_000
    collapse_threshold: int = 400
    fold_threshold: int = 10
    fold_context: int = 3
    long_line_threshold: int = 4_096
    key_symbol_cap: int = 5
    word_diff_min_similarity: float = 0.5
    max_preview_bytes: int = 1_572_864
    max_total_preview_bytes: int = 12_582_912
    image_extensions: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
    cache_max_entries: int = 200
    list_limit: int = 1_000
    section_limit: int = 8
    reading_order: bool = True
    step_order: bool = True
    cohort_dependencies: bool = True
    cohort_operations: bool = True

    def as_dict(self) -> dict:
        return asdict(self)


DEFAULTS = Settings()
