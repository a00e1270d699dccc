"""Options of a corpus replay, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from kistwerk.formats.extract import Options as ExtractOptions
from kistwerk.functions.globs import glob_regex

# Accepted words.
MODES = ("strict", "lenient")
POLICIES = ("all", "failed", "success", "partial", "issues", "warnings", "clean", "none")
SORTS = ("path", "duration-desc", "size-desc", "artifacts-desc", "artifacts-failed-desc", "warnings-desc", "error-code", "failed-first")
TIE_BREAKERS = ("path", "duration-desc")

# Gates on the scan, the summary, the baseline and the trend.
SCAN_GATES = ("min_scanned_files", "max_scanned_files", "min_matched_files", "max_matched_files_total", "max_truncated_matches")
SUMMARY_GATES = ("min_processed", "max_processed", "min_pass_rate", "max_failed", "max_partial", "max_warnings", "max_warning_files")
BASELINE_GATES = ("max_newly_failed", "max_new_files", "max_removed_files", "max_newly_partial", "max_new_error_codes", "max_error_code_regressions")
TREND_GATES = ("max_pass_rate_drop", "max_processed_increase", "max_processed_drop", "max_failed_increase", "max_partial_increase", "max_warning_increase")


class OptionError(ValueError):
    pass


@dataclass
class ReplayOptions:
    """Numbers below 0 switch a filter, limit or gate off."""

    root: str = "."
    ext: list[str] = field(default_factory=lambda: [".doc", ".dot", ".xls", ".xlt", ".ppt", ".pot", ".ole", ".cfb"])
    include_glob: list[str] = field(default_factory=list)
    exclude_glob: list[str] = field(default_factory=list)
    min_file_size_bytes: int = -1
    max_file_size_bytes: int = -1
    max_matched_files: int = -1
    mode: str = "lenient"
    report_files: str = "all"
    report_sort: str = "path"
    report_sort_tie_breaker: str = "path"
    report_offset: int = 0
    report_limit: int = -1
    report_include_glob: list[str] = field(default_factory=list)
    report_exclude_glob: list[str] = field(default_factory=list)
    report_error_codes: list[str] = field(default_factory=list)
    report_exclude_error_codes: list[str] = field(default_factory=list)
    baseline: str = ""
    baseline_latest: bool = False
    run_id: str = ""
    trend_dir: str = ""
    trend_limit: int = 20
    save_trend: bool = False
    save_trend_name: str = ""
    save_trend_prune: bool = False
    include_raw: bool = False
    detect_images: bool = True
    detect_oleds: bool = True
    unwrap_ole10native: bool = True
    deduplicate: bool = True
    max_depth: int = 16
    max_artifacts: int = 4096
    max_total_bytes: int = 64 << 20
    max_artifact_size: int = 32 << 20
    min_scanned_files: int = -1
    max_scanned_files: int = -1
    min_matched_files: int = -1
    max_matched_files_total: int = -1
    max_truncated_matches: int = -1
    min_processed: int = -1
    max_processed: int = -1
    min_pass_rate: float = -1
    max_failed: int = -1
    max_partial: int = -1
    max_warnings: int = -1
    max_warning_files: int = -1
    max_newly_failed: int = -1
    max_new_files: int = -1
    max_removed_files: int = -1
    max_newly_partial: int = -1
    max_pass_rate_drop: float = -1
    max_processed_increase: int = -1
    max_processed_drop: int = -1
    max_failed_increase: int = -1
    max_partial_increase: int = -1
    max_warning_increase: int = -1
    deny_error_codes: list[str] = field(default_factory=list)
    max_new_error_codes: int = -1
    max_error_code_regressions: int = -1
    output: str = ""

    def validate(self) -> ReplayOptions:
        """Raises OptionError for the first rule that is broken; normalises lists and words."""

        def need(ok: bool, message: str) -> None:
            if not ok:
                raise OptionError(message)

        words = lambda v: [w.strip() for w in v if w.strip()]
        self.ext = [e if e.startswith(".") else f".{e}" for e in map(str.lower, words(self.ext))]
        for name in ("include_glob", "exclude_glob", "report_include_glob", "report_exclude_glob"):
            setattr(self, name, words(getattr(self, name)))
            for p in getattr(self, name):
                try:
                    glob_regex(p)
                except ValueError as e:
                    raise OptionError(f"{name.replace('_', '-')}: {e}") from None
        for name in ("report_error_codes", "report_exclude_error_codes", "deny_error_codes"):
            setattr(self, name, sorted({w.upper() for w in words(getattr(self, name))}))
        for name, allowed in (("mode", MODES), ("report_files", POLICIES), ("report_sort", SORTS), ("report_sort_tie_breaker", TIE_BREAKERS)):
            setattr(self, name, getattr(self, name).strip().lower())
            need(getattr(self, name) in allowed, f"invalid {name.replace('_', '-')}: {getattr(self, name)}")
        dash = lambda name: name.replace("_", "-")
        need(not (self.baseline_latest and self.baseline), "baseline-latest cannot be used with -baseline")
        need(not self.baseline_latest or bool(self.trend_dir), "baseline-latest requires -trend-dir")
        for name in BASELINE_GATES:
            need(getattr(self, name) < 0 or bool(self.baseline) or self.baseline_latest, f"{dash(name)} requires -baseline")
        for name in TREND_GATES:
            need(getattr(self, name) < 0 or bool(self.trend_dir), f"{dash(name)} requires -trend-dir")
        need(not self.save_trend or bool(self.trend_dir), "save-trend requires -trend-dir")
        need(not self.save_trend_prune or self.save_trend, "save-trend-prune requires -save-trend")
        need(not self.save_trend_prune or self.trend_limit > 0, "save-trend-prune requires trend-limit > 0")
        for name in ("min_pass_rate", "max_pass_rate_drop"):
            need(getattr(self, name) <= 1, f"{dash(name)} must be <= 1")
        need(min(self.min_file_size_bytes, self.max_file_size_bytes) < 0 or self.min_file_size_bytes <= self.max_file_size_bytes, "min-file-size-bytes cannot be greater than max-file-size-bytes")
        need(self.report_offset >= 0, "report-offset must be >= 0")
        for name in ("report_limit", "max_matched_files", *SCAN_GATES):
            need(getattr(self, name) >= -1, f"{dash(name)} must be >= -1")
        return self

    def extraction(self) -> ExtractOptions:
        return ExtractOptions(
            strict=self.mode == "strict", include_raw=self.include_raw, images=self.detect_images, objects=self.detect_oleds, unwrap=self.unwrap_ole10native, deduplicate=self.deduplicate,
            max_depth=self.max_depth, max_artifacts=self.max_artifacts, max_total_bytes=self.max_total_bytes, max_artifact_size=self.max_artifact_size,
        )

    def echo(self) -> dict:
        """The options as the report shows them."""
        gates = {*SCAN_GATES, *SUMMARY_GATES, *BASELINE_GATES, *TREND_GATES, "deny_error_codes", "output"}
        names = {"ext": "extensions", "include_glob": "include_globs", "exclude_glob": "exclude_globs", "report_include_glob": "report_include_globs", "report_exclude_glob": "report_exclude_globs", "baseline": "baseline_report"}
        always = {"root", "ext", "mode", "report_files", "include_raw", "detect_images", "detect_oleds", "unwrap_ole10native", "deduplicate", "max_depth", "max_artifacts", "max_total_bytes", "max_artifact_size"}
        return {names.get(f.name, f.name): getattr(self, f.name) for f in fields(self) if f.name not in gates and (f.name in always or getattr(self, f.name))}
