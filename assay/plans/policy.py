"""What decides whether a payload is accepted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from assay.functions.names import DANGEROUS_EXTENSIONS
from assay.functions.rules import Rule, rules
from assay.functions.values import MEDIUM
from assay.operators.archive import ArchiveLimits
from assay.operators.svg import SvgPolicy


@dataclass(frozen=True)
class Policy:
    """Rules name types (`image/*`, `application/pdf`, `.docx`, `category:archive`) and hold for the detected type, never the declared one."""

    allowed: Sequence[str | Rule] | None = None
    blocked: Sequence[str | Rule] = ("category:executable", "category:script")
    max_size: int | None = None
    min_size: int = 1
    require_extension: bool = True
    strict_extension: bool = True
    check_content_type: bool = True
    allow_unknown: bool = False
    sanitize_svg: bool = True
    svg_policy: SvgPolicy = field(default_factory=SvgPolicy)
    inspect_archives: bool = True
    archive_limits: ArchiveLimits = field(default_factory=ArchiveLimits)
    polyglot_scan_limit: int = 1 << 20
    check_trailing_data: bool = True
    dangerous_extensions: frozenset[str] = DANGEROUS_EXTENSIONS
    flag_browser_active_extensions: bool = False
    filename_max_length: int = 255
    reject_threshold: int = MEDIUM
    filename_replacement: str = "_"
    ascii_filenames: bool = False

    def __post_init__(self) -> None:
        rules(self.allowed)  # a bad rule fails here, not in a job
        rules(self.blocked)

    def with_(self, **changes) -> Policy:
        return replace(self, **changes)
