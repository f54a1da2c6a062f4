"""Option bundles, and a plan applied to them: what a caller set explicitly
wins over the plan, the plan wins over the profile."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    chunk_tokens: int = 512
    top_k: int = 5
    merge_siblings: bool = True
    context_text: bool = True
    window_pages: int = 100
    table_mode: str = "auto"
    figures: bool = False
    domain: str | None = None


PROFILES: dict[str, Options] = {
    "default": Options(),
    "retrieval": Options(chunk_tokens=384, figures=True),
    "technical": Options(domain="nvme", table_mode="auto"),
    "visual": Options(figures=True, window_pages=50),
    "fast": Options(merge_siblings=False, context_text=False, window_pages=250),
    "review": Options(table_mode="html", top_k=10),
}


def window_pages(n_pages: int, tables_per_page: float, figures_per_page: float) -> int:
    """Smaller windows for dense pages, one window for small documents."""
    if n_pages <= 50:
        return max(n_pages, 1)
    dense = tables_per_page + figures_per_page
    return 25 if dense >= 2 else 50 if dense >= 0.5 else 100


def apply_plan(profile: str, plan: dict[str, Any], explicit: dict[str, Any]) -> tuple[Options, dict[str, str]]:
    """(options, why each is as it is). Unknown names are an error."""
    base = PROFILES[profile]
    known = set(asdict(base))
    if bad := (set(plan) | set(explicit)) - known:
        raise ValueError(f"unknown options: {sorted(bad)}")
    why = {k: "explicit" if k in explicit else "plan" if k in plan else "profile" for k in known}
    return replace(base, **{**plan, **explicit}), why
