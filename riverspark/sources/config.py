"""Settings: flags, and scenario sheets in long form."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def parse_flag(raw: str | None, default: bool = False) -> bool:
    """yes, true, on and 1 (any case, blanks around) are true; empty is the default; all else is false."""
    text = (raw or "").strip().lower()
    return default if not text else text in {"1", "true", "yes", "on", "y"}


def scenario_rows(sheet: Iterable[Mapping]) -> list[tuple[str, str, float, float]]:
    """(scenario, indicator, weight, csi_thresh) of the rows of a scenario sheet that are to be processed."""
    rows = []
    for r in sheet:
        if int(r.get("to_process", 1)) != 1:
            continue
        n = 1
        while f"indicator_{n}" in r:
            rows.append((r["scenario_name"], r[f"indicator_{n}"], float(r[f"weight_{n}"]), float(r["csi_thresh"])))
            n += 1
    return rows


def scenario_fields(scenario: str) -> dict[str, str]:
    """Names of a scenario's columns on export."""
    return {"csi": scenario, "dom": f"{scenario}_D", "ff": f"{scenario}_FF", "status1": f"{scenario}_FF1", "status2": f"{scenario}_FF2", "stretch": f"{scenario}_FFID"}


def positive(name: str, value: int) -> int:
    """value, or ValueError unless it is at least 1."""
    if value < 1:
        raise ValueError(f"{name} must be at least 1, not {value}")
    return value
