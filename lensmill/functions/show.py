"""Formats of the report page, computed on the driver."""

from __future__ import annotations

import html


def percent(rate: float) -> str:
    """One decimal; below a tenth of a percent it says so rather than 0.0%."""
    return "<0.1%" if 0 < rate < 0.001 else f"{rate * 100:.1f}%"


def coverage(share: float | None) -> str:
    """Two decimals that never round up to the whole."""
    if share is None:
        return "unknown"
    return ">99.99%" if 0.99995 <= share < 1 else f"{share * 100:.2f}%"


def thousands(n: int) -> str:
    return f"{n:,}"


def hours(minutes: int) -> str:
    return f"{minutes} min" if minutes < 60 else f"{thousands(minutes // 60)} h"


def elapsed(seconds: int) -> str:
    h, rest = divmod(seconds, 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m:02d}m" if h else f"{m}m {s:02d}s" if m else f"{s}s"


def escape(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&#39;")


def title(name: str | None, appid: int) -> str:
    return name or f"App {appid}"


def provenance(fitted_from: list[int]) -> str:
    """What anchors were made from: their descriptions, or labels of the named apps."""
    return "fitted:" + "+".join(map(str, fitted_from)) if fitted_from else "descriptions"


def built_from(anchors: list[str]) -> str:
    """A sentence on the anchors of a classification; several kinds are called mixed."""
    if len(anchors) > 1:
        return "Built from a mixture of anchors: " + ", ".join(sorted(anchors)) + "."
    if not anchors or anchors[0] == "descriptions":
        return "Built from the category descriptions alone."
    return f"Built from labelled examples ({anchors[0]})."
