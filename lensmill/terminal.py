"""Plain tables of what the commands found, for a terminal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lensmill.functions.show import elapsed, percent, thousands
from lensmill.operators import vectors
from lensmill.schema import CATEGORIES

_LABEL = dict(CATEGORIES)


def table(head: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """Columns as wide as their widest cell, the first to the left and the others to the right; None is a dash."""
    cells = [list(head), *([("-" if v is None else str(v)) for v in r] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    line = lambda r: "  ".join([r[0].ljust(width[0]), *(c.rjust(w) for c, w in zip(r[1:], width[1:]))]).rstrip()
    return "\n".join([line(cells[0]), "-" * (sum(width) + 2 * len(width) - 2), *map(line, cells[1:])])


def _share(v: float | None) -> str:
    return "-" if v is None else percent(v)


def _p(p: float | None) -> str:
    return "nothing changed sides" if p is None else "p < 0.0001" if p < 0.0001 else f"p = {p:.4f}"


def crawls(reports: list[dict]) -> str:
    """A summary of each crawl, with a warning where windows were left open."""
    out = []
    for r in reports:
        mode = f"top-up, reviews after {r['top_up_from']}" if r["top_up_from"] else "resumed a crawl that broke off" if r["resumed"] else "whole corpus"
        lines = [("mode", mode), ("windows", r["shards"]), ("pages", r["pages"]), ("unique", thousands(r["unique"])), ("duplicates", f"{thousands(r['duplicates_this_run'])} (this run)"), ("stated", thousands(r["stated"])), ("coverage", r["coverage"]), ("elapsed", elapsed(r["elapsed_secs"]))]
        if r["shards_restarted"]:
            lines.append(("walked again", r["shards_restarted"]))
        out.append("\n".join([f"app {r['app_id']}" + (f" ({r['review_score_desc']})" if r.get("review_score_desc") else ""), *(f"  {k:<13}{v}" for k, v in lines)]))
        if not r["complete"]:
            out.append(f"warning: {r['shards_short']} windows stayed short of what the store states and were left open; run the command again to walk them.")
    return "\n".join(out)


def classifications(facts: list[dict]) -> str:
    """Counts and rates of each app's categories, the most mentioned first."""
    out = []
    for f in facts:
        rows = sorted((c for c in f["categories"] if c["mention_count"]), key=lambda c: (-c["mention_count"], c["slot"]))
        cells = [(_LABEL[c["category"]], thousands(c["mention_count"]), percent(c["mention_rate"]), percent(c["primary_share"]), _share(c["positive_share"]), percent(c["top_mention_rate"]), "-" if c["bias_factor"] is None else f"{c['bias_factor']:.1f}") for c in rows]
        head = f"app {f['app_id']}: {thousands(f['reviews'])} reviews, {percent(f['positive'] / f['reviews'] if f['reviews'] else 0.0)} positive, {thousands(f['unmatched'])} without a vector"
        out.append("\n".join([head, *([f"note: {f['note']}"] if f["note"] else []), table(("category", "mentions", "of all", "mainly", "positive", "of the top", "bias"), cells)]))
    return "\n\n".join(out)


def slices(rows: list[dict]) -> str:
    """Agreement of each subset and, below it, of its clear-cut and contested labels, with 95 % intervals."""
    cells = []
    for r in rows:
        name = (r["subset"] or "no subset") if r["whole"] else "  contested" if r["ambiguous"] else "  clear-cut"
        cells.append((name, r["compared"], _share(r["agreement"]), "-" if r["low"] is None else f"[{r['low'] * 100:.1f}, {r['high'] * 100:.1f}]"))
    return table(("subset", "n", "agreement", "95 % interval"), cells)


def evaluations(found: list[dict]) -> str:
    """Agreement of each app, its slices, and its categories by reference mentions."""
    out = []
    for f in found:
        interval = "" if f["low"] is None else f" [{f['low'] * 100:.1f}, {f['high'] * 100:.1f}]"
        f1 = "-" if f["macro_f1"] is None else f"{f['macro_f1']:.3f}"
        cells = [(_LABEL.get(c["category"], c["category"]), c["ref_mentions"], c["pred_mentions"], c["mention_agreed"], _share(c["precision"]), _share(c["recall"]), "-" if c["f1"] is None else f"{c['f1']:.3f}", c["taken_for"]) for c in sorted(f["categories"].values(), key=lambda c: (-c["ref_mentions"], c["category"]))]
        out.append("\n".join([f"app {f['app_id']}: {_share(f['agreement'])}{interval} of {f['compared']} labels, macro F1 {f1}, {f['unmatched']} without a prediction", slices(f["slices"]), "", table(("category", "labels", "predicted", "agreed", "precision", "recall", "F1", "taken for"), cells)]))
    return "\n\n".join(out)


def fitted(f: dict) -> str:
    """What a fit chose, the evidence of each category, how it does on what was held back, and what the other objective would do."""
    lines = [f"fitted on {f['examples']} labels: smoothing {f['smoothing']:g}, secondary weight {f['secondary']:g}, scoring {f['scoring']}, margin {f['margin']:g}"]
    lines.append(table(("category", "evidence", "learned"), [(_LABEL[a["category"]], f"{a['evidence']:g}", percent(a["learned"])) for a in f["anchors"]]))
    lines.append(f"on {f['held_back']} labels held back: {_share(f['agreement'])}" + ("" if f["macro_f1"] is None else f", macro F1 {f['macro_f1']:.3f}"))
    if f["other"]:
        o = f["other"]
        lines.append(f"fitted for {o['objective']} instead: {_share(o['agreement'])}, macro F1 {o['macro_f1']:.3f}; {o['gained']} labels for this fit, {o['lost']} for that, {_p(o['p'])}")
    return "\n".join(lines)


def _by_app(rows: list) -> list:
    return sorted(rows, key=lambda r: (r.app is None, r.app or 0))


def transfers(verdicts: DataFrame) -> str:
    """The transfer table over all labels held back, over the clear-cut and over the contested ones."""
    verdicts = verdicts.cache()
    out = []
    for contested, what in ((None, "all labels held back"), (False, "clear-cut ones"), (True, "contested ones")):
        rows = _by_app(vectors.transfer_table(verdicts, contested).collect())
        cells = [("all" if r.app is None else r.app, r.n, _share(r.written / r.n if r.n else None), _share(r.same / r.n if r.n else None), _share(r.unseen / r.n if r.n else None), f"+{r.gained} / -{r.lost}", _p(r.p)) for r in rows]
        out.append(what + "\n" + table(("left out", "n", "descriptions", "all apps", "other apps", "changed", "exact test"), cells))
    verdicts.unpersist()
    return "\n\n".join(out)


def comparison(first: DataFrame, second: DataFrame) -> str:
    """Two encoders on the same labels held back, by the fit on other apps."""
    rows = _by_app(vectors.compare_encoders(first, second).collect())
    cells = [("all" if r.app is None else r.app, r.n, _share(r["first"] / r.n), _share(r["second"] / r.n), f"+{r.gained} / -{r.lost}", _p(r.p)) for r in rows]
    return table(("left out", "n", "first", "second", "changed", "exact test"), cells)
