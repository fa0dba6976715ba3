"""One self-contained HTML page from the aggregates of one or several apps, and tables for the terminal.

Only aggregates and a few quoted reviews of each app come to the driver; the page never needs the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.functions.show import built_from, coverage, escape, percent, thousands, title
from lensmill.functions.stats import Z
from lensmill.functions.text import day_name, review_url
from lensmill.operators import rates, sampling
from lensmill.schema import ALONE, BOUNDARIES, CATEGORIES, DESCRIPTIONS, LANGUAGES, RIGHT_TO_LEFT
from lensmill.shared import write_text

#: Reviews a month needs to be drawn, reference mentions a category needs to be judged, recall under which it is thin, languages named.
MONTH_LEAST, MENTIONS_LEAST, THIN_RECALL, LANGUAGES_SHOWN = 30, 10, 0.25, 12
#: Reviews of the top of the pile that a page shows.
TOP_SHOWN = 10
_LABEL = dict(CATEGORIES)
_TAG = {name: (tag, shown) for name, tag, shown in LANGUAGES}


@dataclass
class Quote:
    category: str
    text: str
    language: str
    votes: int
    url: str | None
    day: str = ""
    positive: bool | None = None
    mentions: list[str] = field(default_factory=list)


@dataclass
class App:
    """What the page says about one app."""

    appid: int
    name: str | None = None
    reviews: int = 0
    positive: int = 0
    captured_share: float | None = None
    captured: int | None = None
    stated: int | None = None
    top_reviews: int = 0
    categories: list[dict] = field(default_factory=list)
    months: list[dict] = field(default_factory=list)
    languages: list[tuple[str, int]] = field(default_factory=list)
    quotes: list[Quote] = field(default_factory=list)
    top: list[Quote] = field(default_factory=list)
    trends: dict[str, list[tuple[str, float]]] = field(default_factory=dict)  # by category: share of a month's reviews
    anchors: list[str] = field(default_factory=list)
    agreement: dict | None = None


def build(reviews: DataFrame, assigned: DataFrame, apps: list[int], quotes: int = 4, names: dict[int, str] | None = None, covered: DataFrame | None = None, store: str = "https://store.invalid") -> list[App]:
    """The page's content for a few apps. Aggregation and the choice of quotes run in Spark; only their results are collected."""
    chosen = reviews.where(F.col("appid").isin(apps)).cache()
    tags = assigned.join(chosen.select("recommendationid"), "recommendationid", "left_semi").cache()
    joined = chosen.join(tags, "recommendationid")
    out = {a: App(a, (names or {}).get(a)) for a in apps}
    for r in rates.category_rates(chosen, tags).orderBy("appid", F.desc("mention_count"), "slot").collect():
        app = out[r.appid]
        app.reviews, app.top_reviews = r.reviews, r.top_reviews
        app.categories.append(r.asDict())
    for r in rates.months(chosen).orderBy("appid", "month").collect():
        out[r.appid].months.append(r.asDict())
        out[r.appid].positive += r.positive
    size = {(a.appid, m["month"]): m["reviews"] for a in out.values() for m in a.months}
    counted = {(r.appid, r.month, r.category): r.mentions for r in rates.month_categories(joined, ["appid"]).collect()}
    for app in out.values():  # months without a mention count as 0, months of few reviews not at all
        drawn = [m["month"] for m in app.months if m["reviews"] >= MONTH_LEAST]
        app.trends = {c: [(m, counted.get((app.appid, m, c), 0) / size[app.appid, m]) for m in drawn] for c, _ in CATEGORIES}
    for r in chosen.groupBy("appid", "language").agg(F.count("*").alias("n")).orderBy("appid", F.desc("n"), "language").collect():
        out[r.appid].languages.append((r.language or "unknown", r.n))
    for r in joined.groupBy("appid").agg(F.array_sort(F.collect_set("anchors")).alias("anchors")).collect():
        out[r.appid].anchors = r.anchors
    top = rates.top_of_pile(chosen).select("recommendationid", "appid", "rank").join(tags.select("recommendationid", "mentions"), "recommendationid")
    picked = sampling.quoted(sampling.shortlist(joined, quotes), top, quotes)
    author = F.col("author_steamid") if "author_steamid" in chosen.columns else F.lit("")
    card = chosen.select("recommendationid", "review", "language", "votes_up", "voted_up", day_name("timestamp_created").alias("day"), review_url(author, F.col("appid"), store).alias("url"))
    full = picked.join(card, "recommendationid")
    for r in full.orderBy("appid", "category", "quote").collect():
        out[r.appid].quotes.append(Quote(r.category, r.review, r.language, r.votes_up, r.url, r.day, r.voted_up))
    for r in top.where(F.col("rank") <= TOP_SHOWN).join(card, "recommendationid").orderBy("appid", "rank").collect():
        out[r.appid].top.append(Quote("", r.review, r.language, r.votes_up, r.url, r.day, r.voted_up, r.mentions))
    if covered is not None:
        for r in covered.where(F.col("appid").isin(apps)).collect():
            app = out[r.appid]
            app.captured_share, app.captured, app.stated = r.coverage, r.captured, r.stated
    chosen.unpersist()
    tags.unpersist()
    return [out[a] for a in apps]


def headline(app: App) -> str:
    """What the top of the pile exaggerates most, if it says it often enough."""
    enough = [c for c in app.categories if c["mention_count"] and c["top_mention_count"] >= max(2, -(-app.top_reviews // 10))]
    if not enough:
        return "The most helpful reviews talk about the same things as everyone else."
    worst = max(enough, key=lambda c: (c["bias_factor"], c["slot"]))
    return f"The most helpful reviews mention {_LABEL[worst['category']].lower()} {worst['bias_factor']:.1f} times as often as all reviews do."


def month_chart(months: list[dict]) -> str:
    """Bars of reviews a month as SVG; nothing with fewer than two months."""
    if len(months) < 2:
        return ""
    peak = max(m["reviews"] for m in months)
    bars = "".join(f'<rect x="{i * 8}" y="{60 - 60 * m["reviews"] / peak:.1f}" width="7" height="{60 * m["reviews"] / peak:.1f}"><title>{m["month"]}: {m["reviews"]}</title></rect>' for i, m in enumerate(months))
    return f'<svg class="months" viewBox="0 0 {len(months) * 8} 60" role="img" aria-label="reviews by month">{bars}</svg>'


def sparkline(points: list[tuple[str, float]]) -> str:
    """A line through the shares of the months with enough reviews; nothing with fewer than three."""
    if len(points) < 3:
        return ""
    peak = max(v for _, v in points) or 1.0
    path = " ".join(f"{i * 60 / (len(points) - 1):.1f},{16 - 15 * v / peak:.1f}" for i, (_, v) in enumerate(points))
    return f'<svg class="spark" viewBox="0 0 60 16"><title>{points[0][0]} to {points[-1][0]}</title><polyline points="{path}"/></svg>'


def thin_note(scores: dict | None) -> str:
    """A mark for a category that the classifier rarely finds; only where the labels mention it often enough to tell."""
    if not scores or scores["ref_mentions"] < MENTIONS_LEAST or scores["recall"] is None or scores["recall"] >= THIN_RECALL:
        return ""
    other = f", mostly taken for {_LABEL.get(scores['taken_for'], scores['taken_for'])}" if scores.get("taken_for") else ""
    return f'<span class="thin">thinly measured: found in {percent(scores["recall"])} of labelled cases{other}</span>'


def _language(name: str) -> str:
    tag, shown = _TAG.get(name, ("", name))
    way = ' dir="rtl"' if tag in RIGHT_TO_LEFT else ""
    return f"<span{way}>{escape(shown)}</span>"


_LEGEND = (
    "<p class=\"legend\"><b>of all reviews</b>: share of all that mention it. <b>mainly</b>: share that are mainly about it. <b>positive</b>: of those that mention it. "
    "<b>of the top</b>: share of the most helpful reviews that mention it. <b>bias</b>: how many times as often the top mentions it; the bar stands left of the middle for less often. "
    "The line is its share month by month.</p>"
)


def _gauge(bias: float | None) -> str:
    """A bar between -1 and 1 for how the top exaggerates; a doubling is a third of the way."""
    if bias is None:
        return ""
    at = -1.0 if bias <= 0 else max(-1.0, min(1.0, math.log2(bias) / 3))
    return f'<meter min="-1" max="1" value="{at:.2f}">{bias:.1f}</meter>'


def _categories(app: App) -> str:
    scores = (app.agreement or {}).get("categories", {})
    by: dict[str, list[Quote]] = {}
    for q in app.quotes:
        by.setdefault(q.category, []).append(q)
    rows = []
    for c in app.categories:
        if not c["mention_count"]:
            continue
        name = c["category"]
        bias = "" if c["bias_factor"] is None else f"{c['bias_factor']:.1f}"
        evidence = f'<details class="evidence" id="app-{app.appid}-{name}"><summary>{len(by[name])} in their words</summary>{"".join(map(_quote, by[name]))}</details>' if name in by else ""
        rows.append(
            f'<tr data-name="{escape(_LABEL[name].lower())}"><th>{escape(_LABEL[name])} {sparkline(app.trends.get(name, []))} {thin_note(scores.get(name))}{evidence}</th><td>{percent(c["mention_rate"])}</td>'
            f'<td>{percent(c["primary_share"])}</td><td>{percent(c["positive_share"] or 0.0)}</td><td>{percent(c["top_mention_rate"])}</td><td>{bias} {_gauge(c["bias_factor"])}</td></tr>'
        )
    head = "<tr><th>Category</th><th>of all reviews</th><th>mainly</th><th>positive</th><th>of the top</th><th>bias</th></tr>"
    return f'{_LEGEND}<table class="categories sortable"><thead>{head}</thead><tbody>{"".join(rows)}</tbody></table>'


def _quote(q: Quote) -> str:
    tag, _ = _TAG.get(q.language, ("", ""))
    lang = f' lang="{tag}"' if tag else ""
    way = ' dir="rtl"' if tag in RIGHT_TO_LEFT else ""
    body = escape(q.text.strip())
    if len(q.text.strip()) > 320:
        body = f"<details><summary>{escape(q.text.strip()[:320])}…</summary>{body}</details>"
    link = f' <a href="{escape(q.url)}" rel="noopener">source</a>' if q.url else ""
    facts = [{True: "recommended", False: "not recommended"}.get(q.positive, ""), escape(q.day), ", ".join(escape(_LABEL.get(m, m)) for m in q.mentions)]
    return f"<blockquote{lang}{way}>{body}<footer>{thousands(q.votes)} found this helpful{''.join(f' · {x}' for x in facts if x)}{link}</footer></blockquote>"


def _top(app: App) -> str:
    """The most helpful reviews themselves, in their order."""
    if not app.top:
        return ""
    return f'<details class="pile"><summary>The top of the pile: the first {len(app.top)} of {app.top_reviews}</summary><ol>{"".join(f"<li>{_quote(q)}</li>" for q in app.top)}</ol></details>'


def interval(agreed: int, compared: int) -> tuple[float, float] | None:
    """95 % Wilson interval; None of nothing."""
    if not compared:
        return None
    p, z2 = agreed / compared, Z * Z
    half = Z * math.sqrt(p * (1 - p) / compared + z2 / (4 * compared * compared))
    return max(0.0, (p + z2 / (2 * compared) - half) / (1 + z2 / compared)), min(1.0, (p + z2 / (2 * compared) + half) / (1 + z2 / compared))


def pooled_agreement(apps: list[App]) -> dict | None:
    """Agreement over several apps from their summed counts, never from their rates; None unless there are several and all were measured."""
    if len(apps) < 2 or not all(a.agreement and a.agreement.get("compared") for a in apps):
        return None
    agreed, compared = (sum(a.agreement[k] for a in apps) for k in ("agreed", "compared"))
    sums: dict[str, list[int]] = {}
    for a in apps:
        for name, c in a.agreement.get("categories", {}).items():
            if name in _LABEL:
                sums[name] = [x + (c.get(k) or 0) for x, k in zip(sums.get(name, [0, 0, 0]), ("ref_mentions", "pred_mentions", "mention_agreed"))]
    f1 = [2 * hit / (ref + pred) for ref, pred, hit in sums.values() if ref]
    low, high = interval(agreed, compared)
    return {"agreed": agreed, "compared": compared, "agreement": agreed / compared, "low": low, "high": high, "macro_f1": sum(f1) / len(f1) if f1 else None}


def _agreement(a: dict) -> str:
    out = f" It agrees with the reference labels on {percent(a['agreement'])} of {thousands(a['compared'])} reviews ({percent(a['low'])} to {percent(a['high'])})"
    out += f", macro F1 {a['macro_f1']:.2f}." if a.get("macro_f1") is not None else "."
    for r in a.get("slices", []):
        if not r["whole"] and r["compared"]:
            out += f" {'Contested' if r['ambiguous'] else 'Clear-cut'} labels of the subset {r['subset']}: {percent(r['agreement'])} of {thousands(r['compared'])}."
    return out


def _app(app: App) -> str:
    total = sum(n for _, n in app.languages) or 1
    rest = sum(n for _, n in app.languages[LANGUAGES_SHOWN:])
    langs = "".join(f"<li>{_language(name)} {percent(n / total)}</li>" for name, n in app.languages[:LANGUAGES_SHOWN]) + (f"<li>{len(app.languages) - LANGUAGES_SHOWN} others {percent(rest / total)}</li>" if rest else "")
    spark = sparkline([(m["month"], m["positive"] / m["reviews"]) for m in app.months if m["reviews"] >= MONTH_LEAST])
    trust = built_from(app.anchors) + (_agreement(app.agreement) if app.agreement and app.agreement.get("compared") else " It has not been measured against reference labels.")
    counts = "" if app.captured is None else f" of {thousands(app.captured)} captured" + ("" if app.stated is None else f" and {thousands(app.stated)} stated by the store")
    return (
        f'<article id="app-{app.appid}"><h2>{escape(title(app.name, app.appid))}</h2><p class="facts">{thousands(app.reviews)} reviews counted{counts}: {coverage(app.captured_share)} of what the store states, '
        f"{percent(app.positive / app.reviews if app.reviews else 0.0)} positive.</p><p class=\"headline\">{escape(headline(app))}</p>{month_chart(app.months)}{spark}{_categories(app)}"
        f'{_top(app)}<h3>Languages</h3><ul class="languages">{langs}</ul><p class="trust">{escape(trust)}</p></article>'
    )


def _matrix(apps: list[App]) -> str:
    """Categories by app, shaded by rate; only where there are several apps."""
    if len(apps) < 2:
        return ""
    rate = {(a.appid, c["category"]): c["mention_rate"] for a in apps for c in a.categories}
    pooled = {c: sum(x["mention_count"] for a in apps for x in a.categories if x["category"] == c) for c, _ in CATEGORIES}
    order = sorted((c for c in pooled if pooled[c]), key=lambda c: -pooled[c])
    rows = []
    for c in order:
        cells = [rate.get((a.appid, c), 0.0) for a in apps]
        shown = [percent(v) for v in cells]
        best = max(range(len(cells)), key=lambda i: (cells[i], i))
        leads = cells[best] >= 0.001 and shown.count(shown[best]) == 1
        rows.append(f"<tr><th>{escape(_LABEL[c])}</th>" + "".join(f'<td style="--heat:{min(1.0, (2 * v) ** 0.5):.2f}"{" class=leads" if leads and i == best else ""}>{s}</td>' for i, (v, s) in enumerate(zip(cells, shown))) + "</tr>")
    spread = [(max(rate.get((a.appid, c), 0.0) for a in apps) - min(rate.get((a.appid, c), 0.0) for a in apps), c) for c in order]
    wide = max(spread, key=lambda x: x[0], default=(0.0, ""))
    note = f"<p>The apps are furthest apart on {escape(_LABEL[wide[1]].lower())}.</p>" if wide[0] >= 0.001 else ""
    head = "<tr><th></th>" + "".join(f"<th>{escape(title(a.name, a.appid))}</th>" for a in apps) + "</tr>"
    return f'<section id="matrix"><h2>Side by side</h2>{note}<table class="matrix"><thead>{head}</thead><tbody>{"".join(rows)}</tbody></table></section>'


_STYLE = (
    "body{font:16px/1.5 system-ui;margin:2rem auto;max-width:70rem;padding:0 1rem;--ink:#222;--paper:#fff;--bar:#5078c8;color:var(--ink);background:var(--paper)}table{border-collapse:collapse;width:100%}td,th{padding:.3rem .5rem;text-align:left;vertical-align:top}"
    ".matrix td{background:rgb(80 120 200/calc(var(--heat)*60%))}.leads{font-weight:700}svg.months{width:100%;height:4rem}svg.spark{width:4rem;height:1rem}rect{fill:var(--bar)}polyline{fill:none;stroke:var(--bar)}.thin,.legend{font-size:.8em;opacity:.7}th{font-weight:600}"
    "@media print{input,button,nav{display:none}}body[data-theme=dark]{--ink:#e8e8e8;--paper:#16181c}@media (prefers-color-scheme:dark){body:not([data-theme=light]){--ink:#e8e8e8;--paper:#16181c}}"
)
_SCRIPT = """
const all = selector => [...document.querySelectorAll(selector)];
const find = document.querySelector('#find');
find.addEventListener('input', () => {
  const wanted = find.value.toLowerCase();
  for (const row of all('tr[data-name]')) row.hidden = !row.dataset.name.includes(wanted);
});
for (const table of all('.sortable')) {
  table.tHead.addEventListener('click', event => {
    const column = event.target.closest('th')?.cellIndex, body = table.tBodies[0];
    if (column === undefined) return;
    const down = table.dataset.by === String(column) && table.dataset.way !== 'down';
    const value = row => parseFloat(row.cells[column].textContent.replace('<', '')) || row.cells[column].textContent;
    [...body.rows].sort((a, b) => (value(a) > value(b) ? 1 : -1) * (down ? -1 : 1)).forEach(row => body.append(row));
    table.dataset.by = column;
    table.dataset.way = down ? 'down' : 'up';
  });
}
const fold = document.querySelector('#fold');
fold.addEventListener('click', () => {
  const open = fold.dataset.open !== 'yes';
  for (const part of all('details')) part.open = open;
  fold.dataset.open = open ? 'yes' : 'no';
});
const follow = () => {
  let part = location.hash.length > 1 && document.getElementById(decodeURIComponent(location.hash.slice(1)));
  if (!part) return;
  part.scrollIntoView();
  for (; part; part = part.parentElement) if (part.tagName === 'DETAILS') part.open = true;
};
addEventListener('hashchange', follow);
follow();
for (const part of all('details[id]')) part.addEventListener('toggle', () => part.open && history.replaceState(null, '', '#' + part.id));
let closed = [];
addEventListener('beforeprint', () => { closed = all('details:not([open])'); closed.forEach(part => part.open = true); });
addEventListener('afterprint', () => closed.forEach(part => part.open = false));
document.querySelector('#theme').addEventListener('click', () => {
  const dark = document.body.dataset.theme ? document.body.dataset.theme === 'dark' : matchMedia('(prefers-color-scheme: dark)').matches;
  document.body.dataset.theme = dark ? 'light' : 'dark';
});
"""


def _overview(apps: list[App]) -> str:
    """The corpora side by side: size, verdict, what was captured, what leads, what the top exaggerates, how far to trust it."""
    rows = []
    for a in apps:
        said = max((c for c in a.categories if c["mention_count"]), key=lambda c: (c["mention_count"], -c["slot"]), default=None)
        trust = f"{percent(a.agreement['agreement'])} ({percent(a.agreement['low'])} to {percent(a.agreement['high'])})" if a.agreement and a.agreement.get("compared") else "not measured"
        cells = [thousands(a.reviews), percent(a.positive / a.reviews if a.reviews else 0.0), coverage(a.captured_share), escape(_LABEL[said["category"]]) if said else "", trust]
        rows.append(f'<tr><th><a href="#app-{a.appid}">{escape(title(a.name, a.appid))}</a></th>' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
    head = "<tr><th></th><th>reviews</th><th>positive</th><th>captured</th><th>most mentioned</th><th>agreement</th></tr>"
    pooled = pooled_agreement(apps)
    note = f'<p class="pooled">Over all {len(apps)} apps:{escape(_agreement(pooled))}</p>' if pooled else ""
    return f'<table class="overview sortable"><thead>{head}</thead><tbody>{"".join(rows)}</tbody></table>{note}'


_LIMITS = "Shares are of all non-blank reviews. Categories are assigned by similarity, and a review may have several. Agreement is with labels, which are no truth, and only with labels that nothing was fitted on."


def render(apps: list[App], heading: str = "What the reviews say") -> str:
    """The page. All text that comes from reviews or names is escaped."""
    nav = "".join(f'<li><a href="#app-{a.appid}">{escape(title(a.name, a.appid))}</a></li>' for a in apps)
    return (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(heading)}</title><style>{_STYLE}</style></head><body><h1>{escape(heading)}</h1>'
        f'<input id="find" type="search" placeholder="Filter categories"> <button id="fold">Open or close all</button> <button id="theme">Light or dark</button><nav><ul>{nav}</ul></nav>{_overview(apps)}{_matrix(apps)}{"".join(map(_app, apps))}'
        f"<footer><p>{_LIMITS}</p></footer><script>{_SCRIPT}</script></body></html>"
    )


def save(apps: list[App], path: str) -> None:
    write_text(path, render(apps))


def labelling_brief(descriptions: dict[str, str] | None = None) -> str:
    """Instructions for whoever labels a sample: every category once, in order, where two meet, which stand alone, and what an answer looks like."""
    what = DESCRIPTIONS | (descriptions or {})
    lines = ["Label each review with one primary category and up to three secondary ones.", ""]
    lines += [f"{c}: {label}. {what[c]}" for c, label in CATEGORIES]
    lines += ["", "Where two categories meet:"] + [f"{a} or {b}: {rule}" for a, b, rule in BOUNDARIES]
    lines += ["", f"These stand alone, with no secondary category: {', '.join(ALONE)}."]
    lines += ["", 'Answer with a JSON array of {"id", "primary", "secondary", "ironic", "confidence", "ambiguous"}.']
    return "\n".join(lines) + "\n"
