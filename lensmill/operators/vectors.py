"""Vectors of texts: embedding, anchors, similarity, assignment, fitting.

Vectors are arrays of float or double. Anchors are a few rows and live on the driver as a numpy
matrix; reviews meet them in Arrow batches. Assignment is computed once per distinct text, before
the join to the reviews that share it.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.functions.stats import mcnemar
from lensmill.functions.text import not_blank, text_key
from lensmill.schema import ALONE_SLOTS, CATEGORY_IDS, MENTION_MARGIN, MOST_MENTIONS, SPINE_VERSION
from lensmill.shared import read_text, write_text

#: The grids that a fit is searched over.
SMOOTHING, SECONDARY, SCORING = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0), (0.0, 0.25, 0.5, 1.0), ("raw", "bias", "centred")
MARGINS = (0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.06)
#: Fixed value: the subset of labels that is held back from fitting.
HOLDOUT = "random"
#: Fixed value: norms up to this are not divided by.
EPSILON = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > EPSILON, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


@dataclass(frozen=True)
class Encoder:
    """A registered text encoder: its width, how token vectors are pooled, a prefix for every text, and the tokens it reads (None: all)."""

    name: str
    dimensions: int
    pooling: str = "mean"
    prefix: str = ""
    most_tokens: int | None = 512


#: No encoder weights ship with the library. ``hashing`` is a deterministic stand-in with the same interface; it reads all
#: words of a text and pools their mean, since a word's hash, unlike a trained first token, says nothing of the others.
ENCODERS = {e.name: e for e in (Encoder("hashing", 64, most_tokens=None), Encoder("hashing-wide", 768, "mean", "query: ", None))}
#: Words whose vectors are held at once.
WORDS_AT_ONCE = 512


def pool(hidden: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """Token vectors (rows x tokens x dimensions) to one unit vector a row: the masked mean or the first token."""
    if pooling == "cls":
        out = hidden[:, 0, :].astype(np.float64)
    else:
        weight = mask[:, :, None].astype(np.float64)
        out = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > EPSILON, out / np.maximum(norm, EPSILON), out).astype(np.float32)


def hashing_forward(encoder: Encoder) -> Callable[[list[str]], np.ndarray]:
    """An encoder without weights: words hash to fixed random vectors, which are pooled."""

    def vector(word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")
        return np.random.default_rng(seed).standard_normal(encoder.dimensions)

    known: dict[str, np.ndarray] = {}

    def forward(texts: list[str]) -> np.ndarray:
        if len(known) > 50_000:
            known.clear()
        out = []
        for text in texts:
            words = (encoder.prefix + text).lower().split()[: encoder.most_tokens] or [""]
            if encoder.pooling == "cls":
                words = words[:1]
            total = np.zeros(encoder.dimensions)
            for at in range(0, len(words), WORDS_AT_ONCE):
                total += np.stack([known[w] if w in known else known.setdefault(w, vector(w)) for w in words[at : at + WORDS_AT_ONCE]]).sum(axis=0)
            out.append(pool(total[None, None] / len(words), np.ones((1, 1)), "mean")[0])
        return np.stack(out) if out else np.zeros((0, encoder.dimensions), dtype=np.float32)

    return forward


def embedded(reviews: DataFrame, encoder: Encoder, forward: Callable[[Encoder], Callable[[list[str]], np.ndarray]] = hashing_forward, batch: int = 64) -> DataFrame:
    """One vector for each distinct non-blank text: ``text_sha256, appid, n_reviews, model, embedding``.

    Texts are sorted by length within a partition, so a batch holds texts of like length. The model
    is made once per task by ``forward``.
    """
    distinct = reviews.where(not_blank("review")).groupBy("appid", text_key("review").alias("text_sha256")).agg(F.first("review").alias("review"), F.count("*").alias("n_reviews"))

    def run(frames):
        model = forward(encoder)
        for frame in frames:
            texts = frame["review"].tolist()
            vectors = [model(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            frame = frame.drop(columns=["review", "size"])
            frame["model"] = encoder.name
            frame["embedding"] = list(np.concatenate(vectors)) if vectors else []
            yield frame

    sorted_ = distinct.withColumn("size", F.char_length("review")).sortWithinPartitions("size")
    return sorted_.mapInPandas(run, "appid bigint, text_sha256 string, n_reviews bigint, model string, embedding array<float>")


def centroid(vectors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean vector over distinct texts in long form: ``by..., pos, value``."""
    each = vectors.select(*by, F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def pooled_centroid(vectors: DataFrame, by: str) -> DataFrame:
    """Mean of the groups' means, each group with weight 1."""
    return centroid(vectors, [by]).groupBy("pos").agg(F.avg("value").alias("value"))


def collect_vector(long: DataFrame) -> np.ndarray:
    """A long-form vector of fixed width as numpy."""
    return np.array([r.value for r in long.orderBy("pos").collect()])


@dataclass
class Anchors:
    """One unit vector per category and how it came about."""

    vectors: np.ndarray
    model: str = "hashing"
    fitted_from: list[int] = field(default_factory=list)
    evidence: np.ndarray | None = None
    share: np.ndarray | None = None
    bias: np.ndarray | None = None
    centre: np.ndarray | None = None
    margin: float = MENTION_MARGIN
    scoring: str = "raw"
    version: str = SPINE_VERSION

    def prepare(self, scoring: str, centroid: np.ndarray) -> Anchors:
        """Raw scoring changes nothing; ``bias`` subtracts what the average text scores; ``centred`` moves the origin there."""
        out = replace(self, scoring=scoring, bias=None, centre=None)
        if scoring == "raw" or len(centroid) != self.vectors.shape[1]:
            return out
        if scoring == "bias":
            out.bias = self.vectors @ centroid
        else:
            out.centre, out.vectors = centroid, _unit(self.vectors - centroid)
        return out

    def similarities(self, x: np.ndarray) -> np.ndarray:
        """Similarity of each row of ``x`` to each anchor."""
        x = x.astype(np.float64)
        if self.centre is not None:
            x = _unit(x - self.centre)
        sims = x @ self.vectors.T
        return sims - self.bias if self.bias is not None else sims

    def save(self, path: str) -> None:
        n = len(self.vectors)
        zero = np.zeros(n)
        rows = zip(CATEGORY_IDS, zero if self.evidence is None else self.evidence, zero if self.share is None else self.share, zero if self.bias is None else self.bias, self.vectors)
        what = {"spine_version": self.version, "model": self.model, "fitted_from": self.fitted_from, "params": {"mention_margin": self.margin, "scoring": self.scoring},
                "centre": None if self.centre is None else self.centre.tolist(), "categories": [{"id": c, "evidence": float(e), "learned_share": float(s), "bias": float(b), "vector": v.tolist()} for c, e, s, b, v in rows]}
        write_text(path, json.dumps(what))

    @classmethod
    def load(cls, path: str, version: str = SPINE_VERSION) -> Anchors:
        """Refuses another taxonomy version, another order of categories and vectors of unequal width."""
        what = json.loads(read_text(path))
        ids = [c["id"] for c in what["categories"]]
        if what["spine_version"] != version:
            raise ValueError(f"anchors are of taxonomy {what['spine_version']}, not {version}")
        if tuple(ids) != CATEGORY_IDS[: len(ids)]:
            raise ValueError("anchors list the categories in another order")
        if len({len(c["vector"]) for c in what["categories"]}) > 1:
            raise ValueError("anchors differ in width")
        get = lambda k: np.array([c[k] for c in what["categories"]])
        bias, params = get("bias"), what["params"]
        return cls(get("vector"), what["model"], what["fitted_from"], get("evidence"), get("learned_share"), bias if bias.any() else None, None if what["centre"] is None else np.array(what["centre"]), params["mention_margin"], params["scoring"], version)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(norm > EPSILON, x / np.maximum(norm, EPSILON), x)


def refuse_foreign(anchors: Anchors, model: str) -> None:
    """Anchors of one encoder say nothing about vectors of another."""
    if anchors.model != model:
        raise ValueError(f"the anchors were made with {anchors.model}, the vectors with {model}")


def assign(sims: np.ndarray, margin: float = MENTION_MARGIN, alone: Sequence[int] = ALONE_SLOTS, most: int = MOST_MENTIONS) -> tuple[np.ndarray, np.ndarray]:
    """Primary slot and mentions (one boolean per slot) of each row of similarities.

    The last of the best wins. A primary that stands alone is the only mention; otherwise whatever
    comes within the margin is mentioned unless it stands alone. More than ``most`` mentions mean
    that the text says nothing in particular, and the primary is left.
    """
    k = sims.shape[1]
    primary = k - 1 - np.argmax(sims[:, ::-1], axis=1)
    own = np.arange(k)[None, :] == primary[:, None]
    single = np.zeros(k, dtype=bool)
    single[[s for s in alone if s < k]] = True
    near = (sims >= sims.max(axis=1, keepdims=True) - margin) & ~single | own
    reset = single[primary] | (near.sum(axis=1) > most)
    return primary, np.where(reset[:, None], own, near)


def assigned(vectors: DataFrame, anchors: Anchors, margin: float | None = None, keep: Sequence[str] = ("text_sha256",)) -> DataFrame:
    """``keep..., slot, score, mentions``: assignment of each vector; ``mentions`` are slots in order."""
    limit = anchors.margin if margin is None else margin

    def run(frames):
        for frame in frames:
            out = frame[list(keep)].copy()
            x = np.stack(frame["embedding"].to_numpy()) if len(frame) else np.zeros((0, anchors.vectors.shape[1]))
            sims = anchors.similarities(x)
            primary, mask = assign(sims, limit)
            out["slot"] = primary.astype(np.int32)
            out["score"] = sims[np.arange(len(sims)), primary]
            out["mentions"] = [np.flatnonzero(m).astype(np.int32) for m in mask]
            yield out

    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keep) + ", slot int, score double, mentions array<int>"
    return vectors.select(*keep, "embedding").mapInPandas(run, schema)


def classified(reviews: DataFrame, vectors: DataFrame, anchors: Anchors) -> DataFrame:
    """Reviews with the assignment of their text; texts without a vector drop out (see ``unmatched``)."""
    names = F.array(*[F.lit(c) for c in CATEGORY_IDS])
    tags = assigned(vectors, anchors).select("text_sha256", F.element_at(names, F.col("slot") + 1).alias("primary_category"), F.col("score").cast("float").alias("primary_score"), F.transform("mentions", lambda s: F.element_at(names, s + 1)).alias("mentions"))
    return reviews.withColumn("text_sha256", text_key("review")).join(tags, "text_sha256")


def unmatched(reviews: DataFrame, vectors: DataFrame) -> DataFrame:
    """Non-blank reviews whose text has no vector."""
    return reviews.where(not_blank("review")).withColumn("text_sha256", text_key("review")).join(vectors.select("text_sha256"), "text_sha256", "left_anti")


def weighted_sums(examples: DataFrame, secondary_weight: float) -> DataFrame:
    """``slot, pos, total, evidence``: sums of the vectors of labelled examples (``slot, secondary, embedding``), primaries with weight 1."""
    tags = F.concat(F.array(F.struct(F.col("slot").alias("slot"), F.lit(1.0).alias("w"))), F.transform(F.coalesce("secondary", F.array().cast("array<int>")), lambda s: F.struct(s.alias("slot"), F.lit(float(secondary_weight)).alias("w"))))
    each = examples.select("embedding", F.explode(tags).alias("t")).where("t.w > 0")
    long = each.select(F.col("t.slot").alias("slot"), F.col("t.w").alias("w"), F.posexplode("embedding").alias("pos", "x"))
    return long.groupBy("slot", "pos").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("total"), F.sum("w").alias("evidence"))


@dataclass
class Examples:
    """A bounded set of labelled vectors (a reference set has a few hundred rows) as numpy."""

    x: np.ndarray
    slot: np.ndarray
    secondary: list[list[int]]

    def take(self, rows: np.ndarray) -> Examples:
        return Examples(self.x[rows], self.slot[rows], [self.secondary[i] for i in rows])


def examples_of(labelled: DataFrame) -> Examples:
    """``id, slot, secondary, embedding`` in id order, as numpy."""
    rows = labelled.orderBy("id").collect()
    return Examples(np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.slot for r in rows], dtype=np.int64), [list(r.secondary or []) for r in rows])


def fit(descriptions: Anchors, e: Examples, smoothing: float, secondary_weight: float, apps: Sequence[int] = ()) -> Anchors:
    """Anchors between their description and the mean of their examples: the more evidence, the nearer to the mean."""
    k, d = descriptions.vectors.shape
    sums, evidence = np.zeros((k, d)), np.zeros(k)
    np.add.at(sums, e.slot, e.x)
    np.add.at(evidence, e.slot, 1)
    for row, others in enumerate(e.secondary):
        for s in others:
            sums[s] += secondary_weight * e.x[row]
            evidence[s] += secondary_weight
    share = evidence / (evidence + smoothing)
    blend = _unit((1 - share)[:, None] * descriptions.vectors + share[:, None] * _unit(sums))
    return replace(descriptions, vectors=np.where(evidence[:, None] > 0, blend, descriptions.vectors), evidence=evidence, share=share, fitted_from=list(apps))


def score(anchors: Anchors, e: Examples, margin: float) -> tuple[float, float]:
    """Share of primaries that agree, and macro F1 of mentions over the categories that occur."""
    primary, mask = assign(anchors.similarities(e.x), margin)
    reference = np.zeros_like(mask)
    reference[np.arange(len(e.slot)), e.slot] = True
    for row, others in enumerate(e.secondary):
        reference[row, others] = True
    hit, ref, pred = (mask & reference).sum(axis=0), reference.sum(axis=0), mask.sum(axis=0)
    f1 = 2 * hit / np.maximum(ref + pred, 1)
    return float((primary == e.slot).mean()) if len(e.slot) else 0.0, float(f1[ref > 0].mean()) if (ref > 0).any() else 0.0


def folds_of(n: int, folds: int) -> np.ndarray:
    """Fold of each example by its place in id order, in turn."""
    return np.arange(n) % folds


def _grid_values(e: Examples, base: Anchors, middle: np.ndarray, smoothing: float, secondary: float, scoring: str, folds: int, objective: str) -> np.ndarray:
    """Cross-validated score of one combination of parameters at each of ``MARGINS``."""
    fold, values = folds_of(len(e.slot), folds), np.zeros(len(MARGINS))
    for f in range(folds):
        train, test = e.take(np.flatnonzero(fold != f)), e.take(np.flatnonzero(fold == f))
        if len(test.slot):
            a = (base if np.isinf(smoothing) else fit(base, train, smoothing, secondary)).prepare(scoring, middle)
            values += [len(test.slot) * score(a, test, m)[objective != "primary"] for m in MARGINS]
    return values / max(1, len(e.slot))


def _grid(scorings: Sequence[str]) -> list[tuple[float, float, str]]:
    return list(product((*SMOOTHING, float("inf")), SECONDARY, scorings))


def searched(labelled: DataFrame, descriptions: Anchors, centroid: np.ndarray, folds: int = 5, objective: str = "primary", scorings: Sequence[str] = SCORING) -> DataFrame:
    """Cross-validated score of every combination of parameters: ``smoothing, secondary, scoring, margin, value``.

    The grid is spread over tasks and each fits all folds; a bounded set of examples goes to all of
    them. A row with infinite smoothing is the descriptions alone.
    """
    spark = labelled.sparkSession
    sent = spark.sparkContext.broadcast((examples_of(labelled), descriptions, centroid))

    def run(frames):
        e, base, middle = sent.value
        for frame in frames:
            out = []
            for s, w, how in frame[["smoothing", "secondary", "scoring"]].itertuples(index=False):
                out += [(s, w, how, m, v) for m, v in zip(MARGINS, _grid_values(e, base, middle, s, w, how, folds, objective))]
            yield pd.DataFrame(out, columns=["smoothing", "secondary", "scoring", "margin", "value"])

    grid = _grid(scorings)
    rows = spark.createDataFrame(grid, "smoothing double, secondary double, scoring string").repartition(min(len(grid), spark.sparkContext.defaultParallelism))
    return rows.mapInPandas(run, "smoothing double, secondary double, scoring string, margin double, value double")


def best_params(search: DataFrame) -> tuple[float, float, str, float]:
    """The best row; the first of the grid on ties."""
    order = {how: i for i, how in enumerate(SCORING)}
    rows = sorted(search.collect(), key=lambda r: (-r.value, r.smoothing, r.secondary, order[r.scoring], r.margin))
    return rows[0].smoothing, rows[0].secondary, rows[0].scoring, rows[0].margin


def split_labels(labelled: DataFrame, holdout: str = HOLDOUT) -> tuple[DataFrame, DataFrame]:
    """Labels to fit on, and those held back: the ones whose ``subset`` is ``holdout``. No label is in both."""
    held = F.coalesce(F.col("subset") == holdout, F.lit(False))
    return labelled.where(~held), labelled.where(held)


def embed_reviews(reviews: DataFrame, ids: DataFrame, encoder: Encoder, forward: Callable[[Encoder], Callable[[list[str]], np.ndarray]] = hashing_forward, batch: int = 64) -> DataFrame:
    """``id, embedding`` of the named reviews (``ids`` has ``id``), embedded afresh in batches of like length, ordered by length and id."""
    wanted = reviews.where(not_blank("review")).select(F.col("recommendationid").alias("id"), "review").join(ids.select("id").distinct(), "id", "left_semi")

    def run(frames):
        model = forward(encoder)
        for frame in frames:
            texts = frame["review"].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.DataFrame({"id": frame["id"], "embedding": vectors})

    return wanted.sortWithinPartitions(F.char_length("review"), "id").mapInPandas(run, "id string, embedding array<float>")


def agreements(anchors: Anchors, e: Examples, margin: float | None = None) -> np.ndarray:
    """Whether each example's primary is the category that its label gives."""
    return assign(anchors.similarities(e.x), anchors.margin if margin is None else margin)[0] == e.slot if len(e.slot) else np.zeros(0, dtype=bool)


def _searched_fit(e: Examples, base: Anchors, middle: np.ndarray, folds: int, objective: str, scorings: Sequence[str], params: tuple[float, float, str] | None) -> Anchors:
    """Anchors fitted on ``e`` with the given parameters, or with the best of the grid by cross-validation."""
    if params is None:
        best = max(((_grid_values(e, base, middle, *g, folds, objective).max(), -k, g) for k, g in enumerate(_grid(scorings))), key=lambda x: x[:2])
        params = best[2]
    smoothing, secondary, scoring = params
    return (base if np.isinf(smoothing) else fit(base, e, smoothing, secondary)).prepare(scoring, middle)


def transfer(labelled: DataFrame, descriptions: Anchors, app_col: str, holdout: str = HOLDOUT, centroids: dict[int, np.ndarray] | None = None, params: tuple[float, float, str] | None = None, folds: int = 5, objective: str = "primary", scorings: Sequence[str] = SCORING) -> DataFrame:
    """Leave one app out: ``app, id, contested, written, same, unseen``, one row for each label held back.

    ``written``, ``same`` and ``unseen`` say whether the descriptions, a fit on the training labels of
    all apps and a fit on those of the other apps get it right. What is held back is never fitted on.
    Each app is a task; a bounded set of labels goes to all of them. ``centroids`` are those of the
    apps' corpora (without one, nothing is calibrated); ``params`` are smoothing, secondary weight and
    scoring, searched by cross-validation where they are not given.
    """
    spark = labelled.sparkSession
    training, held = split_labels(labelled, holdout)
    order = lambda rows: rows.orderBy("id", app_col).collect()
    kept, back = order(training), order(held)
    pack = lambda rows: (Examples(np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.slot for r in rows], dtype=np.int64), [list(r.secondary or []) for r in rows]), np.array([r[app_col] for r in rows]))
    sent = spark.sparkContext.broadcast((pack(kept), pack(back), [str(r["id"]) for r in back], [bool(r["ambiguous"]) for r in back], descriptions, centroids or {}))

    def run(frames):
        (e, apps), (test, test_apps), ids, contested, base, middles = sent.value
        for frame in frames:
            out = []
            for app in frame["app"].tolist():
                own = np.flatnonzero(test_apps == app)
                middle = middles.get(app, np.zeros(0))
                fits = [base, *(_searched_fit(x, base, middle, folds, objective, scorings, params) if len(x.slot) else base for x in (e, e.take(np.flatnonzero(apps != app))))]
                right = [agreements(a, test.take(own)) for a in fits]
                out += [(app, ids[i], contested[i], *(bool(r[k]) for r in right)) for k, i in enumerate(own.tolist())]
            yield pd.DataFrame(out, columns=["app", "id", "contested", "written", "same", "unseen"])

    each = sorted({int(r[app_col]) for r in back})
    rows = spark.createDataFrame([(a,) for a in each], "app bigint").repartition(max(1, min(len(each), spark.sparkContext.defaultParallelism)), "app")
    return rows.mapInPandas(run, "app bigint, id string, contested boolean, written boolean, same boolean, unseen boolean")


def transfer_table(verdicts: DataFrame, contested: bool | None = None) -> DataFrame:
    """Per app, and over all (a null app): labels and those that each set of anchors gets right, and how the unseen fit differs from the descriptions.

    ``contested`` keeps one side of the labels that the labeller could not or could place. ``p`` is
    the exact McNemar probability of ``gained`` and ``lost``.
    """
    rows = verdicts if contested is None else verdicts.where(F.col("contested") == contested)
    hit = lambda c: F.count_if(c)
    out = rows.rollup("app").agg(
        F.count("*").alias("n"), hit(F.col("written")).alias("written"), hit(F.col("same")).alias("same"), hit(F.col("unseen")).alias("unseen"),
        hit(~F.col("written") & F.col("unseen")).alias("gained"), hit(F.col("written") & ~F.col("unseen")).alias("lost"),
    )
    return out.withColumn("p", mcnemar(F.col("gained"), F.col("lost")))


def compare_encoders(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two encoders' verdicts of the unseen fit on the same labels, paired: ``app, n, first, second, gained, lost, p``; a null app is all.

    Raises if the two were measured on different labels.
    """
    a = first.select("app", "id", F.col("unseen").alias("a"))
    b = second.select("app", "id", F.col("unseen").alias("b"))
    wrong = F.raise_error(F.lit("the two encoders were measured on different reviews"))
    both = a.join(b, ["app", "id"], "full_outer").withColumn("a", F.when(F.col("a").isNull() | F.col("b").isNull(), wrong.cast("boolean")).otherwise(F.col("a")))
    out = both.rollup("app").agg(
        F.count("*").alias("n"), F.count_if("a").alias("first"), F.count_if("b").alias("second"), F.count_if(~F.col("a") & F.col("b")).alias("gained"), F.count_if(F.col("a") & ~F.col("b")).alias("lost")
    )
    return out.withColumn("p", mcnemar(F.col("gained"), F.col("lost")))


def other_choice(descriptions: Anchors, training: Examples, held: Examples, centroid: np.ndarray, chosen: Anchors, objective: str, folds: int = 5, scorings: Sequence[str] = SCORING) -> dict | None:
    """What a fit for the other objective scores on the labels held back, and how many of them the chosen one gained and lost against it."""
    if not len(held.slot):
        return None
    other = "mentions" if objective == "primary" else "primary"
    rival = _searched_fit(training, descriptions, centroid, folds, other, scorings, None)
    margin = max(MARGINS, key=lambda m: score(rival, training, m)[1])
    agreement, f1 = score(rival, held, margin)
    mine, theirs = agreements(chosen, held), agreements(rival, held, margin)
    gained, lost = int((mine & ~theirs).sum()), int((~mine & theirs).sum())
    return {"objective": other, "agreement": agreement, "macro_f1": f1, "gained": gained, "lost": lost, "p": exact_p(gained, lost)}


def exact_p(gained: int, lost: int) -> float | None:
    """``stats.mcnemar`` of two numbers."""
    n = gained + lost
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(gained, lost) + 1)) / 2**n) if n else None
