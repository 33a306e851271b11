"""Transfer-learning recipes.

Each recipe returns a ``Result``: the prediction frame for the target test
set and its RMSLE (a scalar computed by one distributed aggregate).  Recipes
that start from the source model take it as ``source`` (fitted, or loaded by
``source_model``); with ``warm_start=False`` they start from nothing.  The
defaults are the modelled experiments' step sizes, rounds and patience; a
caller passes others, no recipe cuts them.

A recipe is written as a plan: a generator that yields the fits it needs next
(one, or several by name) and is sent the fitted models.  ``together`` advances
many plans at once: their preparations and scores run on a bounded pool of
threads, each under a job group of its own, and the fits that are due share the
passes of ``learners.boost_all``.  A plan that fails is cancelled and reported,
the others go on.
"""

from __future__ import annotations

import functools
import logging
import uuid
from collections.abc import Generator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..operators import align, sampling, weights as W
from ..operators.selection import f_score_topk
from ..session import reliable_checkpoint
from . import learners as L
from . import report, trainset

log = logging.getLogger(__name__)

KEY = ["origin", "store_id", "visit_date"]
THREADS = 4


@dataclass
class Result:
    method: str
    predictions: DataFrame
    rmsle: float
    model: L.Chain | None = None
    extra: dict = field(default_factory=dict)


def _score(method: str, model: L.Chain, data: trainset.DomainData, extra=None) -> Result:
    pred = model.predict(data.target_test)
    return Result(method, pred.select(*KEY, "visitors", "prediction"), report.rmsle(pred).first()["rmsle"], model, extra or {})


def training_set(train: DataFrame, valid_days: int = 7) -> DataFrame:
    """M2: the weighted rows with ``is_valid``; only the others are trained on."""
    return trainset.weighted_set(train, valid_days)


def together(spark: SparkSession, plans: dict[str, Generator], threads: int = THREADS) -> tuple[dict[str, Result], dict[str, Exception]]:
    """Results and errors of the plans, advanced side by side."""
    results, errors, waiting = {}, {}, {}
    tag = uuid.uuid4().hex

    def advance(name, sent):
        spark.sparkContext.setJobGroup(f"{tag}-{name}", name, interruptOnCancel=True)
        try:
            asked = plans[name].send(sent)
            return "asks", asked
        except StopIteration as done:
            return "ends", done.value
        except Exception as e:  # any failure of one plan leaves the others alone
            spark.sparkContext.cancelJobGroup(f"{tag}-{name}")
            return "fails", e

    def fitted(fits):
        try:
            return L.boost_all(fits)
        except Exception:
            if len(fits) == 1:
                raise
            log.warning("shared passes failed, fitting %d models one by one", len(fits))
            out = {}
            for key, fit in fits.items():
                try:
                    out |= L.boost_all({key: fit})
                except Exception as e:
                    out[key] = e
            return out

    with ThreadPoolExecutor(threads) as pool:
        sent = {name: None for name in plans}
        while sent:
            steps = {name: pool.submit(inheritable_thread_target(spark)(advance), name, value) for name, value in sent.items()}
            waiting, sent = {}, {}
            for name, step in steps.items():
                what, value = step.result()
                if what == "asks":
                    waiting[name] = value
                else:
                    (results if what == "ends" else errors)[name] = value
            fits = {(name, key): fit for name, asked in waiting.items()
                    for key, fit in (asked.items() if isinstance(asked, dict) else (("", asked),))}
            try:
                models = fitted(fits)
            except Exception as e:
                models = {key: e for key in fits}
            for name, asked in waiting.items():
                mine = {key: models[name, key] for key in (asked if isinstance(asked, dict) else ("",))}
                failed = next((m for m in mine.values() if isinstance(m, Exception)), None)
                if failed is not None:
                    errors[name] = failed
                else:
                    sent[name] = mine if isinstance(asked, dict) else mine[""]
    return results, errors


def recipe(plan):
    """A plan as a function that runs it; ``.plan`` is the generator function."""
    @functools.wraps(plan)
    def run(data, *args, **options) -> Result:
        results, errors = together(data.target_train.sparkSession, {plan.__name__: plan(data, *args, **options)})
        if errors:
            raise errors[plan.__name__]
        return results[plan.__name__]

    run.plan = plan
    return run


def _fit(train: DataFrame, features: list[str], params: L.GBTParams, init: L.Chain | None = None) -> L.Fit:
    return L.Fit(training_set(train), features, params, valid_col="is_valid", init=init)


def _target_fit(data, params: L.GBTParams, init: L.Chain | None = None, features: list[str] | None = None) -> L.Fit:
    """A fit on the target domain; all of them share one frame, so one set of blocks."""
    return L.Fit(data.once("target_set", lambda: training_set(data.target_train)), features or data.features, params, valid_col="is_valid", init=init)


def source_model(data, params=L.GBTParams(), path: str | None = None) -> L.Chain:
    """The model all transfers start from: fitted on the source domain, or
    loaded from ``path`` (S8)."""
    return L.train_or_load(path, training_set(data.source_train), data.features, params, valid_col="is_valid")


def _start(data, params, source, warm_start: bool = True):
    """(plan) The model to go on from."""
    if not warm_start:
        return None
    if source is None:
        source = yield _fit(data.source_train, data.features, params)
    return source


@recipe
def baseline(data, params=L.GBTParams(), source=None):
    """M5: train on the target domain, test on it."""
    return _score("baseline", (yield _target_fit(data, params)), data)


@recipe
def direct_transfer(data, params=L.GBTParams(), source=None):
    """M6: the source model as it is."""
    return _score("direct_transfer", (yield from _start(data, params, source)), data)


def _tuned(method, data, params, source, learning_rate, rounds, warm_start):
    start = yield from _start(data, params, source, warm_start)
    return _score(method, (yield _target_fit(data, params.replace(step_size=learning_rate, max_iter=rounds), start)), data)


@recipe
def fine_tune(data, params=L.GBTParams(), source=None, learning_rate=1e-3, rounds=2000, warm_start=True):
    """M7: the source model continued on the target."""
    return (yield from _tuned("fine_tune", data, params, source, learning_rate, rounds, warm_start))


@recipe
def adversarial(data, params=L.GBTParams(), source=None, learning_rate=0.003, rounds=2000, warm_start=True):
    """As written, a fine-tune with step 0.003 (no discriminator exists)."""
    return (yield from _tuned("adversarial", data, params, source, learning_rate, rounds, warm_start))


@recipe
def pseudo_label(data, params=L.GBTParams(), source=None):
    """M8: source labels + target pseudo-labels from the source model;
    validated on the tail of the training dates, not on the test set."""
    rows = pseudo_label_set(data, (yield from _start(data, params, source)))
    return _score("pseudo_label", (yield L.Fit(rows, data.features, params, valid_col="is_valid")), data)


def pseudo_label_set(data, source: L.Chain) -> DataFrame:
    labelled = source.predict(data.target_train)
    return trainset.time_split(trainset.pseudo_union_a(data.source_train, labelled), "visit_date", 7)


@recipe
def pseudo_label_copies(data, params=L.GBTParams(), source=None, warm_start=True):
    """M9: target rows plus copies labelled by the source model, then M2, from
    the source model on."""
    start = yield from _start(data, params, source)
    union = trainset.pseudo_union_b(data.target_train, start.predict(data.target_train))
    return _score("pseudo_label_copies", (yield _fit(union, data.features, params, start if warm_start else None)), data)


def _both_domains(data) -> tuple[DataFrame, DataFrame]:
    """Source rows (all for training) and target rows with validation days."""
    return (data.source_train.withColumn("is_valid", F.lit(False)),
            trainset.time_split(data.target_train, "visit_date", 7))


@recipe
def domain_weighted(data, params=L.GBTParams(), source=None):
    """Source weight 0.5, target 1.0, over the global mean; the target's
    validation days are held out of training."""
    rows = W.domain_weights(*_both_domains(data))
    return _score("domain_weighted", (yield L.Fit(rows, data.features, params, valid_col="is_valid")), data)


@recipe
def weighted_da(data, params=L.GBTParams(), source=None, learning_rate=0.005, rounds=None, warm_start=True):
    """Per-domain recency weights x 0.3 / 0.7, union, from the source model on."""
    p = params.replace(step_size=learning_rate, max_iter=rounds or params.max_iter)
    start = yield from _start(data, params, source, warm_start)
    rows = W.weighted_da_weights(*_both_domains(data))
    return _score("weighted_da", (yield L.Fit(rows, data.features, p, valid_col="is_valid", init=start)), data)


def sample_union(data, ratio=0.7, seed=42) -> DataFrame:
    """M11's rows: a seeded exact sample of the source and the target."""
    return sampling.exact_sample(data.source_train, KEY, ratio=ratio, seed=seed).unionByName(data.target_train)


@recipe
def sample_transfer(data, params=L.GBTParams(), source=None, ratio=0.7, seed=42, learning_rate=0.01, rounds=3000,
                    warm_start=True):
    """The source model continued on the sample and the target."""
    p = params.replace(step_size=learning_rate, max_iter=rounds)
    start = yield from _start(data, params, source, warm_start)
    return _score("sample_transfer", (yield _fit(sample_union(data, ratio, seed), data.features, p, start)), data)


@recipe
def ensemble(data, params=L.GBTParams(), source=None, n=3, learning_rate=0.003, rounds=2000, warm_start=True):
    """N continuations of the source model on the target, with seeds
    1000 apart, predictions averaged (A19)."""
    start = yield from _start(data, params, source, warm_start)
    p = params.replace(step_size=learning_rate, max_iter=rounds)
    models = yield {str(i): _target_fit(data, p.replace(seed=params.seed + 1000 * i), start) for i in range(n)}
    preds = [m.predict(data.target_test) for m in models.values()]
    pred = data.target_test.select(*KEY, "visitors").join(report.ensemble_mean(preds, KEY), KEY)
    return Result("ensemble", pred, report.rmsle(pred).first()["rmsle"])


def _phased(make, phases, params, model, patience):
    """(plan) The phases one after the other; every phase has its own patience."""
    stages = []
    waits = [*patience, *[patience[-1]] * len(phases)] if patience else [params.patience] * len(phases)
    for (rate, rounds), wait in zip(phases, waits):
        model = yield make(params.replace(step_size=rate, max_iter=rounds, patience=wait), model)
        stages.append(model)
    return stages


def _top_features(data, k: int) -> list[str]:
    """D7 on the source rows; the statistics are taken once for all ``k``."""
    ranked = data.once("f_ranking", lambda: [r["feature"] for r in f_score_topk(
        data.source_train, data.features, "visitors", len(data.features)).collect()])
    return ranked[:k]


@recipe
def super_ensemble_topk(data, params=L.GBTParams(), source=None, k=30, phases=((0.01, 500), (0.002, 3000)),
                        warm_start=True, patience=(100, 500)):
    """The k features of the largest F statistic on the source; the source
    model, then both phases on the target with those features."""
    start = yield from _start(data, params, source, warm_start)
    top = _top_features(data, k)
    models = yield from _phased(lambda p, m: _target_fit(data, p, m, top), phases, params, start, patience)
    return _score("super_ensemble_topk", models[-1], data, {"features": top})


@recipe
def super_ensemble_aligned(data, params=L.GBTParams(), source=None, n_clusters=20, selection_ratio=0.7,
                           top_ratio=0.1, phases=((0.01, 500), (0.002, 3000)), warm_start=True, patience=(100, 500)):
    """Sample selection (D8), partial CORAL (D3), union with the target,
    both phases on it, all from the source model on.  ``extra['stages']`` has
    the RMSLE of the six stages (M17 input)."""
    start = yield from _start(data, params, source, warm_start)
    chosen = reliable_checkpoint(
        align.sample_selection(data.source_train, data.target_train, data.features, KEY, n_clusters, selection_ratio))
    aligned, names = align.partial_coral(chosen, data.target_train, data.features, "visitors", top_ratio)
    union = reliable_checkpoint(data.target_train.unionByName(aligned))
    rows = training_set(union)
    first = yield {"initial": _target_fit(data, params),
                   "selection": _fit(data.target_train.unionByName(chosen), data.features, params, start),
                   "alignment": L.Fit(rows, data.features, params, valid_col="is_valid", init=start)}
    models = yield from _phased(lambda p, m: L.Fit(rows, data.features, p, valid_col="is_valid", init=m), phases, params, start, patience)
    scores = [(name, _score(name, m, data).rmsle) for name, m in first.items()]
    scores.append(("augmentation", scores[-1][1]))       # the augmented set is the aligned union
    scores += [(name, _score(name, m, data).rmsle) for name, m in zip(("phase_1", "final"), models)]
    result = _score("super_ensemble_aligned", models[-1], data)
    result.extra = {"stages": [(i, name, v) for i, (name, v) in enumerate(scores, 1)], "aligned": names}
    return result


CORAL_STRATEGIES = {
    "none": lambda s, t, f, m: (s, []),
    "standard": lambda s, t, f, m: (align.coral_align(s, t, f, moments=m), list(f)),
    "adaptive": lambda s, t, f, m: align.adaptive_coral(s, t, f, "visitors", 0.7, moments=m),
    "partial_30": lambda s, t, f, m: align.partial_coral(s, t, f, "visitors", 0.3, moments=m),
    "partial_50": lambda s, t, f, m: align.partial_coral(s, t, f, "visitors", 0.5, moments=m),
    "threshold_30": lambda s, t, f, m: align.threshold_coral(s, t, f, "visitors", 0.3, moments=m),
    "threshold_50": lambda s, t, f, m: align.threshold_coral(s, t, f, "visitors", 0.5, moments=m),
}


def isolated(spark: SparkSession, plans: dict[str, Generator]) -> tuple[dict[str, float | None], dict[str, str]]:
    """Scores and status of named plans; one that fails is logged and scored
    as missing, the others go on."""
    results, errors = together(spark, plans)
    for name, e in errors.items():
        log.warning("run %s failed: %s", name, e)
    return ({name: results[name].rmsle if name in results else None for name in plans},
            {name: "ok" if name in results else f"failed: {type(errors[name]).__name__}" for name in plans})


def _coral_plan(name, data, params, moments):
    # The dates are not aligned: the split is found once, before the linear maps.
    split = data.once("source_split", lambda: trainset.time_split(data.source_train, "visit_date", 7))
    aligned, _ = CORAL_STRATEGIES[name](split, data.target_train, data.features, moments)
    rows = W.recency_weight(aligned, "day_gap", "is_valid")
    return _score(name, (yield L.Fit(rows, data.features, params, valid_col="is_valid")), data)


def coral_comparison(data, params=L.GBTParams(), strategies=tuple(CORAL_STRATEGIES)):
    """Align the source with each strategy, train on it, score on the
    target.  All strategies are cut from the moments of one pass."""
    moments = align.moment_store({"source": data.source_train, "target": data.target_train}, data.features, "visitors")
    return isolated(data.target_train.sparkSession, {f"coral_{n}": _coral_plan(n, data, params, moments) for n in strategies})


def _with_source(data, params, source):
    return source if source is not None else source_model(data, params)


def param_grid(data, params=L.GBTParams(), source=None, learning_rates=(1e-3, 3e-3), rounds=(500, 2000)):
    """Fine-tune over a learning-rate x rounds grid, one source model."""
    start = _with_source(data, params, source)
    return isolated(data.target_train.sparkSession, {
        f"fine_tune_lr{lr}_r{r}": fine_tune.plan(data, params, start, lr, r) for lr in learning_rates for r in rounds})


def super_ensemble_grid(data, params=L.GBTParams(), source=None, ks=(10, 30, 50, 100),
                        rates=((0.01, 0.002), (0.05, 0.005)), rounds=(500, 3000)):
    """Top-k x phase step sizes, one source model."""
    start = _with_source(data, params, source)
    return isolated(data.target_train.sparkSession, {
        f"topk_{k}_lr1_{a}_lr2_{b}": super_ensemble_topk.plan(data, params, start, k, ((a, rounds[0]), (b, rounds[1])))
        for k in ks for a, b in rates})


def ratio_grid(data, params=L.GBTParams(), source=None, ratios=(0.1, 0.2, 0.3, 0.5), phases=((0.01, 500), (0.002, 3000))):
    """The top int(n * ratio) features."""
    start = _with_source(data, params, source)
    return isolated(data.target_train.sparkSession, {
        f"top_{k}": super_ensemble_topk.plan(data, params, start, k, phases) for k in [int(len(data.features) * r) for r in ratios]})


METHODS = {
    "baseline": baseline, "direct_transfer": direct_transfer, "fine_tune": fine_tune,
    "pseudo_label": pseudo_label, "pseudo_label_copies": pseudo_label_copies,
    "domain_weighted": domain_weighted, "weighted_da": weighted_da, "sample_transfer": sample_transfer,
    "adversarial": adversarial, "ensemble": ensemble, "super_ensemble_topk": super_ensemble_topk,
    "super_ensemble_aligned": super_ensemble_aligned,
}


def run_all(data, params=L.GBTParams(), source=None, options: dict[str, dict] | None = None):
    """Every method on one source model -> (scores, status).  ``options``
    holds keyword arguments per method."""
    start = _with_source(data, params, source)
    return isolated(data.target_train.sparkSession, {
        name: method.plan(data, params, start, **(options or {}).get(name, {})) for name, method in METHODS.items()})
