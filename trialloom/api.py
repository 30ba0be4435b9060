"""Trials as one object: what is aligned, grouped and measured, step by step.

    Trials(trials, events).align("click-100:click+200 @ click").group_by("cond").psth(points, 20.0, taps)

Every step gives a new object and only builds plans; nothing runs before a result is used.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.kernels import Taps
from trialloom.functions.stats import mean_sem
from trialloom.operators import binning, conditions, randomise, timecourse, windows


@dataclass(frozen=True)
class Trials:
    """trials(trial_id, t_start, t_end, attributes ..) and events(trial_id, event, occ, t)."""

    trials: DataFrame
    events: DataFrame
    alignments: tuple[DataFrame, ...] = ()
    axes: tuple[str, ...] = ()
    membership: DataFrame | None = None
    checks: tuple[tuple[Column, str], ...] = field(default=())

    def align(self, *windows_: str, **options) -> Trials:
        """Windows in the alignment language; the first is the one that results refer to."""
        return replace(self, alignments=tuple(windows.align(self.trials, self.events, w, **options) for w in windows_))

    def keep(self, valid: Column, cause: str = "filtered") -> Trials:
        """Trials for which valid does not hold stay, but count as invalid for this cause."""
        return replace(self, checks=(*self.checks, (valid, cause)))

    def group_by(self, *axes: str) -> Trials:
        """Conditions from the values of attributes; the first runs fastest. cond is the name of the
        conditions' number, so no axis can have it."""
        if "cond" in axes:
            raise ValueError("an axis cannot be called cond")
        return replace(self, axes=axes, membership=None)

    def group_into(self, membership: DataFrame) -> Trials:
        """Conditions as membership(trial_id, cond) states them; trials may be in several."""
        return replace(self, axes=(), membership=membership.select("trial_id", "cond"))

    def conditions(self) -> DataFrame:
        """cond and the axes' values for every cell of the cube."""
        return conditions.cube({a: self.trials.select(a) for a in self.axes})

    def members(self) -> DataFrame:
        """trial_id, cond of valid trials."""
        if self.membership is not None:
            found = self.membership
        elif self.axes:
            found = conditions.members(self.trials, self.conditions(), list(self.axes))
        else:
            found = self.trials.select("trial_id", F.lit(0).alias("cond"))
        return found.join(self.validity().where("valid").select("trial_id"), "trial_id", "left_semi")

    def validity(self) -> DataFrame:
        """trial_id, valid, cause: the first check or alignment that fails."""
        rows = self.trials
        for valid, cause in self.checks:
            rows = conditions.set_invalid(rows, valid, cause)
        rows = rows.select("trial_id", F.col("cause") if self.checks else F.lit(None).cast("string").alias("cause"))
        for i, a in enumerate(self.alignments):
            rows = rows.join(a.select("trial_id", F.col("cause").alias(f"_c{i}")), "trial_id", "left")
        cause = F.coalesce("cause", *[f"_c{i}" for i in range(len(self.alignments))])
        return rows.select("trial_id", cause.isNull().alias("valid"), cause.alias("cause"))

    def shuffled(self, seed: int) -> Trials:
        """The same trials dealt anew to conditions of the same sizes."""
        return self.group_into(randomise.shuffle_labels(self.members(), seed))

    def resampled(self, draws: int, seed: int) -> DataFrame:
        """draw, cond, trial_id: each condition with replacement."""
        return randomise.bootstrap(self.members(), draws, seed)

    def in_window(self, rows: DataFrame) -> DataFrame:
        """Points or samples inside the first window, relative to its zero."""
        return windows.in_window(rows, self.alignments[0])

    def mean_rates(self, points: DataFrame) -> DataFrame:
        """trial_id, n, duration, rate."""
        return binning.mean_rate(points, self.alignments[0])

    def psth(self, points: DataFrame, width: float, taps: Taps, mode: str = "causal", min_count: int = 1) -> DataFrame:
        """cond, bin, mean, sem, std, n of smoothed rates."""
        return binning.psth(points, self.alignments[0], self.members(), width, taps, min_count=min_count, mode=mode)

    def series_means(self, samples: DataFrame, width: float, mode: str = "causal", baseline: tuple[int, int] | None = None) -> DataFrame:
        """cond, bin, mean, sem, std, n of a series, less each trial's mean over the bins of baseline."""
        series = timecourse.on_grid(samples, self.alignments[0], width, mode)
        if baseline:
            series = timecourse.subtract_baseline(series, timecourse.trial_baseline(series, *baseline))
        return timecourse.group_means(series, self.members())

    def values(self, *attributes: str) -> DataFrame:
        """trial_id and the attributes of every trial, missing for trials that are not valid."""
        rows = self.trials.select("trial_id", *attributes).join(self.validity().select("trial_id", "valid"), "trial_id")
        return rows.select("trial_id", *[F.when(F.col("valid"), F.col(a)).alias(a) for a in attributes])

    def means(self, attribute: str, min_count: int = 1) -> DataFrame:
        """cond, mean, sem, std, n of an attribute over the trials of each condition."""
        rows = self.members().join(self.trials.select("trial_id", attribute), "trial_id")
        return rows.groupBy("cond").agg(*mean_sem(attribute, min_count))
