"""One run over a set of sources: read, detect, report, check.

The events are parsed once and kept in the shared folder as columns; every detector
and report then reads only the columns it needs. The alerts, which several reports
read, are kept as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..config import AnomalyConfig, DetectorConfig
from ..operators.features import ip_features
from ..schema import ALERT_SCHEMA, FAMILIES, chosen_families
from ..session import stage
from ..sources.merge import read_sources
from . import anomaly, reports, supervised
from .detect import detect


@dataclass(frozen=True)
class Analysis:
    """Events, alerts and, where the anomaly detector ran, its summary."""

    events: DataFrame
    alerts: DataFrame
    families: list[str]
    ml_summary: DataFrame | None = field(default=None)
    #: Paths that could not be read, and lines without an event, where logs were read.
    errors: DataFrame | None = field(default=None)
    rejected: DataFrame | None = field(default=None)

    def detection_summary(self) -> DataFrame:
        return reports.detection_summary(self.alerts, self.families)

    def true_count_report(self) -> DataFrame:
        return reports.true_count_report(self.events)

    def actor_distribution(self, actors: DataFrame) -> DataFrame:
        return reports.actor_distribution(actors)

    def alert_listing(self) -> DataFrame:
        return reports.alert_listing(self.alerts, self.families)

    def ml_report(self) -> DataFrame | None:
        return None if self.ml_summary is None else reports.ml_summary_report(self.ml_summary)

    def accuracy(self) -> DataFrame:
        return reports.accuracy_report(self.events, self.alerts)

    def counts_by_family(self) -> DataFrame:
        return reports.counts_by_family(self.events, self.alerts, self.families)

    def family_totals(self) -> DataFrame:
        return reports.family_totals(self.events)

    def ml_accuracy(self, actors: DataFrame) -> DataFrame:
        return reports.ml_accuracy_report(self.events, self.alerts, actors)

    def role_distribution(self, actors: DataFrame) -> DataFrame:
        return reports.role_distribution(self.events, actors)


def analyze_events(
    events: DataFrame,
    families: Iterable[str] = FAMILIES,
    config: DetectorConfig | None = None,
    anomaly_config: AnomalyConfig | None = None,
    bundle: supervised.ModelBundle | None = None,
    threshold: float = 0.5,
) -> Analysis:
    """Run rule detectors, anomaly detector and, given a model, the classifier."""
    families = list(families)
    chosen_families(families)
    events = stage(events, "events")
    rules = detect(events, config, families)
    if events.isEmpty():
        empty = events.sparkSession.createDataFrame([], ALERT_SCHEMA)
        return Analysis(events, empty, families)
    run = anomaly.run_anomaly(events, anomaly_config)
    found = rules.unionByName(run.alerts)
    if bundle is not None:
        found = found.unionByName(
            supervised.supervised_alerts(ip_features(events), bundle, threshold)
        )
    return Analysis(events, stage(found, "alerts"), families, run.summary)


def analyze(
    spark: SparkSession,
    sources: Mapping[str, Sequence[str]],
    enabled: Iterable[str] | None = None,
    reference_year: int | None = None,
    labeled: bool = True,
    probe: bool = True,
    **options,
) -> Analysis:
    """As ``analyze_events``, from log files: ``sources`` maps a family to its paths.

    With ``probe`` all files are read once beforehand, and those that cannot be read to their
    end are rows of ``errors`` instead of failing the run.
    """
    chosen_families(sources)
    chosen = chosen_families(enabled)
    families = [f for f in FAMILIES if sources.get(f) and f in chosen]
    events, errors, rejected = read_sources(
        spark, sources, families, reference_year, labeled, probe
    )
    return replace(analyze_events(events, families, **options), errors=errors, rejected=rejected)
