"""The telemetry of a folder, landed once per session and shared by its queries."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsrecall.operators import causal, episodes, features, identity, learning, similarity, templates, topology, windows
from opsrecall.plans import context
from opsrecall.session import cut, ensure_checkpoint_dir
from opsrecall.sources import driver_tables as D, events as E


class Landing:
    """Lazily built tables over one folder. What is expensive and used by many
    queries is written to the shared checkpoint folder on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        """A fresh place under the shared folder."""
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def table(self, name: str) -> DataFrame:
        return D.table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        """Telemetry as parquet, a folder for each kind: filters and columns reach the scan."""
        rows, path = D.telemetry(self.spark, self.sf_dir), self.path("events")
        E.write_events(rows, path, partition_by=("kind",))
        return E.read_events(self.spark, path, rows.schema)

    @cached_property
    def renames(self) -> DataFrame:
        return identity.renames(self.events)

    @cached_property
    def ids(self) -> DataFrame:
        return identity.identities(self.renames)

    @cached_property
    def names(self) -> DataFrame:
        """Services as events are filed: own service, span services of a trace."""
        from opsrecall.sources.events import service_mentions
        return service_mentions(self.events)

    @cached_property
    def sigs(self) -> DataFrame:
        return cut(windows.signals(self.events, self.ids))

    @cached_property
    def deps(self) -> DataFrame:
        return cut(topology.live_dependencies(self.events, self.ids))

    @cached_property
    def nbrs(self) -> DataFrame:
        return cut(topology.neighbours(self.deps))

    @cached_property
    def components(self) -> DataFrame:
        return cut(topology.dependency_components(self.deps))

    @cached_property
    def rems(self) -> DataFrame:
        return episodes.remediations(self.events)

    @cached_property
    def graded(self) -> DataFrame:
        return cut(learning.graded(self.rems, self.sigs, self.ids))

    @cached_property
    def features(self) -> DataFrame:
        facts = features.event_facts(context.templated(self.events), self.ids)
        return cut(features.incident_features(self.sigs, features.incident_items(self.sigs, facts)))

    @cached_property
    def causes(self) -> DataFrame:
        return cut(causal.candidate_causes(self.sigs, self.events, self.ids))

    @cached_property
    def chains(self) -> DataFrame:
        """First pass: no history."""
        return cut(causal.chains(self.sigs, self.causes, self.nbrs))

    @cached_property
    def edge_outcomes(self) -> DataFrame:
        return cut(learning.edge_outcomes(self.graded, self.chains))

    @cached_property
    def episodes(self) -> DataFrame:
        """Episodes on first-pass chains."""
        return cut(episodes.episodes(self.sigs, self.features, self.chains, self.events, self.ids, self.deps, self.nbrs, self.rems))

    @cached_property
    def memory(self) -> context.Memory:
        """Everything a context needs, with learned history."""
        known = cut(context.learned_edges(self.edge_outcomes, self.sigs, True))
        chains = cut(causal.chains(self.sigs, self.causes, self.nbrs, known))
        eps = cut(episodes.episodes(self.sigs, self.features, chains, self.events, self.ids, self.deps, self.nbrs, self.rems))
        return context.Memory(self.events, self.ids, self.sigs, self.deps, self.nbrs, self.rems, chains, eps, self.graded,
                              cut(learning.edge_outcomes(self.graded, chains)))

    @cached_property
    def candidates(self) -> DataFrame:
        """The first matches of every incident on first-pass chains, before they are cut to what is shown."""
        past = similarity.past_view(self.episodes)
        return cut(similarity.find_similar(similarity.query_view(self.episodes), past, similarity.RETRIEVED).select("query_id", "rank", "incident_id"))

    @cached_property
    def shown(self) -> DataFrame:
        """The matches that are shown, on first-pass chains."""
        past = similarity.past_view(self.episodes)
        return cut(similarity.find_similar(similarity.query_view(self.episodes), past, similarity.TOP_K["fast"]))

    @cached_property
    def matches(self) -> DataFrame:
        return cut(context.find_matches(self.memory, 5))

    @cached_property
    def context(self) -> DataFrame:
        return cut(context.context(self.memory, matches=self.matches))

    @cached_property
    def shapes(self) -> DataFrame:
        return cut(templates.shapes(self.events.where("kind = 'log'").select("us", "msg")))

    @cached_property
    def line_shapes(self) -> DataFrame:
        return cut(templates.shapes(D.document_lines(self.spark, self.sf_dir)))

    @cached_property
    def line_templates(self) -> DataFrame:
        """Lines clustered as a whole, however long they are."""
        return cut(templates.cluster(cut(templates.shapes(D.document_lines(self.spark, self.sf_dir), chars=None))))

    @cached_property
    def shape_templates(self) -> DataFrame:
        """Catalogue of plain shapes (no clustering)."""
        return templates.catalogue(self.shapes.withColumn("pattern", F.col("shape")))

    @cached_property
    def replica_log(self) -> DataFrame:
        return D.replica_log(self.spark, self.sf_dir)


_LANDINGS: dict[tuple[str, str], Landing] = {}


def landing(spark: SparkSession, sf_dir: str) -> Landing:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDINGS:
        _LANDINGS[key] = Landing(spark, sf_dir)
    return _LANDINGS[key]


def forget() -> None:
    """Drop the shared tables, so that the next query builds its own."""
    _LANDINGS.clear()
