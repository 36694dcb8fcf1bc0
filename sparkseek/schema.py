"""Logical tables, enumerations and ranking options."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Codes in the order of declaration.
ENTITY_KINDS = ("Application", "PackagedApp", "SettingsPage", "ControlPanelApplet", "ManagementConsole", "OptionalFeature", "SystemTool", "ShellLocation")
LAUNCH_KINDS = ("AppsFolder", "Executable", "Shortcut", "Uri", "ControlPanel", "Mmc")

ENTITIES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.IntegerType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("launch_kind", T.IntegerType()),
        T.StructField("launch_target", T.StringType()),
        T.StructField("launch_arguments", T.StringType()),
        T.StructField("icon_source", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("raw_metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_hash", T.StringType()),
        T.StructField("vector_ordinal", T.IntegerType()),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("provider", T.StringType()),
        T.StructField("is_online", T.BooleanType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_uri", T.StringType()),
        T.StructField("retrieved_at", T.TimestampType()),
    ]
)
PROFILES = T.StructType(
    [
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("summary", T.StringType()),
        T.StructField("tasks", T.ArrayType(T.StringType())),
        T.StructField("synonyms", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("features", T.StringType()),
        T.StructField("generator", T.StringType()),
    ]
)
USAGE = T.StructType([T.StructField("entity_id", T.StringType(), False), T.StructField("launch_count", T.IntegerType()), T.StructField("last_launched_at", T.TimestampType())])
VECTORS = T.StructType([T.StructField("vector_ordinal", T.IntegerType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])
TABLES = {"entities": ENTITIES, "documents": DOCUMENTS, "profiles": PROFILES, "vectors": VECTORS, "usage_stats": USAGE}
SCHEMA_VERSION = 5


@dataclass(frozen=True)
class RankingOptions:
    """Tunables of the ranking; ``from_conf`` reads overrides spark.hybrid.<name>."""

    candidates_per_arm: int = 100
    rrf_k: int = 60
    rank_tier_tolerance: float = 0.05
    vector_arm_weight: float = 1.0
    lexical_arm_weight: float = 1.0
    literal_arm_weight: float = 4.0
    adjacency_arm_weight: float = 1.25
    min_vector_score: float = 0.20
    min_vector_only_surface_score: float = 0.35
    min_hybrid_surface_vector_score: float = 0.22
    cosine_floor_leader_fraction: float = 0.80
    min_hybrid_vector_leader_ratio: float = 0.60
    min_corroborated_evidence_product: float = 0.18
    strong_corroborated_evidence_product: float = 0.30
    min_vector_only_leader_ratio: float = 0.75
    min_lexical_contribution_ratio: float = 0.45
    strong_lexical_score: float = 8.0
    min_strong_lexical_coverage: float = 0.85
    min_lexical_only_leader_ratio: float = 0.95
    semantic_contradiction_leader_ratio: float = 0.15
    min_literal_surface_strength: float = 0.6
    min_relative_score_without_independent_evidence: float = 0.35
    vector_magnitude_weight: float = 0.02
    prefix_boost: float = 1.5
    exact_match_boost: float = 3.0
    acronym_boost: float = 0.9
    word_prefix_boost: float = 0.6
    max_frequency_boost: float = 0.008
    max_recency_boost: float = 0.006
    recency_half_life_days: float = 7.0
    unlisted_command_penalty: float = 0.65
    uninstall_record_penalty: float = 0.65
    windows_component_tie_band: float = 0.01
    common_word_share: float = 0.05
    min_partial_name_credibility: float = 0.15

    @classmethod
    def from_conf(cls, spark: SparkSession) -> RankingOptions:
        base = cls()
        found = {f.name: spark.conf.get(f"spark.hybrid.{f.name}", None) for f in fields(cls)}
        return replace(base, **{k: type(getattr(base, k))(float(v)) for k, v in found.items() if v is not None})

    def without_floors(self) -> RankingOptions:
        """The options of a diagnosis: ten floors at zero."""
        names = ("min_vector_score", "min_vector_only_surface_score", "min_hybrid_surface_vector_score", "min_hybrid_vector_leader_ratio", "min_corroborated_evidence_product", "strong_corroborated_evidence_product", "min_vector_only_leader_ratio", "min_lexical_contribution_ratio", "min_lexical_only_leader_ratio", "min_relative_score_without_independent_evidence")
        return replace(self, **dict.fromkeys(names, 0.0))
