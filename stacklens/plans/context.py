"""Derived frames that many queries share, built on the bindings of one data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklens.operators import conflicts as C
from stacklens.operators import dependencies as D
from stacklens.operators import features as FE
from stacklens.operators import strategies as ST
from stacklens.plans.bindings import Bound
from stacklens.session import materialize


class Context(Bound):
    @cached_property
    def deps(self) -> DataFrame:
        return D.dedup_dependencies(self.v_deps)

    @cached_property
    def stored_deps(self) -> DataFrame:
        """The dependencies as a written table, for work that reads them more than once."""
        return materialize(self.deps)

    @cached_property
    def systems(self) -> DataFrame:
        return self._with_gpus(self.v_systems)

    @cached_property
    def repo_systems(self) -> DataFrame:
        return self._with_gpus(self.v_repo_systems)

    @staticmethod
    def _with_gpus(df: DataFrame) -> DataFrame:
        gpu = F.struct(F.col("gpu_name").alias("name"), F.col("gpu_memory").alias("memory_gb"))
        return df.withColumn("gpus", F.array_repeat(gpu, F.col("gpu_count").cast("int")))

    @cached_property
    def repos(self) -> DataFrame:
        return self.v_repos.withColumn("topics", F.array_distinct(F.array("topic1", "topic2")))

    @cached_property
    def issues(self) -> DataFrame:
        return C.detect_issues(self.stored_deps, self.v_deps, self.repo_systems, self.v_repos)

    @cached_property
    def core_features(self) -> DataFrame:
        """Repository features without issue counts."""
        return FE.repository_features(self.repos, self.stored_deps, None,
                                      C.recommended_cuda(self.stored_deps))

    @cached_property
    def stored_features(self) -> DataFrame:
        return materialize(self.core_features)

    @cached_property
    def system_features(self) -> DataFrame:
        f = FE.system_features(self.systems)
        return self.v_repos.select("repo_id", "system_id").join(f.hint("merge"), "system_id")  # systems are as many as owners

    @cached_property
    def records(self) -> DataFrame:
        return FE.training_records(self.v_outcomes, self.core_features, self.system_features)

    @cached_property
    def stored_records(self) -> DataFrame:
        """The records as a written table, for work that reads them more than once."""
        return materialize(FE.training_records(self.v_outcomes, self.stored_features, self.system_features))

    @cached_property
    def facts(self) -> DataFrame:
        return ST.strategy_facts(self.deps)

    @cached_property
    def repo_sets(self) -> DataFrame:
        names = self.deps.groupBy("repo_id").agg(F.collect_set("name").alias("deps"))
        return self.repos.join(names, "repo_id").select("repo_id", "topics", "deps")
