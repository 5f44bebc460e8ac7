"""One reconciliation run as a single lazy plan: records, groups, classified groups, discrepancies and the report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.classify import classify, discrepancies
from ..operators.conserve import conservation_report, proven_report
from ..operators.ledger import HANDLERS, finished
from ..operators.match import STRATEGIES, broken_rejects, group_sum, guarded, mixed_rejects, standardize
from ..sources.mapping import ReadContext
from ..sources.readers import both_sides, route_source
from ..sources.sinks import append_absent, assert_unique, with_discrepancy_ids
from ..sources.versions import Attempt
from .scenario import Scenario


@dataclass
class Reconciliation:
    """What a run gives. Every part is a DataFrame; nothing is computed until one is used."""

    spark: SparkSession
    scenario: Scenario
    run_id: str
    period: str
    tables: dict[str, DataFrame] | None = None
    cutoff: str | None = None
    buckets: int = 64
    on_mixed: str = "fail"

    @cached_property
    def _read(self) -> tuple[DataFrame, DataFrame]:
        self.scenario.validate()
        reads = []
        for s in self.scenario.segments:
            for side, role, source in (("LEFT", s.left_role, s.left), ("RIGHT", s.right_role, s.right)):
                ctx = ReadContext(self.run_id, s.id, side, role, self.cutoff, self.scenario.tenant_id)
                if self.tables:
                    reads.append(route_source(self.spark, "memory", self.tables[source.location], source.mapping, ctx))
                else:
                    reads.append(route_source(self.spark, source.kind, source.location, source.mapping, ctx, **source.options))
        return both_sides(*reads)

    @cached_property
    def _standard(self) -> DataFrame:
        return standardize(self._read[0], buckets=self.buckets)

    @cached_property
    def _quarantined(self) -> tuple[DataFrame, DataFrame]:
        return mixed_rejects(self._standard, self._matched(self._standard))

    @cached_property
    def records(self) -> DataFrame:
        """Standardized records; with ``on_mixed='quarantine'`` without those of mixed groups."""
        return self._quarantined[0] if self.on_mixed == "quarantine" else self._standard

    @cached_property
    def rejects(self) -> DataFrame:
        """Rows that the readers refuse, match keys without a group key, and quarantined records."""
        out = self._read[1].unionByName(broken_rejects(self._read[0]))
        return out.unionByName(self._quarantined[1]) if self.on_mixed == "quarantine" else out

    def _matched(self, records: DataFrame) -> DataFrame:
        by_strategy: dict[str, list[str]] = {}
        for s in self.scenario.segments:
            by_strategy.setdefault(s.strategy, []).append(s.id)
        rows = records.drop("bucket")

        def groups(name: str, ids: list[str]) -> DataFrame:
            own = rows if len(by_strategy) == 1 else rows.where(F.col("segment_id").isin(ids))
            if STRATEGIES[name] is not group_sum:
                return STRATEGIES[name](own)
            # All are of one run, whose id need not be sorted, dealt and compared with every record.
            return group_sum(own.drop("run_id")).select(F.lit(self.run_id).alias("run_id"), "*")

        parts = [groups(name, ids) for name, ids in by_strategy.items()]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def groups(self) -> DataFrame:
        return guarded(self._matched(self._standard), self.on_mixed)

    def classify_groups(self, groups: DataFrame) -> DataFrame:
        """All segments' groups, each classified under its segment's rule."""
        roles = {s.id: s.roles() for s in self.scenario.segments}
        by_rule: dict = {}
        for s in self.scenario.segments:
            by_rule.setdefault(s.rule, []).append(s.id)
        parts = [classify(groups if len(by_rule) == 1 else groups.where(F.col("segment_id").isin(ids)), roles, rule, scenario=self.scenario.code, period=self.period) for rule, ids in by_rule.items()]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def classified(self) -> DataFrame:
        return self.classify_groups(self.groups)

    @property
    def discrepancies(self) -> DataFrame:
        return discrepancies(self.classified)

    @property
    def report(self) -> DataFrame:
        return conservation_report(self.classified)

    @property
    def proven(self) -> DataFrame:
        """The report, balanced only where independent sums over the records agree with it."""
        return proven_report(self.report, self.records)


#: The tables of a run, which are published together.
RUN_TABLES = ["records", "rejects", "classified", "discrepancies", "report", "status"]


def write_run(r: Reconciliation, root: str, handlers=None) -> dict[str, DataFrame]:
    """Carry out a run and publish its tables below ``root``, each computed once; gives them as read back.

    Records, rejects, classified groups, discrepancies, the report and the run's final status are written aside and become the run's in one step, after it has been
    asserted that no fingerprint repeats. Whatever ends an attempt before leaves the former publication whole; calling this again is a re-run. Handlers' rows are appended after that where
    their idempotency keys are new, so an attempt that died between is completed by the next; what people decided is not touched.
    """
    attempt = Attempt(r.spark, root, r.run_id)
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        out[name] = attempt.write(name, df)
        return out[name]

    records = keep("records", r.records)
    keep("rejects", r.rejects)
    classified = keep("classified", r.classify_groups(guarded(r._matched(records), r.on_mixed)))
    found = assert_unique(keep("discrepancies", with_discrepancy_ids(discrepancies(classified))), ["fingerprint"], "a run holds a fingerprint twice")
    report = keep("report", proven_report(conservation_report(classified), records))
    status = keep("status", finished(r.spark.createDataFrame([(r.run_id,)], "run_id string"), report))
    attempt.publish(scenario=r.scenario.code, period=r.period, status=status.first()["status"])
    for name, handler in handlers or HANDLERS:
        append_absent(handler(found), r.spark, f"{root}/{name}", "idempotency_key")
        out[name] = r.spark.read.parquet(f"{root}/{name}")
    return out
