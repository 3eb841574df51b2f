"""Routing policies as data: checks, grids of variants, their decisions in one plan, and a registry of runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexroute.operators import routing as R

#: Studies that runs can belong to, and the settings of the grids.
STUDIES = ("escalation", "features", "thresholds", "cost_weight")
THRESHOLDS, COST_WEIGHTS, STEPS = (0.3, 0.4, 0.5, 0.6, 0.7), (0.0, 0.25, 0.5, 0.75, 1.0), (0, 1, 2, 3)


@dataclass(frozen=True)
class Policy:
    """How queries are routed, judged and escalated; settings that contradict each other are refused."""

    available: tuple[str, ...] = tuple(R.STRATEGIES)
    ladder: tuple[str, ...] = tuple(R.STRATEGIES)
    steps: int = 1
    groups: tuple[str, ...] = tuple(R.GROUPS)
    cost_weight: float = R.COST_WEIGHT
    checked: bool = True
    escalates: bool = True
    enough: float = R.ENOUGH
    min_results: int = R.MIN_RESULTS

    def __post_init__(self):
        wrong = [
            (bool({*self.available, *self.ladder} - set(R.STRATEGIES)), "unknown strategy"),
            (not self.available, "no strategy"),
            (len(set(self.available)) < len(self.available) or len(set(self.ladder)) < len(self.ladder), "a strategy stands twice"),
            (not set(self.ladder) <= set(self.available), "the ladder has a strategy that is not available"),
            (not 0 <= self.steps <= max(0, len(self.ladder) - 1), "steps must be between 0 and the rungs above the first"),
            (not self.groups or bool(set(self.groups) - set(R.GROUPS)), "feature groups must be known, with one at least"),
            (not 0 <= self.enough <= 1, "enough must be within 0 and 1"),
            (self.min_results < 1, "min_results must be 1 or more"),
            (self.cost_weight < 0, "cost_weight must not be negative"),
        ]
        said = [text for bad, text in wrong if bad]
        if said:
            raise ValueError("; ".join(said))


@dataclass(frozen=True)
class Variant:
    study: str
    name: str
    policy: Policy = field(default_factory=Policy)
    baseline: bool = False


def digest(policy: Policy) -> str:
    """The same for equal policies on every machine."""
    return hashlib.sha256(json.dumps(asdict(policy), sort_keys=True).encode()).hexdigest()


def varied(policy: Policy, base: Policy) -> dict:
    """The settings in which a policy differs from its base."""
    return {f.name: getattr(policy, f.name) for f in fields(Policy) if getattr(policy, f.name) != getattr(base, f.name)}


def escalation_variants(base: Policy = Policy()) -> list[Variant]:
    """Route only; route and check; route, check and escalate."""
    return [
        Variant("escalation", "route_only", replace(base, checked=False, escalates=False), True),
        Variant("escalation", "check_only", replace(base, checked=True, escalates=False)),
        Variant("escalation", "check_and_escalate", base),
    ]


def feature_variants(base: Policy = Policy()) -> list[Variant]:
    """All groups, then each enabled one left out; a group that is off already, or the only one, has no variant."""
    out = [Variant("features", "full", base, True)]
    if len(base.groups) > 1:
        out += [Variant("features", f"without_{g}", replace(base, groups=tuple(h for h in base.groups if h != g))) for g in R.GROUPS if g in base.groups]
    return out


def threshold_variants(base: Policy = Policy(), setting: str = "enough", values: tuple = THRESHOLDS) -> list[Variant]:
    """One threshold set to each value."""
    if setting not in ("enough", "min_results", "steps"):
        raise ValueError(f"{setting} is no threshold")
    if setting != "enough" and not all(isinstance(v, int) for v in values):
        raise ValueError(f"{setting} takes whole numbers")
    return [Variant("thresholds", f"{setting}={v}", replace(base, **{setting: v}), v == getattr(base, setting)) for v in values]


def step_variants(base: Policy = Policy(), values: tuple[int, ...] = STEPS) -> list[Variant]:
    """Escalations allowed, held within the ladder; values that fall together stay as they are asked."""
    return threshold_variants(base, "steps", tuple(max(0, min(v, len(base.ladder) - 1)) for v in values))


def cost_variants(base: Policy = Policy(), values: tuple[float, ...] = COST_WEIGHTS) -> list[Variant]:
    return [Variant("cost_weight", f"cost_weight={v}", replace(base, cost_weight=v), v == base.cost_weight) for v in values]


def summary(variants: list[Variant]) -> dict[str, list[str]]:
    """Names of the variants of each study, in order."""
    return {s: [v.name for v in variants if v.study == s] for s in dict.fromkeys(v.study for v in variants)}


def routes(analysed: DataFrame, variants: list[Variant]) -> DataFrame:
    """analysed once for each variant, with study, variant and strategy: one pass, whatever the number of variants."""
    first = lambda v: R.ranking(list(v.policy.available), list(v.policy.groups), v.policy.cost_weight)[0]["strategy"]
    made = F.array(*(F.struct(F.lit(v.study).alias("study"), F.lit(v.name).alias("variant"), first(v).alias("strategy")) for v in variants))
    return analysed.withColumn("_v", F.explode(made)).select(*analysed.columns, "_v.study", "_v.variant", "_v.strategy")


def outcomes(routed: DataFrame, judged: DataFrame, variants: list[Variant], by: str = "query_id") -> DataFrame:
    """(by, study, variant, strategy, sufficient, escalated, to_strategy, reason) of what routes() gave.

    judged holds n_results, coverage and top1_coverage of a query under each strategy; an
    unchecked policy has sufficient null, and so has a query that was not judged under its strategy.
    """
    x = routed.select(by, "study", "variant", "strategy").join(judged.select(by, "strategy", "n_results", "coverage", "top1_coverage"), [by, "strategy"], "left")

    def decided(v: Variant):
        p = v.policy
        score = (F.least(F.lit(1.0), F.col("n_results") / p.min_results) + F.col("coverage") + 0.5 * F.col("top1_coverage")) / 2.5
        up = dict(zip(p.ladder, p.ladder[1:]))
        after = F.element_at(F.create_map(*(F.lit(s) for pair in (up or {"": ""}).items() for s in pair)), F.col("strategy"))
        ok = (score >= p.enough) if p.checked else F.lit(None).cast("boolean")
        why = F.when(ok.isNull(), "check disabled" if not p.checked else "not judged").when(ok, "sufficient").when(F.lit(not p.escalates), "escalation disabled").when(F.lit(p.steps < 1), "budget exhausted").when(after.isNull(), "strongest strategy").otherwise("escalated")
        return F.struct(ok.alias("sufficient"), why.alias("reason"), after.alias("after"))

    one = None
    for v in variants:
        here = (F.col("study") == v.study) & (F.col("variant") == v.name)
        one = F.when(here, decided(v)) if one is None else one.when(here, decided(v))
    x = x.withColumn("_d", one)
    up = F.col("_d.reason") == "escalated"
    return x.select(by, "study", "variant", "strategy", "_d.sufficient", up.alias("escalated"), F.when(up, F.col("_d.after")).alias("to_strategy"), "_d.reason")


# --- registry: JSON lines in numbered versions, the newest holds all entries ---

ENTRY = "study string, variant string, baseline boolean, config string, config_sha256 string, varied string, run_dir string"


def entry(variant: Variant, run_dir: str, base: Policy = Policy()) -> tuple:
    """A registry row of a run."""
    if variant.study not in STUDIES:
        raise ValueError(f"unknown study {variant.study}")
    said = json.dumps(asdict(variant.policy), sort_keys=True)
    return variant.study, variant.name, variant.baseline, said, digest(variant.policy), json.dumps(varied(variant.policy, base), sort_keys=True), run_dir


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm, where = spark.sparkContext._jvm, path
    folder = jvm.org.apache.hadoop.fs.Path(where)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    # a version counts once its job has ended
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def registered(spark: SparkSession, path: str) -> DataFrame:
    """All entries; none if the folder is not there yet."""
    seen = _versions(spark, path)
    return spark.read.schema(ENTRY).json(f"{path}/v={seen[-1]}") if seen else spark.createDataFrame([], ENTRY)


def register(spark: SparkSession, path: str, entries: list[tuple], again: bool = False) -> None:
    """Adds runs as a new version. A (study, variant) that is there already is refused, or replaced if again is set; of twice the same in entries, both are refused."""
    new = spark.createDataFrame(entries, ENTRY)
    keys = ["study", "variant"]
    clash = {(e[0], e[1]) for e in entries if sum(e[:2] == f[:2] for f in entries) > 1}
    if not again:
        clash |= {tuple(r) for r in registered(spark, path).join(new.select(*keys), keys, "left_semi").select(*keys).collect()}
    if clash:
        raise ValueError("registered already: " + ", ".join("/".join(c) for c in sorted(clash)))
    seen = _versions(spark, path)
    registered(spark, path).join(new.select(*keys), keys, "left_anti").unionByName(new).write.option("ignoreNullFields", False).json(f"{path}/v={(seen or [0])[-1] + 1}")


def registry_summary(entries: DataFrame) -> DataFrame:
    """(study, n, variants) of a registry."""
    return entries.groupBy("study").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("variant")).alias("variants"))


def drifted(shared: dict, arms: dict[str, dict]) -> list[str]:
    """arm.setting of every shared setting that an arm has otherwise, or lacks."""
    return sorted(f"{a}.{k}" for a, own in arms.items() for k, v in shared.items() if k not in own or own[k] != v)
