"""Job parameters: sampling configuration, periods and the scenario dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.recode import PERIODS, Period

# The climate scenarios and the impact families of the runs.
CLIMATE_SCENARIOS = [
    "ACCESS-1.0",
    "bcc-csm1-1",
    "CanESM",
    "CCSM",
    "CESM1-BGC",
    "CESM1-CAM5",
    "CMCC-CM",
    "CMCC-CMS",
    "CNRM-CM5",
    "GFDL-CM3",
    "GFDL-ESM2M",
    "HadGEM2-CC",
    "HadGEM2-ES",
    "MIROC5",
    "MPI-ESM-LR",
]
BASELINE = "Baseline no CC"
WATER_FAMILY = "Hydropower and Water Load Scenarios"
COOLING_FAMILY = "Cooling Load Scenarios"
COMBINED_FAMILY = "Cooling + Hydropower and Water Load Scenarios"
FAMILY_SUFFIX = {
    WATER_FAMILY: ("Hydro_Load", "hydropower, energy for water"),
    COMBINED_FAMILY: ("CDD_HDD_Hydro_Load", "cooling, hydropower, energy for water"),
    COOLING_FAMILY: ("CDD_HDD", "cooling"),
}


@dataclass(frozen=True)
class Sampling:
    """Parameters of one representative-day sample."""

    study_timeframe_id: int
    time_sample_id: int
    periods: list[Period] = field(default_factory=lambda: list(PERIODS))
    tps_per_day: int = 24
    study_name: str = ""
    study_description: str = ""
    name: str = ""
    method: str = ""
    description: str = ""
    demand_scenario_id: int | None = None

    @property
    def delta_t(self) -> int:
        return 24 // self.tps_per_day


def sampling_from_config(config: dict) -> Sampling:
    """Build the parameters from the nested mapping of a sampling configuration file."""
    study, sample = config["study_timeframe"], config["sampling"]
    periods = [
        Period(str(label), int(p["start_year"]), int(p["end_year"])) for label, p in config["periods"].items()
    ]
    return Sampling(
        study_timeframe_id=study["id"],
        time_sample_id=sample["id"],
        periods=periods,
        tps_per_day=sample.get("tps_per_day", 24),
        study_name=str(study.get("name", "")),
        study_description=str(study.get("description", "")).strip(),
        name=sample.get("name", ""),
        method=sample.get("method", ""),
        description=str(sample.get("description", "")).strip(),
        demand_scenario_id=config.get("demand_scenario"),
    )


def read_config(path: str) -> dict:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs PyYAML; pass the parameters as a dict instead") from missing
    with open(path) as f:
        return yaml.safe_load(f)


def period_frame(spark: SparkSession, sampling: Sampling) -> DataFrame:
    rows = [
        (sampling.study_timeframe_id, i + 1, p.start_year, p.label, p.length, p.end_year)
        for i, p in enumerate(sampling.periods)
    ]
    schema = "study_timeframe_id int, period_id int, start_year int, label string, length_yrs int, end_year int"
    return spark.createDataFrame(rows, schema)


def study_frame(spark: SparkSession, s: Sampling) -> DataFrame:
    rows = [(s.study_timeframe_id, s.study_name, s.study_description)]
    return spark.createDataFrame(rows, "study_timeframe_id int, name string, description string")


def time_sample_frame(spark: SparkSession, s: Sampling) -> DataFrame:
    rows = [(s.time_sample_id, s.study_timeframe_id, s.name, s.method, s.description)]
    schema = "time_sample_id int, study_timeframe_id int, name string, method string, description string"
    return spark.createDataFrame(rows, schema)


def scenario_dimension(
    spark: SparkSession,
    base_run: str,
    families: list[str] | None = None,
    climates: list[str] | None = None,
    baseline: str = BASELINE,
) -> DataFrame:
    """Run directory names and labels of the baseline and of every climate scenario per family."""
    rows = []
    for family in families or list(FAMILY_SUFFIX):
        suffix, label = FAMILY_SUFFIX[family]
        rows.append((base_run, baseline, baseline, family))
        for c in climates or CLIMATE_SCENARIOS:
            rows.append((f"{base_run}_{c}_{suffix}", c, f"{c} {label}", family))
    return spark.createDataFrame(
        rows, "run_id string, Scenario string, scenario_label string, climate_impacts_included string"
    )


def scenario_names(given: list[str] | DataFrame, column: str = "scenario") -> list[str]:
    """The scenarios that a plan produces rows for: a list without gaps and repeats, in its order.

    Of a frame, such as ``scenario_dimension``, the distinct names are looked up when this is called.
    """
    if isinstance(given, DataFrame):
        found = given.select(column).distinct().collect()
        return sorted(r[0] for r in found if r[0] is not None)
    if any(n is None for n in given) or len(set(given)) < len(given):
        raise ValueError(f"scenario names are given once each: {given}")
    return list(given)


def alias_frame(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    """Spelling used by another stage to scenario name."""
    return spark.createDataFrame(list(aliases.items()), "alias string, Scenario string")
