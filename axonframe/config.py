"""Typed settings of a sorting run, read from and written to INI files."""

from __future__ import annotations

import configparser
import dataclasses
import datetime as dt
import json
from dataclasses import dataclass, fields


@dataclass
class Settings:
    """One field a setting, named section_key; values of the INI text are cast to the field's type."""

    run_resort_limit: int = 3
    run_cores_used: int = 8
    run_weekday_run: int = 2
    run_weekend_run: int = 8
    run_run_type: str = "Auto"
    run_manual_run: int = 2
    cluster_min_clusters: int = 2
    cluster_max_clusters: int = 7
    cluster_max_iterations: int = 1000
    cluster_convergence_criterion: float = 0.0001
    cluster_random_restarts: int = 10
    cluster_intra_cluster_cutoff: float = 3.0
    breach_voltage_cutoff: float = 300.0
    breach_max_breach_rate: float = 0.2
    breach_max_breach_count: int = 10
    breach_max_breach_avg: float = 20.0
    filter_low_cutoff: float = 300.0
    filter_high_cutoff: float = 3000.0
    spike_pre_time: float = 0.2
    spike_post_time: float = 0.6
    detection_spike_detection: float = 2.0
    detection_artifact_removal: float = 10.0
    pca_variance_explained: float = 0.95
    pca_use_percent_variance: int = 1
    pca_principal_component_n: int = 5

    def __post_init__(self) -> None:
        self.cluster_min_clusters = max(2, self.cluster_min_clusters)
        if self.cluster_max_clusters < self.cluster_min_clusters:
            raise ValueError("max-clusters is below min-clusters")

    @classmethod
    def read(cls, path: str) -> Settings:
        parser = configparser.ConfigParser()
        with open(path) as f:
            parser.read_file(f)
        kinds = {"int": lambda x: int(float(x)), "float": float, "str": str}
        known = {x.name: x for x in fields(cls)}
        found = {}
        for section in parser.sections():
            for key, value in parser[section].items():
                name = f"{section}_{key}".replace("-", "_")
                if name in known:
                    found[name] = kinds[str(known[name].type)](value)
        return cls(**found)

    def write(self, path: str) -> None:
        parser = configparser.ConfigParser()
        for name, value in dataclasses.asdict(self).items():
            section, _, key = name.partition("_")
            if not parser.has_section(section):
                parser.add_section(section)
            parser[section][key.replace("_", "-")] = str(value)
        with open(path, "w") as f:
            parser.write(f)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Settings of a JSON object; names that are unknown are left out, those that are missing get their defaults."""
        known = {x.name for x in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})

    def files_for(self, day: dt.date) -> int:
        """How many files a run takes on a day: the weekend's number on Fridays, the weekday's else, or the one set by hand."""
        if self.run_run_type == "Auto":
            return self.run_weekend_run if day.weekday() == 4 else self.run_weekday_run
        if self.run_run_type == "Manual":
            return self.run_manual_run
        raise ValueError(f"run-type is Auto or Manual, not {self.run_run_type}")
