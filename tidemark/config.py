"""Configuration: defaults, YAML files over them, and a hash of the whole."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from dataclasses import dataclass, field

DEFAULTS: dict[str, dict] = {
    "base": {"zone": "America/New_York", "seed": 42, "provider": "synthetic", "folder": "", "golden": "", "output": "artifacts", "stocks": 100, "start": "2015-01-02", "end": "2025-12-31", "signal": 1.0},
    "labels": {"reaction": 1, "drift": 20, "use_planted": True},
    "features": {"least": 131, "short": 21, "mid": 63, "long": 126, "volatility": 63, "volume": 63, "text": False},
    "walkforward": {"train_start": "2015-01-01", "train_end": "2018-12-31", "val_start": "2019-01-01", "val_end": "2019-12-31", "test_start": "2020-01-01", "last_end": "2025-12-31", "years": 1},
    "portfolio": {"buckets": 5, "levels": [0.0, 0.0005, 0.001, 0.002, 0.003, 0.005], "primary": 0.002},
}


@dataclass
class Config:
    sections: dict[str, dict] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    def __getattr__(self, name: str) -> dict:
        try:
            return self.__dict__["sections"][name]
        except KeyError as error:
            raise AttributeError(name) from error

    def digest(self) -> str:
        """The first 16 hexadecimal digits of the SHA-256 of the sorted configuration."""
        return hashlib.sha256(json.dumps(self.sections, sort_keys=True, default=str).encode()).hexdigest()[:16]


def load_config(folder: str | None = None, **overrides: object) -> Config:
    """Defaults, then ``<section>.yaml`` of a folder, then ``section__key=value`` overrides; an unknown section or key raises."""
    config = Config()
    if folder:
        import yaml

        for section, values in config.sections.items():
            path = os.path.join(folder, f"{section}.yaml")
            if os.path.exists(path):
                with open(path, encoding="utf-8") as file:
                    put(section, values, yaml.safe_load(file) or {})
    for name, value in overrides.items():
        section, _, key = name.partition("__")
        if section not in config.sections:
            raise KeyError(section)
        put(section, config.sections[section], {key: value})
    return config


def put(section: str, values: dict, new: dict) -> None:
    unknown = set(new) - set(values)
    if unknown:
        raise KeyError(f"{section}: unknown {', '.join(sorted(unknown))}")
    values.update(new)
