"""Settings of a benchmark run: a document with defaults for every key, and the places that follow from it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..functions.text import LABELS

# Methods by what is done with them, and the seed that stands for runs without one.
JUDGE_METHODS = ["first_person_rule", "oneshot_judge", "fewshot_judge"]
GENERATED_METHODS = ["duplicate", "oneshot", "fewshot", "paraphrase"]
SEEDLESS = {"first_person_rule": 0}
LARGE_RUN, OLD_STATUS = "_100x", "incomplete_card_budget"
DEFAULTS: dict[str, Any] = {
    "seeds": [42, 123, 456],
    "paths": {"dataset_dir": "data", "seed_pool_dir": "outputs/seed_pools", "output_root": "outputs/runs"},
    "seed_pool": {"per_label": 10},
    "methods": {"train": [], "direct_judge": []},
    "custom_methods": {},
    "generation": {"n_samples": 2000, "model": "", "url": "http://localhost:8000/v1", "concurrency": 1, "attempt_cap": 20000, "temperature": 1.0, "top_p": 0.9, "paraphrase_batch_size": 10, "paraphrase_attempt_factor": 0.5},
    "direct_judge": {"max_retries": 2, "temperature": 0.0, "top_p": 0.9},
    "trainer": {"epochs": 15, "eval_valid_size": 2000, "eval_test_size": 0, "eval_subsample_seed": 0, "calibrate_threshold": False},
    "artifacts": {"keep_predictions": True, "keep_model_weights": False},
    "datasets": {},
}


@dataclass(frozen=True)
class Dataset:
    name: str
    display_name: str
    split_dir: Path
    pool_root: Path

    def split(self, name: str) -> str:
        return str(self.split_dir / f"{name}.jsonl")

    def pool(self, seed: int, per_label: int) -> str:
        return str(self.pool_root / f"seed_{seed}_k{per_label}")


@dataclass(frozen=True)
class Config:
    values: dict[str, Any] = field(default_factory=dict)
    base: Path = Path()

    def of(self, section: str, key: str) -> Any:
        return self.values[section][key]

    @property
    def seeds(self) -> list[int]:
        return [int(s) for s in self.values["seeds"]]

    @property
    def methods(self) -> list[str]:
        """All methods that may be asked for, custom ones last."""
        named = [*self.values["methods"]["train"], *self.values["methods"]["direct_judge"]]
        return [*named, *sorted(set(self.values["custom_methods"]) - set(named))]

    @property
    def output_root(self) -> str:
        return str(self.base / self.of("paths", "output_root"))

    @property
    def datasets(self) -> dict[str, Dataset]:
        splits, pools = (self.base / self.of("paths", k) for k in ("dataset_dir", "seed_pool_dir"))
        return {n: Dataset(n, (v or {}).get("display_name", n), splits / n, pools / n) for n, v in self.values["datasets"].items()}


def with_defaults(raw: Mapping[str, Any] | None) -> dict[str, Any]:
    """The given values over the defaults, key by key within each section; null sections count as missing."""
    raw = raw or {}
    if not isinstance(raw, Mapping):
        raise ValueError("settings must be a mapping")
    merged = {}
    for key in {*DEFAULTS, *raw}:
        given, default = raw.get(key), DEFAULTS.get(key)
        merged[key] = {**default, **(given or {})} if isinstance(default, dict) else default if given is None else given
    return merged


def _parsed(path: Path) -> Any:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise ValueError(f"{path} needs a YAML reader; write the settings as JSON") from missing
    return yaml.safe_load(text)


def load_config(path: str | Path) -> Config:
    """Settings of a JSON or YAML document; its places are relative to its folder."""
    path = Path(path)
    return Config(with_defaults(_parsed(path)), path.parent)


def label_map(source: str | Path | None) -> dict[str, int]:
    """Label to number of a document, which must be a mapping; the usual one without a document."""
    if source is None or not Path(source).exists():
        return {name: i for i, name in enumerate(LABELS)}
    found = _parsed(Path(source))
    if not isinstance(found, Mapping):
        raise ValueError(f"{source} is no mapping")
    return dict(found)


def seeds_of(method: str, seeds: list[int]) -> list[int]:
    """Seeds of a method's runs; a rule has one run."""
    return [SEEDLESS[method]] if method in SEEDLESS else seeds


def allows_incomplete(method: str, meta: Mapping[str, Any]) -> bool:
    """May a run with fewer rows than asked for be used? Its own word counts, else the older mark of large runs."""
    if "allow_incomplete_training_data" in meta:
        return bool(meta["allow_incomplete_training_data"])
    return method.endswith(LARGE_RUN) and meta.get("generation_status") == OLD_STATUS
