"""Configuration of an analysis: a YAML or JSON file, sought upwards from a folder, checked against ranges."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from .operators.ledger import PRICES

NAMES = ("lattica.yaml", "lattica.yml", "lattica.json")


@dataclass
class Config:
    name: str = "project"
    java_version: int = 17
    ignore_paths: list[str] = field(default_factory=lambda: ["**/test/**", "**/generated/**"])
    constraints: list[list[str]] = field(default_factory=list)
    algorithm: str = "louvain"
    resolution: float = 1.0
    weights: tuple[float, float, float] = (0.5, 0.2, 0.3)
    model: str = "gpt-4o"
    temperature: float = 0.7
    cost_limit_usd: float = 5.0
    path: Path | None = None

    def __post_init__(self):
        for what, value, low, high in (
            ("java_version", self.java_version, 8, 21), ("resolution", self.resolution, 0.1, 10.0), ("temperature", self.temperature, 0.0, 2.0), ("cost_limit_usd", self.cost_limit_usd, 0.0, float("inf")),
        ):
            if not low <= value <= high:
                raise ValueError(f"{what} must lie in {low} .. {high}, not {value}")
        if self.model not in PRICES:
            warnings.warn(f"no price is known for model {self.model!r}; estimates are used", stacklevel=3)

    @property
    def root(self) -> Path:
        return self.path.parent if self.path else Path.cwd()


def find(start: Path | str = ".") -> Path | None:
    """The nearest configuration file in start or a folder above, each time before one in its folder src."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for place in (folder, folder / "src"):
            for name in NAMES:
                if (place / name).is_file():
                    return place / name
    return None


def runtime_root(root: Path) -> Path:
    """Where projects and output lie: root or the folder above, the first with a folder projects, else the first with output, else root."""
    for name in ("projects", "output"):
        for folder in (root, root.parent):
            if (folder / name).exists():
                return folder
    return root


def source_and_output(root: Path, source: str | None = None, project: str | None = None, output: str | None = None) -> tuple[Path, Path]:
    """(sources, output) of a run: a folder of sources, or a project by its name below projects (its src/main/java if it has one); output by default beside projects. A source that isn't there raises FileNotFoundError."""
    base = runtime_root(root)
    if source is not None:
        at = Path(source).expanduser().resolve()
    else:
        at = base / "projects" / (project or "")
        if project and (at / "src/main/java").is_dir():
            at = at / "src/main/java"
    if not at.is_dir() or source is None and not project:
        raise FileNotFoundError(f"no folder {at}")
    return at, Path(output).expanduser().resolve() if output else base / "output"


def load(path: Path | str | None = None) -> Config:
    path = Path(path) if path else find()
    if path is None or not path.is_file():
        raise FileNotFoundError(f"no configuration at {path or Path.cwd()}")
    if path.suffix == ".json":
        raw = json.loads(path.read_text())
    else:
        import yaml

        raw = yaml.safe_load(path.read_text()) or {}
    project, analysis, llm = (raw.get(k) or {} for k in ("project", "analysis", "llm"))
    clustering = analysis.get("clustering") or {}
    w = clustering.get("weights") or {}
    given = {
        "name": project.get("name"), "java_version": project.get("java_version"), "ignore_paths": analysis.get("ignore_paths"),
        "constraints": [c["classes"] for c in analysis.get("constraints") or []], "algorithm": clustering.get("algorithm"), "resolution": clustering.get("resolution"),
        "weights": (w.get("structural", 0.5), w.get("semantic", 0.2), w.get("data_gravity", 0.3)),
        "model": llm.get("model"), "temperature": llm.get("temperature"), "cost_limit_usd": llm.get("cost_limit_usd"),
    }
    return Config(path=path, **{k: v for k, v in given.items() if v is not None})


def build_root(start: Path | str, most: int = 10) -> Path | None:
    """The nearest folder, up to ten levels above, that holds a build file."""
    at = Path(start).resolve()
    for folder in [at, *at.parents][: most + 1]:
        if any((folder / n).is_file() for n in ("pom.xml", "build.gradle", "build.gradle.kts")):
            return folder
    return None


def merged_metadata(found: dict | None, defaults: dict) -> dict:
    """Defaults, with what was found where it isn't null."""
    return defaults | {k: v for k, v in (found or {}).items() if v is not None}
