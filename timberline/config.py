"""Settings: a base with overrides per kind of log. Unknown keys are errors; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class General:
    log_type: str = "ftp"
    head_offset: int = 24
    max_line: int = 500


@dataclass(frozen=True)
class Template:
    library_size: int = 2000


@dataclass(frozen=True)
class Diagnosis:
    window: int = 10
    feature: str = "CNT"
    cover: str = "FULL"
    top: int = 3
    weights: dict[str, float] = field(default_factory=lambda: {"fatal": 3.0, "error": 3.0, "warning": 2.0, "notice": 1.0, "info": 1.0})


@dataclass(frozen=True)
class Sequences:
    width: int = 15
    epochs: int = 100
    hidden: int = 128
    top: int = 10
    batch: int = 32
    one_hot: bool = True


@dataclass(frozen=True)
class Windows:
    size_ms: int = 10_000
    step_ms: int = 5_000


@dataclass(frozen=True)
class Config:
    general: General = General()
    template: Template = Template()
    diagnosis: Diagnosis = Diagnosis()
    sequences: Sequences = Sequences()
    windows: Windows = Windows()

    def override(self, changes: dict) -> Config:
        """A copy with changes, a map of sections to maps."""
        return _changed(self, changes, "")

    @staticmethod
    def load(*paths: str) -> Config:
        """The defaults, changed by YAML files one after the other."""
        import yaml

        c = Config()
        for p in paths:
            c = c.override(yaml.safe_load(Path(p).read_text()) or {})
        return c

    def show(self) -> str:
        import dataclasses

        import yaml

        return yaml.safe_dump(dataclasses.asdict(self), sort_keys=False)


@dataclass(frozen=True)
class Paths:
    """Where a kind of log keeps its things below a folder; training and use have files of their own."""

    root: str = "data"
    log_type: str = "ftp"
    training: bool = True

    def named(self) -> dict[str, str]:
        """Names of things to their paths."""
        kept, made = f"{self.root}/kept/{self.log_type}", f"{self.root}/{'train' if self.training else 'test'}/{self.log_type}"
        kinds = {n: f"{kept}/{n}" for n in ("library", "vocabulary", "idf", "models", "rules.yaml", "classes.yaml")}
        return kinds | {n: f"{made}/{n}" for n in ("washed", "records", "structured", "templates", "report", "diagnosis", "ranges", "lines")}

    def show(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.named().items())


def _changed(x, changes: dict, path: str):
    known = {f.name for f in fields(x)}
    for k in changes:
        if k not in known:
            raise KeyError(f"no setting {path}{k}")
    new = {k: _changed(getattr(x, k), v, f"{path}{k}.") if is_dataclass(getattr(x, k)) else v for k, v in changes.items()}
    return replace(x, **new)


#: What the kinds of log change.
OVERRIDES = {
    "ftp": {"general": {"log_type": "ftp", "head_offset": 20, "max_line": 1000}, "template": {"library_size": 500}, "sequences": {"width": 5, "epochs": 50}, "windows": {"size_ms": 5000, "step_ms": 1000}},
    "cm": {"general": {"log_type": "cm", "max_line": 1000}},
}


def for_log_type(name: str) -> Config:
    return Config().override(OVERRIDES[name])
