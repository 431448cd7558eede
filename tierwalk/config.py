"""Settings of a run: defaults, then TIERWALK_* of the environment, then arguments; checked; and logging."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields, replace

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass(frozen=True)
class Settings:
    forms: tuple[str, ...] = ("SC 13D", "SC 13G", "SC 13D/A", "SC 13G/A", "10-K", "20-F")
    depth: int = 2
    descension_depth: int = 3
    filings_per_cik: int = 50
    most_ciks: int = 100
    index_dir: str = ""
    descend: bool = False
    out: str = "edges"
    log_level: str = "INFO"
    log_file: str = ""

    def checked(self) -> Settings:
        """Itself, or an error; a folder of the submission index means descension."""
        if not 1 <= self.depth <= 10:
            raise ValueError(f"depth has to be 1 to 10, not {self.depth}")
        if not 0 <= self.descension_depth <= 10:
            raise ValueError(f"descension_depth has to be 0 to 10, not {self.descension_depth}")
        for name in ("filings_per_cik", "most_ciks"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} has to be positive")
        if self.log_level.upper() not in LEVELS:
            raise ValueError(f"log_level has to be one of {', '.join(LEVELS)}")
        return replace(self, log_level=self.log_level.upper(), descend=self.descend or bool(self.index_dir))


def _parsed(kind: object, value: str) -> object:
    if isinstance(kind, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(kind, int):
        return int(value)
    return tuple(v.strip() for v in value.split(",") if v.strip()) if isinstance(kind, tuple) else value


def load(environment: dict[str, str] | None = None, **arguments) -> Settings:
    """Arguments that are None count as not given."""
    env, base = os.environ if environment is None else environment, Settings()
    from_env = {f.name: _parsed(getattr(base, f.name), env[f"TIERWALK_{f.name.upper()}"]) for f in fields(base) if f"TIERWALK_{f.name.upper()}" in env}
    return replace(base, **from_env | {k: v for k, v in arguments.items() if v is not None}).checked()


def logger(settings: Settings) -> logging.Logger:
    """The package's logger with one handler, whatever it had before, and a file besides if named."""
    log = logging.getLogger("tierwalk")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler(), *([logging.FileHandler(settings.log_file)] if settings.log_file else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    log.setLevel(settings.log_level)
    return log
