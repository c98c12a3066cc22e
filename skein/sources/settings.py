"""Settings of a project: a TOML file, an environment file, and logging."""

from __future__ import annotations

import logging
import os
import sys
import tomllib
from dataclasses import dataclass
from pathlib import Path

FILE = "skein.toml"
log = logging.getLogger("skein")
EXAMPLE = """# Settings of a project; every entry is optional.

[security]
extra_sensitive_dirs = []  # folders whose files never leave the machine

[detect]
extra_ignore_dirs = []  # folders that are not read

[cluster]
fine_resolution = 0.6
coarse_resolution = 0.15

[provider]
# model = "name"
# vision_model = "name"
"""


@dataclass(frozen=True)
class Settings:
    extra_sensitive_dirs: tuple[str, ...] = ()
    extra_ignore_dirs: tuple[str, ...] = ()
    fine_resolution: float = 0.6
    coarse_resolution: float = 0.15
    model: str | None = None
    vision_model: str | None = None


def load_settings(root: str | Path) -> Settings:
    """The defaults where the file is missing or can't be read."""
    path = Path(root, FILE)
    if not path.is_file():
        return Settings()
    try:
        data = tomllib.loads(path.read_text(encoding="utf-8"))
        part = lambda name: data.get(name, {})
        return Settings(
            tuple(part("security").get("extra_sensitive_dirs", ())),
            tuple(part("detect").get("extra_ignore_dirs", ())),
            float(part("cluster").get("fine_resolution", 0.6)),
            float(part("cluster").get("coarse_resolution", 0.15)),
            part("provider").get("model"),
            part("provider").get("vision_model"),
        )
    except (OSError, ValueError, TypeError, AttributeError) as error:
        log.warning("%s can't be read (%s): the defaults hold", path, error)
        return Settings()


def write_example(root: str | Path) -> bool:
    """Writes an example file, never over an existing one."""
    path = Path(root, FILE)
    if path.exists():
        log.warning("%s exists; nothing written", path)
        return False
    path.write_text(EXAMPLE, encoding="utf-8")
    return True


def load_env(start: str | Path) -> Path | None:
    """Takes over NAME=value lines of the nearest .env at or above start; what is set stays."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        path = folder / ".env"
        if path.is_file():
            for line in path.read_text(encoding="utf-8", errors="replace").splitlines():
                name, found, value = line.strip().partition("=")
                if found and name.strip() and not name.startswith("#"):
                    os.environ.setdefault(name.strip().removeprefix("export ").strip(), value.strip().strip("'\""))
            return path
    return None


def set_up_logging(verbose: bool = False, quiet: bool = False) -> None:
    """Messages go to stderr, so that results alone are on stdout; SKEIN_LOG_LEVEL beats the flags."""
    level = os.environ.get("SKEIN_LOG_LEVEL", "DEBUG" if verbose else "ERROR" if quiet else "INFO").upper()
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(getattr(logging, level, logging.INFO))
