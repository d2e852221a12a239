"""What a session is told about its repository: root, git metadata, configuration files. All of it is a few values on the driver."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Mapping
from pathlib import Path

try:
    import yaml
except ImportError:  # configuration is then read and written as JSON, which is YAML too
    yaml = None

FOLDER = ".loam"
CONFIG, LOCAL = f"{FOLDER}/config.yaml", f"{FOLDER}/config.local.yaml"
#: Variables that hold a key, in order.
KEYS = ("LOAM_API_KEY", "OPENAI_API_KEY", "GROQ_API_KEY")


def find_root(start: str | Path | None = None) -> Path:
    """The nearest folder at or above start with a configuration or a git folder, else the working folder."""
    here = Path(start or Path.cwd()).resolve()
    return next((p for p in (here, *here.parents) if (p / CONFIG).exists() or (p / ".git").exists()), Path.cwd())


def _git(root: str | Path, *args: str) -> str | None:
    try:
        return subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def git_metadata(root: str | Path) -> dict[str, str]:
    """branch and commit ('unknown' outside git) and name, from the remote's address or the folder."""
    remote = _git(root, "remote", "get-url", "origin")
    name = re.sub(r"\.git$", "", re.split(r"[/:]", remote.rstrip("/"))[-1]) if remote else ""
    return {"branch": _git(root, "rev-parse", "--abbrev-ref", "HEAD") or "unknown", "commit": _git(root, "rev-parse", "HEAD") or "unknown", "name": name or Path(root).resolve().name}


def merged(base: Mapping, over: Mapping) -> dict:
    """base with over's values; mappings are merged at every depth, lists and all else replaced."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}}


def _load(path: Path) -> dict:
    text = path.read_text("utf-8") if path.exists() else ""
    return (yaml.safe_load(text) if yaml else json.loads(text or "{}")) or {}


def _dump(values: Mapping) -> str:
    return yaml.safe_dump(dict(values), indent=2) if yaml else json.dumps(values, indent=2)


def load_config(root: str | Path, env: Mapping[str, str] | None = None) -> dict:
    """The configuration with the local file over it. A key `${NAME}` is the variable's value; without a key the first variable set is taken."""
    root, env = Path(root), os.environ if env is None else env
    if not (root / CONFIG).exists():
        raise FileNotFoundError(f"no configuration in {root}")
    both = merged(_load(root / CONFIG), _load(root / LOCAL))
    key = (both.get("provider") or {}).get("api_key")
    if not key:
        key = next((env[k] for k in KEYS if env.get(k)), "")
    elif named := re.fullmatch(r"\$\{(.*)\}", key):
        key = env.get(named[1], "")
    return merged(both, {"provider": {**(both.get("provider") or {}), "api_key": key}})


def save_config(root: str | Path, config: Mapping) -> None:
    """Writes the configuration with a reference in place of the key, and the key itself to the local file, for its owner only."""
    root = Path(root)
    (root / FOLDER).mkdir(parents=True, exist_ok=True)
    provider = {k: v for k, v in (config.get("provider") or {}).items() if k != "api_key"}
    key = (config.get("provider") or {}).get("api_key")
    (root / CONFIG).write_text(_dump({**config, "provider": {**provider, **({"api_key": "${" + KEYS[0] + "}"} if key else {})}}), "utf-8")
    if key:
        with os.fdopen(os.open(root / LOCAL, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
            f.write(_dump({"provider": {"api_key": key}}))
