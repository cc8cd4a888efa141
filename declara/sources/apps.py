"""Apps that manifests below a folder describe."""

from __future__ import annotations

import logging
import os
from pathlib import Path

log = logging.getLogger(__name__)

# Names of manifests, folders that hold none, and an app's fields with what stands for a missing one.
MANIFESTS = ("snowflake.yml", "snowflake.yaml")
SKIPPED = ("__pycache__", "node_modules", "venv")
FIELDS = {"main_file": "streamlit_app.py", "stage": "@{}_stage", "schema": "PUBLIC", "warehouse": "", "query_warehouse": "", "title": "{}", "comment": "", "external_access_integrations": [], "imports": []}
KIND = "streamlit"


def described(told: dict, folder: str) -> dict[str, dict]:
    """Name and fields of the apps of a manifest, of its second form (entities of a type) or its first (one key)."""
    if told.get("definition_version") and told.get("entities"):
        return {name: e for name, e in told["entities"].items() if str(e.get("type", "")).lower() == KIND}
    listed = told.get(KIND) or []
    return {e.get("name", folder): e for e in ([listed] if isinstance(listed, dict) else listed)}


def apps(root: str, depth: int = 5) -> list[dict]:
    """The apps below ``root`` by name; folders below ``depth``, hidden ones and those of tools are not entered, and a broken manifest is logged."""
    import yaml

    out, top = [], Path(root).resolve()
    for folder, below, files in os.walk(top):
        level = len(Path(folder).relative_to(top).parts)
        below[:] = [] if level >= depth else sorted(d for d in below if not d.startswith(".") and d not in SKIPPED)
        for path in (Path(folder, f) for f in sorted(set(files) & set(MANIFESTS))):
            try:
                for name, given in described(yaml.safe_load(path.read_text(encoding="utf-8")) or {}, path.parent.name).items():
                    filled = {k: given.get(k, v.format(name) if isinstance(v, str) else list(v)) for k, v in FIELDS.items()}
                    out.append({"name": name, "directory": folder, "definition_file": str(path), **filled})
            except Exception as e:
                log.warning("%s is left out: %s", path, e)
    return sorted(out, key=lambda a: a["name"])
