"""A project's profile: a small file of settings, read, merged and written on the driver."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

FOLDER = ".tracelens"
LISTS = ("app_identifiers", "exclude_paths", "session_keys", "states")


def profile_path(project: str | Path) -> Path:
    return Path(project) / FOLDER / "profile.yaml"


def index_path(project: str | Path) -> Path:
    return Path(project) / FOLDER / "index"


def load_profile(project: str | Path) -> dict[str, Any]:
    """The manual profile of a project; empty if there is none."""
    path = profile_path(project)
    if not path.exists():
        return {}
    text = path.read_text(encoding="utf-8")
    return json.loads(text) if text.lstrip().startswith("{") else read_yaml(text)


def scalar(text: str) -> Any:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False}.get(text, text)


def read_yaml(text: str) -> dict[str, Any]:
    """Mappings, lists of scalars, inline lists, quotes and booleans; a comment takes a whole line. What is empty is a list."""
    rows = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(i: int, indent: int) -> tuple[Any, int]:
        if i < len(rows) and rows[i][0] >= indent and rows[i][1].startswith("- "):
            items, at = [], rows[i][0]
            while i < len(rows) and rows[i][0] == at and rows[i][1].startswith("- "):
                items.append(scalar(rows[i][1][2:]))
                i += 1
            return items, i
        out: dict[str, Any] = {}
        at = rows[i][0] if i < len(rows) else indent
        while i < len(rows) and rows[i][0] == at and at >= indent:
            key, _, value = rows[i][1].partition(":")
            i += 1
            if value.strip():
                out[scalar(key)] = scalar(value)
            elif i < len(rows) and (rows[i][0] > at or rows[i][0] == at and rows[i][1].startswith("- ")):
                out[scalar(key)], i = block(i, rows[i][0])
            else:
                out[scalar(key)] = []
        return out, i

    return block(0, 0)[0] if rows else {}


def written(value: Any) -> str:
    """A scalar, quoted where it would be read as something else."""
    text = str(value).lower() if isinstance(value, bool) else str(value)
    odd = not isinstance(value, bool) and (text in ("true", "false", "") or text[0] in "[]{}'\"#-" or text != text.strip() or ": " in text)
    return json.dumps(text, ensure_ascii=False) if odd and '"' not in text else text


def write_yaml(profile: dict[str, Any]) -> str:
    out: list[str] = []

    def put(value: Any, indent: int) -> None:
        pad = " " * indent
        if isinstance(value, dict):
            for k, v in value.items():
                if isinstance(v, dict | list) and v:
                    out.append(f"{pad}{k}:")
                    put(v, indent + 2)
                else:
                    out.append(f"{pad}{k}:" + ("" if isinstance(v, dict | list) else f" {written(v)}"))
        else:
            out.extend(f"{pad}- {written(x)}" for x in value)

    put(profile, 0)
    return "\n".join(out) + "\n"


def unique(*lists: list) -> list:
    """All items in order, each once."""
    return list(dict.fromkeys(str(x) for items in lists for x in items or [] if str(x)))


def effective(learned: dict[str, Any], manual: dict[str, Any]) -> dict[str, Any]:
    """The learned vocabulary with the manual profile before it: its patterns come first and are marked as manual."""
    patterns = []
    for name, spec in (manual.get("events") or {}).items():
        if isinstance(spec, dict):
            patterns += [{"pattern": str(p), "type": str(spec.get("type") or f"project:{name}"), "source": "manual_profile"} for p in spec.get("patterns") or []]
    return {
        **learned, **{k: manual[k] for k in ("entities", "events", "expected_sequences", "app_identifiers", "exclude_paths") if k in manual},
        "learned_patterns": patterns + list(learned.get("learned_patterns") or []),
        "session_keys": unique(manual.get("session_keys"), learned.get("session_keys")), "states": unique(manual.get("states"), learned.get("states")),
    }


def patched(profile: dict[str, Any], patch: dict[str, Any]) -> dict[str, Any]:
    """Lists joined, entities' aliases joined, events and sequences of the patch over the old ones."""
    out = {k: unique(profile.get(k), patch.get(k)) for k in LISTS}
    entities = {k: {"aliases": unique(v.get("aliases") if isinstance(v, dict) else [])} for k, v in (profile.get("entities") or {}).items()}
    for k, v in (patch.get("entities") or {}).items():
        entities[k] = {"aliases": unique(entities.get(k, {}).get("aliases"), v.get("aliases") if isinstance(v, dict) else [])}
    out["entities"] = entities
    for k in ("events", "expected_sequences"):
        out[k] = {**(profile.get(k) or {}), **(patch.get(k) or {})}
    return out


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", text.strip().lower()).strip("_") or "event"


def suggested(learned: dict[str, Any], identifiers: list[str] | None = None) -> dict[str, Any]:
    """A profile to begin with, from a learned vocabulary: the most frequent keys, states and patterns."""
    names: dict[str, int] = {}
    events = {}
    for item in (learned.get("learned_patterns") or [])[:40]:
        name = safe_name(str(item["pattern"]))
        names[name] = names.get(name, 0) + 1
        events[name if names[name] == 1 else f"{name}_{names[name]}"] = {"type": item["type"], "patterns": [item["pattern"]]}
    return {"app_identifiers": list(identifiers or [])[:20], "session_keys": (learned.get("session_keys") or [])[:20], "states": (learned.get("states") or [])[:40], "entities": {}, "events": events, "expected_sequences": {}}
