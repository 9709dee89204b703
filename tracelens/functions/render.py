"""Markdown and DOT from small gathered results."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path


def table(rows: list[dict], columns: list[str]) -> list[str]:
    if not rows:
        return ["None."]
    cell = lambda v: ", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(columns) + " |", "|" + " - |" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]


def section(title: str, lines: list[str]) -> list[str]:
    return [f"## {title}", "", *lines, ""]


def analysis(report: dict) -> str:
    out = ["# Log analysis", "", report["diagnosis"]["summary"], ""]
    out += section("Event types", [f"- {k}: {v}" for k, v in report["event_types"].items()] or ["None."])
    out += section("Likely sources", table(report["matches"][:10], ["line_no", "rank", "score", "function", "file", "line"]))
    out += section("Evidence", table(report["trace"], ["kind", "subject", "detail"]))
    out += section("Hypotheses", table(report["hypotheses"], ["title", "label", "confidence", "evidence"]))
    out += section("Suspicious events", table(report["suspicious"][:10], ["line", "type", "session_id", "message"]))
    out += section("Sessions", table(report["sessions"][:5], ["session_id", "event_count", "labels"]))
    out += section("Missing events", table(report["missing_events"], ["session_id", "sequence", "missing"]))
    out += section("Durations", table(report["durations"][:10], ["label", "count", "min_ms", "max_ms", "avg_ms"]))
    out += section("Context", [x for r in report.get("context", []) for x in (f"### {r['file']}:{r['line_no']}", "", "```", r["context"], "```", "")] or ["None."])
    out += section("Profile warnings", table(report["profile_warnings"], ["type", "session_id", "sequence", "label"]))
    return "\n".join(out)


def comparison(result: dict) -> str:
    out = ["# Comparison", ""]
    out += section("Labels", [f"- {k}: {', '.join(v) or '-'}" for k, v in result["labels"].items()])
    out += section("Sessions", table(result["sessions"], ["baseline_session", "target_session", "missing", "extra"]))
    out += section("Slower stages", table(result["duration_anomalies"], ["label", "baseline_avg_ms", "target_avg_ms", "ratio"]))
    out += section("Hypotheses", table(result["hypotheses"], ["title", "label", "confidence"]))
    return "\n".join(out)


def facts(title: str, values: dict) -> str:
    lines = []
    for k, v in values.items():
        lines += section(k.replace("_", " ").capitalize(), [f"- {x}" for x in v] if isinstance(v, list) and v and not isinstance(v[0], dict) else table(v, list(v[0])) if isinstance(v, list) and v else [str(v)])
    return "\n".join([f"# {title}", "", *lines])


def items(values: dict) -> list[str]:
    return [f"- {k.replace('_', ' ')}: {', '.join(map(str, v)) or '-' if isinstance(v, list) else v}" for k, v in values.items()]


def doctor(status: dict) -> str:
    known = {k: status[k] for k in ("project", "index", "index_stale", "manual_profile", "app_identifiers", "suggested_app_identifiers") if k in status}
    out = ["# Project", "", *items(known), "", *section("Profile", items(status["profile_health"]))]
    return "\n".join(out + section("Next", [f"- {x}" for x in status["recommendations"]]))


def cleanup_lines(patch: dict) -> list[str]:
    return [f"- {k.replace('_', ' ')}: {', '.join(f'`{x}`' for x in v)}" for k, v in patch.items() if v] or ["None."]


def lint(report: dict) -> str:
    out = ["# Profile lint", "", *section("Problems", table(report["problems"], ["severity", "type", "subject", "item", "action"]))]
    out += section("Fixes", table(report.get("fixes", []), ["action", "target", "reason"]))
    return "\n".join(out + section("Cleanup patch, for review", cleanup_lines(report.get("cleanup_patch", {}))))


def cleanup(report: dict) -> str:
    gone = {k: [x for x in report["before"].get(k) or [] if x not in (report["after"].get(k) or [])] for k in ("session_keys", "events")}
    out = ["# Profile cleanup", "", "Applied." if report["applied"] else "Nothing was written.", ""]
    for k, v in gone.items():
        out += section(f"Removed {k.replace('_', ' ')}", [f"- `{x}`" for x in v] or ["None."])
    return "\n".join(out + section("Left for review", cleanup_lines({k: v for k, v in report.get("patch", {}).items() if k.startswith("review_")})))


def diagnosis(result: dict) -> str:
    found, state = result["analysis"], result["doctor"]
    out = ["# Diagnosis", "", found["diagnosis"]["summary"], "", *section("Health", items({k: state[k] for k in ("index", "index_stale", "manual_profile")} | state["profile_health"]))]
    out += section("Findings", [f"- {x}" for x in found["diagnosis"]["findings"][:6]] or ["None."])
    out += section("Evidence", table(found["trace"][:8], ["kind", "subject", "detail"]))
    out += section("Profile problems", table(result["lint"][:8], ["severity", "type", "subject", "item"]))
    out += section("Cleanup patch, for review", cleanup_lines(result["cleanup_patch"]))
    return "\n".join(out + section("Next", [f"{i}. {x}" for i, x in enumerate(result["recommendations"], 1)]))


def dot(nodes: list[str], edges: list[tuple[str, str]], sites: list[tuple[str, str]]) -> str:
    """A graph of functions, calls among them, and the templates that they emit."""
    q = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = ["digraph code {", "  rankdir=LR;", *(f"  {q(n)} [shape=box];" for n in nodes), *(f"  {q(a)} -> {q(b)};" for a, b in edges)]
    for i, (f, t) in enumerate(sites):
        lines += [f"  s{i} [shape=note,label={q(t)}];", f"  {q(f)} -> s{i} [style=dashed];"]
    return "\n".join([*lines, "}", ""])


def draw(text: str, path: str) -> str:
    """Write a graph, as an image where Graphviz is there and the suffix asks for one; else its text. Returns the file written."""
    target = Path(path)
    if target.suffix != ".dot" and shutil.which("dot"):
        done = subprocess.run(["dot", f"-T{target.suffix.lstrip('.') or 'svg'}", "-o", str(target)], input=text, text=True, capture_output=True)
        if done.returncode == 0:
            return str(target)
    target = target.with_suffix(".dot")
    target.write_text(text, encoding="utf-8")
    return str(target)
