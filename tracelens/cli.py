"""Command line: index sources, analyse and compare logs, keep a profile, evaluate."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import render
from .operators import analyze, events, index, locate, parse, quality
from .sources import files, profile


def session() -> SparkSession:
    return SparkSession.builder.appName("tracelens").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def tables_of(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    return files.load_index(spark, str(path))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one log; its name stands for the file."""
    return files.log_lines(spark, path)


def text_lines(spark: SparkSession, text: str) -> DataFrame:
    return files.log_lines_of(spark.createDataFrame([("-", text)], "file string, text string"), "file", "text")


def show(value: object, out: str | None = None) -> None:
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2, default=str)
    if out:
        Path(out).write_text(text + "\n", encoding="utf-8")
    else:
        print(text)


def with_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("entry_id", F.concat_ws(":", "file", F.col("line_no").cast("string")))


def candidates(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.orderBy("entry_id", "rank").collect()]


def progress(a: argparse.Namespace, phase: str, path: str) -> None:
    """One line of JSON on standard error for each phase, where asked for."""
    if getattr(a, "progress_jsonl", False):
        print(json.dumps({"phase": phase, "path": path}), file=sys.stderr, flush=True)


def cmd_init(a: argparse.Namespace) -> int:
    spark = session()
    out = a.out or str(profile.index_path(a.project) if a.command == "init" else "index")
    source = getattr(a, "src", None) or a.project
    previous = None
    if a.command == "init" and not a.no_incremental and Path(out).exists():
        previous = {k: t.cache() for k, t in tables_of(spark, out).items()}
        for t in previous.values():
            t.count()
    progress(a, "parse", source)
    tables = analyze.build_index(spark, source, previous, profile.load_profile(a.project).get("exclude_paths"))
    progress(a, "write", out)
    files.save_index(tables, out + ".new")
    ready = tables_of(spark, out + ".new")
    files.save_index(ready, out)
    done = tables_of(spark, out)
    show({k: done[k].count() for k in ("functions", "call_edges", "log_sites")} | {"index": out})
    return 0


def cmd_query(a: argparse.Namespace) -> int:
    spark = session()
    raw = spark.createDataFrame([("-", 1, a.log)], "file string, line_no int, raw string")
    show(candidates(locate.locate(parse.entries(with_ids(raw)), tables_of(spark, a.index), a.top)))
    return 0


def cmd_locate(a: argparse.Namespace) -> int:
    spark = session()
    entries = parse.entries(with_ids(parse.blocks(lines_of(spark, a.log_file))))
    show(candidates(locate.locate(entries, tables_of(spark, a.index), a.top)))
    return 0


def analysed(a: argparse.Namespace) -> dict:
    spark = session()
    manual = profile.load_profile(a.project)
    tables = tables_of(spark, a.index or profile.index_path(a.project))
    return analyze.analyse(spark, tables, lines_of(spark, a.log_file), manual, a.query, not a.all_lines, a.top, context=getattr(a, "context", 0))


def cmd_analyze(a: argparse.Namespace) -> int:
    report = analysed(a)["report"]
    report["matches"] = report["matches"][: a.show_matches]
    if a.compact:
        report = {k: report[k] for k in ("counts", "entries", "matches", "query_focus", "diagnosis", "trace", "profile_warnings", "hypotheses")}
        a.format = "json"
    show(render.analysis(report) if a.format == "markdown" else report, a.out)
    return 0


def cmd_explain(a: argparse.Namespace) -> int:
    a.format = "markdown"
    return cmd_analyze(a)


def cmd_compare(a: argparse.Namespace) -> int:
    spark = session()
    tables = tables_of(spark, a.index or profile.index_path(a.project))
    result = analyze.compare_runs(spark, tables, lines_of(spark, a.baseline), lines_of(spark, a.target), profile.load_profile(a.project))
    show(render.comparison(result) if a.format == "markdown" else result, a.out)
    return int(a.fail_on_regression and bool(result["duration_anomalies"] or result["hypotheses"] or result["labels"]["missing"]))


def cmd_profile(a: argparse.Namespace) -> int:
    spark = session()
    manual = profile.load_profile(a.project)
    path = profile.profile_path(a.project)

    def save(value: dict) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(profile.write_yaml(value), encoding="utf-8")

    index_at = a.index or profile.index_path(a.project)
    if a.action in ("suggest", "init"):
        if a.action == "init" and path.exists() and not a.force:
            print(f"{path} exists", file=sys.stderr)
            return 1
        value = profile.suggested(events.learned_profile(tables_of(spark, index_at)["log_sites"]), files.app_identifiers(spark, a.project))
        if a.action == "init":
            save(value)
        show(profile.write_yaml(value), a.out)
        return 0
    if a.action == "refine":
        a.query, a.all_lines, a.top = a.query or "", True, 3
        done = analysed(a)
        rows = done["report"]["suggested_rules"] + [r.asDict() for r in quality.runtime_tokens(done["events"]).collect()]
        patch = {"events": {profile.safe_name(r["pattern"]): {"type": f"project:{profile.safe_name(r['pattern'])}", "patterns": [r["pattern"]]} for r in rows[:30]}}
        if a.apply:
            save(profile.patched(manual, patch))
        show(patch if a.format == "json" else profile.write_yaml(patch), a.out)
        return 0
    if a.action == "lint":
        lines = lines_of(spark, a.log_file) if a.log_file else None
        if not path.exists():
            problems = [{"severity": "error", "type": "missing_profile", "subject": str(path), "item": ""}]
            show({"problems": problems})
            return int(a.strict)
        warnings = None
        if lines is not None and Path(index_at).exists():
            a.top, a.context = 3, 0
            warnings = analysed(a)["warnings"]
        found = quality.lint(spark, manual, None if lines is None else quality.lines_for(lines, a.query), warnings)
        problems = [r.asDict() | {"action": quality.ACTIONS.get(r["type"], "")} for r in found.orderBy("severity", "type", "subject", "item").collect()]
        report = {"problems": problems, "fixes": quality.fixes(problems), "cleanup_patch": quality.cleanup_patch(found)}
        show(render.lint(report) if a.format == "markdown" else report, a.out)
        return int(a.strict and any(p["severity"] in ("warning", "error") for p in problems))
    patch = json.loads(Path(a.patch).read_text(encoding="utf-8")) if a.patch and a.patch.endswith(".json") else profile.read_yaml(Path(a.patch).read_text(encoding="utf-8")) if a.patch else {}
    if a.action == "cleanup":
        after = quality.cleaned(manual, patch.get("cleanup_patch", patch))
        if a.apply:
            save(after)
        report = {"applied": bool(a.apply), "before": manual, "after": after, "patch": patch.get("cleanup_patch", patch)}
        show(render.cleanup(report) if a.format == "markdown" else report, a.out)
    elif a.action == "apply":
        save(patch if a.force else profile.patched(manual, patch))
    elif a.action == "sequence":
        a.query, a.all_lines, a.top, a.log_file = "", True, 3, a.from_log
        show(profile.write_yaml({"expected_sequences": {a.name: analyze.sequence_from(analysed(a)["timelines"])}}), a.out)
    return 0


def cmd_audit(a: argparse.Namespace) -> int:
    spark = session()
    counts = quality.quality_score(quality.audit(tables_of(spark, a.index)["log_sites"]))
    problems = [r["problem"] for r in quality.audit_problems(counts).orderBy("ord").collect()]
    result = counts.first().asDict() | {"problems": problems, "recommendations": quality.recommendations(problems)}
    show(render.facts("Audit", result) if a.format == "markdown" else result)
    return 0


def cmd_doctor(a: argparse.Namespace) -> int:
    spark = session()
    at = profile.index_path(a.project)
    status = analyze.doctor(spark, a.project, tables_of(spark, at) if at.exists() else None, profile.load_profile(a.project))
    show(render.doctor(status) if a.format == "markdown" else status)
    return 0


def cmd_diagnose(a: argparse.Namespace) -> int:
    spark = session()
    result = analyze.diagnose(spark, a.project, tables_of(spark, profile.index_path(a.project)), lines_of(spark, a.log_file), profile.load_profile(a.project), a.query)
    if a.save_artifacts:
        base = Path(a.log_file).with_suffix("")
        Path(f"{base}.diagnosis.json").write_text(json.dumps(result, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
        Path(f"{base}.diagnosis.md").write_text(render.diagnosis(result), encoding="utf-8")
        Path(f"{base}.cleanup.json").write_text(json.dumps({"cleanup_patch": result["cleanup_patch"]}, ensure_ascii=False, indent=2), encoding="utf-8")
    show(result, a.out)
    return 0


def cmd_render(a: argparse.Namespace) -> int:
    spark = session()
    t = tables_of(spark, a.index)
    if a.log:
        raw = spark.createDataFrame([("-", 1, a.log)], "file string, line_no int, raw string")
        chosen = locate.locate(parse.entries(with_ids(raw)), t, a.top).select("function_id")
    else:
        chosen = spark.createDataFrame([(x,) for x in a.function_id], "function_id string")
    nodes, edges = index.focus(chosen, t["functions"], t["call_edges"])
    sites = t["log_sites"].join(nodes.select(F.col("id").alias("function_id")), "function_id", "left_semi")
    text = render.dot(sorted(r["id"] for r in nodes.collect()), sorted((r["caller"], r["callee"]) for r in edges.collect()), sorted((r["function_id"], r["template"]) for r in sites.collect()))
    show({"written": render.draw(text, a.out)})
    return 0


def cmd_evaluate(a: argparse.Namespace) -> int:
    spark = session()
    tables = {k: t.cache() for k, t in analyze.build_index(spark, a.src).items()}
    corpus = files.labelled_corpus(spark, a.corpus).cache()
    raw = corpus.select(F.lit("-").alias("file"), F.lit(1).alias("line_no"), F.col("log").alias("raw"), F.col("id").alias("entry_id"))
    out = locate.evaluate(corpus, parse.entries(raw), tables, a.top, a.tolerance).cache()
    r = out.agg(F.count(F.lit(1)).alias("total"), F.count_if("top1").alias("top1"), F.count_if("hit").alias("hit")).first()
    accuracy = r["hit"] / r["total"] if r["total"] else 0.0
    failed = [x["id"] for x in out.filter("not hit").orderBy("id").limit(a.show_failures).collect()]
    show({"total": r["total"], "top1": r["top1"], f"top{a.top}": r["hit"], "accuracy": accuracy, "failures": failed})
    return int(accuracy < a.min_accuracy)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *args: tuple) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for names, options in args:
            c.add_argument(*names.split(), **options)
        return c

    text, flag = (lambda n, d=None: (n, {"default": d})), (lambda n: (n, {"action": "store_true"}))
    number = lambda n, d: (n, {"type": type(d), "default": d})
    log, project, idx, top, out = ("--log-file", {"required": True}), ("project", {}), ("index", {}), number("--top", 3), text("--out")
    shape = ("--format", {"choices": ["json", "markdown"], "default": "json"})
    common = [project, log, text("--index"), out, top, number("--show-matches", 10), flag("--all-lines"), shape, text("--query", ""), number("--context", 0), flag("--compact")]
    add("index", cmd_init, project, out, flag("--progress-jsonl"))
    add("init", cmd_init, project, text("--src"), out, flag("--no-incremental"), flag("--progress-jsonl"))
    add("query", cmd_query, idx, ("--log", {"required": True}), top)
    add("locate", cmd_locate, idx, log, top)
    add("analyze", cmd_analyze, *common)
    add("explain", cmd_explain, *common)
    add("compare", cmd_compare, project, ("--baseline", {"required": True}), ("--target", {"required": True}), text("--index"), out, shape, flag("--fail-on-regression"))
    add(
        "profile", cmd_profile, ("action", {"choices": ["suggest", "init", "refine", "lint", "cleanup", "apply", "sequence"]}), project, text("--log-file"), text("--from-log"), text("--index"), text("--query", ""),
        text("--patch"), text("--name", "success"), out, flag("--apply"), flag("--force"), flag("--strict"), flag("--all-lines"), ("--format", {"choices": ["json", "yaml", "markdown"], "default": "yaml"}),
    )
    add("audit", cmd_audit, idx, shape)
    add("doctor", cmd_doctor, project, shape)
    add("diagnose", cmd_diagnose, project, log, text("--query", ""), flag("--save-artifacts"), out)
    add("render", cmd_render, idx, text("--log"), ("--function-id", {"action": "append", "default": []}), top, text("--out", "graph.dot"))
    add("evaluate", cmd_evaluate, ("--src", {"required": True}), ("--corpus", {"required": True}), top, number("--tolerance", 3), number("--min-accuracy", 0.9), number("--show-failures", 10))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
