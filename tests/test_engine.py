"""The log-diagnosis engine on a small project, and its operators against plain Python."""

import json
import os
import random
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelens import cli
from tracelens.functions import render, text
from tracelens.operators import analyze, compare, events, index, locate, parse, quality, rules
from tracelens.sources import extract, files, profile

ORDERS = '''import logging
log = logging.getLogger("orders")


def place_order(cart):
    log.info("Placing order for cart %s", cart)
    return store_order(cart)


def store_order(cart):
    try:
        log.error("Could not store order %s", cart)
    except ValueError:
        log.exception(f"order {cart} was broken state=Await")


class Billing:
    def charge(self, user, amount):
        log.warning("Charged {} for user {}".format(amount, user))
'''
USERS = '''import logging
log = logging.getLogger("users")


def find_user(ident):
    log.error("User %d is unknown here", ident)
    raise LookupError(f"User {ident} is unknown here")
'''


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "app").mkdir()
    (root / "app" / "orders.py").write_text(ORDERS)
    (root / "app" / "users.py").write_text(USERS)
    (root / "vendor").mkdir()
    (root / "vendor" / "skip.py").write_text(USERS)
    return root


@pytest.fixture(scope="module")
def tables(spark, project):
    return {k: t.cache() for k, t in analyze.build_index(spark, str(project)).items()}


def entry_rows(spark, *raws):
    rows = spark.createDataFrame([("f", i + 1, str(i), r) for i, r in enumerate(raws)], "file string, line_no int, entry_id string, raw string")
    return parse.entries(rows)


def test_index(tables):
    assert {r.qualname for r in tables["functions"].collect()} == {"place_order", "store_order", "Billing.charge", "find_user"}
    assert {r.template for r in tables["log_sites"].collect()} == {"Placing order for cart %s", "Could not store order %s", "order {} was broken state=Await", "Charged {} for user {}", "User %d is unknown here"}
    assert {r.file for r in tables["file_signatures"].collect()} == {"app/orders.py", "app/users.py"}


def test_incremental_index(spark, project, tables, tmp_path):
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(project, copy)
    first = {k: t.cache() for k, t in analyze.build_index(spark, str(copy)).items()}
    for t in first.values():
        t.count()
    (copy / "app" / "users.py").write_text(USERS.replace("unknown", "missing") + "\n")
    (copy / "app" / "orders.py").unlink()
    again = analyze.build_index(spark, str(copy), first)
    assert {r.template for r in again["log_sites"].collect()} == {"User %d is missing here"}
    assert {r.qualname for r in again["functions"].collect()} == {"find_user"}


def test_formats(spark):
    got = entry_rows(
        spark, "2024-01-15 10:30:45,123 INFO [main] a.B - hello", "2024-01-15 10:30:45.123 [main] WARN a.B - hello", "2024-01-15 10:30:45 ERROR a.b - hello", "07-08 10:12:01.123 12 34 I Tag: hello", "E/Tag( 12): hello", "Jan 15 10:30:45 host prog[3]: hello",
        "timestamp=1 level=warn message=hello", "INFO: hello", "just text", '{"msg": "hello", "levelname": "info", "lineno": "7", "file": "x.py"}', "",
    ).orderBy("line_no").collect()
    assert [r.level for r in got] == ["INFO", "WARN", "ERROR", "INFO", "ERROR", "INFO", "WARN", "INFO", "", "INFO", ""]
    assert [r.message for r in got] == ["hello"] * 8 + ["just text", "hello", ""]
    assert got[9].lineno == 7 and got[9].pathname == "x.py" and got[5].logger == "prog"


def test_blocks_against_a_state_machine(spark):
    rng = random.Random(5)
    kinds = ["2024-01-15 10:30:45 INFO a - m", "  at a.B(C.java:1)", "java.io.IOException: x", "continued", "... 3 more", "ERROR: y"]
    for case in range(6):
        lines = [rng.choice(kinds) for _ in range(40)]
        want, cur, inside = [], [], False
        for line in lines:
            exc, starts = line.startswith("java."), line.startswith(("2024", "ERROR"))
            if inside:
                cur.append(line)
                inside = not exc
            elif exc:
                inside = True
                cur.append(line)
            else:
                if cur and starts:
                    want.append("\n".join(cur))
                    cur = []
                cur.append(line)
        want.append("\n".join(cur))
        df = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
        assert [r.raw for r in parse.blocks(df).orderBy("line_no").collect()] == want


def test_locate(spark, tables):
    trace = 'Traceback (most recent call last):\n  File "/srv/app/users.py", line 6, in find_user\n    raise LookupError()\nLookupError: User 3 is unknown here'
    found = locate.locate(entry_rows(spark, "ERROR [orders] Could not store order 42", trace, "nothing to see", "INFO x Chargd 7.5 for usr anna!"), tables).filter("rank = 1")
    best = {r.entry_id: (r.function, r.line) for r in found.collect()}
    assert best["0"] == ("store_order", 12) and best["1"] == ("find_user", 6) and "2" not in best


def test_generic_templates_find_nothing(spark):
    one = spark.createDataFrame([("%d",), ("{} {}",), ("order %s",)], "t string").select("t", text.is_generic(F.col("t")).alias("g"))
    assert {r.t: r.g for r in one.collect()} == {"%d": True, "{} {}": True, "order %s": False}


def test_similarity_tiers(spark):
    df = spark.createDataFrame([("order 5 saved", "order 7 saved"), ("abc", ""), ("short", "a very much longer text than that"), ("a b c d e f", "a b c d e x")], "a string, b string")
    got = [r.s for r in df.select(text.quick_similarity(text.canonical("a"), text.canonical("b")).alias("s")).collect()]
    assert got == [0.95, 0.0, 0.0, pytest.approx(0.85 + (5 / 6 - 0.8) * 0.5)]


def test_number_text(spark):
    values = [0.0, 15200.0, 1234567.0, 0.5, 12.25, 100000.0, 1000000.0, 0.00001, 3.14159265]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(text.number_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{v:g}" for v in values]


LOG = ["2024-01-15 10:00:00 INFO a - start sessionId=s1", "2024-01-15 10:00:01 ERROR a - await state=Await sessionId=s1 duration=15.2s timeout", "2024-01-15 10:00:02 WARN a - retry sessionId=s2 took 900 ms", "2024-01-15 10:00:03 WARN a - retry again sessionId=s2"]
MANUAL = {"session_keys": ["sessionId"], "events": {"begin": {"type": "begin", "patterns": ["start"]}}, "expected_sequences": {"flow": ["begin", "timeout", "done"]}}


def log_frame(spark, rows):
    return spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(rows)], "file string, line_no int, line string")


def test_analysis(spark, tables):
    report = analyze.analyse(spark, tables, log_frame(spark, LOG), MANUAL)["report"]
    assert report["event_types"] == {"begin": 1, "timeout": 1, "retry": 2}
    assert report["missing_events"][0]["missing"] == ["done"] and report["durations"][0]["max_ms"] == 15200.0
    assert {h["title"] for h in report["hypotheses"]} == {"Expected event missing before a timeout", "Repeated retries", "Long-running stage"}
    assert "Log analysis" in render.analysis(report)


def test_missing_walk(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(8))], [rng.choice("abcd") for _ in range(5)]) for _ in range(200)]

    def walk(labels, expected):
        at, absent = 0, []
        for x in expected:
            if x in labels[at:]:
                at = labels.index(x, at) + 1
            else:
                absent.append(x)
        return absent

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = {r.i: r.m for r in df.select("i", events.missing_of(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {i: walk(a, b) for i, (a, b) in enumerate(rows)}


def test_comparison(spark, tables):
    slow = [x.replace("15.2s", "45s").replace("start", "begun") for x in LOG]
    result = analyze.compare_runs(spark, tables, log_frame(spark, LOG), log_frame(spark, slow), MANUAL)
    assert result["labels"]["missing"] == ["begin"] and result["duration_anomalies"][0]["label"] == "Await"
    assert any(h["title"] == "Duration regression" for h in result["hypotheses"]) and "Comparison" in render.comparison(result)
    one = spark.createDataFrame([(["a", "b", "a"], ["a", "c"])], "x array<string>, y array<string>").select(compare.shared(F.col("x"), F.col("y")), compare.lacking(F.col("x"), F.col("y"))).first()
    assert list(one) == [["a", "a"], ["b"]]


def test_long_label_lists_are_compared_in_proportion(spark):
    n = 40_000
    a, b = (F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit(x), (i % 7).cast("string"))) for x in ("a", "b"))
    runs = spark.range(2).select(F.col("id").cast("string").alias("session_id"), (F.lit(n) + F.col("id")).alias("event_count"), F.concat(F.when(F.col("id") == 0, a).otherwise(b), F.array(F.lit("end"))).alias("labels"))
    long = {i: [f"{x}{k % 7}" for k in range(1, n + 1)] for i, x in ((0, "a"), (1, "b"))}
    start = time.monotonic()
    got = compare.compare_labels(runs, runs.filter("session_id = '1'").withColumn("labels", F.concat("labels", F.array(F.lit("more"))))).first()
    lists = runs.filter("session_id = '0'").select(F.col("labels").alias("x")).crossJoin(runs.filter("session_id = '1'").select(F.col("labels").alias("y")))
    pair = lists.select(compare.shared(F.col("x"), F.col("y")).alias("shared"), compare.lacking(F.col("x"), F.col("y")).alias("lacking")).first()
    took = time.monotonic() - start
    assert got.shared == [*long[1], "end", "end"] and got.missing == long[0] and got.extra == ["more"]
    assert pair.shared == ["end"] and pair.lacking == long[0]
    assert took < 30



def test_edges_resolve_by_one_meaning(spark):
    fns = spark.createDataFrame([("1", "run", "run", "m"), ("2", "go", "A.go", "m"), ("3", "top", "top", "n")], "id string, name string, qualname string, module string")
    edges = spark.createDataFrame([("1", c, "f", 1, 0.5) for c in ("run", "self.go", "n.top", "other")], "caller string, callee string, file string, line int, confidence double")
    assert {r.raw: r.callee for r in index.resolve_edges(edges, fns).collect()} == {"run": "run", "self.go": "2", "n.top": "3", "other": "other"}
    assert {r.callee for r in index.resolve_edges(edges, fns, distinct_names=True).collect()} == {"1", "2", "3", "other"}


@pytest.mark.parametrize(
    "language, file, code, functions, sites",
    [
        ("java", "A.java", 'public class A {\n  public void run(int x) {\n    logger.error("it failed {}", x);\n  }\n}\n', {"A.run"}, {("A.run", "error", "it failed {}")}),
        ("typescript", "a.ts", "export function go() {\n  console.log(`done ${x}`);\n}\nconst f = (a) => {\n console.warn('odd');\n}\n", {"go", "f"}, {("go", "info", "done {}"), ("f", "warn", "odd")}),
        ("go", "a.go", 'func (s *S) Run() {\n\tlog.Fatalf("no %s", x)\n\tfmt.Println("yes")\n}\n', {"Run"}, {("Run", "fatal", "no %s"), ("Run", "info", "yes")}),
        ("c", "a.c", '#include <x.h>\nstatic int run(int a,\n    int b) {\n  printf("value of %d", a);\n  printf("%d", a);\n}\nvoid g(void) {\n  syslog(LOG_ERR, "bad thing");\n}\n', {"run", "g"}, {("run", "info", "value of %d"), ("g", "err", "bad thing")}),
        ("c", "a.hpp", 'void A::run() {\n  std::cerr << "broken pipe";\n}\n', {"A::run"}, {("A::run", "info", "broken pipe")}),
        ("kotlin", "A.kt", 'class A {\n  fun run(x: Int) {\n    Log.e(TAG, "bad $x")\n    L.ri { "was ${x}" }\n    other.call()\n  }\n}\n', {"A.run"}, {("A.run", "e", "bad {}"), ("A.run", "ri", "was {}")}),
    ],
)
def test_extractors(language, file, code, functions, sites):
    rows = extract.parse(language, file, file.split(".")[0], code.encode())
    assert {r[4] for r in rows if r[0] == "function"} >= functions and {(r[4], r[8], r[9]) for r in rows if r[0] == "site"} == sites
    assert extract.parse("python", "b.py", "b", b"def x(:\n") == [] and extract.parse("python", "b.py", "b", b"\xff") == []


def test_profile_round_trip():
    value = {"app_identifiers": ["com.a"], "entities": {"order": {"aliases": ["订单", "[x]", "true"]}}, "events": {"e": {"type": "t", "patterns": ["a: b"]}}, "expected_sequences": {"s": ["a", "b"]}, "states": []}
    assert profile.read_yaml(profile.write_yaml(value)) == value
    assert profile.read_yaml("# c\nkeys: [a, 'b']\nx:\n  y: true\n") == {"keys": ["a", "b"], "x": {"y": True}}
    merged = profile.patched(value, {"entities": {"order": {"aliases": ["new"]}}, "session_keys": ["k"]})
    assert merged["entities"]["order"]["aliases"][-1] == "new" and merged["session_keys"] == ["k"]
    assert rules.query_terms("find 订单 now", value) == sorted({"find", "订单", "now", "order", "[x]", "true"})


def test_lint_and_cleanup(spark):
    manual = {"session_keys": ["handleIncomingRequest", "sessionId"], "events": {"x": {"patterns": []}, "y": {"patterns": ["start"]}}, "expected_sequences": {"s": ["y", "z"]}}
    problems = quality.lint(spark, manual, log_frame(spark, LOG))
    assert {(r.type, r.subject) for r in problems.collect()} == {("suspicious_session_key", "handleIncomingRequest"), ("empty_event", "x"), ("undefined_sequence_event", "s"), ("unmatched_event", "x"), ("unused_session_key", "handleIncomingRequest")}
    patch = quality.cleanup_patch(problems)
    assert patch["remove_events"] == ["x"] and quality.cleaned(manual, patch)["session_keys"] == ["sessionId"]


def test_command_line(spark, project, tmp_path, capsys):
    log = tmp_path / "run.log"
    log.write_text("\n".join([*LOG, "ERROR [orders] Could not store order 42"]) + "\n")
    assert cli.main(["init", str(project)]) == 0
    at = str(profile.index_path(project))
    capsys.readouterr()
    assert cli.main(["query", at, "--log", "ERROR [orders] Could not store order 42"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["function"] == "store_order"
    assert cli.main(["profile", "init", str(project)]) == 0 and cli.main(["profile", "init", str(project)]) == 1
    assert cli.main(["profile", "lint", str(project), "--log-file", str(log), "--strict"]) == 1
    assert cli.main(["audit", at]) == 0 and cli.main(["doctor", str(project)]) == 0
    assert cli.main(["render", at, "--log", "ERROR [orders] Could not store order 42", "--out", str(tmp_path / "g.dot")]) == 0 and "store_order" in (tmp_path / "g.dot").read_text()


def test_streaming(spark, tmp_path):
    from tracelens.streaming import events as streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LOG))
    counts = streaming.windowed_counts(streaming.stream_events(streaming.stream_lines(spark, str(tmp_path / "in"))))
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.type, r.n) for r in spark.table("counted").groupBy("type").agg(F.sum("n").alias("n")).collect()} == {("timeout", 1), ("retry", 2)}


def test_entry_without_training_data_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    gone = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(root, tmp_path / "repo", ignore=gone)
    (tmp_path / "repo" / "tracelens" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'candidate_topk' in q; assert not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_log_files_are_numbered_over_blocks(spark, tmp_path):
    for name, n in (("a.log", 3000), ("b.log", 7)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\r\n" if i % 3 else "\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    assert got == {name: {i: f"{name} line {i}" if i % 3 else "" for i in range(1, n + 1)} for name, n in (("a.log", 3000), ("b.log", 7))}


@pytest.mark.parametrize("stretch", [100_000, 4])
def test_running_sums_over_stretches(spark, stretch, monkeypatch):
    from tracelens.functions import frames

    monkeypatch.setattr(frames, "STRETCH", stretch)
    rng = random.Random(8)
    rows = [(f, i, rng.randrange(-3, 4), rng.choice([None, i])) for f in "ab" for i in range(1, 40)]
    df = spark.createDataFrame(rows, "file string, line_no int, n int, v int")
    out = frames.carried(frames.numbered_by(df, "total", "n"), "last", "v").collect()
    for r in out:
        before = [x for x in rows if x[0] == r.file and x[1] <= r.line_no]
        assert r.total == sum(x[2] for x in before) and r["last"] == next((x[3] for x in reversed(before) if x[3] is not None), None)
    assert len(out) == len(rows)


def test_ranks_over_groups(spark):
    from tracelens.functions import frames

    rng = random.Random(9)
    rows = [(f"s{i}", rng.randrange(3)) for i in rng.sample(range(1000), 200)]
    got = {r.k: r["rank"] for r in frames.ranked(spark.createDataFrame(rows, "k string, n int"), "rank", "n", "k", prefix=2).collect()}
    assert got == {k: i for i, (k, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}


def test_events_without_sessions(spark):
    rows = [("f", i, t, t, "", s, "k" if s else "") for i, (t, s) in enumerate([("retry", ""), ("timeout", ""), ("retry", "")])]
    schema = "file string, line int, type string, label string, message string, session_id string, session_key string"
    alone = events.timelines(spark.createDataFrame(rows, schema)).collect()
    assert [(r.session_id, r.labels, r.event_types) for r in alone] == [("__global__", ["retry", "timeout", "retry"], {"retry": 2, "timeout": 1})]
    rows.append(("f", 9, "state", "state", "", "s1", "sid"))
    assert [r.session_id for r in events.timelines(spark.createDataFrame(rows, schema)).collect()] == ["s1"]


def test_best_detail(spark):
    df = spark.createDataFrame([("a\n│ last said │\n└────┘\n",), ("one",), ("┌──┐\n└──┘",), ("",)], "raw string")
    assert [r[0] for r in df.select(rules.best_detail(F.col("raw"))).collect()] == ["last said │", "one", "", ""]


def test_application_names(spark, tmp_path):
    (tmp_path / "app" / "src" / "main").mkdir(parents=True)
    (tmp_path / "lib").mkdir()
    (tmp_path / "app" / "build.gradle").write_text("android {\n namespace 'com.a.app'\n defaultConfig { applicationId = \"com.a.id\" }\n}")
    (tmp_path / "lib" / "build.gradle.kts").write_text('namespace = "com.a.lib"\nnamespace = "com.a.app"')
    (tmp_path / "app" / "src" / "main" / "AndroidManifest.xml").write_text('<manifest package="com.a.manifest"/>')
    assert files.app_identifiers(spark, str(tmp_path)) == ["com.a.app", "com.a.id", "com.a.lib", "com.a.manifest"]
    assert files.app_identifiers(spark, str(tmp_path / "lib")) == []


def test_lint_under_a_query(spark):
    lines = spark.createDataFrame([("f", 1, "Order paid"), ("f", 2, "other"), ("f", 3, "paid again")], "file string, line_no int, line string")
    count = lambda q: quality.lines_for(lines, q).count()
    assert (count("PAID x"), count(""), count("nothing like it"), quality.lines_for(lines.limit(0), "paid").count()) == (2, 3, 3, 0)


def test_reports():
    problems = [{"severity": "warning", "type": "generic_alias", "subject": "Order", "item": "data", "action": "narrow_alias"}]
    assert "`x`" in render.lint({"problems": problems, "fixes": quality.fixes(problems), "cleanup_patch": {"remove_events": ["x"], "review_events": []}})
    assert quality.fixes(problems * 2) == [{"action": "narrow_alias", "target": "data", "reason": quality.REASONS["generic_alias"]}]
    assert quality.recommendations(["p"]) == quality.ADVICE and quality.recommendations([]) == quality.KEEP_UP
    report = render.cleanup({"applied": False, "before": {"session_keys": ["a", "b"], "events": {"e": {}}}, "after": {"session_keys": ["b"], "events": {}}, "patch": {"review_sequences": ["flow"]}})
    assert "- `a`" in report and "- `e`" in report and "- `b`" not in report and "`flow`" in report
    state = {"project": "p", "index": True, "index_stale": True, "manual_profile": False, "profile_health": {"events": 2}, "recommendations": ["Build it."]}
    assert "- events: 2" in render.doctor(state) and "- Build it." in render.doctor(state)
    result = {"doctor": state, "lint": problems, "cleanup_patch": {"remove_events": ["x"]}, "analysis": {"trace": [{"kind": "source", "subject": "a.py:1:f", "detail": ""}], "diagnosis": {"summary": "Sum", "findings": ["1 error"]}}}
    result["recommendations"] = analyze.recommended(result)
    assert len(result["recommendations"]) == 4 and "1. Build the index again" in render.diagnosis(result)
