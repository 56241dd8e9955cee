"""Translators that are programs: one start a task, numbers, crashes, silence, warm-up."""

import sys

import pytest

from inkstrata.functions.programs import Program, ProgramError
from inkstrata.operators import translation

SERVER = r'''
import json, os, sys, time
open(os.path.join(sys.argv[1], str(os.getpid())), "w").close()
warm = set()
for line in sys.stdin:
    q = json.loads(line)
    pair = (q["from"], q["to"])
    if q["command"] == "warmup":
        open(os.path.join(sys.argv[1], f"warm-{os.getpid()}-{q['from']}"), "a").write("x")
        warm.add(pair)
    print("a line that is no answer", flush=True)
    print(json.dumps({"id": q["id"] - 1, "translations": ["late"]}), flush=True)
    if "die" in q["texts"]:
        sys.exit(3)
    if "sleep" in q["texts"]:
        time.sleep(30)
    if "refuse" in q["texts"]:
        print(json.dumps({"id": q["id"], "error": "no such pair"}), flush=True)
        continue
    print(json.dumps({"id": q["id"], "translations": [f"{t.upper()}{'' if pair in warm else ' cold'}" for t in q["texts"] if t != "skip"]}), flush=True)
'''


@pytest.fixture
def server(tmp_path):
    return [sys.executable, "-c", SERVER, str(tmp_path)]


def starts(folder):
    return [f.name for f in folder.iterdir() if f.name.isdigit()]


def test_one_program_answers_by_number(server, tmp_path):
    program = Program(server)
    program.warm("en", "ru")
    assert program(["a", " ", "b", None], "en", "ru") == ["A", "", "B", ""] and program(["c", "skip"], "en", "ru") == ["C", ""]
    assert program(["", " "], "en", "ru") == ["", ""] and len(starts(tmp_path)) == 1
    with pytest.raises(ProgramError, match="no such pair"):
        program(["refuse"], "en", "ru")
    assert program(["d"], "en", "ru") == ["D"] and len(starts(tmp_path)) == 1
    program.close()


def test_a_program_that_ends_or_is_silent_is_started_again(server, tmp_path):
    program = Program(server, timeout=2)
    assert program(["a"], "en", "ru") == ["A cold"]
    with pytest.raises(ProgramError, match="ended"):
        program(["die"], "en", "ru")
    assert len(starts(tmp_path)) == 2
    with pytest.raises(ProgramError, match="in time"):
        program(["sleep"], "en", "ru")
    assert program(["b"], "en", "ru") == ["B cold"]
    program.close()
    with pytest.raises(ProgramError):
        Program(["/no/such/program"])(["a"], "en", "ru")


def test_one_start_a_task_and_one_warm_up_a_pair(spark, server, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = spark.createDataFrame([(s, "ru", f"{s}{i}") for i in range(40) for s in ("en", "de")], "src string, tgt string, text string").repartition(3)
        found = {r["text"]: (r["translated"], r["note"]) for r in translation.call(rows, Program(server)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {f"{s}{i}": (f"{s}{i}".upper(), None) for i in range(40) for s in ("en", "de")}
    assert len(starts(tmp_path)) == 3
    warmed = [f for f in tmp_path.iterdir() if f.name.startswith("warm-")]
    assert len(warmed) == 6 and all(f.read_text() == "x" for f in warmed)


def test_what_fails_is_told_and_not_cached(spark, server):
    rows = spark.createDataFrame([(1, "one", "en", "ru"), (2, "die", "de", "ru"), (3, "one", "en", "ru")], "id long, text string, src string, tgt string").coalesce(1)
    empty = spark.createDataFrame([], "src string, tgt string, text string, translated string")
    out, cache = translation.translate(rows, empty, Program(server))
    assert {r["id"]: r["translated"] for r in out.collect()} == {1: "ONE", 2: "", 3: "ONE"}
    assert [tuple(r) for r in cache.collect()] == [("en", "ru", "one", "ONE")]
    noted = translation.call(rows, Program(server)).where("note IS NOT NULL").collect()
    assert [(r["text"], "ended" in r["note"]) for r in noted] == [("die", True)]


def test_translate_passes_the_warm_up_on(spark, tmp_path):
    def warm(source, target):
        (tmp_path / f"{source}-{target}").touch()

    rows = spark.createDataFrame([(1, "one more", "en", "ru")], "id long, text string, src string, tgt string")
    empty = spark.createDataFrame([], "src string, tgt string, text string, translated string")
    assert [r["translated"] for r in translation.translate(rows, empty, warm=warm)[0].collect()] == ["[fallback] one more"]
    assert [f.name for f in tmp_path.iterdir()] == ["en-ru"]
