import re
import subprocess
from datetime import datetime, timedelta

from codelode.operators import diffs
from codelode.plans.graph_queries import LOOKS
from codelode.sources.projects import git_diff
from codelode.streaming.ingest import event_stream, latest_events, run_to_end

DAY = datetime(2025, 6, 1)


def event(i, days, kind="change", path="/a"):
    return (i, i, path, kind, DAY + timedelta(days=days), DAY + timedelta(days=60))


def test_late_events_of_a_later_batch_are_kept_and_repeats_dropped(spark, tmp_path):
    from codelode.streaming.ingest import EVENT

    folder, place = tmp_path / "events", str(tmp_path / "place")
    write = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder))
    write([event(1, 50), event(2, 55), event(2, 55)])
    stream = lambda: event_stream(spark, str(folder))
    assert sorted(r["event_id"] for r in run_to_end(stream(), "t", "event_id", place).collect()) == [1, 2]
    write([event(1, 50), event(3, 10, "unlink", "/b"), event(4, 56, "unlink")])
    got = run_to_end(stream(), "t", "event_id", place)
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 4]
    assert {r["path"]: r["change_kind"] for r in latest_events(got).collect()} == {"/a": "unlink", "/b": "unlink"}


def test_a_diff_of_eleven_megabytes_is_read_whole(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    names = ["a.txt", "b c.txt", "z.txt"]
    for n in names:
        (tmp_path / n).write_text("one\n")
    git("add", ".")
    git("commit", "-qm", "first")
    assert git_diff(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.txt").write_text("one\n" + "diff --git is only text here\n")
    (tmp_path / "b c.txt").write_text("one\n" + "".join(f"line {i} of a long file that has a great many lines\n" for i in range(220_000)))
    (tmp_path / "z.txt").unlink()
    found = {r["new_file"]: r for r in diffs.diff_files(diffs.diff_lines(git_diff(spark, str(tmp_path)))).collect()}
    assert set(found) == {"a.txt", "b c.txt", "/dev/null"} and found["/dev/null"]["status"] == "deleted"
    assert len(found["b c.txt"]["added"]) == 220_000 and found["a.txt"]["added"] == [2]


def test_looks_take_every_common_form():
    forms = {
        "go": ["func (r *T) Read() int {", "func Read() {", "package core", "type T struct {"], "rust": ["pub fn run() {", "    pub(crate) async fn go() {", "impl T for X {", "trait T {"],
        "python": ["class A:", "class A(B):", "    async def f(x):", "def f(x):"], "typescript": ["function f() {", "export default function f() {", "export class A extends B {", "interface A {", "const x = 1", "async function f() {"],
    }
    for lang, _, look in LOOKS:
        assert all(re.search(look, f"Some words.\n{x}\n") for x in forms[lang]), lang
        assert not re.search(look, "We import nothing from this type of class, and the function ends.\n")
