import subprocess

import pytest

from gistmill.operators import build
from gistmill.sources import files
from gistmill.sources.git import Repository
from gistmill.state import BoundedCache, Memory, OriginStore


def _git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=Ann", "-c", "user.email=a@example.org", *args], check=True, capture_output=True)


def test_git_readers(spark, tmp_path):
    _git(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("x\n")
    _git(tmp_path, "add", ".")
    _git(tmp_path, "commit", "-qm", "first")
    (tmp_path / "a.txt").write_text("one\n2\nthree\n")
    (tmp_path / "c.txt").write_text("new\n")
    _git(tmp_path, "rm", "-q", "b.txt")
    repo = Repository(spark, str(tmp_path))
    assert sorted(map(tuple, repo.diff().collect())) == [("a.txt", 2, 1, "modified"), ("b.txt", 0, 1, "deleted")]
    assert [(r["author"], r["message"]) for r in repo.log().collect()] == [("Ann", "first")]
    assert sorted(map(tuple, repo.status().collect())) == [("modified", "a.txt"), ("staged", "b.txt"), ("untracked", "c.txt")]
    assert [tuple(r) for r in repo.branches().collect()] == [("main", True)]
    _git(tmp_path, "commit", "-qam", "second")
    blamed = sorted((r["line"], r["author"], r["content"]) for r in repo.blame("a.txt").collect())
    assert blamed == [(1, "Ann", "one"), (2, "Ann", "2"), (3, "Ann", "three")]
    assert [r["content"] for r in repo.blame("a.txt", 2).collect()] == ["2"]
    kinds = {r["kind"] for r in build.diff_parse(repo.raw_diff("HEAD~1")).collect()}
    assert {"file", "hunk", "add", "del"} <= kinds
    for bad in ("--output=x", "a b", ""):
        with pytest.raises(ValueError):
            repo.diff(bad)
    with pytest.raises(ValueError):
        repo.blame("../x")


def test_files_exist_and_load_once(spark, tmp_path):
    for name in ("a.ts", "b.js", "c.md"):
        (tmp_path / name).write_text(name)
    assert files.exists(spark, f"{tmp_path}/a.ts") and not files.exists(spark, f"{tmp_path}/z.ts")
    loaded = files.load(spark, [f"{tmp_path}/*.{{ts,js}}", f"{tmp_path}/a.*", f"{tmp_path}/none*"])
    assert sorted(r["content"] for r in loaded.collect()) == ["a.ts", "b.js"]
    assert files.load(spark, [f"{tmp_path}/none*"]).count() == 0


def test_cache_bounds_age_and_version():
    now = [0.0]
    cache = BoundedCache(entries=2, size=10, seconds=5, clock=lambda: now[0])
    assert cache.put("a", 1, 4, "v1") and cache.put("b", 2, 4)
    assert cache.get("a", "v1") == 1
    assert cache.put("c", 3, 4) and cache.get("b") is None and cache.get("a", "v1") == 1
    assert cache.get("a", "v2") is None and cache.bytes == 4
    assert not cache.put("d", 4, 11)
    now[0] = 6
    assert cache.get("c") is None and len(cache) == 0


def test_origins_and_memory():
    store = OriginStore(entries=1)
    first = store.keep("text")
    assert first.startswith("d") and len(first) == 11 and store.restore(first) == "text"
    store.keep("other")
    assert store.restore(first) is None
    memory = Memory()
    memory.set("c", goal="x")
    assert memory.get("c") == {"goal": "x"}
    memory.clear("c")
    assert memory.get("c") == {}
