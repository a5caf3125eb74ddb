"""The tracked files of repositories made here, against Git's own lists."""

import os
import random
import subprocess

import pytest

from codelode.sources import git_tree
from codelode.sources.files import decoded, source_files


def git(at, *args):
    env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    return subprocess.run(["git", "-C", str(at), "-c", "user.name=a", "-c", "user.email=a@b", "-c", "core.quotePath=false", *args], check=True, capture_output=True, env=env).stdout.decode()


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "repo"
    at.mkdir()
    git(at, "init", "-q", "-b", "main")
    r = random.Random(1)
    lines = [f"line {r.random()}" for _ in range(2000)]
    for i in range(12):  # files that differ little, so that packs hold deltas
        lines[r.randrange(2000)] = f"changed {i}"
        (at / f"src{i % 3}").mkdir(exist_ok=True)
        (at / f"src{i % 3}" / f"f{i}.txt").write_text("\n".join(lines))
        git(at, "add", "-A")
        git(at, "commit", "-q", "-m", f"c{i}")
    (at / "é ü").mkdir()
    (at / "é ü" / "日本.py").write_text("x = 1\n")
    (at / "empty").write_text("")
    (at / "big.bin").write_bytes(bytes(2 << 20))
    os.symlink("empty", at / "link")
    (at / ".gitignore").write_text("ignored\n")
    git(at, "add", "-A")
    git(at, "commit", "-q", "-m", "last")
    (at / "ignored").write_text("no")
    (at / "untracked").write_text("no")
    return at


def listed(at, *args):
    rows = [line.split(None, 3) if "\t" not in line else [*line.split("\t")[0].split(), line.split("\t")[1]] for line in git(at, *args).splitlines()]
    return {r[-1]: r for r in rows}


def read(spark, at, **options):
    git_tree.register(spark)
    return spark.read.format("git_tree").options(path=str(at), **options).load()


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("version", [2, 4])
def test_tracked_files(spark, repo, packed, version):
    if packed:
        git(repo, "gc", "-q")
    git(repo, "update-index", "--index-version", str(version))
    df = read(spark, repo, filesPerPartition=4)
    rows = {r["file_path"]: r for r in df.collect()}
    want = listed(repo, "ls-files", "-s")
    assert {p: (oct(r["mode"])[2:], r["blob"]) for p, r in rows.items()} == {p: (w[0], w[1]) for p, w in want.items()}
    assert df.rdd.getNumPartitions() == -(-len(want) // 4) and "untracked" not in rows and "ignored" not in rows
    for p, r in rows.items():
        if p == "big.bin":
            assert r["size"] == 2 << 20 and r["content"] is None
        else:
            assert bytes(r["content"]) == (b"empty" if p == "link" else (repo / p).read_bytes()) and r["size"] == len(r["content"])
    assert "é ü/日本.py" in [r["file_path"] for r in decoded(source_files(df).where("content IS NOT NULL")).collect()]


def test_a_commit_instead_of_the_index(spark, repo):
    git(repo, "tag", "-a", "-m", "t", "v1")
    git(repo, "rm", "-q", "-r", "src0")
    git(repo, "repack", "-adq", "--depth=50", "--window=50")
    git(repo, "pack-refs", "--all")
    head = git(repo, "rev-parse", "HEAD").strip()
    first = git(repo, "rev-list", "--max-parents=0", "HEAD").strip()
    for ref in ("main", "v1", "HEAD", head, first):
        tree = {line.split("\t")[1]: line.split()[2] for line in git(repo, "ls-tree", "-r", ref).splitlines()}
        assert {r["file_path"]: r["blob"] for r in read(spark, repo, ref=ref).collect()} == tree
    assert not any(r["file_path"].startswith("src0") for r in read(spark, repo, content="false").collect())
    with pytest.raises(Exception, match="no commit"):
        read(spark, repo, ref="nothing").collect()


def test_worktrees_clones_submodules_and_none(spark, repo, tmp_path):
    git(repo, "worktree", "add", "-q", str(tmp_path / "tree"), "-b", "other")
    git(tmp_path, "clone", "-q", "--shared", str(repo), str(tmp_path / "clone"))
    names = set(listed(repo, "ls-files", "-s"))
    for at in ("tree", "clone"):
        df = read(spark, tmp_path / at)
        assert {r["file_path"] for r in df.collect()} == names and df.where("content IS NULL").count() == 1
    git(repo, "update-index", "--add", "--cacheinfo", "160000," + git(repo, "rev-parse", "HEAD").strip() + ",module")
    assert [(r["size"], r["content"]) for r in read(spark, repo).where("file_path = 'module'").collect()] == [(None, None)]
    git(tmp_path, "init", "-q", "fresh")
    assert read(spark, tmp_path / "fresh").count() == 0
    with pytest.raises(Exception, match="no Git repository"):
        read(spark, tmp_path / "nothing").collect()
