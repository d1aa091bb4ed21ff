import pytest

from corvine.__main__ import main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# Notes\nalpha beta")
    (tmp_path / "b.md").write_text("gamma delta")
    at = ["-p", str(tmp_path)]
    run = lambda *args: (main([*at, *args], spark), capsys.readouterr().out)[1]
    assert str(tmp_path) in run("init") and "added=2" in run("sync")
    assert "2 vectors" in run("embed")
    assert "[1] a.md (1)" in run("search", "alpha", "-m", "fts") and "[1] b.md" in run("search", "gamma", "delta", "-m", "semantic")
    assert "[1] a.md" in run("search", "alpha") and "nothing found" in run("search", "zeta", "-m", "fts")
    listed = run("files", "--limit", "1", "--offset", "1")
    assert listed.startswith("b.md\t1 chunks") and "Showing 2-2 of 2" in listed
    assert '"total_files": 2' in run("stats") and str(tmp_path) in run("stats", "root")
    assert main(["version"]) == 0


@pytest.mark.parametrize("args", [["sync", "--all", "-c", "x"], ["search", "a", "-m", "other"], ["search"], []])
def test_wrong_arguments(args):
    with pytest.raises(SystemExit):
        main(args)
