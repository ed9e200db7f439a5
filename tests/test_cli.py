"""Command line: list the catalog, refuse an unknown question."""

from pitchside.__main__ import main


def test_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 8 and out[6].startswith("7\t")


def test_unknown_question(spark, star001, tmp_path, capsys):
    from pitchside.plans.ingest_star import write_star
    write_star(star001, str(tmp_path / "star"))
    assert main(["ask", "99", str(tmp_path / "star")]) == 2
    assert main(["ask", "4", str(tmp_path / "star"), "--rows", "3"]) == 0
    out = capsys.readouterr().out
    assert "matches_with_pressure" in out and "first 3 shown" in out
