import json

from cairnframe.__main__ import answer, main, parser


def test_scan_and_questions(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    for name, text in (("a/x", "1"), ("a/y", "1"), ("b/z", "2"), ("b/Thumbs.db", "t")):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    ask = lambda *args: answer(spark, parser().parse_args(["--store", store, *args]))
    found = ask("scan", str(tmp_path / "tree"), "--exclude", "Thumbs.db")
    assert found["files"] == 3 and found["states"] == {"ok": 3}
    (root,) = ask("roots")
    at = (root["machine_id"], root["root"])
    assert ask("dirs", *at) == ["a", "b"]
    assert [r["rel_path"] for r in ask("duplicates", *at, "--prefix", "a")] == ["x", "y"]
    assert ask("summary", *at)["files"] == 3 and ask("interrupted") == []
    both = ask("compare", *at, *at, "--left-prefix", "a", "--right-prefix", "b")
    assert both["identical_count"] == 0 and [r["rel_path"] for r in both["right_only"]] == ["z"]
    assert main(["--store", store, "summary", "nobody", "/x"]) == 1 and "nobody" in capsys.readouterr().err
    assert main(["--store", store, "roots"]) == 0 and json.loads(capsys.readouterr().out)[0]["root"] == root["root"]
