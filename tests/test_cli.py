from tracewright import cli


def test_convert_and_compare(spark, tmp_path):
    one, two = tmp_path / "a.json", tmp_path / "b.json"
    one.write_text('{"prefix": {"ex": "http://e/"}, "entity": {"ex:a": {"ex:n": 1}}}')
    two.write_text('{"prefix": {"ex": "http://e/"}, "entity": {"ex:a": {"ex:n": 2}}}')
    assert cli.main(["convert", str(one), str(tmp_path / "out"), "--from", "json", "--to", "provn"]) == 0
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "entity(ex:a, [ex:n=1])" in text and "prefix ex <http://e/>" in text
    assert cli.main(["compare", str(one), str(one), "--from", "json"]) == 0
    assert cli.main(["compare", str(one), str(two), "--from", "json"]) == 1
    assert cli.main(["compare", str(one), str(tmp_path / "none"), "--from", "json"]) == 2
