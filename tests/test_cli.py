"""Generated logs through the command line."""

import json
import os

from tallylog.__main__ import main
from tallylog.sources import formats, parse, synth


def test_generated_lines(spark):
    for form, profile in (("combined", "combined"), ("common", "common"), ("w3c", "w3c")):
        made = synth.generate(spark, 3000, form)
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, synth.generate(spark, 3000, form).repartition(3).collect()))
        kinds = {(r.kind, r.code): r["count"] for r in parse.parse(made.selectExpr("1L as source_id", "line_number", "value"), formats.preset(profile)).groupBy("kind", "code").count().collect()}
        if form == "w3c":
            rows = parse.records(parse.parse(made.selectExpr("1L as source_id", "line_number", "value"), formats.preset("w3c")))
            assert rows.where("line_number <= 1504 and bytes_sent is null or line_number > 1504 and bytes_sent is not null").count() == 0 and rows.where("status is null").count() == 0
        bad = sum(n for (k, _), n in kinds.items() if k == "error")
        assert sum(kinds.values()) == 3000 + 5 * (form == "w3c") and 0 < bad < 60 and kinds["record", None] > 2900


def test_commands(spark, tmp_path, capsys):
    out, store = str(tmp_path / "raw"), str(tmp_path / "case")
    main(["gen", out, "--lines", "500"])
    log = str(tmp_path / "a.log")
    with open(log, "wb") as f:
        for part in sorted(os.listdir(out)):
            if part.startswith("part-"):
                f.write(open(f"{out}/{part}", "rb").read())
    capsys.readouterr()
    main(["import", store, "combined", log])
    job = json.loads(capsys.readouterr().out)
    assert job["status"].startswith("completed") and job["committed_records"] + job["committed_errors"] + job["committed_skipped"] == 500
    main(["query", store, "--status", "404", "--rows", "5"])
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 5 and {r["status"] for r in rows} == {404}
    main(["stats", store, "--top", "3"])
    found = {}
    for x in capsys.readouterr().out.splitlines():
        found |= json.loads(x)
    assert found["totals"][0]["total"] == job["committed_records"] and len(found["top_targets"]) == 3
    main(["export", store, str(tmp_path / "csv"), "--max-rows", "10"])
    assert json.loads(capsys.readouterr().out)["truncated"] is True
    main(["detail", store, "1", str(rows[0]["line_number"])])
    assert " 404 " in json.loads(capsys.readouterr().out)["text"]
    main(["verify", store, "1"])
    assert json.loads(capsys.readouterr().out) == {"unchanged": True}
