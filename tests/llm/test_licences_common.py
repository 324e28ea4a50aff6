from tallylog.llm import licenses


def test_notices_in_a_corpus_where_a_third_mentions_licences(spark):
    talk = ["License: MIT", "## License", "this repo has a license file", "the code is licensed and released by us", "see the MIT page", "under the hood it is fast"]
    rows = [(k, f"{talk[k // 3 % 6]}\n{talk[(k // 3 + 1) % 6]} {k}" if k % 3 == 0 else f"an ordinary line about thing {k}\nand more of it") for k in range(600)]
    want = {}
    for n, (family, text) in enumerate(licenses.TEMPLATES):
        rows.append((10_000 + n, f"# Title\n\nsome words\n{text}\n"))
        want[10_000 + n] = family
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k].family for k in want} == want
    assert all(got[k].family is None for k in range(600))
