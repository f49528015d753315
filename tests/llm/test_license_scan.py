import pyarrow as pa

from catchwater.llm import license_scan
from tests.llm import cases


def test_bands_bound_a_miss():
    for similarity in (0.2, 0.5, 0.9):
        n = license_scan.bands(similarity, 1e-4)
        assert (1 - similarity) ** n <= 1e-4 < (1 - similarity) ** (n - 1)


def test_planted_notices(spark):
    """Every template, whole or with a word changed, anywhere in other text, in any case; none in clean text."""
    rows, want = [], set()
    for k, (name, notice) in enumerate(sorted(license_scan.TEMPLATES.items())):
        for v, text in enumerate((notice, notice.upper(), notice.replace(" ", "\n  "), notice if len(notice) < 90 else notice.replace("following", "ensuing", 1))):
            rows.append((k * 10 + v, cases.text(k, 7 * v) + " " + text + " " + cases.text(k + 50, 40)))
            want.add((k * 10 + v, name))
    rows += [(900 + k, cases.text(k, 200)) for k in range(20)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license"]) for r in found}
    short = {(i, n) for i, n in got if (i, n) not in want}
    assert want <= got and {n for _, n in short} <= {"apache-2.0-notice"}  # a header begins with the notice
    spans = {(r["doc_id"], r["license"]): r for r in found}
    for i, name in want:
        assert spans[i, name]["first_word"] >= 7 * (i % 10) - 1 and spans[i, name]["containment"] >= 0.8


def test_edges(spark):
    assert license_scan.scan(cases.frame(spark)).count() == 0
    assert license_scan.scan(cases.frame(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, license_scan.TEMPLATES["mit-notice"])] * 2 + [(None, license_scan.TEMPLATES["mit-notice"])], "doc_id long, text string")
    assert license_scan.scan(twice).where("license = 'mit-notice'").count() == 3


def test_matches_equal_brute_force():
    """Against a scan that counts every template's shingles around every word."""
    kinds = license_scan.Templates(license_scan.TEMPLATES, 1e-4)
    texts = [cases.text(k, 60) + " " + " ".join(license_scan.TEMPLATES["gpl-3.0-notice"].split()[: 4 + k]) + " " + cases.text(9, 30) for k in range(9)]
    got = {(d, kinds.names[t]) for d, t, *_ in kinds.matches(pa.array(texts, pa.large_string()), 0.8)}
    want = set()
    for d, text in enumerate(texts):
        grams, _ = license_scan._shingles(pa.array([text], pa.large_string()))
        share = {name: (len(set(grams.tolist()) & set(own.tolist())) / len(own), len(own)) for name, own in zip(kinds.names, kinds.sets, strict=True)}
        for name, (x, n) in share.items():
            if x >= 0.8 and not any(y > x and min(m, n) >= 0.5 * max(m, n) for y, m in share.values()):
                want.add((d, name))
    assert got == want and want


def test_pieces_far_apart_are_no_match_and_each_occurrence_counts(spark):
    header = license_scan.TEMPLATES["apache-2.0-header"].split()
    apart = " ".join(" ".join(header[k : k + 12]) + " " + cases.text(k, 60) for k in range(0, len(header), 12))
    mit, gpl = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["gpl-2.0-header"]
    many = " ".join(mit + " " + cases.text(k, 25) for k in range(4)) + " " + gpl
    schema = "doc_id long, text string, license string, first_word string, n_words string, containment string"
    docs = spark.createDataFrame([(1, apart, *"wxyz"), (2, many, *"wxyz"), (3, cases.text(5, 20_000) + " " + mit, *"wxyz"), (4, None, *"wxyz"), (5, "", *"wxyz")], schema)
    found = license_scan.scan(docs).collect()
    assert all(r["doc_id"] != 1 or r["license"] == "apache-2.0-notice" for r in found)
    two = sorted((r["first_word"], r["license"], r["n_words"]) for r in found if r["doc_id"] == 2)
    words = len(license_scan._shingles(pa.array([mit]))[0]) + 1
    assert [x[1] for x in two] == ["mit"] * 4 + ["gpl-2.0-header"] and all(n == words for _, name, n in two if name == "mit")
    assert [(r["license"], r["first_word"]) for r in found if r["doc_id"] == 3] == [("mit", 20_000)]


def test_versions_are_told_apart(spark):
    docs = spark.createDataFrame([(2, license_scan.TEMPLATES["gpl-2.0-notice"]), (3, license_scan.TEMPLATES["gpl-3.0-header"])], "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()} == {(2, "gpl-2.0-notice"), (3, "gpl-3.0-header")}
