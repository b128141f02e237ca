import random

import pytest
from pyspark.sql import functions as F

from hazeloom.llm import license_scan, quality_model, url_rules
from hazeloom.llm.queries import URL_RULES


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://x.com/en/", "x.com", "/en/", "com/en/", "block"),
        ("https://com/en/1", "com", "/en/1", "com/en/", "block"),
        ("https://xcom/en/1", "xcom", "/en/1", None, "allow"),
        ("https://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("https://b.net/DE/", "b.net", "/DE/", None, "allow"),
        ("s://h?x://y/z", "h", "", None, "allow"),
        ("no-scheme.com/en/", "", "", None, "allow"),
        ("a\nb://o.org/es/#x", "o.org", "/es/", "org/es/", "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_given_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id bigint, url string")
    labels = spark.createDataFrame([], "page_id bigint, bad boolean")
    (r,) = url_rules.judge(pages, labels, URL_RULES).collect()
    assert tuple(r.judged) == (host, path, rule, verdict)


def test_rules_of_the_contract(spark):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"""
    cases = {
        "https://a.com/en/1": ("com/en/", "block"),
        "https://www.example.com/en/71": ("example.com/en/7", "allow"),
        "https://net/de/": ("net/de/", "allow"),
        "https://example.net/de/7": ("net/de/", "allow"),
        "https://www.example.net/de/8": ("example.net/de/8", "block"),
        "https://a.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    got = url_rules.judge(pages, spark.createDataFrame([], "page_id bigint, bad boolean"), URL_RULES).collect()
    assert {r.url: (r.judged.rule, r.judged.verdict) for r in got} == cases


def test_mined_rules_block(spark):
    rng = random.Random(3)
    hosts = ["spam.shop", "fine.shop", "news.info"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['win', 'read'])}/{i}?id=1") for i in range(600)]
    bad = lambda u: "spam" in u and "win" in u
    labels = [(i, bad(u) != (rng.random() < 0.05)) for i, u in rows if i % 2]
    pages = spark.createDataFrame([*rows, (None, rows[0][1]), (9999, None)], "page_id bigint, url string").withColumn("items", F.lit(0))
    got = url_rules.judge(pages, spark.createDataFrame([*labels, (1, None), (None, True)], "page_id bigint, bad boolean"), ())
    assert got.columns == ["page_id", "url", "items", "judged"]
    for r in got.collect():
        assert r.judged.verdict == ("block" if r.url and bad(r.url) else "allow")
    empty = pages.where("false")
    assert url_rules.judge(empty, spark.createDataFrame([], "page_id bigint, bad boolean"), URL_RULES).count() == 0


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels, "doc_id", "text", "quality")
    scored = docs.join(labels.select("doc_id", "quality"), "doc_id").where(quality_model.fold(F.col("doc_id")) == 0)
    rows = scored.select("quality", quality_model.score(F.col("text"), model).alias("score")).collect()
    good, low = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in low)
    assert wins >= 0.95 * len(good) * len(low)
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    again = quality_model.fit(docs.repartition(5), labels, "doc_id", "text", "quality")
    assert again.vocabulary == model.vocabulary and (again.vectors == model.vectors).all() and again.temperature == model.temperature


def test_classifier_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2 if i < 8 else None) for i in range(12)], "doc_id bigint, quality int")
    model = quality_model.fit(odd_docs, labels, "doc_id", "text", "quality")
    rows = odd_docs.select(quality_model.score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.s <= 1 for r in rows)
    assert quality_model.fit(no_docs, labels, "doc_id", "text", "quality") is None
    assert quality_model.fit(odd_docs, labels.where("false"), "doc_id", "text", "quality") is None
    assert odd_docs.select(quality_model.score(F.col("text"), None).alias("s")).first().s == 0.5


def test_fold_is_crc32(spark):
    import zlib

    ids = list(range(50))
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select(quality_model.fold(F.col("i")).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in ids]


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_licenses_with_edits(spark):
    rng = random.Random(8)
    rows, planted = [], {}
    names = list(license_scan.TEMPLATES)
    for i in range(60):
        before, after = (" ".join(rng.choice(["lorem", "ipsum", "the", "of"]) for _ in range(rng.randint(0, 30))) for _ in "ab")
        name = rng.choice(names)
        words = license_scan.TEMPLATES[name].split()
        if len(words) > 20:
            decides = {w for p in license_scan.DECIDING[name] for w, _, _ in license_scan.split_words(p)}
            plain = [j for j, w in enumerate(words) if not decides & {x for x, _, _ in license_scan.split_words(w)}]
            for _ in range(3):
                words[rng.choice(plain)] = "changed"
            del words[rng.choice(plain[:-1])]
        if i % 2:
            planted[i] = (name, " ".join(words))
        rows.append((i, f"{before} {' '.join(words) if i % 2 else 'no licence here'} {after}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = license_scan.scan(df, "doc_id", "text").collect()
    texts = dict(rows)
    assert {r["key"] for r in found} == set(planted)
    for r in found:  # other templates only where the planted one contains them
        assert planted[r["key"]][0].split("-")[0] == r.template.split("-")[0]
    for i, (name, text) in planted.items():
        hits = [r for r in found if r["key"] == i and r.template == name]
        assert len(hits) == 1, (i, name)
        wanted = [w for w, _, _ in license_scan.split_words(license_scan.TEMPLATES[name])]
        own = [w for w, _, _ in license_scan.split_words(text)]
        assert longest_common(wanted, own) - 3 <= hits[0].matched_words <= longest_common(wanted, own)
        assert hits[0].coverage == pytest.approx(hits[0].matched_words / len(wanted))
        span = texts[i][hits[0].start_char : hits[0].end_char]
        assert len(span) >= 0.85 * len(text) - 12 and span in text


@pytest.mark.parametrize(
    "sentence,names",
    [
        ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0-notice"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0-notice"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl-3.0-notice"}),
        ("This work is licensed under the GNU General Public License, version 9.", set()),
        ("Licensed under the Apache License, Version 1.1.", {"apache-1.1-notice"}),
        ("licensed under the apache license version 2.0", {"apache-2.0-notice"}),
        ("Licensed under the Apache Licence, Version 2.0.", set()),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0-notice"}),
        ("Licensed under CC BY-NC-SA 4.0.", {"cc-by-nc-sa-4.0-notice"}),
        ("Licensed under CC BY 3.0.", {"cc-by-3.0-notice"}),
        ("Released under the MIT License.", {"mit-notice"}),
        ("Released under the BSD License.", set()),
        (license_scan.BSD_CLAUSES + license_scan.BSD_DISCLAIMER, {"bsd", "bsd-2-clause"}),
        (license_scan.BSD_CLAUSES + license_scan.BSD_THIRD + license_scan.BSD_DISCLAIMER, {"bsd", "bsd-3-clause"}),
        (license_scan.MIT_TEXT + license_scan.MIT_DISCLAIMER, {"mit", "mit-full"}),
    ],
)
def test_versions_and_families_are_told_apart(sentence, names):
    index = license_scan.Index(license_scan.TEMPLATES, license_scan.DECIDING)
    for text in (sentence, f"before it {sentence} and after"):
        assert {m[0] for m in license_scan.scan_text(index, index.scanner(), text, 0.7)} == names


def every_alignment(template, words):
    """Best score and matches of any local alignment, without candidates or band."""
    best, row = (0, 0), [(0, 0)] * (len(words) + 1)
    for wanted in template:
        new = [(0, 0)]
        for j, w in enumerate(words):
            score, matched = row[j]
            cell = (score + 1, matched + 1) if w == wanted else (max(score - 1, 0), matched if score > 1 else 0)
            for s, m in (row[j + 1], new[j]):
                if s - 1 > cell[0]:
                    cell = (s - 1, m)
            new.append(cell)
            best = max(best, cell)
        row = new
    return best


def test_all_templates_at_all_places(spark):
    """Every template against the whole text: what reaches the coverage and has its phrases is what is found."""
    rng = random.Random(5)
    names = [n for n in license_scan.TEMPLATES if len(license_scan.TEMPLATES[n].split()) < 40]
    rows = []
    for i in range(25):
        words = [rng.choice(["lorem", "license", "under", "version", "the", "software"]) for _ in range(20)]
        if i % 2:
            own = license_scan.TEMPLATES[rng.choice(names)].split()
            words[5:5] = own
        rows.append((i, " ".join(words)))
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect():
        got.setdefault(r["key"], set()).add(r.template)
    for i, text in rows:
        words = [w for w, _, _ in license_scan.split_words(text)]
        want = set()
        for name in license_scan.TEMPLATES:
            template = [w for w, _, _ in license_scan.split_words(license_scan.TEMPLATES[name])]
            phrases = [[w for w, _, _ in license_scan.split_words(p)] for p in license_scan.DECIDING[name]]
            if every_alignment(template, words)[1] >= 0.7 * len(template) and all(license_scan._phrase_in(p, words) for p in phrases):
                want.add(name)
        assert got.get(i, set()) == want


def test_licenses_of_odd_rows(spark, odd_docs, no_docs):
    assert license_scan.scan(odd_docs, "doc_id", "text").count() == 0
    assert license_scan.scan(no_docs, "doc_id", "text").count() == 0
    assert license_scan.scan(odd_docs, "doc_id", "text", {}).count() == 0
    twice = "Released under the MIT License. And then much later it is " + "x " * 30 + "released under THE mit license."
    df = spark.createDataFrame([(1, twice), (1, twice), (None, twice)], "doc_id bigint, text string")
    got = license_scan.scan(df, "doc_id", "text").collect()
    assert len(got) == 6 and all(r.coverage == 1.0 and r.template == "mit-notice" for r in got)
