"""Record extraction, scoring, validation, enhancement, export and storage on one résumé."""

import random

import pytest
from pyspark.sql import functions as F

from parchline import sinks
from parchline.operators import enhance, record, score, segment, store
from parchline.sources import documents

RESUME = """Anna Example
anna.example@mail.org
+1 (555) 234-5678
linkedin.com/in/annaexample | github.com/annaex
Berlin, Germany

PROFESSIONAL SUMMARY
Engineer with ten years of experience in data platforms and distributed systems.

WORK EXPERIENCE
Senior Data Engineer | Acme Corp | Berlin
Jan 2020 - Present
- Built pipelines with Python, Spark and Airflow
Software Engineer at Widget GmbH
Mar 2016 - Dec 2019
- Developed services in Java and PostgreSQL

EDUCATION
Master of Science in Computer Science
Technical University of Berlin
2013 - 2015
GPA: 3.8/4.0

SKILLS
Languages: Python, Java, SQL Server
Tools: Docker, k8s, reactjs

CERTIFICATIONS
AWS Certified Solutions Architect - 2021
PMP, 2019
"""


@pytest.fixture(scope="module")
def records(spark):
    docs = spark.createDataFrame([(1, RESUME), (2, ""), (3, None)], "doc_id bigint, text string")
    made = score.completeness(score.confidence(record.extract(docs, "2024-01-01"))).join(docs, "doc_id")
    made.write.mode("overwrite").parquet(spark.conf.get("spark.checkpoint.dir") + "/records")
    return spark.read.parquet(spark.conf.get("spark.checkpoint.dir") + "/records")


def test_fields(records):
    rows = {r.doc_id: r for r in records.collect()}
    r = rows[1].record
    assert (r.contact.full_name, r.contact.email, r.contact.city, r.contact.country) == ("Anna Example", "anna.example@mail.org", "Berlin", "Germany")
    assert [j.job_title for j in r.experience] == ["Senior Data Engineer", "Software Engineer"]
    assert r.experience[0].is_current and r.experience[1].end_date == "Dec 2019"
    assert r.education[0].gpa == "3.8/4.0" and r.education[0].institution == "Technical University of Berlin"
    assert {"kubernetes", "react", "python", "docker"} <= set(r.skills["all"])
    assert [c.name for c in r.certifications] == ["AWS Certified Solutions Architect", "PMP"]
    assert r.total_experience_years == 7.8
    assert rows[1].confidence.overall > 0.85 and rows[2].confidence.overall < 0.3 and rows[3].completeness.score == 0


def test_repairs_and_warnings(records):
    out = enhance.validate_record(enhance.enhance(records, "2024-01-01"), "2024-01-01").where("doc_id = 1").first()
    assert out.record.certifications[1].url.startswith("https://www.pmi.org")
    assert out.warnings == [] and out.enhancement.urls_mapped == 2


def test_exports(records):
    assert sinks.mapped(sinks.flat(records)).where("`Full Name` = 'Anna Example'").first()["Extraction Confidence"] in ("0.9", "1.0")
    assert sinks.exploded(records, "experience").count() == 4
    assert {r.metric: r.value for r in sinks.overview(records).collect()}["total"] == 3
    assert set(store.normalized_tables(records)) == {"extractions", "candidates", "contacts", "experience", "education", "skills", "certifications", "projects", "languages"}
    with pytest.raises(ValueError):
        sinks.export_csv(records, "unused", "no such mode")


def test_versioned_table(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), "id")
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string"), 1)
    t.update(spark.createDataFrame([(2,)], "id bigint"), {"v": "c"}, 2)
    t.delete(spark.createDataFrame([(1,)], "id bigint"), 3)
    assert [(r.id, r.v) for r in t.current().collect()] == [(2, "c")]


def test_security(spark):
    files = spark.createDataFrame(
        [("/in/a.pdf", bytearray(b"%PDF-1.4 text")), ("/in/b.pdf", bytearray(b"%PDF-1.4 /JavaScript")), ("/in/c.pdf", bytearray(b"no magic")), ("/in/d.docx", bytearray(b"PK\x03\x04"))],
        "path string, content binary",
    )
    safe, quarantine = documents.split_safe(documents.security_scan(files))
    assert [r.path for r in safe.collect()] == ["/in/a.pdf"]
    assert {r.path: r.why for r in quarantine.collect()} == {"/in/b.pdf": "pdf_keyword:/JavaScript", "/in/c.pdf": "magic_mismatch", "/in/d.docx": "unsupported_format"}


def test_blocks_and_sections(spark):
    docs = spark.createDataFrame([(1, RESUME)], "doc_id bigint, text string")
    cut = segment.segment_blocks(documents.text_blocks(docs))
    counts = {r.section: r["count"] for r in cut.groupBy("section").count().collect()}
    assert counts["experience"] == 6 and counts["education"] == 4 and counts["contact"] == 5
    headers = segment.find_headers(documents.text_blocks(docs))
    assert headers.where("text = 'EDUCATION'").count() == 1
    assert segment.name_block(documents.text_blocks(docs)).first()["name"] == "Anna Example"


def test_html_tables(spark):
    html = "<table><tr><th>A</th><th></th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    rows = documents.table_text(documents.html_tables(spark.createDataFrame([(1, html), (2, None)], "id int, html string"))).orderBy("row_idx").collect()
    assert [r.line for r in rows] == ["1 | 2", "3 | "] and rows[0].cells == {"A": "1", "col_1": "2"}


def test_pdf_without_library(spark):
    rows = documents.pdf_blocks(spark.createDataFrame([("/x.pdf", bytearray(b""))], "path string, content binary")).collect()
    assert len(rows) <= 1 and all(r.error for r in rows)


def test_long_entries_are_whole(spark):
    """Entries keep every line; headings begin entries only where a mark stands before them."""
    head, made = "Senior Developer | Acme | Berlin", [f"- built part {i}" for i in range(1100)]
    lines = [head, "Jan 2018 - Mar 2021", *made, "prose of more than five words", "Data Analyst | Firm 2 | Oslo", "2012 and then 2014"]
    rows = [(1, "experience", i, t) for i, t in enumerate(lines)] + [(1, "projects", i, t) for i, t in enumerate(["Parchment", *made])]
    cut = record.entry_rows(spark.createDataFrame(rows, "doc_id int, section string, line_no int, text string"))
    jobs = [r.j for r in cut.where("section = 'experience'").orderBy("entry").select(record.job(F.col("lines"), "2024-01-01").alias("j")).collect()]
    assert len(jobs[0].responsibilities) == 1100 and jobs[0].description == "prose of more than five words"
    assert (jobs[1].company, jobs[1].start_date, jobs[1].end_date) == ("Firm 2", "2012", "2014")
    found = cut.where("section = 'projects'").select(record.project(F.col("lines"), "2024-01-01").alias("p")).collect()
    assert len(found) == 1 and found[0].p.description.endswith("built part 1099")


def test_headings_begin_entries_as_a_fold_would(spark):
    """The window's rule against the step-by-step one, over random lines."""
    rng = random.Random(3)
    kinds = {"h": "Data Analyst | Firm", "b": "- did things", "d": "Jan 2018 - Mar 2021", "p": "some other words"}
    docs = [[rng.choice("hbdp") for _ in range(rng.randrange(1, 25))] for _ in range(200)]
    rows = [(k, "experience", i, kinds[x]) for k, xs in enumerate(docs) for i, x in enumerate(xs)]
    got = {}
    for r in record.entry_rows(spark.createDataFrame(rows, "doc_id int, section string, line_no int, text string")).collect():
        got.setdefault(r.doc_id, {})[r.entry] = r.lines
    for k, xs in enumerate(docs):
        want = []
        for x in xs:
            if not want or (x == "h" and any(y in (kinds["b"], kinds["d"]) for y in want[-1])):
                want.append([])
            want[-1].append(kinds[x])
        assert [got[k][e] for e in sorted(got[k])] == want


def test_enhancement_recovers_jobs(spark):
    text = "Ann Lee\nSenior Developer\nJan 2018 - Mar 2021\nother words"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    made = record.extract(docs, "2024-01-01").join(docs, "doc_id")
    out = enhance.enhance(made, "2024-01-01").first()
    assert [(j.job_title, j.start_date) for j in out.record.experience] == [("Senior Developer", "Jan 2018")] and out.enhancement.jobs_recovered == 1


def test_similarity_bound_is_safe(spark):
    """The Levenshtein bound never throws out a pair that reaches the cutoff."""
    from parchline.functions.similarity import possible, ratio

    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    out = pairs.selectExpr(f"{ratio('a', 'b')} r", f"{possible('a', 'b', 75)} p")
    assert out.where("r >= 75 AND NOT p").count() == 0 and out.where("NOT p").count() > 0
