"""Golden cases of the scalar rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolemill.functions import contacts as C
from rolemill.functions import display, experience, identity, salary, sections, seniority, text, vectors

def as_of():
    return F.lit("2026-08-20 00:00:00").cast("timestamp")


def values(spark, inputs, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


SALARIES = {
    "$120k - $140k USD": (120000, 140000, "USD", "yearly"),
    "$100,000 - $130,000": (100000, 130000, "USD", "yearly"),
    "£60k": (60000, None, "GBP", None),
    "€70,000": (70000, None, "EUR", "yearly"),
    "$50/hr": (50, None, "USD", "hourly"),
    "$50 / hr": (50, None, "USD", None),
    "$50 - $60": (50, 60, "USD", "yearly"),
    "A$120k": (120000, None, "USD", None),
    "€50k - €60k": (50000, None, "EUR", "yearly"),
    "€70.000": (70, None, "EUR", "yearly"),
    "60000 - 90000": (60000, 90000, None, "yearly"),
    "0 - 0": (0, 0, None, None),
    "100k to 120k EUR per year": (100000, 120000, "EUR", "yearly"),
    "$1.5M": (1500000, None, "USD", None),
    "3 weeks holiday, $90k": (3, None, "USD", None),
    "Competitive": (None,) * 4,
    "Competitive. $90k": (None,) * 4,
    "": (None,) * 4,
    None: (None,) * 4,
}


def test_salary(spark):
    got = values(spark, list(SALARIES), salary.parse_salary)
    assert {k: tuple(v) if v else (None,) * 4 for k, v in zip(SALARIES, got)} == SALARIES


TITLES = {
    "Sr. Engineer": "senior", "Senior Staff Engineer": "staff", "Senior Manager": "senior",
    "Head of Data": "manager", "VP Engineering": "director+", "Tech Lead": "lead",
    "Graduate Lead": "junior", "Domain Expert": "senior", "Data Engineer": "mid",
    "Internal Tools Engineer": "mid", "Summer Internship": "intern", None: None,
}


def test_seniority(spark):
    assert dict(zip(TITLES, values(spark, list(TITLES), seniority.seniority))) == TITLES


def test_text(spark):
    assert values(spark, ["<p>A&nbsp;B</p>", "&amp;lt;b&gt;", "<br>", None, "&apos;x&#39;  y"],
                  text.strip_html) == ["A B", "<b>", None, None, "'x' y"]
    assert values(spark, ["  Data\t Engineer ", None], text.normalize_text) == ["data engineer", ""]


PROFILE = """Jane Doe
Senior Data Engineer
jane.doe@example.com | +62 812 3456 7890 | https://github.com/janedoe

EXPERIENCE
Acme (Jan 2020 - Dec 2023)
Beta Corp (Mar 2018 - Jun 2020)

Skills:
Python, SQL, Kafka, CI/CD"""


def test_profile(spark):
    row = (
        spark.createDataFrame([(PROFILE,)], "t string")
        .select("t", sections.sections(F.col("t")).alias("s"), C.contacts(F.col("t")).alias("c"))
        .select("s", "c", experience.years_experience(F.col("s"), as_of()).alias("y"),
                experience.target_role(F.col("s"), F.col("t")).alias("r"))
        .first()
    )
    assert [(s.name, s.heading, len(s.lines)) for s in row.s] == [
        ("header", "(header)", 3), ("experience", "EXPERIENCE", 2), ("skills", "Skills:", 1)]
    assert tuple(row.c) == ("jane.doe@example.com", "+62 812 3456 7890",
                            "https://github.com/janedoe", None, None)
    assert row.y == 5.8
    assert row.r == "Senior Data Engineer"


@pytest.mark.parametrize("body,years", [
    ("Acme Jan 2020 - Dec 2023", 3.9),
    ("Acme: 2020 - 2023\nBeta: 2015 - 2017", 5.0),
    ("Mar 2018 - Jun 2020, Jan 2020 - Jan 2022", 3.8),
    ("03/2020–08/2022", 2.4),
    ("Aug 2024 to Present", 2.1),
    ("1950 - 2020", None),
    ("nothing here", None),
])
def test_years(spark, body, years):
    df = spark.createDataFrame([(f"EXPERIENCE\n{body}",)], "t string")
    assert df.select(experience.years_experience(sections.sections(F.col("t")), as_of())).first()[0] == years


def test_years_without_section(spark):
    df = spark.createDataFrame([("Acme 2020 - 2023",)], "t string")
    assert df.select(experience.years_experience(sections.sections(F.col("t")), as_of())).first()[0] is None


def test_roles(spark):
    texts = ["SUMMARY\nSeeking a Data Platform role.\n", "SUMMARY\nTargeting an Analytics Manager Role\n",
             "Some Person\nPrincipal  Designer of things\n", "X\nplain Backend Developer here", "nothing"]
    got = values(spark, texts, lambda t: experience.target_role(sections.sections(t), t))
    assert got == ["Data Platform", "Analytics Manager", "Principal Designer of things",
                   "plain Backend Developer here", None]


def test_headings(spark):
    lines = {"Experience with Spark": "experience", "- Work History:": "experience",
             "Technical Skills & Tools": "skills", "MY OWN PART": "my-own-part", "Ends with dot.": None,
             "SHOUTED LINE OF MORE THAN FIVE": None, "plain line": None, "": None, "AB": None,
             "Career Summary": "experience", "About me": "summary", "Volunteering": "volunteer",
             "EDUCATION;": None, "x" * 61: None}
    assert dict(zip(lines, values(spark, list(lines), sections.heading_name))) == lines


def test_sections_shape(spark):
    doc = "\n\nSKILLS\na\n\n\nSKILLS\n\nPROJECTS\n\nb\n\n"
    got = values(spark, [doc], sections.sections)[0]
    assert [(s.name, s.lines) for s in got] == [("skills", ["a"]), ("projects", ["", "b"])]


def test_contact_rules(spark):
    cases = {
        "call 20201231 now": None, "+1 (555) 123-4567": "+1 (555) 123-4567", "12345": None,
    }
    assert dict(zip(cases, values(spark, list(cases), lambda t: C.contacts(t)["phone"]))) == cases
    urls = {"see https://me.dev/x, https://github.com/a": "https://me.dev/x,",
            "https://x.org/p.png https://me.dev": None, "no": None}
    assert dict(zip(urls, values(spark, list(urls), lambda t: C.contacts(t)["url"]))) == urls
    late = "x" * 3001 + " a@b.co"
    assert values(spark, [late], lambda t: C.contacts(t, C.HEAD_CHARS)["email"]) == [None]
    assert values(spark, [late], lambda t: C.contacts(t)["email"]) == ["a@b.co"]
    assert values(spark, [late], lambda t: C.contacts(t, None)["email"]) == ["a@b.co"]


def test_display(spark):
    df = spark.createDataFrame(
        [(90000, 120000, "USD", "yearly"), (50, None, "GBP", "hourly"), (None, 1500, "EUR", "monthly"),
         (None, None, "USD", None), (500, 1499, "SGD", None), (1, 2, None, None)],
        "a int, b int, c string, p string")
    assert [r[0] for r in df.select(display.format_salary(*map(F.col, "abcp"))).collect()] == [
        "$90k – $120k/yr", "£50+/hr", "€2k-/mo", None, "SGD500 – SGD1k", "1 – 2"]
    df = spark.createDataFrame(
        [(True, "Hybrid - X"), (None, "Remote EU"), (True, None), (False, None), (None, "Paris"),
         (None, None)], "r boolean, l string")
    assert [r[0].kind for r in df.select(display.workplace_label(F.col("r"), F.col("l"))).collect()] == [
        "hybrid", "remote", "remote", "onsite", "onsite", "any"]
    stamps = ["2026-08-19 23:59:30", "2026-08-19 23:01:00", "2026-08-19 01:00:00", "2026-08-10 00:00:00",
              "2026-05-01 00:00:00", "2024-01-01 00:00:00", None]
    assert values(spark, stamps, lambda v: display.time_ago(v.cast("timestamp"), as_of())) == [
        "just now", "59m ago", "23h ago", "10d ago", "3mo ago", "2y ago", ""]
    assert values(spark, ["lever:acme", "remotive"], display.source_label) == ["lever", "remotive"]


def test_identity(spark):
    df = spark.createDataFrame([(" ACME ", "Data  Engineer", None, ["SQL", "a", "a"])],
                               "c string, t string, l string, s array<string>")
    import hashlib
    want = hashlib.sha256("acme|data engineer||a,a,sql".encode()).hexdigest()
    assert df.select(identity.content_hash(*map(F.col, "ctls"))).first()[0] == want
    one = df.select(identity.job_summary(
        F.col("t"), F.col("c"), F.col("s"), F.lit(""), F.lit("mid"), F.lit(1), F.lit(2), F.lit("USD")),
        identity.cv_composite(F.lit("Dev"), F.from_json(
            F.lit('[{"skill":"a","occurrences":1},{"skill":"b","occurrences":3},{"skill":"c","occurrences":1}]'),
            "array<struct<skill:string,occurrences:int>>"), F.lit(6.5)),
        identity.user_key(F.lit(" 1.2.3.4, 5.6.7.8"), F.lit(None).cast("string"), F.lit("9")),
        identity.job_id(F.sha2(F.lit("x"), 256))).first()
    assert one[0] == "Data  Engineer ·  ACME  · SQL, a, a · mid · 1-2USD"
    assert one[1] == "Dev · b, a, c · 7 years · mid"
    assert one[2] == hashlib.sha256(b"1.2.3.4:9").hexdigest()[:16]
    assert len(one[3]) == 36


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(vectors.l2_normalize(F.col("a")), vectors.cosine_distance(F.col("a"), F.col("b")),
                    vectors.cosine_distance_to(F.col("a"), [1.0, 0.0]),
                    vectors.score(vectors.cosine_distance(F.col("a"), F.col("b"))),
                    vectors.parse_vector(vectors.vector_literal(F.col("a"))),
                    vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert row[0] == pytest.approx([0.6, 0.8]) and row[1] == pytest.approx(0.4)
    assert row[2] == pytest.approx(0.4) and row[3] == 0.6 and row[4] == [3.0, 4.0] and row[5] == [0, 0]
    with pytest.raises(Exception, match="dimension mismatch"):
        df.select(vectors.require_dim(F.col("a"), 3)).collect()
