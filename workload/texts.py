"""Text rules over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.functions import contacts as C
from rolemill.functions import experience, identity, seniority, text
from rolemill.functions.salary import parse_salary
from rolemill.functions.sections import sections
from rolemill.operators import skills
from rolemill.sources import documents
from workload import sql as S
from workload.common import Tables, query

AS_OF = "2026-08-20 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query(f"SELECT page_id, {S.strip_html('html')} AS plain FROM pages")
def strip_html(t: Tables) -> DataFrame:
    return t.spread("pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query(f"""SELECT doc_id, {S.norm('text')} AS normal, sha256({S.norm('source')} || '|' || {S.norm('text')} || '|' || lang || '|' ||
    array_to_string(list_sort([source, lang, source]), ',')) AS content_hash FROM documents""")
def normalize_hash(t: Tables) -> DataFrame:
    return t.spread("documents").select(
        "doc_id", text.normalize_text(F.col("text")).alias("normal"),
        identity.content_hash(F.col("source"), F.col("text"), F.col("lang"),
                              F.array("source", "lang", "source")).alias("content_hash"))


SALARY_TEXT = """CASE WHEN p_size < 6 THEN '$' || k || 'k - $' || k2 || 'k USD' WHEN p_size < 12 THEN '£' || k || 'k'
    WHEN p_size < 18 THEN '€' || k || ',000' WHEN p_size < 24 THEN '$' || k || '/hr' WHEN p_size < 30 THEN 'A$' || k || 'k – ' || k2 || 'k per month'
    WHEN p_size < 36 THEN k || ' to ' || k2 || '000 eur yearly' WHEN p_size < 42 THEN p_name || ' $' || k || '.5K'
    WHEN p_size < 48 THEN 'Competitive. ' || k ELSE '  ' END"""


def salary_text():
    """Nine spellings of pay, by part size."""
    k = F.floor("p_retailprice").cast("string")
    k2 = F.floor(F.col("p_retailprice") * 2).cast("string")
    texts = [
        F.concat(F.lit("$"), k, F.lit("k - $"), k2, F.lit("k USD")), F.concat(F.lit("£"), k, F.lit("k")),
        F.concat(F.lit("€"), k, F.lit(",000")), F.concat(F.lit("$"), k, F.lit("/hr")),
        F.concat(F.lit("A$"), k, F.lit("k – "), k2, F.lit("k per month")), F.concat(k, F.lit(" to "), k2, F.lit("000 eur yearly")),
        F.concat("p_name", F.lit(" $"), k, F.lit(".5K")), F.concat(F.lit("Competitive. "), k)]
    chosen = F.lit("  ")
    for i, text_ in reversed(list(enumerate(texts))):
        chosen = F.when(F.col("p_size") < 6 * (i + 1), text_).otherwise(chosen)
    return chosen


@query(S.salary(f"""(SELECT p_partkey, trim({SALARY_TEXT}) AS txt FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS k,
    CAST(floor(p_retailprice * 2) AS BIGINT) AS k2 FROM part))""", "txt", "p_partkey"))
def salary_parse(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", parse_salary(salary_text()).alias("s")).select("p_partkey", "s.*")


TITLE = """c_name || CASE c_mktsegment WHEN 'BUILDING' THEN ' Sr. Staff' WHEN 'FURNITURE' THEN ' jr. expert'
    WHEN 'MACHINERY' THEN ' Head of Internal' WHEN 'AUTOMOBILE' THEN ' VP' ELSE ' leader' END"""


@query(f"""SELECT c_custkey, {S.seniority('title')} AS level, {S.level_from_years('abs(c_acctbal) / 500')} AS by_years
    FROM (SELECT *, {TITLE} AS title FROM customer)""")
def seniority_levels(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    title = F.concat("c_name", F.when(seg == "BUILDING", " Sr. Staff").when(seg == "FURNITURE", " jr. expert")
                     .when(seg == "MACHINERY", " Head of Internal").when(seg == "AUTOMOBILE", " VP").otherwise(" leader"))
    return t.customer.select("c_custkey", seniority.seniority(title).alias("level"),
                             seniority.seniority_from_years(F.abs("c_acctbal") / 500).alias("by_years"))


def _re(e: str, p: str, g: int = 0) -> str:
    return f"nullif(regexp_extract({e}, '{p}', {g}), '')"


# How phone numbers and links are written.
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?"
URL = r"(?i)https?://[^\s<>\"'')]+"


def contact_sql(rel: str, key: str, txt: str) -> str:
    return f"""SELECT {key}, {_re(txt, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}')} AS email,
      CASE WHEN length(digits) BETWEEN 8 AND 15 AND NOT regexp_matches(digits, '^(19|20)[0-9]{{6}}$') THEN {S.trimmed('ph')} END AS phone,
      {_re(txt, '(?i)(?:https?://)?(?:www[.])?github[.]com/[a-zA-Z0-9-]{1,39}(?:/)?')} AS github,
      {_re(txt, '(?i)(?:https?://)?(?:[a-z]{2,3}[.])?linkedin[.]com/in/[a-zA-Z0-9_%-]{3,100}(?:/)?')} AS linkedin,
      CASE WHEN NOT regexp_matches(u, '(?i)github[.]com|linkedin[.]com|mailto:|[.]png|[.]jpe?g') THEN u END AS url
    FROM (SELECT *, regexp_replace(ph, '[^0-9]', '', 'g') AS digits FROM
      (SELECT *, {_re(txt, PHONE)} AS ph, {_re(txt, URL)} AS u FROM {rel}))"""


HEAD = 200


@query(contact_sql(f"(SELECT doc_id, left(text, {HEAD}) AS head, text FROM documents)", "doc_id", "text").replace(
    "regexp_extract(text, '[a-zA-Z0-9._%+-]+@", "regexp_extract(head, '[a-zA-Z0-9._%+-]+@").replace(
    f"{_re('text', PHONE)} AS ph", f"{_re('head', PHONE)} AS ph"))
def contacts_in_head(t: Tables) -> DataFrame:
    """Email and phone from the first characters only, links from the whole text."""
    return t.spread("documents").select("doc_id", C.contacts(F.col("text"), HEAD).alias("c")).select("doc_id", "c.*")


@query(contact_sql("documents", "doc_id", "text"))
def contacts_in_documents(t: Tables) -> DataFrame:
    found = C.contacts(F.col("text"), head_chars=None)
    return t.spread("documents").select("doc_id", found.alias("c")).select("doc_id", "c.*")


@query(contact_sql("pages", "page_id", "html"))
def contacts_in_pages(t: Tables) -> DataFrame:
    found = C.contacts(F.col("html"), head_chars=None)
    return t.spread("pages").select("page_id", found.alias("c")).select("page_id", "c.*")


PROFILE_LINES = """SELECT o_orderkey AS doc_id, 'Customer ' || o_custkey || chr(10) || 'Lead ' || o_orderpriority || ' manager' || chr(10) || chr(10) ||
    'Professional Experience:' || chr(10) || 'Acme (' || strftime(o_orderdate, '%b %Y') || ' - ' || strftime(o_orderdate + INTERVAL 400 DAY, '%m/%Y') || ')' || chr(10) ||
    'Beta ' || year(o_orderdate) || ' until present' || chr(10) || chr(10) || CASE o_orderstatus WHEN 'O' THEN 'SUMMARY' || chr(10) || 'Seeking a Data  Platform roles' || chr(10)
    WHEN 'F' THEN 'OTHER THINGS' || chr(10) || ' - x.' || chr(10) || 'SKILLS & MORE' || chr(10) ELSE '' END AS text FROM orders"""


def profile_texts(t: Tables) -> DataFrame:
    """One profile-shaped text per order: name, title line, work history, optional extra parts."""
    st, nl = F.col("o_orderstatus"), "\n"
    day = F.col("o_orderdate")
    return t.spread("orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_orderdate", F.concat(
            F.lit("Customer "), "o_custkey", F.lit(nl + "Lead "), "o_orderpriority", F.lit(" manager\n\nProfessional Experience:\nAcme ("),
            F.date_format(day, "MMM yyyy"), F.lit(" - "), F.date_format(F.date_add(day, 400), "MM/yyyy"), F.lit(")\nBeta "),
            F.year(day), F.lit(" until present\n\n"),
            F.when(st == "O", "SUMMARY\nSeeking a Data  Platform roles\n").when(st == "F", "OTHER THINGS\n - x.\nSKILLS & MORE\n").otherwise(""),
        ).alias("text"))


def section_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode(sections(F.col("text"))).alias("pos", "s")).select(
        "doc_id", "pos", "s.name", "s.heading", F.size("s.lines").alias("n_lines"), F.array_join("s.lines", "\n").alias("body"))


@query(S.sections("documents"))
def sections_of_documents(t: Tables) -> DataFrame:
    return section_rows(t.spread("documents"))


@query(S.sections(f"({PROFILE_LINES})"))
def sections_of_profiles(t: Tables) -> DataFrame:
    return section_rows(profile_texts(t))


@query("""SELECT o_orderkey AS doc_id, floor(CAST(epoch_ms(TIMESTAMP '2026-08-20') - least(a, b) AS DOUBLE) / (365.25 * 86400000) * 10 + 0.5) / 10 AS years
    FROM (SELECT o_orderkey, epoch_ms(date_trunc('month', o_orderdate)) AS a, epoch_ms(date_trunc('year', o_orderdate)) AS b FROM orders)""")
def years_of_experience(t: Tables) -> DataFrame:
    """Month span and an open span per text: the union reaches from the earliest start to now."""
    parts = profile_texts(t).select("doc_id", sections(F.col("text")).alias("s"))
    # "Beta 2020" reads as a month name and a year, so the open span needs its own line start.
    return parts.select("doc_id", experience.years_experience(F.transform("s", lambda p: F.struct(
        p["name"].alias("name"), p["heading"].alias("heading"),
        F.transform(p["lines"], lambda l: F.replace(l, F.lit("Beta "), F.lit("Beta: "))).alias("lines"))), as_of()).alias("years"))


@query("""SELECT o_orderkey AS doc_id, n AS n_spans, CAST(epoch_ms(a) AS BIGINT) AS first_start,
    CAST(epoch_ms(e) AS BIGINT) AS first_end FROM (SELECT *, date_trunc('month', o_orderdate) AS a,
    date_trunc('month', o_orderdate + INTERVAL 400 DAY) AS e, CAST(1 AS INT) AS n FROM orders)""")
def date_ranges(t: Tables) -> DataFrame:
    spans = profile_texts(t).select("doc_id", experience.date_spans(F.col("text"), as_of()).alias("s"))
    return spans.select("doc_id", F.size("s").alias("n_spans"), F.col("s")[0]["start"].alias("first_start"),
                        F.col("s")[0]["end"].alias("first_end"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN 'Data Platform' ELSE 'Lead ' || o_orderpriority || ' manager' END AS role
    FROM orders""")
def target_roles(t: Tables) -> DataFrame:
    parts = profile_texts(t).withColumn("s", sections(F.col("text")))
    return parts.select("doc_id", experience.target_role(F.col("s"), F.col("text"), head_chars=None).alias("role"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Data Engineer' END AS role FROM orders""")
def target_role_in_head(t: Tables) -> DataFrame:
    """A title phrase counts only where it stands in the first characters."""
    n = F.col("o_orderkey")
    gap = F.when(n % 3 == 0, F.lit("")).otherwise(F.repeat(F.lit("word "), 20))
    text = F.concat(F.lit("SUMMARY\nabout me "), gap, F.lit(" as Data Engineer here"))
    docs = t.orders.select(n.alias("doc_id"), text.alias("text"))
    return docs.select("doc_id", experience.target_role(sections(F.col("text")), F.col("text"), 60).alias("role"))


WORDS = [("The", ["the"]), ("Of", ["of", "of the"]), ("French", ["de la", "des", "que de"]), ("Spanish", ["de", "ción", "que"]),
         ("German", ["der", "die", "und"]), ("Pair", ["and the", "to the of"]), ("Sharp", ["e#"])]


def word_dictionary(t: Tables) -> DataFrame:
    """A small dictionary of words and phrases that occur in the documents (a parameter of the query)."""
    return skills.dictionary(t.spark.createDataFrame(
        [(i, c, a) for i, (c, a) in enumerate(WORDS)], "pos int, canonical string, aliases array<string>"))


def _terms_sql() -> str:
    seen, rows = set(), []
    for canonical, aliases in WORDS:
        for term in [canonical, *aliases]:
            if term.lower() not in seen:
                seen.add(term.lower())
                rows.append(f"('{term.lower()}', '{canonical}')")
    return ", ".join(rows)


MATCHES = f"""WITH terms(term, canonical) AS (VALUES {_terms_sql()}),
    d AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[a-z0-9+#.]+') AS runs,
            regexp_extract_all(lower(text), '[^a-z0-9+#.]+') AS seps FROM documents),
    r AS (SELECT doc_id, runs, seps, CASE WHEN regexp_matches(t, '^[a-z0-9+#.]') THEN 0 ELSE 1 END AS lead,
            unnest(range(1, len(runs) + 1)) AS i FROM d),
    p AS (SELECT doc_id, i, unnest([runs[i],
            CASE WHEN i < len(runs) THEN runs[i] || seps[i + lead] || runs[i + 1] END,
            CASE WHEN i + 1 < len(runs) THEN runs[i] || seps[i + lead] || runs[i + 1] || seps[i + lead + 1] || runs[i + 2] END]) AS phrase FROM r),
    h AS (SELECT doc_id, canonical, i FROM p JOIN terms ON phrase = term WHERE term NOT LIKE '%#'
          UNION ALL SELECT doc_id, 'Sharp', unnest(range(1, n + 1)) FROM
            (SELECT doc_id, len(regexp_extract_all(t, '(^|[^a-z0-9_])e#')) AS n FROM d))"""


@query(MATCHES + " SELECT doc_id, canonical, count(*) AS occurrences FROM h GROUP BY doc_id, canonical")
def dictionary_match(t: Tables) -> DataFrame:
    return skills.match_terms(t.spread("documents"), "doc_id", "text", word_dictionary(t)).drop("first_run")


@query(MATCHES + """, c AS (SELECT doc_id, canonical, count(*) AS n, min(i) AS f FROM h WHERE canonical <> 'Sharp' GROUP BY doc_id, canonical)
    SELECT doc_id, string_agg(canonical || ':' || n, ',' ORDER BY n DESC, f, canonical) AS skills FROM c GROUP BY doc_id""")
def skill_lists(t: Tables) -> DataFrame:
    """Ordered skill list per document (terms without symbol endings)."""
    terms = word_dictionary(t).where(F.col("canonical") != "Sharp")
    lists = skills.skill_lists(skills.match_terms(t.spread("documents"), "doc_id", "text", terms), "doc_id")
    shown = F.transform("skills", lambda s: F.concat(s["skill"], F.lit(":"), s["occurrences"]))
    return lists.select("doc_id", F.array_join(shown, ",").alias("skills"))


@query("""SELECT p_partkey, CASE WHEN lower(p_type) IN ('small', 'promo') THEN 'Offer' WHEN lower(p_type) = 'large' THEN 'LARGE' ELSE p_type END AS name
    FROM part""")
def canonical_names(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([("small", "Offer"), ("promo", "Offer")], "term string, canonical string")
    return skills.canonicalize(t.part, "p_type", terms, "name").select("p_partkey", "name")


@query("""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
    x AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9+#.]+|[^a-z0-9+#.]+')) AS part,
            generate_subscripts(regexp_extract_all(t, '[a-z0-9+#.]+|[^a-z0-9+#.]+'), 1) AS i FROM d),
    o AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS off FROM x)
    SELECT doc_id, count(*) AS n_runs, CAST(sum(off) AS BIGINT) AS sum_offset, CAST(max(off) AS BIGINT) AS last_offset
    FROM o WHERE regexp_matches(part, '^[a-z0-9+#.]') GROUP BY doc_id""")
def token_offsets(t: Tables) -> DataFrame:
    return skills.token_offsets(t.spread("documents"), "doc_id", "text").groupBy("doc_id").agg(
        F.count("*").alias("n_runs"), F.sum("offset").alias("sum_offset"), F.max("offset").alias("last_offset"))


FILES = """SELECT doc_id, text, CASE lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'application/PDF' ELSE '' END AS content_type,
    'F' || doc_id || CASE WHEN lang = 'de' THEN '.Docx' WHEN lang = 'es' AND n_chars > 500 THEN '.bin' ELSE '.TXT' END AS filename,
    n_chars AS size FROM documents"""


@query(f"""SELECT doc_id, CASE WHEN size > 20000 THEN 'too large' WHEN lang = 'es' AND n_chars > 500 THEN 'unsupported type'
    WHEN lang = 'fr' THEN 'pdf needs a decoder' WHEN lang = 'de' THEN 'docx needs a decoder'
    WHEN length({S.trimmed('text')}) < 40 THEN 'text too short' ELSE 'accepted' END AS outcome
    FROM (SELECT d.*, f.size FROM documents d JOIN ({FILES}) f USING (doc_id))""")
def document_admission(t: Tables) -> DataFrame:
    lang = F.col("lang")
    files = t.spread("documents").select(
        "doc_id", F.when(lang == "en", "text/plain").when(lang == "fr", "application/PDF").otherwise("").alias("content_type"),
        F.concat(F.lit("F"), "doc_id", F.when(lang == "de", ".Docx").when((lang == "es") & (F.col("n_chars") > 500), ".bin")
                 .otherwise(".TXT")).alias("filename"),
        F.col("n_chars").alias("size"), F.encode("text", "UTF-8").alias("content"))
    good, bad = documents.route_documents(files, max_bytes=20000)
    return good.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(
        bad.select("doc_id", F.col("reject_reason").alias("outcome")))


@query(f"""WITH p AS ({PROFILE_LINES})
    SELECT doc_id, 'Customer' AS first_word, CAST(2 AS INT) AS header_lines, 'Lead:1' AS skills,
      CASE WHEN text LIKE '%SUMMARY%' THEN 'Data Platform' ELSE regexp_extract(text, 'Lead .* manager') END AS role FROM p""")
def parsed_profiles(t: Tables) -> DataFrame:
    """The whole profile parse: sections, contacts, skills, years, role, admission."""
    terms = t.spark.createDataFrame([("lead", "Lead"), ("acme", "Acme Corp")], "term string, canonical string")
    docs = profile_texts(t).select("doc_id", "text")
    rows = documents.parse_profiles(docs, terms.where("term = 'lead'"), as_of(), "doc_id", "text", None, None)
    rows = rows.where(F.col("reject_reason").isNull())
    return rows.select(
        "doc_id", F.substring_index(F.col("sections")[0]["lines"][0], " ", 1).alias("first_word"),
        F.size(F.col("sections")[0]["lines"]).alias("header_lines"),
        F.array_join(F.transform("skills", lambda s: F.concat(s["skill"], F.lit(":"), s["occurrences"])), ",").alias("skills"),
        F.col("target_role").alias("role"))


COMPOSITE = """SELECT c_custkey, list_sort(list(DISTINCT o_orderpriority)) AS sk FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""


@query(f"""SELECT c.c_custkey, c_name || ' · ' || c_mktsegment || coalesce(' · ' || nullif(array_to_string(sk, ', '), ''), '') ||
      CASE WHEN c_acctbal > 0 THEN ' · EU' ELSE '' END || ' · mid' AS composite,
    c_name || ' · ' || c_mktsegment || coalesce(' · ' || nullif(array_to_string(sk, ', '), ''), '') ||
      CASE WHEN c_acctbal > 0 THEN ' · EU' ELSE '' END || ' · mid · 1-' || CAST(c_nationkey AS VARCHAR) || 'USD' AS summary
    FROM customer c LEFT JOIN ({COMPOSITE}) k USING (c_custkey)""")
def job_texts(t: Tables) -> DataFrame:
    """Embedding text and summary of postings with their sorted skills."""
    from rolemill.operators.embedding import with_skill_list
    jobs = t.customer.withColumn("id", F.col("c_custkey"))
    links = t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("skill"))
    place = F.when(F.col("c_acctbal") > 0, "EU")
    rows = with_skill_list(jobs, links)
    return rows.select(
        "c_custkey",
        identity.job_composite(F.col("c_name"), F.col("c_mktsegment"), F.col("skills"), place, F.lit("mid")).alias("composite"),
        identity.job_summary(F.col("c_name"), F.col("c_mktsegment"), F.col("skills"), place, F.lit("mid"), F.lit(1),
                             F.col("c_nationkey"), F.lit("USD")).alias("summary"))


@query("""SELECT p_partkey, p_name || ' · ' || CASE WHEN p_size > 25 THEN p_brand || ', ' || p_type ELSE p_type || ', ' || p_brand END ||
      CASE WHEN p_size > 5 THEN ' · ' || CAST(floor(p_size / 3.0 + 0.5) AS BIGINT) || ' years · ' || """ + S.level_from_years("p_size / 3.0") + """ ELSE '' END AS composite
    FROM part""")
def profile_texts_for_embedding(t: Tables) -> DataFrame:
    size = F.col("p_size")
    listed = F.array(F.struct(F.col("p_type").alias("skill"), F.lit(26).alias("occurrences")),
                     F.struct(F.col("p_brand").alias("skill"), (size + 1).alias("occurrences")))
    return t.part.select("p_partkey", identity.cv_composite(
        F.col("p_name"), listed, F.when(size > 5, size / 3.0)).alias("composite"))
