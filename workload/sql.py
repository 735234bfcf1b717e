"""Reference SQL fragments, written for DuckDB independently of the Spark columns."""

from __future__ import annotations


def norm(e: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({e}), '\\s+', ' ', 'g')), '')"


def trimmed(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def strip_html(e: str) -> str:
    out = f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"
    for a, b in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"),
                 ("&apos;", "''"), ("&quot;", '"')]:
        out = f"replace({out}, '{a}', '{b}')"
    return f"nullif(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '')"


def seniority(e: str) -> str:
    def has(p: str) -> str:
        return f"regexp_matches(lower({e}), '\\b({p})\\b')"
    # Level words, in order of precedence.
    return f"""CASE WHEN {e} IS NULL THEN NULL
        WHEN {has('intern|internship|apprentice')} THEN 'intern'
        WHEN {has('junior|jr|entry|graduate')} THEN 'junior'
        WHEN {has('staff|principal')} THEN 'staff'
        WHEN {has('senior|sr')} THEN 'senior'
        WHEN {has('lead')} THEN 'lead'
        WHEN {has('expert')} THEN 'senior'
        WHEN {has('director|vp|vice president|chief|cto|cio|ceo')} THEN 'director+'
        WHEN {has('manager|head of')} THEN 'manager'
        ELSE 'mid' END"""


def level_from_years(e: str) -> str:
    # Years below which a level holds.
    return (f"CASE WHEN {e} < 2 THEN 'intern' WHEN {e} < 4 THEN 'junior' WHEN {e} < 7 THEN 'mid' "
            f"WHEN {e} < 12 THEN 'senior' ELSE 'staff' END")


# Fixed value: how an amount of money is written.
AMT = r"\$?\s*[\d.,]+[kKmM]?"


def _amount(e: str) -> str:
    clean = f"trim(regexp_replace({e}, '[,$£€¥]', '', 'g'))"
    pat = r"^(\d+(?:\.\d+)?)\s*([kKmM])?$"
    unit = f"lower(regexp_extract({clean}, '{pat}', 2))"
    num = f"TRY_CAST(nullif(regexp_extract({clean}, '{pat}', 1), '') AS DOUBLE)"
    return (f"CAST(floor({num} * (CASE {unit} WHEN 'k' THEN 1000.0 WHEN 'm' THEN 1000000.0 ELSE 1.0 END)"
            f" + 0.5) AS BIGINT)")


def salary(source: str, text: str, cols: str) -> str:
    """SELECT of ``cols`` plus the four salary columns from a relation with a text column."""
    rng = rf"({AMT})\s*(?:-|–|—|to)\s*({AMT})"
    lo, hi = (_amount(f"nullif(regexp_extract({text}, '{rng}', {g}), '')") for g in (1, 2))
    one = _amount(f"nullif(regexp_extract({text}, '{AMT}', 0), '')")
    return f"""
    SELECT {cols}, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo ELSE one END AS salary_min,
           CASE WHEN lo IS NOT NULL THEN hi END AS salary_max,
           CASE WHEN (lo IS NOT NULL AND hi IS NOT NULL) OR one IS NOT NULL THEN cur END AS salary_currency,
           CASE WHEN (lo IS NOT NULL AND hi IS NOT NULL) OR one IS NOT NULL THEN per END AS salary_period
    FROM (SELECT *, {lo} AS lo, {hi} AS hi, {one} AS one,
            CASE WHEN contains({text}, '$') THEN 'USD' WHEN contains({text}, '£') THEN 'GBP'
                 WHEN contains({text}, '€') THEN 'EUR' WHEN contains({text}, '¥') THEN 'JPY'
                 ELSE nullif(upper(regexp_extract({text}, '(?i)\\b(USD|GBP|EUR|JPY|AUD|CAD|SGD|INR)\\b', 1)), '')
                 END AS cur,
            CASE WHEN regexp_matches({text}, '(?i)\\b(per\\s*hour|/\\s*hr\\b|/\\s*hour\\b|hourly)\\b') THEN 'hourly'
                 WHEN regexp_matches({text}, '(?i)\\b(per\\s*month|/\\s*mo\\b|monthly)\\b') THEN 'monthly'
                 WHEN regexp_matches({text}, '(?i)\\b(per\\s*year|/\\s*yr\\b|yearly|annually)\\b') THEN 'yearly'
                 WHEN length(regexp_replace({text}, '[^0-9]', '', 'g')) >= 4 THEN 'yearly' END AS per
          FROM {source})"""


# Headings and the sections they open.
HEADINGS = [
    (r"(?:professional\s+)?(?:work\s+|employment\s+)?experience", "experience"),
    (r"employment(?:\s+history)?", "experience"),
    (r"work\s+history", "experience"),
    (r"career\s+(?:history|summary)", "experience"),
    (r"education(?:al)?(?:\s+background|\s+history)?", "education"),
    (r"(?:technical\s+)?skills?(?:\s+(?:&|and)\s+\w+)?", "skills"),
    (r"(?:core|key)\s+competenc(?:y|ies)", "skills"),
    (r"projects?(?:\s+(?:&|and)\s+\w+)?", "projects"),
    (r"(?:professional\s+)?summary", "summary"),
    (r"(?:profile|objective|about\s+me)", "summary"),
    (r"certifications?", "certifications"),
    (r"languages", "languages"),
    (r"publications?", "publications"),
    (r"awards?(?:\s+(?:&|and)\s+honors)?", "awards"),
    (r"volunteer(?:ing)?(?:\s+experience)?", "volunteer"),
    (r"interests?", "interests"),
    (r"references?", "references"),
]


def sections(docs: str) -> str:
    """Relation (doc_id, pos, name, heading, n_lines, body) from a relation (doc_id, text)."""
    rules = "\n".join(f"WHEN regexp_matches(bare, '(?i)^{p}\\b') THEN '{n}'" for p, n in HEADINGS)
    return f"""
    WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln
               FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM {docs})),
    t AS (SELECT *, {trimmed('line')} AS tr FROM l),
    b AS (SELECT *, {trimmed("regexp_replace(regexp_replace(tr, ':\\s*$', ''), '^[-–—•·*]\\s*', '')")} AS bare FROM t),
    h AS (SELECT *, CASE WHEN length(tr) BETWEEN 1 AND 60 AND NOT regexp_matches(tr, '[.,;]$') AND bare <> '' THEN
            CASE {rules}
            WHEN length(bare) > 2 AND bare = upper(bare) AND regexp_matches(bare, '[A-Z]')
                 AND len(regexp_split_to_array(bare, '\\s+')) <= 5
            THEN regexp_replace(lower(bare), '\\s+', '-', 'g') END END AS hd FROM b),
    s AS (SELECT *, count(hd) OVER (PARTITION BY doc_id ORDER BY ln) AS sec FROM h),
    k AS (SELECT *, max(CASE WHEN tr <> '' AND hd IS NULL THEN ln END) OVER (PARTITION BY doc_id, sec) AS last_ln FROM s),
    g AS (SELECT doc_id, sec,
            coalesce(max(hd), 'header') AS name,
            coalesce(max(CASE WHEN hd IS NOT NULL THEN tr END), '(header)') AS heading,
            count(*) FILTER (hd IS NULL AND ln <= last_ln AND (sec > 0 OR tr <> '')) AS n_lines,
            string_agg(line, chr(10) ORDER BY ln) FILTER (hd IS NULL AND ln <= last_ln AND (sec > 0 OR tr <> '')) AS body
          FROM k GROUP BY doc_id, sec)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INT) AS pos, name, heading,
           CAST(n_lines AS INT) AS n_lines, body
    FROM g WHERE n_lines > 0"""
