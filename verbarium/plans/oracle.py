"""SQL for DuckDB with the results that the registered queries must give."""

from __future__ import annotations

from verbarium import schemas
from verbarium.plans import catalog
from verbarium.plans.wikitext_view import PAGES_SQL

# Each step may use the ones above it.
STEPS = {
    "wiki": PAGES_SQL,
    "content": """
        SELECT * FROM wiki
        WHERE NOT (position(':' IN title) > 0 AND split_part(title, ':', 1)
          IN ('User', 'Template', 'Module', 'Category', 'Thread', 'Talk'))""",
    "cut": r"""
        SELECT page_id, title,
          regexp_extract_all(text, '(?m)^==([^=]+)==\n', 1) AS names,
          regexp_split_to_array(text, '(?m)^==[^=]+==\n') AS pieces
        FROM content""",
    "sections": """
        SELECT page_id, title, CAST(i AS INTEGER) AS section, lower(names[i]) AS language,
          pieces[i + 1] AS body
        FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM cut)""",
    "verbs": r"""
        SELECT page_id, title, section, language, regexp_extract(body,
          '(?m)^={3,}Verb={3,}$((?s:.*?))(?:^={2,}.*={2,}$|\z)', 1) AS verb
        FROM sections WHERE contains(body, '===Verb===')""",
    "matches": r"""
        SELECT *, regexp_extract_all(verb, '(# )?(\{\{[^{]*\}\})', 0) AS f,
          regexp_extract_all(verb, '(# )?(\{\{[^{]*\}\})', 2) AS g
        FROM verbs""",
    "selected": """
        SELECT *, CASE WHEN len(f) = 0 THEN []
            WHEN regexp_matches(f[1], 'verb( |-)form') THEN list_concat([f[1]], g[2:])
            ELSE [f[1]] END AS chosen
        FROM matches""",
    "found": """
        SELECT page_id, title, section, language, CAST(i - 1 AS INTEGER) AS pos,
          chosen[i] AS template
        FROM (SELECT *, unnest(range(1, len(chosen) + 1)) AS i FROM selected)""",
    "raw": r"""
        SELECT *, regexp_extract(e, 'm=(.{3})', 1) AS mood,
          regexp_extract(e, '\|([^|]+)\}\}', 1) AS reference,
          regexp_extract(e, 't=(.{4})', 1) AS tense_code,
          regexp_extract(e, 'n=(.{2})', 1) AS number_code,
          regexp_extract(e, 'p=([0-9]{1,3})', 1) AS persons
        FROM (
          SELECT *, CASE WHEN template = '{{nl-verb}}'
            THEN '{{nl-verb form of|n=pl|t=pres|m=ind|' || title || '}}' ELSE template END AS e
          FROM found WHERE language IN ('dutch', 'flemish') AND template <> '{{nl-verb-form}}')""",
    "judged": """
        SELECT *, CASE WHEN mood <> 'ind' THEN 'unsupported_mood'
            WHEN reference = '' THEN 'invalid_template'
            WHEN tense_code = '' THEN 'missing_tense'
            WHEN tense_code NOT IN ('pres', 'past') THEN 'invalid_tense'
            WHEN number_code = '' THEN 'missing_number' ELSE 'ok' END AS status
        FROM raw""",
    "decoded": """
        SELECT page_id, title, section, language, pos, template, status,
          CASE WHEN status NOT IN ('unsupported_mood', 'invalid_template')
            THEN reference END AS infinitive,
          CASE WHEN status = 'ok' THEN
            CASE tense_code WHEN 'pres' THEN 'present' ELSE 'past' END END AS tense,
          CASE WHEN status = 'ok' THEN CASE number_code WHEN 'pl' THEN 2 ELSE 1 END END AS num,
          CASE WHEN status = 'ok' AND number_code <> 'pl' THEN
            CASE WHEN persons = '' THEN 14 ELSE
              CASE WHEN contains(persons, '1') THEN 2 ELSE 0 END
              + CASE WHEN contains(persons, '2') THEN 4 ELSE 0 END
              + CASE WHEN contains(persons, '3') THEN 8 ELSE 0 END END END AS person
        FROM judged""",
    "forms": """
        SELECT language, title AS word, infinitive, tense, person, num
        FROM decoded WHERE status = 'ok'""",
    "vocabulary": """
        SELECT title AS word FROM decoded WHERE status <> 'unsupported_mood'
        UNION SELECT infinitive FROM decoded WHERE infinitive IS NOT NULL""",
    "words": "SELECT row_number() OVER (ORDER BY word) AS id, word FROM vocabulary",
    "facts": """
        SELECT CASE language WHEN 'dutch' THEN 1 ELSE 2 END AS lang_id, w.id AS word_id, i.id AS inf_id,
          CASE tense WHEN 'present' THEN 1 ELSE 2 END AS tense_id, person, num
        FROM forms JOIN words w ON w.word = forms.word JOIN words i ON i.word = infinitive""",
    "first_inf": """
        SELECT w.word, i.word AS infinitive, f.inf_id
        FROM (SELECT word_id, arg_min(inf_id, (lang_id, inf_id)) AS inf_id
              FROM facts GROUP BY word_id) f
        JOIN words w ON w.id = f.word_id JOIN words i ON i.id = f.inf_id""",
    "lookups": f"SELECT c_custkey AS lookup_id, {catalog.LOOKUP_SQL} FROM customer",
    "slots": """
        SELECT f.*, s.slot FROM facts f
        JOIN (VALUES ('First', 2), ('Second', 4), ('Third', 8), ('Plural', 1)) s(slot, bit)
          ON CASE num WHEN 2 THEN 1 ELSE person END & s.bit <> 0""",
    "entries": """
        SELECT inf_id, tense_id, slot, list(word ORDER BY word) AS forms
        FROM slots JOIN words ON words.id = word_id GROUP BY ALL""",
    "tables": """
        SELECT i.id AS inf_id, i.word AS infinitive, """
    + ", ".join(
        f"coalesce(max(forms) FILTER (tense_id = {n} AND slot = '{slot}'), []) AS {tense}_{slot}"
        for n, tense in [(1, "present"), (2, "past")]
        for slot in ["First", "Second", "Third", "Plural"]
    )
    + """
        FROM entries JOIN words i ON i.id = inf_id GROUP BY i.id, i.word""",
    "user_rows": f"""
        SELECT {", ".join(catalog.USER_SQL)}, created_at
        FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at
          FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "requests": f"SELECT o_orderkey AS request_id, {catalog.REQUEST_SQL} FROM orders",
    "accepted": """
        SELECT name, min(request_id) AS request_id FROM requests
        WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM user_rows) GROUP BY name""",
}

_LISTS = [f"{t}_{s}" for t in ["present", "past"] for s in ["First", "Second", "Third", "Plural"]]
_AS_TEXT = ", ".join(f"array_to_string({c}, ',') AS {c.lower()}" for c in _LISTS)


def _nested(tense: str) -> str:
    fields = [f"\"{s}\" := {tense}_{s}" for s in ["First", "Second", "Third", "Plural"]]
    return f"struct_pack({', '.join(fields)})"


_FLAT = " UNION ALL ".join(
    f"SELECT infinitive, '{label}' AS label, array_to_string(present_{s}, ', ') AS present,"
    f" array_to_string(past_{s}, ', ') AS past FROM tables"
    for s, label in [
        ("First", "1st person singular"),
        ("Second", "2nd person singular"),
        ("Third", "3rd person singular"),
        ("Plural", "Plural"),
    ]
)

def _violations() -> str:
    """Each constraint on its own, over the tables of ``constraint_report``."""
    sources = {
        "languages": "SELECT n_nationkey AS id, lower(n_name) AS name, substr(n_name, 8) AS tag FROM nation",
        "words": f"SELECT {', '.join(catalog.BAD_WORD_SQL)} FROM part",
        "tenses": "SELECT * FROM (VALUES (1, 'present'), (2, 'past')) t(id, tense)",
        "roles": "SELECT * FROM (VALUES (1, 'admin'), (2, 'user')) t(id, role)",
        "verb_forms": f"SELECT {', '.join(catalog.BAD_FORM_SQL)} FROM lineitem",
        "users": f"SELECT {', '.join(catalog.BAD_USER_SQL)}, 1 AS created_at FROM customer",
    }
    parts = []

    def add(constraint: str, table: str, column: str, rest: str) -> None:
        parts.append(
            f"""SELECT '{constraint}' AS "constraint", '{table}' AS "table", '{column}' AS "column",
            CAST({column} AS VARCHAR) AS value, count(*) AS n_rows FROM ({sources[table]}) {rest}"""
        )

    for table, columns in schemas.REQUIRED.items():
        for c in columns:
            add("not null", table, c, f"WHERE {c} IS NULL GROUP BY {c}")
    for table, columns in schemas.UNIQUE.items():
        for c in columns:
            add("unique", table, c, f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1")
    for (table, c), parent in schemas.FOREIGN.items():
        known = f"SELECT id FROM ({sources[parent]}) WHERE id IS NOT NULL"
        add("reference", table, c, f"WHERE {c} IS NOT NULL AND {c} NOT IN ({known}) GROUP BY {c}")
    return " UNION ALL ".join(parts)


LOST_LANGUAGES = """SELECT 'reference' AS "constraint", 'users' AS "table",
        'target_language_id' AS "column", CAST(target_language_id AS VARCHAR) AS value,
        count(*) AS n_rows FROM user_rows WHERE target_language_id NOT IN (1, 2)
        GROUP BY target_language_id"""

RESULTS = {
    "namespace_filter": "SELECT page_id, title FROM content",
    "page_lookup": f"""SELECT page_id, title, text FROM content
        WHERE title = '{catalog.PAGE_TITLE}' ORDER BY page_id LIMIT 1""",
    "early_stop": f"""SELECT page_id, 'page ' || page_id AS title FROM wiki
        WHERE 'page ' || page_id = '{catalog.EARLY_TITLE}'""",
    "page_limit": f"""SELECT page_id, title FROM content
        ORDER BY page_id LIMIT {catalog.PAGE_LIMIT}""",
    "language_sections": "SELECT page_id, title, section, language, body FROM sections",
    "verb_sections": "SELECT page_id, title, section, language, verb FROM verbs",
    "templates": "SELECT * FROM found",
    "supported_templates": "SELECT * FROM found WHERE language = 'dutch'",
    "morphology": "SELECT * FROM decoded",
    "reject_counts": "SELECT status, count(*) AS n FROM decoded GROUP BY status",
    "rejects": """SELECT page_id, title, language, section, pos, template, status
        FROM decoded WHERE status <> 'ok'""",
    "verb_forms": "SELECT * FROM forms",
    "rule_registry": """
        SELECT language, status, count(*) AS n FROM (
          SELECT language, status FROM decoded WHERE language = 'dutch'
          UNION ALL SELECT language, 'ok' FROM found WHERE language = 'english')
        GROUP BY language, status""",
    "rule_rows": """
        SELECT page_id, section, language, pos, status, infinitive, tense, num FROM decoded
        UNION ALL
        SELECT page_id, section, language, pos, 'ok', CASE tense WHEN 'past' THEN template ELSE title END, tense, 1
        FROM found, (VALUES ('present'), ('past')) t(tense)
        WHERE language = 'english' AND NOT contains(title, ':')""",
    "word_list": "SELECT word FROM vocabulary",
    "word_dictionary": "SELECT id, word FROM words",
    "language_dictionary": """SELECT DISTINCT CASE language WHEN 'dutch' THEN 1 ELSE 2 END AS id, language AS name
        FROM decoded""",
    "encoded_facts": "SELECT * FROM facts",
    "fact_ids": """SELECT count(*) AS n_ids, CAST(1 AS BIGINT) AS most_rows_per_id,
        CAST(0 AS BIGINT) AS n_missing FROM facts""",
    "forms_by_tense": "SELECT tense, num, count(*) AS n FROM forms GROUP BY tense, num",
    "all_words": """SELECT DISTINCT words.id, words.word AS text, lang_id AS language
        FROM facts JOIN words ON facts.word_id = words.id OR facts.inf_id = words.id""",
    "word_by_id": f"""SELECT words.id, word AS text, min(lang_id) AS language
        FROM facts JOIN words ON words.id = word_id
        WHERE word_id = {catalog.WORD_ID} GROUP BY words.id, word""",
    "words_by_id": """SELECT words.id, word AS text, min(lang_id) AS language
        FROM facts JOIN words ON words.id = word_id GROUP BY words.id, word""",
    "infinitive_of": f"""SELECT word, infinitive, inf_id FROM first_inf
        WHERE word = '{catalog.WORD}'""",
    "infinitive_lookups": """SELECT lookup_id, word, infinitive, inf_id
        FROM lookups JOIN first_inf USING (word) WHERE word <> ''""",
    "lookup_missing": """SELECT lookup_id, word, 'word ' || word || ' does not exist' AS error
        FROM lookups WHERE word <> '' AND word NOT IN (SELECT word FROM first_inf)""",
    "conjugation_table": f"SELECT inf_id, infinitive, {_AS_TEXT} FROM tables",
    "conjugation_slots": """SELECT inf_id, i.word AS infinitive,
        CASE tense_id WHEN 1 THEN 'Present' ELSE 'Past' END AS tense, slot, w.word AS form, count(*) AS copies
        FROM slots JOIN words i ON i.id = inf_id JOIN words w ON w.id = word_id GROUP BY ALL""",
    "conjugation_of_word": f"""SELECT infinitive, {_AS_TEXT} FROM tables WHERE inf_id =
        (SELECT inf_id FROM first_inf WHERE word = '{catalog.WORD}')""",
    "conjugation_flat": _FLAT,
    "conjugation_json": f"""SELECT inf_id, CAST(to_json(struct_pack("Infinitive" := infinitive,
        "Present" := {_nested("present")}, "Past" := {_nested("past")})) AS VARCHAR) AS json
        FROM tables""",
    "person_slots": "SELECT word_id, inf_id, tense_id, num, person, slot FROM slots",
    "lookup_default": f"""
        WITH asked AS (SELECT n_nationkey AS lookup_id, CASE n_regionkey WHEN 1 THEN ''
          WHEN 2 THEN n_name ELSE concat('w', CAST(n_nationkey AS STRING)) END AS word FROM nation)
        SELECT lookup_id, asked.word, coalesce(tables.infinitive, '') AS infinitive,
          {", ".join(f"coalesce(array_to_string({c}, ','), '') AS {c.lower()}" for c in _LISTS)}
        FROM asked LEFT JOIN first_inf ON first_inf.word = asked.word
        LEFT JOIN tables ON tables.inf_id = first_inf.inf_id WHERE asked.word <> ''""",
    "languages": """SELECT n_nationkey AS id, lower(n_name) AS name, substr(n_name, 8) AS tag
        FROM nation""",
    "languages_json": """SELECT CAST(to_json(struct_pack(id := n_nationkey, name := lower(n_name),
        tag := substr(n_name, 8))) AS VARCHAR) AS json FROM nation""",
    "words_json": """SELECT DISTINCT CAST(to_json(struct_pack(id := words.id, text := words.word,
        language := lang_id)) AS VARCHAR) AS json
        FROM facts JOIN words ON facts.word_id = words.id OR facts.inf_id = words.id""",
    "users_json": """SELECT CAST(to_json(struct_pack(id := id, name := name, role := role_id,
        "target-language" := target_language_id,
        "creation-tz" := strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'))) AS VARCHAR) AS json FROM user_rows""",
    "language_by_id": f"""SELECT n_nationkey AS id, lower(n_name) AS name,
        substr(n_name, 8) AS tag FROM nation WHERE n_nationkey = {catalog.LANGUAGE_ID}""",
    "users": "SELECT * FROM user_rows",
    "user_by_id": f"SELECT * FROM user_rows WHERE id = '{catalog.USER_ID}'",
    "admin_flag": """SELECT asked.id, coalesce(role_id = 1, false) AS is_admin
        FROM (SELECT CAST(c_custkey * 2 AS STRING) AS id FROM customer) asked
        LEFT JOIN user_rows ON user_rows.id = asked.id""",
    "new_accounts": """SELECT name, 2 AS role_id, CAST(NULL AS INTEGER) AS target_language_id
        FROM accepted""",
    "rejected_accounts": """SELECT request_id, name,
        coalesce('user ' || name || ' already exists', 'user without a name') AS error
        FROM requests WHERE request_id NOT IN (SELECT request_id FROM accepted)""",
    "uniqueness": """SELECT 'orders' AS "table", 'o_custkey' AS "column",
        CAST(o_custkey AS VARCHAR) AS value, count(*) AS n_rows
        FROM orders GROUP BY o_custkey HAVING count(*) > 1""",
    "orphans": """SELECT 'orders' AS "table", 'o_custkey' AS "column",
        CAST(o_custkey AS VARCHAR) AS value, count(*) AS n_rows
        FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey""",
    "null_violations": " UNION ALL ".join(
        f"""SELECT 'decoded' AS "table", '{c}' AS "column", count(*) AS n_rows FROM decoded
        WHERE {c} IS NULL HAVING count(*) > 0"""
        for c in ["title", "template", "infinitive", "tense", "num", "person"]
    ),
    "constraint_report": _violations(),
    "store_constraints": LOST_LANGUAGES,
    "kept_constraints": LOST_LANGUAGES,
    "empty_result": """SELECT 'no words exist' AS error FROM facts HAVING count(*) = 0
        UNION ALL SELECT 'no words in 99 exist' FROM facts WHERE lang_id = 99
        HAVING count(*) = 0""",
    "dump_scan": "SELECT page_id, title, text FROM wiki",
    "dump_scan_bz2": "SELECT page_id, title, text FROM wiki",
    "dump_cdata": f"""SELECT page_id, title,
        CASE WHEN {catalog.CDATA_SQL} THEN {catalog.PAGE_END_SQL} ELSE text END AS text FROM wiki""",
    "streamed_words": "SELECT word FROM vocabulary",
    "kept_conjugation_tables": f"SELECT infinitive, {_AS_TEXT} FROM tables",
    "kept_table_of_word": f"""SELECT infinitive, {_AS_TEXT} FROM tables WHERE inf_id =
        (SELECT inf_id FROM first_inf WHERE word = '{catalog.KEPT_WORD}')""",
    "corrupt_pages": f"SELECT page_id FROM wiki WHERE page_id % {catalog.BROKEN_EVERY} = 0",
    "incremental_forms": """SELECT word, infinitive,
        CASE tense WHEN 'present' THEN 1 ELSE 2 END AS tense_id, num, person FROM forms""",
}


def statement(name: str) -> str:
    """The full SQL of a result, with only the steps that it needs."""
    needed: list[str] = []
    wanted = RESULTS[name]
    for step, sql in reversed(STEPS.items()):
        if any(_mentions(text, step) for text in [wanted, *[STEPS[n] for n in needed]]):
            needed.append(step)
    ctes = ", ".join(f"{step} AS ({STEPS[step]})" for step in reversed(needed))
    return f"WITH {ctes} SELECT * FROM ({wanted})" if ctes else wanted


def _mentions(sql: str, step: str) -> bool:
    return step in sql.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split()
